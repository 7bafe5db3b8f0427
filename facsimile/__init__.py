"""Profile tables, generate look-alikes from the profile, and measure the likeness, on Spark."""

from facsimile.operators.copula import impose_rank_correlation
from facsimile.operators.privacy import scan_privacy
from facsimile.plans.generate import generate_table
from facsimile.plans.profile import Profile, Profiler, profile_table
from facsimile.plans.report import fidelity_run, numeric_fidelity, quality_report
from facsimile.plans.validate import Validation, validate_tables
from facsimile.sources.profiles import load_profile, save_profile
from facsimile.sources.staging import release, run
from facsimile.sources.tables import EmptyTableError, read_table, require_rows, write_table

__all__ = [
    "EmptyTableError", "Profile", "Profiler", "Validation", "fidelity_run", "generate_table",
    "impose_rank_correlation", "load_profile", "numeric_fidelity", "profile_table", "quality_report",
    "read_table", "release", "require_rows", "run", "save_profile", "scan_privacy", "validate_tables", "write_table",
]
