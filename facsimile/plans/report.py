"""Report tables over a profile and a validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.operators.columns import ROOT
from facsimile.operators.privacy import alerts
from facsimile.plans.generate import generate_table
from facsimile.plans.profile import Profile, profile_table
from facsimile.plans.validate import Validation, validate_tables
from facsimile.sources.staging import stage
from facsimile.sources.tables import require_rows


def numeric_fidelity(validation: Validation) -> DataFrame:
    """(position, column, ks, mean_error, median_error) of numeric columns; 0 where a side is empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return validation.columns.where("type = 'numeric'").select(
        "position", F.col("column_name").alias("column"), zero("ks_statistic").alias("ks"),
        zero("mean_diff").alias("mean_error"), zero("median_diff").alias("median_error"))


def quality_report(profile: Profile, validation: Validation) -> DataFrame:
    """The whole report in long form: (section, item, metric, value)."""

    def long(rows: DataFrame, section: str, item: Column, metrics: dict[str, Column]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("string").alias("value")) for m, c in metrics.items()])
        return rows.select(F.lit(section).alias("section"), item.alias("item"), F.inline(entries))

    col = F.col
    meta = profile.meta.where(col("grp") == ROOT)
    view = ["type", "missing_pct", "unique", "min", "max", "mean", "is_primary_key", "semantic_type"]
    parts = [
        long(meta, "dataset", F.lit("table"), {"rows": col("num_rows"), "columns": col("num_columns")}),
        long(validation.score, "quality", F.lit("table"), {
            "overall": col("overall"), "correlation_error": col("mean_absolute_correlation_error")}),
        long(alerts(profile.warnings), "privacy", col("column_name"), {
            "level": col("warning_level"), "reason": col("reason")}),
        long(numeric_fidelity(validation), "numeric", col("column"), {
            m: col(m) for m in ("ks", "mean_error", "median_error")}),
        long(profile.view(), "profile", col("column"), {m: col(m) for m in view}),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


@dataclass
class FidelityRun:
    """Everything one end-to-end run yields."""

    profile: Profile
    synthetic: DataFrame
    validation: Validation
    report: DataFrame


def fidelity_run(df: DataFrame, rows: int = 100, seed: int = 42, **profile_options) -> FidelityRun:
    """Profile a table, scan it, generate a synthetic one, compare both and report."""
    profile = profile_table(require_rows(df), **profile_options)
    synthetic = stage(generate_table(profile, rows, seed), "synthetic")
    validation = validate_tables(df, synthetic)
    return FidelityRun(profile, synthetic, validation, quality_report(profile, validation))
