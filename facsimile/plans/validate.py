"""Comparison of a synthetic table with its reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators import comparison
from facsimile.plans.together import together
from facsimile.sources.session import prefer_compiled_methods
from facsimile.sources.staging import stage

_METRICS = [
    "ks_statistic", "ks_p_value", "mean_diff", "median_diff", "std_diff", "quantile_diff",
    "numeric_distribution_error", "range_ref_min", "range_ref_max", "range_synth_min", "range_synth_max",
]


@dataclass
class Validation:
    """``columns``: one row of metrics per compared column; ``score``: one row.

    ``correlation_status`` says why the correlation error is missing, if it is.
    """

    columns: DataFrame
    score: DataFrame
    correlation_status: str = "compared"


def column_metrics(ref: DataFrame, synth: DataFrame) -> DataFrame:
    """Status and metrics of every column both tables have."""
    pairs = comparison.paired_columns(ref, synth)
    listing = comparison.listing(ref, synth)
    numeric = [n for n, kind in pairs if kind == comparison.NUMERIC]
    labels = [n for n, kind in pairs if kind == comparison.CATEGORICAL]
    if numeric:
        listing = listing.join(comparison.numeric_metrics(ref, synth, numeric), "column_name", "left")
    else:
        listing = listing.withColumns({m: F.lit(None).cast("double") for m in _METRICS})
    if labels:
        listing = listing.join(comparison.category_metrics(ref, synth, labels), "column_name", "left")
    else:
        listing = listing.withColumn("mean_freq_diff", F.lit(None).cast("double"))
    # only columns with values on both sides have figures
    compared = F.col("ks_statistic").isNotNull() | F.col("mean_freq_diff").isNotNull()
    status = F.when(compared, "compared").otherwise("empty").alias("status")
    return listing.select("position", "column_name", "type", status, *_METRICS, "mean_freq_diff")


def validate_tables(ref: DataFrame, synth: DataFrame) -> Validation:
    """Compare two tables column by column, their correlations, and score the likeness."""
    prefer_compiled_methods(ref.sparkSession)
    done = together(
        ref.sparkSession,
        columns=lambda: stage(column_metrics(ref, synth), "column-metrics"),
        correlation=lambda: comparison.correlation_error(ref, synth),
    )
    status = "compared" if done["correlation"] is not None else "Not enough numeric columns"
    return Validation(done["columns"], comparison.quality_score(done["columns"], done["correlation"]), status)
