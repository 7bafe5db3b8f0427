"""Which columns may identify a person, judged by name and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.estimators import two_decimals
from facsimile.functions.missing import present
from facsimile.operators.columns import column_class, name_of, numeric_cells, tally, text_cells

# Names, or parts of a name between underscores, that identify a person.
IDENTIFIER_NAMES = [
    "id", "user_id", "customer_id", "email", "phone", "name", "address",
    "ssn", "ip_address", "uuid", "guid",
]
SAFE, WARNING, HIGH_CARDINALITY = "SAFE", "WARNING", "HIGH-CARDINALITY"


def matches_identifier(name: Column) -> Column:
    """Whether the whole name or one of its underscore parts is an identifier."""
    known = F.array(*[F.lit(n) for n in IDENTIFIER_NAMES])
    lower = F.lower(name)
    return F.array_contains(known, lower) | F.arrays_overlap(F.split(lower, "_"), known)


def uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct present values per column over all rows: (position, column_name, num_rows, num_unique, ratio)."""
    names = columns or df.columns
    types = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in names if column_class(types[c]) == "numeric"]
    other = [c for c in names if c not in numeric]
    rows = df.agg(F.count(F.lit(1)).alias("num_rows"))
    counted = None
    for group, cells in ((numeric, numeric_cells), (other, text_cells)):
        if group:
            own = cells(df, group)
            if group is other:
                own = own.withColumn("value", F.md5("value"))  # only their number is wanted, so no text is shuffled
            part = tally(own).groupBy("cid").agg(F.count(F.lit(1)).alias("num_unique"))
            part = part.select(name_of(F.col("cid"), group).alias("column_name"), "num_unique")
            counted = part if counted is None else counted.unionByName(part)
    listing = rows.select("num_rows", F.posexplode(F.array(*[F.lit(c) for c in names])).alias("position", "column_name"))
    unique = F.coalesce("num_unique", F.lit(0).cast("bigint"))
    return listing.join(counted, "column_name", "left").where(F.col("num_rows") > 0).select(
        "position", "column_name", "num_rows", unique.alias("num_unique"),
        (unique / F.col("num_rows")).alias("uniqueness_ratio"),
    )


def scan_privacy(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One verdict per column: (position, column_name, warning_level, reason); none for an empty table.

    ``counted`` has the columns of :func:`uniqueness`, for a caller who counted already.
    """
    kinds = F.create_map(*[
        F.lit(v) for f in df.schema for v in (f.name, column_class(f.dataType))
    ])
    rows = (uniqueness(df) if counted is None else counted).withColumns({
        "kind": F.element_at(kinds, F.col("column_name")),
        "named": matches_identifier(F.col("column_name")),
    })
    ratio = F.col("uniqueness_ratio")
    crowded = (F.col("kind") == "categorical") & (ratio > 0.8)
    numeric = F.col("kind").isin("numeric", "boolean")
    level = F.when(F.col("named"), WARNING).when(crowded, HIGH_CARDINALITY).otherwise(SAFE)
    # The wording of the reasons.
    reason = (
        F.when(F.col("named"), F.format_string(
            "Column name matches identifier heuristic. Uniqueness ratio: %.2f", two_decimals(ratio)))
        .when(numeric, F.lit("Numeric column not matching identifier heuristic."))
        .when(crowded, F.format_string(
            "High cardinality categorical column (%.0f%% unique values). Potential identifier.", F.rint(ratio * 100)))
        .otherwise(F.lit("Did not flag identifier heuristics."))
    )
    return rows.select("position", "column_name", level.alias("warning_level"), reason.alias("reason"))


def alerts(warnings: DataFrame) -> DataFrame:
    """The verdicts that call for attention."""
    return warnings.where(F.col("warning_level") != SAFE)
