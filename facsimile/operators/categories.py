"""Frequencies of categories, and what a column's name says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.hashed import laplace
from facsimile.operators.columns import KEYS
from facsimile.operators.sizing import broadcast_if_small

# Parts of a name that mark a key column.
KEY_NAME_PARTS = ["id", "uuid", "key", "index", "hash"]

# Parts of a name and the kind of personal data they mean; first match wins.
SEMANTIC_NAME_PARTS = [
    ("email", ["email", "e-mail"]),
    ("first_name", ["first_name", "fname"]),
    ("last_name", ["last_name", "lname"]),
    ("name", ["name"]),
    ("phone_number", ["phone", "mobile", "cell"]),
    ("address", ["address", "street"]),
    ("city", ["city", "town"]),
    ("zipcode", ["zip", "postal"]),
    ("country", ["country"]),
    ("company", ["company", "organization", "employer"]),
]


def _mentions(name: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(F.lower(name), F.lit(part))
    return found


def is_key(name: Column, distinct: Column, present: Column) -> Column:
    """A key-like name over values that are all different."""
    return _mentions(name, KEY_NAME_PARTS) & (distinct == present) & (distinct > 0)


def semantic_type(name: Column) -> Column:
    """Kind of personal data a column name announces, or null."""
    expr = F.lit(None).cast("string")
    for kind, parts in reversed(SEMANTIC_NAME_PARTS):
        expr = F.when(_mentions(name, parts), F.lit(kind)).otherwise(expr)
    return expr


def label_totals(counts: DataFrame) -> DataFrame:
    """Present and distinct values per (grp, cid)."""
    return counts.groupBy(*KEYS).agg(
        F.sum("cnt").alias("n_cnt"), F.count(F.lit(1)).alias("distinct_cnt")
    )


# Noisy counts live on a grid of 1/1000, so that weights stay whole numbers.
WEIGHT_GRID = 1000


def frequencies(counts: DataFrame, totals: DataFrame, rows: int,
                epsilon: float | None = None, seed: int = 0) -> DataFrame:
    """Relative frequency of each category: (grp, cid, value, weight, frequency).

    With ``epsilon``, each count gets Laplace(1/epsilon) noise and is cut at 0;
    if nothing is left of a column, its true counts stay.
    """
    small = broadcast_if_small(totals.select(*KEYS, "n_cnt"), rows)
    if epsilon is None:
        return counts.join(small, KEYS).select(
            *KEYS, "value", F.col("cnt").alias("weight"), (F.col("cnt") / F.col("n_cnt")).alias("frequency")
        )
    noise = laplace(F.lit(1.0 / epsilon), "category", seed, F.col("grp"), F.col("cid"), F.col("value"))
    grid = F.greatest(F.round((F.col("cnt") + noise) * WEIGHT_GRID), F.lit(0.0)).cast("bigint")
    noisy = counts.withColumn("noisy", grid)
    noisy_totals = noisy.groupBy(*KEYS).agg(F.sum("noisy").alias("noisy_total"))
    joined = noisy.join(small, KEYS).join(broadcast_if_small(noisy_totals, rows), KEYS)
    kept = F.col("noisy_total") > 0
    return joined.select(
        *KEYS, "value",
        F.when(kept, F.col("noisy")).otherwise(F.col("cnt")).alias("weight"),
        F.when(kept, F.col("noisy") / F.when(kept, F.col("noisy_total")))
        .otherwise(F.col("cnt") / F.col("n_cnt")).alias("frequency"),
    )
