"""Statistics of numeric columns from their ordered value counts.

All measures read the same staged table, which holds each distinct value once
with its number of occurrences: a value that fills a third of the rows costs
one row here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.estimators import (
    adjusted_skewness, auto_bin_count, bin_index, decimals_of, interpolated, sample_std,
)
from facsimile.functions.hashed import laplace, uniform
from facsimile.operators.columns import KEYS, ROOT
from facsimile.operators.ordered import Ordered, ordered
from facsimile.operators.sizing import broadcast_if_small

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
KDE_LIMIT = 1000


def ordered_values(counts: DataFrame, weights: list[str], name: str = "values",
                   counters: Iterable[str] = ()) -> Ordered:
    """Order the value counts of numeric cells; collect first-pass measures on the way.

    Per weight ``w``: ``n_w`` values, ``moment_w``, ``distinct_w``, ``min_w``, ``max_w``.
    ``counters`` get running totals only.
    """
    measures, per_key = {}, {}
    value = F.col("value")
    for w in weights:
        seen = F.col(w) > 0
        measures[f"part_moment_{w}"] = F.sum(value * F.col(w))
        measures[f"part_distinct_{w}"] = F.count(F.when(seen, 1))
        measures[f"part_min_{w}"] = F.min(F.when(seen, value))
        measures[f"part_max_{w}"] = F.max(F.when(seen, value))
        per_key[f"moment_{w}"] = F.sum(f"part_moment_{w}")
        per_key[f"distinct_{w}"] = F.sum(f"part_distinct_{w}")
        per_key[f"min_{w}"] = F.min(f"part_min_{w}")
        per_key[f"max_{w}"] = F.max(f"part_max_{w}")
    if "wide" in counts.columns:
        measures["part_wide"] = F.max(F.col("wide").isNotNull())
    measures["part_decimals"] = F.max(decimals_of(value))
    per_key["decimals"] = F.max("part_decimals")
    order = ["value", "wide"] if "wide" in counts.columns else ["value"]
    return ordered(counts, KEYS, order, [*weights, *counters], name, measures, per_key)


NO_FACTS = {"n_root": 0, "distinct": 0, "wide": False}


def column_facts(values: Ordered) -> dict[int, dict]:
    """What plans need to know per column: values in the table, distinct values over
    all groups, and whether any integer is too wide for a double."""
    w = values.weights[0]
    rows = values.parts.groupBy("cid").agg(
        F.sum(F.when(F.col("grp") == ROOT, F.col(f"sum_{w}"))).alias("n_root"),
        F.sum(f"part_distinct_{w}").alias("distinct"), F.max("part_wide").alias("wide"),
    )
    return {r["cid"]: r.asDict() for r in rows.collect()}


def _mean(w: str) -> Column:
    return F.try_divide(F.col(f"moment_{w}"), F.col(f"n_{w}").cast("double"))


def quartiles(w: str) -> list[Column]:
    """Quartiles of one weight, as aggregates of ``positioned`` rows."""
    cum, n = F.col(f"cum_{w}"), F.col(f"n_{w}")
    aggregates = []
    for q, p in QUARTILES.items():
        h = (n - 1).cast("double") * p
        held = F.col(w) > 0
        low = F.min(F.when(held & (cum > F.floor(h)), F.col("value")))
        high = F.min(F.when(held & (cum > F.ceil(h)), F.col("value")))
        aggregates.append(interpolated(low, high, F.first(f"n_{w}"), p).alias(f"{q}_{w}"))
    return aggregates


def moment_statistics(moments: DataFrame, places: list[int]) -> DataFrame:
    """(grp, cid, mean_cnt, std_cnt, skewness_cnt, min_cnt, max_cnt) of numeric columns, from one pass over the table.

    ``places`` are the columns' places in the table, by which ``moments`` goes.
    """
    cid = F.array_position(F.array(*[F.lit(p) for p in places]), F.col("cid")).cast("int") - 1
    return moments.where(F.col("cid").isin(places)).select(
        "grp", cid.alias("cid"), F.col("mean").alias("mean_cnt"), sample_std(F.col("n"), F.col("m2")).alias("std_cnt"),
        adjusted_skewness(F.col("n"), F.col("m2"), F.col("skew")).alias("skewness_cnt"),
        F.col("lo").alias("min_cnt"), F.col("hi").alias("max_cnt"))


def order_statistics(values: Ordered) -> DataFrame:
    """(grp, cid, n_cnt, distinct_cnt, decimals, quartiles) from the ordered value counts."""
    known = ["n_cnt", "distinct_cnt", "decimals"]
    rows = values.positioned(*known).groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in known], *quartiles("cnt"))
    return rows.withColumn("iqr_cnt", F.col("q3_cnt") - F.col("q1_cnt"))


def numeric_summary(values: Ordered, weights: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Mean, spread, quartiles and range per (grp, cid); column names end in the weight.

    ``extra`` adds further aggregates over the positioned rows to the same pass.
    """
    known = [f"{m}_{w}" for w in weights for m in ("n", "moment", "min", "max")]
    away = lambda w: F.col("value") - _mean(w)
    rows = values.positioned(*known).groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in known],
        *[F.sum(away(w) * away(w) * F.col(w)).alias(f"m2_{w}") for w in weights],
        *[a for w in weights for a in quartiles(w)],
        *[a.alias(name) for name, a in (extra or {}).items()],
    )
    derived = {}
    for w in weights:
        derived[f"mean_{w}"] = _mean(w)
        derived[f"std_{w}"] = sample_std(F.col(f"n_{w}"), F.col(f"m2_{w}"))
    return rows.withColumns(derived).drop(*[f"{m}_{w}" for w in weights for m in ("m2", "moment")])


def with_capped_range(stats: DataFrame, cap: bool) -> DataFrame:
    """Add ``min_value`` and ``max_value``, pulled in to the 1.5 IQR fences if asked."""
    low, high = F.col("min_cnt"), F.col("max_cnt")
    if cap:
        low = F.greatest(low, F.col("q1_cnt") - F.col("iqr_cnt") * 1.5)
        high = F.least(high, F.col("q3_cnt") + F.col("iqr_cnt") * 1.5)
    return stats.withColumns({"min_value": low, "max_value": high})


def is_discrete() -> Column:
    """Whole numbers with few distinct values, absolutely or by share."""
    share = F.col("distinct_cnt") / F.greatest(F.col("n_cnt"), F.lit(1))
    return (F.col("decimals") == 0) & ((F.col("distinct_cnt") < 20) | (share < 0.05))


def with_bins(stats: DataFrame) -> DataFrame:
    """Add the edges ``first``, ``last`` and the number of ``bins`` of the histogram."""
    flat = F.col("min_cnt") == F.col("max_cnt")
    bins = auto_bin_count(F.col("n_cnt"), F.col("min_cnt"), F.col("max_cnt"), F.col("iqr_cnt"), F.col("integral"))
    return stats.withColumns({
        "first": F.when(flat, F.col("min_cnt") - 0.5).otherwise(F.col("min_cnt")),
        "last": F.when(flat, F.col("max_cnt") + 0.5).otherwise(F.col("max_cnt")),
        "bins": F.when(flat, F.lit(1).cast("bigint")).otherwise(bins),
    })


def histogram(values: Ordered, binned: DataFrame, rows: int) -> DataFrame:
    """Counts of all bins, empty ones included: (grp, cid, bin, left_edge, right_edge, count).

    ``binned`` comes from :func:`with_bins`, one row per key, ``rows`` in all.
    A column has at most about 2 sqrt(n) bins.
    """
    shape = binned.where(F.col("n_cnt") > 1).select(*KEYS, "first", "last", "bins")
    place = bin_index(F.col("value"), F.col("first"), F.col("last"), F.col("bins"))
    found = (
        values.rows.join(broadcast_if_small(shape, rows), KEYS)
        .groupBy(*KEYS, place.alias("bin")).agg(F.sum("cnt").alias("count"))
    )
    frame = shape.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)))
    step = (F.col("last") - F.col("first")) / F.col("bins")
    edge = lambda i: F.when(i == F.col("bins"), F.col("last")).otherwise(F.col("first") + i * step)
    return frame.join(found, [*KEYS, "bin"], "left").select(
        *KEYS, "bin",
        edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def value_sample(values: Ordered, chosen: DataFrame, rows: int, seed: int, limit: int = KDE_LIMIT) -> DataFrame:
    """At most ``limit`` values per key, without replacement: (grp, cid, idx, value).

    The ordered values are cut into equal strata and one position is drawn in
    each, so the sample is found where the position falls: no sort, no heap,
    no group gathered anywhere. A column of ``limit`` values or fewer is taken whole.
    """
    inside = (
        values.positioned("n_cnt")
        .join(broadcast_if_small(chosen.select(*KEYS), rows), KEYS)
        .withColumns({
            "size": F.least(F.col("n_cnt"), F.lit(limit).cast("bigint")),
            "begin": F.col("cum_cnt") - F.col("cnt"),
        })
    )
    # Stratum s holds the positions p with p * size div n = s.
    strata = inside.select(
        *KEYS, "value", "n_cnt", "size", "begin", "cum_cnt",
        F.explode(F.expr("sequence(begin * size div n_cnt, (cum_cnt - 1) * size div n_cnt)")).alias("idx"),
    ).withColumns({
        "first": F.expr("(idx * n_cnt + size - 1) div size"),
        "after": F.expr("((idx + 1) * n_cnt + size - 1) div size"),
    })
    u = uniform("kde", seed, F.col("grp"), F.col("cid"), F.col("idx"))
    position = F.col("first") + F.floor(u * (F.col("after") - F.col("first")))
    return strata.where((position >= F.col("begin")) & (position < F.col("cum_cnt"))).select(*KEYS, "idx", "value")


def with_moment_noise(stats: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """Laplace noise on mean and standard deviation, scaled to the (capped) range over n.

    Only these two are covered: range, quartiles, skewness and distinct counts
    stay exact, and each statistic spends ``epsilon`` anew. The noisy standard
    deviation is kept from falling below 0.
    """
    scale = (F.col("max_value") - F.col("min_value")) / F.greatest(F.col("n_cnt"), F.lit(1)) / epsilon
    draw = lambda tag: laplace(scale, tag, seed, F.col("grp"), F.col("cid"))
    return stats.withColumns({
        "mean_cnt": F.col("mean_cnt") + draw("mean"),
        "std_cnt": F.greatest(F.col("std_cnt") + draw("std"), F.lit(0.0)),
    })


def with_count_noise(bins: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """Laplace(1/epsilon) noise on each bin count, cut to a whole number not below 0."""
    noise = laplace(F.lit(1.0 / epsilon), "bin", seed, F.col("grp"), F.col("cid"), F.col("bin"))
    return bins.withColumn("count", F.greatest((F.col("count") + noise).cast("bigint"), F.lit(0)).cast("bigint"))
