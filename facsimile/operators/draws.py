"""Drawing values from segments and weights."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.operators.ordered import ordered
from facsimile.operators.sizing import SMALL_BYTES, SMALL_ROWS, broadcast_if_small, exclusive_total
from facsimile.sources.staging import keep


class Size(NamedTuple):
    """How large a lookup table is: most rows of one group, rows in all, groups, bytes of its longest row."""

    entries: int
    total: int
    groups: int
    widest: int = 64

    @property
    def spread(self) -> int:
        """At most so many rows once segments are repeated per bucket that they meet."""
        return self.total + self.groups * _grid(self.entries)

    @property
    def small(self) -> bool:
        """Fit for a broadcast in rows and in bytes, repeats counted."""
        return self.total <= SMALL_ROWS and self.spread * self.widest <= SMALL_BYTES


def _grid(entries: int) -> int:
    """Buckets for so many segments: the next power of two, so a bucket meets about two."""
    return min(max(1 << max(entries - 1, 1).bit_length(), 16), 1 << 20)


def by_segment(rows: DataFrame, u: str, segments: DataFrame, carry: list[str], size: Size) -> DataFrame:
    """Join each row to the segment of its group that holds ``u``.

    ``segments`` has (grp, lo, hi, *carry) and covers [0, 1) per group. The range
    condition is reduced to an equality on a bucket of u.
    """
    grid = _grid(size.entries)
    last = F.lit(grid - 1).cast("bigint")
    spread = segments.select(
        F.col("grp").alias("_seg_grp"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
        *[F.col(c) for c in carry],
        F.explode(F.sequence(F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), last))).alias("_seg_bucket"),
    )
    keyed = rows.withColumn("_bucket", F.floor(F.col(u) * grid))
    on = [
        F.col("_bucket") == F.col("_seg_bucket"), F.col("grp") == F.col("_seg_grp"),
        F.col(u) >= F.col("_lo"), F.col(u) < F.col("_hi"),
    ]
    # A segment appears once, and once more per bucket border it crosses.
    joined = keyed.join(broadcast_if_small(spread, size.spread), on, "left")
    return joined.drop("_bucket", "_seg_bucket", "_seg_grp")


def draw_numeric(rows: DataFrame, u: str, segments: DataFrame, size: Size, alias: str) -> DataFrame:
    """Value at ``u`` of the inverse distribution function given by the segments."""
    joined = by_segment(rows, u, segments, ["x0", "x1"], size)
    share = (F.col(u) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    value = F.col("x0") + (F.col("x1") - F.col("x0")) * share
    return joined.withColumn(alias, value).drop("_lo", "_hi", "x0", "x1")


def weight_segments(weights: DataFrame, keys: list[str], order: list[Column], weight: str) -> DataFrame:
    """Lay the weights of each key end to end on [0, 1): adds lo and hi. For keys of few rows; see ``laid_in_slices``."""
    laid = weights.withColumns({
        "_before": exclusive_total(weight, keys, order),
        "_total": F.sum(weight).over(Window.partitionBy(*keys)),
    })
    return _scaled(laid, F.col("_before"), F.col("_before") + F.col(weight), F.col("_total")).drop("_before", "_total")


def laid_in_slices(weights: DataFrame, order: list[str], weight: str) -> DataFrame:
    """As ``weight_segments`` per grp, by a range sort over all tasks: no group is one task, however many weights differ."""
    laid = ordered(weights, ["grp"], order, [weight], "classes").positioned(f"n_{weight}")
    total = F.col(f"cum_{weight}")
    return _scaled(laid, total - F.col(weight), total, F.col(f"n_{weight}")).drop(f"cum_{weight}", f"n_{weight}")


def _scaled(laid: DataFrame, low: Column, high: Column, total: Column) -> DataFrame:
    return laid.withColumns({"lo": low / total, "hi": high / total})


def draw_category(rows: DataFrame, u: str, categories: DataFrame, size: Size, alias: str) -> DataFrame:
    """Weighted choice among (grp, value, weight) by the uniform ``u``.

    A table fit for a broadcast is laid out as segments. Others are drawn in
    two steps: first how heavy, then which of that weight. Distinct weights w
    of n cells sum to at most n, so there are at most sqrt(2n) of them, while
    the categories of one weight are equally likely and can be numbered and met
    by equality. Noisy weights may all differ; their classes are then as many as
    the categories. Texts meet the rows in a shuffle only. One drawn by more than 1/1000
    of the rows lies there in that many copies, among which its rows choose.
    """
    positive = categories.where("weight > 0")
    if size.small:
        laid = weight_segments(positive, ["grp"], [F.col("weight").desc(), F.col("value")], "weight")
        joined = by_segment(rows, u, laid, ["value"], size)
        return joined.withColumnRenamed("value", alias).drop("_lo", "_hi")
    numbered = ordered(positive.withColumn("one", F.lit(1).cast("bigint")), ["grp", "weight"], ["value"], ["one"], "dictionary")
    classes = numbered.parts.groupBy("grp", "weight").agg(F.first("n_one").alias("members"))
    classes = keep(classes.withColumn("mass", F.col("weight") * F.col("members")))
    most, total = classes.groupBy("grp").count().agg(F.max("count"), F.sum("count")).first()
    if (total or 0) <= SMALL_ROWS:
        laid = weight_segments(classes, ["grp"], [F.col("weight").desc()], "mass")
    else:
        laid = laid_in_slices(classes, ["weight"], "mass")
    joined = by_segment(rows, u, laid, ["weight", "members", "mass"], Size(most or 0, total or 0, size.groups))
    share = (F.col(u) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    member = F.least(F.floor(share * F.col("members")), F.col("members") - 1) + 1
    # The root level is the heaviest, and it and all groups together each hold fewer than 1000 copies beyond the first.
    heaviest = classes.groupBy("grp").agg(F.sum("mass").alias("mass")).agg(F.max("mass")).first()[0] or 1
    copies = lambda w: F.ceil(F.col(w) * 1000.0 / heaviest)
    place = F.xxhash64(u, *rows.columns[:2])
    placed = joined.withColumns({
        # rows that draw nothing are scattered instead of meeting in one task
        "_member": member, "_copy": F.coalesce(F.pmod(place, copies("weight")), place),
    }).withColumnRenamed("weight", "_weight").drop("_lo", "_hi", "members", "mass")
    dictionary = numbered.positioned().select(
        F.col("grp").alias("_grp"), F.col("weight").alias("_heavy"), F.col("cum_one").alias("_number"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), copies("weight") - 1)).alias("_nth"), F.col("value").alias(alias))
    on = [F.col(a) == F.col(b) for a, b in (("grp", "_grp"), ("_weight", "_heavy"), ("_member", "_number"), ("_copy", "_nth"))]
    return placed.join(dictionary, on, "left").drop("_weight", "_member", "_copy", "_grp", "_heavy", "_number", "_nth")
