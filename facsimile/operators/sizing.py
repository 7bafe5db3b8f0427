"""Joins and running totals whose strategy follows a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast, or a window run over unsplit keys, only up to this many rows.
SMALL_ROWS = 200_000
# Where the width of a row is known, or is not a few numbers, bytes decide.
SMALL_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a side for broadcast if it is small; otherwise let it shuffle.

    ``rows`` is its size or a proven bound of it, when the caller knows one;
    else it is counted, so ``df`` should be staged or cached.
    """
    if rows is None:
        rows = df.limit(SMALL_ROWS + 1).count()
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def salted_join(df: DataFrame, key: str, size: str, place: str, side: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """Left join of ``df`` to the one row of ``side`` that has its key, where a key may hold any share of the rows.

    ``size`` is the number of rows of a row's key and ``place`` its number among
    them; ``sizes`` has (key, size) once per key. A key's rows are dealt to as
    many salts as they fill eighths of a task's share, and its row of ``side`` is
    repeated for each: some eight times the number of tasks more rows in all.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, rows // (8 * tasks))
    salts = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / share)
    repeated = side.join(sizes.withColumnRenamed(size, "_size"), key).withColumn(
        "_side_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts("_size") - 1))).withColumnRenamed(key, "_side_key")
    dealt = df.withColumn("_salt", F.pmod(F.col(place), salts(size)))
    on = (F.col(key) == F.col("_side_key")) & (F.col("_salt") == F.col("_side_salt"))
    return dealt.join(repeated, on, "left").drop("_salt", "_side_salt", "_side_key", "_size")


def skew_safe_lookup(
    df: DataFrame,
    on: dict[str, str],
    table: DataFrame,
    hot: DataFrame,
    payload: dict[str, str],
) -> DataFrame:
    """Left lookup in a large table with unique keys.

    ``on`` maps key columns of ``df`` to those of ``table``, ``payload`` the
    table's columns to their new names; the first is never null. ``hot`` holds the
    keys that many rows of ``df`` carry, a subset of ``table`` whose size the
    caller bounds, and is broadcast. Rows answered there, and rows without a key, are
    scattered over all tasks of the shuffled join instead of meeting in one.
    """
    answers = hot.select(
        *[F.col(r).alias(f"_hot_{i}") for i, r in enumerate(on.values())],
        *[F.col(p).alias(f"_hot_{a}") for p, a in payload.items()],
    )
    match = [F.col(left) == F.col(f"_hot_{i}") for i, left in enumerate(on)]
    answered = df.join(F.broadcast(answers), match, "left")
    names = list(payload.values())
    open_row = F.col(f"_hot_{names[0]}").isNull()
    for left in on:
        open_row = open_row & F.col(left).isNotNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(9973)) + 1
    keyed = answered.withColumns({
        "_salt": F.when(open_row, F.lit(0).cast("bigint")).otherwise(spread),
        **{f"_key_{i}": F.when(open_row, F.col(left)) for i, left in enumerate(on)},
    })
    # pmod(…, 1) is always 0 but not a literal, so the salt stays a join key.
    cold = table.select(
        *[F.col(r).alias(f"_cold_{i}") for i, r in enumerate(on.values())],
        F.pmod(F.xxhash64(*[F.col(r) for r in on.values()]), F.lit(1)).alias("_zero"),
        *[F.col(p).alias(f"_cold_{a}") for p, a in payload.items()],
    )
    match = [F.col(f"_key_{i}") == F.col(f"_cold_{i}") for i in range(len(on))]
    joined = keyed.join(cold, [*match, F.col("_salt") == F.col("_zero")], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(f"_hot_{a}", f"_cold_{a}").alias(a) for a in names],
    )


def exclusive_total(weight: str, keys: list[str], order: list[Column]) -> Column:
    """Sum of the weights strictly before the row, within small keys."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
