"""Spearman and Pearson correlations of all numeric column pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.missing import present
from facsimile.operators.columns import ROOT, level_cells, name_of, numeric_rows, row_cells, tally
from facsimile.operators.gram import common_counts, pair_moments, score_products
from facsimile.operators.numeric import NO_FACTS, column_facts, ordered_values
from facsimile.operators.ordered import Ordered
from facsimile.operators.packed import SLICE_CELLS, SLICES, block_products
from facsimile.operators.sizing import SMALL_BYTES, broadcast_if_small, skew_safe_lookup
from facsimile.sources.staging import keep, stage

#: Rows of a group that are dealt to one task at least, when cells of a row come together.
BUCKET_ROWS = 1 << 14
#: Columns with gaps up to which rows are counted by the set of those present, some thousand sets at most.
MASK_COLUMNS = 10


@dataclass
class Gaps:
    """Where missing values of one numeric column cut out values of another.

    ``counters`` names one column (by its place) for each pattern of gaps;
    ``pattern`` is, per column, the number of its pattern among them, counted
    from 1; 0 stands for a column that cuts out nothing.
    """

    counters: dict[str, int]
    pattern: list[int]


def staged_numbers(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """The numeric columns, read once and written with a number per row."""
    return stage(numeric_rows(df, columns, by).withColumn("row", F.monotonically_increasing_id()), "numbers")


def _present_together(numbers: DataFrame, count: int) -> dict[tuple[int, int], int]:
    """Rows in which both columns i <= j are present. Only columns with gaps need a look at each row: if they are few, rows are
    counted by which of them are there, in Spark; else by matrix products."""
    cells = [F.col(f"v{i}") for i in range(count)]
    own = numbers.agg(F.count(F.lit(1)), *[F.count(c) for c in cells]).first()
    rows, n = own[0], {(i, i): own[i + 1] for i in range(count)}
    gapped = [i for i in range(count) if n[i, i] < rows]
    if len(gapped) <= MASK_COLUMNS:
        mask = sum((F.when(cells[i].isNotNull(), 1 << k).otherwise(0) for k, i in enumerate(gapped)), F.lit(0))
        masks = numbers.groupBy(mask.alias("mask")).count().collect() if len(gapped) > 1 else []
        pairs = {(a, b): sum(r["count"] for r in masks if r["mask"] >> k & r["mask"] >> m & 1)
                 for k, a in enumerate(gapped) for m, b in enumerate(gapped) if k < m}
    else:
        found = common_counts(numbers.select(*[cells[i] for i in gapped])).collect()
        pairs = {(gapped[r.i], gapped[r.j]): r.n for r in found if r.i < r.j}
    for i in range(count):
        for j in range(i + 1, count):
            # a column without gaps is present wherever the other one is
            n[i, j] = pairs[i, j] if (i, j) in pairs else min(n[i, i], n[j, j])
    return n


def gap_patterns(numbers: DataFrame, count: int) -> Gaps:
    """The patterns of gaps; columns with the same gaps share one, and most tables have few."""
    if count < 2:
        return Gaps({}, [0] * count)
    n = _present_together(numbers, count)
    both = lambda a, b: n.get((min(a, b), max(a, b)), 0)
    cuts = [0 < both(x, x) and any(both(x, y) < both(y, y) for y in range(count)) for x in range(count)]
    first: list[int] = []
    pattern = [0] * count
    for x in range(count):
        if cuts[x]:
            like = [a for a in first if both(a, a) == both(x, x) == both(a, x)]
            first += [] if like else [x]
            pattern[x] = first.index(like[0] if like else x) + 1
    return Gaps({f"p{i + 1}": x for i, x in enumerate(first)}, pattern)


def rankable_values(numbers: DataFrame, count: int, by: bool, gaps: Gaps) -> Ordered:
    """Ordered value counts that also count, per value, the rows each pattern of gaps leaves."""
    cells = row_cells(numbers, range(count), by, gaps.counters)
    return ordered_values(tally(cells, gaps.counters), ["cnt"], counters=gaps.counters)


def spearman(df: DataFrame, columns: list[str], by: str | None = None, numbers: DataFrame | None = None,
             values: Ordered | None = None, gaps: Gaps | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Rank correlation of every pair: (grp, col_a, col_b, rho), both triangles and the diagonal.

    Rows missing either value are left out of a pair and the rest ranked anew.
    All the rankings a column needs, one per pattern of gaps, come from the
    same ordered counts. Cells meet their scores by value in one join for all
    columns, one shuffle brings the scores of a row together, and all pairs are
    matrix products; the number of exchanges does not depend on the columns.
    An undefined correlation is 0.
    """
    k = len(columns)
    if numbers is None:
        numbers = staged_numbers(df, columns, by)
    if gaps is None or values is None:
        gaps = gap_patterns(numbers, k)
        values = rankable_values(numbers, k, by is not None, gaps)
    levels = F.array(F.lit(ROOT), *([F.col("grp")] if by else []))
    leveled = numbers.withColumn("grp", F.explode(levels)).where("grp IS NOT NULL")
    if sizes is None:
        sizes = leveled.groupBy("grp").agg(F.count(F.lit(1)).alias("num_rows"))
        sizes = keep(sizes.unionByName(df.sparkSession.createDataFrame([(ROOT, 0)], sizes.schema)).groupBy("grp").agg(
            F.sum("num_rows").alias("num_rows")))
    groups = sizes.count()

    # Average rank of each value, centred and scaled to (-1/2, 1/2), in total and per pattern.
    weights = ["cnt", *gaps.counters]
    scores = {f"s{i}": f"s{i}" for i in range(len(weights))}
    ranked = values.positioned(*[f"n_{w}" for w in weights]).selectExpr(
        "grp", "cid", "value", "coalesce(wide, 0L) AS wide", "cnt", "cum_cnt AS up_to",
        *[f"coalesce(try_divide(cum_{w} - ({w} - 1) / 2.0D - (n_{w} + 1) / 2.0D, n_{w}), 0.0D) AS s{i}" for i, w in enumerate(weights)])
    dealt = leveled.join(broadcast_if_small(sizes, groups), "grp").withColumn(
        "bucket", F.pmod(F.xxhash64("row"), F.ceil(F.col("num_rows") / BUCKET_ROWS))).drop("num_rows")
    on = {c: c for c in ("grp", "cid", "value", "wide")}
    facts = [column_facts(values).get(i, NO_FACTS) for i in range(k)]
    # columns whose rankings are few are broadcast together, up to a size in bytes; the others share one shuffle
    light, left = [], SMALL_BYTES
    for i in sorted(range(k), key=lambda i: facts[i]["distinct"]):
        left -= facts[i]["distinct"] * 8 * (len(weights) + 5)
        light += [i] if left >= 0 else []
    if not by and not any(f["wide"] for f in facts):
        sums = block_products(numbers, *_rankings(ranked, facts, light, len(weights)), gaps.pattern, len(weights))
        return _matrix(sizes.select("grp"), columns, sums, F.lit(1e-300))
    heavy = [i for i in range(k) if i not in light]
    parts = []
    if light:
        side = ranked.where(F.col("cid").isin(light)).select(*[F.col(c).alias(f"_{c}") for c in on], *scores)
        cells = level_cells(dealt, light, "grp", "bucket", "row")
        parts.append(cells.join(F.broadcast(side), [F.col(c) == F.col(f"_{c}") for c in on]))
    if heavy:
        # Keys on more than 1/1000 of a column's cells; fewer than 2000 a column, however many groups there are.
        total = F.element_at(F.array(*[F.lit(f["n_root"]) for f in facts]), F.col("cid") + 1)
        table = ranked.where(F.col("cid").isin(heavy))
        cells = level_cells(dealt, heavy, "grp", "bucket", "row")
        parts.append(skew_safe_lookup(cells, on, table, table.where(F.col("cnt") * 1000 > total), scores))
    named = ["grp", "bucket", "row", "cid", *scores]
    scored = parts[0].select(*named) if len(parts) == 1 else parts[0].select(*named).unionAll(parts[1].select(*named))
    sums = score_products(scored, k, gaps.pattern, len(weights))
    return _matrix(sizes.select("grp"), columns, sums, F.lit(1e-300))


def _rankings(ranked: DataFrame, facts: list[dict], light: list[int], patterns: int) -> tuple:
    """What ``block_products`` takes of the rankings of a table without groups.

    Whole rankings of the ``light`` columns, as well as values on more than 1/1000 of
    another column's cells, are known to every task; the others are cut into slices of so many cells, at most ``SLICES``
    per column.
    """
    total = F.element_at(F.array(*[F.lit(f["n_root"]) for f in facts]), F.col("cid") + 1)
    known = ranked.where(F.col("cid").isin(light) | (F.col("cnt") * 1000 > total)).select(
        "cid", "value", *[f"s{w}" for w in range(patterns)]).toArrow()
    cid = known.column("cid").to_numpy()
    figures = np.stack([known.column(c).to_numpy() for c in known.column_names[1:]])
    near, starts = {}, {}
    for i in range(len(facts)):
        own = figures[:, cid == i]
        own = own[:, np.argsort(own[0])]
        near[i] = (own[0], own[1:])
    width = {i: max(SLICE_CELLS, -(-f["n_root"] // SLICES)) for i, f in enumerate(facts) if i not in light}
    if width:
        cut = F.element_at(F.array(*[F.lit(width.get(i, 1)) for i in range(len(facts))]), F.col("cid") + 1).cast("bigint")
        rows = ranked.where(F.col("cid").isin(list(width))).groupBy("cid", F.floor((F.col("up_to") - 1) / cut).alias("slice")).agg(
            F.min("value").alias("start")).orderBy("cid", "start").collect()
        starts = {i: tuple(np.array([r[c] for r in rows if r["cid"] == i]) for c in ("start", "slice")) for i in width}
    return ranked, near, starts, width


def _matrix(groups: DataFrame, columns: list[str], sums: DataFrame, least: Column) -> DataFrame:
    """(grp, col_a, col_b, rho) of all cells of the matrix; 0 where a correlation is undefined.

    A column with a sum of squares up to ``least`` has no spread, and correlates 0 with itself too.
    """
    places = F.sequence(F.lit(0), F.lit(len(columns) - 1))
    cells = groups.withColumn("a", F.explode(places)).withColumn("b", F.explode(places))
    cells = cells.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")})
    spread = F.sqrt("square_i") * F.sqrt("square_j")
    rho = F.when(F.col("a") == F.col("b"), F.when(F.col("square_i") > least, F.lit(1.0))).otherwise(
        F.try_divide(F.col("product"), F.when(spread > 0, spread)))
    return cells.join(sums, ["grp", "i", "j"], "left").select(
        "grp", name_of(F.col("a"), columns).alias("col_a"), name_of(F.col("b"), columns).alias("col_b"),
        F.greatest(F.least(F.coalesce(rho, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)).alias("rho"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Linear correlation of every pair over pair-complete rows: (grp, col_a, col_b, rho).

    One pass and one small exchange for any number of columns and gaps. Sums
    are of distances from the pair's own means, so they lose no digits. A column
    without spread correlates 0, with itself too.
    """
    types = {f.name: f.dataType for f in df.schema}
    numbers = df.select([present(c, types[c]).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    root = df.sparkSession.createDataFrame([(ROOT,)], "grp string")
    return _matrix(root, columns, pair_moments(numbers).withColumn("grp", F.lit(ROOT)), F.lit(0.0))
