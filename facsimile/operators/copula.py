"""Dependence between columns through a Gaussian copula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.hashed import normal
from facsimile.functions.missing import present
from facsimile.operators.ordered import ordered
from facsimile.sources.staging import stage, sweep

#: Ranks of a column that are given their values at once.
BLOCK = 1 << 18


def target_matrix(correlations: DataFrame, names: list[str]) -> DataFrame:
    """Full symmetric target per group with unit diagonal: (grp, col_a, col_b, rho).

    Missing entries are 0; the two triangles are averaged.
    """
    listed = F.array(*[F.lit(c) for c in names])
    frame = (
        correlations.select("grp").distinct()
        .select("grp", F.explode(listed).alias("col_a"))
        .select("grp", "col_a", F.explode(listed).alias("col_b"))
    )
    swapped = correlations.select("grp", F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("rho").alias("ohr"))
    keys = ["grp", "col_a", "col_b"]
    both = frame.join(correlations, keys, "left").join(swapped, keys, "left")
    mean = (F.coalesce("rho", F.lit(0.0)) + F.coalesce("ohr", F.lit(0.0))) / 2.0
    return both.select(*keys, F.when(F.col("col_a") == F.col("col_b"), F.lit(1.0)).otherwise(mean).alias("rho"))


def mixing_rows(correlations: DataFrame, names: list[str], rank_exact: bool = False) -> DataFrame:
    """Triangular factor of each group's target: (grp, factor array), row-major k x k.

    A target that is not a correlation matrix (pairwise estimates need not be)
    is first brought to the nearest one by cutting its eigenvalues at 0.
    ``rank_exact`` maps rank to linear correlation, R = 2 sin(pi rho / 6).
    """
    full = target_matrix(correlations, names)
    order = names
    k = len(order)

    def factor(pdf):
        import numpy as np
        import pandas as pd

        at = {c: i for i, c in enumerate(order)}
        matrix = np.eye(k)
        matrix[pdf["col_a"].map(at), pdf["col_b"].map(at)] = pdf["rho"]
        if rank_exact:
            matrix = 2.0 * np.sin(np.pi * matrix / 6.0)
            np.fill_diagonal(matrix, 1.0)
        values, vectors = np.linalg.eigh(matrix)
        if values.min() < 1e-9:
            matrix = (vectors * np.clip(values, 1e-9, None)) @ vectors.T
            scale = np.sqrt(np.diag(matrix))
            matrix = matrix / scale[:, None] / scale[None, :]
        lower = np.linalg.cholesky(matrix)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "factor": [lower.ravel()]})

    return full.groupBy("grp").applyInPandas(factor, "grp string, factor array<double>")


def impose_rank_correlation(df: DataFrame, columns: list[str], correlation: list[list[float]], seed: int = 0) -> DataFrame:
    """Reorder the values within numeric columns so that their ranks correlate as asked.

    Each column keeps its values, in their own type, and the places of its nulls. Rows get
    correlated normal scores; the value of rank r goes to the row whose score
    has rank r among the column's present rows. All columns share two range
    sorts, one of the scores and one of each distinct value with its count, and meet by
    (column, block of ranks). The same rows give the same result however they are laid out.
    What a step has staged and shuffled goes as soon as the next one is written; whole rows are written once.
    """
    import numpy as np

    target = np.array(correlation, dtype=float)
    target = (target + target.T) / 2.0
    np.fill_diagonal(target, 1.0)
    values, vectors = np.linalg.eigh(target)
    root = vectors * np.sqrt(np.clip(values, 0.0, None))

    # Rows are numbered in the order of their values' hash, so the result depends on the rows
    # alone; equal rows may swap numbers, which changes nothing, and are spread by the tie.
    spark = df.sparkSession
    names = df.columns
    columns = [f"c{names.index(c)}" for c in columns]
    df = df.toDF(*[f"c{i}" for i in range(len(names))])  # names of any kind pass through Arrow
    cells_of_row = [F.col(c) for c in df.columns]
    numbered = df.withColumns({
        "_all": F.lit(0), "_one": F.lit(1).cast("bigint"), "_hash": F.xxhash64(*cells_of_row),
        "_tie": F.monotonically_increasing_id()})
    laid = ordered(numbered, ["_all"], ["_hash", "_tie"], ["_one"], "rows", without=["_hash", "_tie"])
    rows = laid.positioned().select(*cells_of_row, F.col("cum__one").alias("_rid"))
    sweep(spark)
    noise = rows.select("_rid", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)],
                        *[normal(f"copula/{j}", seed, F.col("_rid")).alias(f"_g{j}") for j in range(len(columns))])
    # One slot per data type: a value is ordered and carried as what it is.
    types = {f.name: f.dataType for f in df.schema}
    kinds = list(dict.fromkeys(types[c].simpleString() for c in columns))
    slots = [f"_s{k}" for k in range(len(kinds))]
    scores, cells = [], []
    for i, c in enumerate(columns):
        z = F.lit(0.0)
        for j in range(len(columns)):
            z = z + F.col(f"_g{j}") * float(root[i, j])
        scores.append(F.struct(
            F.lit(i).alias("cid"), z.alias("z"), present(f"_c{i}", types[c]).isNotNull().alias("has")))
        own = present(c, types[c])
        cells.append(F.struct(
            F.lit(i).alias("cid"), own.isNotNull().alias("has"), _below_zero(own, types[c]).alias("below"),
            *[(own if kind == types[c].simpleString() else F.lit(None)).cast(kind).alias(slot) for kind, slot in zip(kinds, slots)]))
    present_scores = noise.select("_rid", F.inline(F.array(*scores))).where("has").select(
        "cid", "z", "_rid", F.lit(1).cast("bigint").alias("one"))
    by_score = ordered(present_scores, ["cid"], ["z", "_rid"], ["one"], "by-score", without=["z"])
    sweep(spark)
    counted = rows.select(F.inline(F.array(*cells))).where("has").groupBy("cid", "below", *slots).agg(
        F.count(F.lit(1)).alias("cnt"))
    by_value = ordered(counted, ["cid"], [*slots, "below"], ["cnt"], "by-value")
    sweep(spark)
    placed = stage(_values_at_ranks(by_score.positioned(), by_value.positioned(), slots), "placed")
    sweep(spark, by_score.rows, by_value.rows)
    slot_of = {c: slots[kinds.index(types[c].simpleString())] for c in columns}
    signed = lambda c: F.when(F.col("below"), F.lit(-0.0).cast(types[c])).otherwise(F.col(slot_of[c])) if isinstance(
        types[c], (T.DoubleType, T.FloatType)) else F.col(slot_of[c])
    wide = stage(placed.groupBy("_rid").agg(*[
        F.max(F.when(F.col("cid") == i, signed(c))).alias(f"_v{i}") for i, c in enumerate(columns)
    ]), "imposed")
    sweep(spark, placed)
    position = {c: i for i, c in enumerate(columns)}
    return rows.join(wide, "_rid", "left").select([
        F.col(f"_v{position[c]}").alias(c) if c in position else F.col(c) for c in df.columns
    ]).toDF(*names)


def _below_zero(value: Column, dtype: T.DataType) -> Column:
    """Whether a value is the zero with a minus sign, which grouping would make the other one."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.lit(False)
    return (value == 0) & value.cast("string").startswith("-")


def _values_at_ranks(ranked: DataFrame, counted: DataFrame, slots: list[str]) -> DataFrame:
    """(_rid, cid, below, *slots): to each row of ``ranked`` (cid, cum_one, _rid) the value that holds its rank.

    ``counted`` has the distinct values with ``cnt`` and their inclusive total ``cum_cnt``. Both sides are cut into
    blocks of ``BLOCK`` ranks; a value stands in each block it reaches, so no task holds more than a block of either.
    """
    block = lambda rank: F.floor(rank / BLOCK)
    left = ranked.select("cid", block(F.col("cum_one") - 1).alias("block"), "cum_one", "_rid")
    right = counted.select(
        "cid", F.explode(F.sequence(block(F.col("cum_cnt") - F.col("cnt")), block(F.col("cum_cnt") - 1))).alias("block"),
        "cum_cnt", "below", *slots)
    schema = T.StructType([ranked.schema["_rid"], *[counted.schema[c] for c in ("cid", "below", *slots)]])

    def assigned(ranks, values):
        import numpy as np

        values = values.sort_by("cum_cnt")
        at = np.searchsorted(values.column("cum_cnt").to_numpy(), ranks.column("cum_one").to_numpy())
        found = values.select(["cid", "below", *slots]).take(at)
        return found.add_column(0, "_rid", ranks.column("_rid"))

    return left.groupBy("cid", "block").cogroup(right.groupBy("cid", "block")).applyInArrow(assigned, schema)
