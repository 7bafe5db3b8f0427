"""Sums of products of all column pairs, as matrices that merge.

A task turns its rows into blocks of numbers and takes all pairs of columns at
once as matrix products, with a mask for missing cells. What leaves it is one
row per pair, so neither plan nor traffic grows with the square of the columns
times the rows, and the number of exchanges does not depend on the columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where missing) and the mask of those present."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
    here = ~np.isnan(x)
    return np.where(here, x, 0.0), here


def _rows(upper: tuple[np.ndarray, np.ndarray], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = {"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), **columns}
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))


def common_counts(numbers: DataFrame) -> DataFrame:
    """(i, j, n) for i <= j: rows in which both columns of a frame of doubles are present."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            here = _block(batch)[1].astype(float)
            total = total + here.T @ here
        if np.ndim(total):
            upper = np.triu_indices(len(total))
            yield _rows(upper, {"n": total[upper].astype(np.int64)})

    return numbers.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


class _Moments:
    """Pair-complete moments of all pairs: entry (i, j) is of column i over the rows that have column j too."""

    def __init__(self, x: np.ndarray, here: np.ndarray):
        m = here.astype(float)
        centre = x.sum(axis=0) / np.maximum(m.sum(axis=0), 1)
        z = np.where(here, x - centre, 0.0)
        self.n = m.T @ m
        some = np.maximum(self.n, 1)
        total = z.T @ m
        self.mean = centre[:, None] + total / some
        self.square = np.maximum((z * z).T @ m - total * total / some, 0.0)
        self.product = z.T @ z - total * total.T / some
        low, high = np.where(here, x, np.inf), np.where(here, x, -np.inf)
        kinds, of = np.unique(here, axis=1, return_inverse=True)  # columns with the same gaps share a mask
        rows = [kinds[:, p] for p in range(kinds.shape[1])]
        self.low = np.stack([low[r].min(axis=0, initial=np.inf) for r in rows], 1)[:, of.ravel()]
        self.high = np.stack([high[r].max(axis=0, initial=-np.inf) for r in rows], 1)[:, of.ravel()]

    def merge(self, other: _Moments) -> None:
        n = self.n + other.n
        some = np.maximum(n, 1)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        weight = self.n * other.n / some
        self.square += other.square + weight * apart * apart
        self.product += other.product + weight * apart * apart.T
        self.mean = (self.mean * self.n + other.mean * other.n) / some
        self.low, self.high, self.n = np.minimum(self.low, other.low), np.maximum(self.high, other.high), n


_MOMENTS = ("mean", "square", "low", "high")


def pair_moments(numbers: DataFrame) -> DataFrame:
    """(i, j, n, square_i, square_j, product) for i <= j, over the rows that have both columns.

    Squares and products are of the distances from the pair's own means, in one
    pass; the square of a column that is constant there is exactly 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for batch in batches:
            if batch.num_rows:
                block = _Moments(*_block(batch))
                if all_ is None:
                    all_ = block
                else:
                    all_.merge(block)
        if all_ is not None:
            upper = np.triu_indices(len(all_.n))
            sides = {f"{name}_{side}": (getattr(all_, name) if side == "i" else getattr(all_, name).T)[upper]
                     for name in _MOMENTS for side in "ij"}
            yield _rows(upper, {"n": all_.n[upper].astype(np.int64), "product": all_.product[upper], **sides})

    names = ", ".join(f"{name}_{side} double" for name in _MOMENTS for side in "ij")
    parts = numbers.mapInArrow(run, f"i int, j int, n long, product double, {names}")
    # one row per task and pair; each is moved to the mean of all
    pair = Window.partitionBy("i", "j")
    for side in "ij":
        parts = parts.withColumn(f"mean_{side}", F.col(f"mean_{side}") - F.try_divide(
            F.sum(F.col("n") * F.col(f"mean_{side}")).over(pair), F.sum("n").over(pair).cast("double")))
    moved = lambda side: F.when(F.min(f"low_{side}") < F.max(f"high_{side}"), F.sum(
        F.col(f"square_{side}") + F.col("n") * F.col(f"mean_{side}") * F.col(f"mean_{side}"))).otherwise(F.lit(0.0))
    return parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), moved("i").alias("square_i"), moved("j").alias("square_j"),
        F.sum(F.col("product") + F.col("n") * F.col("mean_i") * F.col("mean_j")).alias("product"))


def score_products(cells: DataFrame, count: int, pattern: list[int], patterns: int) -> DataFrame:
    """(grp, i, j, square_i, square_j, product) for i <= j, of scores in long form.

    ``cells`` has (grp, bucket, row, cid, s0, s1, ...): the scores of a cell, one
    per pattern of gaps. The pair (i, j) takes the score of i under the pattern
    of j and the other way round, over rows that have both. One shuffle brings the
    cells of a row together; groups are cut into buckets, so none is one task.
    """
    of = [np.flatnonzero(np.array(pattern) == w) for w in range(patterns)]
    names = [f"s{w}" for w in range(patterns)]

    def add(sums: list[np.ndarray], row: np.ndarray, cid: np.ndarray, scores: np.ndarray) -> None:
        place = np.cumsum(np.concatenate([[True], row[1:] != row[:-1]])) - 1
        x = np.zeros((patterns, place[-1] + 1, count))
        x[:, place, cid] = scores
        here = np.zeros(x.shape[1:])
        here[place, cid] = 1.0
        for w in range(patterns):
            if len(of[w]):
                sums[0][:, of[w]] += (x[w] * x[w]).T @ here[:, of[w]]
                for v in range(patterns):
                    if len(of[v]):
                        sums[1][np.ix_(of[w], of[v])] += x[v][:, of[w]].T @ x[w][:, of[v]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(count)
        group, sums, held = None, None, None

        def told() -> pa.RecordBatch:
            table = _rows(upper, {"square_i": sums[0][upper], "square_j": sums[0].T[upper], "product": sums[1][upper]})
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(group, pa.string()), table.num_rows), *table.columns],
                                              names=["grp", *table.schema.names])

        for batch in _and_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
                table = table[0] if table else batch
            elif held is not None:
                table = held
            else:
                break
            if not table.num_rows:
                continue
            grp = table.column(0).dictionary_encode()
            code, row = grp.indices.to_numpy(zero_copy_only=False), table.column(1).to_numpy()
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
            end = len(row) if batch is None else int(np.flatnonzero(new)[-1])  # the last row may go on
            held = table.slice(end)
            if not end:
                continue
            cid = table.column(2).to_numpy()
            scores = np.stack([table.column(3 + w).to_numpy(zero_copy_only=False) for w in range(patterns)])
            starts = np.flatnonzero(np.concatenate([[True], code[1:end] != code[:end - 1]])).tolist()
            for a, b in zip(starts, [*starts[1:], end]):
                name = grp.dictionary[int(code[a])].as_py()
                if name != group:
                    if group is not None:
                        yield told()
                    group, sums = name, [np.zeros((count, count)), np.zeros((count, count))]
                add(sums, row[a:b], cid[a:b], scores[:, a:b])
        if group is not None:
            yield told()

    dealt = cells.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "row").select("grp", "row", "cid", *names)
    sums = dealt.mapInArrow(run, "grp string, i int, j int, square_i double, square_j double, product double")
    return sums.groupBy("grp", "i", "j").agg(*[F.sum(c).alias(c) for c in ("square_i", "square_j", "product")])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
