"""Rank scores that travel as arrays.

A row per cell costs some hundred bytes in every sort and shuffle. Here a task sorts
the cells of a block of rows per column with numpy, and a rank is asked for by an
array of values and the rows' places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.columns import ROOT
from facsimile.operators.gram import _rows

#: Rows of a block whose scores meet in one matrix, as a power of two at most, and bytes of such a matrix.
BLOCK_BITS, BLOCK_BYTES = 16, 64 << 20
#: A ranking is asked for in slices of at least so many cells, and of at most this share of all.
SLICE_CELLS, SLICES = 1 << 17, 4096


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches, joined to tables of ``rows`` rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column of doubles; NaN where it is missing."""
    return table.column(name).to_numpy().astype(float, copy=False)


def block_products(numbers: DataFrame, ranked: DataFrame, near: dict[int, tuple], starts: dict[int, np.ndarray], width: dict[int, int],
                   pattern: list[int], patterns: int) -> DataFrame:
    """(grp, i, j, square_i, square_j, product) for i <= j over the whole table, as ``score_products`` has them.

    ``numbers`` has the columns v0, v1, ... and a number per ``row``. ``ranked`` has
    (cid, value, up_to, s0, s1, ...): scores by value, and the number of cells up to it.
    ``near`` holds, per column, sorted values and their scores (a row per pattern) that every task
    knows; a column in ``starts`` has others too, for which its cells ask the slices of the ranking:
    slices of ``width`` cells that begin at the values ``starts``. Two shuffles of arrays: cells to slices, scores to
    blocks of rows.
    """
    count = len(pattern)
    bits = max(6, min(BLOCK_BITS, (BLOCK_BYTES // (8 * patterns * count)).bit_length() - 1))
    names = [f"s{w}" for w in range(patterns)]
    of = [np.flatnonzero(np.array(pattern) == w) for w in range(patterns)]

    def found(cid: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the values are near, and the place of each there."""
        known = near[cid][0]
        if not len(known):
            return np.zeros(len(value), bool), np.zeros(len(value), int)
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        return known[at] == value, at

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(block, column, places, values) of the cells that are present."""
        for table in _gathered(batches, 1 << BLOCK_BITS):
            row = table.column("row").to_numpy()
            block = row >> bits
            ends = np.flatnonzero(np.concatenate([block[1:] != block[:-1], [True]])) + 1
            for cid in range(count):
                value = _numbers(table, f"v{cid}")
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    kept = a + np.flatnonzero(~np.isnan(value[a:b]))
                    yield int(block[a]), cid, (row[kept] & ((1 << bits) - 1)).astype(np.int32), value[kept]

    told = pa.schema([("block", pa.int64()), ("cid", pa.int32()), ("places", pa.binary()), ("scores", pa.binary()), ("keys", pa.bool_())])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells whose values are near go straight to their block, as values."""
        for block, cid, places, value in blocks(batches):
            if cid in starts:
                held = found(cid, value)[0]
                places, value = places[held], value[held]
            if len(places):
                yield pa.RecordBatch.from_pylist([{
                    "block": block, "cid": cid, "places": places.tobytes(), "scores": value.tobytes(), "keys": True}], schema=told)

    asks = pa.schema([("cid", pa.int32()), ("slice", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("figures", pa.binary())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All others go to their slice of the ranking, sorted."""
        for block, cid, places, value in blocks(batches):
            if cid in starts:
                away = ~found(cid, value)[0]
                places, value = places[away], value[away]
                at = np.argsort(value)
                places, value = places[at], value[at]
                to = np.searchsorted(starts[cid][0], value, "right") - 1
                cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
                if len(to):
                    yield pa.RecordBatch.from_pylist([{
                        "cid": cid, "slice": int(starts[cid][1][to[a]]), "block": block, "places": places[a:b].tobytes(),
                        "figures": value[a:b].tobytes()} for a, b in zip(cuts, cuts[1:])], schema=asks)

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of the ranking, one per slice and batch, under block -1: values, then the scores of each pattern."""
        for batch in batches:
            if batch.num_rows:
                cid, to, value = (batch.column(i).to_numpy() for i in range(3))
                scores = [batch.column(3 + w).to_numpy() for w in range(patterns)]
                cuts = [0, *(np.flatnonzero((to[1:] != to[:-1]) | (cid[1:] != cid[:-1])) + 1).tolist(), len(to)]
                yield pa.RecordBatch.from_pylist([{
                    "cid": int(cid[a]), "slice": int(to[a]), "block": -1, "places": b"",
                    "figures": np.stack([value[a:b], *[s[a:b] for s in scores]]).tobytes()} for a, b in zip(cuts, cuts[1:])], schema=asks)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of cells with their scores; a slice's own rows come before those that ask it."""
        here, parts, known = None, [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if here != (r["cid"], r["slice"]):
                    here, parts, known = (r["cid"], r["slice"]), [], None
                if r["block"] < 0:
                    parts.append(np.frombuffer(r["figures"]).reshape(1 + patterns, -1))
                    continue
                if known is None:
                    known = np.concatenate(parts, 1)
                    known, parts = known[:, np.argsort(known[0])], []
                at = np.searchsorted(known[0], np.frombuffer(r["figures"]))
                out.append({"block": r["block"], "cid": r["cid"], "places": r["places"], "scores": known[1:, at].tobytes(), "keys": False})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=told)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((count, count)), np.zeros((count, count))]
        x = here = None
        block = None

        def add() -> None:
            for w in range(patterns):
                if len(of[w]):
                    sums[0][:, of[w]] += (x[w] * x[w]).T @ here[:, of[w]]
                    for v in range(patterns):
                        if len(of[v]):
                            sums[1][np.ix_(of[w], of[v])] += x[v][:, of[w]].T @ x[w][:, of[v]]

        for batch in batches:
            for r in batch.to_pylist():
                if block != r["block"]:
                    if block is not None:
                        add()
                    x, here = np.zeros((patterns, 1 << bits, count)), np.zeros((1 << bits, count))
                    block = r["block"]
                places, figures = np.frombuffer(r["places"], np.int32), np.frombuffer(r["scores"])
                x[:, places, r["cid"]] = near[r["cid"]][1][:, found(r["cid"], figures)[1]] if r["keys"] else figures.reshape(patterns, -1)
                here[places, r["cid"]] = 1.0
        if block is not None:
            add()
            upper = np.triu_indices(count)
            yield _rows(upper, {"square_i": sums[0][upper], "square_j": sums[0].T[upper], "product": sums[1][upper]})

    cells = numbers.select("row", *[f"v{i}" for i in range(count)])
    ddl = "block long, cid int, places binary, scores binary, keys boolean"
    pieces = cells.mapInArrow(answered, ddl)
    if starts:
        ask = "cid int, slice long, block long, places binary, figures binary"
        cut = F.element_at(F.array(*[F.lit(width.get(i, 1)) for i in range(count)]), F.col("cid") + 1).cast("bigint")
        slices = ranked.where(F.col("cid").isin(list(starts))).select(
            "cid", F.expr("up_to - 1").alias("slice"), "value", *names).withColumn("slice", F.floor(F.col("slice") / cut)).mapInArrow(offered, ask)
        met = slices.unionByName(cells.mapInArrow(asked, ask)).repartition("cid", "slice").sortWithinPartitions("cid", "slice", "block")
        pieces = pieces.unionByName(met.mapInArrow(looked_up, ddl))
    sums = pieces.repartition("block").sortWithinPartitions("block").mapInArrow(
        multiplied, "i int, j int, square_i double, square_j double, product double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("square_i", "square_j", "product")]).withColumn("grp", F.lit(ROOT))
