"""CSV with line breaks inside quotes, read by as many tasks as the bytes ask for.

Whether a line begins a record depends on every quote before it in the file. So
each byte range is scanned under both assumptions, that it begins between two
records and that it begins inside quotes; each range then is a function of one
bit. Running those functions over the ranges of a file, one small row each,
tells where every range really begins, and with it every line. A record of one
line, nearly all of them, is never shuffled; the lines of longer records meet by
the number of their record.

A quote opens a value only as its first character; a bare quote inside an
unquoted value is text. Records end at \\n or \\r\\n; blank lines are none,
and line breaks inside quotes stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.sources.staging import stage

_VALUE = rb'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
_REST = rb"(?:," + _VALUE + rb")*+"
#: A line that ends between records, if it begins there or inside quotes.
_CLOSED = (re.compile(_VALUE + _REST, re.DOTALL), re.compile(rb'(?:[^"]|"")*+"[^,]*+' + _REST, re.DOTALL))
#: Of each assumption (record, quotes): inside quotes before and after the line; records begun in the range so far.
_SCANNED = ("path string, start bigint, line bigint, value string, before_r boolean, after_r boolean, n_r bigint, "
            "before_q boolean, after_q boolean, n_q bigint")


def ends_inside_quotes(line: bytes, inside: bool) -> bool:
    """Whether the end of a line lies inside quotes, given whether its beginning does."""
    return _CLOSED[inside].fullmatch(line) is None


class _Range:
    """State of the scan of one byte range under both assumptions."""

    def __init__(self):
        self.lines = 0
        self.inside = [False, True]
        self.begun = [0, 0]

    def scan(self, lines: list[bytes], quotes: np.ndarray, blank: np.ndarray) -> list[np.ndarray]:
        """Columns of ``_SCANNED`` after the first two, without the text; lines without a quote change nothing."""
        n = len(lines)
        out = [np.arange(self.lines, self.lines + n)]
        self.lines += n
        for h in (0, 1):
            inside = self.inside[h]
            state = np.empty(n + 1, bool)
            done = 0
            for i in np.flatnonzero(quotes).tolist():
                state[done:i + 1] = inside
                inside = ends_inside_quotes(lines[i], inside)
                done = i + 1
            state[done:] = inside
            begun = self.begun[h] + np.cumsum(~state[:-1] & ~blank)
            out += [state[:-1], state[1:], begun]
            self.inside[h] = inside
            self.begun[h] = int(begun[-1])
        return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, current = None, None
    for batch in batches:
        path, start, value = batch.columns
        if not len(value):
            continue
        lines = value.cast(pa.large_binary()).to_pylist()
        quotes = pc.match_substring(value, '"').to_numpy(zero_copy_only=False)
        blank = pc.is_in(value, pa.array(["", "\r"], value.type)).to_numpy(zero_copy_only=False)
        starts = start.to_numpy()
        new = starts[1:] != starts[:-1]
        new |= pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(lines)]
        parts = []
        for f, e in zip(edges, edges[1:]):
            own = (path[f].as_py(), int(starts[f]))
            if own != key:
                key, current = own, _Range()
            parts.append(current.scan(lines[f:e], quotes[f:e], blank[f:e]))
        line, *rest = (pa.array(np.concatenate(c)) for c in zip(*parts))
        yield pa.RecordBatch.from_arrays(
            [path, start, line, value, *rest],
            ["path", "start", "line", "value", "before_r", "after_r", "n_r", "before_q", "after_q", "n_q"])


def _ranges(lines: DataFrame) -> DataFrame:
    """(path, start, inside, owner, owner_n, header): how each range begins, which record goes on into it, and
    the range that holds the file's first record.

    One row per byte range. A range keeps the bit, flips it or sets it; so the bit
    is what was set last, flipped as often as happened since.
    """
    last = lines.groupBy("path", "start").agg(F.max_by(F.struct("after_r", "n_r", "after_q", "n_q"), "line").alias("s"))
    flips = (F.col("s.after_r") & ~F.col("s.after_q")).cast("int")
    sets = F.col("s.after_r") == F.col("s.after_q")
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flipped = last.withColumn("flips", F.sum(flips).over(upto)).withColumn("flips_before", F.col("flips") - flips)
    marked = F.when(sets, (F.col("s.after_r").cast("int") + F.col("flips")) % 2)
    known = flipped.withColumn("inside", (
        (F.coalesce(F.last(marked, ignorenulls=True).over(before), F.lit(0)) + F.col("flips_before")) % 2).cast("boolean"))
    begun = known.withColumn("begun", F.when(F.col("inside"), F.col("s.n_q")).otherwise(F.col("s.n_r")))
    owner = F.last(F.when(F.col("begun") > 0, F.struct(F.col("start").alias("at"), F.col("begun").alias("n"))), ignorenulls=True)
    header = F.min(F.when(F.col("begun") > 0, F.col("start"))).over(Window.partitionBy("path"))
    return begun.withColumn("owner", owner.over(before)).select(
        "path", "start", "inside", F.col("owner.at").alias("owner"), F.col("owner.n").alias("owner_n"), header.alias("header"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): every record of the files but the first of each, their header; in no order.

    The lines are staged once, so that how Spark cut the files cannot change between two reads.
    """
    text = spark.read.text(path, lineSep="\n")
    lines = stage(text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
    ).mapInArrow(_scan, _SCANNED), "csv-lines")
    # a row per input split, which the driver lists for every scan anyway
    known = lines.join(F.broadcast(_ranges(lines)), ["path", "start"])
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}_q")).otherwise(F.col(f"{name}_r"))
    # a line before the first record of its range goes on with the last record of a range before
    carried = pick("n") == 0
    known = known.select(
        "path", "start", "line", "value", "header", pick("before").alias("before"), pick("after").alias("after"),
        F.when(carried, F.col("owner")).otherwise(F.col("start")).alias("at"),
        F.when(carried, F.col("owner_n")).otherwise(pick("n")).alias("n"))
    header = (F.col("at") == F.col("header")) & (F.col("n") == 1)
    blank = ~F.col("before") & F.col("value").isin("", "\r")
    body = known.where(~header & ~blank)
    single = ~F.col("before") & ~F.col("after")
    whole = body.where(single).select(F.col("value").alias("record"))
    joined = body.where(~single).groupBy("path", "at", "n").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "line", "value"))), lambda p: p["value"]), "\n").alias("record"))
    return whole.unionByName(joined.select("record")).select(F.regexp_replace("record", "\r$", "").alias("record"))


def read(spark: SparkSession, path: str, columns: list[str], options: dict) -> DataFrame:
    """The records as text columns, staged: what reads them again reads only the columns it needs."""
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    parse = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    parsed = records(spark, path).select(F.from_csv("record", schema, {**parse, "multiLine": "true"}).alias("r"))
    return stage(parsed.select("r.*"), "csv").toDF(*columns)
