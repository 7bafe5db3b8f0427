"""Benchmark decontamination by greedy string tiling.

Running Karp-Rabin hashes of all windows of a least tile's words are looked up
among those of the benchmark (the join on seeds). For each document and item
whose shared seeds cover enough of the item, greedy string tiling then marks the
longest match of words not yet marked, again and again, until none of the least
length is left. Tiles may come in any order, so a reordered passage is covered
like a straight one. An item leaks where its tiles cover at least THRESHOLD of
its words.

A least tile is MIN_TILE words. In scripts written without blanks each character
is a word, and items mostly of such take twice as many. A shorter item is one
tile: it leaks where it stands whole. An item of fewer than SHORTEST words says
nothing about a document and never leaks.

Matches come from the pairs of equal seeds where these are few. Where a text
repeats itself, so that pairs would grow with the product of the lengths, the
longest match is searched by length over running hashes instead, in memory
linear in both texts; the tiles are the same.

The benchmark is taken in blocks of at most BLOCK_BYTES of text (and one item),
each broadcast for one map over the documents, so its size is bounded however
long the benchmark grows; documents are never shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import WordHashes, as_bytes, mapped, mixed, quoted, text_rows
from facsimile.sources.staging import stage

MIN_TILE = 5
THRESHOLD = 0.6
BLOCK_BYTES = 16 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
#: Fewest words of an item that can leak.
SHORTEST = 2
#: Pairs of equal seeds per window up to which they are listed.
DENSE = 8
#: One character of Thai, Lao, Myanmar, Khmer, the Han and kana blocks, in UTF-8.
_UNSPACED = re.compile(rb"(?:\xE0[\xB8-\xBB]|\xE1[\x80-\x82\x9E\x9F]|[\xE3-\xE9][\x80-\xBF]|\xEF[\xA4-\xAB])[\x80-\xBF]"
                       rb"|\xF0[\xA0-\xBF][\x80-\xBF]{2}")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def split_words(data: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation; each character of an unspaced script is one."""
    data = data.lower().translate(_WORD_BYTES)
    return (data if data.isascii() else _UNSPACED.sub(rb" \g<0> ", data)).split()


def least_tile(words: list[bytes], least: int = MIN_TILE) -> int:
    """Words of the shortest tile of an item."""
    unspaced = sum(bool(_UNSPACED.fullmatch(w)) for w in words)
    return min(len(words), 2 * least if 2 * unspaced > len(words) else least)


def coded(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words."""
    return hashes.of(split_words(data))


def _running_sum(words: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed(words) * _powers(_BASE, len(words)), out=total[1:])
    return total


def running_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2^64) of each window, from one running sum."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = _running_sum(words)
    return (total[length:] - total[:-length]) * _powers(_INVERSE, n)


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (item start, document start, length), longest first.

    Among equal lengths the earliest in the item, then in the document, is marked first.
    """
    a, b = running_hashes(item, least), running_hashes(doc, least)
    order = np.argsort(a, kind="stable")
    return _tiles(item, doc, a[order], order, b, np.arange(len(b)), least)


def _tiles(item: np.ndarray, doc: np.ndarray, seeds: np.ndarray, item_at: np.ndarray, own: np.ndarray, doc_at: np.ndarray,
           least: int) -> list[tuple[int, int, int]]:
    """The tiles, from the item's seeds (sorted, with their places) and the document's (with theirs)."""
    lo = np.searchsorted(seeds, own, "left")
    n = np.searchsorted(seeds, own, "right") - lo
    pairs = int(n.sum())
    if pairs > DENSE * (len(item) + len(doc)):
        return tiles_by_length(item, doc, least)
    k = np.arange(pairs) - np.repeat(np.cumsum(n) - n, n)
    return tiles_of_seeds(item_at[np.repeat(lo, n) + k], np.repeat(doc_at, n), len(item), len(doc), least)


def tiles_by_length(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """The same tiles without a list of pairs: the longest shared length by bisection, all its tiles, then the next length.

    As tiles do not overlap, at most sqrt(2 * words of the item) lengths occur.
    """
    sums = _running_sum(item), _running_sum(doc)
    inverse = _powers(_INVERSE, max(len(item), len(doc)))
    free = np.ones(len(item), bool), np.ones(len(doc), bool)

    def windows(side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows with no word marked."""
        taken = np.r_[0, np.cumsum(~free[side])]
        at = np.flatnonzero(taken[length:] == taken[:len(taken) - length])
        return at, (sums[side][at + length] - sums[side][at]) * inverse[at]

    def shared(length: int) -> bool:
        return bool(np.isin(windows(0, length)[1], windows(1, length)[1]).any())

    found, most = [], min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        if low < least:
            break
        (places, hashes), (doc_places, doc_hashes) = windows(0, low), windows(1, low)
        order = np.argsort(doc_hashes, kind="stable")
        doc_places, doc_hashes = doc_places[order], doc_hashes[order]
        first, end = (np.searchsorted(doc_hashes, hashes, side) for side in ("left", "right"))
        reached: dict[int, int] = {}  # by hash, the first of its places in the document that may be free
        for k in np.flatnonzero(first < end).tolist():
            i, f, e = int(places[k]), int(first[k]), int(end[k])
            # what is marked in this round has this length, so a window is free if both its ends are
            if not (free[0][i] and free[0][i + low - 1]):
                continue
            p = reached.get(f, f)
            while p < e and not (free[1][doc_places[p]] and free[1][doc_places[p] + low - 1]):
                p += 1
            reached[f] = p
            if p < e:
                j = int(doc_places[p])
                free[0][i:i + low] = free[1][j:j + low] = False
                found.append((i, j, low))
        most = low - 1
    return found


def tiles_of_seeds(item_at: np.ndarray, doc_at: np.ndarray, n_item: int, n_doc: int,
                   least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """The tiles from the places of all shared windows: neighbours on a diagonal join to maximal matches."""
    if not len(item_at):
        return []
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    d, p = diagonal[order], item_at[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
    runs = np.diff(np.r_[first, len(p)])
    heap = [(-(int(n) + least - 1), int(p[f]), int(p[f] + d[f])) for f, n in zip(first, runs)]
    heapq.heapify(heap)
    item_free, doc_free = np.ones(n_item, bool), np.ones(n_doc, bool)
    found = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = item_free[i:i + length] & doc_free[j:j + length]
        if free.all():
            item_free[i:i + length] = doc_free[j:j + length] = False
            found.append((i, j, length))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), i + int(s), j + int(s)))
    return found


class Benchmark:
    """Items of one block, with the places of all their windows, by length of the least tile."""

    def __init__(self, items: list[tuple[object, bytes]], least: int):
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.words, by_least = [], {}
        for k, (_, data) in enumerate(items):
            words = split_words(data)
            self.words.append(hashes.of(words))
            if len(words) >= SHORTEST:
                by_least.setdefault(least_tile(words, least), []).append(k)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.windows = {}
        for n, owners in by_least.items():
            seeds = [running_hashes(self.words[k], n) for k in owners]
            joined = (np.concatenate(seeds), np.repeat(np.array(owners, np.int32), [len(x) for x in seeds]),
                      np.concatenate([np.arange(len(x), dtype=np.int32) for x in seeds]))
            order = np.argsort(joined[0], kind="stable")
            self.windows[n] = [x[order] for x in joined]

    def leaks(self, words: np.ndarray, threshold: float) -> list[tuple[int, float, list]]:
        """(item, coverage, tiles) of every item covered far enough."""
        return sorted(x for least in self.windows for x in self._leaks(words, threshold, least))

    def _leaks(self, words: np.ndarray, threshold: float, least: int) -> Iterator[tuple[int, float, list]]:
        seeds, owners, places = self.windows[least]
        own = running_hashes(words, least)
        near = np.searchsorted(seeds, own)
        near[near == len(seeds)] = 0
        at = np.flatnonzero(seeds[near] == own)
        if not len(at):
            return
        # every window of the block that the document has: no more than the block's, however often it repeats them
        lo = np.unique(near[at])
        n = np.searchsorted(seeds, seeds[lo], "right") - lo
        row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = row[np.lexsort((places[row], owners[row]))]
        owner, place = owners[row], places[row].astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        step = np.full(len(row), least, np.int64)  # words that a seed covers before the next one: tiles cover no more
        same = owner[1:] == owner[:-1]
        step[:-1][same] = np.minimum(np.diff(place)[same], least)
        ends = np.r_[first[1:], len(row)]
        hopeful = np.add.reduceat(step, first) >= threshold * self.lengths[owner[first]]
        for f, e in zip(first[hopeful].tolist(), ends[hopeful].tolist()):
            k = int(owner[f])
            order = np.argsort(seeds[row[f:e]], kind="stable")
            mine = seeds[row[f:e]][order]
            got = _tiles(self.words[k], words, mine, place[f:e][order], own[at], at, least)
            covered = sum(t[2] for t in got)
            if covered >= threshold * self.lengths[k]:
                yield k, covered / int(self.lengths[k]), got


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items, a bounded block at a time; items without a word are left out."""
    items = benchmark.select(quoted(id_col).alias("item_id"), quoted(text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        block, size = [], 0
        for r in sorted(rows, key=lambda r: (str(r.item_id), r.text)):
            data = r.text.encode()
            if block and size + len(data) > block_bytes:
                yield block
                block, size = [], 0
            block.append((r.item_id, data))
            size += len(data)
        if block:
            yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_TILE,
               id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """Every row with its ``leaks``: (item_id, coverage, tiles (item_start, doc_start, length)), most covered first.

    Returns doc_id and leaks, or with ``keep`` all columns of ``docs`` in rows
    without a leak only. Null and empty texts and items, and items of one word,
    never leak; an item shorter than a tile leaks where it stands whole. Repeated rows and items each count; an empty benchmark
    finds nothing.
    """
    spark = docs.sparkSession
    id_type = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    item_type = benchmark.select(quoted(item_id_col)).schema[0].dataType.simpleString()
    leak_type = (f"array<struct<item_id:{item_type},coverage:double,"
                 "tiles:array<struct<item_start:int,doc_start:int,length:int>>>>")
    name = "leaks"
    if keep:
        while name in docs.columns:
            name += "_"
        rows, text_at = docs, docs.columns.index(text_col)
    else:
        rows, text_at = text_rows(docs, id_col, text_col), 1
    rows = rows.withColumn(name, F.lit(None).cast(leak_type))
    for number, items in enumerate(_blocks(benchmark, item_id_col, item_text_col, block_bytes)):
        shared = spark.sparkContext.broadcast(Benchmark(items, least))
        if number:
            rows = stage(rows, "leaks")  # one broadcast block at a time

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, hashes = shared.value, WordHashes()
            for batch in batches:
                last = batch.num_columns - 1
                found = []
                for data, old in zip(as_bytes(batch.column(text_at)), batch.column(last).to_pylist()):
                    new = [{"item_id": own.ids[k], "coverage": c, "tiles": [
                        {"item_start": i, "doc_start": j, "length": n} for i, j, n in got]}
                        for k, c, got in own.leaks(coded(data, hashes), threshold)]
                    found.append([*(old or []), *new] or None)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:last], pa.array(found, batch.column(last).type)], schema=batch.schema)

        rows = mapped(rows, run)
    if keep:
        return rows.where(quoted(name).isNull()).drop(name)
    leaks = F.coalesce(F.col(name), F.array().cast(leak_type))
    order = lambda a, b: F.when(a.coverage > b.coverage, -1).when(a.coverage < b.coverage, 1).when(
        a.item_id < b.item_id, -1).when(a.item_id > b.item_id, 1).otherwise(0)
    return rows.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.array_sort(leaks, order).alias("leaks"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, with all their columns."""
    return find_leaks(docs, benchmark, keep=True, **options)


def query(spark, sf_dir: str) -> DataFrame:
    """Of all documents those into which a benchmark item leaks, with the items."""
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") > 0).select(
        "doc_id", F.lit(True).alias("contaminated"), F.col("leaks.item_id").alias("item_ids"),
        F.try_element_at("leaks.coverage", F.lit(1)).alias("coverage"), "leaks")
