"""SimHash near-duplicates by pigeonring filtering.

A document's fingerprint holds, bit by bit, the majority of the 64-bit hashes of
its four-word shingles. Fingerprints link at a Hamming distance of at most
``DISTANCE``. Cut the 64 bits into a ring of ``SEGMENTS`` segments: if two
fingerprints differ in at most ``DISTANCE`` bits, then some segment starts a
chain of which *every* prefix of p segments differs in at most
``DISTANCE * p / SEGMENTS`` bits (the strong form of the pigeonring principle).

Candidates come from the first segments of such chains. Of a chain prefix of l
segments at most ``floor(DISTANCE * l / SEGMENTS)`` differ, and its own prefixes
say which combinations can; each greatest combination gives one key, the bits
of all other segments of the prefix. Two fingerprints whose chain starts at a
segment agree on at least one of its keys. Within a bucket of equal keys the
chain is followed segment by segment, and only what stays within every budget
is compared in full.

The length l is chosen for the number of distinct fingerprints, so that neither
keys nor chance meetings outgrow it; the links found are the same for any l.
Buckets of more than ``BUCKET`` members are dealt anew by longer chains, and
what is still large then by pairs of blocks, so no bucket lies in one task
whole. A bucket gives a spanning forest of its links, not all its pairs.

A null text counts as empty. A text without words has fingerprint zero and
links like any other. Repeated rows and null ids give a row each; a null id
stands for itself only where all ids of its component are null. An empty table
gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm.common import as_bytes, text_rows
from facsimile.llm.components import components
from facsimile.sources.staging import stage

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 9
#: Prefix lengths that keys are made of, in segments.
LENGTHS = (4, 6, 8)
BUCKET = 4096
#: Members of a block, where a bucket is too large at every length.
BLOCK = 2048
#: Buckets up to this size are compared all at once, larger ones member by member.
SMALL = 8
#: Shingles hashed at once; bounds the memory a long text takes.
SLAB = 1 << 16


# --- fingerprints ----------------------------------------------------------------

#: Per byte value, its bits as eight counters of eight bits.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
          .astype(np.uint8).copy().view(np.uint64).ravel())


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    whole = np.zeros((-(-len(hashes) // 255) * 255, 8), np.uint64)
    whole[:len(hashes)] = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    # 255 rows are as many as an eight-bit counter can take
    sums = np.ascontiguousarray(whole.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64))
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """The 64-bit majority over the hashes of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, SLAB):
        part = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i:i + SLAB], ends[i:i + SLAB])]
        counts += _bit_counts(np.array(part, np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row per document, the fingerprint as a signed number."""
    rows = text_rows(docs, id_col, text_col)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


# --- chains ------------------------------------------------------------------------

def budget(length: int) -> int:
    """Differing bits that a chain prefix of so many segments may have."""
    return DISTANCE * length // SEGMENTS


def _segment(i: int) -> int:
    low, high = i % SEGMENTS * 64 // SEGMENTS, (i % SEGMENTS + 1) * 64 // SEGMENTS
    return (1 << high) - (1 << low)


def _union(start: int, places) -> int:
    return sum(_segment(start + p) for p in places)


def left_out(length: int) -> list[tuple[int, ...]]:
    """The greatest sets of places in a prefix that may differ, by the budgets of its own prefixes."""
    return [s for s in combinations(range(length), budget(length))
            if all(sum(x < p for x in s) <= budget(p) for p in range(1, length + 1))]


def keys(length: int) -> list[tuple[int, tuple[int, ...], int]]:
    """(start, places left out, mask of the bits that must agree), in a fixed order."""
    return [(i, s, _union(i, (p for p in range(length) if p not in s)))
            for i in range(SEGMENTS) for s in left_out(length)]


def best_length(n: int) -> int:
    """The prefix length with the least keys and chance meetings among n fingerprints."""
    def cost(length: int) -> float:
        return sum(n + n * n / 2 ** (mask.bit_count() + 1) for _, _, mask in keys(length))

    return min(LENGTHS, key=cost)


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(classes: DataFrame, length: int) -> DataFrame:
    """(k, bits, fp): every fingerprint under each key of the prefix length."""
    each = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_as_long(mask)).cast("long")).alias("bits"))
            for k, (_, _, mask) in enumerate(keys(length))]
    return classes.select("fp", F.explode(F.array(*each)).alias("x")).select("x.k", "x.bits", "fp")


def _longer(members: DataFrame, length: int, to: int) -> DataFrame:
    """Members of buckets of one prefix length under the keys of the next that go on from theirs."""
    table = [(k, c, _as_long(mask)) for k, (i, s, _) in enumerate(keys(length)) for c, (j, t, mask) in enumerate(keys(to))
             if i == j and {p for p in t if p < length} <= set(s)]
    following = members.sparkSession.createDataFrame(table, "k int, child int, mask long")  # some hundred rows at most
    return members.join(F.broadcast(following), "k").select(
        F.col("child").alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp").distinct()


class _Chain:
    """The rest of a chain whose first ``length`` segments are known: masks and budgets, shortest first."""

    def __init__(self, start: int, length: int):
        self.steps = [(np.uint64(_union(start, range(p))), budget(p)) for p in range(length, SEGMENTS + 1)]

    def near(self, differing: np.ndarray) -> np.ndarray:
        """Places of the differences that stay within every budget; the last one is the whole distance."""
        at = np.arange(len(differing))
        for mask, most in self.steps:
            at = at[np.bitwise_count(differing[at] & mask) <= most]
            if not len(at):
                break
        return at


def _forest(fps: np.ndarray, chain: _Chain) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the linked members of one bucket, each member reached once."""
    left, us, vs = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            at = chain.near(left ^ u)
            if len(at):
                found = left[at]
                us.append(np.full(len(found), u))
                vs.append(found)
                queue.extend(found)
                left = np.delete(left, at)
    return us, vs


def _bucket_links(buckets: DataFrame, length: int, of: list[str]) -> DataFrame:
    """(u, v): links found in buckets, which are rows with equal values of ``of``; k is among them."""
    starts = [i for i, _, _ in keys(length)]
    columns = [*of, "fp"]

    def solved(table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        *names, fps = table
        ks, fps = names[0], fps.view(np.uint64)
        new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in names])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(fps)))
        run = np.cumsum(new) - 1
        us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        chains = {k: _Chain(starts[k], length) for k in np.unique(ks[first[size > 1]]).tolist()}
        small = size[run] <= SMALL
        for s in range(1, SMALL):
            at = np.flatnonzero(small[s:] & (run[s:] == run[:-s]))
            if not len(at):
                break
            differing, of_key = fps[at] ^ fps[at + s], ks[at]
            for k, chain in chains.items():
                mine = np.flatnonzero(of_key == k)
                mine = mine[chain.near(differing[mine])]
                us.append(fps[at[mine]])
                vs.append(fps[at[mine] + s])
        for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
            u, v = _forest(fps[a:a + n], chains[int(ks[a])])
            us += u
            vs += v
        return np.concatenate(us), np.concatenate(vs)

    def rows(table: list[np.ndarray]) -> pa.RecordBatch:
        u, v = (x.view(np.int64) for x in solved(table))
        low, high = np.minimum(u, v), np.maximum(u, v)
        links = np.unique(np.stack([low, high], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last bucket seen, which the next batch may go on with
        for batch in batches:
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            if held is not None:
                table = [np.concatenate(x) for x in zip(held, table)]
            if not len(table[0]):
                continue
            last = np.logical_and.reduce([x[:-1] == x[-1] for x in table[:-1]])
            cut = len(last) - int(np.argmin(last[::-1])) if len(last) and not last.all() else 0
            if cut:
                yield rows([x[:cut] for x in table])
            held = [x[cut:] for x in table]
        if held is not None:
            yield rows(held)

    return buckets.select(*columns).repartition(*of).sortWithinPartitions(*of, "fp").mapInArrow(run, "u long, v long")


def links(classes: DataFrame, n: int) -> DataFrame:
    """(u, v), u < v: links that join all linked ones of n distinct fingerprints (column fp)."""
    length = best_length(n)
    members, found = _keyed(classes, length), []
    while True:
        sizes = members.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n"))
        large = stage(sizes.where(F.col("n") > BUCKET), "large_buckets")
        if large.isEmpty():
            found.append(_bucket_links(members, length, ["k", "bits"]))
            break
        found.append(_bucket_links(members.join(large, ["k", "bits"], "left_anti"), length, ["k", "bits"]))
        hot = members.join(large, ["k", "bits"])
        if length == LENGTHS[-1]:
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            mine = hot.withColumn("b", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
            pairs = mine.select("k", "bits", "fp", "b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o")).select(
                "k", "bits", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "fp")
            found.append(_bucket_links(pairs, length, ["k", "bits", "low", "high"]))
            break
        to = LENGTHS[LENGTHS.index(length) + 1]
        members, length = stage(_longer(hot, length, to), "longer_chains"), to
    union = found[0]
    for more in found[1:]:
        union = union.unionAll(more)
    return union.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document."""
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint_classes")
    reached = stage(components(links(classes, classes.count())), "fingerprint_components")
    joined = classes.join(reached, F.col("fp") == F.col("node")).select("fp", "component", "least")
    firsts = joined.groupBy("component").agg(F.min("least").alias("first"))
    linked = joined.join(firsts, "component").select(F.col("fp").alias("node"), "first")
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("node"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("node")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
