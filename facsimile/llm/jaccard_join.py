"""Exact n-gram Jaccard self-join by signature trees.

A document is its set of hashed word shingles. Equal sets form a class; classes
are joined. Two sets that link share one of their first
``n - ceil(t * n) + 1`` shingles in any fixed order (hot shingles last), so
classes meet in buckets by such a shingle, and buckets of one class vanish. At
the first shingle they share, both still have enough shingles from there on: a
class's ``reach`` is the largest partner for which that holds, so a pair is
looked at in few of the buckets it shares. Within a bucket, trees over the
classes hold, per node, the OR of the members' bitmaps and the ranges of their
sizes and reaches; a dual traversal drops node pairs whose bitmaps leave too
little overlap possible. What remains is checked against the whole sets.

Only connection matters, so pairs inside a component are never looked at. A
first round joins every class in a few buckets with two partners at most, the
likeliest and the first of the likely ones, so that copies form stars; the
second takes every bucket that still holds several components, and checks for
each class the likeliest partner in each other component. Where that one is no
link, another of its component may be, if there is one: a third round compares
the classes of which this holds. A pair left unchecked by the second has on
either side a likelier partner that was none, so both its classes are among
them. So no possible link is left unchecked and components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.common import EMPTY, WordHashes, as_bytes, shingle_hashes, signed, text_rows
from facsimile.llm.components import components
from facsimile.sources.staging import stage

SHINGLE, PERCENT = 4, 85
#: A shingle in more than this share of the documents comes last in the order, if the corpus has at most HOT_LIMIT such.
HOT_SHARE, HOT_LIMIT = 0.002, 1 << 19
MOST_BITS = 1 << 13
FANOUT = 8
#: Classes of a bucket that one task compares at a time.
BLOCK = 4096
FIRST_TOKENS = 4
#: The same in the first round, where any partner will do.
FIRST_BLOCK = 512
#: Class keys broadcast at most; more are joined by a shuffle.
MOST_KEYS = 500_000
#: Node pairs compared at once, by their number and the bytes of their bitmaps; pairs held before the likeliest are chosen.
PAIRS_AT_A_TIME, BYTES_AT_A_TIME, PAIRS_HELD = 8192, 4 << 20, 1 << 18


def shingle_set(data: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Ascending distinct shingle hashes; of fewer than k words the whole sequence is one."""
    words = hashes.of(data.lower().split())
    if not len(words):
        return EMPTY
    return np.unique(shingle_hashes(words, min(k, len(words))) + np.uint64(len(words) if len(words) < k else 0))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def reaches(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Largest partner of a class of n shingles, if the first one they share is that at ``place`` of its order.

    The overlap is then n - place at most, and a link needs percent / (100 + percent) of both sizes.
    """
    return (100 + percent) * (n - place) // percent - n


def bitmap(shingles: np.ndarray) -> bytes:
    """One to two bits a shingle, a power of two in all."""
    bits = 128
    while bits < min(MOST_BITS, len(shingles)):
        bits *= 2
    out = np.zeros(bits // 8, np.uint8)
    at = (shingles >> np.uint64(40)) % np.uint64(bits)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bits(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps).sum(axis=1, dtype=np.int64)


class Signatures:
    """Members of a bucket with bitmaps of one length: a tree with the OR of bitmaps and ranges of sizes and reaches per node."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, component: np.ndarray, reach: np.ndarray, member: np.ndarray):
        order = np.lexsort((sizes, component))
        excess = sizes - _bits(maps)  # shingles beyond the bits they set
        self.member = member[order]
        # level 0: the members; per level bitmaps, least and largest size, least and largest component, largest excess and reach
        self.levels = [(maps[order], sizes[order], sizes[order], component[order], component[order], excess[order], reach[order])]
        while len(self.levels[-1][0]) > FANOUT:
            below = self.levels[-1]
            at = np.arange(0, len(below[0]), FANOUT)
            ops = (np.bitwise_or, np.minimum, np.maximum, np.minimum, np.maximum, np.maximum, np.maximum)
            self.levels.append(tuple(op.reduceat(x, at, axis=0) for op, x in zip(ops, below)))


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The node pairs that may hold a link between components, and their largest possible overlap."""
    keep = (x[6][i] >= y[1][j]) & (y[6][j] >= x[1][i])
    keep &= ~((x[3][i] == x[4][i]) & (y[3][j] == y[4][j]) & (x[3][i] == y[3][j]))
    i, j = i[keep], j[keep]
    overlap = _bits(x[0][i] & y[0][j]) + np.minimum(x[5][i], y[5][j])
    overlap = np.minimum(overlap, np.minimum(x[2][i], y[2][j]))
    keep = (100 + percent) * overlap >= percent * (x[1][i] + y[1][j])
    return i[keep], j[keep], overlap[keep]


def dual_traversal(x: Signatures, y: Signatures, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member of x, member of y, largest possible overlap) of the pairs that no node pair rules out."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    at_a_time = max(1, min(PAIRS_AT_A_TIME, BYTES_AT_A_TIME // x.levels[0][0][:1].nbytes))
    i, j = np.divmod(np.arange(len(level(x, top)[0]) * len(level(y, top)[0])), len(level(y, top)[0]))
    work = [(top, i, j)]
    while work:
        k, i, j = work.pop()
        if len(i) > at_a_time:
            half = len(i) // 2
            work += [(k, i[:half], j[:half]), (k, i[half:], j[half:])]
            continue
        if same:
            ordered = i <= j if k else i < j
            i, j = i[ordered], j[ordered]
        i, j, overlap = _possible(level(x, k), level(y, k), i, j, percent)
        if not len(i):
            continue
        if not k:
            yield x.member[i], y.member[j], overlap
            continue
        sides = []
        for tree, at in ((x, i), (y, j)):
            if k < len(tree.levels):
                children = at[:, None] * FANOUT + np.arange(FANOUT)
                sides.append((children, children < len(tree.levels[k - 1][0])))
            else:
                sides.append((at[:, None], np.ones((len(at), 1), bool)))
        (ci, mi), (cj, mj) = sides
        real = mi[:, :, None] & mj[:, None, :]
        ii, jj = np.broadcast_arrays(ci[:, :, None], cj[:, None, :])
        work.append((k - 1, ii[real], jj[real]))


def _likeliest(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, sizes: np.ndarray, component: np.ndarray):
    """Of (member, partner, overlap), the likeliest partner for each member and other component."""
    likely = overlap / (sizes[a] + sizes[b] - overlap)
    order = np.lexsort((b, -likely, component[b], a))
    a, b, overlap = a[order], b[order], overlap[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (component[b[1:]] != component[b[:-1]])]
    return a[first], b[first], overlap[first]


def _partners(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int):
    """Of (member, partner, overlap), two for each member at most: the likeliest, and the least component among the likely ones."""
    likely = overlap / (sizes[a] + sizes[b] - overlap)
    alike = 200 * likely >= 100 + percent  # a bitmap makes sets look more alike than they are
    order = np.lexsort((component[b], -likely, a))
    best = order[np.r_[True, a[order][1:] != a[order][:-1]]]
    order = np.lexsort((component[b], a))
    order = order[alike[order]]
    least = order[np.r_[True, a[order][1:] != a[order][:-1]][:len(order)]]
    kept = np.union1d(best, least)
    return a[kept], b[kept], overlap[kept]


def _chosen(found: Iterator[tuple], sizes: np.ndarray, component: np.ndarray, percent: int, best_only: bool, first_only: bool,
            left: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the pairs found, as :func:`candidates` has them; few are held at a time."""
    held, n, most = [], 0, PAIRS_HELD

    def chosen():
        a, b, overlap = (np.concatenate(x) for x in zip(*held))
        if not len(a):
            return a, b, overlap
        return _partners(a, b, overlap, sizes, component, percent) if first_only else _likeliest(a, b, overlap, sizes, component)

    for a, b, overlap in found:
        if left is not None:
            keep = left[a] | left[b]
            a, b, overlap = a[keep], b[keep], overlap[keep]
        if not best_only:
            yield a, b
            continue
        held.append((np.r_[a, b], np.r_[b, a], np.r_[overlap, overlap]))
        n += 2 * len(a)
        if n > most:
            held = [chosen()]
            n = len(held[0][0])
            most = max(PAIRS_HELD, 2 * n)
    if held:
        yield chosen()[:2]


def _found(maps: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int, reach: np.ndarray) -> Iterator[tuple]:
    """(a, b, largest possible overlap) of the pairs of one bucket that may link two components."""
    length = np.array([len(m) for m in maps])
    trees: dict[tuple[int, int], Signatures] = {}

    def tree(own: int, bits: int) -> Signatures:
        """Members whose bitmaps have ``own`` bytes, folded to ``bits`` bytes."""
        if (own, bits) not in trees:
            at = np.flatnonzero(length == own)
            raw = np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), own // 8)
            while raw.shape[1] * 8 > bits:
                raw = raw[:, :raw.shape[1] // 2] | raw[:, raw.shape[1] // 2:]
            trees[own, bits] = Signatures(raw, sizes[at], component[at], reach[at], at)
        return trees[own, bits]

    present = sorted(set(length.tolist()))
    for own in present:
        a = tree(own, own)
        yield from dual_traversal(a, a, percent)
        if 2 * own in present:  # sizes that link differ by less than a factor of two
            yield from dual_traversal(tree(2 * own, own), a, percent)


def candidates(maps: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int, best_only: bool,
               left: np.ndarray | None = None, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one bucket that may link two components; with ``best_only`` the likeliest for each
    member and other component. ``left`` marks members compared with all; pairs of two unmarked are left out.
    ``reach`` is the largest partner of each in this bucket."""
    reach = reaches(sizes, 0, percent) if reach is None else reach
    pairs = list(_chosen(_found(maps, sizes, component, percent, reach), sizes, component, percent, best_only, False, left))
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return a, b


def _small_found(maps: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int, reach: np.ndarray,
                 left: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    """:func:`_found` of many buckets at once that are no larger than a tree's root: only the members' own level."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    count = np.diff(np.r_[starts, len(bucket)])
    owner = np.repeat(np.arange(len(starts)), count)
    # each member with all later ones of its bucket
    later = (starts + count)[owner] - np.arange(len(bucket)) - 1
    a = np.repeat(np.arange(len(bucket)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    keep = (component[a] != component[b]) & (left[a] | left[b]) & (reach[a] >= sizes[b]) & (reach[b] >= sizes[a])
    a, b = a[keep], b[keep]
    length = np.array([len(m) for m in maps])
    for bits in np.unique(np.minimum(length[a], length[b])).tolist() if len(a) else ():
        own = np.minimum(length[a], length[b]) == bits
        first, second = a[own], b[own]
        for at in range(0, len(first), PAIRS_AT_A_TIME):
            i, j = first[at:at + PAIRS_AT_A_TIME], second[at:at + PAIRS_AT_A_TIME]
            used = np.unique(np.r_[i, j])
            raw = np.empty((len(used), bits // 8), np.uint64)
            for k, m in enumerate(used.tolist()):
                one = np.frombuffer(maps[m], np.uint64)
                while len(one) * 8 > bits:
                    one = one[:len(one) // 2] | one[len(one) // 2:]
                raw[k] = one
            n, comp = sizes[used], component[used]
            level = (raw, n, n, comp, comp, n - _bits(raw), reach[used])
            x, y, overlap = _possible(level, level, np.searchsorted(used, i), np.searchsorted(used, j), percent)
            yield used[x], used[y], overlap


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, th, n_shingles, cls (digest of the set), prefix and bitmap; staged."""
    rows = docs.withColumn("th", F.xxhash64("text"))
    spark = docs.sparkSession

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles frequent in some run of documents: any shingle above the share is so in one of them."""
        hashes = WordHashes()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            held, size, n = [], 0, 0
            for i, data in enumerate(texts):
                held.append(shingle_set(data, hashes, k))
                size += len(held[-1])
                n += 1
                if size > 1_000_000 or i == len(texts) - 1:
                    values, count = np.unique(np.concatenate(held), return_counts=True)
                    keep = count >= max(4, HOT_SHARE * n)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(values[keep])), pa.array(count[keep])], names=["t", "n"])
                    held, size, n = [], 0, 0

    total = rows.count()
    hot = [r.t for r in rows.select("text").mapInArrow(frequent, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(
        F.col("n") >= max(8, HOT_SHARE * total)).orderBy(F.desc("n"), "t").limit(HOT_LIMIT).select("t").collect()]
    shared = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, last = WordHashes(), shared.value
        for batch in batches:
            n, cls, prefix, maps = [], [], [], []
            for data in as_bytes(batch.column(1)):
                own = shingle_set(data, hashes, k)
                n.append(len(own))
                cls.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                ordered = own
                if len(last) and len(own):
                    at = np.searchsorted(last, own)
                    at[at == len(last)] = 0
                    is_hot = last[at] == own
                    ordered = np.r_[own[~is_hot], own[is_hot]]
                prefix.append(ordered[:prefix_length(len(own), percent)].astype("<u8").tobytes() if len(own) else None)
                maps.append(bitmap(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (cls, prefix, maps))],
                names=["doc_id", "th", "n", "cls", "prefix", "map"])

    return stage(rows.mapInArrow(run, f"doc_id {id_type}, th long, n long, cls binary, prefix binary, map binary"), "shingle-sets")


def _explode(percent: int):
    """(token, cid, n, reach) of each prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, "<u8") for p in batch.column(2).to_pylist()]
            length = np.array([len(p) for p in prefixes], np.int64)
            tokens = np.concatenate(prefixes) if prefixes else EMPTY
            cid, n = (np.repeat(batch.column(c).to_numpy(), length) for c in (0, 1))
            reach = reaches(n, np.arange(len(tokens)) - np.repeat(np.cumsum(length) - length, length), percent)
            for at in range(0, len(tokens), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(tokens[part])), *(pa.array(x[part]) for x in (cid, n, reach))], names=["token", "cid", "n", "reach"])
    return run


def _pairs(buckets: DataFrame, percent: int, best_only: bool, first_only: bool) -> DataFrame:
    """(hub, member) pairs of classes to check, from rows (token, block, cid, n, map, component, left, reach)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, small = None, [], []

        def out(rows: list, find, *more):
            cid, n, maps, component, left, reach = zip(*rows)
            cid, n, component, left, reach = (np.array(x) for x in (cid, n, component, left, reach))
            found = find(list(maps), n, component, percent, reach, *([left, *more] if more else []))
            for a, b in _chosen(found, n, component, percent, best_only, first_only, left):
                for at in range(0, len(a), 200_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cid[b[at:at + 200_000]]), pa.array(cid[a[at:at + 200_000]])], names=["hub", "member"])

        def closed():
            """A bucket of several levels by itself; small ones wait for others."""
            if 1 < len(held) <= FANOUT:
                small.append(held)
            elif len(held) > 1:
                yield from out(held, _found)

        def gathered():
            if small:
                # a class may stand in several of them
                bucket = np.repeat(np.arange(len(small)), [len(x) for x in small])
                yield from out([x for one in small for x in one], _small_found, bucket)
            small.clear()

        for batch in batches:
            for token, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, block) != key:
                    yield from closed()
                    key, held = (token, block), []
                    if len(small) >= 2000:
                        yield from gathered()
                held.append(row)
        yield from closed()
        yield from gathered()

    dealt = buckets.select("token", "block", "cid", "n", "map", "component", "left", "reach")
    return dealt.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(run, "hub long, member long")


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link, as (u, v); staged."""
    wanted = pairs.select(F.col("hub").alias("cid")).unionAll(pairs.select("member")).distinct()
    keys = stage(wanted.join(classes.select("cid", "rep", "th"), "cid"), "wanted")
    n = keys.count()
    if not n:
        return pairs.select(F.col("hub").alias("u"), F.col("member").alias("v"))
    if n <= MOST_KEYS:
        keys = F.broadcast(keys)
    rows = docs.withColumn("th", F.xxhash64("text"))
    texts = rows.join(keys, (rows.th == keys.th) & rows.doc_id.eqNullSafe(keys.rep)).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [shingle_set(x, hashes, k).astype("<u8").tobytes() for x in as_bytes(batch.column(1))], pa.binary())],
                names=["cid", "shingles"])

    sets = stage(texts.mapInArrow(run, "cid long, shingles binary"), "wanted-sets")
    # a hub's partners are dealt over tasks, each with the hub's set
    per_hub = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(500)).cast("int").alias("salts"))
    salted = pairs.join(per_hub, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    members = salted.join(sets, F.col("member") == sets.cid).select("hub", "salt", "member", "shingles")
    heads = salted.select("hub", "salt").distinct().join(sets, F.col("hub") == sets.cid).select(
        "hub", "salt", F.lit(None).cast("long").alias("member"), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, EMPTY
        for batch in batches:
            found = []
            for h, _, m, s in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(s, "<u8")
                if m is None:  # sorted first; a repeated row of a class has the same set
                    hub, own = h, s
                elif h == hub and links(own, s, percent):
                    found.append((h, m))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = members.unionAll(heads).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    return stage(dealt.mapInArrow(verify, "u long, v long"), "true-links")


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (token, cid, reach, component) of buckets with several components, dealt into blocks.

    In a bucket beyond BLOCK classes, those of its largest component are split over
    blocks, and all others go to every block (``left``), where they meet each other and
    the block's part of the largest component. If the others pass BLOCK too, all classes are
    dealt to groups, and a block is a pair of groups.
    """
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    per_token = sizes.groupBy("token").agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("several"),
        F.max(F.struct("n", "component")).alias("most")).where("several > 1").select(
        "token", F.col("most.component").alias("most"),
        F.when(F.col("all") > BLOCK, F.ceil(F.col("most.n") / F.lit(BLOCK // 2))).otherwise(F.lit(1)).cast("int").alias("blocks"),
        F.when(F.col("all") - F.col("most.n") > BLOCK, F.ceil(F.col("all") / F.lit(BLOCK // 2))).otherwise(F.lit(0)).cast("int").alias("groups"))
    known = rows.join(per_token, "token")
    is_most = (F.col("component") == F.col("most")) & (F.col("blocks") > 1) & (F.col("groups") == 0)
    groups, group = F.col("groups"), F.pmod(F.xxhash64("cid"), F.greatest("groups", F.lit(1))).cast("int")
    dealt = known.withColumn("group", group).select(
        "token", "cid", "reach", "component", "group", "groups", (~is_most).alias("left"),
        F.explode(F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.least(g, "group").cast("long") * groups
                                                 + F.greatest(g, "group"))).otherwise(
            F.when(is_most, F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long"))).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda g: g.cast("long"))))).alias("block"))
    # the second of two groups meets only the first there, as its own classes meet in a block of their own
    first = F.col("block") < (F.col("group") + F.lit(1)).cast("long") * groups
    return dealt.select("token", "cid", "reach", "component", "block", F.when(groups > 0, first).otherwise(F.col("left")).alias("left"))


def _open(pairs: DataFrame, component: DataFrame, before: DataFrame) -> DataFrame:
    """(cid) of classes apart from one they were paired with, whose component ``before`` had others to pair with."""
    others = before.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component")
    known = before.join(others, "component").select("cid", F.lit(True).alias("several"))
    known = component.join(known, "cid", "left")
    of = lambda side: known.select(F.col("cid").alias(side), F.col("component").alias(f"{side}_component"), F.col("several").alias(f"{side}_several"))
    apart = pairs.join(of("hub"), "hub").join(of("member"), "member").where("hub_component <> member_component AND hub_several AND member_several")
    return apart.select(F.col("hub").alias("cid")).unionAll(apart.select("member")).distinct()


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    component_id: the smallest doc_id that links of at least ``percent`` Jaccard
    over sets of ``k``-word shingles reach. Null and empty texts, and texts
    without a word, have no shingle and are linked with nothing. Repeated rows
    are equal texts and share a component; a null id is given to a component
    only if it has no other. An empty table gives an empty result.
    """
    return _joined(text_rows(docs, id_col, text_col), k, percent).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, th, n, component, component_id) of every row; component is null for rows without a shingle."""
    sets = _sets(docs, k, percent)
    classes = stage(sets.where("n > 0").groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"),
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("map").alias("map")).select(
        "cls", "n", "prefix", "map", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"),
        F.monotonically_increasing_id().alias("cid")), "classes")
    tokens = classes.select("cid", "n", "prefix").mapInArrow(_explode(percent), "token long, cid long, n long, reach long")
    # the smaller of two that link reaches its own size at least, the other one that of the smaller
    several = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("all"), F.min(F.when(F.col("reach") >= F.col("n"), F.col("n"))).alias("least")).where("all > 1 AND least IS NOT NULL")
    rows = stage(tokens.drop("n").join(several.drop("all"), "token").where("reach >= least").drop("least"), "shared-tokens")
    # first round: the first tokens of each class; hot buckets are cut by salts, as any partner will do
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("token"))
    known = rows.withColumn("rank", rank).where(F.col("rank") <= FIRST_TOKENS).drop("rank")
    size = known.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "token", F.ceil(F.col("n") / F.lit(FIRST_BLOCK)).cast("int").alias("blocks"))
    buckets = known.join(size, "token").withColumns({
        "block": F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long"), "left": F.lit(True), "component": F.col("cid")})
    true = pairs_done = None
    for number in range(3):
        # any pair is as good in the first round, wherever it meets
        signed_rows = buckets.join(classes.select("cid", "n", "map"), "cid")
        if number == 0:
            signed_rows = signed_rows.withColumn("reach", F.floor(F.col("n") * 100 / percent).cast("long"))
        pairs = _pairs(signed_rows, percent, number < 2, number == 0)
        pairs = pairs.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")).distinct()
        if pairs_done is not None:
            pairs = pairs.join(pairs_done, ["hub", "member"], "left_anti")
        pairs = stage(pairs, "pairs")
        found = _checked(pairs, classes, docs, k, percent)
        found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        true = found if true is None else true.unionAll(found)
        pairs_done = pairs if pairs_done is None else pairs_done.unionAll(pairs)
        reached = components(true)
        before = None if number == 0 else component
        component = stage(classes.select("cid").join(reached, F.col("cid") == F.col("node"), "left").select(
            "cid", F.coalesce("component", "cid").alias("component")), "components")
        if number == 0:
            buckets = _blocked(rows.join(component, "cid"))
        elif number == 1:
            open_ = stage(_open(pairs_done, component, before), "open")
            if open_.isEmpty():
                break
            buckets = _blocked(rows.join(component.join(open_, "cid"), "cid"))
    named = classes.join(component, "cid").select("cls", "rep", "component")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "component").select("cls", "component", "component_id")
    return sets.select("doc_id", "th", "n", "cls").join(ids, "cls", "left").select("doc_id", "th", "n", "component", "component_id")


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null last), then the smallest text hash.

    An id may stand at several texts or be null. Rows without a shingle all stay.
    """
    found = stage(_joined(text_rows(docs), k, percent).select("doc_id", "th", "n", "component"), "jaccard")
    per_key = found.where("n > 0").groupBy("component", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    first = per_key.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rows")).alias("first")).select(
        F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_th"), F.col("first.rows").alias("kept_rows"))
    alone = found.where("n = 0").select("doc_id", "th", F.lit(1).cast("long")).distinct()
    kept = stage(first.unionAll(alone), "kept")

    def rows_of(keys: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(keys["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == keys["kept_th"])
        return docs.join(keys, same, "left_semi")

    repeated = kept.where("kept_rows > 1")
    once = rows_of(kept.where("kept_rows = 1"))
    return once if repeated.isEmpty() else once.unionAll(rows_of(repeated).dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents with their components."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
