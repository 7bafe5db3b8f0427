"""Removal of passages that occur earlier, by longest-previous-factor arrays.

A byte goes if a string of ``WIDTH`` bytes over it also starts earlier in the
corpus. Such strings (windows) are found exactly, and no task sees the corpus:

1. Each window elects an anchor, its 32-byte gram of least hash. Equal windows
   elect equal grams at equal places, so windows meet only under their anchor's
   hash. Neighbouring windows with one anchor form a run, and a run's bytes its
   context. Runs of equal contexts under one anchor are copies: all but the
   earliest go, and no text has to be moved for them. This is done first within
   a task, then, by anchor, over all.
2. What remains are different contexts with a common anchor, which may share
   some windows. Their bytes are fetched and meet by anchor. There, the windows
   are put in suffix order; from the longest common prefixes with the previous
   and the next smaller position in that order follows each window's longest
   previous factor, and a factor of ``WIDTH`` bytes means an earlier match.
3. The windows found are laid over their documents.

Anchors frequent in the corpus are salted: by their contexts in step 1, by
single windows in step 2. Where a window starts is (doc_id, place); a null id
comes after all others, and among rows of one id the text's hash decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import as_bytes, free_names, mapped, mixed, quoted, signed
from facsimile.sources.staging import stage

WIDTH = 100
GRAM = 32
#: Window starts that elect anchors together; their places fit 20 bits.
CHUNK = 1 << 19
#: Text bytes whose runs are compared within a task.
TOGETHER = 8 << 20
#: Rows of one anchor a task is meant to take; more are salted.
HOT_ROWS = 2000
HOT_LIMIT = 1 << 17
#: Windows put in suffix order together.
WINDOWS = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(raw: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Hash of every ``length`` bytes, from one running sum modulo 2^64."""
    n = len(raw)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(10, (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[:n], out=total[1:])
    return mixed((total[length:] - total[:-length]) * down[:n - length + 1])


def runs(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, anchor hash) of the runs of windows that elect one anchor; they tile all windows."""
    raw = np.frombuffer(data, np.uint8)
    windows = len(raw) - width + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    span = width - GRAM + 1
    starts, hashes = [], []
    for a in range(0, windows, CHUNK):
        part = raw[a:a + CHUNK + width - 1]
        own = gram_hashes(part)
        # least hash, then leftmost: the place is in the low bits
        low = np.uint64((1 << 20) - 1)
        key = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        size, least = 1, key
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        starts.append(a + first)
        hashes.append(own[anchor[first]])
    start, anchor = np.concatenate(starts), np.concatenate(hashes)
    return start, np.diff(np.r_[start, windows]), anchor


def previous_factors(windows: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest previous factor of each window, within its group.

    ``windows`` is (n, width) bytes, ``order`` ranks their starts. In suffix
    order, the earlier window with the longest common prefix is the previous or
    the next with a smaller rank; both are found by jumping over neighbours
    that are no earlier, whose own jumps are known, all windows at once.
    """
    n, width = windows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = windows
    words = padded.view(">u8").astype(np.uint64)
    suffix = np.lexsort((order, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group))
    sorted_, owner, rank = windows[suffix], group[suffix], order[suffix]
    differ = sorted_[1:] != sorted_[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[owner[1:] != owner[:-1]] = 0
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        jump = np.arange(n) + step
        # longest common prefix with the window jumped to
        shared = np.r_[0, common] if step == -1 else np.r_[common, 0]
        shared = shared.astype(np.int64)
        while True:
            inside = (jump >= 0) & (jump < n)
            later = np.flatnonzero(inside & (shared > 0))
            later = later[rank[jump[later]] > rank[later]]
            if not len(later):
                break
            over = jump[later]
            shared[later] = np.minimum(shared[later], shared[over])
            jump[later] = jump[over]
        inside = (jump >= 0) & (jump < n)
        best = np.maximum(best, np.where(inside, shared, 0))
    out = np.empty(n, np.int64)
    out[suffix] = best
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal byte runs (from, to) under the windows of the runs given."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        a, b = int(starts[i]), int(starts[i] + lengths[i] - 1 + width)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, none, th, raw): the id, whether it is null, the text's hash, and its bytes."""
    doc = quoted(id_col)
    raw = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(doc.cast("long"), F.lit(0)).alias("doc"), doc.isNull().alias("none"),
                       F.xxhash64(raw).alias("th"), raw.alias("raw"))


def _hot_anchors(rows: DataFrame) -> dict[int, int]:
    """Anchors of many runs, and their number: those frequent in some megabytes of text, counted over all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(values[n >= 8])), pa.array(n[n >= 8])], names=["h", "n"])

        for batch in batches:
            for data in as_bytes(batch.column(0)):
                held.append(runs(data)[2])
                size += len(data)
                if size > TOGETHER:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    counted = rows.select("raw").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r.h: r.n for r in counted.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "h").limit(HOT_LIMIT).collect()}


def _salts(h: np.ndarray, by: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """Salt of each row: 0 unless its anchor is hot, else one of so many that a salt has some HOT_ROWS rows."""
    out = np.zeros(len(h), np.int64)
    if hot:
        keys = np.array(sorted(hot), np.int64)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        found = np.flatnonzero(keys[at] == h)
        of = np.array([1 + hot[int(k)] // HOT_ROWS for k in keys], np.uint64)
        out[found] = (mixed(by[found].view(np.uint64)) % of[at[found]]).astype(np.int64)
    return out


_RUN = "doc long, none boolean, th long, start long, n long"


def _first_of_equal_contexts(rows: DataFrame, hot) -> DataFrame:
    """Rows (copy, doc, none, th, start, n): runs that are later copies, and runs whose context has to be compared."""
    names = ["h", "salt", "dg", "copy", "doc", "none", "th", "start", "n"]

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All runs of a task; later copies within some megabytes are already told."""
        import xxhash

        held: list[tuple] = []
        size = 0

        def flushed():
            n = [len(x[3]) for x in held]
            doc, none, th = (np.repeat(np.array([x[k] for x in held]), n) for k in range(3))
            start, length, h, dg = (np.concatenate([x[k] for x in held]) for k in range(3, 7))
            order = np.lexsort((start, th, doc, none, dg, h))
            first = np.r_[True, (h[order][1:] != h[order][:-1]) | (dg[order][1:] != dg[order][:-1])] if len(order) else []
            copy = np.ones(len(order), bool)
            copy[order[np.flatnonzero(first)]] = False
            salt = _salts(h, dg, hot.value)
            # neighbouring copies of a document become one row
            at = np.flatnonzero(copy)
            joins = np.r_[False, (at[1:] == at[:-1] + 1) & (start[at[1:]] == start[at[:-1]] + length[at[:-1]])] if len(at) else []
            heads = np.flatnonzero(~np.asarray(joins, bool))
            merged = np.add.reduceat(length[at], heads) if len(at) else np.empty(0, np.int64)
            keep = np.flatnonzero(~copy)
            at = at[heads]
            pick = lambda x: np.r_[x[keep], x[at]]
            flag = np.r_[np.zeros(len(keep), bool), np.ones(len(at), bool)]
            # copies only pass through: dealt by their document
            columns = [np.where(flag, pick(th), pick(h)), np.where(flag, 0, pick(salt)), pick(dg), flag, pick(doc), pick(none),
                       pick(th), pick(start), np.r_[length[keep], merged]]
            for a in range(0, len(flag), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 100_000]) for c in columns], names=names)

        for batch in batches:
            for doc, none, th, data in zip(*(c.to_pylist() for c in batch.columns[:3]), as_bytes(batch.column(3))):
                start, length, h = runs(data)
                if len(start):
                    dg = np.fromiter((xxhash.xxh3_64_intdigest(data[a:a + m - 1 + WIDTH])
                                      for a, m in zip(start.tolist(), length.tolist())), np.uint64, len(start))
                    held.append((doc, none, th, start, length, signed(h), signed(dg)))
                    size += len(data)
                    if size > TOGETHER:
                        yield from flushed()
                        held, size = [], 0
        if held:
            yield from flushed()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by anchor and context: the earliest of equal contexts stays, if other contexts share its anchor."""
        last = None  # (h, salt, dg) of the row before
        lone = None  # the first row of an anchor, until a second context turns up

        for batch in batches:
            arrays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            is_copy = arrays[3]
            own = np.flatnonzero(~is_copy)
            out = [[a[is_copy]] for a in arrays[3:]]
            if len(own):
                h, salt, dg = (arrays[k][own] for k in range(3))
                same_anchor = np.r_[last is not None and (h[0], salt[0]) == last[:2], (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])]
                same = same_anchor & np.r_[last is not None and dg[0] == last[2], dg[1:] == dg[:-1]]
                # a context is compared if it is not the only one of its anchor; hot anchors are taken to have several
                change = ~same
                firsts = np.flatnonzero(change)
                follows = same_anchor[firsts]
                several = follows | np.r_[follows[1:], False]
                if hot.value:
                    several |= np.isin(h[firsts], np.fromiter(hot.value, np.int64, len(hot.value)))
                if lone is not None and len(firsts):
                    if follows[0]:
                        for k, x in enumerate(lone):
                            out[k].append(np.array([x]))
                    lone = None
                final = firsts[-1] if len(firsts) else None
                if final is not None and not several[-1]:
                    lone = [arrays[k][own[final]] for k in range(3, 9)]
                told = np.r_[own[firsts[several]], own[np.flatnonzero(same)]]
                copies = np.r_[np.zeros(int(several.sum()), bool), np.ones(int(same.sum()), bool)]
                out[0].append(copies)
                for k in range(1, 6):
                    out[k].append(arrays[3 + k][told])
                last = h[-1], salt[-1], dg[-1]
            columns = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(bool) if k in (0, 2) else c.astype(np.int64)) for k, c in enumerate(columns)], names=names[3:])

    elected = rows.mapInArrow(elect, "h long, salt long, dg long, copy boolean, " + _RUN)
    dealt = elected.repartition("h", "salt").sortWithinPartitions("h", "salt", "copy", "dg", "none", "doc", "th", "start")
    return stage(dealt.mapInArrow(tell, "copy boolean, " + _RUN), "runs")


def _packed(rows: DataFrame, value: str) -> DataFrame:
    """Per document its rows (start, n) as a list; bounded by the document's length."""
    return rows.groupBy("doc", "none", "th").agg(F.collect_list(F.struct("start", "n")).alias(value))


def _joined(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents with their lists, which grow with the corpus, so both sides are shuffled at any size."""
    return rows.join(lists, ["doc", "none", "th"], how)


def _matches_of_contexts(rows: DataFrame, wanted: DataFrame, hot) -> DataFrame:
    """(doc, none, th, start, n): runs of windows with an earlier match among different contexts of their anchor."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "salt", "doc", "none", "th", "start", "n", "bytes"]
        for batch in batches:
            for doc, none, th, data, lists in zip(*(c.to_pylist() for c in batch.columns[:3]), as_bytes(batch.column(3)),
                                                 batch.column(4).to_pylist()):
                need = np.array(sorted(x["start"] for x in lists), np.int64)
                start, length, h = runs(data)
                at = np.searchsorted(start, need)
                h, length = signed(h[at]), length[at]
                is_hot = np.isin(h, np.fromiter(hot.value, np.int64, len(hot.value))) if hot.value else np.zeros(len(h), bool)
                # a hot anchor's windows go one by one, dealt by their own bytes
                m = np.where(is_hot, length, 1)
                at = np.repeat(np.arange(len(need)), m)
                begin = need[at] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                size = np.where(is_hot, 1, length)[at]
                parts = [data[a:a + k - 1 + WIDTH] for a, k in zip(begin.tolist(), size.tolist())]
                salt = np.zeros(len(at), np.int64)
                if is_hot.any():
                    own = np.array([int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) if s else 0
                                    for p, s in zip(parts, is_hot[at])], np.int64)
                    # many windows a context: as many more salts
                    salt = _salts(h[at], own, {k: 16 * v for k, v in hot.value.items()})
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at]), pa.array(salt), pa.array(np.full(n, doc)), pa.array(np.full(n, none)),
                     pa.array(np.full(n, th)), pa.array(begin), pa.array(size), pa.array(parts, pa.binary())], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with two contexts or more, many at a time."""
        held: list[list[tuple]] = []
        key, count = None, 0

        def closed():
            groups = [g for g in held if len(g) > 1]
            if not groups:
                return
            flat = [x for g in groups for x in g]
            size = np.array([x[4] for x in flat])
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(x[5], np.uint8), WIDTH) for x in flat])
            group = np.repeat(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), size)
            context = np.repeat(np.arange(len(flat)), size)
            doc, none, th, start = (np.array([x[k] for x in flat])[context] for k in range(4))
            start = start + np.arange(len(context)) - np.repeat(np.cumsum(size) - size, size)
            order = np.empty(len(context), np.int64)
            order[np.lexsort((start, th, doc, none))] = np.arange(len(context))
            found = np.flatnonzero(previous_factors(windows, group, order) >= WIDTH)
            if len(found):
                head = np.flatnonzero(np.r_[True, (found[1:] != found[:-1] + 1) | (context[found[1:]] != context[found[:-1]])])
                n = np.diff(np.r_[head, len(found)])
                f = found[head]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[f], none[f], th[f], start[f], n)],
                                                 names=["doc", "none", "th", "start", "n"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for h, salt, *row in zip(*columns):
                if (h, salt) != key:
                    if count > WINDOWS:
                        yield from closed()
                        held, count = [], 0
                    key = h, salt
                    held.append([])
                held[-1].append(row)
                count += row[4]
        yield from closed()

    texts = _joined(rows, _packed(wanted, "wanted"), "inner").select("doc", "none", "th", "raw", "wanted")
    dealt = texts.mapInArrow(contexts, "h long, salt long, " + _RUN + ", bytes binary").repartition("h", "salt")
    return stage(dealt.sortWithinPartitions("h", "salt").mapInArrow(compare, _RUN), "matches")


def _spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct documents (id, text) as keyed rows, and per document the runs of windows to remove."""
    rows = _keyed(docs, id_col, text_col)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_anchors(rows))
    told = _first_of_equal_contexts(rows, hot)
    matches = _matches_of_contexts(rows, told.where("NOT copy"), hot)
    both = told.where("copy").drop("copy").unionAll(matches)
    return rows, _packed(both, "found")


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans are byte ranges (from, to).

    Null and empty texts have nothing to remove, nor have texts of fewer than
    ``WIDTH`` bytes. Among rows with one id and text, one is the first and the
    others are its copies. An empty table gives an empty result.
    """
    once, repeats = _without_repeats(docs, id_col, text_col)
    rows, found = _spans(once, id_col, text_col)
    joined = _joined(rows, found, "left").select("doc", "none", "th", "raw", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, lists in zip(as_bytes(batch.column(3)), batch.column(4).to_pylist()):
                spans = covered(len(data), *(np.array([x[k] for x in lists or ()], np.int64) for k in ("start", "n")))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(),
                            [{"from": a, "to": b} for a, b in spans]))
            columns = list(zip(*out)) if out else [[]] * 5
            spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, t) for c, t in zip(
                    columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type)))],
                names=["doc", "none", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = joined.mapInArrow(run, "doc long, none boolean, th long, n_bytes long, n_removed long, n_spans long, "
                                 "kept_sha256 string, spans array<struct<from:long,to:long>>")
    if repeats is not None:
        first = out
        whole = F.col("n_bytes") >= WIDTH
        later = out.join(repeats, ["doc", "none", "th"]).select(
            "doc", "none", "th", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
            F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_bytes").alias("to")))).otherwise(
                F.col("spans")).alias("spans"),
            F.explode(F.sequence(F.lit(2), F.col("times"))).alias("time")).drop("time")
        out = first.unionAll(later)
    return out.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _without_repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with each (id, text) once, and, if any repeat, how often each of these occurs."""
    rows = _keyed(docs, id_col, text_col)
    repeats = stage(rows.groupBy("doc", "none", "th").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeats")
    if repeats.isEmpty():
        return docs, None
    key = [quoted(id_col), F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary"))]
    names = free_names(docs, "__id", "__th")
    once = docs.withColumns(dict(zip(names, key))).dropDuplicates(names).drop(*names)
    return once, repeats


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with each (id, text) once and removed passages cut from the text; the character count follows.

    Characters that a removed run covers only in part stay. All columns are
    kept in their order and rows are never dropped; a text may become empty.
    """
    once, _ = _without_repeats(docs, id_col, text_col)
    _, found = _spans(once, id_col, text_col)
    kinds = ("doc", "none", "th", "found")
    names = dict(zip(kinds, free_names(docs, *(f"__{k}" for k in kinds))))
    lists = found.select(*(F.col(k).alias(v) for k, v in names.items()))
    raw = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    doc = quoted(id_col)
    on = ((F.coalesce(doc.cast("long"), F.lit(0)) == F.col(names["doc"])) & (doc.isNull() == F.col(names["none"]))
          & (F.xxhash64(raw) == F.col(names["th"])))
    rows = once.join(lists, on, "left").select(
        *(quoted(c) for c in docs.columns), names["found"])
    text_at = docs.columns.index(text_col)
    count_at = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            old, lists = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [x if not found else without(x.encode(), found) for x, found in zip(old, lists)]
            columns[text_at] = pa.array(new, batch.column(text_at).type)
            if count_at is not None:
                counts = [c if n is o else len(n) for c, o, n in zip(batch.column(count_at).to_pylist(), old, new)]
                columns[count_at] = pa.array(counts, batch.column(count_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    return mapped(rows, run).drop(names["found"])


def without(data: bytes, found: list[dict]) -> str:
    """The text left when whole characters under the runs found are cut."""
    out, at = [], 0
    for a, b in covered(len(data), *(np.array([x[k] for x in found], np.int64) for k in ("start", "n"))):
        while a < b and data[a] & 0xC0 == 0x80:  # begins inside a character
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:  # ends inside one
            b -= 1
        out.append(data[at:a])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, with what is left of each."""
    return remove_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
