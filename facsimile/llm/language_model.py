"""Word bigram model in Elias-Fano tries, trained and applied in one shuffle.

Every token goes, with the word before it, to the shard of that context word;
frequent contexts are salted by the next word. A shard holds all counts its
probabilities need. It builds a trie of two levels (contexts, then next words
relative to their context), both Elias-Fano coded with monotone pointers
between them, with smoothed probabilities quantised to 16 bits, writes the
levels to a file, maps that into memory, and looks up all its tokens by
successor search. Only sums per document leave a shard.

Smoothing is interpolated absolute discounting over unigrams with add-one
counts, all exact. The counts of the at most UNIGRAMS most frequent words are
broadcast. For every other word it meets a shard asks the bucket of that word,
which holds its count: each shard sends its distinct rare words once and gets
as many counts back, so no table of all words is held anywhere. In the same
way the shards of a salted context learn its followers in all shards: salting
changes no probability.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import EMPTY, WordHashes, as_bytes, fold, mixed, signed, text_rows
from facsimile.sources.staging import stage

UNIGRAMS = 1 << 19
DISCOUNT = 0.75
#: Tokens a shard is meant to hold, and tokens coded at a time.
SHARD_TOKENS = 1_000_000
BATCH_TOKENS = 500_000
#: A context with more than this share of a shard's tokens is salted.
HOT_SHARE = 0.25
WORD_BITS = 40
_MASK = np.uint64((1 << WORD_BITS) - 1)
#: Words hold no space, so these are never words of a text.
BEGIN, END = b" begin", b" end"
#: log10 probabilities and weights in equal steps, from 0 to -16.
_STEPS, _HIGHEST, _LOWEST = 65_535, 0.0, -16.0

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one in a byte, by rule.
_SELECT = np.array([([j for j in range(8) if i >> j & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)


def quantised(log_p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip((_HIGHEST - log_p) / (_HIGHEST - _LOWEST), 0, 1) * _STEPS).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return _HIGHEST - code.astype(np.float64) * ((_HIGHEST - _LOWEST) / _STEPS)


class EliasFano:
    """A non-decreasing sequence: low bits in whole bytes, high parts in unary with a rank directory."""

    FIELDS = ("low", "high", "ranks")

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bytes, self.low, self.high, self.ranks = n, low_bytes, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        spread = int(values[-1]) // n if n else 0
        low_bytes = max(0, (spread.bit_length() - 1) // 8)
        shift = np.uint64(8 * low_bytes)
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes].copy()
        top = (values >> shift).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
        at = top + np.arange(n)
        size = -(-(int(at[-1]) + 1) // 64) * 8 if n else 8
        bits = np.zeros(size * 8, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
        counts = _POPCOUNT[high].reshape(-1, 8).sum(axis=1)
        return cls(n, low_bytes, low, high, np.r_[0, np.cumsum(counts)].astype(np.uint32))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.ranks, i, "right") - 1
        left = i - self.ranks[word].astype(np.int64)
        at = word * 8
        for _ in range(7):  # to the byte that holds the one
            n = _POPCOUNT[self.high[at]]
            on = left >= n
            # a byte is left behind only while its ones do not reach
            at = at + on
            left = np.where(on, left - n, left)
            if not on.any():
                break
        top = (at * 8 + _SELECT[self.high[at], left] - i).astype(np.uint64)
        value = top << np.uint64(8 * self.low_bytes) if self.low_bytes < 8 else np.zeros(len(i), np.uint64)
        for k in range(self.low_bytes):
            value = value | (self.low[i, k].astype(np.uint64) << np.uint64(8 * k))
        return value

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose value is at least x; hi where there is none."""
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            below = self.access(middle) < x[open_]
            lo[open_] = np.where(below, middle + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], middle)
        return lo


class Trie:
    """Contexts, pointers to their successors, successors relative to the context, probabilities."""

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, back_off: np.ndarray):
        self.levels, self.codes, self.back_off = levels, codes, back_off

    @classmethod
    def of(cls, contexts: np.ndarray, starts: np.ndarray, words: np.ndarray, log_p: np.ndarray, log_back: np.ndarray) -> Trie:
        """Ascending contexts; starts of their ascending words (and the end); log10 probabilities and back-off weights."""
        owner = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(starts))
        return cls({"contexts": EliasFano.of(contexts), "pointers": EliasFano.of(starts),
                    "words": EliasFano.of((owner << np.uint64(WORD_BITS)) + words)}, quantised(log_p), quantised(log_back))

    def mapped(self, folder: str | None = None) -> Trie:
        """The same trie, read from a file mapped into memory; the file goes with the last reader."""
        arrays = [a for e in self.levels.values() for a in (e.low, e.high, e.ranks)] + [self.codes, self.back_off]
        with tempfile.TemporaryFile(dir=folder) as file:
            places = []
            for a in arrays:
                file.write(b"\0" * (-file.tell() % 8))
                places.append(file.tell())
                file.write(np.ascontiguousarray(a).tobytes())
            file.write(b"\0" * 8)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        back = [np.frombuffer(view, a.dtype, a.size, p).reshape(a.shape) for a, p in zip(arrays, places)]
        levels = {k: EliasFano(e.n, e.low_bytes, *back[3 * i:3 * i + 3]) for i, (k, e) in enumerate(self.levels.items())}
        return Trie(levels, *back[-2:])

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known context, found, log10 probability or else back-off weight) of each pair."""
        level, n = self.levels["contexts"], self.levels["contexts"].n
        known = np.zeros(len(contexts), bool)
        found, value = known.copy(), np.zeros(len(contexts))
        if not n or not len(contexts):
            return known, found, value
        distinct, which = np.unique(contexts, return_inverse=True)
        at = level.successor(distinct, np.zeros(len(distinct)), np.full(len(distinct), n))
        hit = at < n
        hit[hit] = level.access(at[hit]) == distinct[hit]
        known, at = hit[which], at[which]
        i = at[known]
        lo, hi = (self.levels["pointers"].access(x).astype(np.int64) for x in (i, i + 1))
        goal = (i.astype(np.uint64) << np.uint64(WORD_BITS)) + words[known]
        place = self.levels["words"].successor(goal, lo, hi)
        inside = place < hi
        inside[inside] = self.levels["words"].access(place[inside]) == goal[inside]
        out = restored(self.back_off[i])
        out[inside] = restored(self.codes[place[inside]])
        value[known] = out
        found[known] = inside
        return known, found, value


@dataclass
class Unigrams:
    """Bounded: the most frequent words, and the mean share of all others (their own counts are asked for)."""

    tokens: int
    types: int
    ends: int
    words: np.ndarray  # low bits, ascending
    log_p: np.ndarray
    log_rest: float
    hot: dict[int, tuple[int, int]]  # context: (tokens, salts)
    shards: int
    whole: bool = True  # no word is left out

    @property
    def hot_contexts(self) -> np.ndarray:
        return np.array(sorted(self.hot), np.uint64)

    @property
    def buckets(self) -> int:
        """Of rare words: fewer than shards, so that requests do not grow with the square of the input."""
        return max(1, math.ceil(8 * math.sqrt(self.shards)))

    def log_prob(self, words: np.ndarray, rare: np.ndarray = EMPTY, counts: np.ndarray = EMPTY) -> np.ndarray:
        """log10 probabilities; ``rare`` words, ascending, have ``counts``, and words in neither table none."""
        own = np.zeros(len(words))
        if len(rare):
            at = np.searchsorted(rare, words)
            at[at == len(rare)] = 0
            own = np.where(rare[at] == words, counts[at], 0)
        own = np.log10((own + 1) / (self.tokens + self.types + 1))
        if not len(self.words):
            return own
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == words, self.log_p[at], own)


def _tokens(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    return [hashes.of(x.lower().split()) for x in texts]


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n): exact counts of the hashed words of all rows, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def flushed():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for words in _tokens(as_bytes(batch.column(1)), hashes):
                held.append(words)
                size += len(words)
                if size > 6 * BATCH_TOKENS:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    return stage(rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def learn_unigrams(training: DataFrame, all_tokens: int | None = None) -> Unigrams:
    """Totals, and the most frequent words: what a whole count table tells in a bounded size."""
    return _learned(training)[0]


def _learned(training: DataFrame) -> tuple[Unigrams, DataFrame]:
    """The unigrams, and (word, n) of the words that are not among them."""
    counts = count_words(training)
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
    ends = training.count()
    tokens, types = (total.n or 0) + ends, total.types + (ends > 0)
    # the least count with at most UNIGRAMS words at or above it, from some 1,000 bins of counts
    bins = sorted(((r.b, r.k) for r in counts.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(
        F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, kept = None, 0
    for b, k in bins:
        if kept + k > UNIGRAMS:
            break
        least, kept = b, kept + k
    is_frequent = F.floor(F.log2("n") * 16) >= least if least is not None else F.lit(False)
    frequent = counts.where(is_frequent).toArrow()
    words = frequent.column("word").to_numpy().astype(np.int64).view(np.uint64)
    n = frequent.column("n").to_numpy().astype(np.float64)
    shards = max(1, -(-tokens // SHARD_TOKENS))
    limit = max(1.0, HOT_SHARE * tokens / shards)
    begin, end = (WordHashes()[x] for x in (BEGIN, END))
    # at most shards / HOT_SHARE words, also where the table is too small for them
    known = {r.word % (1 << 64): r.n for r in counts.where(F.col("n") > limit).collect()}
    if ends > limit:
        known[begin] = ends
    hot = {w: (c, math.ceil(c / limit)) for w, c in known.items()}
    p = np.r_[n + 1, ends + 1] / (tokens + types + 1)
    low = np.r_[words, np.uint64(end)].astype(np.uint64) & _MASK
    order = np.argsort(low, kind="stable")
    rest = max(1 - p.sum(), 1 / (tokens + types + 1)) / max(1, types - len(words))
    whole = kept == sum(k for _, k in bins)
    return (Unigrams(tokens, types, ends, low[order], np.log10(p[order]), math.log10(rest), hot, shards, whole),
            counts.where(~is_frequent))


def rare_words(known: Unigrams, words: np.ndarray) -> np.ndarray:
    """The distinct words, ascending, whose counts a shard has to ask for."""
    return EMPTY if known.whole else np.setdiff1d(words, known.words)


def _runs(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where a pair differs from the one before."""
    return np.r_[True, (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])] if len(contexts) else np.empty(0, bool)


def followers_here(known: Unigrams, contexts: np.ndarray, words: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The salted contexts met in a shard, ascending, and how many distinct words follow each in its training pairs.

    The salt goes by the word, so the followers in all shards add up to the context's own.
    """
    at = np.isin(contexts, known.hot_contexts)
    hot = np.unique(contexts[at])
    at &= trains
    c, w = contexts[at], words[at]
    order = np.lexsort((w, c))
    c, w = c[order], w[order]
    return hot, np.bincount(np.searchsorted(hot, c[_runs(c, w)]), minlength=len(hot))


def _requests(known: Unigrams, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(bucket, rare words, salted contexts and their followers) of a shard."""
    if known.whole and not known.hot:
        return
    contexts, words, _, trains = (np.concatenate(x) for x in zip(*map(_decoded, blobs)))
    rare = rare_words(known, words)
    hot, followers = followers_here(known, contexts, words, trains)
    bucket, hot_bucket = _bucket(known, rare), _bucket(known, hot)
    for b in np.union1d(bucket, hot_bucket).tolist():
        mine, his = rare[bucket == b], hot_bucket == b
        yield b, b"".join((np.array([len(mine)], "<i8").tobytes(), mine.astype("<u8").tobytes(),
                           hot[his].astype("<u8").tobytes(), followers[his].astype("<u8").tobytes()))


def _bucket(known: Unigrams, words: np.ndarray) -> np.ndarray:
    return (words & _MASK) % np.uint64(known.buckets)


def _replies(requests: list[bytes], words: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each request the words' counts, and the followers of its salted contexts in all shards, from one bucket."""
    words, which = np.unique(words.view(np.uint64) & _MASK, return_inverse=True)
    n = np.bincount(which, n).astype(np.int64)
    asked, hot = [], []
    for blob in requests:
        all_ = np.frombuffer(blob, "<u8")
        k = int(all_[0]) + 1
        asked.append(all_[1:k])
        hot.append(all_[k:].reshape(2, -1))
    contexts, which = np.unique(np.concatenate([c for c, _ in hot]) if hot else EMPTY, return_inverse=True)
    followers = np.bincount(which, np.concatenate([f for _, f in hot]) if hot else None, len(contexts)).astype(np.int64)
    out = []
    for mine, (c, _) in zip(asked, hot):
        counts = np.zeros(len(mine), np.int64)
        if len(words):
            at = np.searchsorted(words, mine)
            at[at == len(words)] = 0
            counts = np.where(words[at] == mine, n[at], 0)
        out.append(np.r_[counts, followers[np.searchsorted(contexts, c)]].astype("<i8").tobytes())
    return out


def _coded(known: Unigrams, docs: list[np.ndarray], trains: np.ndarray, first: int, begin: int, end: int):
    """Blobs of (context, word, document) by shard, of consecutive rows from uid ``first`` on."""
    sizes = np.array([len(d) + 1 for d in docs])
    own = np.concatenate(docs) if docs else np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    contexts = np.insert(own, starts - np.arange(len(docs)), np.uint64(begin))
    words = np.insert(own, starts + sizes - 1 - np.arange(len(docs)), np.uint64(end)) & _MASK
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
    spread = mixed(contexts)
    if known.hot:
        hot = known.hot_contexts
        salts = np.array([known.hot[int(w)][1] for w in hot], np.uint64)
        at = np.searchsorted(hot, contexts)
        at[at == len(hot)] = 0
        is_hot = hot[at] == contexts
        spread[is_hot] = salted(contexts[is_hot], words[is_hot], salts[at[is_hot]], known.shards)
    shard = (spread % np.uint64(known.shards)).astype(np.int64)
    order = np.lexsort((words, contexts, shard))
    edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
    for a, b in zip(edges, edges[1:]):
        part = order[a:b]
        c = contexts[part]
        heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        planes = words[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BITS // 8]
        where = (doc[part] << np.uint32(1) | trains[doc[part]].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        yield int(shard[part[0]]), b"".join((
            np.array([first, len(part), len(heads)], "<i8").tobytes(), c[heads].astype("<u8").tobytes(),
            np.diff(np.r_[heads, len(part)]).astype("<u4").tobytes(),
            *(np.ascontiguousarray(p[:, k]).tobytes() for p in (planes, where) for k in range(p.shape[1]))))


def _decoded(blob: bytes) -> tuple[np.ndarray, ...]:
    """(context, word, uid, trains) of one blob."""
    first, n, heads = np.frombuffer(blob, "<i8", 3)
    at = 24
    c = np.frombuffer(blob, "<u8", heads, at)
    runs = np.frombuffer(blob, "<u4", heads, at := at + 8 * int(heads))
    at += 4 * int(heads)
    planes = np.frombuffer(blob, np.uint8, 9 * int(n), at).reshape(9, -1)
    words = sum(planes[k].astype(np.uint64) << np.uint64(8 * k) for k in range(5))
    where = sum(planes[5 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return np.repeat(c, runs), words, first + (where >> 1).astype(np.int64), (where & 1).astype(bool)


def salted(contexts: np.ndarray, words: np.ndarray, salts: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each pair with a hot context: by the context and a salt that the word decides."""
    return mixed(mixed(contexts) + mixed(words) % salts) % np.uint64(shards)


def shard_trie(known: Unigrams, contexts: np.ndarray, words: np.ndarray, rare: np.ndarray = EMPTY, counts: np.ndarray = EMPTY,
               hot: np.ndarray = EMPTY, hot_followers: np.ndarray = EMPTY) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of the training pairs given in ascending order, its contexts and their tokens in all shards.

    A salted context has the words of some salts here, perhaps none; its tokens
    and followers (``hot_followers``) are those of all shards.
    """
    pair = np.flatnonzero(_runs(contexts, words))
    n = np.diff(np.r_[pair, len(contexts)])
    c, w = contexts[pair], words[pair]
    heads = np.union1d(c, hot).astype(np.uint64)
    starts = np.r_[np.searchsorted(c, heads), len(c)].astype(np.int64)
    here = np.diff(starts)
    owner = np.repeat(np.arange(len(heads)), here)
    followers, tokens = here.copy(), np.bincount(owner, n, len(heads)).astype(np.int64)
    at = np.searchsorted(heads, hot)
    followers[at] = hot_followers
    tokens[at] = [known.hot[int(x)][0] for x in hot]
    back = DISCOUNT * followers / np.maximum(tokens, 1)
    p = (n - DISCOUNT) / tokens[owner] + back[owner] * 10 ** known.log_prob(w, rare, counts)
    trie = Trie.of(heads, starts, w, np.log10(np.minimum(p, 1.0)), np.log10(back))
    return trie, heads, tokens


def _scored(known: Unigrams, blobs: list[bytes], begin: int, replies: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
    """Per block of documents and for each of these: its place, log10(count + 1) summed over its contexts, known contexts,
    log10 probabilities."""
    contexts, words, uid, trains = (np.concatenate(x) for x in zip(*map(_decoded, blobs)))
    order = np.lexsort((words, contexts))
    contexts, words, uid, trains = contexts[order], words[order], uid[order], trains[order]
    rare = rare_words(known, words)
    hot, followers = followers_here(known, contexts, words, trains)
    counts, bucket, hot_bucket = np.zeros(len(rare), np.int64), _bucket(known, rare), _bucket(known, hot)
    for b, blob in replies.items():
        told, mine = np.frombuffer(blob, "<i8"), bucket == b
        k = np.count_nonzero(mine)
        counts[mine], followers[hot_bucket == b] = told[:k], told[k:]
    trie, heads, tokens = shard_trie(known, contexts[trains], words[trains], rare, counts, hot, followers)
    trie = trie.mapped()
    # every pair once; they are sorted
    head = _runs(contexts, words)
    which = np.cumsum(head) - 1
    c, w = contexts[head], words[head]
    is_known, found, value = trie.look_up(c, w)
    log_p = np.where(found, value, value + known.log_prob(w, rare, counts))
    at = np.searchsorted(heads, c)
    at[at == len(heads)] = 0
    n = np.where(is_known, tokens[at], 0) if len(heads) else np.zeros(len(c))
    is_word = c != np.uint64(begin)
    base = np.where(is_word, np.log10(n + 1), 0.0)
    docs, at = np.unique(uid, return_inverse=True)
    sums = (docs, np.bincount(at, base[which]), np.bincount(at, (is_word & (n > 0))[which]).astype(np.int64),
            np.bincount(at, log_p[which]))
    # by block, so that few rows leave a shard however many documents it meets
    firsts = np.unique([np.frombuffer(x, "<i8", 1)[0] for x in blobs])
    edges = np.r_[np.searchsorted(docs, firsts), len(docs)]
    for first, lo, hi in zip(firsts.tolist(), edges, edges[1:]):
        part = [x[lo:hi] for x in sums]
        yield first, b"".join(((part[0] - first).astype("<u4").tobytes(), part[1].astype("<f8").tobytes(),
                               part[2].astype("<u4").tobytes(), part[3].astype("<f8").tobytes()))


def score(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row scored by a model of the rows outside the held-out fold.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). A
    null or empty text is the end token alone. Repeated rows count and score
    each; without training rows all words are unknown; an empty table gives an
    empty result.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    known, rare_counts = _learned(rows.where(~F.col("held_out")).select("doc_id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    begin, end = (WordHashes()[x] for x in (BEGIN, END))
    names = ["shard", "blob", "doc_id", "uid", "first", "held_out", "n_tokens"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A blob per shard of some documents, and a row per document."""
        hashes = WordHashes()
        for batch in batches:
            uid = batch.column(3).to_numpy()
            held_out = batch.column(2).to_numpy(zero_copy_only=False)
            texts = as_bytes(batch.column(1))
            a = 0
            while a < len(texts):
                held_words, size, b = [], 0, a
                while b < len(texts) and size < BATCH_TOKENS:
                    held_words.append(hashes.of(texts[b].lower().split()))
                    size += len(held_words[-1]) + 1
                    b += 1
                blobs = list(_coded(shared.value, held_words, ~held_out[a:b], int(uid[a]), begin, end))
                n, k = b - a, len(blobs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x for x, _ in blobs] + [int(u) % shared.value.shards for u in uid[a:b]], pa.int64()),
                    pa.array([x for _, x in blobs] + [None] * n, pa.binary()),
                    pa.array([None] * k + batch.column(0)[a:b].to_pylist(), batch.column(0).type),
                    pa.array([None] * k + uid[a:b].tolist(), pa.int64()), pa.array(np.full(k + n, uid[a])),
                    pa.array([None] * k + held_out[a:b].tolist(), pa.bool_()),
                    pa.array([None] * k + [len(x) + 1 for x in held_words], pa.int64())], names=names)
                a = b

    def blobs_of(table: pa.Table) -> list[bytes]:
        return table.column("blob").drop_null().to_pylist()

    def ask(table: pa.Table) -> pa.Table:
        """What a shard wants to know of each bucket."""
        blobs = blobs_of(table)
        found = list(_requests(shared.value, blobs)) if blobs else []
        return pa.table({"bucket": pa.array([b for b, _ in found], pa.int64()),
                         "shard": pa.array([table.column("shard")[0].as_py()] * len(found), pa.int64()),
                         "blob": pa.array([x for _, x in found], pa.binary())})

    def answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
        found = _replies(asked.column("blob").to_pylist(), counts.column("word").to_numpy(), counts.column("n").to_numpy())
        return pa.table({"shard": asked.column("shard"), "bucket": asked.column("bucket"), "blob": pa.array(found, pa.binary())})

    def look_up(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Sums of each block in a shard; the documents' own rows pass through."""
        own = table.filter(table.column("blob").is_null())
        blobs = blobs_of(table)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist()))
        found = list(_scored(shared.value, blobs, begin, told)) if blobs else []
        none = lambda c: pa.nulls(len(found), table.schema.field(c).type)
        sums = pa.table([none("shard"), pa.array([x for _, x in found], pa.binary()), none("doc_id"), none("uid"),
                         pa.array([x for x, _ in found], pa.int64()), none("held_out"), none("n_tokens")], names=names)
        return pa.concat_tables([own.select(names), sums.cast(own.select(names).schema)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, documents first: what each shard has of them added up."""
        fields = ["doc_id", "held_out", "n_tokens", "base", "known", "log_p"]
        current, own, sums = None, [], None

        def closed():
            docs_ = pa.Table.from_batches(own)
            return pa.RecordBatch.from_arrays(
                [docs_.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")]
                + [pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], names=fields)

        for batch in batches:
            firsts = batch.column(4).to_numpy()
            edges = np.flatnonzero(np.r_[True, firsts[1:] != firsts[:-1], True])
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                if firsts[lo] != current:
                    if own:
                        yield closed()
                    current, own, sums = firsts[lo], [], None
                is_doc = part.column(1).is_null()
                if (docs_ := part.filter(is_doc)).num_rows:
                    own.append(docs_)
                for blob in part.filter(pa.compute.invert(is_doc)).column(1).to_pylist():
                    if sums is None:
                        sums = np.zeros((3, sum(x.num_rows for x in own)))
                    n = len(blob) // 24
                    at = np.frombuffer(blob, "<u4", n)
                    for k, (kind, place) in enumerate((("<f8", 4), ("<u4", 12), ("<f8", 16))):
                        sums[k, at] += np.frombuffer(blob, kind, n, place * n)
        if own:
            yield closed()

    kinds = f"shard long, blob binary, doc_id {id_type}, uid long, first long, held_out boolean, n_tokens long"
    coded = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(code, kinds)
    # dealt once: Spark reuses the exchange for the requests and for the scores
    dealt = coded.repartition(known.shards, "shard")
    asked = dealt.groupBy("shard").applyInArrow(ask, "bucket long, shard long, blob binary")
    told = rare_counts.select((F.col("word").bitwiseAND(F.lit(int(_MASK))) % known.buckets).alias("bucket"), "word", "n")
    replies = asked.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        answer, "shard long, bucket long, blob binary").repartition(known.shards, "shard")
    sums = dealt.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(look_up, kinds)
    totals = sums.repartition("first").sortWithinPartitions("first", F.asc_nulls_last("uid")).mapInArrow(
        add_up, f"doc_id {id_type}, held_out boolean, n_tokens long, base double, known long, log_p double")
    spread = math.log10(known.tokens + known.types + 1)
    return totals.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + int(known.ends > 0)).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10(known.ends + 1) - F.col("n_tokens") * spread).alias("base_score"),
        F.col("log_p").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
