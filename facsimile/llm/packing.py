"""Packing documents into token windows by order-preserving dynamic programming.

Documents keep their order. Cuts may fall at document ends (free), at sentence
ends or between words (each for a penalty), and the windows between cuts hold
at most ``WINDOW`` tokens. The cheapest cuts minimise padding plus penalties:

    best[j] = min over i, pos[j] - pos[i] <= WINDOW, of best[i] + WINDOW - (pos[j] - pos[i]) + penalty[j]

so the inner minimum is that of best[i] + pos[i] over a sliding window, which a
monotone queue gives in constant time per cut. Windows whose length is a power
of two need no padding, which adds a lookup for each such length.

Rows are dealt by blocks of neighbouring ids and sorted, so the cuts depend on
the documents alone. A task walks its rows as a stream and closes a segment at
the first document end beyond ``SEGMENT`` tokens: memory is bounded by that and
the longest document, however many rows a block has.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import as_bytes, text_rows

WINDOW = 2048
#: Lengths below WINDOW that need no padding; shorter powers of two are left out, as many tiny sequences help nobody.
EXACT = (256, 512, 1024)
SENTENCE_PENALTY = 2
WORD_PENALTY = 24
#: Tokens between cuts inside a sentence.
WORD_STEP = 64
SEGMENT = 1 << 19
IDS_PER_BLOCK = 512
END_ID = 1
SCHEMA = ("doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "block long")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's rules never join what white space parts, and never a run
    of letters with the punctuation behind it, so a text's ids are those of
    its words and tails in a row. Each new word is tokenized once and kept;
    bounded: a full table starts anew.
    """

    LIMIT = 500_000  # entries of each table, some 120 MB
    TAIL = b".,;:!?*&%$#|"
    TOGETHER = 1_000_000
    #: Words of these letters alone are one piece to the rules, whose only effect on them is lower case.
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.in_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}  # stems and tails
        self.closing = np.array(self.tokenizer.encode(". ! ?", add_special_tokens=False).ids, "<u4")
        self.words: dict[bytes, bytes] = {}  # what stands between white space

    def _learn(self, words: list[bytes]) -> None:
        """Plain words go to the model at once; others joined by spaces, told apart again by their places."""
        self.known[b""] = b""
        others = []
        for w in words:
            text = w.decode("utf-8", "replace")
            if self.LETTERS.fullmatch(text):
                text = text.lower()
                symbols = text if text.isascii() else self.in_bytes.pre_tokenize_str(text)[0][0]
                ids = [t.id for t in self.model.tokenize(symbols)]
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
            elif w:
                others.append(w)
        words = others
        for i in range(0, len(words), 1000):
            part = words[i:i + 1000]
            texts = [w.decode("utf-8", "replace") for w in part]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            owner = np.searchsorted(starts, np.array([o[0] for o in got.offsets], np.int64), "right") - 1
            edges = np.searchsorted(owner, np.arange(len(part) + 1))
            ids = np.array(got.ids, "<u4")
            self.known.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, edges, edges[1:]))

    def _split(self, word: bytes) -> tuple[bytes, bytes]:
        stem = word.rstrip(self.TAIL)
        if stem and stem[-1] < 128 and stem[-1:].isalnum():
            return stem, word[len(stem):]
        return word, b""

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Per text its ids with the end id, and where its sentences end (in ids, the end excluded)."""
        at, ids_of = 0, self.words
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= self.TOGETHER):
                size += len(texts[to])
                to += 1
            # marks of special tokens are exact, so a text that may hold one keeps its capitals
            split = [(x if b"<|" in x else x.lower()).split() for x in texts[at:to]]
            at = to
            new = set().union(*split).difference(ids_of)
            if new:
                if len(ids_of) + len(new) > self.LIMIT:
                    ids_of.clear()
                    new = set().union(*split)
                parted = {w: self._split(w) for w in new}
                known = self.known
                stems = {x for pair in parted.values() for x in pair}
                if lacking := stems.difference(known):
                    if len(known) + len(lacking) > self.LIMIT:
                        known.clear()
                        lacking = stems
                    self._learn(sorted(lacking))
                ids_of.update((w, known[a] + known[b]) for w, (a, b) in parted.items())
            for words in split:
                ids = b"".join(map(ids_of.__getitem__, words))
                coded = np.frombuffer(ids, "<u4")
                places = np.flatnonzero(np.logical_or.reduce([coded == c for c in self.closing])) + 1
                yield ids + END_ID.to_bytes(4, "little"), places[places < len(coded)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so what one task has learned serves the next."""
    return Encoder(path)


def cuts_of(total: int, sentence_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """A document's cut places, the last its end, and their penalties."""
    places = dict.fromkeys(sentence_ends.tolist(), SENTENCE_PENALTY)
    edges = [0, *places, total]
    for a, b in zip(edges, edges[1:]):
        if b - a > WORD_STEP:
            places.update(dict.fromkeys(range(a + WORD_STEP, b, WORD_STEP), WORD_PENALTY))
    places[total] = 0
    at = sorted(places)
    return at, [places[p] for p in at]


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW, exact: tuple[int, ...] = EXACT) -> list[int]:
    """The window ends of least cost over ascending cut places; no two neighbours are further apart than a window."""
    if not places:
        return []
    pos, best, back = [0, *places], [0], [0]
    at = {0: 0}
    queue = deque([(0, 0)])  # (best + pos, index), ascending in both
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - p
        for length in exact:
            k = at.get(p - length)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += penalties[j - 1]
        best.append(cost)
        back.append(i)
        at[p] = j
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(pos) - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


class _Segment:
    """Documents gathered since the last close, and the pieces they give."""

    def __init__(self):
        self.docs: list[tuple[object, bytes]] = []
        self.places: list[int] = []
        self.penalties: list[int] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes, sentence_ends: np.ndarray) -> None:
        n = len(ids) // 4
        at, penalties = cuts_of(n, sentence_ends)
        self.docs.append((doc_id, ids))
        self.places.extend(self.tokens + a for a in at)
        self.penalties.extend(penalties)
        self.tokens += n

    def pieces(self, first_sequence: int) -> Iterator[tuple]:
        ends = best_cuts(self.places, self.penalties)
        k, begin, done = 0, 0, 0
        for doc_id, ids in self.docs:
            n = len(ids) // 4
            start = 0
            while start < n:
                length = min(n, ends[k] - done) - start
                part = ids[4 * start:4 * (start + length)]
                yield doc_id, start, length, zlib.crc32(part), n, first_sequence + k, done + start - begin
                start += length
                if done + start == ends[k]:
                    begin = ends[k]
                    k += 1
            done += n
        self.n_sequences = k


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, block).
    Null and empty texts are the end id alone. Repeated rows are packed like
    others; rows without an id follow one another by their texts' hash. An
    empty table gives no pieces. sequence_id is unique, not gapless.
    """
    rows = text_rows(docs, id_col, text_col)
    block = F.coalesce(F.floor(F.col("doc_id") / IDS_PER_BLOCK).cast("long"),
                       F.pmod(F.xxhash64("text"), F.lit(64)) - F.lit(1 << 40))
    rows = rows.withColumn("block", block)
    schema = SCHEMA.format(rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        segment, current = _Segment(), None

        def closed():
            nonlocal segment, sequence
            pieces = [(*p, current) for p in segment.pieces(sequence)]
            sequence += segment.n_sequences
            segment = _Segment()
            for at in range(0, len(pieces), 20_000):
                columns = list(zip(*pieces[at:at + 20_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "block"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            ids_and_ends = tokens.encode(as_bytes(batch.column(1)))
            for doc_id, at, (ids, ends) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ids_and_ends):
                if segment.docs and (at != current or segment.tokens >= SEGMENT):
                    yield from closed()
                current = at
                segment.add(doc_id, ids, ends)
        if segment.docs:
            yield from closed()

    return rows.repartition("block").sortWithinPartitions("block", "doc_id", "text").mapInArrow(run, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files of this machine lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
