"""Phrase collocations by prefix-free parsing.

A text is a row of words, with a mark wherever punctuation or a line end parts
two pieces. Windows of ``OVERLAP`` neighbouring tokens whose hash is a multiple
of ``PERIOD`` are triggers; a chunk runs from one trigger to the end of the
next, so neighbouring chunks share just the trigger, equal passages are parsed
alike wherever they stand, and every phrase of up to ``OVERLAP`` + 1 words lies
whole in the one chunk that holds its first word before the chunk's last
trigger. Distinct chunks form a dictionary with their frequencies per language;
phrases are counted inside distinct chunks, weighted by frequency, and what
starts in an overlap is counted in the later chunk alone.

Longer phrases are counted only where the shorter ones within them are frequent
enough: the frequent ones are known to the tasks as a filter of ``FILTER_BITS``
bits, a size that does not grow with the corpus. Meetings of hashes in it cost
some counts that are dropped later, never a phrase. Counts are exact, the
arithmetic of scores is on whole decimals.

A null text counts as empty, a null language as ``und``. Repeated rows count
each time. Ties go by score, count and the phrase's bytes. An empty table or
texts without words give an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.llm.common import WordHashes, mixed, quoted
from facsimile.sources.staging import stage

#: Tokens that neighbouring chunks share; one less than the words of the longest phrase.
OVERLAP = 2
#: One window in so many is a trigger.
PERIOD = 32
LEAST_COUNT = 10
#: Percentage of a phrase's occurrences within a longer one from which on it goes.
WITHIN = 50
TOP = 2000
FILTER_BITS = 1 << 24
#: Parts of a language's candidates that are cut to the first ones on their own.
SLICES = 64
#: Bytes of chunks gathered before a task counts their phrases, and before it passes on what it has parsed.
TOGETHER = 1 << 23
PARSED_TOGETHER = 1 << 22

#: No text in UTF-8 holds this byte.
_MARK = b"\xff"
_SEED = 42
#: Fixed: what parts pieces becomes the mark.
_PLAIN = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _MARK * 10)


# --- parsing -----------------------------------------------------------------------

def tokens(text: bytes) -> list[bytes]:
    """Words in order, A-Z in lower case, with a mark between pieces."""
    return text.lower().translate(_PLAIN).replace(_MARK, b" \xff ").split()  # no white space but blanks and tabs is left


def parse(text: bytes, hashes: WordHashes, period: int = PERIOD) -> Iterator[tuple[bytes, bool]]:
    """The chunks of a text, and whether another one follows (whose first tokens are this one's last)."""
    row = tokens(text)
    if not row:
        return
    h = hashes.of(row)
    triggers = np.flatnonzero(mixed(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(period) == 0) if len(row) > OVERLAP else ()
    start = 0
    for t in triggers:
        if t > start:
            yield b" ".join(row[start:t + OVERLAP]), True
            start = int(t)
    yield b" ".join(row[start:]), False


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, goes_on, freq): distinct chunks of each language with their frequencies."""
    period, together = PERIOD, PARSED_TOGETHER
    rows = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       quoted(text_col).cast("string").cast("binary").alias("text"))

    def batch_of(langs: list, chunks: list, on: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()), pa.array(on, pa.bool_())],
                                          names=["lang", "chunk", "goes_on"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        langs, chunks, on, size = [], [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                found = list(parse(text, hashes, period))
                langs += [lang] * len(found)
                chunks += [chunk for chunk, _ in found]
                on += [goes_on for _, goes_on in found]
                size += len(text)
                if size >= together:
                    yield batch_of(langs, chunks, on)
                    langs, chunks, on, size = [], [], [], 0
        yield batch_of(langs, chunks, on)

    parsed = rows.mapInArrow(run, "lang string, chunk binary, goes_on boolean")
    return parsed.groupBy("lang", "chunk", "goes_on").agg(F.count(F.lit(1)).alias("freq"))


# --- counting ---------------------------------------------------------------------------

def frequent_filter(counts: DataFrame, length: int, least: int) -> np.ndarray:
    """Bits, by the hashes of their words, of all phrases of one or two words counted ``least`` times and more."""
    frequent = counts.where(F.col("a") >= least)
    if length == 1:
        hashed = F.xxhash64("phrase")
    else:
        first, second = (F.xxhash64(_word(i)) for i in range(2))
        hashed = first.bitwiseXOR(F.shiftleft(second, 17).bitwiseOR(F.shiftrightunsigned(second, 47)))
    cells = frequent.select(hashed.bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")).alias("bin")).select(
        F.shiftright("bin", 6).alias("cell"), F.expr("shiftleft(1L, cast(bin & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two words from theirs, as in ``frequent_filter``."""
    return first ^ (second << np.uint64(17) | second >> np.uint64(47))


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the filter has each hash."""
    bins = hashes & np.uint64(64 * len(table) - 1)
    return (table[bins >> np.uint64(6)] >> (bins & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Table:
    """Tokens of many chunks of one language as numbers, with weights."""

    def __init__(self, chunks: pa.Array, goes_on: np.ndarray, freq: np.ndarray):
        parts = pc.split_pattern(chunks, b" ")
        sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        self.words = coded.dictionary
        #: numbers in order, -1 for marks and behind every chunk, so that no phrase goes on into the next
        self.ids = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
        mark = pc.index(self.words, pa.scalar(_MARK, self.words.type)).as_py()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids[ids == mark] = -1
        self.ids[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        # what starts in the shared tail counts in the next chunk
        own = np.where(goes_on, sizes - OVERLAP, sizes)
        self.weights = np.repeat(np.stack([freq, np.zeros_like(freq)], 1).ravel(), np.stack([own, sizes + 1 - own], 1).ravel())

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        return np.fromiter((xxh64_intdigest(w, _SEED) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def _counted(self, at: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases that start at the places, and their counts."""
        base, pairs = len(self.words), None
        if not len(at):
            return pa.array([], pa.binary()), np.empty(0, np.int64)
        codes = self.ids[at]
        for j in range(1, length):
            if j == 2 and base ** 3 >= 1 << 63:  # pairs take numbers of their own
                pairs, codes = np.unique(codes, return_inverse=True)
            codes = codes * base + self.ids[at + j]
        order = np.argsort(codes)
        codes = codes[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.add.reduceat(self.weights[at[order]], starts)
        codes, words = codes[starts], []
        for j in reversed(range(length)):
            codes, ids = (codes // base, codes % base) if j else (None, codes)
            if j == 2 and pairs is not None:
                codes = pairs[codes]
            words.insert(0, self.words.take(pa.array(ids)))
        return pc.binary_join_element_wise(*words, b" ") if length > 1 else words[0], counts

    def unigrams(self) -> tuple[pa.Array, np.ndarray]:
        return self._counted(np.flatnonzero((self.ids >= 0) & (self.weights > 0)), 1)

    def bigrams(self, words: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Pairs of words that the filter has."""
        good = np.append(_among(self.hashes(), words), False)[self.ids]  # the last one is for -1
        return self._counted(np.flatnonzero(good[:-1] & good[1:] & (self.weights[:-1] > 0)), 2)

    def trigrams(self, pairs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words in threes whose both pairs the filter has."""
        there, hashes = self.ids >= 0, self.hashes()[self.ids]
        both = there[:-1] & there[1:] & _among(_pair_hash(hashes[:-1], hashes[1:]), pairs)
        return self._counted(np.flatnonzero(both[:-1] & both[1:] & (self.weights[:-2] > 0)), 3)


def count_phrases(chunks: DataFrame, length: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, a): occurrences of phrases of so many words; ``frequent`` filters what they are made of."""
    together = TOGETHER

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        for lang in pc.unique(rows["lang"]):
            mine = rows.filter(pc.equal(rows["lang"], lang)).combine_chunks()
            table = _Table(mine["chunk"].combine_chunks(), mine["goes_on"].to_numpy(), mine["freq"].to_numpy())
            phrases, n = (table.unigrams() if length == 1 else
                          table.bigrams(frequent) if length == 2 else table.trigrams(frequent))
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases.cast(pa.binary()), pa.array(n)],
                                             names=["lang", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= together:
                yield from counted(waiting)
                waiting, size = [], 0
        if waiting:
            yield from counted(waiting)

    rows = chunks.select("lang", "chunk", "goes_on", "freq").mapInArrow(run, "lang string, phrase binary, a long")
    return rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


# --- scores --------------------------------------------------------------------------------

def _word(i: int) -> Column:
    """A word of the phrase, by its place."""
    return F.split(F.col("phrase").cast("string"), " ").getItem(i).cast("binary")


def _with_count(rows: DataFrame, part: str, counts: DataFrame, name: str) -> DataFrame:
    """Adds the count of the phrase in column ``part``."""
    there = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("a").alias(name))
    return rows.join(there, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase"))).drop("_lang", "_phrase")


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two and three words."""
    chunks = stage(dictionary(docs, text_col, lang_col), "chunks")
    ones = stage(count_phrases(chunks, 1), "words")
    twos = stage(count_phrases(chunks, 2, frequent_filter(ones, 1, least)).where(F.col("a") >= least), "pairs")
    threes = stage(count_phrases(chunks, 3, frequent_filter(twos, 2, least)).where(F.col("a") >= least), "threes")

    joined = lambda a, b: F.concat(F.col(a), F.lit(b" "), F.col(b))
    cut = threes.select("lang", "phrase", "a", _word(0).alias("w1"), _word(1).alias("w2"), _word(2).alias("w3"))
    cut = cut.select("*", joined("w1", "w2").alias("w12"), joined("w2", "w3").alias("w23"))
    for part, counts in (("w1", ones), ("w23", twos), ("w12", twos), ("w3", ones)):
        cut = _with_count(cut, part, counts, f"f_{part}")
    cut = cut.withColumn("first", _score("f_w1", "f_w23")).withColumn("second", _score("f_w12", "f_w3"))
    early = F.col("first") <= F.col("second")
    three = cut.select("lang", "phrase", "a", F.when(early, F.col("f_w1")).otherwise(F.col("f_w12")).alias("l"),
                       F.when(early, F.col("f_w23")).otherwise(F.col("f_w3")).alias("r"),
                       F.least("first", "second").alias("score"))

    holders = cut.select("lang", F.explode(F.array("w12", "w23")).alias("within"), F.col("a").alias("longer"))
    holders = holders.groupBy("lang", "within").agg(F.max("longer").alias("longer"))
    pairs = twos.select("lang", "phrase", "a", _word(0).alias("w1"), _word(1).alias("w2"))
    pairs = pairs.join(holders, (pairs.lang == holders.lang) & (pairs.phrase == holders.within), "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < WITHIN * F.col("a"))).select(pairs["*"])
    for part, name in (("w1", "l"), ("w2", "r")):
        pairs = _with_count(pairs, part, ones, name)
    two = pairs.select("lang", "phrase", "a", "l", "r", _score("l", "r").alias("score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slices = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    best = two.unionAll(three).withColumn("slice", slices).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = ones.groupBy(F.col("lang").alias("of")).agg(F.sum("a").alias("n"))
    return best.join(totals, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n",
        F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of the documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same phrases by SQL, every window of every piece counted on its own."""
    return rf"""WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k))),
    counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
    candidates AS MATERIALIZED (
        SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= {LEAST_COUNT}),
    cuts AS (
        SELECT c.lang, c.k, c.phrase, c.a, c.w, p, l.f AS l, r.f AS r,
               (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS p FROM candidates) c
        JOIN counts l ON l.lang = c.lang AND l.k = p AND l.phrase = array_to_string(c.w[1:p], ' ')
        JOIN counts r ON r.lang = c.lang AND r.k = c.k - p AND r.phrase = array_to_string(c.w[p + 1:], ' ')),
    scored AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, p) AS place FROM cuts),
    held AS (
        SELECT lang, within, max(a) AS longer FROM (
            SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS within
            FROM candidates WHERE k = 3) GROUP BY ALL),
    ranked AS (
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
               phrase, a, l, r, score
        FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.within = s.phrase
        WHERE place = 1 AND NOT (k = 2 AND coalesce(100 * longer >= {WITHIN} * a, false)))
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM counts c WHERE c.lang = ranked.lang AND k = 1) AS n,
       CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}"""
