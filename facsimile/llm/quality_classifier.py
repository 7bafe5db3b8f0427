"""Quality by co-training: two views of a document teach each other.

The text view sees words, word shapes and repetition; the metadata view sees
language, source and length. Each view is a naive Bayes classifier over hashed
features, kept where a chi-squared test ties them to the label. In every round
each view labels the unlabelled documents it is sure of, by its calibrated
probability, and the other view learns from them beside the true labels.
Finally the calibrated views are combined.

Features are made once, in one map over the texts, and staged; rounds and scores
read the staged numbers. A round is one aggregation over them: tasks add up
counts per feature, and what reaches the driver is a fixed number of sums
(features, and bins of scores for calibration) whatever the table's size. True
labels are a bounded sample (``LABELLED``, by hash of the id) and broadcast, so
that no feature is shuffled; all other documents take part as unlabelled.
Calibration uses the labelled rows of fold 0, which no view learns from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.llm.common import WordHashes, as_bytes, fold, quoted, shingle_hashes
from facsimile.sources.staging import stage

ROUNDS = 3
FOLDS = 5
TEXT_FEATURES, META_FEATURES = 1 << 15, 1 << 12
VIEWS = ("text", "meta")
FEATURES = ("label", "calibrates", "text", "meta")
SCORES = ("text_score", "meta_score", "score")
#: The views learn from at most so many true labels, broadcast at some 16 bytes each; beyond, ids go by parts of their hashes.
LABELLED, LABEL_PARTS = 400_000, 4096
#: A view passes a label on where its calibrated probability of good quality is beyond these.
SURE_BAD, SURE_GOOD = 0.02, 0.98
LEAST_CHI_SQUARED = 15.1
LEAST_DOCUMENTS = 4
#: Texts that are taken out of an Arrow batch at a time.
TEXTS = 256
#: Bins of raw scores (text view) and of combined ones, for calibration.
BINS = 512
GRID = 48

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 0, each run of one kind once."""
    out = bytearray()
    for c in word.translate(_SHAPE):
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


class TextFeatures:
    """Feature numbers of a text; word tables are bounded and start anew when full."""

    LIMIT = 1 << 17

    def __init__(self):
        self.hashes = WordHashes()
        self.known: dict[bytes, tuple[int, int]] = {}

    @staticmethod
    def _number(kind: bytes, what: bytes) -> int:
        return zlib.crc32(kind + what) % TEXT_FEATURES

    def of(self, data: bytes) -> np.ndarray:
        words = data.split()
        if len(self.known) > self.LIMIT:
            self.known.clear()
        distinct = set(words)
        for w in distinct.difference(self.known):
            self.known[w] = self._number(b"w", w.lower()), self._number(b"s", shape(w))
        found = {i for w in distinct for i in self.known[w]}
        n = len(words)
        figures = {"n": n.bit_length()}
        if n:
            coded = self.hashes.of(words)
            windows = shingle_hashes(coded, 5)
            shapes = sum(1 for w in words if not w[-1:].isalnum() and w[-1] not in b".,;:!?" and w[-1] < 128)
            lines = [x for x in data.split(b"\n") if x.strip()]
            share = lambda part, whole: int(10 * part / max(1, whole))
            figures |= {
                "stutter": share(np.count_nonzero(coded[1:] == coded[:-1]), n - 1),
                "again": share(len(windows) - len(np.unique(windows)), len(windows)),
                "lines": share(len(lines) - len(set(lines)), len(lines)),
                "marks": share(shapes, n),
                "length": int(2 * np.log2(max(1, len(data) / n))),
                "capitals": share(sum(1 for w in words if w.isupper()), n),
                "distinct": share(len(distinct), n),
            }
        found.update(self._number(b"f", f"{k}:{v}".encode()) for k, v in figures.items())
        return np.fromiter(found, np.int32, len(found))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Feature numbers of the metadata; a null is a value of its own."""
    size = None if n_chars is None or n_chars < 0 else int(2 * np.log2(n_chars + 1))
    facts = (f"lang:{lang}", f"source:{source}", f"size:{size}", f"pair:{lang}:{source}", f"both:{lang}:{size}")
    return sorted({zlib.crc32(f.encode()) % META_FEATURES for f in facts})


@dataclass
class View:
    """Naive Bayes weights of one view, and the curve that calibrates its scores."""

    weights: np.ndarray
    prior: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0

    @classmethod
    def learned(cls, counts: np.ndarray, totals: np.ndarray) -> View:
        """From documents per (class, feature) and per class."""
        n, (bad, good) = totals.sum(), np.maximum(totals, 1e-9)
        b, g = counts
        chi = n * (g * (bad - b) - b * (good - g)) ** 2 / ((g + b) * (n - g - b) * good * bad + 1e-9)
        kept = (chi >= LEAST_CHI_SQUARED) & (g + b >= LEAST_DOCUMENTS)
        smoothed = np.log((g + 0.5) / (good + 1)) - np.log((b + 0.5) / (bad + 1))
        return cls(np.where(kept, smoothed, 0.0), float(np.log(good + 1) - np.log(bad + 1)))

    def raw(self, features: list[np.ndarray]) -> np.ndarray:
        """Log odds of good quality; squashed, since features repeat one another."""
        sizes = np.array([len(f) for f in features])
        flat = np.concatenate([*features, np.zeros(1, np.int32)])
        sums = np.add.reduceat(np.r_[self.weights[flat[:-1]], 0.0], np.r_[0, np.cumsum(sizes)[:-1]]) if len(features) else np.zeros(0)
        return 40 * np.tanh((self.prior + np.where(sizes > 0, sums, 0.0)) / 40)

    def odds(self, features: list[np.ndarray]) -> np.ndarray:
        """Calibrated log odds."""
        return self.slope * self.raw(features) + self.intercept


def logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray, start: np.ndarray, held: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve through counted points, lightly held to the start."""
    beta = start.astype(float)
    n = good + bad
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        grad = x.T @ (n * p - good) + held * (beta - start)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + held * np.eye(len(beta))
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta


@dataclass
class QualityModel:
    """Both views and how they combine; of a fixed size."""

    views: dict[str, View] = field(default_factory=dict)
    mix: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    constant: float | None = None
    rounds: list[dict] = field(default_factory=list)

    def odds(self, text: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds by text, by metadata, and combined."""
        if self.constant is not None:
            same = np.full(len(text), self.constant)
            return same, same, same
        t, m = np.clip(self.views["text"].odds(text), -12, 12), np.clip(self.views["meta"].odds(meta), -12, 12)
        return t, m, self.mix[0] * t + self.mix[1] * m + self.mix[2]

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows of ``featured`` with (c0, c1, ...) carried, and text_score, meta_score and score instead of the features."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in SCORES]))
        def scores(text: pa.Array, meta: pa.Array) -> pa.Array:
            odds = shared.value.odds(_split(text), _split(meta))
            return pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-x)), pa.float64()) for x in odds], names=[*SCORES])

        carried = [c for c in rows.columns if c not in FEATURES]
        found = rows.select(*carried, scores("text", "meta").alias("scores"))
        return found.select(*carried, *(F.col("scores")[c].alias(c) for c in SCORES))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_score, meta_score, score, good) of every row: chances of good quality, good where 0.5 or more.

        Needs doc_id, text, lang, source and n_chars. Null and empty texts have
        the features of an empty text; null metadata are values of their own;
        repeated rows count each.
        """
        return self.verdicts(featured(docs, None, carry=["doc_id"]))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """As ``score``, for rows of ``featured`` that carry doc_id alone."""
        return self.scored(rows).select(
            F.col("c0").alias("doc_id"), *SCORES, (F.col("score") >= 0.5).alias("good"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of good quality, with all their columns."""
        return self.good(featured(docs, None, carry=docs.columns), docs.columns)

    def good(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """As ``keep``, for rows of ``featured`` that carry the named columns."""
        return self.scored(rows).where("score >= 0.5").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def bounded_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(key, label) of at most ``LABELLED`` ids: all, or those of the lowest hashes.

    The lower of several labels of an id counts; other labels than 0 and 1 and
    null ids are left out. ``key`` is the id if a number, else its digest, so
    that the table has a proven size.
    """
    doc_id = quoted("doc_id")
    given = labels.select(_key(doc_id, labels).alias("key"), quoted(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("key").isNotNull()).groupBy("key").agg(F.min("label").alias("label"))
    part = F.pmod(F.xxhash64("key"), F.lit(LABEL_PARTS))
    sizes = dict(given.groupBy(part.alias("part")).count().collect())
    total, limit = 0, 0
    while limit < LABEL_PARTS and total + sizes.get(limit, 0) <= LABELLED:
        total += sizes.get(limit, 0)
        limit += 1
    return given.where(part < limit)


def _key(doc_id: Column, df: DataFrame) -> Column:
    kind = df.select(doc_id).schema[0].dataType
    return doc_id.cast("long") if isinstance(kind, T.IntegralType) else F.md5(doc_id.cast("string").cast("binary"))


def featured(docs: DataFrame, labels: DataFrame | None, label_col: str = "quality", carry: Sequence[str] = ()) -> DataFrame:
    """(label, calibrates, text, meta, c0, c1, ...) of every row: features as arrays, label null if none, carried columns by place."""
    # what is carried never leaves the JVM, where a text would cross into Python and back once more, and is held once
    carried = [f"c{i}" for i in range(len(carry))]
    place = {c: dict(zip(carry, carried)).get(c, c) for c in ("text", "lang", "source", "n_chars")}
    own = docs.select(_key(quoted("doc_id"), docs).alias("key"), (fold(quoted("doc_id"), FOLDS) == 0).alias("calibrates"),
                      *(quoted(c).alias(c) for c, at in place.items() if at == c),
                      *(quoted(c).alias(at) for c, at in zip(carry, carried)))
    if labels is None:
        rows = own.withColumn("label", F.lit(None).cast("int"))
    else:
        rows = own.join(F.broadcast(bounded_labels(labels, label_col)), "key", "left")
    numbers = T.ArrayType(T.IntegerType())

    @F.arrow_udf(T.StructType([T.StructField(view, numbers) for view in VIEWS]))
    def views(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        features = TextFeatures()
        for text, *facts in batches:
            # a few texts at a time exist as Python objects beside their batch
            of_text = [features.of(x) for i in range(0, len(text), TEXTS) for x in as_bytes(text.slice(i, TEXTS))]
            of_meta = [meta_features(*x) for x in zip(*(f.to_pylist() for f in facts))]
            yield pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in (of_text, of_meta)], names=[*VIEWS])

    found = rows.select("label", "calibrates", views(*place.values()).alias("views"), *carried)
    return found.select("label", "calibrates", *(F.col("views")[view].alias(view) for view in VIEWS), *carried)


def _split(column: pa.Array) -> list[np.ndarray]:
    """The feature numbers of each row."""
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy(zero_copy_only=False)[:ends[-1]], ends[1:-1]) if len(column) else []


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """label (-1 if none), calibrates, and both views' features."""
    label = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
    return label, batch.column(1).to_numpy(zero_copy_only=False), _split(batch.column(2)), _split(batch.column(3))


def _sums(rows: DataFrame, make, size: int) -> np.ndarray:
    """Vectors of ``size`` counts, one a task, added up in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                make(total, *_unpacked(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out


def _learn(rows: DataFrame, model: QualityModel | None) -> dict[str, View]:
    """Both views from true labels and, given a model, from the labels the other view is sure of."""
    sizes = {"text": TEXT_FEATURES, "meta": META_FEATURES}
    start = {"text": 0, "meta": 2 * TEXT_FEATURES + 2}
    shared = rows.sparkSession.sparkContext.broadcast(model)
    low, high = np.log(SURE_BAD / (1 - SURE_BAD)), np.log(SURE_GOOD / (1 - SURE_GOOD))

    def make(total, label, calibrates, text, meta):
        known = np.where(calibrates, -1, label)
        labels = {"text": known, "meta": known}
        if shared.value is not None:
            t, m, _ = shared.value.odds(text, meta)
            sure = lambda x: np.where(x >= high, 1, np.where(x <= low, 0, -1))
            free = (label < 0)
            labels = {"text": np.where(free, sure(m), known), "meta": np.where(free, sure(t), known)}
        for view, features in (("text", text), ("meta", meta)):
            for k in (0, 1):
                own = [f for f, y in zip(features, labels[view]) if y == k]
                at = start[view] + k * (sizes[view] + 1)
                total[at + sizes[view]] += len(own)
                if own:
                    total[at:at + sizes[view]] += np.bincount(np.concatenate(own), minlength=sizes[view])

    got = _sums(rows, make, 2 * (TEXT_FEATURES + META_FEATURES) + 4)
    views = {}
    for view in VIEWS:
        part = got[start[view]:start[view] + 2 * (sizes[view] + 1)].reshape(2, -1)
        views[view] = View.learned(part[:, :-1], part[:, -1])
        views[view].totals = part[:, -1].tolist()
    return views


def _calibrate(rows: DataFrame, model: QualityModel) -> None:
    """Curves through the views' scores of the labelled rows of fold 0."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make(total, label, calibrates, text, meta):
        known = calibrates & (label >= 0)
        for k, (view, features) in enumerate((("text", text), ("meta", meta))):
            raw = shared.value.views[view].raw(features)
            at = np.clip(((raw + 40) / 80 * BINS).astype(int), 0, BINS - 1)
            np.add.at(total, (k * 2 + label[known]) * BINS + at[known], 1)

    got = _sums(rows, make, 4 * BINS).reshape(2, 2, BINS)
    middle = (np.arange(BINS) + 0.5) / BINS * 80 - 40
    for k, view in enumerate(VIEWS):
        x = np.stack([middle, np.ones(BINS)], axis=1)
        slope, intercept = logistic(x, got[k, 1], got[k, 0], np.array([0.5, 0.0]))
        model.views[view].slope, model.views[view].intercept = max(0.0, float(slope)), float(intercept)


def _combine(rows: DataFrame, model: QualityModel) -> None:
    """A logistic mix of the calibrated views, over a grid of their scores on the labelled rows of fold 0."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    cell = lambda x: np.clip(((x + 12) / 24 * GRID).astype(int), 0, GRID - 1)

    def make(total, label, calibrates, text, meta):
        known = calibrates & (label >= 0)
        t, m, _ = shared.value.odds(text, meta)
        np.add.at(total, (label[known] * GRID + cell(t)[known]) * GRID + cell(m)[known], 1)

    got = _sums(rows, make, 2 * GRID * GRID).reshape(2, -1)
    t, m = np.divmod(np.arange(GRID * GRID), GRID)
    x = np.stack([*((v + 0.5) / GRID * 24 - 12 for v in (t, m)), np.ones(GRID * GRID)], axis=1)
    model.mix = logistic(x, got[1], got[0], np.array([1.0, 0.0, 0.0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rounds: int = ROUNDS) -> QualityModel:
    """The model from ``labels`` (0 or 1; other labels are left out, the lower of several counts).

    Without labelled rows outside fold 0 every score is 0.5, so all are kept;
    with one class only, every row gets that class.
    """
    return learned(stage(featured(docs, labels, label_col), "quality-rows"), rounds)


def learned(rows: DataFrame, rounds: int = ROUNDS) -> QualityModel:
    """As ``fit``, from staged rows of ``featured``."""
    model = QualityModel()
    taught = rows.where(F.col("label").isNotNull() & ~F.col("calibrates"))
    n = {r.label: r.n for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        model.constant = 0.0 if not n else 12.0 if 1 in n else -12.0
        return model
    rows = rows.select(*FEATURES)
    for number in range(rounds + 1):
        model.views = _learn(rows, model if number else None)
        model.rounds.append({view: model.views[view].totals for view in VIEWS})
        _calibrate(rows, model)
    _combine(rows, model)
    return model


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of good quality by a model from ``labels``; texts are read once, and staged beside their features."""
    rows = stage(featured(docs, labels, carry=docs.columns), "quality-rows")
    return learned(rows).good(rows, docs.columns)


def held_out(doc_id: Column) -> Column:
    """Rows no view learns from."""
    return fold(doc_id, FOLDS) == 0


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, scored."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = stage(featured(docs, labels, carry=["doc_id"]), "quality-rows")
    scored = learned(rows).verdicts(rows)
    return scored.withColumnRenamed("good", "kept").withColumn("held_out", held_out(F.col("doc_id")))
