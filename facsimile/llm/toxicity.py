"""Toxicity by the votes of the nearest labelled examples.

Neighbours are exact: the k labelled examples of highest TF-IDF cosine, found
in a block-max inverted index. The index holds the examples in blocks of 64;
every term keeps, for each block it occurs in, one lane of weights and their
maximum. A query first bounds every block by its maxima, then opens blocks from
the highest bound down until no unopened block can hold a better neighbour.

Only the examples are bounded: at most ``PER_CLASS`` labelled documents of each
class, those with the smallest hashes of their ids, become examples, so the
index (at most ``TERMS`` terms) has a fixed size and is broadcast. Term
statistics for the weights are counted over all documents, and all documents
are scored in one pass without a shuffle.

Terms are words and their 4 to 6 byte beginnings (inflected words share them),
kept where a chi-squared test on the examples ties them to the label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import as_bytes, fold, quoted, text_rows

PER_CLASS = 6000
TERMS = 512
#: A term needs this many examples, and this chi-squared (1 degree of freedom, p < 1e-7).
LEAST_EXAMPLES = 8
LEAST_CHI_SQUARED = 28.4
NEIGHBOURS = 16
LANES = 64
WAVE = 8
FOLDS = 5

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return data.lower().translate(_WORD_BYTES).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked as such."""
    return [word, *(word[:n] + b"~" for n in (4, 5, 6) if len(word) >= n)]


class TermFinder(dict):
    """Indexes of a word's chosen terms; bounded, since a full table starts anew."""

    LIMIT = 1 << 20

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.index = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        return value

    def counts(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Chosen terms of a text, ascending, and how often each occurs."""
        found = [i for x in map(self.__getitem__, words_of(data)) if x for i in x]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        terms, n = np.unique(np.array(found), return_counts=True)
        return terms, n.astype(np.float32)


class BlockMaxIndex:
    """Unit vectors of labelled examples, searched exactly by cosine."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # alike vectors share blocks, which keeps the maxima tight
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), labels[i], str(ids[i])))
        self.ids = [ids[i] for i in order]
        self.labels = labels[order].astype(np.float32)
        self.blocks = -(-len(ids) // LANES)
        self.rows = np.zeros((n_terms, self.blocks), np.int32)
        lanes = [np.zeros(LANES, np.float32)]
        for at, i in enumerate(order):
            block, lane = divmod(at, LANES)
            for term, weight in zip(*vectors[i]):
                if not self.rows[term, block]:
                    self.rows[term, block] = len(lanes)
                    lanes.append(np.zeros(LANES, np.float32))
                lanes[self.rows[term, block]][lane] = weight
        self.lanes = np.array(lanes)
        self.maxima = self.lanes.max(axis=1)[self.rows]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term; ties go to the lower place."""
        bounds = weights @ self.maxima[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rows = self.rows[terms]
        best_at, best = np.empty(0, np.int64), np.empty(0, np.float32)
        for i in range(0, len(order), WAVE):
            if len(best) == k and bounds[order[i]] < best[-1] - 1e-5:
                break
            wave = order[i:i + WAVE]
            scores = np.tensordot(weights, self.lanes[rows[:, wave]], 1).ravel()
            at = (wave[:, None] * LANES + np.arange(LANES)).ravel()
            keep = (scores > 0) & (at != but)
            best, best_at = np.concatenate([best, scores[keep]]), np.concatenate([best_at, at[keep]])
            top = np.lexsort((best_at, -best))[:k]
            best, best_at = best[top], best_at[top]
        return best_at, best


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf[terms]
    return (weights / np.sqrt(weights @ weights)).astype(np.float32)


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """Share of the toxic votes; a neighbour's vote weighs its cosine squared."""
    weights = cosines.astype(float) ** 2
    return float(weights @ labels / weights.sum()) if len(cosines) else 0.0


def platt(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve through the votes, lightly held to slope 8."""
    beta = np.array([8.0, -4.0])
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (weights * (p - labels)) + 1e-2 * (beta - [8.0, -4.0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by PER_CLASS and TERMS."""

    prior: float = 0.0
    silent: float = 0.0
    terms: list[bytes] = field(default_factory=list)
    idf: np.ndarray | None = None
    index: BlockMaxIndex | None = None
    slope: float = 0.0
    intercept: float = 0.0

    def one(self, finder: TermFinder, data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """Score, and places and cosines of the neighbours."""
        none = np.empty(0, np.int64), np.empty(0, np.float32)
        if self.index is None:
            return self.prior, *none
        terms, counts = finder.counts(data)
        if not len(terms):
            return self.silent, *none
        at, cosines = self.index.nearest(terms, unit(terms, counts, self.idf), NEIGHBOURS)
        if not len(at):
            return self.silent, *none
        x = self.slope * vote(self.index.labels[at], cosines) + self.intercept
        return float(1 / (1 + np.exp(-x))), at, cosines

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score, predicted, neighbours) of every row; neighbours is the evidence, nearest first.

        Null and empty texts, and texts without any chosen term, have no
        neighbours and get the share of toxic examples among such texts.
        """
        rows = text_rows(docs, id_col, text_col)
        id_type = rows.schema["doc_id"].dataType.simpleString()
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            finder = TermFinder(model.terms)
            for batch in batches:
                found = [model.one(finder, x) for x in as_bytes(batch.column(1))]
                scores = [x[0] for x in found]
                evidence = [[{"doc_id": model.index.ids[i], "label": int(model.index.labels[i]), "cosine": float(c)}
                             for i, c in zip(at, cosines)] for _, at, cosines in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(evidence, pa.list_(pa.struct([
                        ("doc_id", batch.column(0).type), ("label", pa.int32()), ("cosine", pa.float64())])))],
                    names=["doc_id", "score", "predicted", "neighbours"])

        return rows.mapInArrow(run, f"doc_id {id_type}, score double, predicted int, "
                                    f"neighbours array<struct<doc_id:{id_type},label:int,cosine:double>>")


def _chosen_terms(examples: DataFrame, totals: tuple[int, int]) -> list[bytes]:
    """Terms tied to the label: counted in Spark, at most TERMS of them fetched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flushed():
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)],
                names=["term", "clean", "toxic"])
            for c in counts:
                c.clear()

        for batch in batches:
            for data, label in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                counts[label].update({t for w in set(words_of(data)) for t in terms_of(w)})
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from flushed()
        yield from flushed()

    a, b = F.col("toxic"), F.col("clean")
    n, c, d = sum(totals), totals[1] - a, totals[0] - b
    chi = n * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * (c + d) * totals[0] * totals[1] + 1e-9)
    counted = examples.mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
    rows = (counted.where(a + b >= LEAST_EXAMPLES).select("term", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI_SQUARED)
            .orderBy(F.desc("chi"), "term").limit(TERMS).collect())
    return [bytes(r.term) for r in rows]


def _document_counts(rows: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each chosen term occurs, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, counts = TermFinder(terms), np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            for data in as_bytes(batch.column(1)):
                counts[finder.counts(data)[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["term", "n"])

    counted = rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(terms) + 1)
    for r in counted:
        n[r.term] = r.n
    return n[:-1], int(n[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "toxic") -> ToxicityModel:
    """The model from the labelled rows given (0 or 1; other labels are left out, the higher of several counts).

    Without labelled rows every score is 0; with labels of one class only,
    every score is that class.
    """
    rows = text_rows(docs, id_col, text_col)
    given = labels.select(quoted(label_id_col).alias("doc_id"), quoted(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r.label: r.n for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ToxicityModel(prior=shares.get(1, 0) / max(1, sum(shares.values())))
    if len(shares) < 2:
        return model
    chosen = None
    for label in (0, 1):
        part = given.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most 2 * per_class ids
    listed = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    examples = rows.join(F.broadcast(listed), "doc_id").select("doc_id", "text", "label")
    totals = {r.label: r.n for r in listed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model.terms = _chosen_terms(examples, (totals[0], totals[1]))
    if not model.terms:
        return model
    df, n = _document_counts(rows, model.terms)
    model.idf = (1 + np.log((n + 1) / (df + 1))).astype(np.float32)
    terms = model.terms

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(terms)
        for batch in batches:
            found = [finder.counts(x) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(batch.column(2).to_pylist(), pa.int32()),
                 pa.array([t.tolist() for t, _ in found], pa.list_(pa.int64())),
                 pa.array([c.tolist() for _, c in found], pa.list_(pa.float32()))],
                names=["doc_id", "label", "terms", "counts"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    # bounded: 2 * per_class rows of at most TERMS entries (a repeated row of an example counts once)
    got = (examples.mapInArrow(vectors, f"doc_id {id_type}, label int, terms array<long>, counts array<float>")
           .dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    weight = {k: shares[k] / totals[k] for k in (0, 1)}
    mute = [r.label for r in got if not r.terms]
    silent = sum(weight[x] for x in mute if x), sum(weight[x] for x in mute)
    model.silent = (silent[0] + model.prior) / (silent[1] + 1)
    heard = [r for r in got if r.terms]
    if not heard:
        return model
    vectors_ = [(t := np.array(r.terms), unit(t, np.array(r.counts, np.float32), model.idf)) for r in heard]
    model.index = BlockMaxIndex([r.doc_id for r in heard], np.array([r.label for r in heard]), vectors_, len(terms))
    # calibration: every example's vote without itself, weighted back to the classes' shares
    by_id = {r.doc_id: v for r, v in zip(heard, vectors_)}
    votes = []
    for at, i in enumerate(model.index.ids):
        found, cosines = model.index.nearest(*by_id[i], NEIGHBOURS, but=at)
        votes.append(vote(model.index.labels[found], cosines))
    own = model.index.labels
    model.slope, model.intercept = platt(np.array(votes), own, np.array([weight[int(x)] for x in own]))
    return model


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by examples outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    scored = fit(docs, labels.where(~held_out)).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours")
