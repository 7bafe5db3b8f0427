"""Product codes for vectors by Lloyd rounds over partition-local cover trees.

Components become integers, floor(``SCALE`` x), and all arithmetic is on
integers, so every figure is exact and does not depend on how rows are split.
Vectors are cut into equal parts; each part position has a codebook of its own.

Rows are taken in blocks, and a block gives one cover tree per part position: a
node has a centre (a point), the radius of its subtree, and the count and sum of
the points below it; children's centres lie farther apart than the radius that
children may cover, which shrinks from level to level. Trees are written once.
A round walks them with the present entries: where the nearest entry is nearer
to a node's centre than every other by more than twice the radius, the triangle
inequality gives the whole subtree to it, and its sum and count are added at
once; entries that cannot be nearest for any point below are left out, and only
what stays ambiguous descends, down to exact comparisons of single points.
What leaves a task is one sum per entry and component.

Vectors that are null or hold null or non-finite components are dropped.
Shorter vectors, and lengths that the number of parts does not divide, are
filled up with zeros behind. Ties go to the lower entry. The first codebooks
are those of the smallest ids, null ids last and repeated ids by their vectors;
with fewer vectors than entries the codebooks are that much smaller. Repeated
rows and null ids give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.llm.common import quoted
from facsimile.sources.staging import stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors of one block, that is points of one tree.
BLOCK = 4096
#: A node of so few points has no children.
LEAF = 8
#: What children may cover, of what their parent may.
SHRINK = 0.6
_LONG = (1 << 63) - 1


# --- cover trees ---------------------------------------------------------------------

def _fits(largest: int, width: int) -> bool:
    """Whether squared distances and sums of a block stay within 64 bits."""
    return width * (2 * largest + 2) ** 2 < 1 << 62 and largest * BLOCK < 1 << 62


def _square(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per point and a column per entry."""
    total = 0
    for j in range(points.shape[1]):
        apart = points[:, j, None] - entries[None, :, j]
        total = total + apart * apart
    return total


class CoverTree:
    """Points in the tree's order, so that every subtree is a run of them."""

    FIELDS = ("order", "points", "nodes", "radii", "sums")

    def __init__(self, order, points, nodes, radii, sums):
        #: ``nodes``: first point, end, centre, first child, number of children
        self.order, self.points, self.nodes, self.radii, self.sums = order, points, nodes, radii, sums

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        """Level by level from the top; a centre stays the centre of its first child."""
        n = len(points)
        order, nodes, radii = np.arange(n), [], []
        apart = lambda among, at: np.sqrt(((points[among] - points[at]) ** 2).sum(axis=1).astype(float))
        far = apart(order, 0) if n else np.empty(0)
        waiting = [(0, n, far, float(far.max(initial=0.0)))] if n else []  # a run, distances from its first point, what it may cover
        nodes.append([0, n, 0, 0, 0])
        radii.append(float(far.max(initial=0.0)))
        at = 0
        while at < len(waiting):
            low, high, far, cover = waiting[at]
            if high - low > LEAF and radii[at] > 0:
                cover = min(cover, radii[at]) * SHRINK
                rest, child = order[low:high].copy(), low
                nodes[at][3] = len(nodes)
                while len(rest):
                    near = far <= cover
                    mine = rest[near]
                    order[child:child + len(mine)] = mine
                    nodes.append([child, child + len(mine), child, 0, 0])
                    radii.append(float(far[near].max()))
                    waiting.append((child, child + len(mine), far[near], cover))
                    child += len(mine)
                    rest = rest[~near]
                    far = apart(rest, rest[0]) if len(rest) else far
                nodes[at][4] = len(nodes) - nodes[at][3]
            at += 1
        nodes = np.array(nodes, np.int32).reshape(-1, 5)
        points = points[order]
        before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        return cls(order.astype(np.int32), points, nodes, np.array(radii), before[nodes[:, 1]] - before[nodes[:, 0]])

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per point (in the tree's order) its nearest entry, and every entry's count and sum."""
        k = len(entries)
        nearest = np.zeros(len(self.points), np.int64)
        counts, sums = np.zeros(k, np.int64), np.zeros(entries.shape, np.int64)
        if not len(self.points):
            return nearest, counts, sums
        # an entry equal to a lower one never wins
        possible = np.array([[not any((entries[j] == entries[i]).all() for i in range(j)) for j in range(k)]])
        front, alone = np.zeros(1, np.int64), [np.empty(0, np.int64)]
        while len(front):
            centres, radius = self.points[self.nodes[front, 2]], self.radii[front, None]
            far = np.where(possible, np.sqrt(_square(centres, entries).astype(float)), np.inf)
            least = far.min(axis=1, keepdims=True)
            # the margin covers the rounding of roots, so what is left out is truly farther
            possible = far - least <= 2 * radius + 1e-9 * (least + radius + 1)
            sure = possible.sum(axis=1) == 1
            won = possible[sure].argmax(axis=1)
            whole = self.nodes[front[sure]]
            np.add.at(counts, won, whole[:, 1] - whole[:, 0])
            np.add.at(sums, won, self.sums[front[sure]])
            nearest[_runs(whole[:, 0], whole[:, 1])] = np.repeat(won, whole[:, 1] - whole[:, 0])
            open_, possible = front[~sure], possible[~sure]
            children = self.nodes[open_, 4]
            leaves = self.nodes[open_[children == 0]]
            alone.append(_runs(leaves[:, 0], leaves[:, 1]))
            first = self.nodes[open_, 3]
            front = _runs(first, first + children)
            possible = np.repeat(possible, children, axis=0)
        alone = np.concatenate(alone)
        if len(alone):
            nearest[alone] = won = _square(self.points[alone], entries).argmin(axis=1)  # the first of equal ones
            np.add.at(counts, won, 1)
            np.add.at(sums, won, self.points[alone])
        return nearest, counts, sums

    def blobs(self) -> list[bytes]:
        small = self.points if self.points.dtype == object else self.points.astype(np.int32)
        return [self.order.tobytes(), small.tobytes(), self.nodes.tobytes(), self.radii.tobytes(), self.sums.tobytes()]

    @classmethod
    def read(cls, blobs: list[bytes], width: int) -> CoverTree:
        order, points, nodes, radii, sums = blobs
        return cls(np.frombuffer(order, np.int32), np.frombuffer(points, np.int32).astype(np.int64).reshape(-1, width),
                   np.frombuffer(nodes, np.int32).reshape(-1, 5), np.frombuffer(radii),
                   np.frombuffer(sums, np.int64).reshape(-1, width))


class Wide:
    """Points too large for 64-bit arithmetic: whole numbers without a bound, every one compared."""

    def __init__(self, points: np.ndarray):
        self.order, self.points = np.arange(len(points)), points

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entries = entries.astype(object)
        nearest = _square(self.points, entries).argmin(axis=1).astype(np.int64)
        counts, sums = np.bincount(nearest, minlength=len(entries)), np.zeros(entries.shape, object)
        np.add.at(sums, nearest, self.points)
        return nearest, counts, sums

    def blobs(self) -> list[bytes]:
        # each is the floor of a double and so a double itself
        return [self.points.astype(float).tobytes()]

    @classmethod
    def read(cls, blobs: list[bytes], width: int) -> Wide:
        return cls(_whole(np.frombuffer(blobs[0])).reshape(-1, width))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    sizes = (ends - starts).astype(np.int64)
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def _tree(blobs: list[bytes], width: int) -> CoverTree | Wide:
    return (Wide if len(blobs) == 1 else CoverTree).read(blobs, width)


def _entries(codebook: list[tuple[int, ...]], width: int) -> np.ndarray:
    largest = max((abs(x) for e in codebook for x in e), default=0)
    if _fits(largest, width):
        return np.array(codebook, np.int64).reshape(-1, width)
    return np.array(codebook, object).reshape(-1, width)


# --- jobs ----------------------------------------------------------------------------------

def kept_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): vectors without null or non-finite components, as doubles."""
    rows = table.select(quoted(id_col).alias("vec_id"), quoted(label_col).alias("label"),
                        quoted(vec_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & good)


def grow_trees(kept: DataFrame, width: int) -> DataFrame:
    """(vec_ids, labels, trees): a row per block, with one tree per part position."""
    ids, labels, most = kept.schema["vec_id"].dataType, kept.schema["label"].dataType, BLOCK
    schema = T.StructType([T.StructField("vec_ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)),
                           T.StructField("trees", T.ArrayType(T.ArrayType(T.BinaryType())))])

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        lists = table.column(2).combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.zeros((len(sizes), PARTS * width))
        points[np.repeat(np.arange(len(sizes)), sizes), _runs(np.zeros(len(sizes), np.int64), sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
        points = np.floor(SCALE * points)
        trees = []
        for p in range(PARTS):
            part = points[:, p * width:(p + 1) * width]
            plain = _fits(int(np.abs(part).max(initial=0.0)), width) and np.abs(part).max(initial=0.0) < 1 << 31
            trees.append((CoverTree.build(part.astype(np.int64)) if plain else Wide(_whole(part))).blobs())
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), column.combine_chunks())
        return pa.RecordBatch.from_arrays(
            [one(table.column(0)), one(table.column(1)), pa.array([trees], pa.list_(pa.list_(pa.binary())))],
            names=["vec_ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= most:
                waiting.append(batch.slice(0, most - n))
                batch = batch.slice(most - n)
                yield block(waiting)
                waiting, n = [], 0
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
        if n:
            yield block(waiting)

    return kept.mapInArrow(run, schema)


def _round_sums(trees: DataFrame, books: list[list[tuple[int, ...]]], width: int) -> DataFrame:
    """(part, entry, place, n, total): counts and sums of what each entry is nearest to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_entries(book, width) for book in books]
        counts = [np.zeros(len(e), np.int64) for e in entries]
        sums = [np.zeros(e.shape, object) for e in entries]  # whole numbers without a bound
        for batch in batches:
            for block in batch.column(0):
                for p, blobs in enumerate(block.as_py()):
                    _, n, total = _tree(blobs, width).assign(entries[p])
                    counts[p] += n
                    sums[p] += total
        rows = [(p, e, j, int(counts[p][e]), Decimal(int(sums[p][e, j])))
                for p in range(PARTS) for e in np.flatnonzero(counts[p]).tolist() for j in range(width)]
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["part", "entry", "place", "n", "total"])

    sums = trees.select("trees").mapInArrow(run, "part int, entry int, place int, n long, total decimal(38,0)")
    return sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _coded(trees: DataFrame, books: list[list[tuple[int, ...]]], width: int) -> DataFrame:
    """(vec_id, label, code, error) of every vector under the final codebooks."""
    ids, labels = (trees.schema[c].dataType.elementType for c in ("vec_ids", "labels"))
    schema = T.StructType([T.StructField("vec_id", ids), T.StructField("label", labels),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_entries(book, width) for book in books]
        for batch in batches:
            for i in range(batch.num_rows):
                owners = batch.column(0)[i].values
                codes, errors = np.zeros((len(owners), PARTS), np.uint8), 0
                for p, blobs in enumerate(batch.column(2)[i].as_py()):
                    tree = _tree(blobs, width)
                    nearest, _, _ = tree.assign(entries[p])
                    codes[tree.order, p] = nearest
                    apart = (tree.points - entries[p][nearest]).astype(object if isinstance(tree, Wide) else np.int64)
                    error = np.zeros(len(owners), apart.dtype)
                    error[tree.order] = (apart * apart).sum(axis=1)
                    errors = errors + error.astype(object)
                digits = codes.tobytes().hex()
                step = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [owners, batch.column(1)[i].values,
                     pa.array([digits[at:at + step] for at in range(0, len(digits), step)], pa.string()),
                     pa.array([min(int(x), _LONG) for x in errors], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, schema)


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             rounds: int = ROUNDS) -> tuple[DataFrame, list[list[tuple[int, ...]]]]:
    """Codes of all kept vectors, and the final codebooks by part and entry.

    The rows are (vec_id, label, code, error): hex entry numbers by part, and
    the squared distances summed over parts (2^63 - 1 if larger).
    """
    kept = kept_vectors(table, id_col, vec_col, label_col)
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // PARTS))
    smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    firsts = [[int(x) for x in np.floor(SCALE * np.array(r.v, float))] + [0] * (PARTS * width - len(r.v)) for r in smallest]
    books = [[tuple(v[p * width:(p + 1) * width]) for v in firsts] for p in range(PARTS)]
    trees = stage(grow_trees(kept, width), "cover_trees")
    for _ in range(rounds):
        books = [list(book) for book in books]
        sums: dict = {}
        for r in _round_sums(trees, books, width).collect():  # at most a row per entry and component
            sums.setdefault((r.part, r.entry), {})[r.place] = int(r.total) // r.n
        for (part, entry), means in sums.items():
            books[part][entry] = tuple(means[j] for j in range(width))
    return _coded(trees, books, width), books


def codebook_digest(books: list[list[tuple[int, ...]]]) -> str:
    """SHA-256 of all components in order, decimal, with commas between them."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together."""
    coded = stage(coded, "vector_codes")
    per_label = coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONG))).cast("long").alias("label_error"))
    return coded.join(per_label, coded.label.eqNullSafe(per_label.of)).drop("of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, coded in eight parts of sixteen entries after six rounds."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rounds by SQL: every part against every entry."""
    rounds = "".join(f"""
    near{i} AS MATERIALIZED (
        SELECT v, label, p, x, entry, d, e FROM (
            SELECT parts.v, parts.label, parts.p, parts.x, b.entry, b.e,
                   list_sum(list_transform(list_zip(parts.x, b.e), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS d,
                   row_number() OVER (PARTITION BY parts.v, parts.p ORDER BY d, b.entry) AS place
            FROM parts JOIN book{i} b ON b.p = parts.p) WHERE place = 1),"""
                     + (f"""
    means{i} AS MATERIALIZED (
        SELECT p, entry, list(CAST(floor_sum AS BIGINT) ORDER BY j) AS e FROM (
            SELECT p, entry, j, (sum(xj) - ((sum(xj) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
            FROM (SELECT p, entry, unnest(x) AS xj, unnest(range(len(x))) AS j FROM near{i}) GROUP BY p, entry, j)
        GROUP BY p, entry),
    book{i + 1} AS MATERIALIZED (
        SELECT b.p, b.entry, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN means{i} m ON m.p = b.p AND m.entry = b.entry),"""
                        if i < ROUNDS else "") for i in range(ROUNDS + 1))
    return f"""WITH kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x,
               row_number() OVER (ORDER BY vec_id, embedding) AS v
        FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (
        SELECT v, label, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS x
        FROM kept, (SELECT unnest(range({PARTS})) AS p)),
    book0 AS MATERIALIZED (SELECT p, v - 1 AS entry, x AS e FROM parts WHERE v <= {ENTRIES}),{rounds}
    coded AS MATERIALIZED (
        SELECT v, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code,
               CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY v),
    digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) AS s FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY coded.label) AS BIGINT) AS label_error,
       (SELECT s FROM digest) AS codebooks_sha256
FROM coded JOIN kept USING (v)"""
