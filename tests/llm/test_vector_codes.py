import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import types as T

from facsimile.llm import vector_codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType())])


def plain(rows, rounds=6):
    """The rounds in whole numbers, one vector after another."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 8))
    whole = [[math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    parts = [[tuple(w[p * width:(p + 1) * width]) for w in whole] for p in range(8)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    codes, books = [], []
    for points in parts:
        book = [points[i] for i in first]

        def near(x):
            return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e])), e))

        for _ in range(rounds):
            of = defaultdict(list)
            for x in points:
                of[near(x)].append(x)
            for e, mine in of.items():
                book[e] = tuple(sum(c) // len(mine) for c in zip(*mine))
        codes.append([near(x) for x in points])
        books.append(book)
    errors = [sum(sum((a - b) ** 2 for a, b in zip(parts[p][i], books[p][codes[p][i]])) for p in range(8))
              for i in range(len(kept))]
    per_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        per_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(repr, ((r[0], "".join(f"{codes[p][i]:02x}" for p in range(8)), errors[i], per_label[r[2]], digest)
                             for i, r in enumerate(kept))))


def result(spark, rows, **clash):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    for name, value in clash.items():
        table = table.withColumn(name, F.lit(value))
    coded, books = vector_codes.compress(table)
    full = vector_codes.with_label_errors(coded)
    digest = vector_codes.codebook_digest(books)
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, digest)) for r in full.collect())


def test_against_sql(spark, sf_dir):
    same_rows(vector_codes.query(spark, sf_dir), sf_dir, vector_codes.oracle())


def test_edges(spark):
    rows = [(5, None, 1), (6, [1.0, None] * 8, 1), (7, [float("nan")] * 16, 1), (8, [float("inf")] * 16, 2),
            (1, [0.5] * 16, None), (1, [0.5] * 16, None), (1, [0.25] * 16, 3), (None, [-0.3] * 16, 3),
            (2, [], 4), (3, [0.1] * 5, 4), (4, [-1e-9, 0.1, -0.1] * 5, None)]
    assert result(spark, rows, of="clash", label_error="clash", v="clash") == plain(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None, None)]) == []


@pytest.mark.parametrize("scale", [1.0, 1e-4, 3e5, 1e30])
def test_many_blocks(spark, monkeypatch, scale):
    """Clusters, ties and repeats over many small trees; sizes beyond 64-bit arithmetic too."""
    monkeypatch.setattr(vector_codes, "BLOCK", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 24))
    points = [centres[i % 9] + 0.05 * rng.normal(size=24) for i in range(300)]
    points += [np.round(p, 1) for p in points[:100]] + points[:50]
    rows = [(i, (scale * p).tolist(), i % 5) for i, p in enumerate(points)]
    rows += [(900 + i, [1e17] * 24, 7) for i in range(3)] if scale == 1e30 else []
    got, expected = result(spark, rows), plain(rows)
    if scale == 1e30:  # errors pass 64 bits and are cut there
        assert [eval(x)[:2] + eval(x)[4:] for x in got] == [eval(x)[:2] + eval(x)[4:] for x in expected]
    else:
        assert got == expected


def test_trees_cover():
    """Every node holds its points within its radius, children part them, and whole subtrees are assigned."""
    rng = np.random.default_rng(1)
    points = np.floor(4096 * (rng.integers(0, 4, (600, 1)) + 0.01 * rng.normal(size=(600, 8)))).astype(np.int64)
    tree = vector_codes.CoverTree.build(points)
    assert (points[tree.order] == tree.points).all()
    for (low, high, centre, child, n), radius, total in zip(tree.nodes, tree.radii, tree.sums):
        far = np.sqrt(((tree.points[low:high] - tree.points[centre]) ** 2).sum(axis=1))
        assert far.max() <= radius and (tree.points[low:high].sum(axis=0) == total).all()
        if n:
            below = tree.nodes[child:child + n]
            assert below[0, 0] == low and below[-1, 1] == high and (below[1:, 0] == below[:-1, 1]).all()
    entries = np.full((4, 8), 4096) * np.arange(4)[:, None]
    seen = []
    exact = vector_codes._square
    vector_codes._square = lambda p, e: seen.append(len(p)) or exact(p, e)
    try:
        nearest, counts, sums = tree.assign(entries)
    finally:
        vector_codes._square = exact
    assert sum(seen) < 100 and counts.sum() == 600 and (sums.sum(axis=0) == points.sum(axis=0)).all()
    assert (nearest == exact(tree.points, entries).argmin(axis=1)).all()
