import zlib

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from facsimile.llm import toxicity


def auc(pairs):
    """Chance that a toxic document scores above a clean one."""
    toxic, clean = ([s for s, y in pairs if y == k] for k in (1, 0))
    return np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])


def test_held_out_accuracy(spark):
    import os

    sf_dir = os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").rstrip("/")) + "/sf0.1"
    if not os.path.isdir(sf_dir):
        sf_dir = os.path.dirname(sf_dir) + "/sf0.01"
    rows = {r.doc_id: r for r in toxicity.query(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert auc(held) > 0.95
    right = np.mean([(s >= 0.5) == y for s, y in held])
    assert right > 0.96
    learned = {n.doc_id for r in rows.values() for n in r.neighbours}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in learned)


def test_neighbours_are_exact():
    draw = np.random.default_rng(8)
    n_terms, vectors, labels = 40, [], draw.integers(0, 2, 700)
    for _ in range(700):
        t = np.sort(draw.choice(n_terms, draw.integers(1, 6), replace=False))
        w = draw.integers(1, 4, len(t)).astype(np.float32)
        vectors.append((t, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(list(range(700)), labels, vectors, n_terms)
    dense = np.zeros((700, n_terms))
    for at, i in enumerate(index.ids):
        dense[at, vectors[i][0]] = vectors[i][1]
    for t, w in vectors[:200]:
        exact = dense[:, t] @ w
        at, cosines = index.nearest(t, w, 10)
        assert np.allclose(np.sort(exact)[::-1][:10], cosines, atol=1e-5)
        assert np.allclose(exact[at], cosines, atol=1e-5)


def labelled(spark, texts, labels):
    docs = documents(spark, texts, score="clash", toxic="clash", label="clash")
    return docs, spark.createDataFrame([(i, y) for i, y in enumerate(labels) if y != -1], "doc_id long, toxic int")


def test_edges(spark):
    texts = [f"vile awful w{i}" for i in range(30)] + [f"kind calm w{i}" for i in range(60)] + [
        None, "", "vile " * 100_000, "nothing known", "kind", "vile"]
    docs, labels = labelled(spark, texts, [1] * 30 + [0] * 60 + [-1, -1, -1, -1, None, 7])
    got = {r.doc_id: r for r in toxicity.fit(docs, labels).score(docs).collect()}
    assert len(got) == len(texts)
    assert got[92].predicted == got[0].predicted == got[95].predicted == 1 and got[94].predicted == got[40].predicted == 0
    assert got[90].score == got[91].score == got[93].score and not got[90].neighbours
    assert len(got[92].neighbours) == 16 and all(n.label for n in got[92].neighbours)
    again = toxicity.fit(docs.unionByName(docs), labels.unionAll(labels)).score(docs.where(F.col("doc_id") == 0)).first()
    assert again.predicted == 1


def test_without_labels(spark):
    docs, labels = labelled(spark, ["a", None], [1, 1])
    assert [r.score for r in toxicity.fit(docs, labels.where("toxic = 0")).score(docs).collect()] == [0, 0]
    assert [r.score for r in toxicity.fit(docs, labels).score(docs).collect()] == [1, 1]
    assert toxicity.fit(docs, labels).score(documents(spark, [])).count() == 0
