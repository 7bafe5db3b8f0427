import os

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from facsimile.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    root = os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").rstrip("/"))
    sf_dir = f"{root}/sf0.1" if os.path.isdir(f"{root}/sf0.1") else f"{root}/sf0.01"
    rows = {r.doc_id: r for r in qc.query(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
            if rows[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in rows.values())
    assert np.mean([r.kept == bool(y) for r, y in held]) > 0.95
    assert np.mean([r.kept for r, y in held if y]) > 0.98  # good documents stay
    # calibrated: the mean score is near the share of good documents
    assert abs(np.mean([r.score for r, _ in held]) - np.mean([y for _, y in held])) < 0.05


def labelled(spark, n=240):
    texts = [f"calm words number {i} here" if i % 3 else f"BAD!!! BAD!!! {i}$$$ JUNK###" for i in range(n)]
    docs = documents(spark, texts, scores="clash", label="clash", good="clash").withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "spam").otherwise("books"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, n, 2)], "doc_id long, quality int")
    return docs, labels


def test_views_teach_each_other(spark):
    docs, labels = labelled(spark)
    model = qc.fit(docs, labels)
    first, last = model.rounds[0], model.rounds[-1]
    assert len(model.rounds) == qc.ROUNDS + 1
    assert sum(last["text"]) > sum(first["text"])  # labels passed on by the metadata view
    got = {r.doc_id: r for r in model.score(docs).collect()}
    assert all(got[i].good == bool(i % 3) for i in range(240))
    kept = model.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(240) if i % 3]


def test_labels_are_a_bounded_sample(spark, monkeypatch):
    docs, labels = labelled(spark)
    assert qc.bounded_labels(labels.unionAll(labels), "quality").count() == 120
    monkeypatch.setattr(qc, "LABELLED", 50)
    few = qc.bounded_labels(labels, "quality").count()
    assert 40 <= few <= 50
    kept = qc.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(240) if i % 3]
    # ids that are texts have a key of fixed size
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    taught = qc.featured(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), named)
    assert taught.where("label is not null").count() == few


def test_carried_columns_stay_in_the_jvm(spark):
    docs, labels = labelled(spark)
    rows = qc.featured(docs, labels, carry=docs.columns)
    kept = qc.learned(rows.persist()).good(rows, docs.columns)
    for frame in (qc.featured(docs, labels, carry=docs.columns), kept):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    rows.unpersist()
    # a carried column of another spelling, and rows without some of the columns
    odd = docs.withColumnRenamed("text", "TEXT")
    assert sorted(r.TEXT for r in qc.keep_good(odd, labels).collect()) == sorted(r.text for r in kept.collect())
    few = qc.featured(docs, labels, carry=["doc_id", "source"])
    assert few.columns == [*qc.FEATURES, "c0", "c1"] and few.count() == 240


def test_edges(spark):
    docs, labels = labelled(spark)
    odd = documents(spark, [None, "", "calm words number", "BAD!!! " * 200_000, "x", "x"], ids=[1000, None, 1, 3, 7, 7])
    odd = odd.withColumn("lang", F.lit(None).cast("string")).withColumn(
        "n_chars", F.when(F.col("doc_id") == 7, -1).otherwise(F.col("n_chars")))
    model = qc.fit(docs.select(*(f"`{c}`" for c in odd.columns)).unionAll(odd), labels)
    got = model.score(odd).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert model.score(documents(spark, [])).count() == 0
    none = qc.fit(odd, labels.where("false"))
    assert {r.score for r in none.score(odd).collect()} == {0.5} and none.keep(odd).count() == 6
    assert not qc.fit(docs, labels.where("quality = 0")).keep(docs).count()
    assert qc.fit(documents(spark, []), labels).constant == 0.0


def test_shape():
    assert [qc.shape(w) for w in (b"Hello,", b"ABC!!", "é12x".encode(), b"")] == [b"Aa,", b"A!", b"a0a", b""]
