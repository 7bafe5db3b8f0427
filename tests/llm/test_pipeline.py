"""Every stage of the pipeline against a plain version, on the driver's table."""

import os
import sys

import numpy as np
import test_decontamination
import test_jaccard_join
import test_packing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from facsimile.llm import decontamination, packing, suffix_dedup  # noqa: E402
from facsimile.llm.common import WordHashes  # noqa: E402


def cut_in_the_plain_way(texts, width=suffix_dedup.WIDTH):
    first = {}
    raws = {i: t.encode() for i, t in texts.items()}
    for i in sorted(raws):
        for s in range(len(raws[i]) - width + 1):
            first.setdefault(raws[i][s:s + width], (i, s))
    out = {}
    for i, raw in raws.items():
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if first[raw[s:s + width]] < (i, s):
                gone[s:s + width] = True
        kept, at = [], 0
        for c in texts[i]:  # a character goes if all its bytes do
            n = len(c.encode())
            if not gone[at:at + n].all():
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_stages(spark, sf_dir, tmp_path):
    read = lambda df: {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = read(docs)
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            texts = {i: r.text for i, r in before.items()}
            padding, tokens = test_packing.checked(out.collect(), texts, packing.public_tokenizer())
            assert padding < 0.03 * tokens
            break
        assert out.columns == columns
        after = read(out)
        assert len(after) == out.count() and set(after) <= set(before)
        texts = {i: r.text for i, r in before.items()}
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert np.mean([i in after for i, q in labels.items() if q]) > 0.97
        elif name == "n-gram Jaccard join":
            plain = test_jaccard_join.plain(texts, k=5, percent=80)
            assert set(after) == {i for i, (n, c) in plain.items() if not n or c == i}
        elif name == "suffix-array dedup":
            assert set(after) == set(before)
            assert {i: r.text for i, r in after.items()} == cut_in_the_plain_way(texts)
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            hashes = WordHashes()
            items = [decontamination.coded(r.text.encode(), hashes)
                     for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for i, text in texts.items():
                words = decontamination.coded(text.encode(), hashes)
                shares = [sum(t[2] for t in decontamination.tiles(item, words)) / len(item) for item in items]
                assert (i in after) == (max(shares) < decontamination.THRESHOLD)
        docs, before = out, after


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert ids and ids < {r.doc_id for r in docs.collect()}


def test_decontamination_helpers_are_shared():
    assert test_decontamination.dc is decontamination
