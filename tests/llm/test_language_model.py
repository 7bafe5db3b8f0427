import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents

from facsimile.llm import language_model as lm


def plain(texts):
    """The same model by dictionaries: {doc: (held_out, n_tokens, n_known, train_tokens, base, score)}."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one, two, followers = Counter(), Counter(), defaultdict(set)
    for i, w in words.items():
        if not held[i]:
            one.update([*w, lm.END])
            for v, x in zip([lm.BEGIN, *w], [*w, lm.END]):
                two[v, x] += 1
                followers[v].add(x)
    n, types = sum(one.values()), len(one)
    contexts = Counter()
    for (v, _), c in two.items():
        contexts[v] += c
    out = {}
    for i, w in words.items():
        base = sum(math.log10((one[x] + 1) / (n + types + 1)) for x in [*w, lm.END])
        log_p = 0.0
        for v, x in zip([lm.BEGIN, *w], [*w, lm.END]):
            p = (one[x] + 1) / (n + types + 1)
            if contexts[v]:
                p = max(two[v, x] - lm.DISCOUNT, 0) / contexts[v] + lm.DISCOUNT * len(followers[v]) / contexts[v] * p
            log_p += math.log10(p)
        out[i] = held[i], len(w) + 1, sum(one[x] > 0 for x in [*w, lm.END]), n, base, log_p
    return out


def check(rows, texts):
    expected = plain(texts)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        held, n_tokens, n_known, train, base, log_p = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(log_p, abs=3e-4 * n_tokens + 1e-9)


def test_driver_table_by_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = lm.query(spark, sf_dir).collect()
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    texts = dict(enumerate([None, "", "a", "A b", "a b a b", "x " * 50_000, "é Ü \x1c z", "new words here"] + ["the cat sat"] * 30))
    check(lm.score(documents(spark, list(texts.values()), shard="clash", uid="clash", score="clash")).collect(), texts)
    assert lm.score(documents(spark, [])).count() == 0
    again = lm.score(documents(spark, ["a b", "a b", None], ids=[3, 3, None])).collect()
    assert len(again) == 3 and len({r.score for r in again if r.doc_id == 3}) == 1
    held_only = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = lm.score(documents(spark, ["a", "b"], ids=held_only)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in rows)


def test_many_shards_and_salted_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 300)
    draw = np.random.default_rng(1)
    texts = {i: " ".join("the" if draw.random() < 0.4 else f"w{draw.integers(40)}" for _ in range(30)) for i in range(60)}
    expected = plain(texts)
    rows = lm.score(documents(spark, list(texts.values()))).collect()
    for r in rows:
        held, n_tokens, n_known, train, base, log_p = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        # salting spreads a context's back-off by the followers of each salt
        assert r.score == pytest.approx(log_p, rel=0.1)


def test_elias_fano():
    draw = np.random.default_rng(6)
    for top in (3, 200, 1 << 20, 1 << 45, (1 << 63) - 1):
        values = np.sort(draw.integers(0, top, 700).astype(np.uint64))
        ef = lm.EliasFano.of(values)
        assert (ef.access(np.arange(700)) == values).all()
        x = np.r_[draw.integers(0, top, 300).astype(np.uint64), values[:50], values[-1:]]
        assert (ef.successor(x, np.zeros(len(x)), np.full(len(x), 700)) == np.searchsorted(values, x)).all()
    assert lm.EliasFano.of(np.empty(0, np.uint64)).n == 0
    one = lm.EliasFano.of(np.array([2**64 - 1], np.uint64))
    assert one.access(np.array([0]))[0] == 2**64 - 1


def test_unigrams_of_rare_words_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "UNIGRAMS", 10)
    texts = [" ".join(f"w{j}" for j in range(i)) for i in range(40)]
    known = lm.learn_unigrams(documents(spark, texts).select("doc_id", "text"))
    assert 0 < len(known.words) <= 11
    rest = known.types - (len(known.words) - 1) - 1 + 1  # the end is in words; one unknown
    assert (10 ** known.log_p).sum() + rest * 10 ** known.log_rest == pytest.approx(1)


def test_words_beyond_the_table_keep_their_own_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "UNIGRAMS", 10)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 400)
    monkeypatch.setattr(lm, "HOT_SHARE", 1e9)
    draw = np.random.default_rng(3)
    texts = {i: " ".join(f"w{int(draw.zipf(1.4)) % 300}" for _ in range(20)) for i in range(100)}
    check(lm.score(documents(spark, list(texts.values()))).collect(), texts)


def test_salting_changes_no_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 300)
    draw = np.random.default_rng(1)
    texts = {i: " ".join("the" if draw.random() < 0.4 else f"w{draw.integers(40)}" for _ in range(30)) for i in range(60)}
    # words that follow "the" in held-out documents only
    texts |= {i: f"the new{i} the" for i in range(60, 90) if zlib.crc32(str(i).encode()) % 7 == 2}
    check(lm.score(documents(spark, list(texts.values()), ids=list(texts))).collect(), texts)
