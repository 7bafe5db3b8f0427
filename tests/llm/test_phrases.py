import random
import re
from collections import Counter

import pytest
from helpers import documents, same_rows
from pyspark.sql import functions as F

from facsimile.llm import phrases
from facsimile.llm.common import WordHashes


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, least=10, top=2000):
    """Every window of every piece counted on its own."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least:
            held = any(100 * f >= 50 * a and (w == v[:2] or w == v[1:]) for (of, v), f in counts.items()
                       if len(w) == 2 and of == lang and len(v) == 3 and f >= least)
            if not held:
                cuts = [(10 ** 6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -score) for lang, mine in found.items()
                  for i, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1))


def result(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def test_against_sql(spark, sf_dir):
    same_rows(phrases.query(spark, sf_dir), sf_dir, phrases.oracle())


@pytest.mark.parametrize("period, together", [(1, 1 << 20), (3, 50), (32, 50), (1 << 62, 1 << 20)])
def test_any_parsing_counts_alike(spark, monkeypatch, period, together):
    """Chunks of two tokens, of a few, and whole texts; many small tables; a filter that lets much through."""
    monkeypatch.setattr(phrases, "PERIOD", period)
    monkeypatch.setattr(phrases, "TOGETHER", together)
    monkeypatch.setattr(phrases, "PARSED_TOGETHER", together)
    monkeypatch.setattr(phrases, "FILTER_BITS", 128)
    rng = random.Random(period)
    words = [f"w{i}" for i in range(12)] + ["É", "Und", "a\x00b", "漢字"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", " !? "])
                     for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += texts[:30] + ["w1 w2 w3 " * 2000] + [None, "", " . ", "one"]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    docs = spark.createDataFrame(list(zip(texts, langs)), "text string, lang string").repartition(3)
    assert result(docs, least=4, top=25) == plain(list(zip(langs, texts)), least=4, top=25)


def test_edges(spark):
    texts = ["Big apple pie, big apple pie. " * 6, None, "", "\t \n", "Big apple\npie"] * 2
    docs = documents(spark, texts, a="clash", phrase="clash", rank="clash")
    expected = plain([("en", t) for t in texts])
    assert result(docs) == expected and {r[2] for r in expected} == {"big apple pie"}  # its pairs mostly lie within it
    assert result(docs.withColumn("lang", F.lit(None).cast("string"))) == [("und", *r[1:]) for r in expected]
    assert result(documents(spark, [])) == result(documents(spark, [None, "", "one"])) == []


def test_chunks_share_triggers_only():
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") for _ in range(4000)).encode()
    chunks = list(phrases.parse(text, WordHashes()))
    assert [on for _, on in chunks] == [True] * (len(chunks) - 1) + [False] and len(chunks) > 20
    back = chunks[0][0].split(b" ")
    for before, (chunk, _) in zip(chunks, chunks[1:]):
        words = chunk.split(b" ")
        assert words[:2] == before[0].split(b" ")[-2:]
        back += words[2:]
    assert back == text.split(b" ")


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_007, 3_000_000_011, 3_000_000_019), (10 ** 11, 10 ** 11, 10 ** 11 + 1)], "a long, l long, r long")
    got = [r[0] for r in row.select(phrases._score("l", "r")).collect()]
    assert got == [10 ** 6 * a * a // (b * c) for a, b, c in [(3_000_000_007, 3_000_000_011, 3_000_000_019), (10 ** 11, 10 ** 11, 10 ** 11 + 1)]]


def test_more_words_than_codes_hold():
    """Three words of millions of distinct ones pass 64 bits; they count alike."""
    import numpy as np
    import pyarrow as pa

    n = 1 << 22
    chunk = b" ".join(b"%x" % i for i in range(n)) + b" 0 1 2 0 1 2"
    table = phrases._Table(pa.array([chunk], pa.binary()), np.array([False]), np.array([3]))
    every = np.full(phrases.FILTER_BITS // 64, (1 << 64) - 1, np.uint64)
    found, counts = table.trigrams(every)
    assert len(found) == n + 2 and {p for p, c in zip(found.to_pylist(), counts) if c > 3} == {b"0 1 2"}
    assert found[int(np.argmax(counts))].as_py() == b"0 1 2" and counts.max() == 9 and counts.sum() == 3 * (n + 4)
