import random

import numpy as np
import pytest
import xxhash
from helpers import documents

from facsimile.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Least index of each component, every pair compared."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_driver_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(fps)
    got = sorted(tuple(r) for r in simhash.query(spark, sf_dir).collect())
    assert got == [(docs[i][0], f"{fps[i]:016x}", docs[roots[i]][0]) for i in range(len(docs))]
    assert len({*roots}) < len(docs)


def test_edges(spark):
    texts = [None, "", " \n\t", "One", "one", "one two three", "A b c d", "a B c d e " * 40_000, "a B c d e " * 40_000,
             "İ é ﬁ x y", "same words here and there", "same words here and there"]
    ids = [7, 3, 9, 1, 2, 4, 5, 6, 8, 10, 11, 11]
    got = simhash.near_duplicates(documents(spark, texts, ids=ids, fp="x", node="x", component="x")).collect()
    by_text = {t: (r.fingerprint, r.component_id) for t, i in zip(texts, ids) for r in got if r.doc_id == i}
    assert by_text[None] == by_text[""] == by_text[" \n\t"] == ("0" * 16, 3)
    assert by_text["One"] == by_text["one"] and by_text["one"][1] == 1
    assert all(by_text[t][0] == f"{plain_fingerprint(t):016x}" for t in texts)
    assert len(got) == len(texts) and sum(r.doc_id == 11 for r in got) == 2
    nothing = simhash.near_duplicates(documents(spark, []))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "fingerprint", "component_id"]
    nulls = simhash.near_duplicates(documents(spark, ["q", "q", "r"], ids=[None, 2, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in nulls) == [("2", "2"), ("None", "2"), ("None", "None")]


def test_every_chain_has_a_key():
    """Any two within the distance agree on some key of each length, and on no bits beyond the masks of the ring."""
    rng = random.Random(5)
    for length in simhash.LENGTHS:
        masks = [m for _, _, m in simhash.keys(length)]
        for _ in range(3000):
            differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any(differing & m == 0 for m in masks)
    assert simhash.best_length(50_000) < simhash.best_length(10 ** 8) < simhash.best_length(10 ** 11)


def fingerprint_rows(spark, fps):
    return spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long").repartition(4)


def crowd(rng, n):
    """Fingerprints of one large family, some small ones, and strangers."""
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    centre, low = rng.getrandbits(64), rng.getrandbits(64) & 0xFFFFFFFF
    fps = {flip(centre, rng.randint(1, 5)) for _ in range(n)}
    fps |= {low | rng.getrandbits(32) << 32 for _ in range(n)}  # half of the bits in common, and mostly no link
    for _ in range(40):
        one = rng.getrandbits(64)
        fps |= {one, flip(one, 3), flip(one, 4), flip(one, 5)}
    return sorted(fps)


@pytest.mark.parametrize("length, bucket", [(4, 4096), (6, 4096), (8, 4096), (4, 40)])
def test_lengths_and_large_buckets(spark, monkeypatch, length, bucket):
    """Any prefix length, and buckets dealt by longer chains and by blocks, give the links of all pairs."""
    monkeypatch.setattr(simhash, "best_length", lambda n: length)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fps = crowd(random.Random(length), 700)
    found = simhash.links(fingerprint_rows(spark, fps), len(fps)).collect()
    place = {x: i for i, x in enumerate(fps)}
    pairs = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in found]
    assert all((u ^ v).bit_count() <= 4 for u, v in pairs)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in pairs:
        a, b = find(place[u]), find(place[v])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == plain_components(fps)
