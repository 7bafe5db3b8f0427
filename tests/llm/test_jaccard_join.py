import random

import numpy as np
import pytest
from helpers import documents

from facsimile.llm import jaccard_join as jj
from facsimile.llm.components import components


def plain(texts, k=4, percent=85):
    """{doc: (n, smallest linked doc)} by comparing all pairs of sets."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(rows, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(texts)


def test_driver_table_by_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(jj.query(spark, sf_dir).collect(), texts)


def family(draw, n, words=60, edits=6):
    base = [f"b{draw.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
        yield " ".join(own)


def test_families_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)  # so that hot buckets are cut
    monkeypatch.setattr(jj, "FIRST_BLOCK", 12)
    monkeypatch.setattr(jj, "HOT_SHARE", 0.05)
    draw = random.Random(7)
    texts = [t for n, words in ((70, 60), (40, 25), (25, 200), (10, 8), (6, 3)) for t in family(draw, n, words)]
    texts += [" ".join(["common words in all of them", *(f"u{draw.randrange(10**6)}" for _ in range(30))]) for _ in range(60)]
    draw.shuffle(texts)
    check(jj.join(documents(spark, texts)).collect(), dict(enumerate(texts)))


def test_copies_are_paired_in_stars(spark, monkeypatch):
    draw, pairs, stage = random.Random(5), [], jj.stage
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join([*base[:i], f"e{i}", *base[i + 1:]]) for i in range(10, 390, 3)]
    draw.shuffle(texts)

    def staged(df, name):
        out = stage(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jj, "stage", staged)
    check(jj.join(documents(spark, texts)).collect(), dict(enumerate(texts)))
    assert sum(pairs) <= 2 * jj.FIRST_TOKENS * len(texts) < len(texts) ** 2 // 8


def test_large_buckets_of_small_components_are_cut(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)
    # token 1: every class by itself; token 2: one large component and few others; token 3: one component; token 4: small
    rows = [(1, i, 9, i) for i in range(100)] + [(2, i, 9, min(i, 95)) for i in range(100)] + [(3, i, 9, 0) for i in range(50)]
    rows += [(2, 200 + i, 9, 95) for i in range(60)] + [(4, 1, 9, 1), (4, 2, 9, 2)]
    rows = [(t, c, r, 1000 if t == 2 and 5 <= c else p) for t, c, r, p in rows]
    blocks = {}
    for r in jj._blocked(spark.createDataFrame(rows, "token long, cid long, reach long, component long")).collect():
        assert r.cid not in blocks.setdefault((r.token, r.block), {})
        blocks[r.token, r.block][r.cid] = (r.component, r.left)
    assert max(map(len, blocks.values())) < 45
    met = {(t, *sorted((a, b))) for (t, _), held in blocks.items() for a, (p, x) in held.items() for b, (q, y) in held.items()
           if p != q and (x or y)}
    assert met == {(t, a, b) for t, a, _, p in rows for u, b, _, q in rows if t == u and a < b and p != q}


def test_reach_keeps_the_bucket_of_the_first_shared_shingle():
    draw = np.random.default_rng(4)
    for _ in range(300):
        base = np.unique(draw.integers(0, 2**63, draw.integers(1, 60)).astype(np.uint64))
        a, b = (np.union1d(base[draw.random(len(base)) > 0.08], draw.integers(0, 2**63, draw.integers(0, 4)).astype(np.uint64)) for _ in "ab")
        if len(a) and len(b) and jj.links(a, b, 85):
            first = np.intersect1d(a, b)[0]
            i, j = np.searchsorted(a, first), np.searchsorted(b, first)
            assert i < jj.prefix_length(len(a), 85) and j < jj.prefix_length(len(b), 85)
            assert len(b) <= jj.reaches(len(a), i, 85) and len(a) <= jj.reaches(len(b), j, 85)


def test_pairs_are_chosen_a_few_at_a_time(monkeypatch):
    draw = np.random.default_rng(6)
    n = 60
    sizes, component = draw.integers(50, 60, n), draw.integers(0, 9, n)
    a, b = np.triu_indices(n, 1)
    overlap = draw.integers(30, 50, len(a))
    found = [(a[i:i + 7], b[i:i + 7], overlap[i:i + 7]) for i in range(0, len(a), 7)]
    for first_only in (False, True):
        monkeypatch.setattr(jj, "PAIRS_HELD", 1 << 18)
        whole = {tuple(p) for x in jj._chosen(iter(found), sizes, component, 85, True, first_only, None) for p in np.array(x).T.tolist()}
        monkeypatch.setattr(jj, "PAIRS_HELD", 10)
        cut = {tuple(p) for x in jj._chosen(iter(found), sizes, component, 85, True, first_only, None) for p in np.array(x).T.tolist()}
        assert whole == cut and len(whole) <= (2 * n if first_only else 9 * n)


def test_edges(spark):
    texts = [None, "", " \n", "one", "ONE", "one two", "One  two\t", "a b c d", "a b c d e", "x " * 100_000, "X " * 90_000,
             "ü Ü", "ü ü", "a b c d"]
    extra = {c: "clash" for c in ("n", "cid", "token", "component", "th", "n_shingles")}
    check(jj.join(documents(spark, texts, **extra)).collect(), dict(enumerate(texts)))
    assert jj.join(documents(spark, [])).count() == 0
    again = jj.join(documents(spark, ["a b c", "a b c", "a b c", None], ids=[5, 5, None, None])).collect()
    assert sorted(str(r.component_id) for r in again) == ["5", "5", "5", "None"]
    kept = jj.keep_first(documents(spark, ["a b", "a b", "a b", None, "", "z"], ids=[4, 4, 2, 7, 8, 9])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 7, 8, 9]


def test_one_row_of_each_component_stays(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcde"}
    rows = [(None, text["a"] + " end"), (3, text["a"]), (None, text["a"]),     # near copies without an id
            (None, text["b"] + " end"), (None, text["b"]), (None, text["b"]),  # and all without one
            (11, text["c"]), (12, text["c"] + " end"), (12, text["d"]),        # an id at two texts
            (6, text["e"]), (6, text["e"]),                                    # a repeated row
            (5, ""), (5, ""), (None, None)]                                    # without a word: left alone
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], kept_id="clash", th="clash")
    got = [(r.doc_id, r.text) for r in jj.keep_first(docs).collect()]
    of_b = [x for x in got if x[1] and x[1].startswith("b0 ")]
    assert len(of_b) == 1 and of_b[0][0] is None
    expected = [(3, text["a"]), (11, text["c"]), (12, text["d"]), (6, text["e"]), (5, ""), (5, ""), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, expected + of_b))


def test_no_pair_that_links_is_ruled_out():
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = draw.integers(0, 2**63, draw.integers(1, 400)).astype(np.uint64)
        for _ in range(6):
            own = base.copy()
            at = draw.random(len(own)) < draw.random() * 0.15
            own[at] = draw.integers(0, 2**63, at.sum())
            sets.append(np.unique(own))
    sizes, component = np.array([len(s) for s in sets]), np.arange(len(sets))
    a, b = jj.candidates([jj.bitmap(s) for s in sets], sizes, component, 85, False)
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jj.links(sets[i], sets[j], 85)}
    assert true and true <= found and len(found) < len(sets) ** 2 // 8
    one = jj.candidates([jj.bitmap(s) for s in sets], sizes, component // 6, 85, False)
    assert all(x // 6 != y // 6 for x, y in zip(*one))


def test_components(spark):
    draw = random.Random(9)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    draw.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 100, 101])
def test_prefix_length(n):
    assert jj.prefix_length(n, 85) == n - int(np.ceil(0.85 * n - 1e-9)) + 1
