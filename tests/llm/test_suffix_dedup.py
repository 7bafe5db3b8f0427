import hashlib
import random

import numpy as np
import pytest
from helpers import documents

from facsimile.llm import suffix_dedup as sd


def plain(texts, width=sd.WIDTH):
    """{doc: (n_bytes, n_removed, n_spans, sha)} from a table of every window's first start."""
    first, out = {}, {}
    raws = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(raws):
        for s in range(len(raws[i]) - width + 1):
            first.setdefault(raws[i][s:s + width], (i, s))
    for i, raw in raws.items():
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - width + 1):
            if first[raw[s:s + width]] < (i, s):
                gone[s:s + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = len(raw), int(gone.sum()), int(np.count_nonzero(gone[:-1] & ~np.r_[False, gone[:-1]][:len(raw)])) if raw else 0, \
            hashlib.sha256(kept).hexdigest()
    return out


def check(rows, texts):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain(texts)


def test_driver_table_by_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = plain(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.query(spark, sf_dir).collect()}
    assert got == expected and any(v[1] for v in expected.values())


def planted(draw, n=120):
    word = lambda: "".join(draw.choice("abcdeé ") for _ in range(draw.randrange(1, 9)))
    text = lambda m: " ".join(word() for _ in range(m))
    shared = [text(40) for _ in range(4)] + ["ab" * 90, "x" * 260]
    out = []
    for _ in range(n):
        parts = [text(draw.randrange(30))]
        for _ in range(draw.randrange(4)):
            s = draw.choice(shared)
            a = draw.randrange(len(s) // 3)
            parts += [s[a:len(s) - draw.randrange(len(s) // 3)], text(draw.randrange(6))]
        out.append("".join(parts))
    return out + out[:15] + [o[:-3] + "!" for o in out[:15]]


@pytest.mark.parametrize("hot_rows", [2000, 5])
def test_planted_passages(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(sd, "HOT_ROWS", hot_rows)  # a low one salts nearly every shared anchor
    monkeypatch.setattr(sd, "TOGETHER", 3000)
    monkeypatch.setattr(sd, "WINDOWS", 500)
    texts = planted(random.Random(11))
    check(sd.remove_copies(documents(spark, texts, doc="clash", raw="clash", th="clash")).collect(), dict(enumerate(texts)))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 5000)  # long texts elect anchors in parts
    long = "".join(random.Random(1).choices("abc ", k=24_000))
    texts = [None, "", "y" * 99, "y" * 100, "y" * 101, long, long[3000:20_000], "é" * 60, "é" * 60, "é" * 49]
    check(sd.remove_copies(documents(spark, texts)).collect(), dict(enumerate(texts)))
    assert sd.remove_copies(documents(spark, [])).count() == 0
    again = documents(spark, ["z" * 50 + long[:200]] * 3 + ["short"] * 2 + [long[:150]] * 2, ids=[4, 4, 4, 5, 5, None, None])
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in sd.remove_copies(again).collect())
    assert got == [("4", 250, 0), ("4", 250, 250), ("4", 250, 250), ("5", 5, 0), ("5", 5, 0), ("None", 150, 150), ("None", 150, 150)]


def test_cut_keeps_characters_and_columns(spark):
    body = "".join(random.Random(2).choices("éèab ", k=300))
    docs = documents(spark, [body, "ê" + body[1:] + " tail", None, body[:20]], found="clash")
    got = {r.doc_id: r for r in sd.cut(docs).collect()}
    assert sd.cut(docs).columns == docs.columns
    assert got[0].text == body and got[2].text is None and got[3].text == body[:20]
    assert got[1].text.endswith(" tail") and len(got[1].text) < 20 and got[1].n_chars == len(got[1].text)


def test_cut_leaves_columns_of_any_name(spark):
    """Helper names as the user's own columns come back as they were, with repeated rows and without."""
    clash = {name: f"mine {name}" for name in ("__id", "__th", "__doc", "__none", "__found", "doc", "th", "raw")}
    body = "".join(random.Random(5).choices("abcd ", k=300))
    for texts, ids in (([body, body[:200] + " end", "s"], [1, 2, 3]), ([body, body, body[:200], "s", "s"], [1, 1, 2, 3, 3])):
        docs = documents(spark, texts, ids=ids, **clash)
        got = sd.cut(docs).collect()
        assert sd.cut(docs).columns == docs.columns and len(got) == len({*zip(ids, texts)})
        assert all(r[name] == value for r in got for name, value in clash.items())
        assert {r.doc_id: r.text for r in got}[2] == texts[ids.index(2)][200:]


def test_previous_factors():
    draw = np.random.default_rng(4)
    for _ in range(60):
        n, width = int(draw.integers(1, 60)), 12
        windows = draw.integers(97, 99, (n, width)).astype(np.uint8)
        windows[draw.random(n) < 0.5, 6:] = 97
        group, order = draw.integers(0, 3, n), draw.permutation(n)
        got = sd.previous_factors(windows, group, order)
        for i in range(n):
            best = 0
            for j in range(n):
                if group[i] == group[j] and order[j] < order[i]:
                    same = windows[i] == windows[j]
                    best = max(best, width if same.all() else int(np.argmin(same)))
            assert got[i] == best


def test_runs_tile_and_equal_windows_elect_alike():
    draw = random.Random(3)
    a = bytes(draw.choice(b"ab") for _ in range(400))
    b = b"zz" + a[50:300] + b"y"
    own = []
    for data in (a, b):
        start, n, h = sd.runs(data)
        assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and start[-1] + n[-1] == len(data) - 99
        assert n.max() <= sd.WIDTH - sd.GRAM + 1
        own.append({data[s + k:s + k + 100]: x for s, m, x in zip(start, n, h) for k in range(m)})
    both = own[0].keys() & own[1].keys()
    assert len(both) > 100 and all(own[0][w] == own[1][w] for w in both)
