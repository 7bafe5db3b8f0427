import random

import numpy as np
from helpers import documents

from facsimile.llm import decontamination as dc
from facsimile.llm.common import WordHashes

ITEM = " ".join(f"Item{i}" for i in range(30))


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def leaks(spark, docs, items, **options):
    return {r.doc_id: r.leaks for r in dc.find_leaks(documents(spark, docs, leaks="clash", item_id="clash"),
                                                    benchmark(spark, items), **options).collect()}


def tiling_by_brute_force(a, b, least):
    """The definition: mark the longest unmarked common run, earliest first, until all are short."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        i, j, n = best
        ma[i:i + n], mb[j:j + n] = [True] * n, [True] * n
        out.append(best)


def test_tiles_are_greedy_string_tiles():
    draw = random.Random(2)
    hashes = WordHashes()
    for _ in range(300):
        a, b = ([draw.choice(b"abc"[:draw.choice([1, 2, 3])]) for _ in range(draw.randrange(22))] for _ in "ab")
        coded = [hashes.of([bytes([x]) for x in s]) for s in (a, b)]
        plain = tiling_by_brute_force(a, b, 3)
        assert dc.tiles(*coded, least=3) == plain
        assert dc.tiles_by_length(*coded, least=3) == plain


def test_texts_that_repeat_themselves_take_linear_memory():
    import time
    import tracemalloc

    hashes = WordHashes()
    item, doc = (hashes.of([b"a"] * n + tail) for n, tail in ((2_000, [b"b"] * 40), (400_000, [b"b"] * 50)))
    tracemalloc.start()
    begun = time.perf_counter()
    # 400 million pairs of equal windows
    assert dc.tiles(item, doc) == [(0, 398_000, 2_040)]
    assert time.perf_counter() - begun < 30 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_short_and_unspaced_items(spark):
    unspaced = "".join(chr(0x4E00 + 37 * i % 9000) for i in range(80))
    thai = "".join(chr(0x0E01 + 7 * i % 40) for i in range(30))
    items = ["four words stand here", "two words", "alone", unspaced, unspaced[:6], thai, "six words of one more item"]
    docs = ["before Four words, stand here after", "four words stand there", "only two words", "alone",
            "前" * 30 + unspaced + "後", unspaced[40:] + "中" + unspaced[:40], unspaced[:30] + "別" * 50, thai + "ก",
            "here four words stand", "six words of one other item", "six words of one more"]
    got = {i: [leak.item_id for leak in found] for i, found in leaks(spark, docs, items).items()}
    assert got == {0: [0], 1: [], 2: [1], 3: [], 4: [3, 4], 5: [3, 4], 6: [4], 7: [5], 8: [], 9: [], 10: [6]}


def test_reordered_partial_and_clean(spark):
    words = ITEM.split()
    moved = " ".join(words[15:] + ["between"] + words[:15])
    edited = " ".join(w if i != 12 else "other" for i, w in enumerate(words))
    half = " ".join(words[:15])
    got = leaks(spark, [f"before {ITEM.upper()} after", moved, edited, half, "plain text " * 40,
                        ", ".join(words), None, "", "x " * 400_000 + ITEM], [ITEM, None, "", "short"])
    assert [[leak.item_id for leak in got[i]] for i in range(9)] == [[0], [0], [0], [], [], [0], [], [], [0]]
    assert got[0][0].coverage == got[1][0].coverage == 1 and len(got[1][0].tiles) == 2
    assert 0.9 < got[2][0].coverage < 1
    assert got[8][0].tiles[0].doc_start == 400_000


def test_blocks_repeats_and_empty_tables(spark):
    items = [f"{' '.join(f'w{k}x{i}' for i in range(12))}" for k in range(8)]
    docs = [" ".join(items[:3]), items[7], items[0] + " " + items[0], "none"]
    one, many = (leaks(spark, docs, items + items[:1], block_bytes=b) for b in (1 << 20, 100))
    assert one == many
    assert [leak.item_id for leak in one[0]] == [0, 1, 2, 8] and [leak.item_id for leak in one[1]] == [7]
    assert leaks(spark, docs, []) == {i: [] for i in range(4)}
    assert leaks(spark, [], items) == {}
    twice = documents(spark, [items[0], items[0], "none", None], ids=[5, 5, None, None])
    assert sorted(len(r.leaks) for r in dc.find_leaks(twice, benchmark(spark, items)).collect()) == [0, 0, 1, 1]
    kept = dc.clean(twice.withColumnRenamed("lang", "leaks"), benchmark(spark, items))
    assert kept.count() == 2 and "leaks" in kept.columns


def test_driver_table_by_brute_force(spark, sf_dir):
    def words(text):
        return "".join(c if c.isalnum() and ord(c) < 128 or ord(c) > 127 else " " for c in text.lower()).split(" ")

    clean = lambda t: [w for w in words(t.replace("\n", " ")) if w]
    items = {r.item_id: clean(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in dc.query(spark, sf_dir).collect()}
    whole = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = " " + " ".join(clean(r.text)) + " "
        inside = {i for i, w in items.items() if f" {' '.join(w)} " in text}
        assert inside <= got.get(r.doc_id, set())
        whole += len(inside)
    assert whole and sum(map(len, got.values())) <= whole * 1.2 and all(got.values())


def test_find_leaks_by_brute_force(spark):
    draw = random.Random(5)
    items = [" ".join(draw.choice(["to", "be", "or", "not", "so", "it", "is"]) for _ in range(draw.randrange(0, 24))) for _ in range(12)]
    docs = [" ".join(draw.choice(["to", "be", "or", "not", "so", "it", "is"]) for _ in range(draw.randrange(0, 60))) for _ in range(25)]
    docs += [items[k] + " " + items[k - 1] for k in range(12)]
    got = leaks(spark, docs, items)
    expected = {}
    for d, doc in enumerate(docs):
        expected[d] = {}
        for k, item in enumerate(items):
            a, b = item.split(), doc.split()
            if len(a) > 1:
                tiles = tiling_by_brute_force(a, b, min(5, len(a)))
                if sum(t[2] for t in tiles) >= 0.6 * len(a):
                    expected[d][k] = [tuple(t) for t in tiles]
    assert {d: {x.item_id: [tuple(t) for t in x.tiles] for x in found} for d, found in got.items()} == expected
    assert sum(map(len, expected.values())) > 12
