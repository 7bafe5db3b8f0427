import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import documents

from facsimile.llm import sharding


def checked(rows, texts, shards):
    """The contract on every row; returns the bytes of each shard."""
    slots, load = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    return [load[s] for s in range(shards)]


def test_driver_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.query(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    load = checked(rows, docs, 24)
    assert max(load) - min(load) <= max(r.size for r in rows)


def test_hot_group_is_cut_and_small_groups_stay_together(spark):
    texts = ["same text here"] * 900 + [f"text number {i} " * (1 + i % 7) for i in range(2000)] + ["pair"] * 2
    rows = sharding.shard(documents(spark, texts), 4).collect()
    load = checked(rows, texts, 4)
    assert max(load) < 1.02 * min(load)
    tokens = Counter()
    for r in rows:
        tokens[r.shard] += r.n_tokens
    assert max(tokens.values()) < 1.1 * min(tokens.values())
    assert len({r.shard for r in rows if texts[r.doc_id] == "pair"}) == 1


def test_edges(spark):
    texts = [None, "", "é ü", "x" * 200_000, "a"]
    rows = sharding.shard(documents(spark, texts, shard="clash", slot="clash", size="clash", bytes="clash"), 3).collect()
    checked(rows, texts, 3)
    assert {r.doc_id: r.n_tokens for r in rows} == {0: 0, 1: 0, 2: 2, 3: 1, 4: 1}
    assert sharding.shard(documents(spark, []), 3).count() == 0
    again = sharding.shard(documents(spark, ["t"] * 50 + [None] * 50, ids=[7] * 50 + [None] * 50), 2).collect()
    by = Counter(r.shard for r in again)
    assert sum(by.values()) == 100
    assert all(sorted(r.slot for r in again if r.shard == s) == list(range(n)) for s, n in by.items())


def test_same_plan_at_any_layout(spark):
    texts = [f"text number {i} " * (1 + i % 7) for i in range(300)]
    one, many = ({r.doc_id: r.shard for r in sharding.shard(documents(spark, texts, partitions=p), 4).collect()} for p in (1, 7))
    assert one == many


def test_place_takes_the_highest_dot_product():
    items = np.array([[8, 1, 1], [4, 1, 1], [4, 1, 1]])
    chosen, loads = sharding.place(items, 2)
    assert chosen[0] != chosen[1] and chosen[1] == chosen[2]
    assert loads[:, 0].tolist() == [8, 8]


def test_place_leaves_room_for_bytes():
    # the second shard has most room for tokens and rows, yet no bytes left for the last item
    items = np.array([[6, 0, 0], [1, 3, 3], [5, 1, 1]])
    chosen, loads = sharding.place(items, 2)
    assert chosen.tolist() == [1, 0, 0] and sorted(loads[:, 0].tolist()) == [6, 6]


def test_pieces_of_a_cut_group_join_to_whole_shards():
    items = np.array([[3, 3, 3]] * 7 + [[1, 1, 1]] * 2)
    owners = ["g"] * 7 + [None, None]
    assert sharding.joined_parts(owners, items, [10, 10, 10]).tolist() == [0, 0, 0, 1, 1, 1, 2, 3, 4]


def test_equal_texts_share_a_shard_beside_a_hot_group(spark):
    texts = ([f"group {g} " + "word " * (g % 5) for g in range(60) for _ in range(1 + g % 9)]
             + ["hot text of one group"] * 200 + [None] * 3 + [""] * 2)
    shards = 4
    rows = sharding.shard(documents(spark, texts), shards).collect()
    load = checked(rows, texts, shards)
    where = defaultdict(set)
    weight = Counter()
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
        weight[texts[r.doc_id]] += r.size
    total = [sum(r.size for r in rows), sum(r.n_tokens for r in rows), len(rows)]
    hot = "hot text of one group"
    assert weight[hot] > total[0] / shards and len(where[hot]) > 1
    assert all(len(s) == 1 for t, s in where.items() if t != hot)
    assert max(load) - min(load) <= max(w for t, w in weight.items() if t != hot)


def test_groups_of_the_driver_table_are_whole(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.query(spark, sf_dir).collect()
    where = defaultdict(set)
    for r in rows:
        where[docs[r.doc_id]].add(r.shard)
    size = Counter()
    for r in rows:
        size[docs[r.doc_id]] += r.size
    shard_bytes = sum(size.values()) / 24
    assert all(len(s) == 1 for t, s in where.items() if size[t] <= shard_bytes / 2)
