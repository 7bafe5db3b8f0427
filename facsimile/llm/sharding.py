"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts form a group and travel together. The plan is made from bounded
figures: groups that weigh at least 1/64 of a shard are items of their own,
all others are hashed into 6,144 bundles (256 a shard), so the driver places
at most some 10,000 items whatever the table's size. Only a group heavier than
a shard (and than the heaviest row) in some dimension is cut: its rows are
hashed into pieces of some 1/64 of a shard, and neighbouring pieces are joined
again to parts as large as a shard takes. Items go, heaviest first, to the
shard where the dot product of the item's vector with the shard's residual
capacity is highest, among those with room for its bytes; where none has, to
the one with fewest bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from facsimile.llm.common import text_rows
from facsimile.sources.staging import stage

BUNDLES_PER_SHARD = 256
#: A group is placed by itself from this share of a shard on.
PARTS_PER_SHARD = 64
#: Rows numbered in one task when slots are dealt.
ROWS_PER_SLOT_RANGE = 50_000
DIMENSIONS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each item, and the loads; items is (n, 3) of bytes, tokens and rows.

    The vectors are shares of the totals. A shard whose bytes an item would
    overfill is passed over while another has room. Ties go to the lowest shard
    number, and equal items keep their order, so the plan is a function of its input.
    """
    totals = np.maximum(items.sum(axis=0), 1).astype(float)
    shares = items / totals
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(items), np.int32)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        room = residual[:, 0] >= shares[i, 0] - 1e-12
        best = int(np.argmax(np.where(room, residual @ shares[i], -np.inf) if room.any() else residual[:, 0]))
        chosen[i] = best
        residual[best] -= shares[i]
    return chosen, (1.0 / shards - residual) * totals


def joined_parts(owners: list, items: np.ndarray, most: list[float]) -> np.ndarray:
    """Part of each item: neighbours of one owner share a part while it weighs at most ``most`` in every dimension.

    Items without an owner (None) are parts of their own.
    """
    part = np.zeros(len(items), np.int64)
    load = None
    for i, owner in enumerate(owners):
        joins = i and owner is not None and owner == owners[i - 1] and np.all(load + items[i] <= most)
        load = load + items[i] if joins else items[i]
        part[i] = (part[i - 1] + (not joins)) if i else 0
    return part


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, n_tokens, grp, uid) of every row, staged: texts are read once.

    size: UTF-8 bytes (null: none) plus 8. grp names the text; null and empty
    texts are groups of their own. uid tells equal rows apart.
    """
    text = F.col("text")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return stage(text_rows(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.struct(F.xxhash64(raw, text.isNull()).alias("a"), F.octet_length(raw).alias("b")).alias("grp"),
        F.monotonically_increasing_id().alias("uid")), "shard-rows")


def assign(rows: DataFrame, shards: int = 24) -> DataFrame:
    """``rows`` of :func:`measured` with ``shard``."""
    spark = rows.sparkSession
    groups = stage(rows.groupBy("grp").agg(
        F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    # the heaviest row of a group weighs its share: all have the same text
    figures = groups.agg(*(F.sum(c) for c in DIMENSIONS), *(F.max(F.ceil(F.col(c) / F.col("rows"))) for c in DIMENSIONS)).first()
    total, heaviest_row = figures[:3], figures[3:]
    if not total[2]:
        return rows.withColumn("shard", F.lit(None).cast("int"))
    most = [max(t / shards, r) for t, r in zip(total, heaviest_row)]
    portion = [max(1, t // (shards * PARTS_PER_SHARD)) for t in total]
    # at most shards * 64 groups in each dimension weigh that much
    portions = F.greatest(*(F.ceil(F.col(c) / p) for c, p in zip(DIMENSIONS, portion)))
    cut = F.greatest(*(F.col(c) / F.greatest(F.lit(m), F.lit(1.0)) for c, m in zip(DIMENSIONS, most))) > 1
    heavy_groups = groups.where(portions > 1).select(
        "grp", F.when(cut, F.least(portions, F.col("rows"))).otherwise(1).cast("int").alias("parts"))
    bundles = shards * BUNDLES_PER_SHARD
    items = rows.join(F.broadcast(heavy_groups), "grp", "left").withColumn(
        "bundle", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("grp"), F.lit(bundles))).cast("int")).withColumn(
        "item", F.when(F.col("parts").isNull(), F.struct(F.lit(None).cast(rows.schema["grp"].dataType).alias("g"), F.col("bundle").alias("n"))).otherwise(
            F.struct(F.col("grp").alias("g"), F.pmod(F.xxhash64("doc_id", "uid"), F.col("parts")).cast("int").alias("n"))))
    weights = items.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"),
                                        F.count(F.lit(1)).alias("rows"))
    listed = sorted(weights.collect(), key=lambda r: (r.item.g is None, r.item.g and tuple(r.item.g), r.item.n))
    vectors = np.array([[r[c] for c in DIMENSIONS] for r in listed], np.int64)
    part = joined_parts([r.item.g and tuple(r.item.g) for r in listed], vectors, most)
    merged = np.zeros((part[-1] + 1, len(DIMENSIONS)), np.int64)
    np.add.at(merged, part, vectors)
    chosen, _ = place(merged, shards)
    plan = spark.createDataFrame(
        [(r.item, int(chosen[p])) for r, p in zip(listed, part)],
        items.select("item").schema.add("shard", IntegerType()))
    return items.join(F.broadcast(plan), "item").drop("item", "bundle", "parts")


def numbered(rows: DataFrame, order: tuple[str, ...] = ("doc_id", "text_crc32", "size", "uid")) -> DataFrame:
    """``slot``: gapless from 0 in each shard; no task numbers more than a range of a shard."""
    n = rows.count()
    ranges = max(1, n // ROWS_PER_SLOT_RANGE)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(ranges)).cast("int"))
    before = rows.groupBy("shard", "part").count().withColumn(
        "first", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).drop("count")
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return rows.withColumn("local", local).join(before, ["shard", "part"]).withColumn(
        "slot", (F.col("first") + F.col("local")).cast("long")).drop("part", "local", "first")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and slot under the law ``bytes``: shard sizes are near equal.

    Returns doc_id, size, text_crc32, n_tokens, law, shard, slot, grown_shard
    (null under this law). Null texts weigh 8 bytes; repeated rows and null ids
    get a slot each; an empty table gives an empty result. Equal texts share a
    shard unless all of them together weigh more than one. A single row heavier
    than a shard stays whole, as rows are never cut.
    """
    rows = stage(assign(measured(docs, id_col, text_col), shards), "sharded")
    return numbered(rows).select(
        "doc_id", "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
