"""Global order without a single-task window.

A window ordered over a whole column runs in one task. Here a range sort
splits the order over all tasks, each adds running totals to its own slice,
and the slices are tied together by one row per (slice, key).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators.sizing import broadcast_if_small
from facsimile.sources.staging import keep, stage


def slice_totals(df: DataFrame, order: list[str], weights: list[str], without: list[str] | None = None) -> DataFrame:
    """Range-sort the frame; add ``pid`` and, per weight, a running total in the slice. ``without`` goes once it has sorted."""
    sliced = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("pid", F.spark_partition_id())
        .drop(*(without or []))
    )
    schema = T.StructType(sliced.schema.fields + [T.StructField(f"run_{w}", T.LongType()) for w in weights])

    def add_totals(batches):
        import numpy as np
        import pyarrow as pa

        carried = dict.fromkeys(weights, 0)
        for batch in batches:
            extra = []
            for w in weights:
                total = np.cumsum(batch.column(w).to_numpy(zero_copy_only=False)) + carried[w]
                carried[w] = int(total[-1]) if len(total) else carried[w]
                extra.append(pa.array(total, pa.int64()))
            names = batch.schema.names + [f"run_{w}" for w in weights]
            yield pa.RecordBatch.from_arrays(batch.columns + extra, names=names)

    return sliced.mapInArrow(add_totals, schema)


@dataclass
class Ordered:
    """A staged, globally ordered table with running totals per key."""

    rows: DataFrame
    keys: list[str]
    weights: list[str]
    parts: DataFrame
    part_rows: int

    def positioned(self, *carry: str) -> DataFrame:
        """Rows with ``cum_<w>``, the inclusive total within the key, plus key-level columns."""
        side = self.parts.select(
            "pid", *self.keys, *[f"shift_{w}" for w in self.weights], *carry
        )
        joined = self.rows.join(broadcast_if_small(side, self.part_rows), ["pid", *self.keys])
        for w in self.weights:
            joined = joined.withColumn(f"cum_{w}", F.col(f"run_{w}") + F.col(f"shift_{w}"))
        drop = ["pid"] + [f"{p}_{w}" for w in self.weights for p in ("run", "shift")]
        return joined.drop(*drop)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weights: list[str],
    name: str,
    measures: dict[str, Column] | None = None,
    per_key: dict[str, Column] | None = None,
    without: list[str] | None = None,
) -> Ordered:
    """Order ``df`` by (keys, order) and lay running totals of the weights over each key.

    ``measures`` are aggregates taken per slice and key while the staged rows
    are read for the first time; ``per_key`` combines them over a key's slices
    (window expressions over ``Window.partitionBy(keys)``). Columns ``without`` only sort and are not staged.
    """
    rows = stage(slice_totals(df, [*keys, *order], weights, without), name)
    parts = rows.groupBy("pid", *keys).agg(
        *[F.sum(w).alias(f"sum_{w}") for w in weights],
        *[F.min(F.col(f"run_{w}") - F.col(w)).alias(f"base_{w}") for w in weights],
        *[m.alias(a) for a, m in (measures or {}).items()],
    )
    # One row per slice and key: as many rows as there are slices, plus one per key.
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = {
        f"shift_{w}": F.coalesce(F.sum(f"sum_{w}").over(before), F.lit(0)) - F.col(f"base_{w}")
        for w in weights
    }
    totals = {f"n_{w}": F.sum(f"sum_{w}").over(whole) for w in weights}
    parts = parts.withColumns({**shifts, **totals})
    if per_key:
        parts = parts.withColumns({a: c.over(whole) for a, c in per_key.items()})
    parts = keep(parts)
    return Ordered(rows, keys, weights, parts, parts.count())
