"""Rank correlations by blocks of cells, against pandas."""

import numpy as np
import pandas as pd
import pytest

from facsimile.operators import correlation, packed
from facsimile.operators.correlation import spearman


def made(rows=3000):
    rng = np.random.default_rng(5)
    a = rng.normal(size=rows).round(6)
    frame = pd.DataFrame({
        "fine": a, "ties": (a * 3).round() + 0.0, "hot": np.where(rng.random(rows) < 0.6, 7.5, a + rng.normal(size=rows)),
        "gaps": np.where(rng.random(rows) < 0.3, np.nan, -a + rng.normal(size=rows)),
        "more": np.where(rng.random(rows) < 0.2, np.nan, rng.normal(size=rows)), "flat": np.ones(rows)})
    return frame


@pytest.mark.parametrize("small", [32 << 20, 0])
def test_rank_correlation_travels_as_arrays(spark, monkeypatch, small):
    monkeypatch.setattr(correlation, "SMALL_BYTES", small)
    monkeypatch.setattr(correlation, "SLICE_CELLS", 100)
    monkeypatch.setattr(packed, "BLOCK_BITS", 7)
    frame = made()
    names = list(frame)
    df = spark.createDataFrame(frame).repartition(3)
    found = spearman(df, names)
    plan = found._jdf.queryExecution().toString()
    # no cell has a row of its own in a join or shuffle
    assert "bucket" not in plan and "_salt" not in plan
    got = found.toPandas().pivot(index="col_a", columns="col_b", values="rho")
    want = frame.corr("spearman").fillna(0.0)
    for a in names:
        for b in names:
            assert got.loc[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_sample_goes_to_the_values_and_not_they_to_it(spark, tmp_path):
    """Few rows of a sample are checked against all ordered values, which are neither sorted nor shuffled for it."""
    from catalog.profiling import p14

    n = 3000
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "l_orderkey": np.arange(n), "l_partkey": rng.integers(0, 900, n), "l_suppkey": rng.integers(0, 9, n), "l_linenumber": rng.integers(1, 7, n),
        "l_quantity": rng.integers(1, 50, n).astype(float), "l_extendedprice": rng.random(n).round(4), "l_discount": rng.random(n).round(2),
        "l_tax": rng.random(n).round(3), "l_returnflag": rng.choice(["A", "N", "R"], n), "l_linestatus": rng.choice(["F", "O"], n)})
    spark.createDataFrame(frame).write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = p14(spark, str(tmp_path))
        assert "LeftSemi, BuildRight" in found._jdf.queryExecution().toString()
        rows = {r.column_name: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows["l_extendedprice"].sampled == rows["l_extendedprice"].positions == 1000
    assert all(r.foreign_values == 0 and r.mean_close for r in rows.values())
