import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import facsimile as fs
from facsimile.functions.estimators import exact_kolmogorov_p, kolmogorov_p
from facsimile.operators import comparison
from facsimile.operators.correlation import pearson

STAFF = """badge,wage,years,stars,team
11,1800.25,2,4,North
12,2600.00,7,,South
13,,3,5,North
14,9100.50,21,1,East
15,2100.00,4,3,
16,2050.75,,2,North
"""


def metrics(v):
    return {r["column_name"]: r for r in v.columns.collect()}


def test_constant_copy_loses_its_correlation(spark):
    ref = spark.createDataFrame([(i, 2 * i) for i in range(1, 6)], "a long, b long")
    synth = spark.createDataFrame([(v, 5) for v in (1.1, 2.1, 2.9, 4.2, 4.8)], "a double, b long")
    v = fs.validate_tables(ref, synth)
    a = metrics(v)["a"]
    assert a["type"] == "numeric" and a["ks_statistic"] == pytest.approx(0.2)
    score = v.score.first()
    assert score["mean_absolute_correlation_error"] == pytest.approx(0.75)


def test_against_itself(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(STAFF)
    df = fs.read_table(spark, str(path))
    v = fs.validate_tables(df, df)
    assert v.score.first()["overall"] == pytest.approx(100.0)
    m = metrics(v)
    assert m["wage"]["ks_statistic"] == 0 and m["wage"]["ks_p_value"] == 1.0 and m["team"]["mean_freq_diff"] == 0


def test_figures_match_numpy(spark):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"x": rng.normal(size=300).round(1), "y": rng.gamma(2, size=300), "c": rng.choice(list("abc"), 300)})
    b = pd.DataFrame({"x": rng.normal(0.3, 1.2, size=500).round(1), "y": rng.gamma(3, size=500), "c": rng.choice(list("bcd"), 500)})
    a.loc[a.index % 7 == 0, "x"] = np.nan
    m = metrics(fs.validate_tables(spark.createDataFrame(a), spark.createDataFrame(b)))
    for name in ("x", "y"):
        r, s = np.sort(a[name].dropna()), np.sort(b[name])
        grid = np.concatenate([r, s])
        ks = np.abs(np.searchsorted(r, grid, "right") / len(r) - np.searchsorted(s, grid, "right") / len(s)).max()
        q = [0.25, 0.5, 0.75]
        qd = np.abs(a[name].quantile(q) - b[name].quantile(q)).mean()
        rel = lambda u, w: abs(u - w) / max(abs(u), 1e-5)
        err = np.mean([rel(a[name].mean(), b[name].mean()), rel(a[name].median(), b[name].median()),
                       rel(a[name].std(), b[name].std()), qd / max(a[name].quantile(q).abs().mean(), 1e-5)])
        got = m[name]
        assert got["ks_statistic"] == pytest.approx(ks) and got["quantile_diff"] == pytest.approx(qd)
        assert got["numeric_distribution_error"] == pytest.approx(err)
        assert (got["range_ref_min"], got["range_synth_max"]) == (a[name].min(), b[name].max())
    fa, fb = a.c.value_counts(normalize=True), b.c.value_counts(normalize=True)
    assert m["c"]["mean_freq_diff"] == pytest.approx(fa.sub(fb, fill_value=0).abs().mean())


def test_empty_sides_and_missing_columns(spark):
    ref = spark.createDataFrame([(1.0, "a", None, 1)], "v double, s string, e double, only int")
    synth = spark.createDataFrame([(None, "a", 2.0)], "v double, s string, e double")
    v = fs.validate_tables(ref, synth)
    m = metrics(v)
    assert set(m) == {"v", "s", "e"} and m["v"]["status"] == m["e"]["status"] == "empty"
    assert v.score.first()["distribution_similarity"] == 1.0


def test_status_of_the_correlation(spark):
    words = spark.createDataFrame([("a",), ("b",)], "s string")
    v = fs.validate_tables(words, words)
    assert v.correlation_status == "Not enough numeric columns" and v.score.first()["mean_absolute_correlation_error"] is None


def test_staged_tables_can_be_dropped(spark, monkeypatch, tmp_path):
    from facsimile.sources import staging

    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path / "own"))
    monkeypatch.setattr(staging, "_folders", [])
    monkeypatch.setattr(staging, "_kept", [[]])
    assert staging.stage(spark.range(3), "three").count() == 3 and (tmp_path / "own").exists()
    fs.release(spark)
    assert not (tmp_path / "own").exists()


def test_runs_drop_their_own(spark, tmp_path, monkeypatch):
    """A run's tables and caches go at its end; those of an outer run and the caller's own stay."""
    from facsimile.sources import staging

    mine = spark.range(5).persist()
    outer = staging.stage(spark.range(3), "outer")
    with fs.run(spark):
        inner, kept = staging.stage(spark.range(4), "inner"), staging.keep(spark.range(6))
        assert inner.count() == 4 and kept.count() == 6 and kept.is_cached
    assert outer.count() == 3 and mine.is_cached and not kept.is_cached
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        inner.count()
    mine.unpersist()


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "s string, f boolean")
    score = fs.validate_tables(df, df).score.first()
    assert score["overall"] == 100.0 and score["mean_absolute_correlation_error"] is None


def test_pearson_matches_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(150, 3)) + 1e6, columns=list("abc"))
    pdf["b"] += pdf["a"]
    pdf.loc[pdf.index % 4 == 0, "a"] = np.nan
    pdf.loc[pdf.index % 6 == 1, "c"] = np.nan
    pdf["flat"] = 0.1
    expected = pdf.corr().fillna(0)
    for r in pearson(spark.createDataFrame(pdf), list(pdf.columns)).collect():
        assert r["rho"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]], abs=1e-8), r


def test_kolmogorov_branches_meet(spark):
    df = spark.createDataFrame([(0.0,), (0.0117,), (0.0118,), (0.0119,), (0.05,)], "d double")
    n = F.lit(20000)
    p = [r[0] for r in df.select(kolmogorov_p(F.col("d"), n, n)).collect()]
    assert p[0] == 1.0 and p[-1] < 1e-9 and abs(p[2] - (p[1] + p[3]) / 2) < 1e-3


def test_end_to_end(spark):
    df = spark.range(800).select(
        (F.col("id") + 1).alias("row_id"), (F.pow("id", F.lit(0.5)) * 10).alias("v"), (F.col("id") % 7).alias("w"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("c"))
    run = fs.fidelity_run(df, rows=800, seed=1)
    assert run.synthetic.count() == 800
    assert run.validation.score.first()["overall"] > 85
    sections = {r["section"]: r["count"] for r in run.report.groupBy("section").count().collect()}
    assert sections == {"dataset": 2, "quality": 2, "privacy": 2, "numeric": 9, "profile": 32}


def exact_p(n, d):
    """P(D_n >= d) of the one-sample statistic, by Marsaglia, Tsang and Wang's matrix power."""
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = np.fromfunction(lambda i, j: (i - j + 1 >= 0).astype(float), (m, m))
    for i in range(m):
        a[i, 0] -= h ** (i + 1)
        a[m - 1, i] -= h ** (m - i)
    a[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                a[i, j] /= np.prod(np.arange(1.0, i - j + 2))
    q = np.linalg.matrix_power(a, n)[k - 1, k - 1]
    for i in range(1, n + 1):
        q *= i / n
    return 1 - q


def test_p_value_at_finite_sizes(spark):
    cases = [(13, 100, 0.53), (13, 100, 0.3), (30, 30, 0.25), (100, 100, 0.2), (1000, 500, 0.05), (40, 60, 0.15)]
    got = spark.createDataFrame(cases, "n long, m long, d double").select(
        kolmogorov_p(F.col("d"), F.col("n"), F.col("m"))).collect()
    for (n, m, d), (p,) in zip(cases, got):
        assert p == pytest.approx(exact_p(round(n * m / (n + m)), d), abs=0.004)


def test_exact_p_value():
    """Every order of a few values enumerated; equal sides by the closed form of Gnedenko and Korolyuk."""
    from itertools import combinations
    from math import comb

    for n, m in ((1, 1), (3, 3), (4, 6), (7, 3)):
        orders = []
        for left in combinations(range(n + m), n):
            at, most = 0, 0
            for t in range(n + m):
                at += m if t in left else -n
                most = max(most, abs(at))
            orders.append(most)
        for reach in range(n * m + 2):
            expected = sum(x >= reach for x in orders) / len(orders)
            assert exact_kolmogorov_p(n, m, reach) == pytest.approx(expected, rel=1e-12, abs=1e-15)
    for n, k in ((8, 4), (15, 7), (60, 31), (2000, 60), (10_000, 250)):
        closed = 2 * sum((-1) ** (t - 1) * (comb(2 * n, n - t * k) / comb(2 * n, n) if n <= 500 else
                                            np.exp(log_comb(2 * n, n - t * k) - log_comb(2 * n, n))) for t in range(1, n // k + 1))
        assert exact_kolmogorov_p(n, n, k * n) == pytest.approx(closed, rel=1e-7)
    # the tables' critical value for twice 20 values at 5 % is a distance of 9/20
    assert exact_kolmogorov_p(20, 20, 9 * 20) < 0.05 < exact_kolmogorov_p(20, 20, 8 * 20)


def log_comb(n, k):
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def test_p_value_of_small_tables(spark):
    """Small sides are counted, large ones go by the limit law; both in one table."""
    rng = np.random.default_rng(11)
    ref = pd.DataFrame({"a": rng.normal(size=13), "b": rng.normal(size=13)})
    ref.loc[4, "b"] = np.nan
    synth = pd.DataFrame({"a": rng.normal(0.8, 1, size=100), "b": rng.normal(size=100)})
    m = metrics(fs.validate_tables(spark.createDataFrame(ref), spark.createDataFrame(synth)))
    for name, n in (("a", 13), ("b", 12)):
        assert m[name]["ks_p_value"] == pytest.approx(exact_kolmogorov_p(n, 100, round(m[name]["ks_statistic"] * n * 100)))
    rows = spark.createDataFrame([("", 0, 10_000, 10_000, 0.02), ("", 1, 10_001, 10_000, 0.02)],
                                 "grp string, cid int, n_ref long, n_synth long, ks_statistic double")
    exact, limit = (r.ks_p_value for r in comparison.with_p_values(rows).orderBy("cid").collect())
    assert exact == exact_kolmogorov_p(10_000, 10_000, 2_000_000) and exact == pytest.approx(limit, abs=1e-3)


@pytest.mark.skipif("FIDELITY_PAIR" not in os.environ, reason="two CSV files, the reference table and a synthetic one")
def test_published_figures(spark):
    """The published report on a pair of example tables."""
    v = fs.validate_tables(*[fs.read_table(spark, path) for path in os.environ["FIDELITY_PAIR"].split(",")])
    score, m = v.score.first(), metrics(v)
    assert round(score["overall"], 1) == 71.3 and round(score["mean_absolute_correlation_error"], 2) == 0.32
    published = {"id": (0.2200, 1.9400, 1.0), "salary": (0.5304, 14272.1371, 17848.1150), "age": (0.5243, 2.4179, 5.5),
                 "rating": (0.3077, 0.2405, 0.0)}
    for name, figures in published.items():
        assert [round(m[name][f], 4) for f in ("ks_statistic", "mean_diff", "median_diff")] == list(figures)
