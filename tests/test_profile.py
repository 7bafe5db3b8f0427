import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import facsimile as fs
from facsimile.operators import columns
from facsimile.operators.columns import ROOT
from facsimile.operators.correlation import pearson, spearman


def by_column(profile, grp=ROOT):
    return {r["column_name"]: r for r in profile.columns.where(F.col("grp") == grp).collect()}


def test_numeric_columns(spark):
    df = spark.createDataFrame([(25.0, 50000), (30.0, 60000), (35.0, 70000), (math.nan, 80000)], "age double, salary long")
    p = fs.profile_table(df)
    meta = p.meta.first()
    assert (meta["num_rows"], meta["num_columns"]) == (4, 2)
    cols = by_column(p)
    assert cols["age"]["inferred_type"] == "numeric" and cols["age"]["nullable"]
    assert cols["age"]["missing_count"] == 1 and cols["age"]["mean"] == 30.0 and cols["age"]["num_unique"] == 3
    assert not cols["salary"]["nullable"]
    assert (cols["salary"]["min_value"], cols["salary"]["max_value"]) == (50000.0, 80000.0)


def test_categories(spark):
    p = fs.profile_table(spark.createDataFrame([("red",), ("blue",), ("red",), ("green",)], "color string"))
    assert by_column(p)["color"]["num_unique"] == 3
    assert {r["value"]: r["frequency"] for r in p.frequencies.collect()}["blue"] == 0.25
    assert p.correlations.count() == 0


def test_discrete_and_skewed_match_numpy(spark):
    skewed = list(range(25)) + [1000, 2000, 3000, 4000, 5000]
    pdf = pd.DataFrame({"discrete": [1, 2, 3, 4, 5] * 6, "skewed": skewed, "real": np.linspace(-3, 7, 30) ** 3})
    p = fs.profile_table(spark.createDataFrame(pdf))
    cols = by_column(p)
    assert cols["discrete"]["is_discrete"] and not cols["skewed"]["is_discrete"]
    wide = {r["column_name"]: r for r in p.assembled().collect()}
    for name in pdf:
        c, x = cols[name], pdf[name]
        assert c["skewness"] == pytest.approx(x.skew(), abs=1e-9)
        assert c["std_dev"] == pytest.approx(x.std())
        assert [c["q1"], c["median"], c["q3"]] == pytest.approx(list(x.quantile([0.25, 0.5, 0.75])))
        counts, bins = np.histogram(x, bins="auto")
        assert wide[name]["histogram_counts"] == list(counts)
        assert wide[name]["histogram_bins"] == pytest.approx(list(bins))
    assert sorted(wide["real"]["kde_samples"]) == pytest.approx(sorted(pdf["real"]))


def test_histogram_matches_numpy_on_larger_data(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.lognormal(size=4096), "b": rng.integers(0, 40, 4096), "c": np.round(rng.normal(size=4096), 2)})
    p = fs.profile_table(spark.createDataFrame(pdf))
    wide = {r["column_name"]: r for r in p.assembled().collect()}
    for name in pdf:
        counts, bins = np.histogram(pdf[name], bins="auto")
        assert wide[name]["histogram_counts"] == list(counts)
    sample = [r["value"] for r in p.sample.where("column_name = 'a'").collect()]
    assert len(sample) == 1000 and len(set(sample)) == 1000 and set(sample) <= set(pdf["a"])


def test_edge_columns(spark):
    schema = T.StructType.fromDDL(
        "one long, flat double, void string, flag boolean, at timestamp, items array<int>, tiny double, fine double")
    rows = [(i, 2.5, None, i % 2 == 0, dt.datetime(2020, 1, 1 + i), [i], i * 1e-7, i / 7) for i in range(3)]
    cols = by_column(fs.profile_table(spark.createDataFrame(rows, schema)))
    assert cols["void"]["inferred_type"] == "unsupported" and cols["void"]["missing_percentage"] == 100.0
    assert cols["flag"]["inferred_type"] == "boolean"
    assert cols["at"]["inferred_type"] == "datetime" and cols["at"]["num_unique"] == 3
    assert cols["items"]["inferred_type"] == "unsupported" or cols["items"]["num_unique"] == 3
    assert cols["flat"]["std_dev"] == 0.0 and cols["flat"]["skewness"] == 0.0
    assert cols["tiny"]["decimals"] == 4 and cols["fine"]["decimals"] == 4 and cols["flat"]["decimals"] == 1


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([(5, "a")], "x_id long, y string")
    cols = by_column(fs.profile_table(one))
    assert cols["x_id"]["std_dev"] == 0.0 and cols["x_id"]["is_primary_key"]
    empty = one.where("x_id > 9")
    with pytest.raises(fs.EmptyTableError):
        fs.fidelity_run(empty)
    assert fs.scan_privacy(empty).count() == 0
    assert fs.profile_table(empty).meta.first()["num_rows"] == 0


def test_long_integers_stay_apart(spark):
    big = 1 << 60
    df = spark.createDataFrame([(big + i, float(i)) for i in range(20)], "hash long, v double")
    col = by_column(fs.profile_table(df))["hash"]
    assert col["num_unique"] == 20 and col["is_primary_key"]
    rho = {(r["col_a"], r["col_b"]): r["rho"] for r in spearman(df, ["hash", "v"]).collect()}
    assert rho["hash", "v"] == pytest.approx(1.0)


def test_spearman_matches_pandas_with_gaps_and_constants(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 12, (200, 4)).astype(float), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf.loc[pdf.index % 3 == 0, "a"] = np.nan
    pdf.loc[pdf.index % 5 == 1, "c"] = np.nan
    pdf["same"] = pdf["a"] * 2
    pdf["flat"] = 4.0
    expected = pdf.corr(method="spearman").fillna(0)
    for r in spearman(spark.createDataFrame(pdf), list(pdf.columns)).collect():
        assert r["rho"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]], abs=1e-9), r


def test_shuffled_lookup_agrees_with_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": np.where(rng.random(900) < 0.4, 7.0, rng.normal(size=900)), "b": rng.normal(size=900)})
    pdf["c"] = pdf["a"] + pdf["b"]
    pdf.loc[pdf.index % 4 == 0, "b"] = np.nan
    pdf["g"] = np.where(rng.random(900) < 0.3, "x", "y")
    df = spark.createDataFrame(pdf)
    figures = lambda: {(r["grp"], r["col_a"], r["col_b"]): r["rho"] for r in spearman(df, list("abc"), "g").collect()}
    small = figures()
    monkeypatch.setattr("facsimile.operators.correlation.SMALL_BYTES", 0)
    large = figures()
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k], abs=1e-12) for k in small)
    assert small["=x", "a", "c"] == pytest.approx(pdf[pdf.g == "x"][["a", "c"]].corr(method="spearman").iloc[0, 1])


def test_hundred_columns_with_gaps(spark):
    """Every column with gaps of its own; the plan has as many exchanges as for three columns."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(120, 100)).round(1), columns=[f"c{i}" for i in range(100)])
    pdf += rng.normal(size=(120, 1))
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    df = spark.createDataFrame(pdf)
    ranks = spearman(df, list(pdf.columns))
    for found, expected in ((ranks, pdf.corr(method="spearman")), (pearson(df, list(pdf.columns)), pdf.corr())):
        rows = found.collect()
        assert len(rows) == 10_000
        got = pd.DataFrame([r.asDict() for r in rows]).pivot(index="col_a", columns="col_b", values="rho")
        assert np.allclose(got.loc[pdf.columns, pdf.columns], expected, atol=1e-9)
    exchanges = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(spearman(df, list(pdf.columns[:20]))) == exchanges(spearman(df, ["c0", "c1", "c2"]))


def test_moments_merge(spark):
    """Parts far apart, in many tasks, and groups; figures as pandas has them."""
    rng = np.random.default_rng(9)
    x = np.concatenate([1e8 + rng.normal(size=400), rng.gamma(2, size=300)])
    pdf = pd.DataFrame({"x": x, "y": x * 0 + 2.5, "g": np.where(np.arange(700) < 650, "a", "b"), "t": [None, "s"] * 350})
    df = spark.createDataFrame(pdf).repartitionByRange(9, "x")
    found = {(r.grp, r.cid): r for r in columns.moments(df, "g").collect()}
    assert found["", columns.ROWS].n == 700 and found["=b", columns.ROWS].n == 50 and found["", 3].n == 350
    for grp, part in (("", pdf), ("=a", pdf[pdf.g == "a"]), ("=b", pdf[pdf.g == "b"])):
        r = found[grp, 0]
        assert r.m2 == pytest.approx(((part.x - part.x.mean()) ** 2).sum(), rel=1e-9)
        assert r.mean == pytest.approx(part.x.mean()) and (r.lo, r.hi) == (part.x.min(), part.x.max())
        assert found[grp, 1].m2 == 0
    plan = columns.moments(df, None)._jdf.queryExecution().executedPlan().toString()
    assert "partial_skewness" in plan or "partial_" in plan


def test_three_reads_per_profile(spark, tmp_path):
    """A table of numbers and texts is scanned three times: for moments, for numbers and for texts."""
    df = spark.range(200).select(F.col("id"), (F.col("id") % 7).alias("v"), F.col("id").cast("string").alias("s"))
    df.write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    source = spark.read.parquet(str(tmp_path / "t")).coalesce(1)
    fs.profile_table(source.mapInArrow(counted, source.schema), conditional_by="v")
    assert reads.value == 3


def test_groups(spark):
    rows = [("n", 1.0), ("n", 2.0), ("s", 10.0), ("s", None), (None, 50.0)]
    p = fs.profile_table(spark.createDataFrame(rows, "side string, v double"), conditional_by="side")
    assert {r["grp"]: r["num_rows"] for r in p.meta.collect()} == {"": 5, "=n": 2, "=s": 2}
    assert by_column(p)["v"]["mean"] == 15.75
    assert by_column(p, "=s")["v"]["missing_count"] == 1 and by_column(p, "=n")["v"]["mean"] == 1.5
    ignored = fs.profile_table(spark.createDataFrame(rows, "side string, v double"), conditional_by="nowhere")
    assert ignored.meta.count() == 1


def test_outlier_cap_changes_only_the_range(spark):
    df = spark.createDataFrame([(float(v),) for v in list(range(20)) + [1000]], "v double")
    plain, capped = (by_column(fs.profile_table(df, auto_clean_outliers=c))["v"] for c in (False, True))
    assert capped["max_value"] == plain["q3"] + 1.5 * plain["iqr"] < plain["max_value"]
    assert capped["mean"] == plain["mean"] and capped["skewness"] == plain["skewness"]


def test_noise_leaves_no_sample_and_is_repeatable(spark):
    df = spark.range(500).select((F.col("id") * 1.37).alias("v"), F.when(F.col("id") < 200, "a").otherwise("b").alias("c"))
    first, second = (fs.profile_table(df, epsilon=1.0, seed=5) for _ in range(2))
    assert first.sample.count() == 0
    assert by_column(first)["v"]["mean"] == by_column(second)["v"]["mean"] != 1.37 * 249.5
    assert sum(r["frequency"] for r in first.frequencies.collect()) == pytest.approx(1.0)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.1), (2, "b", None), (3, "a", 1 / 3)], "k_id long, s string, v double")
    before = fs.profile_table(df)
    for kind in ("json", "parquet"):
        fs.save_profile(before, str(tmp_path / kind), kind)
        after = fs.load_profile(spark, str(tmp_path / kind), kind)
        for part in ("meta", "columns", "histogram", "sample", "frequencies", "correlations", "warnings"):
            a = getattr(before, part)
            assert sorted(map(str, a.collect())) == sorted(map(str, getattr(after, part).select(*a.columns).collect()))
        same = lambda p: sorted(map(str, fs.generate_table(p, 20).collect()))
        assert same(before) == same(after)


def test_csv_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,v,flag,s\n1,NA,True,"a, b"\n2,2.5,False,null\n3,,True,N/A\n')
    df = fs.read_table(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, True, "a, b"), (2, 2.5, False, None), (3, None, True, None)]


def test_privacy(spark):
    df = spark.createDataFrame(
        [(1, "a@b.com", 20, "A"), (2, "c@d.com", 25, "B"), (3, "e@f.com", 30, "C"), (4, "g@h.com", 35, "D")],
        "customer_id int, user_email string, age int, high_cardinality_cat string")
    direct = {r["column_name"]: r for r in fs.scan_privacy(df).collect()}
    profiled = {r["column_name"]: r for r in fs.profile_table(df).warnings.collect()}
    assert direct == profiled
    assert direct["customer_id"]["warning_level"] == "WARNING" and "identifier heuristic" in direct["customer_id"]["reason"]
    assert direct["user_email"]["warning_level"] == "WARNING" and direct["age"]["warning_level"] == "SAFE"
    assert direct["high_cardinality_cat"]["warning_level"] == "HIGH-CARDINALITY"
    assert "100%" in direct["high_cardinality_cat"]["reason"]


def test_two_decimals_round_as_printf(spark):
    from facsimile.functions.estimators import two_decimals

    ratios = [(a, b) for b in (7, 8, 40, 200, 1000) for a in range(0, b + 1, 3)]
    df = spark.createDataFrame([(a / b, f"{a / b:.2f}") for a, b in ratios], "x double, text string")
    assert df.where(F.format_string("%.2f", two_decimals(F.col("x"))) != F.col("text")).count() == 0


def test_noisy_histograms_share_counts_and_rank_nothing(spark, tmp_path):
    from catalog import inputs

    spark.range(400).selectExpr("id AS l_orderkey", "id % 7 AS l_discount", "id % 3 AS l_tax", "'A' AS l_returnflag").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    noisy = inputs.profiler(spark, str(tmp_path), "lineitem_gaps", epsilon=1.0)
    plain = inputs.profiler(spark, str(tmp_path), "lineitem_gaps")
    assert noisy.epsilon == 1.0 and plain.epsilon is None
    bins = noisy.histogram.count()
    # the one that came first has counted for both, and only what a histogram needs
    assert bins == plain.histogram.count() and noisy.values is plain.values and noisy.numbers is plain.numbers
    for step in ("correlations", "labels", "label_totals"):
        assert step not in plain.__dict__ and step not in noisy.__dict__
    assert noisy.stats is not plain.stats


def test_gaps_are_counted_without_looking_at_full_columns(spark, monkeypatch):
    from facsimile.operators import correlation
    from facsimile.operators.gram import common_counts

    rows = [tuple(None if c and r % (c + 1) == 0 else float(r) for c in range(5)) for r in range(60)] + [(1.0, None, None, 2.0, 3.0)] * 2
    full = [(*r, float(i), float(-i)) for i, r in enumerate(rows)]
    sent = []
    monkeypatch.setattr(correlation, "common_counts", lambda df: sent.append(df.columns) or common_counts(df))
    for most in (10, 2):  # by sets of present columns, then by matrices
        monkeypatch.setattr(correlation, "MASK_COLUMNS", most)
        for data, k in ((full, 7), (full[:1], 7), ([], 3)):
            df = spark.createDataFrame([r[:k] for r in data], ", ".join(f"v{i} double" for i in range(k)))
            want = {(i, j): sum(r[i] is not None and r[j] is not None for r in data) for i in range(k) for j in range(i, k)}
            assert correlation._present_together(df, k) == want
    assert sent and all(c == [f"v{i}" for i in (1, 2, 3, 4)] for c in sent)
    full_only = spark.createDataFrame([(float(i), float(i)) for i in range(9)], "v0 double, v1 double")
    assert correlation.gap_patterns(full_only, 2) == correlation.Gaps({}, [0, 0])
