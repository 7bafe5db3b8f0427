import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import facsimile as fs
from facsimile.functions.hashed import normal_cdf, normal_quantile, normal_tail, permuted, uniform
from facsimile.operators.correlation import spearman


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_same_seed_same_rows(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "B"), (5, "C")], "val long, cat string")
    p = fs.profile_table(df)
    assert rows_of(fs.generate_table(p, 10, 42)) == rows_of(fs.generate_table(p, 10, 42, partitions=1))
    assert rows_of(fs.generate_table(p, 10, 42)) != rows_of(fs.generate_table(p, 10, 43))
    assert fs.generate_table(p, 10).columns == ["val", "cat"]


def test_range_is_kept(spark):
    p = fs.profile_table(spark.createDataFrame([(10,), (20,), (20,)], "val long"))
    p = p.replaced(columns=p.columns.withColumn("std_dev", F.lit(1000.0)))
    low, high = fs.generate_table(p, 100).agg(F.min("val"), F.max("val")).first()
    assert low >= 10 and high <= 20


def test_gaps_precision_and_types(spark):
    rows = [(i, None if i % 4 == 0 else i * 0.25, None if i % 5 == 0 else i % 3 == 0, None, "u" if i % 10 else None) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "row_key long, v double, b boolean, nothing string, s string")
    g = fs.generate_table(fs.profile_table(df), 1000).toPandas()
    assert sorted(g["row_key"]) == [float(i) for i in range(1, 1001)]
    assert g["v"].isna().sum() == 250 and g["b"].isna().sum() == 200 and g["s"].isna().sum() == 100
    assert g["nothing"].isna().all() and set(g["s"].dropna()) == {"u"}
    assert (g["v"].dropna().round(2) == g["v"].dropna()).all()


def test_constant_has_no_gaps(spark):
    df = spark.createDataFrame([(3.5,), (3.5,), (None,)], "v double")
    assert {r["v"] for r in fs.generate_table(fs.profile_table(df), 30).collect()} == {3.5}


def test_correlated_key_and_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=1500)
    pdf = pd.DataFrame({"seq_id": np.arange(1500), "a": np.arange(1500) / 100 + rng.normal(size=1500), "b": x, "c": -x + rng.normal(size=1500)})
    p = fs.profile_table(spark.createDataFrame(pdf))
    g = fs.generate_table(p, 4000, rank_exact=True)
    got, want = g.toPandas().corr(method="spearman"), pdf.corr(method="spearman")
    assert np.abs(got.loc[want.index, want.columns] - want).to_numpy().max() < 0.07
    assert sorted(r["seq_id"] for r in g.collect()) == [float(i) for i in range(1, 4001)]


def test_two_numeric_keys(spark):
    pdf = pd.DataFrame({"a_id": np.arange(60), "b_id": np.arange(60) * 2 + 5, "v": np.arange(60) * 1.5})
    g = fs.generate_table(fs.profile_table(spark.createDataFrame(pdf)), 200).toPandas()
    for key in ("a_id", "b_id"):
        assert sorted(g[key]) == [float(i) for i in range(1, 201)]
    assert g.corr(method="spearman").loc["a_id", "b_id"] > 0.95


def test_groups(spark):
    rows = [("n", i, float(i % 50)) for i in range(300)] + [("s", 1000 + i, 500.0 + i % 50) for i in range(100)] + [(None, 5000 + i, -1.0 * i) for i in range(100)]
    df = spark.createDataFrame(rows, "side string, row_id long, v double")
    p = fs.profile_table(df, conditional_by="side")
    g = fs.generate_table(p, 1000).toPandas()
    assert sorted(g["row_id"]) == [float(i) for i in range(1, 1001)]
    assert g["side"].isna().sum() == 200
    assert g[g.side == "n"]["v"].between(0, 49).all() and g[g.side == "s"]["v"].between(500, 549).all()
    assert 500 < (g.side == "n").sum() < 700


def test_numeric_group_column_leaves_all_rows_ungrouped(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(40)], "g int, v double")
    g = fs.generate_table(fs.profile_table(df, conditional_by="g"), 50).toPandas()
    assert len(g) == 50 and g["g"].isna().all() and g["v"].notna().all()


def test_many_categories_agree_with_few(spark, monkeypatch):
    rows = [(f"hot{i % 3}",) for i in range(600)] + [(f"v{i % 250}",) for i in range(500)] + [(f"one{i}",) for i in range(400)]
    p = fs.profile_table(spark.createDataFrame(rows, "s string"))
    monkeypatch.setattr("facsimile.operators.draws.SMALL_ROWS", 10)
    drawn = fs.generate_table(p, 30000).groupBy("s").count().toPandas().set_index("s")["count"] / 30000
    true = {r["value"]: r["frequency"] for r in p.frequencies.collect()}
    assert drawn.sum() == pytest.approx(1.0) and set(drawn.index) <= set(true) and len(drawn) > 600
    assert max(abs(drawn.get(v, 0.0) - f) for v, f in true.items()) < 0.015


def test_noisy_weights_that_all_differ(spark, monkeypatch):
    rows = [(f"hot{i % 3}",) for i in range(600)] + [(f"v{i % 250}",) for i in range(1500)]
    p = fs.profile_table(spark.createDataFrame(rows, "s string"), epsilon=1.0)
    monkeypatch.setattr("facsimile.operators.draws.SMALL_ROWS", 10)
    drawn = fs.generate_table(p, 30000).groupBy("s").count().toPandas().set_index("s")["count"] / 30000
    true = {r["value"]: r["frequency"] for r in p.frequencies.collect()}
    assert len({r["weight"] for r in p.frequencies.collect()}) > 200
    assert drawn.sum() == pytest.approx(1.0) and set(drawn.index) <= set(true)
    assert max(abs(drawn.get(v, 0.0) - f) for v, f in true.items()) < 0.015


def test_long_texts_meet_rows_in_a_shuffle(spark):
    """A third of the rows hold one text of 100 kB; by its bytes the table is too large for a broadcast."""
    word = F.when(F.col("id") < 100, "long ").when(F.col("id") < 280, F.format_string("%05d", F.col("id") % 150))
    p = fs.profile_table(spark.range(300).select(F.repeat(word, 20_000).alias("s")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = fs.generate_table(p, 1500)
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        count = {r.word: r["count"] for r in out.groupBy(F.substring("s", -5, 5).alias("word"), F.length("s").alias("n")).count().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(count.values()) == 1500 and count[None] == 100 and len(count) > 120
    assert count["long "] / 1400 == pytest.approx(100 / 280, abs=0.05)


def test_made_up_values(spark):
    df = spark.createDataFrame([(f"p{i}@real.org", f"Real {i}", "+1", "note") for i in range(30)], "email string, full_name string, phone string, memo string")
    g = fs.generate_table(fs.profile_table(df, smart_pii=True), 200).toPandas()
    assert g["email"].str.endswith("@example.com").all() and not g["full_name"].str.startswith("Real").any()
    assert set(g["memo"]) == {"note"}


def test_impose_rank_correlation(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.lognormal(size=2000), "b": rng.integers(0, 9, 2000).astype(float), "t": ["x"] * 2000})
    pdf.loc[pdf.index % 10 == 0, "a"] = np.nan
    out = fs.impose_rank_correlation(spark.createDataFrame(pdf), ["a", "b"], [[1, 0.8], [0.8, 1]]).toPandas()
    assert sorted(out["a"].dropna()) == sorted(pdf["a"].dropna()) and sorted(out["b"]) == sorted(pdf["b"])
    assert out["a"].isna().sum() == 200 and out[["a", "b"]].corr(method="spearman").iloc[0, 1] == pytest.approx(0.78, abs=0.05)


def test_impose_rank_correlation_keeps_values_and_layout(spark):
    from decimal import Decimal

    rows = [((1 << 53) + 2 * i + 1, Decimal(i) / 100 + Decimal("12345678901234567.01"), float(i % 5), "same") for i in range(60)]
    df = spark.createDataFrame(rows * 2, "`wide.id` bigint, cents decimal(20,2), few double, t string")
    impose = lambda d: fs.impose_rank_correlation(d, ["wide.id", "cents", "few"], [[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]])
    out = impose(df)
    assert out.schema == df.schema
    for i in range(3):
        assert sorted(r[i] for r in out.collect()) == sorted(r[i] for r in df.collect())
    one, eight = (sorted(map(tuple, impose(df.repartition(p)).collect())) for p in (1, 8))
    assert one == eight


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 5, 97, 1000, 4096):
        seen = spark.range(n).select(permuted(F.col("id"), F.lit(n), "t", 3).alias("p")).distinct()
        assert seen.agg(F.min("p"), F.max("p"), F.count("p")).first() == (0, n - 1, n)
    for size in (1 << 36, 1 << 45, (1 << 45) + 12_345):  # large positions without overflow
        got = spark.range(size - 500, size).select(permuted(F.col("id"), F.lit(size), "t", 3).alias("p")).agg(
            F.min("p"), F.max("p"), F.count_distinct("p")).first()
        assert 0 <= got[0] and got[1] < size and got[2] == 500


def test_permutations_are_independent(spark):
    """Joint counts of two permutations' first tenths, for names whose letters have one weighted sum."""
    n, tags = 60_000, ["high", "name", "length", "rating", "month", "quota"]
    table = spark.range(n).select(*[(permuted(F.col("id"), F.lit(n), f"gap/{t}", 3) < n // 10).alias(t) for t in tags])
    pairs = [(a, b) for i, a in enumerate(tags) for b in tags[:i]]
    got = table.agg(*[F.count_if(F.col(a) & F.col(b)) for a, b in pairs], *[F.count_if(F.col(t)) for t in tags]).first()
    assert all(c == n // 10 for c in got[len(pairs):])
    assert all(abs(c - n / 100) < 5 * (n * 0.1 * 0.1 * 0.9 * 0.9) ** 0.5 for c in got[:len(pairs)])


def test_tails_of_bells(spark):
    from statistics import NormalDist

    from facsimile.operators.marginals import with_bell_draw

    unit = NormalDist()
    points = [-8.0, -5.0, -1.0, 0.0, 2.0, 6.0]
    got = spark.createDataFrame([(z,) for z in points], "z double").select(normal_tail(F.col("z"))).collect()
    for z, (p,) in zip(points, got):
        assert p == pytest.approx(unit.cdf(-z), rel=1e-6)
    none = F.lit(None).cast("double")
    for z in points:
        row = spark.createDataFrame([(unit.cdf(z), z)], "u double, z double")
        for name, low, high, at in (("open", none, none, F.col("z")), ("cut", F.lit(5.0), F.lit(11.0), F.col("z")),
                                    ("even", F.lit(5.0), F.lit(11.0), None)):
            row = with_bell_draw(row, name, F.col("u"), at, F.lit(10.0), F.lit(2.0), low, high)
        row = row.select("open", "cut", "even").first()
        assert row[0] == pytest.approx(10 + 2 * z, abs=1e-9)
        a, b = unit.cdf(-2.5), unit.cdf(0.5)
        expected = 10 + 2 * unit.inv_cdf(a + unit.cdf(z) * (b - a))
        assert row[1] == pytest.approx(expected, abs=1e-5) and row[2] == pytest.approx(expected, abs=1e-5)


def test_density_curve_follows_the_kernels():
    from statistics import NormalDist

    from facsimile.operators.marginals import density_curve, knot_places

    points = np.random.default_rng(0).normal(5, 3, 400)
    steps = np.array(knot_places())
    curve = density_curve(points, steps)
    width = points.std(ddof=1) * 400 ** -0.2
    assert (np.diff(curve) >= 0).all() and (np.diff(steps) > 0).all()
    for k in (12, 50, 83, len(steps) // 2, len(steps) - 90, len(steps) - 50):
        cdf = np.mean([NormalDist(x, width).cdf(curve[k]) for x in points])
        sf = np.mean([NormalDist(-x, width).cdf(-curve[k]) for x in points])
        assert cdf == pytest.approx(steps[k], rel=0.02) and sf == pytest.approx(1 - steps[k], rel=0.02)


def test_random_expressions(spark):
    df = spark.range(100000).select(uniform("t", 1, F.col("id")).alias("u"))
    u = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.variance("u")).first()
    assert 0 < u[0] and u[1] < 1 and u[2] == pytest.approx(0.5, abs=0.01) and u[3] == pytest.approx(1 / 12, abs=0.002)
    from statistics import NormalDist

    points = [0.0005, 0.01, 0.3, 0.5, 0.77, 0.999]
    got = spark.createDataFrame([(p,) for p in points], "p double").select(
        normal_quantile(F.col("p")), normal_cdf(normal_quantile(F.col("p")))).collect()
    for p, (z, back) in zip(points, got):
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-6) and back == pytest.approx(p, abs=1e-6)


def test_knots_by_arithmetic(spark):
    """Draws between the knots follow the kernels' distribution, in the middle, in both tails and across a gap."""
    from statistics import NormalDist

    from facsimile.operators.marginals import density_curve, knot_places, monotone_slopes, with_knot_draw

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 1, 300), rng.normal(40, 2, 200)])
    steps = np.array(knot_places())
    knots = density_curve(points, steps)
    slopes = monotone_slopes(steps, knots)
    assert len(steps) == len(set(steps)) == 2 * 84 + 255 and (slopes >= 0).all()
    u = sorted([2.0**-52, 3e-15, 1e-9, 1e-5, 0.003, 1 / 256, 0.1234, 0.55, 0.9, 255 / 256, 0.999, 1 - 1e-6, 1 - 1e-12,
                *steps[::31], *rng.random(200)])
    df = spark.createDataFrame([(float(x),) for x in u], "u double").coalesce(1)
    arrays = [F.lit(x.tolist()) for x in (knots, slopes)]
    got = [r.v for r in with_knot_draw(df, "u", *arrays, "v").collect()]
    assert (np.diff(got) >= 0).all()
    assert np.interp(steps[::31], u, got) == pytest.approx(knots[::31], rel=1e-5)  # 1 - u has few digits at the far end
    width = points.std(ddof=1) * len(points) ** -0.2
    for x, value in zip(u, got):
        cdf = np.mean([NormalDist(p, width).cdf(value) for p in points])
        assert abs(cdf - x) < 1e-3 and (x > 0.1 or x < 1e-13 or cdf == pytest.approx(x, rel=0.03))


@pytest.fixture(scope="module")
def many_groups(spark):
    """A thousand groups and one that holds half of the rows, with a column drawn from its density."""
    df = spark.range(24_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 2001).cast("string"))).alias("g"),
        (F.pow(F.rand(3) + 0.1, F.lit(2.0)) * F.when(F.col("id") % 2 == 0, 100).otherwise(1)).alias("v"))
    return fs.profile_table(df, conditional_by="g")


def test_many_groups_without_a_shuffle(spark, many_groups):
    table = fs.generate_table(many_groups, 20_000, seed=3)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(j in plan for j in ("SortMergeJoin", "ShuffledHashJoin", "Exchange range"))
    g = table.toPandas()
    assert g["g"].nunique() > 900 and 9_500 < (g["g"] == "hot").sum() < 10_500 and g["v"].notna().all()
    real = many_groups.columns.where("column_name = 'v' AND grp = '=hot'").first()
    hot = g[g["g"] == "hot"]["v"]
    assert hot.median() == pytest.approx(real["median"], rel=0.1)
    assert hot.between(real["min_value"] - 1e-4, real["max_value"] + 1e-4).all()  # four decimals are kept


def test_large_groups_are_split(spark, many_groups, monkeypatch):
    """Beyond the size for a broadcast, rows and values stay the same and no task gets much more than others."""
    from facsimile.plans import generate

    small = rows_of(fs.generate_table(many_groups, 20_000, seed=3))
    monkeypatch.setattr(generate, "SMALL_BYTES", 0)
    before = [spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(fs.generate_table(many_groups, 20_000, seed=3)) == small
        maker = generate.Generator(many_groups, 20_000, 3)
        side, _ = maker._parameters()
        rows = maker._with_parameters(maker.rows(), side)
        sizes = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 20_000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_normal_query_draws_its_table_once(spark, monkeypatch):
    """What the law is held against is a staged table, so no filter takes the draw's expression into itself."""
    from catalog import generating

    class Seen(Exception):
        pass

    def look(table, *rest):
        raise Seen(table._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(generating, "_law_distance", look)
    monkeypatch.setattr(generating, "load", lambda *a: spark.range(50))
    monkeypatch.setattr(generating, "profile", lambda *a, **o: fs.profile_table(
        spark.range(50).select((F.col("id") * 1.0).alias("l_extendedprice")), epsilon=1e9))
    with pytest.raises(Seen) as seen:
        generating.g7(spark, "")
    assert "Range" not in str(seen.value)


def test_layouts_grow_with_the_rows():
    """No layout that the determinism query compares is one task of all rows, but for a small table."""
    from catalog.generating import LAYOUT_ROWS, layout

    assert layout(0) == layout(LAYOUT_ROWS) == 1 and layout(9_000_000) == 36


def test_permutation_by_steps(spark):
    """The compiled steps give the places of the one expression, those beyond the grid's rest included, per group too."""
    from facsimile.functions.hashed import with_permuted

    for n in (1, 2, 7, 400, 9_999, 10_001):
        df = with_permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("bigint"), "t", 3)
        df = df.withColumn("q", permuted(F.col("id"), F.lit(n).cast("bigint"), "t", 3))
        assert tuple(df.agg(F.count_if(F.col("p") != F.col("q")), F.count_distinct("p"), F.max("p")).first()) == (0, n, n - 1)
    groups = spark.range(3_000).select((F.col("id") % 50 + 1).alias("size"), F.expr("id div 50").alias("idx"))
    groups = groups.where("idx < size").withColumn("grp", F.col("size").cast("string"))
    df = with_permuted(groups, "p", F.col("idx"), F.col("size"), "t", 3, F.col("grp"))
    assert df.where(F.col("p") != permuted(F.col("idx"), F.col("size"), "t", 3, F.col("grp"))).count() == 0
    assert df.select("grp", "p").distinct().count() == groups.count()


def _mixed(spark):
    return spark.range(600).select(
        F.concat(F.lit("t"), (F.col("id") * 7 % 300).cast("string")).alias("label"),
        (F.sqrt("id") + F.col("id") % 11 / 7).alias("a"), (F.col("id") * F.col("id") % 997 / 8).alias("b"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("part"))


@pytest.mark.parametrize("by", [None, "part"])
def test_no_shuffle_carries_arrays(spark, monkeypatch, by):
    """Texts too large for a broadcast are met in a shuffle; arrays of knots have ended before it."""
    from facsimile.operators import draws

    monkeypatch.setattr(draws, "SMALL_BYTES", 0)
    p = fs.profile_table(_mixed(spark), conditional_by=by)
    table = fs.generate_table(p, 600)
    joins, todo, carried = 0, [table._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        todo += children
        if node.nodeName() == "Join" and "_nth" in node.toString().split("\n")[0]:
            joins += 1
            carried.append("knots_" in children[0].output().mkString())
    assert joins and not any(carried)


def test_noise_shares_the_counts(spark):
    """Noise comes after all counting: a profile with noise reads the staged counts of one without, and is what a new one gives."""
    from facsimile import Profiler

    plain = Profiler(_mixed(spark))
    plain.run()
    shared, alone = plain.noised(2.0), Profiler(_mixed(spark), epsilon=2.0)
    assert shared.values is plain.values and shared.numbers is plain.numbers and shared.correlations is plain.correlations
    a, b = shared.run(), alone.run()
    for part in ("columns", "histogram", "sample", "frequencies", "meta"):
        x, y = getattr(a, part), getattr(b, part)
        columns = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes]
        assert x.select(columns).exceptAll(y.select(columns)).count() == 0 == y.select(columns).exceptAll(x.select(columns)).count()


def test_distance_at_many_points_is_one_search_a_row(spark, monkeypatch):
    from catalog.generating import _points_distance

    rng = np.random.default_rng(5)
    values = np.concatenate([np.round(rng.gamma(2.0, size=3000), 2), [math.nan, -0.0, 0.0]])
    points = [0.0, 0.0, *np.sort(np.round(rng.gamma(2.0, size=3000), 2))]
    law = [float(x) for x in np.linspace(0, 1, len(points))]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 7, "v double").repartition(3)
    kind, widest = type(df), []
    plain = kind.agg
    monkeypatch.setattr(kind, "agg", lambda self, *columns: widest.append(len(columns)) or plain(self, *columns))
    expected = max(abs((values <= x).sum() / len(values) - p) for x, p in zip(points, law)) * len(values) ** 0.5
    assert _points_distance(df, "v", points, law) == pytest.approx(expected, rel=1e-12)
    assert max(widest, default=0) < 10


def test_impose_rank_correlation_writes_rows_once(spark, monkeypatch):
    import glob
    import os

    from facsimile.operators import copula
    from facsimile.sources.staging import run, staging_root

    monkeypatch.setattr(copula, "BLOCK", 7, raising=False)  # values reach over several blocks of ranks, and blocks hold several values
    rng = np.random.default_rng(8)
    a = [None if i % 9 == 0 else float(v) for i, v in enumerate(np.round(rng.normal(size=300), 2))]
    b = [float(v) for v in rng.choice([-0.0, 0.0, 0.0, 1.0, math.inf], 300)]
    rows = [(x, y, int(i % 4), "t" * (i % 3)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c int, t string").repartition(5)
    with run(spark):
        before = set(glob.glob(f"{staging_root(spark)}/run-*/*"))
        out = fs.impose_rank_correlation(df, ["a", "b", "c"], [[1, 0.7, 0], [0.7, 1, 0], [0, 0, 1]]).collect()
        staged = sorted(os.path.basename(f).rsplit("-", 1)[0] for f in set(glob.glob(f"{staging_root(spark)}/run-*/*")) - before)
    shown = lambda values: sorted(map(repr, values))  # noqa: E731  -0.0 is not 0.0
    for i in range(4):
        assert shown(r[i] for r in out) == shown(r[i] for r in rows)
    assert shown(r["t"] for r in out if r["a"] is None) == shown(r[3] for r in rows if r[0] is None)
    assert staged == ["imposed", "rows"]
