"""Generation. Output is random, so each query states facts about it that must hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.inputs import LINEITEM_NUMBERS, load, profile, profiler, sql_input, synthetic
from catalog.profiling import BINS, GAPS, STATS, _spearman_sql
from catalog.registry import query, rounded
from facsimile import generate_table, impose_rank_correlation, profile_table, write_table
from facsimile.functions.hashed import normal_cdf
from facsimile.operators.comparison import ks_statistics, paired_values
from facsimile.operators.copula import target_matrix
from facsimile.operators.correlation import spearman
from facsimile.operators.marginals import strategies
from facsimile.plans.generate import Generator
from facsimile.sources.staging import stage, staging_root, sweep

# Noise this weak leaves every statistic as it is but keeps raw values out of the profile.
WEAK = 1e9


def _share_gaps(drawn, expected, keys):
    """Largest distance between drawn and expected shares of each value, per key."""
    both = drawn.join(expected, [*keys, "value"], "full")
    apart = F.abs(F.coalesce("drawn", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0)))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("expected").isNull()).alias("foreign_values"), F.max(apart).alias("gap"))


def _law_distance(table, column, cdf, cells=512):
    """(n, ks): largest distance of the drawn shares from the law ``cdf`` (a Spark expression), times sqrt(n).

    Probabilities are counted in even cells, which bounds the exact Kolmogorov-Smirnov figure from below.
    """
    at = F.least(F.floor(cdf * cells), F.lit(cells - 1))
    counted = table.where(F.col(column).isNotNull()).groupBy(F.greatest(at, F.lit(0)).alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    laid = counted.select("cell", F.sum("k").over(Window.orderBy("cell")).alias("up_to"), F.sum("k").over(Window.partitionBy()).alias("n"))
    edges = table.sparkSession.range(cells).withColumnRenamed("id", "cell").join(laid, "cell", "left").select(
        "cell", F.last("up_to", True).over(Window.orderBy("cell")).alias("up_to"), F.max("n").over(Window.partitionBy()).alias("n"))
    apart = F.abs(F.coalesce("up_to", F.lit(0)) / F.col("n") - (F.col("cell") + 1) / cells)
    return edges.agg(F.max("n").alias("n"), (F.max(apart) * F.sqrt(F.max("n"))).alias("ks")).first()


def _points_distance(table, column, points, law):
    """The same at given points, where the law's distribution function has the values ``law``.

    Each value is counted once, between the two points where it lies: a row costs one search, however many points there are.
    """
    import numpy as np

    edges = np.sort(np.array(points, dtype=float))

    def between(batches):
        import pyarrow as pa

        counts = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False)), minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["cell", "k"])

    values = table.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    counts = np.zeros(len(edges) + 1, dtype=np.int64)
    for r in values.mapInArrow(between, "cell bigint, k bigint").groupBy("cell").agg(F.sum("k").alias("k")).collect():
        counts[r["cell"]] = r["k"]
    up_to, n = np.cumsum(counts), int(counts.sum())
    return max(abs(int(up_to[np.searchsorted(edges, float(x))]) / n - p) for x, p in zip(points, law)) * n ** 0.5


# A Kolmogorov-Smirnov distance beyond 2.2 / sqrt(n) has a chance of 1e-4 under the law; seeds are fixed.
KS_BOUND = 2.2


@query("s4_write_table", """
SELECT 'csv' AS format, count(*) AS num_rows, count(DISTINCT c_custkey) AS keys, CAST(9 AS INTEGER) AS columns FROM customer
UNION ALL SELECT 'parquet', count(*), count(DISTINCT c_custkey), 9 FROM customer""")
def s4(spark, sf_dir):
    from uuid import uuid4

    table = synthetic(spark, sf_dir, "customer_gaps")
    result = None
    for kind in ("csv", "parquet"):
        path = f"{staging_root(spark)}/out-{uuid4().hex}.{kind}"
        write_table(table, path, kind)
        back = spark.read.format(kind).option("header", True).load(path)
        part = back.agg(F.count(F.lit(1)).alias("num_rows"), F.count_distinct("c_custkey").alias("keys"))
        part = part.select(F.lit(kind).alias("format"), "num_rows", "keys", F.lit(len(back.columns)).alias("columns"))
        result = part if result is None else result.unionByName(part)
    return result


@query("g1_primary_key", """
SELECT count(*) AS num_rows, CAST(1 AS DOUBLE) AS first_key, CAST(count(*) AS DOUBLE) AS last_key, count(*) AS numeric_keys,
  count(*) AS text_keys, CAST(0 AS BIGINT) AS misshapen FROM customer""")
def g1(spark, sf_dir):
    return synthetic(spark, sf_dir, "customer_gaps").agg(
        F.count(F.lit(1)).alias("num_rows"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"),
        F.count_distinct("c_custkey").alias("numeric_keys"), F.count_distinct("name_key").alias("text_keys"),
        F.count_if(~F.col("name_key").rlike("^ID-[0-9]+$")).alias("misshapen"))


@query("g2_constant", """
SELECT count(*) AS num_rows, CAST(7.5 AS DOUBLE) AS lowest, CAST(7.5 AS DOUBLE) AS highest, count(*) AS present FROM customer""")
def g2(spark, sf_dir):
    return synthetic(spark, sf_dir, "customer_gaps").agg(
        F.count(F.lit(1)).alias("num_rows"), F.min("flat_rate").alias("lowest"), F.max("flat_rate").alias("highest"),
        F.count("flat_rate").alias("present"))


@query("g3_density", """
SELECT count(value) AS drawn, true AS in_range, true AS follows_the_law FROM events""")
def g3(spark, sf_dir):
    from statistics import NormalDist

    import numpy as np

    p = profiler(spark, sf_dir, "events")
    own = profile(spark, sf_dir, "events")
    low, high = p.stats.where("column_name = 'value'").select("min_value", "max_value").first()
    sample = np.array([r[0] for r in own.sample.where("column_name = 'value'").select("value").collect()])
    width = sample.std(ddof=1) * len(sample) ** -0.2
    kernel = NormalDist(0, width)
    # inside the range, as what lies beyond is put on its ends
    points = np.quantile(sample, np.linspace(0.01, 0.99, 60))
    law = [float(np.mean([kernel.cdf(x - v) for v in sample])) for x in points]
    table = synthetic(spark, sf_dir, "events")
    distance = _points_distance(table, "value", points, law)
    return table.agg(
        F.count("value").alias("drawn"), ((F.min("value") >= low) & (F.max("value") <= high)).alias("in_range"),
        F.lit(distance < KS_BOUND).alias("follows_the_law"))


DISCRETE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query("g4_discrete", f"""
WITH {STATS}, {BINS}, placed AS (
  SELECT u.column_name, bins, lo, (hi - lo) / bins AS step, value, least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS raw
  FROM u JOIN b USING (column_name) WHERE column_name IN ('l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity')),
counted AS (
  SELECT column_name, lo, step, CASE WHEN value < lo + raw * step AND raw > 0 THEN raw - 1
    WHEN value >= lo + (raw + 1) * step AND raw < bins - 1 THEN raw + 1 ELSE raw END AS bin FROM placed)
SELECT column_name, count(DISTINCT round_even(lo + bin * step, 0)) AS values, CAST(0 AS BIGINT) AS foreign_values, true AS shares_close
FROM counted GROUP BY column_name""")
def g4(spark, sf_dir):
    table = synthetic(spark, sf_dir, "lineitem_gaps")
    bins = profile(spark, sf_dir, "lineitem_gaps").histogram.where(F.col("column_name").isin(DISCRETE) & (F.col("count") > 0))
    weights = bins.groupBy("column_name", F.bround("left_edge", 0).alias("value")).agg(F.sum("count").alias("c"))
    rows = load(spark, sf_dir, "lineitem").count()
    expected = weights.select("column_name", "value", (F.col("c") / rows).alias("expected"))
    cells = table.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in DISCRETE])))
    drawn = cells.groupBy("column_name", "value").agg((F.count(F.lit(1)) / rows).alias("drawn"))
    values = drawn.groupBy("column_name").agg(F.count("value").alias("values"))
    return _share_gaps(drawn, expected, ["column_name"]).join(values, "column_name").select(
        "column_name", "values", "foreign_values", (F.col("gap") < 6 / F.sqrt(F.lit(rows))).alias("shares_close"))


def _range_check(table, column, low, high):
    return table.agg(
        F.count(column).alias("drawn"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"),
        F.percentile_approx(column, [0.25, 0.5, 0.75], 10000).alias("q"),
    ).withColumns({"low": F.lit(low), "high": F.lit(high), "in_range": (F.col("lo") >= low) & (F.col("hi") <= high)})


@query("g5_histogram_bins", """
SELECT 'histogram' AS strategy, count(value) AS drawn, true AS in_range, true AS follows_the_law FROM events""")
def g5(spark, sf_dir):
    p = profile(spark, sf_dir, "events", epsilon=WEAK)
    plan = strategies(p.columns, p.histogram, p.sample).where("column_name = 'value'").select("strategy", "min_value", "max_value").first()
    bins = p.histogram.where("column_name = 'value'").orderBy("bin").select("right_edge", "count").collect()
    total, law = 0, []
    for r in bins:
        total += r["count"]
        law.append(total)
    table = synthetic(spark, sf_dir, "events", epsilon=WEAK)
    distance = _points_distance(table, "value", [r["right_edge"] for r in bins[:-1]], [x / total for x in law[:-1]])
    return _range_check(table, "value", plan["min_value"], plan["max_value"]).select(
        F.lit(plan["strategy"]).alias("strategy"), "drawn", "in_range", F.lit(distance < KS_BOUND).alias("follows_the_law"))


@query("g6_truncated_normal", """
SELECT 'truncated_normal' AS strategy, count(l_extendedprice) AS drawn, true AS in_range, true AS follows_the_law
FROM lineitem""")
def g6(spark, sf_dir):
    p = profile(spark, sf_dir, "lineitem_gaps", epsilon=WEAK)
    plan = strategies(p.columns, p.histogram, p.sample).where("column_name = 'l_extendedprice'").select(
        "strategy", "mean", "std_dev", "min_value", "max_value").first()
    from statistics import NormalDist

    unit = NormalDist(plan["mean"], plan["std_dev"])
    a, b = unit.cdf(plan["min_value"]), unit.cdf(plan["max_value"])
    table = synthetic(spark, sf_dir, "lineitem_gaps", epsilon=WEAK)
    score = normal_cdf((F.col("l_extendedprice") - plan["mean"]) / plan["std_dev"])
    found = _law_distance(table, "l_extendedprice", (score - a) / (b - a))
    return _range_check(table, "l_extendedprice", plan["min_value"], plan["max_value"]).select(
        F.lit(plan["strategy"]).alias("strategy"), "drawn", "in_range", F.lit(found["ks"] < KS_BOUND).alias("follows_the_law"))


@query("g7_normal", """
SELECT 'normal' AS strategy, count(l_extendedprice) AS drawn, true AS follows_the_law, true AS std_close, true AS kurtosis_close,
  true AS tails_close, true AS beyond_range FROM lineitem""")
def g7(spark, sf_dir):
    base = profile(spark, sf_dir, "lineitem", epsilon=WEAK)
    open_ended = F.col("column_name") == "l_extendedprice"
    p = base.replaced(columns=base.columns.withColumns({
        c: F.when(~open_ended, F.col(c)) for c in ("min_value", "max_value")}))
    rows = load(spark, sf_dir, "lineitem").count()
    plan = strategies(p.columns, p.histogram, p.sample).where(open_ended).select("strategy", "mean", "std_dev").first()
    known = base.columns.where(open_ended).select("min_value").first()
    z = (F.col("l_extendedprice") - plan["mean"]) / plan["std_dev"]
    # drawn once; a filter on the lazy table would take the draw's whole expression into itself
    table = stage(generate_table(p, rows).select("l_extendedprice"), "normal")
    found = _law_distance(table, "l_extendedprice", normal_cdf(z))
    n = F.col("drawn")
    # chances beyond 2, 3 and 4 standard deviations, fixed values
    beyond = {2: 0.0455002638963584, 3: 0.0026997960632602, 4: 0.0000633424836662}
    tails = F.lit(True)
    for k, chance in beyond.items():
        tails = tails & (F.abs(F.col(f"b{k}") - n * chance) <= 5 * F.sqrt(n * chance) + 1)
    return table.agg(
        F.count("l_extendedprice").alias("drawn"), F.stddev(z).alias("std"), F.kurtosis(z).alias("kurtosis"),
        F.min("l_extendedprice").alias("lo"), *[F.count_if(F.abs(z) > k).alias(f"b{k}") for k in beyond],
    ).select(
        F.lit(plan["strategy"]).alias("strategy"), "drawn", F.lit(found["ks"] < KS_BOUND).alias("follows_the_law"),
        (F.abs(F.col("std") - 1) < 5 / F.sqrt(2 * n)).alias("std_close"),
        (F.abs("kurtosis") < 5 * F.sqrt(24 / n)).alias("kurtosis_close"), tails.alias("tails_close"),
        (F.col("lo") < known["min_value"]).alias("beyond_range"))


@query("g8_uniform", """
SELECT 'uniform' AS strategy, count(*) AS drawn, true AS in_range, true AS follows_the_law FROM part""")
def g8(spark, sf_dir):
    p = profile(spark, sf_dir, "part_shapes", epsilon=WEAK)
    plan = strategies(p.columns, p.histogram, p.sample).where("column_name = 'squared_size'").select(
        "strategy", "min_value", "max_value").first()
    low, span = plan["min_value"], plan["max_value"] - plan["min_value"]
    table = synthetic(spark, sf_dir, "part_shapes", epsilon=WEAK)
    found = _law_distance(table, "squared_size", (F.col("squared_size") - low) / span)
    return _range_check(table, "squared_size", low, low + span).select(
        F.lit(plan["strategy"]).alias("strategy"), "drawn", "in_range", F.lit(found["ks"] < KS_BOUND).alias("follows_the_law"))


_STRATEGY = """CASE WHEN std = 0 THEN 'constant'
  WHEN {sampled} AND NOT (places = 0 AND (d < 20 OR d / greatest(n, 1) < 0.05)) AND n > 10 THEN 'density'
  WHEN places = 0 AND (d < 20 OR d / greatest(n, 1) < 0.05) THEN 'discrete'
  WHEN abs(skew) > 1 THEN 'histogram' WHEN abs(skew) < 0.5 THEN 'truncated_normal' ELSE 'uniform' END"""


@query("g9_strategy", f"""
WITH {STATS}
SELECT 'exact' AS noise, column_name, {_STRATEGY.format(sampled='true')} AS strategy FROM s
UNION ALL SELECT 'weak', column_name, {_STRATEGY.format(sampled='false')} FROM s
UNION ALL SELECT noise, column_name, strategy FROM (VALUES ('exact'), ('weak')) AS t(noise),
  (VALUES ('l_returnflag', 'categories'), ('l_linestatus', 'categories'), ('l_shipdate', 'empty')) AS c(column_name, strategy)
UNION ALL SELECT 'events', column_name, strategy FROM (VALUES ('event_id', 'key'), ('ts', 'empty'), ('event_type', 'categories'),
  ('value', 'histogram'), ('props', 'categories')) AS c(column_name, strategy)
UNION ALL SELECT 'events', 'user_id', CASE WHEN d / n < 0.05 OR d < 20 THEN 'discrete' WHEN abs(skew) > 1 THEN 'histogram'
  WHEN abs(skew) < 0.5 THEN 'truncated_normal' ELSE 'uniform' END
  FROM (SELECT count(DISTINCT user_id) AS d, count(user_id) AS n, skewness(user_id) AS skew FROM events)""")
def g9(spark, sf_dir):
    cases = [("exact", "lineitem_gaps", {}), ("weak", "lineitem_gaps", {"epsilon": WEAK}), ("events", "events", {"epsilon": WEAK})]
    result = None
    for noise, name, options in cases:
        p = profile(spark, sf_dir, name, **options)
        part = strategies(p.columns, p.histogram, p.sample).select(F.lit(noise).alias("noise"), "column_name", "strategy")
        result = part if result is None else result.unionByName(part)
    return result


_GAPS = f"{sql_input('customer_gaps', 'g')}"
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(floor(100.0 * (count(*) - count({c})) / count(*) / 100.0 * count(*)) AS BIGINT) AS gaps FROM g"
    for c in ("c_name", "c_acctbal", "in_debt", "worth", "c_nationkey", "c_mktsegment"))


@query("g10_exact_gaps", f"WITH {_GAPS} {_NULLS}")
def g10(spark, sf_dir):
    names = ["c_name", "c_acctbal", "in_debt", "worth", "c_nationkey", "c_mktsegment"]
    counted = synthetic(spark, sf_dir, "customer_gaps").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("gaps")) for c in names])))


LETTERS = ["high", "name", "length", "rating", "month", "quota"]  # pairs with one weighted sum of letters


@query("g10_independent_gaps", "SELECT a AS column_a, b AS column_b, true AS exact, true AS independent FROM "
       f"(VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in LETTERS)}) AS x(a), "
       f"(VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in LETTERS)}) AS y(b) WHERE a < b")
def g10_joint(spark, sf_dir):
    table = synthetic(spark, sf_dir, "customer_letters")
    gaps = load(spark, sf_dir, "customer_letters").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in LETTERS],
                                                      F.count(F.lit(1)).alias("n")).first()
    n = gaps["n"]
    pairs = [(a, b) for a in sorted(LETTERS) for b in sorted(LETTERS) if a < b]
    found = table.agg(*[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"{a}_{b}") for a, b in pairs],
                      *[F.count_if(F.col(c).isNull()).alias(c) for c in LETTERS])
    rows = []
    for a, b in pairs:
        p, q = gaps[a] / n, gaps[b] / n
        sd = (n * p * q * (1 - p) * (1 - q)) ** 0.5
        rows.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                             ((F.col(a) == int(100.0 * gaps[a] / n / 100.0 * n)) & (F.col(b) == int(100.0 * gaps[b] / n / 100.0 * n))).alias("exact"),
                             (F.abs(F.col(f"{a}_{b}") - n * p * q) <= 5 * sd + 1).alias("independent")))
    return found.select(F.inline(F.array(*rows)))


@query("g11_categories", """
SELECT 'l_returnflag' AS column_name, count(DISTINCT l_returnflag) AS values, CAST(0 AS BIGINT) AS foreign_values, true AS shares_close
FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), 0, true FROM lineitem""")
def g11(spark, sf_dir):
    names = ["l_returnflag", "l_linestatus"]
    table = synthetic(spark, sf_dir, "lineitem_gaps")
    p = profile(spark, sf_dir, "lineitem_gaps")
    expected = p.frequencies.select("column_name", "value", F.col("frequency").alias("expected"))
    rows = table.count()
    cells = table.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in names])))
    drawn = cells.groupBy("column_name", "value").agg((F.count(F.lit(1)) / rows).alias("drawn"))
    values = drawn.groupBy("column_name").agg(F.count("value").alias("values"))
    return _share_gaps(drawn, expected, ["column_name"]).join(values, "column_name").select(
        "column_name", "values", "foreign_values", (F.col("gap") < 3 / F.sqrt(F.lit(rows))).alias("shares_close"))


@query("g12_booleans", """
SELECT count(*) AS num_rows, true AS is_boolean, true AS share_close FROM customer""")
def g12(spark, sf_dir):
    table = synthetic(spark, sf_dir, "customer_gaps")
    p = profile(spark, sf_dir, "customer_gaps")
    share = p.frequencies.where("column_name = 'in_debt' AND value = 'true'").first()["frequency"]
    return table.agg(
        F.count(F.lit(1)).alias("num_rows"), F.avg(F.col("in_debt").cast("int")).alias("drawn"), F.count("in_debt").alias("n"),
    ).select("num_rows", F.lit(table.schema["in_debt"].dataType.simpleString() == "boolean").alias("is_boolean"),
             (F.abs(F.col("drawn") - share) < 3 / F.sqrt("n")).alias("share_close"))


SHAPES = {
    "contact_email": r"^[a-z]+\.[a-z]+[0-9]+@example\.com$", "fname": r"^\p{Lu}\p{L}+$", "LNAME": r"^\p{Lu}\p{L}+$",
    "company_name": r"^\p{Lu}\p{L}+ \p{Lu}\p{L}+$", "mobile": r"^\([0-9]{3}\) 555-[0-9]{4}$",
    "street": r"^[0-9]+ .+, .+, [0-9]{5}$", "home_town": r"^\p{Lu}\p{L}+$", "postal_code": r"^[0-9]{5}$",
    "country": r"^\p{Lu}\p{L}+$", "employer": r"^\p{L}+ \p{L}+$",
}


@query("g13_made_up_people", "SELECT column_name, n AS num_rows, CAST(0 AS BIGINT) AS misshapen, CAST(0 AS BIGINT) AS reused "
       "FROM (SELECT count(*) AS n FROM customer), (VALUES " + ", ".join(f"('{c}')" for c in SHAPES) + ") AS t(column_name)")
def g13(spark, sf_dir):
    table = synthetic(spark, sf_dir, "customer_people", smart_pii=True)
    real = load(spark, sf_dir, "customer_people")
    long = lambda df, *extra: df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.lit(shape).alias("shape")) for c, shape in SHAPES.items()])))
    known = long(real).select("column_name", "value").distinct().withColumn("known", F.lit(1))
    counted = long(table).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.expr("value RLIKE shape")).alias("bad"))
    return counted.join(known, ["column_name", "value"], "left").groupBy("column_name").agg(
        F.sum("n").alias("num_rows"), F.sum("bad").alias("misshapen"),
        F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("reused"))


@query("g14_unsupported", """
SELECT 'ts' AS column_name, count(*) AS num_rows, count(*) AS gaps FROM events
UNION ALL SELECT 'embedding', count(*), count(*) FROM embeddings""")
def g14(spark, sf_dir):
    result = None
    for name, column in (("events", "ts"), ("embeddings", "embedding")):
        part = synthetic(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("num_rows"), F.count_if(F.col(column).isNull()).alias("gaps"))
        part = part.select(F.lit(column).alias("column_name"), "num_rows", "gaps")
        result = part if result is None else result.unionByName(part)
    return result


@query("g15_correlation_target", f"""
WITH {GAPS}, {_spearman_sql(LINEITEM_NUMBERS, 'g')}
SELECT col_a, col_b, round(avg(rho) OVER (PARTITION BY least(col_a, col_b), greatest(col_a, col_b)), 6) AS rho FROM matrix""")
def g15(spark, sf_dir):
    p = profile(spark, sf_dir, "lineitem_gaps")
    return target_matrix(p.correlations, LINEITEM_NUMBERS).select("col_a", "col_b", rounded("rho"))


@query("g16_rank_correlation", """
SELECT column_name, n AS present, true AS same_sum, true AS same_extremes, true AS same_spread, true AS correlated FROM (
  SELECT 'l_quantity' AS column_name, count(l_quantity) AS n FROM lineitem
  UNION ALL SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', count(*) FILTER (l_returnflag <> 'R') FROM lineitem)""")
def g16(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    target = [[1.0, 0.6, -0.4], [0.6, 1.0, 0.1], [-0.4, 0.1, 1.0]]
    before = load(spark, sf_dir, "lineitem_gaps")
    after = stage(impose_rank_correlation(before, names, target), "imposed")
    sweep(spark)
    figures = lambda df, tag: df.agg(*[F.struct(
        F.count(c).alias("n"), F.sum(F.round(F.col(c) * 100).cast("bigint")).alias("total"), F.min(c).alias("lo"), F.max(c).alias("hi"),
        F.sum((F.round(F.col(c) * 100) * F.round(F.col(c) * 100)).cast("decimal(38,0)")).alias("squares")).alias(c) for c in names])
    long = lambda df: figures(df, "").select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("f")) for c in names])))
    at = {c: i for i, c in enumerate(names)}
    rho = spearman(after, names).collect()
    # normal scores with correlation R have rank correlation 6/pi asin(R/2), 0.02 below R at most
    off = {c: max(abs(r["rho"] - target[at[c]][at[r["col_b"]]]) for r in rho if r["col_a"] == c) for c in names}
    near = F.element_at(F.create_map(*[F.lit(v) for c in names for v in (c, off[c] < 0.03 + 30 / after.count())]), F.col("column_name"))
    a, b = long(before), long(after)
    return a.select("column_name", F.col("f").alias("a")).join(b.select("column_name", F.col("f").alias("b")), "column_name").select(
        "column_name", F.col("b.n").alias("present"), (F.col("a.total") == F.col("b.total")).alias("same_sum"),
        ((F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))).alias("same_extremes"),
        (F.col("a.squares") == F.col("b.squares")).alias("same_spread"), near.alias("correlated"))


@query("g16_values_and_layout", """
SELECT column_name, count(*) AS num_rows, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS layout_rows
FROM customer, (VALUES ('wide'), ('cents'), ('c_acctbal')) AS t(column_name) GROUP BY column_name""")
def g16_layout(spark, sf_dir):
    """Whole multisets of a bigint above 2^53, a decimal and a double; equal rows at 1 and 8 partitions."""
    names = ["wide", "cents", "c_acctbal"]
    table = load(spark, sf_dir, "customer").select(
        F.expr("c_custkey * 2 + 9007199254740993").alias("wide"),
        F.expr("CAST(c_custkey AS DECIMAL(20,2)) / 100 + CAST(12345678901234567.01 AS DECIMAL(20,2))").cast("decimal(21,2)").alias("cents"),
        "c_acctbal", "c_mktsegment")
    target = [[1.0, 0.5, -0.3], [0.5, 1.0, 0.0], [-0.3, 0.0, 1.0]]
    one, eight = (stage(impose_rank_correlation(table.repartition(k), names, target), "imposed") for k in (1, 8))
    apart = one.exceptAll(eight).count() + eight.exceptAll(one).count()
    result = None
    for c in names:
        lost = table.select(c).exceptAll(one.select(c)).count() + one.select(c).exceptAll(table.select(c)).count()
        part = one.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(c).alias("column_name"), "num_rows", F.lit(lost).cast("bigint").alias("lost"),
            F.lit(apart).cast("bigint").alias("layout_rows"))
        result = part if result is None else result.unionByName(part)
    return result


@query("g16_copula_in_generation", """
SELECT CAST(1 AS INTEGER) AS level, count(*) AS num_rows, true AS correlation_kept, true AS unrelated_kept FROM customer
UNION ALL SELECT 2, count(*), true, true FROM customer""")
def g16b(spark, sf_dir):
    result = None
    for level, exact in ((1, False), (2, True)):
        p = profile(spark, sf_dir, "customer_gaps")
        rows = load(spark, sf_dir, "customer_gaps").count()
        table = generate_table(p, rows, seed=level, rank_exact=exact).persist()
        names = ["c_custkey", "c_acctbal", "worth"]
        drawn = spearman(table, names).select("col_a", "col_b", F.col("rho").alias("drawn"))
        both = p.correlations.join(drawn, ["col_a", "col_b"]).agg(
            F.max(F.when((F.col("col_a") == "c_custkey") & (F.col("col_b") == "worth"), F.abs(F.col("rho") - F.col("drawn")))).alias("strong"),
            F.max(F.when((F.col("col_a") == "c_custkey") & (F.col("col_b") == "c_acctbal"), F.abs(F.col("rho") - F.col("drawn")))).alias("weak"))
        bound = 0.03 + 3 / rows**0.5
        part = both.select(F.lit(level).alias("level"), F.lit(table.count()).cast("bigint").alias("num_rows"),
                           (F.col("strong") < bound).alias("correlation_kept"), (F.col("weak") < bound).alias("unrelated_kept"))
        result = part if result is None else result.unionByName(part)
    return result


@query("g17_precision", f"""
WITH {STATS} SELECT column_name, places AS decimals, CAST(0 AS BIGINT) AS finer,
  CASE WHEN places = 0 THEN 'bigint' ELSE 'double' END AS type FROM s""")
def g17(spark, sf_dir):
    table = synthetic(spark, sf_dir, "lineitem_gaps")
    places = {r["column_name"]: r["decimals"] for r in profile(spark, sf_dir, "lineitem_gaps").columns.select("column_name", "decimals").collect()}
    counted = table.agg(*[F.count_if(F.round(F.col(c), places[c]) != F.col(c)).alias(c) for c in LINEITEM_NUMBERS])
    return counted.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(places[c]).alias("decimals"), F.col(c).alias("finer"),
        F.lit(table.schema[c].dataType.simpleString()).alias("type")) for c in LINEITEM_NUMBERS])))


_SEG = "WITH " + sql_input("orders_flags", "g")


@query("g18_groups", f"""
{_SEG} SELECT o_orderpriority AS grp, true AS share_close, true AS price_in_range, true AS statuses_known,
  true AS gaps_exact FROM g WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
UNION ALL SELECT NULL, true, true, true, true
UNION ALL SELECT 'all', count(*) > 0, true, true, true FROM g""")
def g18(spark, sf_dir):
    p = profile(spark, sf_dir, "orders_flags", conditional_by="o_orderpriority")
    rows = load(spark, sf_dir, "orders_flags").count()
    table = synthetic(spark, sf_dir, "orders_flags", conditional_by="o_orderpriority")
    key = F.coalesce(F.concat(F.lit("="), "o_orderpriority"), F.lit(""))
    found = table.groupBy(key.alias("grp"), F.col("o_orderpriority").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        F.count_if(F.col("o_custkey").isNull()).alias("gaps"), F.max(F.col("o_orderstatus").isin("F", "O", "P")).alias("known"))
    price = p.columns.where("column_name = 'o_totalprice'").select("grp", "min_value", "max_value")
    gaps = p.columns.where("column_name = 'o_custkey'").select("grp", "missing_percentage")
    root = p.columns.where("grp = '' AND column_name = 'o_orderpriority'").first()["missing_percentage"]
    missing = int(root / 100 * rows)
    shares = p.frequencies.where("grp = '' AND column_name = 'o_orderpriority'").select("value", "frequency")
    expected = F.when(F.col("value").isNull(), F.lit(float(missing))).otherwise(F.col("frequency") * (rows - missing))
    per_group = found.join(price, "grp").join(gaps, "grp").join(shares, "value", "left").select(
        F.col("value").alias("grp"), (F.abs(F.col("n") - expected) <= F.when(F.col("value").isNull(), 0).otherwise(4 * F.sqrt(expected))).alias("share_close"),
        ((F.col("lo") >= F.col("min_value")) & (F.col("hi") <= F.col("max_value"))).alias("price_in_range"),
        F.col("known").alias("statuses_known"),
        (F.col("gaps") == F.floor(F.col("missing_percentage") / 100 * F.col("n"))).alias("gaps_exact"))
    whole = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("k"), F.max("o_orderkey").alias("m")).select(
        F.lit("all").alias("grp"), (F.col("n") == rows).alias("share_close"), (F.col("k") == rows).alias("price_in_range"),
        (F.col("m") == rows).alias("statuses_known"), F.lit(True).alias("gaps_exact"))
    return per_group.unionByName(whole)


@query("g18_hot_group", """
SELECT count(*) AS num_rows, true AS hot_close, true AS hot_alike, CAST(0 AS BIGINT) AS unknown_groups,
  CAST(0 AS BIGINT) AS beyond_range FROM orders""")
def g18_hot(spark, sf_dir):
    """Some thousand groups, one of which holds half of the rows; prices come from each group's own distribution."""
    def make():
        part = F.when(F.col("o_orderkey") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("o_custkey") % 1000).cast("string")))
        return stage(load(spark, sf_dir, "orders").select(part.alias("part"), "o_totalprice"), "parts")

    source = make()
    p = profile_table(source, conditional_by="part")
    rows = source.count()
    table = stage(generate_table(p, rows), "many-groups")
    ranges = p.columns.where("column_name = 'o_totalprice'").select("grp", "min_value", "max_value")
    found = table.groupBy(F.concat(F.lit("="), "part").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).join(ranges, "grp", "left")
    hot = lambda df: df.where("part = 'hot'").select("o_totalprice")
    ks = ks_statistics(paired_values(hot(source), hot(table), ["o_totalprice"])).first()
    half = source.where("part = 'hot'").count()
    # a density from 1000 sample values and its kernels' width add to the chance of two samples
    alike = ks["ks_statistic"] < 0.06 + 2 / half**0.5
    return found.agg(
        F.sum("n").alias("num_rows"), F.max((F.col("grp") == "=hot") & (F.abs(F.col("n") - half) < 4 * half**0.5)).alias("hot_close"),
        F.lit(bool(alike)).alias("hot_alike"), F.count_if(F.col("min_value").isNull()).alias("unknown_groups"),
        F.count_if((F.col("lo") < F.col("min_value")) | (F.col("hi") > F.col("max_value"))).alias("beyond_range"))


def _runs(batches):
    """The first and last key of a partition, and whether its keys rise."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    first = last = None
    rising = True
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if len(keys):
            rising &= bool((np.diff(keys.astype(object)) >= 0).all()) and (last is None or last <= keys[0])
            first, last = keys[0] if first is None else first, keys[-1]
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": int(first), "last": int(last), "rising": bool(rising)}],
                                         schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("rising", pa.bool_())]))


@query("g19_shuffled", """
SELECT count(*) AS num_rows, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained, true AS hash_ordered FROM customer""")
def g19(spark, sf_dir):
    p = profile(spark, sf_dir, "customer_gaps")
    rows = load(spark, sf_dir, "customer_gaps").count()
    plain, mixed = generate_table(p, rows), generate_table(p, rows, shuffle=True)
    tagged = plain.withColumn("side", F.lit(1)).unionByName(mixed.withColumn("side", F.lit(-1)))
    net = tagged.groupBy(*plain.columns).agg(F.sum("side").alias("net"), F.count_if(F.col("side") < 0).alias("here"))
    ends = mixed.select(F.xxhash64(*[F.col(c) for c in mixed.columns], F.lit(42)).alias("key")).mapInArrow(
        _runs, "part int, first long, last long, rising boolean").orderBy("part").collect()  # a row per partition
    ordered = all(r.rising for r in ends) and all(a.last <= b.first for a, b in zip(ends, ends[1:]))
    return net.agg(
        F.sum("here").alias("num_rows"), F.sum(F.greatest("net", F.lit(0))).cast("bigint").alias("lost"),
        F.sum(-F.least("net", F.lit(0))).cast("bigint").alias("gained"), F.lit(ordered).alias("hash_ordered"))


@query("g20_column_order", f"""
SELECT CAST(i - 1 AS INTEGER) AS position, names[i] AS column_name, n AS num_rows FROM (SELECT count(*) AS n FROM lineitem),
  (SELECT unnest(range(1, 12)) AS i), (SELECT [{', '.join(f"'{c}'" for c in LINEITEM_NUMBERS)}, 'l_returnflag', 'l_linestatus', 'l_shipdate'] AS names)""")
def g20(spark, sf_dir):
    table = synthetic(spark, sf_dir, "lineitem_gaps")
    return table.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.posexplode(F.array(*[F.lit(c) for c in table.columns])).alias("position", "column_name"), "num_rows")


#: Rows that the narrower of two layouts gives to a task.
LAYOUT_ROWS = 250_000


def layout(rows: int) -> int:
    """Partitions of the narrower layout: one for a small table, then as many as the rows ask for."""
    return max(1, -(-rows // LAYOUT_ROWS))


@query("g21_determinism", """
SELECT kind, n AS num_rows, true AS as_expected FROM (SELECT count(*) AS n FROM orders), (VALUES ('partitions'), ('seed')) AS t(kind)""")
def g21(spark, sf_dir):
    p = profile(spark, sf_dir, "orders_flags", conditional_by="o_orderpriority")
    rows = load(spark, sf_dir, "orders_flags").count()
    few = layout(rows)
    one = stage(generate_table(p, rows, seed=7, partitions=few), "few-parts")
    result = None
    for kind, other in (("partitions", generate_table(p, rows, seed=7, partitions=8 * few)),
                        ("seed", generate_table(p, rows, seed=8, partitions=8 * few))):
        tagged = one.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(-1)))
        net = tagged.groupBy(*one.columns).agg(F.sum("side").alias("net"), F.count_if(F.col("side") < 0).alias("here"))
        differ = F.sum(F.abs("net"))
        part = net.agg(F.sum("here").alias("num_rows"), (differ == 0 if kind == "partitions" else differ > 0).alias("as_expected"))
        part = part.select(F.lit(kind).alias("kind"), "num_rows", "as_expected")
        result = part if result is None else result.unionByName(part)
    return result
