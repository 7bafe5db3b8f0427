"""Sources, profile statistics and the privacy scan."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.inputs import (
    LINEITEM_NUMBERS, load, profile, profiler, sql_input, sql_numbers,
)
from catalog.registry import query, rounded
from facsimile import EmptyTableError, load_profile, read_table, require_rows, save_profile, scan_privacy, write_table
from facsimile.operators.categories import semantic_type
from facsimile.operators.columns import columns_of, name_of, numeric_cells, tally
from facsimile.operators.numeric import histogram, is_discrete, with_bins, with_capped_range
from facsimile.operators.privacy import alerts, matches_identifier, uniqueness
from facsimile.sources.staging import stage, staging_root

GAPS = sql_input("lineitem_gaps", "g")
NUMBERS = sql_numbers(LINEITEM_NUMBERS, "g", "u")
# Statistics of every numeric column of lineitem with gaps, one row per column.
STATS = f"""{GAPS}, {NUMBERS}, s AS (
  SELECT column_name, count(*) AS num_rows, count(value) AS n, count(DISTINCT value) AS d,
    min(value) AS lo, max(value) AS hi, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std,
    skewness(value) AS skew, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
    quantile_cont(value, 0.75) AS q3,
    max(CASE WHEN value IS NULL THEN NULL WHEN value % 1 = 0 THEN 0 WHEN round(value, 1) = value THEN 1 WHEN round(value, 2) = value THEN 2
        WHEN round(value, 3) = value THEN 3 ELSE 4 END) AS places
  FROM u GROUP BY column_name)"""
INTEGERS = "('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')"
BINS = """b AS (
  SELECT *, CASE WHEN lo = hi THEN 1 WHEN width > 0 THEN CAST(ceil((hi - lo) / width) AS BIGINT) ELSE 1 END AS bins
  FROM (SELECT *, CASE WHEN column_name IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber') AND w > 0
               THEN greatest(w, 1) ELSE w END AS width
        FROM (SELECT *, least(greatest(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2.0),
                              (hi - lo) / (round(log2(n), 12) + 1.0)) AS w FROM s)))"""


# --- sources ------------------------------------------------------------------

@query("s1_read_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, is_large, o_orderpriority
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice > 250000 END AS is_large,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS o_orderpriority FROM orders)""")
def s1(spark, sf_dir):
    from uuid import uuid4

    path = f"{staging_root(spark)}/orders-{uuid4().hex}.csv"
    tokens = load(spark, sf_dir, "orders_flags").withColumns({
        "o_custkey": F.coalesce(F.col("o_custkey").cast("string"), F.lit("NA")),
        "o_orderpriority": F.coalesce("o_orderpriority", F.lit("N/A")),
        "is_large": F.coalesce(F.initcap(F.col("is_large").cast("string")), F.lit("NaN")),
    })
    write_table(tokens, path)
    return read_table(spark, path).select(
        "o_orderkey", "o_custkey", "o_orderstatus", rounded("o_totalprice", 2), "is_large", "o_orderpriority")


@query("s1_csv_round_trip", """
SELECT 'events' AS table_name, count(*) AS num_rows, count(*) AS equal_rows, 'string' AS code_type, true AS empty_file_rejected FROM events
UNION ALL SELECT 'documents', count(*), count(*), 'string', true FROM documents""")
def s1_round_trip(spark, sf_dir):
    from uuid import uuid4

    empty = f"{staging_root(spark)}/empty-{uuid4().hex}.csv"
    spark.createDataFrame([("",)], "value string").limit(0).write.text(empty)
    try:
        read_table(spark, empty)
        rejected = False
    except EmptyTableError:
        rejected = True
    result = None
    for name, key, breaks in (("events", "event_id", False), ("documents", "doc_id", True)):
        path = f"{staging_root(spark)}/{name}-{uuid4().hex}.csv"
        # a code that Spark's cast alone would take for a number
        table = load(spark, sf_dir, name).withColumn("code", F.concat(F.col(key).cast("string"), F.lit("d")))
        table = table.select([F.col(c).cast("string") if t == "timestamp_ntz" else F.col(c) for c, t in table.dtypes])
        write_table(table, path, multi_line=breaks)
        back = read_table(spark, path, multi_line=breaks)
        same = F.lit(True)
        for c in table.columns:
            same = same & table[c].eqNullSafe(back[c])
        part = table.join(back, table[key] == back[key], "full").agg(
            F.count(F.lit(1)).alias("num_rows"), F.count_if(same).alias("equal_rows")).select(
            F.lit(name).alias("table_name"), "num_rows", "equal_rows", F.lit(dict(back.dtypes)["code"]).alias("code_type"),
            F.lit(rejected).alias("empty_file_rejected"))
        result = part if result is None else result.unionByName(part)
    return result


@query("s2_empty_guard", """
SELECT CAST(count(*) AS BIGINT) AS num_rows, true AS accepted, true AS empty_rejected FROM lineitem""")
def s2(spark, sf_dir):
    table = load(spark, sf_dir, "lineitem")
    try:
        require_rows(table.where("l_quantity < l_quantity"))
        rejected = False
    except EmptyTableError:
        rejected = True
    return require_rows(table).agg(
        F.count(F.lit(1)).alias("num_rows"), F.lit(True).alias("accepted"), F.lit(rejected).alias("empty_rejected"))


@query("s3_profile_round_trip", """
SELECT 'columns' AS part, CAST(5 + 1 AS BIGINT) * (1 + count(DISTINCT o_orderpriority)) AS saved, CAST(0 AS BIGINT) AS lost,
  CAST(0 AS BIGINT) AS gained FROM orders
UNION ALL SELECT 'meta', CAST(1 + count(DISTINCT o_orderpriority) AS BIGINT), 0, 0 FROM orders
UNION ALL SELECT 'correlations', CAST(9 * (1 + count(DISTINCT o_orderpriority)) AS BIGINT), 0, 0 FROM orders
UNION ALL SELECT 'warnings', 6, 0, 0""")
def s3(spark, sf_dir):
    from uuid import uuid4

    path = f"{staging_root(spark)}/profile-{uuid4().hex}"
    before = profile(spark, sf_dir, "orders", conditional_by="o_orderpriority")
    save_profile(before, path)
    after = load_profile(spark, path)
    result = None
    for part in ("columns", "meta", "correlations", "warnings"):
        a, b = getattr(before, part), getattr(after, part)
        b = b.select(*a.columns)
        # one key per whole row, so that a row missing on either side shows in one shuffle
        tagged = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
        rows = tagged.groupBy(*a.columns).agg(
            F.sum("side").alias("net"), F.count_if(F.col("side") == 1).alias("here"))
        counted = rows.agg(
            F.sum("here").alias("saved"),
            F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).cast("bigint").alias("lost"),
            F.coalesce(F.sum(-F.least("net", F.lit(0))), F.lit(0)).cast("bigint").alias("gained"),
        ).select(F.lit(part).alias("part"), "saved", "lost", "gained")
        result = counted if result is None else result.unionByName(counted)
    return result


# --- profile ------------------------------------------------------------------

@query("p1_shape", "SELECT count(*) AS num_rows, CAST(11 AS INTEGER) AS num_columns FROM lineitem")
def p1(spark, sf_dir):
    p = profiler(spark, sf_dir, "lineitem_gaps")
    return p.sizes.select("num_rows", F.lit(len(p.names)).alias("num_columns"))


@query("p2_type_classes", """
SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'datetime'), ('user_id', 'numeric'), ('event_type', 'categorical'),
  ('value', 'numeric'), ('props', 'categorical'), ('vec_id', 'numeric'), ('embedding', 'unsupported'), ('label', 'numeric'),
  ('is_large', 'boolean'), ('void', 'unsupported')) AS t(column_name, inferred_type)""")
def p2(spark, sf_dir):
    from facsimile import Profiler

    flags = load(spark, sf_dir, "orders_flags").select("is_large", F.expr("nullif(o_orderstatus, o_orderstatus)").alias("void"))
    frames = [profiler(spark, sf_dir, "events"), profiler(spark, sf_dir, "embeddings"), Profiler(flags)]
    result = None
    for p in frames:
        part = p.facts.select("column_name", "inferred_type")
        result = part if result is None else result.unionByName(part)
    return result


ALL_LINEITEM = LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]


@query("p3_missing", f"WITH {GAPS} " + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count,
  round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percentage, count(*) > count({c}) AS nullable FROM g"""
    for c in ALL_LINEITEM))
def p3(spark, sf_dir):
    return profiler(spark, sf_dir, "lineitem_gaps").facts.select(
        "column_name", "missing_count", rounded("missing_percentage"), "nullable")


@query("p4_distinct", f"WITH {GAPS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS num_unique FROM g" for c in ALL_LINEITEM)
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS num_unique FROM documents"
    for c in ("doc_id", "text", "lang", "source", "n_chars")))
def p4(spark, sf_dir):
    parts = [profiler(spark, sf_dir, t).basics.select("column_name", "num_unique") for t in ("lineitem_gaps", "documents")]
    return parts[0].unionByName(parts[1])


KEY_TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "events": ["event_id", "user_id", "event_type", "value", "props"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "pages": ["page_id", "url", "html"],
}
_KEYISH = " OR ".join(f"contains(lower(column_name), '{p}')" for p in ("id", "uuid", "key", "index", "hash"))


@query("p5_primary_key", f"""
SELECT column_name, ({_KEYISH}) AND d = n AND d > 0 AS is_primary_key FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS d FROM {t}"
    for t, names in KEY_TABLES.items() for c in names) + ")")
def p5(spark, sf_dir):
    result = None
    for table, names in KEY_TABLES.items():
        part = profiler(spark, sf_dir, table).basics.where(F.col("column_name").isin(names))
        part = part.select("column_name", "is_primary_key")
        result = part if result is None else result.unionByName(part)
    return result


def _numeric(spark, sf_dir):
    return profiler(spark, sf_dir, "lineitem_gaps").stats


def _averages(spark, sf_dir):
    return profiler(spark, sf_dir, "lineitem_gaps").averages


@query("p6_mean_std", f"WITH {STATS} SELECT column_name, round(mean, 6) AS mean, round(std, 6) AS std_dev FROM s")
def p6(spark, sf_dir):
    return _averages(spark, sf_dir).select(
        "column_name", rounded("mean_cnt", alias="mean"), rounded("std_cnt", alias="std_dev"))


@query("p7_skewness", f"""
WITH {STATS} SELECT column_name, round(skew, 6) AS skewness FROM s
UNION ALL SELECT 'value', round(skewness(value), 6) FROM events""")
def p7(spark, sf_dir):
    events = profiler(spark, sf_dir, "events").averages.where("column_name = 'value'")
    return _averages(spark, sf_dir).select("column_name", rounded("skewness_cnt", alias="skewness")).unionByName(
        events.select("column_name", rounded("skewness_cnt", alias="skewness")))


@query("p8_quantiles", f"""
WITH {STATS} SELECT column_name, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr FROM s""")
def p8(spark, sf_dir):
    return _numeric(spark, sf_dir).select(
        "column_name", *[rounded(f"{q}_cnt", alias=q) for q in ("q1", "median", "q3", "iqr")])


@query("p9_min_max", f"WITH {STATS} SELECT column_name, round(lo, 6) AS min_value, round(hi, 6) AS max_value FROM s")
def p9(spark, sf_dir):
    return _averages(spark, sf_dir).select(
        "column_name", rounded("min_cnt", alias="min_value"), rounded("max_cnt", alias="max_value"))


@query("p10_outlier_cap", """
SELECT round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) AS min_value, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) AS max_value,
  round(hi, 6) AS uncapped_max, round(mean, 6) AS mean
FROM (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mean, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3 FROM events)""")
def p10(spark, sf_dir):
    stats = profiler(spark, sf_dir, "events", auto_clean_outliers=True).stats.where("column_name = 'value'")
    return stats.select(rounded("min_value"), rounded("max_value"), rounded("max_cnt", alias="uncapped_max"),
                        rounded("mean_cnt", alias="mean"))


@query("p11_decimals", f"""
WITH {STATS}, {sql_input("part_shapes", "ps")}, pu AS (
  SELECT 'half_skewed' AS column_name, half_skewed AS value FROM ps UNION ALL SELECT 'squared_size', squared_size FROM ps
  UNION ALL SELECT 'p_retailprice', p_retailprice FROM ps)
SELECT column_name, places AS decimals FROM s
UNION ALL SELECT column_name, max(CASE WHEN value IS NULL THEN NULL WHEN value % 1 = 0 THEN 0 WHEN round(value, 1) = value THEN 1
  WHEN round(value, 2) = value THEN 2 WHEN round(value, 3) = value THEN 3 ELSE 4 END) FROM pu GROUP BY column_name""")
def p11(spark, sf_dir):
    shapes = profiler(spark, sf_dir, "part_shapes").stats.where(
        F.col("column_name").isin("half_skewed", "squared_size", "p_retailprice"))
    return _numeric(spark, sf_dir).select("column_name", "decimals").unionByName(shapes.select("column_name", "decimals"))


@query("p12_discrete", f"""
WITH {STATS} SELECT column_name, places = 0 AND (d < 20 OR d / greatest(n, 1) < 0.05) AS is_discrete FROM s
UNION ALL SELECT 'quality', count(DISTINCT quality) < 20 FROM labels
UNION ALL SELECT 'toxic', count(DISTINCT toxic) < 20 FROM labels""")
def p12(spark, sf_dir):
    labels = profiler(spark, sf_dir, "labels").stats.where(F.col("column_name").isin("quality", "toxic"))
    return _numeric(spark, sf_dir).select("column_name", "is_discrete").unionByName(
        labels.select("column_name", "is_discrete"))


@query("p13_histogram", f"""
WITH {STATS}, {BINS}, placed AS (
  SELECT u.column_name, b.bins, b.lo, (hi - lo) / bins AS step, hi, value,
    least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS raw
  FROM u JOIN b USING (column_name) WHERE value IS NOT NULL),
counted AS (
  SELECT column_name, CAST(CASE WHEN value < lo + raw * step AND raw > 0 THEN raw - 1
    WHEN value >= lo + (raw + 1) * step AND raw < bins - 1 THEN raw + 1 ELSE raw END AS BIGINT) AS bin, count(*) AS c
  FROM placed GROUP BY 1, 2),
frame AS (SELECT column_name, bins, lo, hi, unnest(range(bins)) AS bin FROM b)
SELECT f.column_name, f.bin, round(lo + f.bin * (hi - lo) / bins, 6) AS left_edge,
  round(lo + (f.bin + 1) * (hi - lo) / bins, 6) AS right_edge, coalesce(c, 0) AS count
FROM frame f LEFT JOIN counted k ON f.column_name = k.column_name AND f.bin = k.bin""")
def p13(spark, sf_dir):
    p = profiler(spark, sf_dir, "lineitem_gaps")
    return p.histogram.select(
        name_of(F.col("cid"), p.numeric_names).alias("column_name"), "bin", rounded("left_edge"), rounded("right_edge"), "count")


@query("p14_density_sample", f"""
WITH {STATS} SELECT column_name, least(n, 1000) AS sampled, least(n, 1000) AS positions, CAST(0 AS BIGINT) AS foreign_values,
  true AS mean_close FROM s
WHERE NOT (places = 0 AND (d < 20 OR d / greatest(n, 1) < 0.05))""")
def p14(spark, sf_dir):
    p = profiler(spark, sf_dir, "lineitem_gaps")
    # at most 1000 rows a column; they are sent to the ordered values, not those to them
    sample = stage(p.sample, "sample")
    drawn = sample.select("cid", "value").distinct()
    own = p.values.rows.select("cid", "value").join(F.broadcast(drawn), ["cid", "value"], "left_semi").withColumn("known", F.lit(1))
    found = sample.join(own, ["cid", "value"], "left").groupBy("cid").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct("idx").alias("positions"),
        F.count_if(F.col("known").isNull()).alias("foreign_values"), F.avg("value").alias("mean"))
    return found.join(p.stats.select("cid", "column_name", "mean_cnt", "std_cnt"), "cid").select(
        "column_name", "sampled", "positions", "foreign_values",
        # within 5 standard errors of a random sample; a stratified one does better
        (F.abs(F.col("mean") - F.col("mean_cnt")) <= F.col("std_cnt") * 5 / F.sqrt("sampled")).alias("mean_close"))


@query("p15_category_frequencies", f"""
WITH {sql_input("orders_flags", "g")}, {sql_input("lineitem_gaps", "l")}, u AS (
  SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM g
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM g UNION ALL SELECT 'is_large', CAST(is_large AS VARCHAR) FROM g
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM l UNION ALL SELECT 'l_linestatus', l_linestatus FROM l)
SELECT column_name, value, count(*) AS weight, round(count(*) / sum(count(*)) OVER (PARTITION BY column_name), 9) AS frequency
FROM u WHERE value IS NOT NULL GROUP BY column_name, value""")
def p15(spark, sf_dir):
    result = None
    for name in ("orders_flags", "lineitem_gaps"):
        p = profiler(spark, sf_dir, name)
        part = p.frequencies.select(
            name_of(F.col("cid"), p.label_names).alias("column_name"), "value", "weight", rounded("frequency", 9))
        result = part if result is None else result.unionByName(part)
    return result


@query("p16_semantic_type", """
SELECT 'c_name' AS column_name, count(DISTINCT c_name) AS num_unique, 'name' AS semantic_type FROM customer
UNION ALL SELECT 'contact_email', count(DISTINCT c_name), 'email' FROM customer
UNION ALL SELECT 'mobile', count(DISTINCT c_name), 'phone_number' FROM customer
UNION ALL SELECT column_name, n, semantic_type FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer), (VALUES
  ('c_mktsegment', NULL), ('fname', 'first_name'), ('LNAME', 'last_name'), ('company_name', 'name'), ('street', 'address'),
  ('home_town', 'city'), ('postal_code', 'zipcode'), ('country', 'country'), ('employer', 'company'), ('segment', NULL))
  AS t(column_name, semantic_type)""")
def p16(spark, sf_dir):
    return profiler(spark, sf_dir, "customer_people", smart_pii=True).basics.where("inferred_type = 'categorical'").select(
        "column_name", "num_unique", "semantic_type")


def _spearman_sql(columns: list[str], source: str, group: str | None = None) -> str:
    """Average ranks on pair-complete rows, then Pearson's correlation of the ranks."""
    parts = []
    for a, b in combinations(columns, 2):
        for level in (["''"] + ([f"'=' || {group}"] if group else [])):
            part = f"PARTITION BY {level}" if level != "''" else ""
            ties = lambda c: f"PARTITION BY {level}, {c}" if level != "''" else f"PARTITION BY {c}"
            rank = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({ties(c)}) - 1) / 2.0"
            parts.append(f"""SELECT grp, '{a}' AS a, '{b}' AS b, corr(ra, rb) AS rho FROM (
  SELECT {level} AS grp, {rank(a)} AS ra, {rank(b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL
  {f"AND {group} IS NOT NULL" if level != "''" else ""}) GROUP BY grp""")
    return f"""pairs AS MATERIALIZED ({' UNION ALL '.join(parts)}), matrix AS MATERIALIZED (
  SELECT grp, a AS col_a, b AS col_b, rho FROM pairs UNION ALL SELECT grp, b, a, rho FROM pairs
  UNION ALL SELECT DISTINCT grp, c, c, 1.0 FROM pairs, (VALUES {', '.join(f"('{c}')" for c in columns)}) AS t(c))"""


@query("p17_spearman", f"WITH {GAPS}, {_spearman_sql(LINEITEM_NUMBERS, 'g')} SELECT col_a, col_b, round(rho, 6) AS rho FROM matrix")
def p17(spark, sf_dir):
    return profiler(spark, sf_dir, "lineitem_gaps").correlations.select("col_a", "col_b", rounded("rho"))


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_ORDERS = f"{sql_input('orders_flags', 'g')}, {sql_numbers(ORDER_NUMBERS, 'g', 'u', 'o_orderpriority')}"


@query("p18_group_profile", f"""
WITH {_ORDERS}, {_spearman_sql(ORDER_NUMBERS, 'g', 'o_orderpriority')}
SELECT u.grp, u.column_name, count(*) - count(value) AS missing_count, count(DISTINCT value) AS num_unique,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_dev, round(skewness(value), 6) AS skewness,
  round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
  round(any_value(m.rho), 6) AS rho_with_price
FROM u JOIN matrix m ON m.grp = u.grp AND m.col_a = u.column_name AND m.col_b = 'o_totalprice'
GROUP BY u.grp, u.column_name""")
def p18(spark, sf_dir):
    p = profiler(spark, sf_dir, "orders_flags", conditional_by="o_orderpriority")
    rho = p.correlations.where("col_b = 'o_totalprice'").select(
        "grp", F.col("col_a").alias("column_name"), rounded("rho", alias="rho_with_price"))
    figures = ("mean", "std_dev", "skewness", "min_value", "max_value", "q1", "median", "q3")
    return p.columns.where("inferred_type = 'numeric'").join(rho, ["grp", "column_name"]).select(
        "grp", "column_name", "missing_count", "num_unique", *[rounded(f) for f in figures], "rho_with_price")


EPSILON = 0.5


@query("p19_noisy_moments", f"""
WITH {STATS} SELECT column_name, round(lo, 6) AS min_value, round(hi, 6) AS max_value, round(q2, 6) AS median,
  true AS mean_moved, true AS mean_close, true AS std_close, true AS std_valid FROM s""")
def p19(spark, sf_dir):
    exact = _numeric(spark, sf_dir).select("column_name", F.col("mean_cnt").alias("mean"), F.col("std_cnt").alias("std"))
    noisy = profiler(spark, sf_dir, "lineitem_gaps", epsilon=EPSILON).stats
    # Laplace noise exceeds 30 scales with probability e**-30
    reach = (F.col("max_value") - F.col("min_value")) / F.col("n_cnt") / EPSILON * 30
    return noisy.join(exact, "column_name").select(
        "column_name", rounded("min_value"), rounded("max_value"), rounded("median_cnt", alias="median"),
        (F.col("mean_cnt") != F.col("mean")).alias("mean_moved"),
        (F.abs(F.col("mean_cnt") - F.col("mean")) < reach).alias("mean_close"),
        (F.abs(F.col("std_cnt") - F.col("std")) < reach).alias("std_close"),
        (F.col("std_cnt") >= 0).alias("std_valid"))


@query("p20_noisy_histogram", f"""
WITH {STATS}, {BINS} SELECT column_name, bins, true AS whole_counts, true AS each_close, true AS some_moved FROM b""")
def p20(spark, sf_dir):
    exact = profiler(spark, sf_dir, "lineitem_gaps").histogram.select("cid", "bin", F.col("count").alias("true_count"))
    p = profiler(spark, sf_dir, "lineitem_gaps", epsilon=EPSILON)
    apart = F.abs(F.col("count") - F.col("true_count"))
    return p.histogram.join(exact, ["cid", "bin"]).groupBy("cid").agg(
        F.count(F.lit(1)).alias("bins"), F.min(F.col("count") >= 0).alias("whole_counts"),
        F.min(apart <= 30 / EPSILON).alias("each_close"), F.max(apart > 0).alias("some_moved"),
    ).select(name_of(F.col("cid"), p.numeric_names).alias("column_name"), "bins", "whole_counts", "each_close", "some_moved")


@query("p21_noisy_categories", f"""
WITH {sql_input("orders_flags", "g")}, u AS (
  SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM g
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM g UNION ALL SELECT 'is_large', CAST(is_large AS VARCHAR) FROM g)
SELECT column_name, count(DISTINCT value) AS categories, CAST(1 AS DOUBLE) AS total, true AS each_valid, true AS each_close, true AS some_moved
FROM u GROUP BY column_name""")
def p21(spark, sf_dir):
    exact = profiler(spark, sf_dir, "orders_flags").frequencies.select("cid", "value", F.col("frequency").alias("true"))
    p = profiler(spark, sf_dir, "orders_flags", epsilon=EPSILON)
    total = load(spark, sf_dir, "orders_flags").count()
    apart = F.abs(F.col("frequency") - F.col("true"))
    return p.frequencies.join(exact, ["cid", "value"]).groupBy("cid").agg(
        F.count(F.lit(1)).alias("categories"), F.round(F.sum("frequency"), 6).alias("total"),
        F.min(F.col("frequency").between(0, 1)).alias("each_valid"),
        F.min(apart < 200 / EPSILON / total).alias("each_close"), F.max(apart > 0).alias("some_moved"),
    ).select(name_of(F.col("cid"), p.label_names).alias("column_name"), "categories", "total", "each_valid", "each_close", "some_moved")


@query("p22_assembled_profile", f"""
WITH {STATS}, {BINS}
SELECT column_name, 'numeric' AS inferred_type, n < num_rows AS nullable, d AS num_unique, num_rows - n AS missing_count,
  round(mean, 6) AS mean, round(std, 6) AS std_dev, round(q1, 6) AS q25, round(q2, 6) AS q50, round(q3, 6) AS q75,
  CAST(bins AS INTEGER) AS bin_count, CAST(bins + 1 AS INTEGER) AS edge_count, CAST(n AS BIGINT) AS binned,
  CAST(CASE WHEN places = 0 AND (d < 20 OR d / greatest(n, 1) < 0.05) THEN NULL ELSE least(n, 1000) END AS INTEGER) AS sampled,
  places AS decimals FROM b
UNION ALL SELECT column_name, 'categorical', n < r, d, r - n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 4 FROM (
  SELECT 'l_returnflag' AS column_name, count(*) AS r, count(l_returnflag) AS n, count(DISTINCT l_returnflag) AS d FROM g
  UNION ALL SELECT 'l_linestatus', count(*), count(l_linestatus), count(DISTINCT l_linestatus) FROM g)
UNION ALL SELECT 'l_shipdate', 'datetime', false, count(DISTINCT l_shipdate), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 4 FROM g""")
def p22(spark, sf_dir):
    wide = profile(spark, sf_dir, "lineitem_gaps").assembled()
    total = F.aggregate("histogram_counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return wide.select(
        "column_name", "inferred_type", "nullable", "num_unique", "missing_count", rounded("mean"), rounded("std_dev"),
        *[rounded(F.col("quantiles")[f"{q}%"], alias=f"q{q}") for q in (25, 50, 75)],
        size("histogram_counts").alias("bin_count"), size("histogram_bins").alias("edge_count"), total.alias("binned"),
        size("kde_samples").alias("sampled"), "decimals")


# --- privacy scan ---------------------------------------------------------------

@query("v1_identifier_names", """
SELECT column_name, list_contains(names, lower(column_name)) OR list_has_any(names, string_split(lower(column_name), '_'))
  AS is_identifier
FROM (SELECT ['id', 'user_id', 'customer_id', 'email', 'phone', 'name', 'address', 'ssn', 'ip_address', 'uuid', 'guid'] AS names,
  unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment', 'contact_email', 'fname', 'LNAME', 'company_name',
  'mobile', 'street', 'home_town', 'postal_code', 'country', 'employer', 'segment', 's_suppkey', 's_name', 's_nationkey',
  's_acctbal', 'event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name)""")
def v1(spark, sf_dir):
    result = None
    for name in ("customer_people", "supplier", "events"):
        listing = uniqueness(load(spark, sf_dir, name)).select("column_name")
        result = listing if result is None else result.unionByName(listing)
    return result.select("column_name", matches_identifier(F.col("column_name")).alias("is_identifier"))


@query("v2_uniqueness", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS num_rows, count(DISTINCT {c}) AS num_unique, "
    f"round(count(DISTINCT {c}) / count(*), 9) AS uniqueness_ratio FROM {t}"
    for t, names in {"events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
                     "documents": ["doc_id", "text", "lang", "source", "n_chars"]}.items() for c in names) + ")")
def v2(spark, sf_dir):
    parts = [uniqueness(load(spark, sf_dir, t)).select(
        "column_name", "num_rows", "num_unique", rounded("uniqueness_ratio", 9)) for t in ("events", "documents")]
    return parts[0].unionByName(parts[1])


_SCAN_COLUMNS = {
    "events": {"event_id": "n", "ts": "o", "user_id": "n", "event_type": "s", "value": "n", "props": "s"},
    "documents": {"doc_id": "n", "text": "s", "lang": "s", "source": "s", "n_chars": "n"},
    "pages": {"page_id": "n", "url": "s", "html": "s"},
    "supplier": {"s_suppkey": "n", "s_name": "s", "s_nationkey": "n", "s_acctbal": "n"},
}
_SCAN = """scan AS (
  SELECT table_name, column_name, CASE WHEN named THEN 'WARNING' WHEN kind = 's' AND ratio > 0.8 THEN 'HIGH-CARDINALITY' ELSE 'SAFE' END
    AS warning_level,
  CASE WHEN named THEN printf('Column name matches identifier heuristic. Uniqueness ratio: %.2f', ratio)
    WHEN kind = 'n' THEN 'Numeric column not matching identifier heuristic.'
    WHEN kind = 's' AND ratio > 0.8
      THEN printf('High cardinality categorical column (%.0f%% unique values). Potential identifier.', ratio * 100)
    ELSE 'Did not flag identifier heuristics.' END AS reason
  FROM (SELECT *, list_has_any(['id', 'user_id', 'customer_id', 'email', 'phone', 'name', 'address', 'ssn', 'ip_address', 'uuid',
    'guid'], list_concat([lower(column_name)], string_split(lower(column_name), '_'))) AS named FROM (""" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS kind, count(DISTINCT {c}) / count(*) AS ratio FROM {t}"
    for t, names in _SCAN_COLUMNS.items() for c, k in names.items()) + ")))"


def _scanned(spark, sf_dir):
    result = None
    for table in _SCAN_COLUMNS:
        part = scan_privacy(load(spark, sf_dir, table)).withColumn("table_name", F.lit(table))
        result = part if result is None else result.unionByName(part)
    return result.select("table_name", "column_name", "warning_level", "reason")


@query("v3_privacy_scan", f"WITH {_SCAN} SELECT * FROM scan")
def v3(spark, sf_dir):
    return _scanned(spark, sf_dir)


@query("v4_privacy_alerts", f"WITH {_SCAN} SELECT * FROM scan WHERE warning_level <> 'SAFE'")
def v4(spark, sf_dir):
    return alerts(_scanned(spark, sf_dir))
