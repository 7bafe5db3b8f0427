"""Comparison of two tables and report tables."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from catalog.inputs import LINEITEM_NUMBERS, load, profile, sql_input, sql_numbers, validation
from catalog.registry import query, rounded
from facsimile import fidelity_run, numeric_fidelity, quality_report
from facsimile.operators import comparison
from facsimile.operators.columns import name_of
from facsimile.operators.correlation import pearson

_BOTH = (f"{sql_input('lineitem', 'r')}, {sql_input('lineitem_candidate', 's')}, "
         f"{sql_numbers(LINEITEM_NUMBERS, 'r', 'ur')}, {sql_numbers(LINEITEM_NUMBERS, 's', 'us')}")
_STATS = ", ".join(f"""{side} AS (
  SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi,
    quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3
  FROM {source} GROUP BY column_name)""" for side, source in (("a", "ur"), ("b", "us")))
_KS = """ks AS (
  SELECT column_name, max(abs(cr / nr - cs / ns)) AS ks_statistic, CAST(max(nr) AS BIGINT) AS n, CAST(max(ns) AS BIGINT) AS m FROM (
    SELECT column_name, sum(r) OVER w AS cr, sum(s) OVER w AS cs, sum(r) OVER (PARTITION BY column_name) AS nr,
      sum(s) OVER (PARTITION BY column_name) AS ns
    FROM (SELECT column_name, value, sum(r) AS r, sum(s) AS s FROM (
      SELECT column_name, value, 1 AS r, 0 AS s FROM ur UNION ALL SELECT column_name, value, 0, 1 FROM us)
      WHERE value IS NOT NULL GROUP BY column_name, value)
    WINDOW w AS (PARTITION BY column_name ORDER BY value)) GROUP BY column_name)"""
_SIZE = "greatest(round(CAST(n AS DOUBLE) * m / (n + m)), 1)"
_PLAIN = f"ks_statistic * sqrt({_SIZE})"
_X = f"(CASE WHEN ks_statistic = 0 THEN 0.0 ELSE {_PLAIN} + 1.0 / (6 * sqrt({_SIZE})) + ({_PLAIN} - 1.0) / (4 * {_SIZE}) END)"
_UPPER = " + ".join(f"{'2.0' if k % 2 else '-2.0'} * exp({-2.0 * k * k} * {_X} * {_X})" for k in range(1, 9))
_LOWER = " + ".join(f"exp({-((2 * k - 1) ** 2) / 8.0} * pi() * pi() / ({_X} * {_X}))" for k in range(1, 5))
_P = f"""CASE WHEN {_X} <= 0.04 THEN 1.0 WHEN {_X} < 1.18 THEN 1.0 - ({_LOWER}) * sqrt(2.0 * pi()) / {_X}
  ELSE greatest({_UPPER}, 0.0) END"""
# The share of lattice paths that touch the bound, diagonal by diagonal: only for sides of up to 10,000 values.
_WALK = """walk AS (
  SELECT column_name, n, m, ks_statistic, round(ks_statistic * n * m) AS reach, 0 AS s,
    list_transform(range(0, CAST(n AS BIGINT) + 1), lambda i: CAST(0 AS DOUBLE)) AS g FROM ks WHERE greatest(n, m) <= 10000
  UNION ALL
  SELECT column_name, n, m, ks_statistic, reach, s + 1, list_transform(range(0, CAST(n AS BIGINT) + 1), lambda i:
    CASE WHEN i > s + 1 OR s + 1 - i > m THEN 0 WHEN abs(i * m - (s + 1 - i) * n) >= reach THEN 1
      ELSE (CASE WHEN i > 0 THEN g[i] * i ELSE 0 END + g[i + 1] * (s + 1 - i)) / (s + 1) END)
  FROM walk WHERE s < n + m AND reach > 0),
  exact AS (SELECT column_name, CASE WHEN reach > 0 THEN g[-1] ELSE 1.0 END AS p FROM walk WHERE s = n + m OR reach <= 0)"""
_ERROR = """(abs(a.mean - b.mean) / greatest(abs(a.mean), 1e-5) + abs(a.q2 - b.q2) / greatest(abs(a.q2), 1e-5)
  + abs(a.std - b.std) / greatest(abs(a.std), 1e-5)
  + (abs(a.q1 - b.q1) + abs(a.q2 - b.q2) + abs(a.q3 - b.q3)) / 3
    / greatest((abs(a.q1) + abs(a.q2) + abs(a.q3)) / 3, 1e-5)) / 4"""


def _pearson_sql(source: str, alias: str) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS rho FROM {source}"
        for a, b in combinations_with_replacement(LINEITEM_NUMBERS, 2))
    return f"""{alias}h AS ({pairs}), {alias} AS (
  SELECT * FROM {alias}h UNION ALL SELECT col_b, col_a, rho FROM {alias}h WHERE col_a <> col_b)"""


_CORR = f"{_pearson_sql('r', 'cr')}, {_pearson_sql('s', 'cs')}"
_SCORE = f"""score AS (
  SELECT similarity, greatest(0, 1 - off) AS kept, error, off,
    100 * (0.4 * similarity + 0.4 * greatest(0, 1 - error) + 0.2 * greatest(0, 1 - off)) AS overall
  FROM (SELECT avg(1 - ks_statistic) AS similarity FROM ks),
    (SELECT avg({_ERROR}) AS error FROM a JOIN b USING (column_name)),
    (SELECT avg(abs(cr.rho - cs.rho)) AS off FROM cr JOIN cs USING (col_a, col_b)))"""


def _columns(spark, sf_dir):
    return validation(spark, sf_dir).columns


def _paired(spark, sf_dir):
    return comparison.paired_values(
        load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "lineitem_candidate"), LINEITEM_NUMBERS)


_DISPATCH = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{'numeric' if c in LINEITEM_NUMBERS else 'categorical'}' AS type, "
    f"(SELECT count({c}) FROM r) AS n_ref, (SELECT count({c}) FROM s) AS n_synth, 'compared' AS status"
    for i, c in enumerate(LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus"]))


@query("q1_column_pairing", f"""
WITH {sql_input('lineitem', 'r')}, {sql_input('lineitem_candidate', 's')} {_DISPATCH}
UNION ALL SELECT 10, 'void', 'numeric', count(*), 0, 'empty' FROM r""")
def q1(spark, sf_dir):
    ref = load(spark, sf_dir, "lineitem").withColumn("void", F.col("l_quantity")).withColumn("only_here", F.lit(1))
    synth = load(spark, sf_dir, "lineitem_candidate").withColumn("void", F.expr("nullif(l_tax, l_tax)"))
    return comparison.dispatch(ref, synth)


@query("q2_ks_statistic", f"WITH {_BOTH}, {_KS} SELECT column_name, round(ks_statistic, 9) AS ks_statistic FROM ks")
def q2(spark, sf_dir):
    return comparison.ks_statistics(_paired(spark, sf_dir)).select(
        name_of(F.col("cid"), LINEITEM_NUMBERS).alias("column_name"), rounded("ks_statistic", 9))


@query("q3_ks_p_value", f"""
WITH RECURSIVE {_BOTH}, {_KS.replace("ks AS (", "ks AS MATERIALIZED (", 1)}, {_WALK}
SELECT column_name, round(CASE WHEN greatest(n, m) <= 10000 THEN exact.p ELSE {_P} END, 6) AS ks_p_value
FROM ks LEFT JOIN exact USING (column_name)""")
def q3(spark, sf_dir):
    return _columns(spark, sf_dir).where("type = 'numeric'").select("column_name", rounded("ks_p_value"))


_SEGMENTS = {"r": "BUILDING", "s": "MACHINERY"}
_CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("q3_ks_exact", f"""
WITH RECURSIVE {", ".join(f"{side} AS (SELECT * FROM customer WHERE c_mktsegment = '{segment}')" for side, segment in _SEGMENTS.items())},
  {sql_numbers(_CUSTOMER_NUMBERS, 'r', 'ur')}, {sql_numbers(_CUSTOMER_NUMBERS, 's', 'us')},
  {_KS.replace("ks AS (", "ks AS MATERIALIZED (", 1)}, {_WALK}
SELECT column_name, n AS n_ref, m AS n_synth, round(ks_statistic, 9) AS ks_statistic,
  round(CASE WHEN greatest(n, m) <= 10000 THEN exact.p ELSE {_P} END, 9) AS ks_p_value
FROM ks LEFT JOIN exact USING (column_name)""")
def q3_exact(spark, sf_dir):
    """Customers of one market segment against those of another, few enough for the exact distribution."""
    ref, synth = (load(spark, sf_dir, "customer").where(F.col("c_mktsegment") == s) for s in _SEGMENTS.values())
    values = comparison.paired_values(ref, synth, _CUSTOMER_NUMBERS)
    return comparison.ks_statistics(values).select(
        name_of(F.col("cid"), _CUSTOMER_NUMBERS).alias("column_name"), "n_ref", "n_synth",
        rounded("ks_statistic", 9), rounded("ks_p_value", 9))


@query("q4_moment_differences", f"""
WITH {_BOTH}, {_STATS} SELECT column_name, round(abs(a.mean - b.mean), 6) AS mean_diff, round(abs(a.q2 - b.q2), 6) AS median_diff,
  round(abs(a.std - b.std), 6) AS std_diff FROM a JOIN b USING (column_name)""")
def q4(spark, sf_dir):
    return _columns(spark, sf_dir).where("type = 'numeric'").select(
        "column_name", rounded("mean_diff"), rounded("median_diff"), rounded("std_diff"))


@query("q5_quantile_difference", f"""
WITH {_BOTH}, {_STATS} SELECT column_name, round((abs(a.q1 - b.q1) + abs(a.q2 - b.q2) + abs(a.q3 - b.q3)) / 3, 6) AS quantile_diff
FROM a JOIN b USING (column_name)""")
def q5(spark, sf_dir):
    return _columns(spark, sf_dir).where("type = 'numeric'").select("column_name", rounded("quantile_diff"))


@query("q6_distribution_error", f"""
WITH {_BOTH}, {_STATS} SELECT column_name, round({_ERROR}, 6) AS numeric_distribution_error FROM a JOIN b USING (column_name)""")
def q6(spark, sf_dir):
    return _columns(spark, sf_dir).where("type = 'numeric'").select("column_name", rounded("numeric_distribution_error"))


@query("q7_ranges", f"""
WITH {_BOTH}, {_STATS} SELECT column_name, round(a.lo, 6) AS range_ref_min, round(a.hi, 6) AS range_ref_max,
  round(b.lo, 6) AS range_synth_min, round(b.hi, 6) AS range_synth_max FROM a JOIN b USING (column_name)""")
def q7(spark, sf_dir):
    return _columns(spark, sf_dir).where("type = 'numeric'").select(
        "column_name", *[rounded(f"range_{c}") for c in ("ref_min", "ref_max", "synth_min", "synth_max")])


@query("q8_category_difference", f"""
WITH {sql_input('lineitem', 'r')}, {sql_input('lineitem_candidate', 's')} """ + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(avg(abs(coalesce(a.f, 0) - coalesce(b.f, 0))), 9) AS mean_freq_diff FROM
  (SELECT {c} AS v, count(*) / sum(count(*)) OVER () AS f FROM r WHERE {c} IS NOT NULL GROUP BY {c}) a FULL JOIN
  (SELECT {c} AS v, count(*) / sum(count(*)) OVER () AS f FROM s WHERE {c} IS NOT NULL GROUP BY {c}) b ON a.v = b.v"""
    for c in ("l_returnflag", "l_linestatus")))
def q8(spark, sf_dir):
    return comparison.category_metrics(
        load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "lineitem_candidate"), ["l_returnflag", "l_linestatus"],
    ).select("column_name", rounded("mean_freq_diff", 9))


@query("q9_correlation_error", f"""
WITH {sql_input('lineitem', 'r')}, {sql_input('lineitem_candidate', 's')}, {_CORR}
SELECT round(avg(abs(cr.rho - cs.rho)), 9) AS mean_absolute_correlation_error FROM cr JOIN cs USING (col_a, col_b)""")
def q9(spark, sf_dir):
    error = comparison.correlation_error(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "lineitem_candidate"))
    return error.select(rounded("mean_absolute_correlation_error", 9))


@query("q9_pearson_matrix", f"""
WITH {sql_input('lineitem_candidate', 's')}, {_pearson_sql('s', 'cs')} SELECT col_a, col_b, round(rho, 9) AS rho FROM cs""")
def q9b(spark, sf_dir):
    return pearson(load(spark, sf_dir, "lineitem_candidate"), LINEITEM_NUMBERS).select("col_a", "col_b", rounded("rho", 9))


@query("q10_quality_score", f"""
WITH {_BOTH}, {_STATS}, {_KS}, {_CORR}, {_SCORE}
SELECT round(similarity, 9) AS distribution_similarity, round(kept, 9) AS correlation_preservation,
  round(error, 9) AS average_numeric_distribution_error, round(overall, 6) AS overall FROM score""")
def q10(spark, sf_dir):
    return validation(spark, sf_dir).score.select(
        rounded("distribution_similarity", 9), rounded("correlation_preservation", 9),
        rounded("average_numeric_distribution_error", 9), rounded("overall"))


_ORDER_KINDS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
                "o_orderdate": "datetime", "o_orderpriority": "categorical", "is_large": "boolean"}
_VIEW = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS type, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, "
    f"count(DISTINCT {c}) AS \"unique\", "
    + (f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, " if k == "numeric"
       else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, ")
    + (f"count({c}) > 0 AND count(DISTINCT {c}) = count({c}) AS is_primary_key, " if "key" in c else "false AS is_primary_key, ")
    + "CAST(NULL AS VARCHAR) AS semantic_type FROM g"
    for c, k in _ORDER_KINDS.items())


@query("r1_profile_view", f"WITH {sql_input('orders_flags', 'g')} {_VIEW}")
def r1(spark, sf_dir):
    view = profile(spark, sf_dir, "orders_flags").view()
    return view.select("column", "type", rounded("missing_pct"), "unique", rounded("min"), rounded("max"), rounded("mean"),
                       "is_primary_key", "semantic_type")


@query("r2_numeric_fidelity", f"""
WITH {_BOTH}, {_STATS}, {_KS} SELECT column_name AS "column", round(ks_statistic, 9) AS ks,
  round(abs(a.mean - b.mean), 6) AS mean_error, round(abs(a.q2 - b.q2), 6) AS median_error
FROM a JOIN b USING (column_name) JOIN ks USING (column_name)""")
def r2(spark, sf_dir):
    return numeric_fidelity(validation(spark, sf_dir)).select(
        "column", rounded("ks", 9), rounded("mean_error"), rounded("median_error"))


@query("r3_quality_report", f"""
WITH {_BOTH}, {_STATS}, {_KS}, {_CORR}, {_SCORE}
SELECT 'dataset' AS section, 'table' AS item, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS figure FROM r
UNION ALL SELECT 'dataset', 'table', 'columns', 11
UNION ALL SELECT 'quality', 'table', 'overall', round(overall, 5) FROM score
UNION ALL SELECT 'quality', 'table', 'correlation_error', round(off, 5) FROM score
UNION ALL SELECT 'numeric', column_name, 'ks', round(ks_statistic, 5) FROM ks
UNION ALL SELECT 'numeric', column_name, 'mean_error', round(abs(a.mean - b.mean), 5) FROM a JOIN b USING (column_name)
UNION ALL SELECT 'numeric', column_name, 'median_error', round(abs(a.q2 - b.q2), 5) FROM a JOIN b USING (column_name)
UNION ALL SELECT 'profile', column_name, 'mean', round(mean, 5) FROM a
UNION ALL SELECT 'profile', column_name, 'min', round(lo, 5) FROM a
UNION ALL SELECT 'profile', column_name, 'max', round(hi, 5) FROM a
UNION ALL SELECT 'profile', column_name, 'unique', count(DISTINCT value) FROM ur GROUP BY column_name
UNION ALL SELECT 'profile', column_name, 'missing_pct', 0 FROM a""")
def r3(spark, sf_dir):
    report = quality_report(profile(spark, sf_dir, "lineitem"), validation(spark, sf_dir))
    labels = F.col("item").isin("l_returnflag", "l_linestatus", "l_shipdate")
    return report.where(~labels).select(
        "section", "item", "metric", rounded(F.col("value").try_cast("double"), 5, alias="figure")).where("figure IS NOT NULL")


@query("r4_end_to_end", """
SELECT count(*) AS num_rows, CAST(6 AS INTEGER) AS profiled, CAST(5 AS INTEGER) AS compared, CAST(2 AS BIGINT) AS alerts,
  true AS good_score FROM events""")
def r4(spark, sf_dir):
    source = load(spark, sf_dir, "events")
    run = fidelity_run(source, rows=source.count())
    counts = run.synthetic.agg(F.count(F.lit(1)).alias("num_rows"))
    profiled = run.profile.view().count()
    compared = run.validation.columns.where("status = 'compared'").count()
    alerts = run.report.where("section = 'privacy' AND metric = 'level'").count()
    score = run.validation.score.first()["overall"]
    return counts.select("num_rows", F.lit(profiled).cast("int").alias("profiled"), F.lit(compared).cast("int").alias("compared"),
                         F.lit(alerts).cast("bigint").alias("alerts"), F.lit(score > 85).alias("good_score"))
