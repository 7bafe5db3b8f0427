"""Input tables of the registered queries, and what several queries share.

Every input is a whole driver table. Missing values, constants and booleans,
which those tables lack, come from rules on their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile import Profiler, generate_table, validate_tables
from facsimile.sources.staging import stage

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]

# name: (driver table, {column: SQL expression}); the expressions run on both engines
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "lineitem_gaps": ("lineitem", {
        "l_discount": "CASE WHEN l_returnflag <> 'R' THEN l_discount END",
        "l_tax": "CASE WHEN l_tax <> 0 THEN l_tax END",
    }),
    "lineitem_candidate": ("lineitem", {
        "l_quantity": "l_quantity + l_linenumber",
        "l_extendedprice": "l_extendedprice * (1 - l_discount)",
        "l_tax": "CASE WHEN l_tax <> 0 THEN l_tax END",
        "l_returnflag": "CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END",
    }),
    "orders_flags": ("orders", {
        "o_custkey": "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END",
        "o_orderpriority": "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END",
        "is_large": "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice > 250000 END",
    }),
    "customer_people": ("customer", {
        "contact_email": "c_name", "fname": "c_mktsegment", "LNAME": "c_mktsegment", "company_name": "c_mktsegment",
        "mobile": "c_name", "street": "c_mktsegment", "home_town": "c_mktsegment", "postal_code": "c_mktsegment",
        "country": "c_mktsegment", "employer": "c_mktsegment", "segment": "c_mktsegment",
    }),
    "customer_gaps": ("customer", {
        "c_acctbal": "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END",
        "c_name": "CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END",
        "in_debt": "CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal < 0 END",
        "name_key": "c_name",
        "flat_rate": "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey * 0 + 7.5 END",
        "worth": "c_custkey * 10 + c_acctbal / 10",
    }),
    "customer_letters": ("customer", {
        c: f"CASE WHEN (c_custkey * {m}) % 10 > 0 THEN c_acctbal + c_custkey % {k} END"
        for k, (c, m) in enumerate({"high": 7, "name": 3, "length": 9, "rating": 1, "month": 11, "quota": 13}.items(), 2)
    }),
    "part_shapes": ("part", {
        "half_skewed": "p_retailprice * p_retailprice * p_retailprice * 1e-6",
        "squared_size": "p_size * p_size * 1.5",
    }),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one derived from it."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table, rules = DERIVED[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select([F.expr(rules.get(c, f"`{c}`")).alias(c) for c in df.columns]
                     + [F.expr(e).alias(c) for c, e in rules.items() if c not in df.columns])


_shared: dict = {}


def forget() -> None:
    """Drop everything shared between queries, so the next one computes it anew."""
    _shared.clear()


def _once(spark: SparkSession, key: tuple, make):
    key = (spark.sparkContext.applicationId, *key)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def profiler(spark: SparkSession, sf_dir: str, name: str, **options) -> Profiler:
    """A table's profiler; those that differ in their noise alone share their counts."""
    def make():
        plain = {k: v for k, v in options.items() if k != "epsilon"}
        if len(plain) < len(options):
            return profiler(spark, sf_dir, name, **plain).noised(options["epsilon"])
        return Profiler(load(spark, sf_dir, name), **options)

    return _once(spark, (sf_dir, name, "profiler", *sorted(options.items())), make)


def profile(spark: SparkSession, sf_dir: str, name: str, **options):
    make = lambda: profiler(spark, sf_dir, name, **options).run()
    return _once(spark, (sf_dir, name, "profile", *sorted(options.items())), make)


def synthetic(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A staged synthetic table as long as its source."""
    def make():
        rows = load(spark, sf_dir, name).count()
        return stage(generate_table(profile(spark, sf_dir, name, **options), rows), "synthetic")

    return _once(spark, (sf_dir, name, "synthetic", *sorted(options.items())), make)


def validation(spark: SparkSession, sf_dir: str):
    """Lineitem against its altered copy."""
    make = lambda: validate_tables(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "lineitem_candidate"))
    return _once(spark, (sf_dir, "validation"), make)


# --- the same inputs for SQL ----------------------------------------------------

def sql_input(name: str, alias: str) -> str:
    """A common table expression for an input."""
    if name not in DERIVED:
        return f"{alias} AS (SELECT * FROM {name})"
    table, rules = DERIVED[name]
    known = {
        "lineitem": LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    }[table]
    kept = [f"{rules.get(c, c)} AS {c}" for c in known] + [f"{e} AS {c}" for c, e in rules.items() if c not in known]
    return f"{alias} AS (SELECT {', '.join(kept)} FROM {table})"


def sql_numbers(columns: list[str], source: str, alias: str, group: str | None = None) -> str:
    """Numeric columns in long form: (grp, column_name, value)."""
    levels = ["''"] + ([f"'=' || CAST({group} AS VARCHAR)"] if group else [])
    parts = [
        f"SELECT {level} AS grp, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {source}"
        + (f" WHERE {group} IS NOT NULL" if level != "''" else "")
        for c in columns for level in levels
    ]
    return f"{alias} AS ({' UNION ALL '.join(parts)})"
