"""Saving and loading profiles."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.plans.profile import PARTS, Profile

# The layout of a saved profile; reading never has to infer a type.
PROFILE_SCHEMAS = {
    "meta": "grp string, num_rows bigint, num_columns int, conditional_by_column string, dp_epsilon double",
    "columns": "grp string, position int, column_name string, inferred_type string, nullable boolean, "
               "num_unique bigint, missing_count bigint, missing_percentage double, min_value double, "
               "max_value double, mean double, std_dev double, median double, q1 double, q3 double, iqr double, "
               "skewness double, is_discrete boolean, is_primary_key boolean, semantic_type string, decimals int",
    "histogram": "grp string, bin bigint, left_edge double, right_edge double, count bigint, column_name string",
    "sample": "grp string, idx bigint, value double, column_name string",
    "frequencies": "grp string, value string, weight bigint, frequency double, column_name string",
    "correlations": "grp string, col_a string, col_b string, rho double",
    "warnings": "position int, column_name string, warning_level string, reason string",
    "table": "table_schema string",
}


def save_profile(profile: Profile, path: str, format: str = "json") -> None:
    """Write each table of the profile to its own folder under ``path``."""
    spark = profile.spark
    parts = {name: getattr(profile, name) for name in PARTS}
    parts["table"] = spark.createDataFrame([(profile.table_schema,)], PROFILE_SCHEMAS["table"])
    for name, frame in parts.items():
        fields = T.StructType.fromDDL(PROFILE_SCHEMAS[name]).fieldNames()
        frame.select(*fields).write.mode("error").format(format).save(f"{path}/{name}")


def load_profile(spark: SparkSession, path: str, format: str = "json") -> Profile:
    """Read a saved profile back."""
    read = lambda name: spark.read.schema(PROFILE_SCHEMAS[name]).format(format).load(f"{path}/{name}")
    table_schema = read("table").first()["table_schema"]
    return Profile(**{name: read(name) for name in PARTS}, table_schema=table_schema)
