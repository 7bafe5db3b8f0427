"""Reference tables in, synthetic tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions.missing import CSV_NULL_TOKENS, normalize_missing
from facsimile.sources import quoted_csv


class EmptyTableError(ValueError):
    """The table has no row to profile."""


#: One dialect both ways: quotes are doubled, blanks belong to the value.
_DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What a number looks like; Spark's cast alone would also take a type suffix, as in 10d.
_NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def read_table(spark: SparkSession, path: str, format: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a CSV or Parquet table and normalise its missing values.

    CSV is read as text first, so that every missing-value token is dropped
    before types are decided; one aggregate over the file then settles each
    column as bigint, double, boolean or string. ``multi_line`` admits line breaks
    inside quotes; one file is still read by many tasks (see ``quoted_csv``), and
    its cells are staged once as Parquet. Folders with partition columns are left
    to Spark's own reader, one task a file.
    """
    if (format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")) != "csv":
        return normalize_missing(spark.read.format(format or "parquet").load(path))
    text = spark.read.options(**_DIALECT, multiLine=multi_line).csv(path)
    columns = text.columns
    if not columns:
        raise EmptyTableError(f"{path} has no header and no row")
    if multi_line and len(spark.read.text(path).columns) == 1:
        text = quoted_csv.read(spark, path, columns, _DIALECT)
    clean = text.select([
        F.when(~F.col(f"`{c}`").isin(CSV_NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in columns
    ])
    trials = {"bigint": "bigint", "double": "double", "boolean": "boolean"}
    tests = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        tests.append(F.count(col).alias(f"n{i}"))
        for kind in trials:
            accepted = col.try_cast(kind)
            if kind == "double":
                accepted = F.when(col.rlike(_NUMBER), accepted)
            if kind == "boolean":
                accepted = F.when(F.lower(col).isin("true", "false"), accepted)
            tests.append(F.count(accepted).alias(f"{kind}{i}"))
    seen = clean.agg(*tests).first()
    chosen = []
    for i, c in enumerate(columns):
        kind = next((k for k in trials if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]), "string")
        chosen.append(F.col(f"`{c}`").try_cast(kind).alias(c))
    return normalize_missing(clean.select(chosen))


def require_rows(df: DataFrame) -> DataFrame:
    """Pass the table through, or fail if it has no row."""
    if df.isEmpty():
        raise EmptyTableError("the reference table is empty")
    return df


def write_table(df: DataFrame, path: str, format: str = "csv", multi_line: bool = False) -> None:
    """Write a table as headed CSV, or in any other Spark format.

    What :func:`read_table` reads back equals what was written, but for texts that
    are missing-value tokens. A line break in a value fails the write unless
    ``multi_line`` says that readers expect it.
    """
    if format != "csv":
        df.write.mode("error").format(format).save(path)
        return
    if not multi_line:
        texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
        broken = F.raise_error(F.lit("a value holds a line break: write and read with multi_line=True"))
        df = df.select([
            F.when(col.rlike("[\\r\\n]"), broken).otherwise(col).alias(c) if c in texts else col
            for c in df.columns for col in (F.col(f"`{c}`"),)])
    df.write.mode("error").options(**_DIALECT).csv(path)
