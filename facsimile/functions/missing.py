"""Missing values: null and NaN mean the same thing everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens a CSV reader in the pandas tradition takes as missing.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into null."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(dtype))
    return col


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn every NaN of the table into null."""
    return df.select([present(f.name, f.dataType).alias(f.name) for f in df.schema])
