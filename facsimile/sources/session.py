"""Session settings the wide plans of this package depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def prefer_compiled_methods(spark: SparkSession) -> None:
    """Keep generated methods within what HotSpot compiles, unless the user chose a limit.

    A plan that handles many columns at once can generate one method of more
    than 8000 bytes, which HotSpot only ever interprets. With the limit at
    8000, Spark's documented value for HotSpot, such a stage falls back to one
    compiled projection per operator, several times as fast.
    """
    if spark.conf.get(_LIMIT) == "65535":
        spark.conf.set(_LIMIT, "8000")
