"""Column classes of a table and its long forms.

A cell of the long form is keyed by ``grp`` and ``cid``: ``grp`` is ROOT for
the whole table and ``=<value>`` for a group of the conditioning column, so
both levels come from one pass, like grouping sets; ``cid`` is the position of
the column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.missing import present

ROOT = ""
KEYS = ["grp", "cid"]
EXACT = 1 << 53


def column_class(dtype: T.DataType) -> str:
    """The class a column has when it holds at least one value."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    return "unsupported"


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema if column_class(f.dataType) in classes]


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def group_of(name: str) -> Column:
    """Key of a row's group; null where the conditioning column is missing."""
    return F.concat(F.lit("="), F.col(f"`{name}`").cast("string"))


def name_of(cid: Column, columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), cid + 1)


def _levels(group: Column | None) -> list[Column]:
    return [F.lit(ROOT)] + ([] if group is None else [group])


def _long(df: DataFrame, cells: list[tuple[int, list[Column]]], group: Column | None) -> DataFrame:
    structs = [
        F.struct(level.alias("grp"), F.lit(cid).alias("cid"), *values)
        for cid, values in cells
        for level in _levels(group)
    ]
    long = df.select(F.inline(F.array(*structs)))
    return long.where(F.col("grp").isNotNull() & F.col("value").isNotNull())


def numeric_rows(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(grp, v0, w0, v1, w1, ...): the group of each row, and per column its value and what a double cannot hold of it.

    Values are doubles. ``w`` keeps apart, and in order, integers beyond 2**53
    and decimals beyond 15 digits, which a double would merge; it is null otherwise.
    """
    types = {f.name: f.dataType for f in df.schema}
    fields = [(group_of(by) if by else F.lit(None).cast("string")).alias("grp")]
    for cid, name in enumerate(columns):
        col = present(name, types[name])
        wide = F.lit(None).cast("bigint")
        if isinstance(types[name], T.LongType):
            wide = F.when((col >= EXACT) | (col <= -EXACT), col)
        elif isinstance(types[name], T.DecimalType) and types[name].precision > 15:
            # what the double leaves out, in units of the last place: equal doubles of different values differ by it
            scale = types[name].scale
            near = col.cast("double").try_cast(T.DecimalType(38, scale))
            rest = (col.cast(T.DecimalType(38, scale)) - near).cast("double") * float(10**scale)
            wide = F.coalesce(F.round(rest).cast("bigint"), F.lit(0).cast("bigint"))
        fields += [col.cast("double").alias(f"v{cid}"), wide.alias(f"w{cid}")]
    return df.select(fields)


def row_cells(rows: DataFrame, cids: Iterable[int], by: bool, counters: dict[str, int] | None = None) -> DataFrame:
    """One row (grp, cid, value, wide) per present cell of ``numeric_rows``, for the table and each group.

    ``counters`` adds, under each of its names, 1 where the column it names is
    present in the same row, else 0.
    """
    beside = [F.when(F.col(f"v{i}").isNotNull(), 1).otherwise(0).cast("bigint").alias(c) for c, i in (counters or {}).items()]
    cells = [(i, [F.col(f"v{i}").alias("value"), F.col(f"w{i}").alias("wide"), *beside]) for i in cids]
    return _long(rows, cells, F.col("grp") if by else None)


def level_cells(rows: DataFrame, cids: Iterable[int], *carry: str) -> DataFrame:
    """One row (carried columns, cid, value, wide) per present cell; ``wide`` is 0 where a double says all."""
    cells = [F.struct(F.lit(i).alias("cid"), F.col(f"v{i}").alias("value"), F.coalesce(f"w{i}", F.lit(0).cast("bigint")).alias("wide"))
             for i in cids]
    return rows.select(*carry, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def numeric_cells(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """One row (grp, cid, value, wide) per present numeric cell."""
    return row_cells(numeric_rows(df, columns, by), range(len(columns)), by is not None)


def text_cells(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """One row (grp, cid, value) per present non-numeric cell.

    Categories keep their whole text; dates, arrays and the like, of which only
    the number of distinct values is wanted, go by a fixed-size digest.
    """
    types = {f.name: f.dataType for f in df.schema}
    cells = []
    for cid, name in enumerate(columns):
        col = present(name, types[name])
        kind = column_class(types[name])
        if kind in ("datetime", "boolean", "categorical"):
            text = col.cast("string")
        elif isinstance(types[name], T.BinaryType):
            text = F.md5(col)
        else:
            text = F.when(col.isNotNull(), F.md5(F.to_json(F.struct(col.alias("v")))))
        cells.append((cid, [text.alias("value")]))
    return _long(df, cells, group_of(by) if by else None)


def tally(cells: DataFrame, counters: Iterable[str] = ()) -> DataFrame:
    """Occurrences of each cell value, and sums of its counters, combined on the map side first."""
    keys = [c for c in cells.columns if c not in counters]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(c) for c in counters])


def group_sizes(df: DataFrame, by: str | None) -> DataFrame:
    """Rows of the whole table and of each group."""
    if by is None:
        return df.agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(ROOT).alias("grp"), "num_rows")
    levels = F.explode(F.array(F.lit(ROOT), group_of(by))).alias("grp")
    return (
        df.select(levels).where(F.col("grp").isNotNull())
        .groupBy("grp").agg(F.count(F.lit(1)).alias("num_rows"))
    )


#: The column number under which ``moments`` counts rows.
ROWS = -1


def moments(df: DataFrame, by: str | None = None) -> DataFrame:
    """What one pass tells of every column: (grp, cid, n, lo, hi, mean, m2, skew).

    ``cid`` is the place in the table, and ``ROWS`` counts the rows of a group.
    Central moments are kept per task and merged pairwise, by Spark's own
    aggregates, so no value travels; only numeric columns have them. A column
    without a present value has no row.
    """
    cells = [F.struct(F.lit(ROWS).alias("cid"), F.lit(True).alias("here"), F.lit(None).cast("double").alias("value"))]
    for cid, field in enumerate(df.schema):
        col = present(field.name, field.dataType)
        value = col if isinstance(field.dataType, T.NumericType) else F.lit(None)
        cells.append(F.struct(F.lit(cid).alias("cid"), col.isNotNull().alias("here"), value.cast("double").alias("value")))
    each = df.select(F.array(*_levels(group_of(by) if by else None)).alias("levels"), F.inline(F.array(*cells))).where("here")
    # a level's rows are made after the cells that are not there are gone
    long = each.select(F.explode("levels").alias("grp"), "cid", "value") if by else each.select(F.lit(ROOT).alias("grp"), "cid", "value")
    found = long.where(F.col("grp").isNotNull()).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"), F.skewness("value").alias("skew"))
    if by:
        return found
    # an empty table has its row all the same
    none = df.sparkSession.createDataFrame([(ROOT, ROWS, 0)], "grp string, cid int, n bigint")
    return found.unionByName(none, allowMissingColumns=True).groupBy(*KEYS).agg(
        F.max("n").alias("n"), *[F.max(c).alias(c) for c in ("lo", "hi", "mean", "m2", "skew")])
