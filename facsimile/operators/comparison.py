"""How far a synthetic table is from its reference, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.estimators import EXACT_SIDE, exact_kolmogorov_p, kolmogorov_p
from facsimile.functions.missing import present
from facsimile.operators.columns import KEYS, column_class, name_of, numeric_cells, text_cells
from facsimile.operators.correlation import pearson
from facsimile.operators.numeric import QUARTILES, numeric_summary, ordered_values
from facsimile.operators.ordered import Ordered
from facsimile.operators.sizing import broadcast_if_small
from facsimile.sources.staging import stage

NUMERIC = "numeric"
CATEGORICAL = "categorical"


def paired_columns(ref: DataFrame, synth: DataFrame) -> list[tuple[str, str]]:
    """Columns in both tables and how to compare them; the reference decides the class."""
    kinds = {"numeric": NUMERIC, "boolean": CATEGORICAL, "categorical": CATEGORICAL}
    pairs = [(f.name, kinds.get(column_class(f.dataType))) for f in ref.schema if f.name in synth.columns]
    return [(name, kind) for name, kind in pairs if kind]


def listing(ref: DataFrame, synth: DataFrame) -> DataFrame:
    """(position, column_name, type) of each compared column."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(paired_columns(ref, synth))]
    return ref.sparkSession.createDataFrame(rows, "position int, column_name string, type string")


def dispatch(ref: DataFrame, synth: DataFrame) -> DataFrame:
    """(position, column_name, type, n_ref, n_synth, status) for each compared column."""
    pairs = paired_columns(ref, synth)
    names = [n for n, _ in pairs]
    counted = None
    for side, df in (("ref", ref), ("synth", synth)):
        counts = df.select([F.count(_clean(df, n)).alias(f"c{i}") for i, n in enumerate(names)])
        long = counts.select(F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("position", f"n_{side}"))
        counted = long if counted is None else counted.join(long, "position")
    kinds = F.element_at(F.array(*[F.lit(k) for _, k in pairs]), F.col("position") + 1)
    empty = (F.col("n_ref") == 0) | (F.col("n_synth") == 0)
    return counted.select(
        "position", name_of(F.col("position"), names).alias("column_name"), kinds.alias("type"),
        "n_ref", "n_synth", F.when(empty, "empty").otherwise("compared").alias("status"))


def _clean(df: DataFrame, name: str) -> Column:
    return present(name, df.schema[name].dataType)


def _as_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """The synthetic side of numeric columns; whatever is no number counts as missing."""
    cols = []
    for n in names:
        numeric = isinstance(df.schema[n].dataType, T.NumericType)
        cols.append(F.col(f"`{n}`") if numeric else F.col(f"`{n}`").cast("string").try_cast("double").alias(n))
    return df.select(cols)


def paired_values(ref: DataFrame, synth: DataFrame, names: list[str]) -> Ordered:
    """Ordered values of the numeric columns with their counts on either side."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    left = numeric_cells(ref, names).drop("wide").withColumns({"ref": one, "synth": none})
    right = numeric_cells(_as_numbers(synth, names), names).drop("wide").withColumns({"ref": none, "synth": one})
    counts = left.unionByName(right).groupBy(*KEYS, "value").agg(F.sum("ref").alias("ref"), F.sum("synth").alias("synth"))
    return ordered_values(counts, ["ref", "synth"], "paired-values")


def ks_aggregate() -> Column:
    """Largest distance between the two empirical distribution functions, over positioned rows."""
    share = lambda w: F.try_divide(F.col(f"cum_{w}").cast("double"), F.col(f"n_{w}").cast("double"))
    return F.max(F.abs(share("ref") - share("synth")))


def ks_statistics(values: Ordered) -> DataFrame:
    """(grp, cid, n_ref, n_synth, ks_statistic, ks_p_value)."""
    rows = values.positioned("n_ref", "n_synth").groupBy(*KEYS).agg(
        F.first("n_ref").alias("n_ref"), F.first("n_synth").alias("n_synth"), ks_aggregate().alias("ks_statistic"))
    return with_p_values(rows.where("n_ref > 0 AND n_synth > 0"))


def with_p_values(rows: DataFrame) -> DataFrame:
    """Adds ``ks_p_value`` to rows with n_ref, n_synth and ks_statistic.

    Up to ``EXACT_SIDE`` values on the larger side the exact two-sample
    distribution is counted, each column in a task of its own; beyond, the limit law
    at the effective size of both samples.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("ks_p_value", T.DoubleType())])

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            figures = [batch.column(c).to_pylist() for c in ("n_ref", "n_synth", "ks_statistic")]
            p = [exact_kolmogorov_p(n, m, round(d * n * m)) if max(n, m) <= EXACT_SIDE else None for n, m, d in zip(*figures)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "ks_p_value"])

    limit = kolmogorov_p(F.col("ks_statistic"), F.col("n_ref"), F.col("n_synth"))
    # one row per column; a task each, as counting takes up to half a second
    return rows.repartition(32, *KEYS).mapInArrow(counted, schema).withColumn("ks_p_value", F.coalesce("ks_p_value", limit))


def numeric_metrics(ref: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    """All distances of the numeric columns, one row per column with values on both sides."""
    values = paired_values(ref, synth, names)
    stats = numeric_summary(values, ["ref", "synth"], {"ks_statistic": ks_aggregate()})
    both = with_p_values(stats.where("n_ref > 0 AND n_synth > 0"))
    diff = lambda m: F.abs(F.col(f"{m}_ref") - F.col(f"{m}_synth"))
    relative = lambda m: diff(m) / F.greatest(F.abs(F.col(f"{m}_ref")), F.lit(1e-5))
    # A spread is compared only if both sides have more than one value.
    both = both.withColumns({
        f"std_{w}": F.when((F.col("n_ref") > 1) & (F.col("n_synth") > 1), F.col(f"std_{w}")).otherwise(F.lit(0.0))
        for w in ("ref", "synth")
    })
    size = F.lit(0.0)
    apart = F.lit(0.0)
    for q in QUARTILES:
        apart = apart + diff(q)
        size = size + F.abs(F.col(f"{q}_ref"))
    both = both.withColumns({"quantile_diff": apart / 3.0, "_size": size / 3.0})
    quantile = F.col("quantile_diff") / F.greatest(F.col("_size"), F.lit(1e-5))
    return both.select(
        name_of(F.col("cid"), names).alias("column_name"),
        "ks_statistic", "ks_p_value",
        diff("mean").alias("mean_diff"), diff("median").alias("median_diff"), diff("std").alias("std_diff"),
        "quantile_diff",
        ((relative("mean") + relative("median") + relative("std") + quantile) / 4.0).alias("numeric_distribution_error"),
        F.col("min_ref").alias("range_ref_min"), F.col("max_ref").alias("range_ref_max"),
        F.col("min_synth").alias("range_synth_min"), F.col("max_synth").alias("range_synth_max"),
    )


def category_metrics(ref: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    """Mean frequency distance over the union of categories: (column_name, mean_freq_diff)."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    as_text = synth.select([_clean(synth, n).cast("string").alias(n) for n in names])
    left = text_cells(ref, names).withColumns({"ref": one, "synth": none})
    right = text_cells(as_text, names).withColumns({"ref": none, "synth": one})
    counts = left.unionByName(right).groupBy(*KEYS, "value").agg(F.sum("ref").alias("ref"), F.sum("synth").alias("synth"))
    # read twice, for the totals and for the frequencies
    counts = stage(counts, "paired-labels")
    totals = counts.groupBy(*KEYS).agg(F.sum("ref").alias("n_ref"), F.sum("synth").alias("n_synth"))
    totals = totals.where("n_ref > 0 AND n_synth > 0")
    apart = F.abs(F.col("ref") / F.col("n_ref") - F.col("synth") / F.col("n_synth"))
    # one row of totals per column
    return (
        counts.join(broadcast_if_small(totals, len(names)), KEYS)
        .groupBy("cid").agg(F.avg(apart).alias("mean_freq_diff"))
        .select(name_of(F.col("cid"), names).alias("column_name"), "mean_freq_diff")
    )


def correlation_error(ref: DataFrame, synth: DataFrame) -> DataFrame | None:
    """Mean distance over all cells of the two linear correlation matrices; None under two columns."""
    numeric = lambda df: [f.name for f in df.schema if column_class(f.dataType) == "numeric"]
    shared = [c for c in numeric(ref) if c in numeric(synth)]
    if len(shared) < 2:
        return None
    cells = ["col_a", "col_b"]
    left = pearson(ref, shared).select(*cells, F.col("rho").alias("rho_ref"))
    right = pearson(synth, shared).select(*cells, F.col("rho").alias("rho_synth"))
    return left.join(right, cells).agg(
        F.avg(F.abs(F.col("rho_ref") - F.col("rho_synth"))).alias("mean_absolute_correlation_error"))


def quality_score(columns: DataFrame, correlation: DataFrame | None) -> DataFrame:
    """One row: distribution similarity, correlation preservation, mean error and the 0-100 score."""
    numeric = columns.agg(
        F.avg(1.0 - F.col("ks_statistic")).alias("similarity"),
        F.avg("numeric_distribution_error").alias("error"),
    )
    if correlation is None:
        joined = numeric.withColumn("mean_absolute_correlation_error", F.lit(None).cast("double"))
    else:
        # both are single rows
        joined = numeric.withColumn("row", F.lit(1)).join(
            F.broadcast(correlation.withColumn("row", F.lit(1))), "row").drop("row")
    similarity = F.coalesce("similarity", F.lit(1.0))
    error = F.coalesce("error", F.lit(0.0))
    off = F.coalesce("mean_absolute_correlation_error", F.lit(0.0))
    kept = F.greatest(F.lit(0.0), 1.0 - off)
    accurate = F.greatest(F.lit(0.0), 1.0 - error)
    return joined.select(
        similarity.alias("distribution_similarity"), kept.alias("correlation_preservation"),
        error.alias("average_numeric_distribution_error"), "mean_absolute_correlation_error",
        ((similarity * 0.4 + accurate * 0.4 + kept * 0.2) * 100.0).alias("overall"))
