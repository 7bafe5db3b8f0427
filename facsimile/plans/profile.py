"""Profile of a table: everything the generator may know about it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators import categories, columns, correlation, numeric
from facsimile.operators.columns import KEYS, ROOT
from facsimile.operators.ordered import Ordered
from facsimile.operators.privacy import scan_privacy
from facsimile.operators.sizing import broadcast_if_small
from facsimile.plans.together import together
from facsimile.sources.session import prefer_compiled_methods
from facsimile.sources.staging import keep, stage


def _before_noise(step) -> cached_property:
    """A step that profilers of one table share, whatever their noise; computed when the first of them asks for it."""
    return cached_property(wraps(step)(lambda self: getattr(self.source, step.__name__) if self.source else step(self)))


class Profiler:
    """The steps of a profile, each computed once when first asked for."""

    #: The profiler whose counts this one shares, if it was made by ``noised``.
    source: Profiler | None = None

    def __init__(self, df: DataFrame, conditional_by: str | None = None, epsilon: float | None = None,
                 auto_clean_outliers: bool = False, smart_pii: bool = False, seed: int = 0):
        prefer_compiled_methods(df.sparkSession)
        self.df = df
        self.by = conditional_by if conditional_by in df.columns else None
        self.epsilon, self.seed = epsilon, seed
        self.cap, self.semantic = auto_clean_outliers, smart_pii
        self.names = df.columns
        self.numeric_names = columns.columns_of(df, "numeric")
        self.label_names = [c for c in df.columns if c not in self.numeric_names]
        self.types = {f.name: f.dataType for f in df.schema}

    def noised(self, epsilon: float | None) -> "Profiler":
        """A profiler of the same table with other noise. Noise comes after all counting, so both share every count and rank
        that either asks for."""
        other = Profiler(self.df, self.by, epsilon, self.cap, self.semantic, self.seed)
        other.source = self.source or self
        return other

    # --- counts ---------------------------------------------------------------

    @_before_noise
    def moments(self) -> DataFrame:
        """Rows, present values, range and central moments of every column, from one pass; cached, a row per (group, column)."""
        return keep(columns.moments(self.df, self.by))

    @cached_property
    def sizes(self) -> DataFrame:
        """(grp, num_rows): one row per group and one for the table."""
        return self.moments.where(F.col("cid") == columns.ROWS).select("grp", F.col("n").alias("num_rows"))

    @cached_property
    def groups(self) -> int:
        return self.sizes.count()

    @_before_noise
    def numbers(self) -> DataFrame:
        """The numeric columns, staged with a number per row; whatever ranks or sorts reads these."""
        return correlation.staged_numbers(self.df, self.numeric_names, self.by)

    @_before_noise
    def values(self) -> Ordered:
        """Ordered value counts of the numeric columns."""
        return correlation.rankable_values(self.numbers, len(self.numeric_names), self.by is not None, self.gaps)

    @_before_noise
    def gaps(self) -> correlation.Gaps:
        return correlation.gap_patterns(self.numbers, len(self.numeric_names))

    @_before_noise
    def labels(self) -> DataFrame:
        """Staged value counts of all other columns."""
        return stage(columns.tally(columns.text_cells(self.df, self.label_names, self.by)), "labels")

    @_before_noise
    def label_totals(self) -> DataFrame:
        return keep(categories.label_totals(self.labels))

    # --- statistics -----------------------------------------------------------

    def _table(self, names: list[str], fields: dict[str, list]) -> DataFrame:
        """Attach per-column constants by ``cid``."""
        struct = [F.struct(*[F.lit(v[i]).alias(k) for k, v in fields.items()]) for i in range(len(names))]
        return F.element_at(F.array(*struct), F.col("cid") + 1)

    @cached_property
    def averages(self) -> DataFrame:
        """Mean, spread, skewness and range per (grp, cid) of the numeric columns; no value is sorted or sent for them."""
        found = numeric.moment_statistics(self.moments, [self.names.index(c) for c in self.numeric_names])
        return found.withColumn("column_name", columns.name_of(F.col("cid"), self.numeric_names))

    @cached_property
    def stats(self) -> DataFrame:
        """Numeric statistics per (grp, cid); cached."""
        averages = broadcast_if_small(self.averages.drop("column_name"), self.groups * len(self.numeric_names))
        raw = numeric.order_statistics(self.values).join(averages, KEYS)
        raw = numeric.with_capped_range(raw, self.cap).join(broadcast_if_small(self.sizes, self.groups), "grp")
        # Integer columns with gaps count as floating: their bins may be narrower than 1.
        facts = numeric.column_facts(self.values)
        total = self.sizes.where(F.col("grp") == ROOT).first()["num_rows"]
        whole = [columns.is_integral(self.types[c]) and facts.get(i, numeric.NO_FACTS)["n_root"] == total for i, c in enumerate(self.numeric_names)]
        fixed = self._table(self.numeric_names, {"name": self.numeric_names, "integral": whole})
        stats = raw.withColumns({"column_name": fixed["name"], "integral": fixed["integral"]})
        stats = stats.withColumns({
            "is_primary_key": categories.is_key(F.col("column_name"), F.col("distinct_cnt"), F.col("n_cnt")),
            "is_discrete": numeric.is_discrete(),
        })
        stats = numeric.with_bins(stats)
        if self.epsilon is not None:
            stats = numeric.with_moment_noise(stats, self.epsilon, self.seed)
        return keep(stats)

    @cached_property
    def histogram(self) -> DataFrame:
        bins = numeric.histogram(self.values, self.stats, self.groups * len(self.numeric_names))
        if self.epsilon is not None:
            bins = numeric.with_count_noise(bins, self.epsilon, self.seed)
        return bins

    @cached_property
    def sample(self) -> DataFrame:
        """Values kept for density estimates; none under ``epsilon``, for keys and for discrete columns."""
        chosen = self.stats.where(~F.col("is_primary_key") & ~F.col("is_discrete"))
        if self.epsilon is not None:
            chosen = chosen.where(F.lit(False))
        return numeric.value_sample(self.values, chosen, self.groups * len(self.numeric_names), self.seed)

    @cached_property
    def frequencies(self) -> DataFrame:
        """Frequencies of categorical and boolean columns."""
        kept = [i for i, c in enumerate(self.label_names)
                if columns.column_class(self.types[c]) in ("categorical", "boolean")]
        labels = self.labels.where(F.col("cid").isin(kept))
        return categories.frequencies(
            labels, self.label_totals, self.groups * len(self.label_names), self.epsilon, self.seed)

    @_before_noise
    def correlations(self) -> DataFrame | None:
        if len(self.numeric_names) < 2:
            return None
        return correlation.spearman(self.df, self.numeric_names, self.by, self.numbers, self.values, self.gaps, self.sizes)

    # --- assembly -------------------------------------------------------------

    @cached_property
    def facts(self) -> DataFrame:
        """One row per (group, column): class and gaps, from the one pass of ``moments``."""
        listing = self.sizes.select(
            "grp", "num_rows", F.posexplode(F.array(*[F.lit(c) for c in self.names])).alias("position", "column_name"))
        kinds = F.element_at(F.array(*[F.lit(columns.column_class(self.types[c])) for c in self.names]), F.col("position") + 1)
        found = self.moments.select("grp", F.col("cid").alias("position"), "n")
        n = F.coalesce("n", F.lit(0).cast("bigint"))
        missing = F.col("num_rows") - n
        return listing.join(found, ["grp", "position"], "left").select(
            "grp", "position", "column_name", F.when(n > 0, kinds).otherwise("unsupported").alias("inferred_type"),
            (missing > 0).alias("nullable"), missing.alias("missing_count"),
            F.coalesce(F.try_divide(missing * 100.0, F.col("num_rows").cast("double")), F.lit(0.0)).alias("missing_percentage"),
            n.alias("n"))

    @cached_property
    def basics(self) -> DataFrame:
        """One row per (group, column): class, gaps, distinct values, key, semantic type; cached."""
        parts = []
        if self.numeric_names:
            # every slice of a key repeats the key's totals
            totals = self.values.parts.groupBy(*KEYS).agg(F.first("distinct_cnt").alias("d"))
            parts.append(totals.withColumn("column_name", columns.name_of(F.col("cid"), self.numeric_names)))
        if self.label_names:
            totals = self.label_totals.select(*KEYS, F.col("distinct_cnt").alias("d"))
            parts.append(totals.withColumn("column_name", columns.name_of(F.col("cid"), self.label_names)))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        d = F.coalesce("d", F.lit(0).cast("bigint"))
        semantic = F.when(F.col("inferred_type") == "categorical", categories.semantic_type(F.col("column_name")))
        return keep(self.facts.join(found.drop("cid"), ["grp", "column_name"], "left").select(
            "grp", "position", "column_name", "inferred_type", "nullable", d.alias("num_unique"), "missing_count",
            "missing_percentage", categories.is_key(F.col("column_name"), d, F.col("n")).alias("is_primary_key"),
            (semantic if self.semantic else F.lit(None).cast("string")).alias("semantic_type"),
        ))

    @cached_property
    def columns(self) -> DataFrame:
        """One row per (group, column) with all scalar statistics; cached."""
        figures = {
            "min_value": "min_value", "max_value": "max_value", "mean": "mean_cnt", "std_dev": "std_cnt",
            "median": "median_cnt", "q1": "q1_cnt", "q3": "q3_cnt", "iqr": "iqr_cnt", "skewness": "skewness_cnt",
        }
        if self.numeric_names:
            stats = self.stats.select(
                "grp", "column_name", *[F.col(v).alias(k) for k, v in figures.items()],
                F.col("is_discrete").alias("discrete"), F.col("decimals").alias("places"))
            table = self.basics.join(stats, ["grp", "column_name"], "left")
        else:
            table = self.basics.withColumns({
                **{k: F.lit(None).cast("double") for k in figures},
                "discrete": F.lit(None).cast("boolean"), "places": F.lit(None).cast("int")})
        return keep(table.select(
            *[c for c in self.basics.columns if c not in ("is_primary_key", "semantic_type")], *figures,
            F.coalesce("discrete", F.lit(False)).alias("is_discrete"), "is_primary_key", "semantic_type",
            F.coalesce("places", F.lit(4)).alias("decimals"),
        ))

    @cached_property
    def warnings(self) -> DataFrame:
        """Privacy verdicts from the distinct counts at hand."""
        total = self.sizes.where(F.col("grp") == ROOT).first()["num_rows"]
        root = self.basics.where((F.col("grp") == ROOT) & F.lit(total > 0))
        ratio = F.col("num_unique") / F.lit(max(total, 1))
        return scan_privacy(self.df, root.select("position", "column_name", "num_unique", ratio.alias("uniqueness_ratio")))

    def run(self) -> "Profile":
        """Compute and stage every part of the profile, independent ones side by side."""
        spark = self.df.sparkSession
        empty = lambda ddl: spark.createDataFrame([], ddl)
        name = lambda frame, names: frame.withColumn("column_name", columns.name_of(F.col("cid"), names)).drop("cid")
        has_numbers, has_labels = bool(self.numeric_names), bool(self.label_names)
        together(
            spark,
            sizes=lambda: self.groups,
            values=lambda: self.values if has_numbers else None,
            labels=lambda: self.label_totals.count() if has_labels else None,
        )

        def described() -> dict:
            if has_numbers:
                self.stats.count()
            self.columns.count()
            meta = self.sizes.select(
                "grp", "num_rows", F.lit(len(self.names)).alias("num_columns"),
                F.lit(self.by).cast("string").alias("conditional_by_column"),
                F.lit(self.epsilon).cast("double").alias("dp_epsilon"),
            )
            return together(
                spark,
                meta=lambda: stage(meta, "meta"),
                columns=lambda: stage(self.columns, "columns"),
                warnings=lambda: stage(self.warnings, "warnings"),
                histogram=lambda: stage(name(self.histogram, self.numeric_names), "histogram") if has_numbers else empty(
                    "grp string, bin bigint, left_edge double, right_edge double, count bigint, column_name string"),
                sample=lambda: stage(name(self.sample, self.numeric_names), "sample") if has_numbers else empty(
                    "grp string, idx bigint, value double, column_name string"),
            )

        def related() -> DataFrame:
            if self.correlations is None:
                return empty("grp string, col_a string, col_b string, rho double")
            # what shares this step reads the staged table
            self.correlations = stage(self.correlations, "correlations")
            if self.source:
                self.source.correlations = self.correlations
            return self.correlations

        def counted() -> DataFrame:
            if not has_labels:
                return empty("grp string, value string, weight bigint, frequency double, column_name string")
            return stage(name(self.frequencies, self.label_names), "frequencies")

        parts = together(spark, described=described, correlations=related, frequencies=counted)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema)
        return Profile(**parts.pop("described"), **parts, table_schema=schema)


PARTS = ["meta", "columns", "histogram", "sample", "frequencies", "correlations", "warnings"]


@dataclass
class Profile:
    """A profile as tables keyed by group and column; ``grp`` is empty for the whole table."""

    meta: DataFrame
    columns: DataFrame
    histogram: DataFrame
    sample: DataFrame
    frequencies: DataFrame
    correlations: DataFrame
    warnings: DataFrame
    table_schema: str

    @property
    def spark(self):
        return self.meta.sparkSession

    def replaced(self, **parts: DataFrame) -> "Profile":
        """A copy with some of its tables exchanged, e.g. after editing a statistic."""
        return replace(self, **parts)

    def assembled(self) -> DataFrame:
        """One wide row per (group, column), with bins, quantiles and sample as arrays.

        Bins number at most about 2 sqrt(n), sample values at most 1000.
        Category frequencies stay in their own table, which has no such bound.
        """
        keys = ["grp", "column_name"]
        bins = self.histogram.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("bin", "left_edge", "right_edge", "count"))).alias("b"))
        bins = bins.select(
            *keys, F.col("b.count").alias("histogram_counts"),
            F.concat(F.col("b.left_edge"), F.array(F.element_at("b", -1)["right_edge"])).alias("histogram_bins"))
        sample = self.sample.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
        sample = sample.select(*keys, F.col("s.value").alias("kde_samples"))
        wide = self.columns.join(bins, keys, "left").join(sample, keys, "left")
        quantiles = F.when(F.col("q1").isNotNull(), F.create_map(
            F.lit("25%"), F.col("q1"), F.lit("50%"), F.col("median"), F.lit("75%"), F.col("q3")))
        return wide.withColumn("quantiles", quantiles)

    def view(self) -> DataFrame:
        """The profile as shown to a user, whole table only."""
        return self.columns.where(F.col("grp") == ROOT).select(
            "position", F.col("column_name").alias("column"), F.col("inferred_type").alias("type"),
            F.col("missing_percentage").alias("missing_pct"), F.col("num_unique").alias("unique"),
            F.col("min_value").alias("min"), F.col("max_value").alias("max"), "mean",
            "is_primary_key", "semantic_type")


def profile_table(df: DataFrame, conditional_by: str | None = None, epsilon: float | None = None,
                  auto_clean_outliers: bool = False, smart_pii: bool = False, seed: int = 0) -> Profile:
    """Profile a table, optionally per group, with Laplace noise, capped range or semantic types."""
    return Profiler(df, conditional_by, epsilon, auto_clean_outliers, smart_pii, seed).run()
