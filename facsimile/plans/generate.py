"""Generation of a synthetic table from a profile alone.

The plan is one pass over ``spark.range``: each row's group, scores, values
and gaps are functions of its id, the seed and small lookup tables. Nothing is
sorted or shuffled unless a lookup table is too large to broadcast.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.hashed import angle, normal_cdf, normal_quantile, radius, uniform, with_permuted
from facsimile.operators.columns import ROOT
from facsimile.operators.copula import mixing_rows
from facsimile.operators.draws import Size, by_segment, draw_category, draw_numeric
from facsimile.operators.fakes import fake
from facsimile.operators.marginals import (
    BELLS, KNOTS, density_knots, knot_ends, numeric_segments, strategies, with_bell_draw, with_knot_place, with_knot_value)
from facsimile.operators.ordered import ordered
from facsimile.operators.sizing import SMALL_BYTES, SMALL_ROWS, exclusive_total, salted_join
from facsimile.plans.profile import Profile
from facsimile.sources.session import prefer_compiled_methods
from facsimile.sources.staging import keep, stage

_BELOW_ONE = 1.0 - 2.0**-52


class Generator:
    """Draws ``num_rows`` rows from a profile; the same seed and profile give the same rows."""

    def __init__(self, profile: Profile, num_rows: int, seed: int = 42, rank_exact: bool = False,
                 partitions: int | None = None):
        self.profile, self.n, self.seed, self.rank_exact = profile, num_rows, seed, rank_exact
        self.partitions = partitions
        self.spark = profile.spark
        prefer_compiled_methods(self.spark)
        self.source = T.StructType.fromDDL(profile.table_schema)
        meta = profile.meta.where(F.col("grp") == ROOT).first()
        self.by = meta["conditional_by_column"]
        columns = profile.columns if self.by else profile.columns.where(F.col("grp") == ROOT)
        self.plan = keep(strategies(columns, profile.histogram, profile.sample))
        self.facts = self._column_facts()
        self.names = [f["column_name"] for f in self.facts]
        self.numeric = [f["column_name"] for f in self.facts if f["kind"] == "numeric"]
        self.groups = profile.meta.count() if self.by else 1

    def _column_facts(self) -> list:
        """One row per column: what the shape of the plan depends on."""
        root = F.col("grp") == ROOT
        rows = self.plan.groupBy("column_name").agg(
            F.max(F.when(root, F.col("position"))).alias("position"),
            F.max(F.when(root, F.col("inferred_type"))).alias("kind"),
            F.max(F.when(root, F.col("strategy"))).alias("strategy"),
            F.collect_set("strategy").alias("strategies"),
            F.collect_set(F.when(F.col("inferred_type") == "numeric", F.col("decimals"))).alias("decimals"),
            F.max(F.when(root, F.col("missing_percentage"))).alias("missing"),
            F.max("missing_percentage").alias("most_missing"),
            F.max("semantic_type").alias("semantic"),
            F.max("num_unique").alias("most_unique"), F.sum("num_unique").alias("all_unique"),
        )
        return rows.orderBy("position").collect()

    def _fact(self, name: str):
        return self.facts[self.names.index(name)]

    @cached_property
    def widest(self) -> dict[str, int]:
        """Bytes of the longest category of each column, with what stands beside it in a table of segments."""
        longest = self.profile.frequencies.groupBy("column_name").agg(F.max(F.octet_length("value")).alias("bytes"))
        return {r.column_name: (r.bytes or 0) + 64 for r in longest.collect()}

    # --- rows and groups --------------------------------------------------------

    def rows(self) -> DataFrame:
        """(pos, grp, idx, size): every row's place in the table and in its group.

        Two permutations of the row number: ``pos`` orders the table's key, the
        other deals rows to groups, so a group's keys lie all over the table.
        """
        ids = self.spark.range(0, self.n, 1, self.partitions)
        size = F.lit(self.n).cast("bigint")
        ids = with_permuted(ids, "pos", F.col("id"), size, "row", self.seed)
        if not self.by:
            return ids.select("pos", F.lit(ROOT).alias("grp"), F.col("pos").alias("idx"), size.alias("size"))
        bounds = self.bounds
        groups = bounds.count()
        ids = with_permuted(ids, "deal", F.col("id"), size, "group", self.seed)
        placed = ids.select("pos", "deal", F.lit("all").alias("grp"))
        placed = placed.withColumn("_u", (F.col("deal") + 0.5) / self.n)
        segments = bounds.select(
            F.lit("all").alias("grp"), "group", "size", "start",
            (F.col("start") / self.n).alias("lo"), ((F.col("start") + F.col("size")) / self.n).alias("hi"))
        joined = by_segment(placed, "_u", segments, ["group", "size", "start"], Size(groups, groups, 1))
        return joined.select(
            "pos", F.coalesce("group", F.lit(ROOT)).alias("grp"),
            (F.col("deal") - F.col("start")).alias("idx"), "size", F.col("group").isNull().alias("ungrouped"))

    def group_draws(self) -> DataFrame:
        """How many rows each group gets: (group, size); null for rows without a group."""
        fact = self._fact(self.by)
        weights = self.profile.frequencies.where((F.col("grp") == ROOT) & (F.col("column_name") == self.by))
        drawable = fact["kind"] in ("categorical", "boolean")
        missing = int(fact["missing"] / 100 * self.n) if drawable else self.n
        empty = self.spark.range(1).select(
            F.lit(None).cast("string").alias("group"), F.lit(missing).cast("bigint").alias("size"))
        if not drawable:
            return empty
        rows = self.spark.range(self.n - missing).select(
            F.lit(ROOT).alias("grp"), uniform("group", self.seed, F.col("id")).alias("_u"))
        size = Size(fact["most_unique"], fact["most_unique"], 1, self.widest.get(self.by, 0))
        drawn = draw_category(rows, "_u", weights.select("grp", "value", "weight"), size, "value")
        counted = drawn.groupBy(F.concat(F.lit("="), F.col("value")).alias("group")).agg(F.count(F.lit(1)).alias("size"))
        return counted.unionByName(empty).where("size > 0")

    @cached_property
    def bounds(self) -> DataFrame:
        """(group, size, start): groups end to end on 0..n-1."""
        draws = stage(self.group_draws().withColumn("everything", F.lit(0)), "groups")
        if draws.count() <= SMALL_ROWS:
            start = exclusive_total("size", ["everything"], [F.col("group")])
            return keep(draws.withColumn("start", start).drop("everything"))
        laid = ordered(draws, ["everything"], ["group"], ["size"], "group-bounds").positioned()
        return keep(laid.withColumn("start", F.col("cum_size") - F.col("size")).drop("everything", "cum_size"))

    # --- parameters ---------------------------------------------------------------

    def _parameters(self) -> tuple[DataFrame | None, dict]:
        """Per-group constants of every column but curves: literals for one group, else a table by group."""
        wanted = {}
        for i, name in enumerate(self.names):
            at = F.col("column_name") == name
            gaps = F.when(F.col("strategy").isin("key", "constant"), F.lit(0.0)).otherwise(F.col("missing_percentage"))
            wanted[f"missing_{i}"] = F.max(F.when(at, gaps))
            wanted[f"decimals_{i}"] = F.max(F.when(at, F.col("decimals")))
            wanted[f"strategy_{i}"] = F.max(F.when(at, F.col("strategy")))
            if not set(BELLS).isdisjoint(self.facts[i]["strategies"]):
                for figure in ("mean", "std_dev", "min_value", "max_value"):
                    wanted[f"{figure}_{i}"] = F.max(F.when(at, F.col(figure)))
        table = self.plan.groupBy("grp").agg(*[c.alias(a) for a, c in wanted.items()])
        factors = None
        if len(self.numeric) > 1:
            correlations = self.profile.correlations
            if not self.by:
                correlations = correlations.where(F.col("grp") == ROOT)
            factors = mixing_rows(correlations, self._copula_order(), self.rank_exact)
        if not self.by:
            row = table.first().asDict()
            constants = {a: F.lit(v).cast(table.schema[a].dataType) for a, v in row.items() if a != "grp"}
            if factors is not None:
                found = factors.first()
                constants["factor"] = list(found["factor"]) if found else None
            return None, constants
        if factors is not None:
            table = table.join(factors, "grp", "left")
        table = stage(table, "parameters")
        return table, {a: F.col(a) for a in table.columns if a != "grp"}

    def _curves(self, at: list[int]) -> DataFrame:
        """(grp, knots_<i>, slopes_<i>, ...): the density estimates of the columns ``at``, a row per group."""
        knots = density_knots(self.plan, self.profile.sample)
        own = lambda i, c: F.first(F.when(F.col("column_name") == self.names[i], F.col(c)), ignorenulls=True).alias(f"{c}_{i}")
        return knots.groupBy("grp").agg(*[own(i, c) for i in at for c in ("knots", "slopes")])

    def _with_parameters(self, rows: DataFrame, side: DataFrame) -> DataFrame:
        """Every row with its group's parameters: broadcast up to a size in bytes, else a join that splits large groups."""
        fields = [f for f in side.schema if f.name != "grp"]
        curves = sum(f.name.startswith(("knots_", "slopes_")) for f in fields)
        width = 8 * (curves * KNOTS + len(fields) - curves + ("factor" in side.columns) * len(self.numeric) ** 2 + 8)
        if not self.by or self.groups * width <= SMALL_BYTES:
            return rows.join(F.broadcast(side), "grp", "left")
        sizes = self.bounds.select(F.coalesce("group", F.lit(ROOT)).alias("grp"), "size")
        return salted_join(rows, "grp", "size", "idx", side, sizes, self.n)

    def _copula_order(self) -> list[str]:
        """Numeric columns, the first key ahead: its score is fixed by its value."""
        keys = [c for c in self.numeric if self._fact(c)["strategy"] == "key"]
        return keys[:1] + [c for c in self.numeric if c not in keys[:1]]

    # --- values ---------------------------------------------------------------------

    def table(self) -> DataFrame:
        side, constants = self._parameters()
        rows = self.rows()
        if side is not None:
            rows = self._with_parameters(rows, side)
        at = [F.col("pos"), F.col("grp")]
        rows = self._with_uniforms(rows, constants, at)
        rows = self._with_curves(rows)
        numeric_drawn = self.plan.where(~F.col("strategy").isin("key", "empty", "categories", "semantic", "density", *BELLS))
        segments, sizes = None, {}
        if self.numeric:
            segments = stage(numeric_segments(numeric_drawn, self.profile.histogram), "segments")
            per_group = segments.groupBy("column_name", "grp").count()
            for r in per_group.groupBy("column_name").agg(F.max("count"), F.sum("count")).collect():
                sizes[r[0]] = Size(r[1], r[2], self.groups)
        for i, fact in enumerate(self.facts):
            name, kinds = fact["column_name"], set(fact["strategies"])
            if name in sizes:
                own = segments.where(F.col("column_name") == name).drop("column_name")
                rows = draw_numeric(rows, f"u_{i}", own, sizes[name], f"v_{i}")
            if "density" in kinds:
                other = F.col(f"v_{i}") if name in sizes else F.lit(None).cast("double")
                drawn = F.when(constants[f"strategy_{i}"] == "density", F.col(f"_curve_{i}")).otherwise(other)
                rows = rows.withColumn(f"v_{i}", drawn).drop(f"_curve_{i}")
            if not kinds.isdisjoint(BELLS):
                rows = self._with_bell(rows, i, constants, name in sizes or "density" in kinds)
            # a row's group is known before its values
            if name != self.by and name not in sizes and "categories" in kinds:
                own = self.profile.frequencies.where(F.col("column_name") == name).select("grp", "value", "weight")
                size = Size(fact["most_unique"], fact["all_unique"], self.groups, self.widest.get(name, 0))
                rows = draw_category(rows, f"u_{i}", own, size, f"v_{i}")
        for i in self.ranked:
            rows = self._ranked_key(rows, f"z_{i}", f"rank_{i}")
        for i, fact in enumerate(self.facts):
            if self._has_gaps(fact):
                rows = with_permuted(rows, f"place_{i}", F.col("idx"), F.col("size"), f"gap/{fact['column_name']}", self.seed, F.col("grp"))
        output = [self._finished(i, fact, constants, at) for i, fact in enumerate(self.facts)]
        return rows.select(output)

    def _with_curves(self, rows: DataFrame) -> DataFrame:
        """``_curve_<i>``: the density estimate's quantile, of every column that has one in some group.

        Their arrays are literals for one group; a table of groups meets the rows in one join and
        its arrays end there, as rows that carry them on would be copied, and shuffled, by the kilobyte.
        """
        at = [i for i, f in enumerate(self.facts) if "density" in f["strategies"]]
        if not at:
            return rows
        for i in at:
            rows = with_knot_place(rows, f"u_{i}", f"_curve_{i}")
        curves = self._curves(at)
        if self.by:
            side = stage(curves, "curves")
            rows = self._with_parameters(rows, side)
            array = {c: F.col(c) for c in side.columns if c != "grp"}
        else:
            # one row of some numbers per column; a text is one literal, folded into an array once
            array = {c: F.split(F.lit(",".join(map(repr, v))), ",").cast("array<double>")
                     for c, v in curves.drop("grp").first().asDict().items()}
        ends = {}
        for i in at:
            ends |= knot_ends(f"_curve_{i}", array[f"knots_{i}"], array[f"slopes_{i}"])
        rows = rows.withColumns(ends).drop(*array)
        for i in at:
            rows = with_knot_value(rows, f"_curve_{i}")
        return rows

    def _with_bell(self, rows: DataFrame, i: int, constants: dict, drawn: bool) -> DataFrame:
        """``v_<i>`` of the groups in which the column is normal, cut to its range or not."""
        z = F.col(f"z_{i}") if f"z_{i}" in rows.columns else None
        figure = lambda name: constants[f"{name}_{i}"]
        strategy = constants[f"strategy_{i}"]
        cut = lambda name: F.when(strategy == "truncated_normal", figure(name))
        rows = with_bell_draw(rows, f"_bell_{i}", F.col(f"u_{i}"), z, figure("mean"), figure("std_dev"),
                              cut("min_value"), cut("max_value"))
        other = F.col(f"v_{i}") if drawn else F.lit(None).cast("double")
        return rows.withColumn(f"v_{i}", F.when(strategy.isin(*BELLS), F.col(f"_bell_{i}")).otherwise(other)).drop(f"_bell_{i}")

    def _with_uniforms(self, rows: DataFrame, constants: dict, at: list[Column]) -> DataFrame:
        """Add ``u_<i>``: correlated through the copula for numeric columns, else independent."""
        index = {c: i for i, c in enumerate(self.names)}
        drawn = [
            c for c in self.names
            if c not in self.numeric and "categories" in self._fact(c)["strategies"]
        ]
        independent = {f"u_{index[c]}": uniform(f"u/{c}", self.seed, *at) for c in drawn}
        factor = constants.get("factor")
        self.ranked = []
        if factor is None:
            independent.update({f"u_{index[c]}": uniform(f"u/{c}", self.seed, *at) for c in self.numeric})
            return rows.withColumns(independent) if independent else rows
        order = self._copula_order()
        k = len(order)
        keys = [c for c in order if self._fact(c)["strategy"] == "key"]
        points, scores = {}, {}
        for j in range(0, k, 2):
            points[f"r_{j}"] = radius(f"z/{order[j]}", self.seed, *at)
            points[f"a_{j}"] = angle(f"z/{order[j]}", self.seed, *at)
            scores[f"g_{j}"] = F.col(f"r_{j}") * F.cos(F.col(f"a_{j}"))
            scores[f"g_{j + 1}"] = F.col(f"r_{j}") * F.sin(F.col(f"a_{j}"))
        if keys:
            scores["g_0"] = normal_quantile((F.col("pos") + 0.5) / self.n)
        rows = rows.withColumns({**independent, **points}).withColumns(scores)
        mixed = {}
        for i, c in enumerate(order):
            z = None
            for j in range(i + 1):
                if isinstance(factor, list):
                    if abs(factor[i * k + j]) < 1e-12:
                        continue
                    term = F.lit(float(factor[i * k + j])) * F.col(f"g_{j}")
                else:
                    # a group without correlations keeps its columns independent
                    own = F.lit(1.0 if i == j else 0.0)
                    term = F.coalesce(F.element_at(factor, i * k + j + 1), own) * F.col(f"g_{j}")
                z = term if z is None else z + term
            mixed[f"z_{index[c]}"] = z
        rows = rows.withColumns(mixed)
        uniforms = {
            f"u_{index[c]}": F.least(normal_cdf(F.col(f"z_{index[c]}")), F.lit(_BELOW_ONE))
            for c in order if c not in keys
        }
        if uniforms:
            rows = rows.withColumns(uniforms)
        self.ranked = [index[c] for c in keys[1:]]
        return rows

    def _ranked_key(self, rows: DataFrame, score: str, alias: str) -> DataFrame:
        """Rank of a further key's score over the whole table, which only a sort can give."""
        scored = rows.select(F.lit(0).alias("everything"), F.col("pos"), F.col(score).alias("score"), F.lit(1).cast("bigint").alias("one"))
        ranks = ordered(scored, ["everything"], ["score", "pos"], ["one"], "key-ranks").positioned()
        return rows.join(ranks.select("pos", F.col("cum_one").alias(alias)), "pos")

    def _finished(self, i: int, fact, constants: dict, at: list[Column]) -> Column:
        """Final expression of a column: key or drawn value, gaps, precision, type."""
        name, kind, kinds = fact["column_name"], fact["kind"], set(fact["strategies"])
        dtype = self.source[name].dataType
        if name == self.by:
            return F.when(~F.col("ungrouped"), F.substring("grp", 2, 1 << 30)).cast(dtype).alias(name)
        if kind == "numeric":
            value = self._finished_numeric(i, fact, constants)
        elif fact["strategy"] == "key":
            value = F.concat(F.lit("ID-"), (F.col("pos") + 1).cast("string"))
        elif kind in ("categorical", "boolean") and kinds != {"empty"}:
            value = F.lit(None).cast("string")
            if "categories" in kinds:
                value = F.col(f"v_{i}")
            strategy = constants[f"strategy_{i}"]
            if fact["semantic"]:
                value = F.when(strategy == "semantic", fake(fact["semantic"], name, self.seed, *at)).otherwise(value)
            if "key" in kinds:
                value = F.when(strategy == "key", F.concat(F.lit("ID-"), (F.col("idx") + 1).cast("string"))).otherwise(value)
            value = value.cast("boolean") if kind == "boolean" else value
        else:
            return F.lit(None).cast(dtype).alias(name)
        if self._has_gaps(fact):
            missing = F.floor(constants[f"missing_{i}"] / 100.0 * F.col("size"))
            value = F.when(F.col(f"place_{i}") >= missing, value)
        return value.alias(name)

    def _has_gaps(self, fact) -> bool:
        """Whether values of the column are left out; one without any value is null throughout."""
        drawn = fact["kind"] == "numeric" or fact["strategy"] == "key" or (
            fact["kind"] in ("categorical", "boolean") and set(fact["strategies"]) != {"empty"})
        return drawn and fact["column_name"] != self.by and fact["most_missing"] > 0 and fact["strategy"] != "key"

    def _finished_numeric(self, i: int, fact, constants: dict) -> Column:
        kinds, strategy = set(fact["strategies"]), constants[f"strategy_{i}"]
        if fact["strategy"] == "key":
            keys = [c for c in self._copula_order() if self._fact(c)["strategy"] == "key"]
            ranked = len(self.numeric) > 1 and fact["column_name"] in keys[1:] and constants.get("factor") is not None
            place = F.col(f"rank_{i}") if ranked else F.col("pos") + 1
            return place.cast("double")
        if not kinds - {"empty", "key"}:
            value = F.lit(None).cast("double")
        else:
            value = F.col(f"v_{i}")
        places = sorted(fact["decimals"])
        if len(places) == 1:
            value = F.bround(value, places[0])
        else:
            chain = None
            for d in places:
                rounded = F.bround(value, d)
                test = constants[f"decimals_{i}"] == d
                chain = F.when(test, rounded) if chain is None else chain.when(test, rounded)
            value = chain
        if "key" in kinds:
            value = F.when(strategy == "key", (F.col("idx") + 1).cast("double")).otherwise(value)
        elif places == [0]:
            value = value.cast("bigint")
        return value


def generate_table(profile: Profile, num_rows: int, seed: int = 42, shuffle: bool = False,
                   rank_exact: bool = False, partitions: int | None = None) -> DataFrame:
    """A synthetic table of ``num_rows`` rows with the columns of the profiled one.

    Rows are independent and groups come mixed, so their order carries nothing;
    ``shuffle`` sorts them by a keyed hash all the same. ``rank_exact`` corrects
    the copula so that rank correlations, not scores, meet the target. ``partitions``
    sets how many tasks draw the rows and changes nothing else.
    """
    table = Generator(profile, num_rows, seed, rank_exact, partitions).table()
    if shuffle:
        return table.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns], F.lit(seed)))
    return table
