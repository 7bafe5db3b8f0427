"""Marginal distributions, computed from a profile alone.

Columns with a closed form (normal, cut to a range or not) are drawn from it.
A density estimate is an array of quantiles at fixed knots; arithmetic on a
uniform u says between which two it falls, and a monotone cubic joins them, so
it needs no lookup. Bins and constants are segments: u picks the one with
lo <= u < hi, and the value lies between x0 and x1 in proportion. Steps have
x0 = x1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions.hashed import _ERFC, normal_cdf, normal_quantile, normal_tail
from facsimile.operators.sizing import exclusive_total

KEYS = ["grp", "column_name"]
#: Knots of a density: even steps of 1/EVEN, and HALVES half octaves down to 2^-DEEPEST beyond the outermost on either side.
EVEN = 256
DEEPEST = 50
HALVES = 2 * (DEEPEST - 8)
KNOTS = 2 * HALVES + EVEN - 1


def strategies(columns: DataFrame, histogram: DataFrame, sample: DataFrame) -> DataFrame:
    """How each column is drawn: (grp, column_name, strategy) plus its parameters.

    In order: key, constant, density estimate (over 10 sample values), bin edges
    of a discrete column, bins of a skewed one (|skewness| > 1), normal within
    the range (|skewness| < 0.5), else uniform.
    """
    binned = histogram.groupBy(*KEYS).agg(F.sum("count").alias("binned"))
    sampled = sample.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("sampled"))
    table = columns.join(binned, KEYS, "left").join(sampled, KEYS, "left")
    has_bins = F.coalesce(F.col("binned"), F.lit(0)) > 0
    bounded = F.col("min_value").isNotNull() & F.col("max_value").isNotNull()
    bell = F.when(bounded, "truncated_normal").otherwise("normal")
    skew = F.abs("skewness")
    numeric = (
        F.when(F.col("mean").isNull() | F.col("std_dev").isNull(), "empty")
        .when(F.col("std_dev") == 0, "constant")
        .when(F.col("sampled") > 10, "density")
        .when(F.col("is_discrete") & has_bins, "discrete")
        .when((skew > 1.0) & has_bins, "histogram")
        .when(skew < 0.5, bell)
        .otherwise(F.when(bounded, "uniform").otherwise("normal"))
    )
    kind = F.col("inferred_type")
    strategy = (
        F.when(F.col("is_primary_key"), "key")
        .when(kind == "numeric", numeric)
        .when((kind == "categorical") & F.col("semantic_type").isNotNull(), "semantic")
        .when(kind.isin("categorical", "boolean"), "categories")
        .otherwise("empty")
    )
    return table.withColumn("strategy", strategy)


def _bin_segments(chosen: DataFrame, histogram: DataFrame) -> DataFrame:
    """Segments of columns drawn from their bins; a column has at most about 2 sqrt(n) of them."""
    order = [F.col("bin")]
    bins = histogram.join(chosen.select(*KEYS, "strategy"), KEYS).withColumns({
        "before": exclusive_total("count", KEYS, order),
        "total": F.sum("count").over(Window.partitionBy(*KEYS)),
    })
    right = F.when(F.col("strategy") == "discrete", F.col("left_edge")).otherwise(F.col("right_edge"))
    return bins.where("count > 0").select(
        *KEYS, (F.col("before") / F.col("total")).alias("lo"),
        ((F.col("before") + F.col("count")) / F.col("total")).alias("hi"),
        F.col("left_edge").alias("x0"), right.alias("x1"),
    )


def knot_places() -> list[float]:
    """The probabilities of the knots: even steps, and ever finer ones towards both ends."""
    low = [2.0 ** (i / 2 - DEEPEST) for i in range(HALVES)]
    return [*low, *[k / EVEN for k in range(1, EVEN)], *[1.0 - p for p in reversed(low)]]


def _erfc(x):
    """Complementary error function of an array of x >= 0, relatively exact to 1.2e-7."""
    import numpy as np

    t = 1.0 / (1.0 + 0.5 * x)
    poly = np.zeros_like(t)
    for c in _ERFC:
        poly = poly * t + c
    return t * np.exp(poly - x * x)


def density_curve(points, steps):
    """Quantiles at ``steps`` of a Gaussian kernel estimate with Scott's bandwidth.

    Each half of the distribution is inverted from its own tail, in logarithms,
    so the far ends are as exact as the middle.
    """
    import numpy as np

    points = np.sort(np.asarray(points, dtype=float))
    width = points.std(ddof=1) * len(points) ** -0.2
    if width == 0:
        return np.full(len(steps), points[0])
    xs = np.linspace(points[0] - 8.5 * width, points[-1] + 8.5 * width, 6144)

    def tail(side):
        """Log chance to lie beyond xs on one side."""
        out = []
        for part in np.array_split(xs, 24):
            z = side * (part[:, None] - points[None, :]) / width
            half = 0.5 * _erfc(np.abs(z) * np.sqrt(0.5))
            out.append(np.where(z >= 0, half, 1.0 - half).mean(axis=1))
        return np.log(np.maximum(np.concatenate(out), 1e-300))

    steps = np.asarray(steps)
    below, above = tail(-1.0), tail(1.0)
    low = np.interp(np.log(np.maximum(steps, 2.0**-53)), np.maximum.accumulate(below), xs)
    rest = np.log(np.maximum(1.0 - steps, 2.0**-53))
    high = np.interp(-rest, np.maximum.accumulate(-above), xs)
    return np.maximum.accumulate(np.where(steps < 0.5, low, high))


def monotone_slopes(steps, values):
    """Slopes at the knots of a cubic that rises wherever the values do: weighted harmonic means of the secants."""
    import numpy as np

    width = np.diff(steps)
    secant = np.diff(values) / width
    before, after = width[:-1], width[1:]
    left, right = secant[:-1], secant[1:]
    flat = (left <= 0) | (right <= 0)
    left, right = np.where(flat, 1.0, left), np.where(flat, 1.0, right)
    inner = 3.0 * (before + after) / ((2.0 * after + before) / left + (after + 2.0 * before) / right)
    return np.concatenate([[secant[0]], np.where(flat, 0.0, inner), [secant[-1]]])


def density_knots(chosen: DataFrame, sample: DataFrame) -> DataFrame:
    """(grp, column_name, knots, slopes) of density estimates on at most 1000 sample values each, held to the column's range."""
    values = sample.groupBy(*KEYS).agg(F.collect_list("value").alias("values"))
    chosen = chosen.where(F.col("strategy") == "density")
    rows = chosen.join(values, KEYS, "left").select(*KEYS, "min_value", "max_value", "values")

    def curves(batches):
        from math import inf

        import numpy as np
        import pandas as pd

        steps = np.array(knot_places())
        for frame in batches:
            found = []
            for row in frame.itertuples(index=False):
                low = -inf if pd.isna(row.min_value) else row.min_value
                high = inf if pd.isna(row.max_value) else row.max_value
                x = np.clip(density_curve(row.values, steps), low, high)
                found.append((row.grp, row.column_name, x, monotone_slopes(steps, x)))
            yield pd.DataFrame(found, columns=["grp", "column_name", "knots", "slopes"])

    return rows.mapInPandas(curves, "grp string, column_name string, knots array<double>, slopes array<double>")


def with_knot_place(rows: DataFrame, u: str, alias: str) -> DataFrame:
    """Adds between which knots the uniform ``u`` (a column's name) lies, and how far: arithmetic, without the knots.

    Each step is a column of its own, so nothing is computed twice.
    """
    col = lambda name: F.col(f"_{name}_{alias}")
    step = lambda frame, **columns: frame.withColumns({f"_{k}_{alias}": v for k, v in columns.items()})
    # both ends alike, by the distance from the nearer one
    rows = step(rows, end=F.least(F.col(u), 1.0 - F.col(u)), upper=F.col(u) >= 0.5)
    rows = step(rows, half=F.least(F.greatest(
        F.floor(2.0 * (F.log2(F.greatest(col("end"), F.lit(1e-300))) + DEEPEST)), F.lit(0)), F.lit(HALVES)).cast("int"))
    tail = col("half") < HALVES
    rows = step(rows, first=F.when(tail, F.pow(F.lit(2.0), col("half") / 2.0 - DEEPEST)),
                even=F.floor(F.col(u) * EVEN).cast("int"))
    rows = step(
        rows,
        width=F.when(tail, col("first") * (2.0**0.5 - 1.0)).otherwise(F.lit(1.0 / EVEN)),
        place=F.when(tail & col("upper"), KNOTS - 2 - col("half")).when(tail, col("half")).otherwise(HALVES - 1 + col("even")))
    gone = F.when(tail, (col("end") - col("first")) / col("width")).otherwise(F.col(u) * EVEN - col("even"))
    gone = F.least(F.greatest(gone, F.lit(0.0)), F.lit(1.0))
    rows = step(rows, s=F.when(tail & col("upper"), 1.0 - gone).otherwise(gone))
    return rows.drop(*[f"_{c}_{alias}" for c in ("end", "upper", "half", "first", "even")])


def knot_ends(alias: str, knots: Column, slopes: Column) -> dict[str, Column]:
    """The two knots and slopes at the place; taken for all columns in one step, so no row carries arrays further."""
    place = F.col(f"_place_{alias}")
    return {f"_{c}{k}_{alias}": F.element_at(array, place + 1 + k) for c, array in (("y", knots), ("m", slopes)) for k in (0, 1)}


def with_knot_value(rows: DataFrame, alias: str) -> DataFrame:
    """Adds the quantile at the uniform: a cubic between the two knots."""
    col = lambda name: F.col(f"_{name}_{alias}")
    s = col("s")
    value = col("y0") + s * s * (3.0 - 2.0 * s) * (col("y1") - col("y0")) + col("width") * s * (1.0 - s) * (
        (1.0 - s) * col("m0") - s * col("m1"))
    rows = rows.withColumn(alias, F.least(F.greatest(value, col("y0")), col("y1")))
    return rows.drop(*[f"_{c}_{alias}" for c in ("width", "place", "s", "y0", "y1", "m0", "m1")])


def with_knot_draw(rows: DataFrame, u: str, knots: Column, slopes: Column, alias: str) -> DataFrame:
    """All three steps for one column: adds the quantile at the uniform ``u`` (a column's name) of an array of knots."""
    rows = with_knot_place(rows, u, alias)
    return with_knot_value(rows.withColumns(knot_ends(alias, knots, slopes)), alias)


#: Strategies with a closed form, which need no segments.
BELLS = ("normal", "truncated_normal")


def with_bell_draw(rows: DataFrame, alias: str, u: Column, z: Column | None, mean: Column, std: Column,
                   low: Column, high: Column) -> DataFrame:
    """Adds a normal cut to [low, high] (null: open) at the uniform ``u``, or at the normal score ``z`` if there is one.

    Draws above the median count their chance from the upper end, so both tails
    keep their digits. Each step is a column of its own: polynomials within
    polynomials would be computed thousands of times.
    """
    col = lambda name: F.col(f"_{name}_{alias}")
    step = lambda frame, **columns: frame.withColumns({f"_{k}_{alias}": v for k, v in columns.items()})
    none = F.lit(0.0)
    rows = step(rows, a=(low - mean) / std, b=(high - mean) / std, lower=u if z is None else normal_cdf(z),
                upper=F.lit(1.0) - u if z is None else normal_tail(z), first=u < 0.5 if z is None else z < 0)
    rows = step(rows, below=F.coalesce(normal_cdf(col("a")), none), beyond=F.coalesce(normal_tail(col("b")), none))
    rows = step(rows, inside=F.lit(1.0) - (col("below") + col("beyond")))
    rows = step(rows, p=F.when(col("first"), col("below") + col("lower") * col("inside")).otherwise(
        col("beyond") + col("upper") * col("inside")))
    rows = step(rows, q=normal_quantile(col("p")))
    score = F.when(col("first"), col("q")).otherwise(-col("q"))
    if z is not None:
        score = F.when(low.isNotNull() | high.isNotNull(), score).otherwise(z)
    rows = rows.withColumn(alias, F.least(F.greatest(mean + std * score, low), high))
    return rows.drop(*[f"_{c}_{alias}" for c in ("a", "b", "lower", "upper", "first", "below", "beyond", "inside", "p", "q")])


def numeric_segments(chosen: DataFrame, histogram: DataFrame) -> DataFrame:
    """Segments of all numeric columns but keys, bells and densities: (grp, column_name, lo, hi, x0, x1).

    ``chosen`` comes from :func:`strategies`.
    """
    of = lambda *names: chosen.where(F.col("strategy").isin(*names))
    low = F.when(F.col("strategy") == "constant", F.col("mean")).otherwise(F.col("min_value"))
    high = F.when(F.col("strategy") == "constant", F.col("mean")).otherwise(F.col("max_value"))
    flat = of("constant", "uniform").select(
        *KEYS, F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), low.alias("x0"), high.alias("x1"))
    bins = _bin_segments(of("discrete", "histogram"), histogram)
    return flat.unionByName(bins)
