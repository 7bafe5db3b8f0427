"""Closed-form statistics as Column expressions over small aggregate rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolated(low: Column, high: Column, n: Column, p: float) -> Column:
    """Linear interpolation between the two order statistics around (n-1)p."""
    h = (n - 1).cast("double") * p
    return low + (high - low) * (h - F.floor(h))


def adjusted_skewness(n: Column, m2: Column, skew: Column) -> Column:
    """Adjusted Fisher-Pearson skewness from the population's; 0 if n <= 2 or without spread."""
    n = n.cast("double")
    value = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * skew
    return F.when((n <= 2) | (m2 < 1e-14), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def sample_std(n: Column, m2: Column) -> Column:
    """Standard deviation with n-1; 0 for a single value."""
    return F.when(n > 1, F.sqrt(F.try_divide(m2, (n - 1).cast("double")))).otherwise(F.lit(0.0))


def auto_bin_count(n: Column, low: Column, high: Column, iqr: Column, integral: Column) -> Column:
    """How many equal bins the 'auto' rule asks for.

    The width is the smaller of Sturges' and Freedman-Diaconis', the latter not
    below half the square-root rule; at least 1 for an integer column.
    """
    span = high - low
    size = n.cast("double")
    sturges = span / (F.round(F.log2(size), 12) + 1.0)
    diaconis = iqr * 2.0 * F.pow(size, F.lit(-1.0 / 3.0))
    root = span / F.sqrt(size)
    width = F.least(F.greatest(diaconis, root / 2.0), sturges)
    width = F.when(integral & (width > 0), F.greatest(width, F.lit(1.0))).otherwise(width)
    return F.when(width > 0, F.ceil(F.try_divide(span, width))).otherwise(F.lit(1)).cast("bigint")


def bin_index(value: Column, first: Column, last: Column, bins: Column) -> Column:
    """Bin of a value among equal bins, corrected against the computed edges."""
    step = (last - first) / bins
    # beyond 2**53 the two edges of a constant column can be the same double
    share = F.coalesce(F.try_divide(value - first, last - first), F.lit(0.0))
    raw = F.least(F.floor(share * bins), bins - 1)
    down = (value < first + raw * step) & (raw > 0)
    up = (value >= first + (raw + 1) * step) & (raw < bins - 1)
    return F.when(down, raw - 1).when(up, raw + 1).otherwise(raw).cast("bigint")


def decimals_of(value: Column) -> Column:
    """Fewest decimals, up to 4, that reproduce the value."""
    expr = F.when(F.pmod(value, F.lit(1.0)) == 0, F.lit(0))
    for d in (1, 2, 3):
        expr = expr.when(F.round(value, d) == value, F.lit(d))
    return expr.otherwise(F.lit(4))


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Two-sample Kolmogorov-Smirnov p-value at the effective size of both samples.

    The argument is corrected for a finite size (Vrbik's expansion); then two
    expansions of the limit law, each used where it converges fast.
    """
    size = F.greatest(F.round(n.cast("double") * m / (n + m)), F.lit(1.0))
    root = F.sqrt(size)
    x = statistic * root
    x = F.when(statistic == 0, F.lit(0.0)).otherwise(x + F.lit(1.0) / (root * 6.0) + (x - 1.0) / (size * 4.0))
    upper = F.lit(0.0)
    for k in range(1, 9):
        upper = upper + F.exp(x * x * (-2.0 * k * k)) * (2.0 if k % 2 else -2.0)
    lower = F.lit(0.0)
    safe = F.greatest(x, F.lit(0.04))
    for k in range(1, 5):
        lower = lower + F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8.0) / (safe * safe))
    lower = F.lit(1.0) - lower * math.sqrt(2.0 * math.pi) / safe
    p = F.when(x <= 0.04, F.lit(1.0)).when(x < 1.18, lower).otherwise(upper)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


#: Up to so many values on the larger side the two-sample distribution is counted, as it is cheap there.
EXACT_SIDE = 10_000


def exact_kolmogorov_p(n: int, m: int, reach: int) -> float:
    """P(D >= reach / (n m)) of the two-sample statistic, over all orders of n and m values.

    An order is a lattice path from (0, 0) to (n, m), and its statistic is the
    largest |i m - j n| / (n m) on the way. The share of paths to a point that
    have touched the bound follows from the two points before it: the last step
    of i + j came from the left in i / (i + j) of them. Points beyond the bound
    have share 1, so a diagonal's work is the band between. All terms are
    positive, so small probabilities keep their digits.
    """
    import numpy as np

    if reach <= 0:
        return 1.0
    share = np.ones(n + 3)  # of the points (i, s - i) of a diagonal, at i + 1; 1 beyond the band
    share[1] = 0.0
    for s in range(1, n + m + 1):
        # the band: |i m - (s - i) n| < reach, within the rectangle
        low = max(0, s - m, (s * n - reach) // (n + m) + 1)
        high = min(n, s, -((-s * n - reach) // (n + m)) - 1)
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        # a point on an edge of the rectangle has no point before it on that side, at weight 0 or beyond the band
        share[low + 1:high + 2] = (share[low:high + 1] * i + share[low + 1:high + 2] * (s - i)) / s
        share[low], share[high + 2] = 1.0, 1.0
    return float(share[n + 1])


def two_decimals(value: Column) -> Column:
    """Round to two decimals by the exact binary value, ties to even, as printf does.

    0.015 is a little below its decimal reading and goes to 0.01. The value is
    split in two halves whose hundredfold is exact, so nothing is lost on the way.
    """
    spread = value * 134217729.0
    high = spread - (spread - value)
    low = (value - high) * 100.0
    high = high * 100.0
    whole = F.floor(high + low).cast("double")
    rest = (high - whole - 0.5) + low
    up = (rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    return F.when(up, whole + 1).otherwise(whole) / 100.0
