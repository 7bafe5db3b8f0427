"""Keyed randomness: a draw is a function of (row id, tag, seed).

``F.rand`` depends on how rows are laid out over partitions. A hash of the
row id does not, so the same seed gives the same rows at any parallelism and
after any recomputation.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _salt(tag: str, seed: int) -> Column:
    """One literal that stands for a tag and a seed; stable across processes."""
    digest = hashlib.blake2b(f"{seed}/{tag}".encode(), digest_size=8).digest()
    return F.lit(int.from_bytes(digest, "little", signed=True))


def uniform(tag: str, seed: int, *keys: Column) -> Column:
    """Uniform on the open interval (0, 1); 52 hash bits, centred in their cell."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, _salt(tag, seed)), 12)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-52)


def normal(tag: str, seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    return radius(tag, seed, *keys) * F.cos(angle(tag, seed, *keys))


def radius(tag: str, seed: int, *keys: Column) -> Column:
    """Distance from the origin of a standard normal point in the plane."""
    # ln and / may be null for Spark; saying they are not keeps null checks out of all that follows
    return F.sqrt(F.lit(-2.0) * F.coalesce(F.ln(uniform(tag + "/r", seed, *keys)), F.lit(0.0)))


def angle(tag: str, seed: int, *keys: Column) -> Column:
    """Direction of a standard normal point; its cosine and sine give two independent normals."""
    return F.lit(2.0 * math.pi) * uniform(tag + "/a", seed, *keys)


def laplace(scale: Column, tag: str, seed: int, *keys: Column) -> Column:
    """Laplace(0, scale) by inverting its distribution function."""
    centred = uniform(tag, seed, *keys) - 0.5
    return -scale * F.signum(centred) * F.ln(F.lit(1.0) - F.abs(centred) * 2.0)


# Chebyshev fit of erfc from Numerical Recipes, relative error below 1.2e-7 everywhere.
_ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368,
         -1.26551223)


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds ``z``; relatively exact far out, where 1 - cdf has no digits left."""
    x = F.abs(z) * math.sqrt(0.5)
    t = F.coalesce(F.lit(1.0) / (x * 0.5 + 1.0), F.lit(0.0))
    half = t * F.exp(_horner(_ERFC, t) - x * x) * 0.5
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a codegen expression."""
    return normal_tail(-z)


# Acklam's rational approximation of the normal quantile function.
_Q_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
        1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_Q_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
        6.680131188771972e01, -1.328068155288572e01, 1.0)
_Q_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
        -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_Q_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
        3.754408661907416e00, 1.0)
_Q_LOW = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + c
    return acc


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, p in (0, 1)."""
    centred = p - 0.5
    middle = centred * _horner(_Q_A, centred * centred) / _horner(_Q_B, centred * centred)
    low = F.sqrt(F.lit(-2.0) * F.ln(p))
    high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    return (
        F.when(p < _Q_LOW, _horner(_Q_C, low) / _horner(_Q_D, low))
        .when(p > 1.0 - _Q_LOW, -_horner(_Q_C, high) / _horner(_Q_D, high))
        .otherwise(middle)
    )


# --- permutations of 0..n-1 without a shuffle ---------------------------------

_ROUNDS = 6
_WALK = 20


def _grid(size: Column) -> tuple[Column, Column]:
    """Sides of the grid that holds ``size`` cells and fewer than a column more."""
    wide = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")
    return wide, F.floor((size + wide - 1) / wide.cast("decimal(19,0)")).cast("bigint")


def _network(place: Column, wide: Column, high: Column, salt: Column, keys: tuple[Column, ...]) -> Column:
    """One pass of the Feistel network, as a single expression, which Spark interprets."""
    def turned(state: Column, number: Column) -> Column:
        shift = lambda other, cells: F.pmod(F.xxhash64(other, number, salt, *keys), cells)
        x, y = state["x"], state["y"]
        odd = number % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(x + shift(y, wide), wide)).otherwise(x).alias("x"),
            F.when(odd, y).otherwise(F.pmod(y + shift(x, high), high)).alias("y"))

    start = F.struct(F.pmod(place, wide).alias("x"), F.floor(place / wide.cast("decimal(19,0)")).cast("bigint").alias("y"))
    rounds = F.array(*[F.lit(r) for r in range(1, _ROUNDS + 1)])
    return F.aggregate(rounds, start, turned, lambda s: s["y"] * wide + s["x"])


def permuted(index: Column, size: Column, tag: str, seed: int, *keys: Column) -> Column:
    """Position of ``index`` under a keyed random permutation of 0..size-1.

    A Feistel network on the grid of a = ceil(sqrt(size)) by b = ceil(size / a)
    cells: each round shifts one coordinate by a keyed hash of the other, which
    is a bijection of the grid. Fewer than a cells lie beyond ``size``; a
    position there is mapped on until it falls inside, which keeps the whole a
    bijection of 0..size-1. Up to 400 rows that takes at most ``_WALK`` steps; beyond,
    more are needed with a chance below 1e-26.
    """
    wide, high = _grid(size)
    network = lambda place: _network(place, wide, high, _salt(tag, seed), keys)
    walk = F.array(*[F.lit(r) for r in range(_WALK)])
    return F.aggregate(walk, network(index.cast("bigint")), lambda at, _: F.when(at >= size, network(at)).otherwise(at))


def with_permuted(rows: DataFrame, alias: str, index: Column, size: Column, tag: str, seed: int, *keys: Column) -> DataFrame:
    """Adds ``permuted`` as a column. Each round is a column of its own, which Spark compiles; only the
    few positions beyond ``size`` are mapped on by the interpreted expression."""
    salt = _salt(tag, seed)
    col = lambda name: F.col(f"_{name}_{alias}")
    step = lambda frame, **columns: frame.withColumns({f"_{k}_{alias}": v for k, v in columns.items()})
    wide, high = _grid(size)
    rows = step(rows, wide=wide, high=high, at=index.cast("bigint"))
    rows = step(rows, x=F.pmod(col("at"), col("wide")), y=F.call_function("div", col("at"), col("wide")))
    shift = lambda other, number, cells: F.pmod(F.xxhash64(col(other), F.lit(number), salt, *keys), col(cells))
    for number in range(1, _ROUNDS + 1):
        if number % 2:
            rows = step(rows, x=F.pmod(col("x") + shift("y", number, "wide"), col("wide")))
        else:
            rows = step(rows, y=F.pmod(col("y") + shift("x", number, "high"), col("high")))
    rows = step(rows, first=col("y") * col("wide") + col("x"))
    network = lambda place: _network(place, col("wide"), col("high"), salt, keys)
    walk = F.array(*[F.lit(r) for r in range(_WALK)])
    inside = F.aggregate(walk, col("first"), lambda at, _: F.when(at >= size, network(at)).otherwise(at))
    rows = rows.withColumn(alias, F.when(col("first") >= size, inside).otherwise(col("first")))
    return rows.drop(*[f"_{c}_{alias}" for c in ("wide", "high", "at", "x", "y", "first")])
