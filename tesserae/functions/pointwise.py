"""Point-wise maps of values: columns in, a column out, so Spark fuses them with what stands around."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and largest values of the whole-number element types.
BOUNDS = {"u8": (0, 255), "u16": (0, 65535), "u32": (0, 4294967295), "i8": (-128, 127), "i16": (-32768, 32767), "i32": (-2147483648, 2147483647)}


def gamma(v: Column, exponent: float, gain: float = 1.0) -> Column:
    return F.lit(gain) * F.pow(v, F.lit(exponent))


def log(v: Column, gain: float = 1.0) -> Column:
    return F.lit(gain) * F.log1p(v)


def sigmoid(v: Column, cutoff: float, gain: float) -> Column:
    return 1 / (1 + F.exp(F.lit(gain) * (F.lit(cutoff) - v)))


def rescale(v: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Clamped to [low, high], then mapped onto [to_low, to_high]."""
    inside = F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return F.lit(to_low) + (inside - low) * ((to_high - to_low) / (high - low))


def narrow(v: Column, kind: str) -> Column:
    """Rounded half away from zero and kept within the type's bounds; NaN is 0."""
    low, high = BOUNDS[kind]
    away = F.when(F.isnan(v), F.lit(0.0)).otherwise(F.signum(v) * F.floor(F.abs(v) + 0.5))
    return F.least(F.greatest(away, F.lit(float(low))), F.lit(float(high))).cast("long")


def half_even(v: Column) -> Column:
    return F.bround(v, 0).cast("long")


def fixed_point(v: Column, bits: int = 20) -> Column:
    """v * 2^bits, rounded half away from zero: sums of these don't depend on their order."""
    scaled = v * F.lit(float(1 << bits))
    return (F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).cast("decimal(38,0)")


def decimals(v: Column, n: int) -> Column:
    """v rounded half away from zero to n places by whole numbers, as SQL engines do for doubles; F.round goes through decimal text,
    which takes longer than making a pair. What is too large for that is left to it."""
    scaled = F.abs(v) * F.lit(10.0**n)
    down = F.floor(scaled)
    near = (down + F.when(scaled - down >= 0.5, 1).otherwise(0)) / F.lit(10.0**n)
    return F.when(scaled < 2.0**52, F.when(v < 0, -near).otherwise(near)).otherwise(F.round(v, n))
