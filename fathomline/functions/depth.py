"""Numeric column functions on depth samples, codes and disparities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The 16-bit code range, its midpoint, and the largest finite half float.
CODE_MAX = 65535
MIDPOINT_CODE = 32768
HALF_MAX = 65504.0
LANES = 16


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clip01(x: Column) -> Column:
    """x between 0 and 1; null stays null (``least`` alone would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def score(x: Column, representation: Column) -> Column:
    """Larger is nearer: 1/x of metric depth (null unless x > 0), x of inverse depth, -x of relative depth."""
    metric = F.when(x > 0, F.try_divide(F.lit(1.0), x))
    return F.when(representation == "metric_depth", metric).when(representation == "inverse_depth", x).when(representation == "relative_depth", -x)


def canonical(s: Column, low: Column, high: Column) -> Column:
    """The score's place between its bounds, in [0, 1]; 0.5 where it is missing or the bounds are equal."""
    return F.coalesce(F.when(finite(s), clip01(F.try_divide(s - low, high - low))), F.lit(0.5))


def encode(v: Column) -> Column:
    """A value in [0, 1] as a 16-bit code, rounded half to even."""
    return F.rint(clip01(v) * CODE_MAX).cast("int")


def decode(code: Column) -> Column:
    return code / F.lit(float(CODE_MAX))


def inverse_metric(x: Column) -> Column:
    """1/x in single precision where that is finite and x > 0, else null."""
    inverse = (F.lit(1.0) / F.when(x > 0, x)).cast("float")
    return F.when(finite(x) & (x > 0) & finite(inverse), inverse)


def relative_disparity(near: Column, convergence: float, strength: float) -> Column:
    return (near - convergence) * (strength / 100.0)


def metric_disparity(inverse: Column, focal: float, baseline_mm: float, convergence_m: float, retained: float) -> Column:
    """The output fraction before it is clipped."""
    return F.lit(focal) / retained * (baseline_mm / 1000.0) * (inverse - 1.0 / convergence_m)


def lane_offset(shift: Column, sign: int = 1) -> Column:
    """A shift in pixels as a whole number of lanes; beyond 32 bits it is an error."""
    return F.ceil(shift * (sign * LANES) - 0.5).cast("int")


def bounded(x: Column, low: float, high: float, slack: float) -> Column:
    """x, snapped to a bound that it misses by no more than ``slack``; an error beyond that. -0.0 becomes 0.0."""
    snapped = F.when((x < low) & (low - x <= slack), F.lit(low)).when((x > high) & (x - high <= slack), F.lit(high)).when((x < low) | (x > high), F.raise_error(F.lit("statistic out of its bounds")).cast("double")).otherwise(x)
    return F.when(snapped == 0, F.lit(0.0)).otherwise(snapped)


def fits_half(x: Column) -> Column:
    """Aggregate: whether all finite values can be kept as half floats."""
    return F.coalesce(F.bool_and(F.when(finite(x), F.abs(x) <= HALF_MAX)), F.lit(True))
