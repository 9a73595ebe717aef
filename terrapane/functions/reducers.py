"""Reducers of a window of samples: each is some aggregate columns and a column over their results.

A missing sample is NULL.  It makes mean, sum, min, max, dd and sine_dd NULL; bins
counts it as outside, nanmean leaves it out.  Completeness compares the samples that
are there with the number expected, which is count(*) or, for cubes on one time
axis, the number of the axis' steps in the period.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CALCS = ("mean", "nanmean", "sum", "min", "max", "dd", "bins", "sine_dd")
THRESHOLD_CALCS = ("dd", "bins", "sine_dd")


@dataclass(frozen=True)
class Thresholds:
    """Lower and upper threshold, and which of the two degrees are measured from: 0 the lower, 1 the upper."""

    low: float
    high: float
    base: int = 0

    def __post_init__(self):
        if self.base not in (0, 1):
            raise ValueError(f"the third of ddargs must be 0 or 1, not {self.base!r}")

    @property
    def suffix(self) -> str:
        return f"{_short(self.low)}_{_short(self.high)}"


def _short(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and not isinstance(x, float) else str(x)


def thresholds(ddargs: Sequence) -> tuple[list[Thresholds], bool]:
    """(low, high, base), or a list of such; and whether it was a list."""
    args = list(ddargs)
    if args and isinstance(args[0], (list, tuple)) or args and hasattr(args[0], "__len__"):
        return [Thresholds(*list(a)) for a in args], True
    if len(args) not in (2, 3):
        raise ValueError(f"ddargs need a lower and an upper threshold and 0 or 1, not {ddargs!r}")
    return [Thresholds(*args)], False


def inside(v: Column, t: Thresholds) -> Column:
    """Strictly between both thresholds."""
    return (v > t.low) & (v < t.high)


def ordered_mean(v: Column, time: Column) -> Column:
    """An aggregate: the mean of the samples, added one after another in order of time, so that its last bit is always the same."""
    samples = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(time.alias("t"), v.cast("double").alias("v")))))
    return F.try_divide(F.aggregate(samples, F.lit(0.0), lambda a, s: a + s["v"]), F.count(v))


def aggregates(calc: str, v: Column, t: Thresholds | None, name: str, time: Column, samples: str) -> dict[str, Column]:
    """Aggregate columns by name for one output; samples: a name for what all outputs of the same samples share.

    Degrees below a threshold are NULL or not by the last bit of the mean where it lies on the edge of what a sine can
    have; partial sums would add in an order that hangs on the scan's splits, so sine_dd from above takes samples by time.
    """
    if calc not in CALCS:
        raise ValueError(f"calc {calc!r} is not one of {', '.join(CALCS)}")
    if calc in THRESHOLD_CALCS and t is None:
        raise ValueError(f"calc {calc!r} needs ddargs")
    count = {f"{name}__c": F.count(v)}
    if calc in ("mean", "nanmean"):
        return count | {f"{name}__a": F.avg(v)}
    if calc == "sum":
        return count | {f"{name}__a": F.sum(v)}
    if calc in ("min", "max"):
        return count | {f"{name}__a": getattr(F, calc)(v)}
    if calc == "dd":
        from_ = t.low if t.base == 0 else t.high
        return count | {f"{name}__a": F.sum(F.when(inside(v, t), F.abs(v - F.lit(float(from_)))).otherwise(F.lit(0.0)))}
    if calc == "bins":
        return count | {f"{name}__a": F.sum(F.when(inside(v, t), F.lit(1.0)).otherwise(F.lit(0.0)))}
    mean = {f"{name}__a": F.avg(v)} if t.base == 0 else {f"{samples}__m": ordered_mean(v, time)}
    return count | {f"{name}__lo": F.min(v), f"{name}__hi": F.max(v)} | mean


def result(calc: str, t: Thresholds | None, name: str, expected: Column, samples: str) -> Column:
    """The output from the aggregate columns.  expected: how many samples the window should have; 0 for an empty one."""
    whole = (F.col(f"{name}__c") == expected) & (expected > 0)
    value = F.col(f"{samples}__m" if calc == "sine_dd" and t.base == 1 else f"{name}__a")
    if calc == "nanmean":
        return value
    if calc == "bins":
        return F.when(expected > 0, value)
    if calc == "sine_dd":
        value = sine_degrees(F.col(f"{name}__lo"), F.col(f"{name}__hi"), value, t)
    return F.when(whole, value)


def sine_cooling(lo: Column, hi: Column, avg: Column, threshold: float) -> Column:
    """Degrees above a threshold of a day whose temperature follows a sine from lo to hi."""
    th = F.lit(float(threshold))
    span = hi - lo
    a = F.acos(F.try_divide(F.lit(2.0) * th - hi - lo, span))
    between = ((avg - th) * a + span * F.sin(a) / 2) / math.pi
    return F.when(th <= lo, avg - th).when(th < hi, between).otherwise(F.lit(0.0))


def sine_heating(lo: Column, hi: Column, avg: Column, threshold: float) -> Column:
    """Degrees below a threshold of such a day; NULL where the average lies too far from the threshold for any sine."""
    th = F.lit(float(threshold))
    half = (hi - lo) / 2
    ratio = F.try_divide(th - avg, half)
    phi = F.when(F.abs(ratio) <= 1, F.asin(ratio))
    between = ((th - avg) * (phi + math.pi / 2) + half * F.cos(phi)) / math.pi
    return F.when(th >= hi, th - avg).when(th > lo, between).otherwise(F.lit(0.0))


def sine_degrees(lo: Column, hi: Column, avg: Column, t: Thresholds) -> Column:
    if t.base == 0:
        return sine_cooling(lo, hi, avg, t.low) - sine_cooling(lo, hi, avg, t.high)
    return sine_heating(lo, hi, avg, t.high) - sine_heating(lo, hi, avg, t.low)


def sine_share(lo: Column, hi: Column, threshold: float) -> Column:
    """The share of a day above a threshold, if its temperature follows a sine from lo to hi."""
    th = F.lit(float(threshold))
    between = F.acos(F.try_divide(F.lit(2.0) * th - hi - lo, hi - lo)) / math.pi
    return F.when(th <= lo, 1.0).when(th < hi, between).when(th >= hi, 0.0)


def share_inside(v: Column, t: Thresholds) -> Column:
    """An aggregate: the share of samples strictly between the thresholds."""
    return F.avg(F.when(inside(v, t), F.lit(1.0)).otherwise(F.lit(0.0)))
