"""Column expressions of the trip model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dayparts in the order in which they are tested: (label, weekend or None, hour ranges as [from, to)).
DAYPARTS = (
    ("late_night_weekend", True, ((22, 24), (0, 4))),
    ("am_peak", False, ((6, 10),)),
    ("pm_peak", False, ((16, 20),)),
    ("midday", None, ((10, 16),)),
    ("evening", None, ((20, 24), (4, 6))),
)
OTHER = "other"


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, by whole-second boundaries crossed."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return seconds / F.lit(60.0)


def is_weekend(weekday: Column) -> Column:
    """Weekday counts from 0 = Monday."""
    return weekday >= 5


def daypart(weekday: Column, hour: Column) -> Column:
    """Label of a (weekday, hour) cell; the first part that matches wins."""
    out = None
    for label, weekend, ranges in DAYPARTS:
        test = F.lit(False)
        for a, b in ranges:
            test = test | ((hour >= a) & (hour < b))
        if weekend is not None:
            test = test & (is_weekend(weekday) if weekend else ~is_weekend(weekday))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(OTHER)


def capped_bin(x: Column, cap: int = 120) -> Column:
    """Unit bin of a non-negative value, the last one open."""
    return F.least(F.floor(x), F.lit(cap)).cast("int")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate of the rows that have both values; null where either doesn't vary.

    The variances are compared by their extremes, so rounding can't make a constant column vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number, to about 1e-12: its own logarithms up to 16, Stirling's series beyond."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n > 16, series).otherwise(F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(17)]), (n + 1).cast("int")))


def net_flow_index(outward: Column, inward: Column) -> Column:
    """(out - in) / (out + in): +1 for a pure source; null without flow."""
    return safe_ratio(outward - inward, outward + inward)


def contains(text: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; null counts as no match."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def integer_hash(*keys: Column) -> Column:
    """Multiplicative hash in 0..2^31-2 that any SQL engine can repeat with 64-bit integers."""
    out = F.lit(0).cast("long")
    for k in keys:
        out = ((out + k.cast("long")) * 48271 + 11) % 2147483647
    return out


def geoid(state: str, county: Column, tract: Column) -> Column:
    """Census identifier: state, county, and the tract padded to six digits."""
    return F.concat(F.lit(state), county, F.lpad(tract.cast("string"), 6, "0"))


def coordinate_key(lat: Column, lon: Column, digits: int = 3) -> Column:
    """Composite key of coordinates snapped to a grid."""
    return F.concat_ws(",", F.format_number(lat, digits), F.format_number(lon, digits))


def quarter_day(hour: Column) -> Column:
    """Six-hour label of an hour: 00-06, 06-12, 12-18, 18-24."""
    part = F.floor(hour / 6).cast("int")
    return F.concat_ws("-", F.lpad((part * 6).cast("string"), 2, "0"), F.lpad((part * 6 + 6).cast("string"), 2, "0"))
