"""Cleaning of raw trips and the profile of what cleaning drops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.functions.expressions import duration_minutes


@dataclass(frozen=True)
class Limits:
    """Inclusive limits of valid trips."""

    first_zone: int = 1
    last_zone: int = 263
    minutes: tuple[float, float] = (1.0, 360.0)
    fare: tuple[float, float] = (0.01, 1000.0)
    miles: tuple[float, float] = (0.0, 100.0)


LIMITS = Limits()


def _duration() -> Column:
    return duration_minutes(F.col("t0"), F.col("t1"))


def valid(limits: Limits = LIMITS) -> Column:
    """The conjunction of all tests; null operands drop a row."""
    zone = lambda c: F.col(c).between(limits.first_zone, limits.last_zone)
    return zone("pu") & zone("do") & (F.col("t1") > F.col("t0")) & _duration().between(*limits.minutes) & F.col("fare").between(*limits.fare) & F.col("dist").between(*limits.miles)


def clean(raw: DataFrame, limits: Limits = LIMITS, year: int | None = None) -> DataFrame:
    """Valid trips in the narrow model o, d, dur, fare, total, dist, tip, rate, wd, hr, mo, yr.

    With a year, the range test on the start time reaches the scan, where a test on year(t0) wouldn't.
    """
    if year is not None:
        raw = raw.where((F.col("t0") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("t0") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    return raw.where(valid(limits)).select(
        F.col("pu").cast("int").alias("o"),
        F.col("do").cast("int").alias("d"),
        _duration().alias("dur"),
        "fare",
        "total",
        "dist",
        "tip",
        F.col("rate").cast("int").alias("rate"),
        F.weekday("t0").alias("wd"),
        F.hour("t0").alias("hr"),
        F.month("t0").alias("mo"),
        F.year("t0").alias("yr"),
    )


def drop_reasons(limits: Limits = LIMITS) -> dict[str, Column]:
    """Tests that count a row as bad; they overlap, and null fares or distances count in none."""
    out = lambda c, a, b: (F.col(c) < a) | (F.col(c) > b)
    zones = F.col("pu").isNull() | F.col("do").isNull() | out("pu", limits.first_zone, limits.last_zone) | out("do", limits.first_zone, limits.last_zone)
    return {
        "bad_zone": zones,
        "bad_time": F.col("t0").isNull() | F.col("t1").isNull() | (F.col("t1") <= F.col("t0")),
        "bad_duration": (_duration() < limits.minutes[0]) | (_duration() > limits.minutes[1]),
        "bad_fare": out("fare", *limits.fare),
        "bad_distance": out("dist", *limits.miles),
    }


def profile(raw: DataFrame, year: int, limits: Limits = LIMITS) -> DataFrame:
    """One row: raw rows, each drop reason's count, rows out of the year, rows kept."""
    in_year = F.year("t0") == year
    counts = [F.count_if(test).alias(name) for name, test in drop_reasons(limits).items()]
    return raw.agg(F.count(F.lit(1)).alias("raw_rows"), *counts, F.count_if(~in_year).alias("out_of_year"), F.count_if(in_year & valid(limits)).alias("kept"))


def monthly_profile(raw: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Raw and kept rows by year and month, with totals by year (month 0) in the same pass."""
    keyed = raw.select(F.year("t0").alias("year"), F.month("t0").alias("month"), valid(limits).alias("ok")).where("year is not null")
    both = keyed.rollup("year", "month").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if("ok").alias("kept"))
    return both.where("year is not null").select("year", F.coalesce("month", F.lit(0)).alias("month"), "raw_rows", "kept", F.round(F.col("kept") * 100.0 / F.col("raw_rows"), 3).alias("kept_pct"))
