"""Event time: ``(sec, cs)`` pairs, microseconds and local wall-clock text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.functions.scalars import col, idiv

# Sub-second scales: "tick" is nanoseconds >> 23 (0..119), "centi" is hundredths.
TICK_SHIFT = 23
TICKS_PER_SECOND = 120
SCALES = ("tick", "centi")


def event_us(sec: Column | str, cs: Column | str, scale: str = "tick") -> Column:
    """Microseconds since the epoch of a ``(sec, cs)`` pair."""
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {SCALES}")
    fine = col(cs).cast("bigint")
    part = idiv(F.shiftleft(fine, TICK_SHIFT), 1000) if scale == "tick" else fine * 10_000
    return col(sec).cast("bigint") * 1_000_000 + part


def cs_of(us: Column | str, scale: str = "tick") -> Column:
    """Sub-second part of ``us`` on the given scale."""
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {SCALES}")
    micros = F.pmod(col(us), F.lit(1_000_000))
    part = F.shiftright(micros * 1000, TICK_SHIFT) if scale == "tick" else idiv(micros, 10_000)
    return part.cast("int")


def sec_of(us: Column | str) -> Column:
    return idiv(col(us) - F.pmod(col(us), F.lit(1_000_000)), 1_000_000)


def when_key(sec: Column | str = "sec", cs: Column | str = "cs") -> Column:
    """``(sec, cs)`` as one BIGINT that sorts the same way. A plain number keeps
    max_by in hash aggregation, where a struct would force a sort."""
    return col(sec) * 128 + col(cs)


def with_event_time(df: DataFrame, scale: str = "tick") -> DataFrame:
    return df.withColumn("event_us", event_us("sec", "cs", scale))


def split_event_time(df: DataFrame, us_col: str, scale: str = "tick") -> DataFrame:
    """Inverse of :func:`with_event_time`, exact to one tick."""
    return df.withColumns({"sec": sec_of(us_col), "cs": cs_of(us_col, scale)})


def wall_clock(sec: Column | str, tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` without a zone, whatever the session zone is."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), col(sec).cast("decimal(18,6)")
    )
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def local_text(sec: Column | str, tz: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in ``tz``."""
    return wall_clock(sec, tz).cast("string")


# Fixed value: the client's clock, seven hours behind UTC all year.
CLIENT_OFFSET_S = -7 * 3600


def client_text(sec: Column | str) -> Column:
    """The client's time: month and day unpadded, three blanks, then the time."""
    wall = wall_clock(col(sec) + CLIENT_OFFSET_S)
    day = F.concat_ws("-", *[part(wall).cast("string") for part in (F.year, F.month, F.dayofmonth)])
    return F.concat(day, F.lit("   "), F.substring(wall.cast("string"), 12, 8))


def local_day(sec: Column | str, tz: str = "UTC") -> Column:
    return wall_clock(sec, tz).cast("date")


def day_start_sec(day: Column, tz: str = "UTC") -> Column:
    """Epoch seconds at which the local ``day`` begins in ``tz``."""
    start = day.cast("timestamp_ntz")
    if tz != "UTC":
        start = F.convert_timezone(F.lit(tz), F.lit("UTC"), start)
    days = F.datediff(start.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(start) * 3600 + F.minute(start) * 60 + F.second(start)
