"""Runtime, energy, cost, time-weighted averages and correlation.

The project behind the data states these as goals and gives the constants only;
the formulas are ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.functions.scalars import idiv
from holdline.functions.times import day_start_sec, local_day
from holdline.operators.changelog import intervals, is_known
from holdline.operators.history import History
from holdline.operators.views import furnace_state
from holdline.sources.config import setting

US = 1_000_000
BTU_PER_THERM = 100_000.0
WS_PER_KWH = 3_600_000.0


def _known(horizon_us: Column | int | None) -> None:
    if horizon_us is None:
        raise ValueError("a horizon is needed: without it the newest interval has no length")


def by_day(spans: DataFrame, tz: str = "UTC") -> DataFrame:
    """Cut ``[start_us, end_us)`` at local midnights: ``day`` and the clipped span.
    The number of pieces is the number of days a span touches."""
    first = local_day(idiv("start_us", US), tz)
    last = local_day(idiv(F.col("end_us") - 1, US), tz)
    days = spans.filter(F.col("end_us") > F.col("start_us")).withColumn(
        "day", F.explode(F.sequence(first, last))
    )
    lo = day_start_sec(F.col("day"), tz) * US
    hi = day_start_sec(F.date_add("day", 1), tz) * US
    return days.withColumns({"start_us": F.greatest("start_us", lo), "end_us": F.least("end_us", hi)})


def furnace_runtime(log: DataFrame, key: list[str], cfg: DataFrame, horizon_us: int, tz: str = "UTC") -> DataFrame:
    """Burning seconds per key and day. A run is a maximal time with the control
    on; its first seconds, the ignition delay, do not burn. The last one lasts until
    ``horizon_us``."""
    _known(horizon_us)
    state = furnace_state(log)
    h = History.of(state, key, ["event_us"]).previous("__was", F.struct("furnace_ctrl"))
    turned = F.col("__was").isNull() | ~F.col("furnace_ctrl").eqNullSafe(F.col("__was.furnace_ctrl"))
    h = h.filter(turned).following("end_us", F.col("event_us"))
    delay = setting(cfg, "furnace_ignition_delay", "INT") * US
    runs = h.filter(F.col("furnace_ctrl") == 1).rows().select(
        *key,
        (F.col("event_us") + delay).alias("start_us"),
        F.coalesce("end_us", F.lit(horizon_us).cast("bigint")).alias("end_us"),
    )
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(float(US))
    return by_day(runs, tz).groupBy(*key, "day").agg(F.sum(seconds).alias("run_s"))


def gas_cost(runtime: DataFrame, cfg: DataFrame) -> DataFrame:
    """``therms`` and ``cost`` of burning seconds ``run_s``."""
    rate = setting(cfg, "furnace_burn_rate", "INT")
    therms = F.col("run_s") / F.lit(3600.0) * rate / F.lit(BTU_PER_THERM)
    return runtime.withColumn("therms", therms).withColumn(
        "cost", F.col("therms") * setting(cfg, "gas_cost", "FLOAT")
    )


def electric_cost(log: DataFrame, key: list[str], cfg: DataFrame, horizon_us: int, tz: str = "UTC") -> DataFrame:
    """``kwh``, ``cost``, ``known_s`` and ``unknown_s`` per key and day: power held
    over its interval, the last until ``horizon_us``; time under a tombstone counts as
    unknown, not as zero."""
    _known(horizon_us)
    h = History.of(log, key, ["event_us"]).following("end_us", F.col("event_us"))
    spans = h.rows().select(
        *key,
        F.col("event_us").alias("start_us"),
        F.coalesce("end_us", F.lit(horizon_us).cast("bigint")).alias("end_us"),
        "pmean",
    )
    dt = (F.col("end_us") - F.col("start_us")) / F.lit(float(US))
    known = is_known(["pmean"])
    out = by_day(spans, tz).groupBy(*key, "day").agg(
        F.coalesce(F.sum(F.col("pmean") * dt) / F.lit(WS_PER_KWH), F.lit(0.0)).alias("kwh"),
        F.coalesce(F.sum(F.when(known, dt)), F.lit(0.0)).alias("known_s"),
        F.coalesce(F.sum(F.when(~known, dt)), F.lit(0.0)).alias("unknown_s"),
    )
    return out.withColumn("cost", F.col("kwh") * setting(cfg, "electricity_cost", "FLOAT"))


def time_weighted(log: DataFrame, key: list[str], col: str, bucket_s: int, horizon_us: Column | int) -> DataFrame:
    """Time-weighted mean, minimum, maximum and share of known time per key and
    bucket (``bucket`` is its start in epoch seconds); the last value holds until
    ``horizon_us``."""
    _known(horizon_us)
    width = bucket_s * US
    first, last = idiv("start_us", width), idiv(F.col("end_us") - 1, width)
    spans = intervals(log, key, [col], horizon_us).filter(F.col("end_us") > F.col("start_us"))
    spans = spans.withColumns({"__lo": idiv(F.col("start_us") + (width - 1), width), "__hi": idiv("end_us", width) - 1})
    # At most two buckets are cut; those between belong to this value alone.
    ends = F.array(F.when(first < F.col("__lo"), first), F.when(last > F.col("__hi"), last))
    cut = spans.withColumn("__b", F.explode(F.array_distinct(F.array_compact(ends))))
    dt = F.least("end_us", (F.col("__b") + 1) * width) - F.greatest("start_us", F.col("__b") * width)
    parts = cut.groupBy(*key, "__b").agg(
        F.sum(F.col(col).cast("double") * dt).alias("__vt"),
        F.sum(dt).alias("__t"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    parts = parts.select(
        *key,
        (F.col("__b") * bucket_s).alias("bucket"),
        (F.col("__vt") / F.col("__t")).alias("mean"),
        "min",
        "max",
        (F.col("__t") / F.lit(float(width))).alias("coverage"),
    )
    whole = _expanded(spans.filter("__lo <= __hi"), "__lo", "__hi", "__b").select(
        *key,
        (F.col("__b") * bucket_s).alias("bucket"),
        F.col(col).cast("double").alias("mean"),
        F.col(col).alias("min"),
        F.col(col).alias("max"),
        F.lit(1.0).alias("coverage"),
    )
    return parts.unionByName(whole)


def _expanded(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for every number from ``low`` to ``high``, in three levels, so that no array
    has more than 1,024 elements for a range of a billion."""
    at = low
    for level, step in enumerate((1 << 20, 1 << 10, 1)):
        end = F.col(high) if at == low else F.least(F.col(at) + (step << 10) - 1, F.col(high))
        new = name if step == 1 else f"__level{level}"
        df = df.withColumn(new, F.explode(F.sequence(F.col(at), end, F.lit(step).cast("bigint"))))
        at = new
    return df


def correlate(a: DataFrame, b: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Correlation and covariance of ``mean`` on aligned buckets, one row per
    ``by``."""
    left = a.select(*on, F.col("mean").alias("x"))
    right = b.select(*on, F.col("mean").alias("y"))
    both = left.join(right, on)
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov")
    )
