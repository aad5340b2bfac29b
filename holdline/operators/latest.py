"""Latest rows and snapshots: partial aggregates, never a global sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.functions.scalars import idiv
from holdline.functions.times import when_key
from holdline.operators.views import furnace_state
from holdline.sources.config import setting

_WHEN = ("sec", "cs")


def latest(log: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """The newest row per key, its NULLs included."""
    return log.groupBy(*key).agg(*[F.max_by(c, when_key()).alias(c) for c in (*_WHEN, *cols)])


def _newest(log: DataFrame) -> DataFrame:
    return _times(log.agg(F.max(when_key()).alias("t")).filter("t IS NOT NULL"))


def _times(df: DataFrame) -> DataFrame:
    """``(sec, cs)`` of a time key ``t``."""
    return df.select(idiv("t", 128).alias("sec"), (F.col("t") % 128).cast("int").alias("cs"))


def last_log_times(logs: list[DataFrame]) -> DataFrame:
    """Distinct newest ``(sec, cs)`` of each log; an empty log adds no row."""
    return reduce(DataFrame.unionByName, [_newest(log) for log in logs]).distinct()


def last_log_time(logs: list[DataFrame]) -> DataFrame:
    """The newest ``(sec, cs)`` of all logs: one row, zeros when all are empty."""
    top = last_log_times(logs).agg(F.max(when_key()).alias("t"))
    return _times(top.select(F.coalesce("t", F.lit(0).cast("bigint")).alias("t")))


def last_log_sec(logs: list[DataFrame]) -> DataFrame:
    """Seconds-only variant of :func:`last_log_time`."""
    tops = [log.agg(F.max("sec").alias("sec")) for log in logs]
    return reduce(DataFrame.unionByName, tops).agg(F.coalesce(F.max("sec"), F.lit(0)).alias("sec"))


def latest_within(log: DataFrame, dim: DataFrame, now: Column | int, seconds: int = 3600) -> DataFrame:
    """Per sensor of ``dim``: the newest value of the trailing period, ``found``
    telling a recorded NULL from no row at all."""
    now = now if isinstance(now, Column) else F.lit(now)
    recent = latest(log.filter(F.col("sec") > now - seconds), ["sensor_id"], ["temp"])
    out = dim.join(recent.withColumn("found", F.lit(True)), "sensor_id", "left")
    return out.select(
        "site", "sensor_id", "label", "temp", F.coalesce("found", F.lit(False)).alias("found")
    )


def pivot_labels(newest: DataFrame, labels: list[str], value: str = "temp") -> DataFrame:
    """One row per site, one column per label. The explicit list saves a job."""
    return newest.groupBy("site").pivot("label", labels).agg(F.max_by(value, when_key()))


# Snapshot columns by family; on the right the name in the wide row.
SNAPSHOT = {
    "max11201b": {"flux": "tflux"},
    "furnace": {"furnace_ctrl": "furnace_ctrl", "furnace_power": "furnace_power"},
    "bme680": {"temp": "tmp_ctrl_module", "pres": "plocal", "hum": "hum_in", "gas": "gas"},
    "sht31": {"temp": "tmp_outdoor_module", "hum": "hum_out"},
    "tsl2591": {"total": "vis_ir", "ired": "ired"},
    "veml6075": {"uva": "uva", "uvb": "uvb"},
    "ina260": {"vrms": "vrms", "irms": "irms", "pmean": "pmean"},
}


def last_logs(logs: dict[str, DataFrame], cfg: DataFrame, strict: bool = False) -> DataFrame:
    """One wide row per site: the newest value of every channel and the settings.

    ``logs`` carry a ``site`` column. With ``strict`` a site needs a row in every
    family; otherwise missing families give NULLs. ``sec`` is the newest time of
    any log of the site, the 1-wire log included when it is given.
    """
    parts = []
    for family, names in SNAPSHOT.items():
        log = furnace_state(logs[family]) if family == "furnace" else logs[family]
        wide = log.select("site", *_WHEN, *[F.col(c).alias(n) for c, n in names.items()])
        parts.append(wide.withColumn("__family", F.lit(family)))
    if "ds18b20" in logs:
        parts.append(logs["ds18b20"].select("site", *_WHEN).withColumn("__family", F.lit("ds18b20")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # One aggregate over all families: a single shuffle, combined map-side.
    aggs = [F.max("sec").alias("sec")]
    for family, names in SNAPSHOT.items():
        at = F.when(F.col("__family") == family, when_key())
        aggs.append(F.max(at).alias(f"__{family}"))
        aggs += [F.max_by(n, at).alias(n) for n in names.values()]
    out = rows.groupBy("site").agg(*aggs)
    if strict:
        out = out.dropna(subset=[f"__{family}" for family in SNAPSHOT])
    settings = ("elevation", "flux_area", "exch_flow_rate")
    return out.select(
        "site",
        "sec",
        *[setting(cfg, s, "INT").alias(s) for s in settings],
        *[n for names in SNAPSHOT.values() for n in names.values()],
    )
