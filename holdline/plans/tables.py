"""The driver's tables seen as sensor logs.

``events`` holds no sensor data, so its columns are mapped onto the log schemas:
a user is a site with one sensor of each family and four thermometers, an event is
a reading of every chip of its site, and ``error`` events are tombstones. So each
family's log has a row for every event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdline.functions.scalars import idiv
from holdline.functions.times import cs_of, sec_of, with_event_time
from holdline.model import FAMILIES
from holdline.operators.history import History
from holdline.sources.config import default_config

LABELS = ("fencepost", "heat_exch_inlet", "heat_exch_outlet", "tank_1")
DAY_US = 86_400_000_000


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, in any session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def adapt_events(events: DataFrame) -> DataFrame:
    us, user = _micros(F.col("ts")), F.col("user_id")
    df = events.select(
        "event_id",
        user.alias("site"),
        user.alias("sensor_key"),
        us.alias("us"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        (F.col("event_type") == "error").alias("tomb"),
        "event_type",
    )
    df = df.withColumns(
        {"sec": sec_of("us"), "cs": cs_of("us"), "cs100": cs_of("us", "centi")}
    )
    return with_event_time(df)


def _channels(family: str) -> dict[str, Column]:
    v, k = F.col("v"), F.col("k")
    return {
        "ds18b20": lambda: {"temp": v - 5000},
        "max11201b": lambda: {"flux": idiv(v - 5000, 100)},
        "furnace": lambda: {"q1": k % 2, "q2": idiv(k, 2) % 2},
        "bme680": lambda: {"temp": v - 5000, "pres": k + 8400, "hum": v % 1001, "gas": k + 1},
        "sht31": lambda: {"temp": v - 5000, "hum": v % 1001},
        "tsl2591": lambda: {"total": v * 1000, "ired": k * 10_000},
        "veml6075": lambda: {"uva": v, "uvb": k * 10},
        "ina260": lambda: {
            "vrms": k % 10 + 115,
            "irms": F.when(k % 10 == 0, 0).otherwise(v % 2000),
            "pmean": v % 2400,
        },
    }[family]()


def readings(ev: DataFrame, *families: str) -> DataFrame:
    """Events with the channels of the given families, NULL on tombstones."""
    cols = {}
    for family in families:
        types = dict(FAMILIES[family].channels)
        for c, e in _channels(family).items():
            cols[c] = F.when(~F.col("tomb"), e.cast(types[c]))
    return ev.withColumns(cols)


def family_log(ev: DataFrame, family: str) -> DataFrame:
    """Log rows of one family, with what else is known of the event."""
    f = FAMILIES[family]
    rows = readings(ev, family)
    if family == "ds18b20":
        rows = rows.withColumns(
            {"sensor_id": F.col("site") * 4 + F.col("k") % 4, "cs": F.col("cs100")}
        )
        rows = with_event_time(rows, "centi")
    more = [c for c in ("event_us", "event_id", "event_type", "session") if c in rows.columns]
    return rows.select("site", f.key, "sec", "cs", *more, *f.columns)


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return adapt_events(self.read("events"))

    def log(self, family: str) -> DataFrame:
        return family_log(self.events(), family)

    def logs(self, *families: str) -> dict[str, DataFrame]:
        return {f: self.log(f) for f in (families or FAMILIES)}

    def sensor_ids(self) -> DataFrame:
        ids = self.log("ds18b20").select("site", "sensor_id").distinct()
        serial = F.concat(F.lit("28-"), F.lpad(F.lower(F.hex("sensor_id")), 12, "0"))
        label = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("sensor_id") % 4).cast("int"))
        return ids.select("sensor_id", "site", serial.alias("serial_code"), label.alias("label"))

    def dim(self) -> DataFrame:
        """The sensors that signed up; the others are unknown to the dimension."""
        signed = self.log("ds18b20").filter("event_type = 'signup'").select("sensor_id")
        return self.sensor_ids().join(signed, "sensor_id", "left_semi")

    def cfg(self) -> DataFrame:
        return default_config(self.spark)

    def now(self) -> Column:
        """The newest second of the data, as a scalar subquery."""
        return self.events().agg(F.max("sec")).scalar()

    def sessions(self) -> DataFrame:
        """Events with ``session``: a new one after a silence of over a day."""
        h = History.of(self.events(), ["sensor_key"], ["us", "event_id"]).previous("prev_us", F.col("us"))
        gap = F.coalesce((F.col("us") - F.col("prev_us") > DAY_US).cast("bigint"), F.lit(0).cast("bigint"))
        h = h.running_sum("session", gap)
        return h.with_columns(session=F.col("session") + 1).rows()
