"""Publish/subscribe messages: topics to typed rows. Works on streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The topic layout and the payloads of sensor life-cycle messages.
SERIAL = r"^[0-9a-f]{2}-[0-9a-f]{12}$"
OFFLINE = "offline"
TOPIC_FORMAT = "sensors/%02x-%02x%02x%02x%02x%02x%02x"


def sensor_topic(addr: list[Column], suffix: str = "") -> Column:
    """Topic of the device with the eight address bytes ``addr``: family code, then
    the serial from its high byte down, as the kernel names its folders."""
    return F.concat(F.format_string(TOPIC_FORMAT, addr[0], *addr[6:0:-1]), F.lit(suffix))


def route_messages(df: DataFrame, topic: str, payload: str) -> DataFrame:
    """Add ``kind``, ``node``, ``value`` (integer readings) and ``tombstone``.

    Kinds: ``data``, ``error`` and ``lifecycle`` of a sensor, ``vent`` and
    ``swamp_pump`` switches, ``bus_error``, ``act`` and ``hb`` of a node, ``other``.
    """
    parts = F.split(F.col(topic), "/")
    n, first, second, third = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    sensor = (first == "sensors") & second.rlike(SERIAL)
    kind = (
        F.when(sensor & (n == 3) & (third == "data"), "data")
        .when(sensor & (n == 3) & (third == "errors"), "error")
        .when(sensor & (n == 2), "lifecycle")
        .when((F.col(topic) == "sensors/w1/errors"), "bus_error")
        .when((first == "sensors") & (n == 2) & second.isin("vent", "swamp_pump"), second)
        .when((n == 2) & first.isin("act", "hb"), first)
        .otherwise("other")
    )
    out = df.withColumn("kind", kind)
    number = F.col(payload).try_cast("bigint")
    valued = F.col("kind").isin("data", "vent", "swamp_pump", "hb")
    return out.withColumns(
        {
            "node": F.when(F.col("kind").isin("data", "error", "lifecycle", "act", "hb"), second),
            "value": F.when(valued, number),
            "tombstone": (F.col("kind") == "data") & (F.col(payload) == OFFLINE),
        }
    )
