"""Upserts into the sensor dimension and the heartbeat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdline.functions.scalars import join_on
from holdline.session import materialize


def upsert_sensors(dim: DataFrame, seen: DataFrame) -> DataFrame:
    """``dim`` plus one row per unknown ``serial_code`` in ``seen``. New ids follow
    the largest one in serial order; the label starts as the serial. Serials are dealt
    out by range and numbered in their ranges; only a count per range meets in one task."""
    new = (
        seen.select("site", "serial_code")
        .groupBy("serial_code")
        .agg(F.min("site").alias("site"))
        .join(dim.select("serial_code"), "serial_code", "left_anti")
        .repartitionByRange("serial_code")
        .withColumn("__range", F.spark_partition_id())
    )
    new = materialize(new)  # the ranges must not change between the reads below
    top = dim.agg(F.coalesce(F.max("sensor_id"), F.lit(0))).scalar()
    counts = new.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    numbered = join_on(new, counts.select("__range", before.alias("__before")), ["__range"], "inner")
    place = F.row_number().over(Window.partitionBy("__range").orderBy("serial_code"))
    return dim.unionByName(
        numbered.select(
            (top + F.col("__before") + place).alias("sensor_id"),
            "site",
            "serial_code",
            F.col("serial_code").alias("label"),
        )
    )


def upsert_heartbeats(hb: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins: ``new(sensor_name, sec, seq)`` over ``hb(sensor_name, sec)``."""
    old = hb.select("sensor_name", "sec", F.lit(None).cast("bigint").alias("seq"))
    both = old.unionByName(new.select("sensor_name", "sec", F.col("seq").cast("bigint")))
    # Stored rows lose against any new one.
    seq = F.coalesce("seq", F.lit(-(1 << 63)))
    return both.groupBy("sensor_name").agg(F.max_by("sec", seq).alias("sec"))


def dimension_violations(dim: DataFrame) -> DataFrame:
    """Rows that break the dimension's rules, one row per broken rule."""
    empty = dim.select(
        "sensor_id",
        F.when(F.coalesce(F.col("serial_code"), F.lit("")) == "", "empty serial_code")
        .when(F.coalesce(F.col("label"), F.lit("")) == "", "empty label")
        .alias("rule"),
    ).filter(F.col("rule").isNotNull())
    out = empty
    for keys, rule in ((["sensor_id"], "sensor_id"), (["serial_code"], "serial_code"), (["site", "label"], "label")):
        twice = (
            dim.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.max("sensor_id").alias("id"))
            .filter(F.col("n") > 1)
            .select(F.col("id").alias("sensor_id"), F.lit(f"duplicate {rule}").alias("rule"))
        )
        out = out.unionByName(twice)
    return out
