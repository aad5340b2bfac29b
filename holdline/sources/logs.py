"""Stored change logs: parquet by day, fixed schema, sorted by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdline.functions.times import local_day, with_event_time
from holdline.model import FAMILIES


def write_log(df: DataFrame, path: str, family: str, mode: str = "append") -> None:
    """Range-partitioned before writing, so a crowded day or sensor is spread over
    several files instead of going through one task."""
    f = FAMILIES[family]
    dated = df.select(*f.schema.names).withColumn("day", local_day("sec"))
    (
        dated.repartitionByRange("day", f.key, "sec", "cs")
        .sortWithinPartitions("day", f.key, "sec", "cs")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def read_log(
    spark: SparkSession, path: str, family: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """The log with ``event_us``. ``since`` and ``until`` (days, inclusive) prune
    partitions."""
    f = FAMILIES[family]
    schema = T.StructType([*f.schema.fields, T.StructField("day", T.DateType(), True)])
    df = spark.read.schema(schema).parquet(path)
    if since:
        df = df.filter(F.col("day") >= F.lit(since).cast("date"))
    if until:
        df = df.filter(F.col("day") <= F.lit(until).cast("date"))
    return with_event_time(df, f.scale)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. NULL is an empty field."""
    df.write.mode("overwrite").option("header", True).csv(path)
