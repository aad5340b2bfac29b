"""Text dumps of 1-wire temperature sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdline.operators.views import valid_temperature


def read_w1(spark: SparkSession, path: str) -> DataFrame:
    """One row per dump file; ``serial_code`` is the name of its folder. A failed read
    leaves a file without a byte, which the file sources of DataFrames skip; reading whole
    files as records does not."""
    files = spark.sparkContext.wholeTextFiles(path, spark.sparkContext.defaultParallelism)
    df = files.toDF("path string, text string")
    return df.withColumn("serial_code", F.element_at(F.split("path", "/"), -2))


def parse_w1(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``temp`` in hundredths, and ``reason`` to dumps without a usable one: ``empty``
    (no text at all), or as ``valid_temperature`` gives it. The first line has to end in
    YES, the second holds ``t=<thousandths>``."""
    lines = F.split(F.col(text_col), "\n")
    ok = F.coalesce(F.trim(F.get(lines, F.lit(0))).endswith("YES"), F.lit(False))
    milli = F.regexp_extract(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"t=\s*([+-]?\d+)\s*$", 1)
    out = valid_temperature(df.withColumn("milli", milli.try_cast("int")), "milli", ok)
    empty = F.coalesce(F.col(text_col), F.lit("")) == ""
    return out.withColumn("reason", F.when(empty, "empty").otherwise(F.col("reason")))
