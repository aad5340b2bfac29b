"""Site settings: case-insensitive names, typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdline.model import CONFIG_SCHEMA, DEFAULT_CONFIG

_SPARK_TYPE = {"INT": "bigint", "FLOAT": "double", "TEXT": "string"}


def default_config(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{var}', '{val}', '{kind}')" for var, val, kind in DEFAULT_CONFIG)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(CONFIG_SCHEMA.names)})")


def config_value(cfg: DataFrame, name: str, type: str) -> DataFrame:
    """One row ``value``; the query fails when the setting is missing or has
    another type than ``INT``, ``FLOAT`` or ``TEXT`` as asked."""
    target = _SPARK_TYPE[type]
    found = cfg.filter(F.lower("var") == name.lower()).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("val_type") == type, F.col("val")).try_cast(target)).alias("v"),
    )
    return found.select(
        F.when(F.col("n") == 0, F.raise_error(F.lit(f"setting {name} not found")).cast(target))
        .when(F.col("v").isNull(), F.raise_error(F.lit(f"setting {name} is not of type {type}")).cast(target))
        .otherwise(F.col("v"))
        .alias("value")
    )


def setting(cfg: DataFrame, name: str, type: str) -> Column:
    """The setting as a scalar subquery, usable in any expression."""
    return config_value(cfg, name, type).scalar()
