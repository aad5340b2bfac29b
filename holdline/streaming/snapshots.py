"""Numbered folders of a table that a stream writes as a whole at every trigger."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=<n>`` folders under ``path``, ascending."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        done = _folder(spark, f"{path}/{name}/_SUCCESS")
        if name.startswith("batch=") and done[0].exists(done[1]):
            found.append(int(name.removeprefix("batch=")))
    return sorted(found)


def drop_versions(spark: SparkSession, path: str, below: int) -> None:
    for n in versions(spark, path):
        if n < below:
            fs, p = _folder(spark, f"{path}/batch={n}")
            fs.delete(p, True)
