"""Session settings shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A key with more rows than this is spread over several tasks (see History).
MAX_ROWS_CONF = "holdline.maxRowsPerTask"
MAX_ROWS_DEFAULT = 4_000_000


def max_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="holdline-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder so that later stages see the same rows
    and partition numbers even when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, for tables that are
    read several times: a read takes the columns and rows it needs."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("holdline")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
