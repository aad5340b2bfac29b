"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from pathlib import Path
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from holdline.session import shared_dir

# Rows handed to Python at once. With the bytes limit below it bounds a worker's memory
# by a few MB and the longest single text.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_sent_to: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _sent_to:
        return
    package = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="holdline-")) / "holdline.zip"
    with ZipFile(file, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(file))
    _sent_to.add(sc.applicationId)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches kept small, for long texts, and its
    executors able to run this package."""
    send_package(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and saves
    the column types, and later stages need not repeat the work before it."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def batch(columns: Mapping[str, object], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def columns_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The named columns of each batch as Python lists."""
    for b in batches:
        yield [b.column(n).to_pylist() for n in names]
