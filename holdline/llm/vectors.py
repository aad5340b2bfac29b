"""Rows of a vector table that can be computed with, and their numbers in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows that are worked on at once, unless Spark hands over more.
ROWS = 4096


def complete(vector: Column) -> Column:
    """True for vectors that are there, without null and non-finite components."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, number)


def usable(df: DataFrame, parts: int = 1, **columns: str) -> tuple[DataFrame, int]:
    """The complete vectors of ``df`` as doubles, and their length.

    ``columns`` maps the names wanted to those of ``df``; one of them is ``vector``. The
    length is the one most rows have, of several the greatest; it is a multiple of
    ``parts`` and not 0. Rows of any other length are left out. 0 without any row.
    """
    rows = df.select(*[F.col(old).alias(new) for new, old in columns.items()])
    rows = rows.filter(complete(F.col("vector")))
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    size = F.size("vector")
    lengths = rows.filter((size > 0) & (size % parts == 0)).groupBy(size.alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else 0
    return rows.filter((size == length) & (size > 0)), length


def matrix(batch: pa.RecordBatch, length: int, name: str = "vector") -> np.ndarray:
    """The vectors of a batch, all of one length and without nulls, as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def joined(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, so that each call of numpy has much
    to do."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
