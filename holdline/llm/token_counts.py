"""Token counts with a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file.
Counts already stored under both digests are joined; only the distinct texts not yet
stored are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common, pieces

_COUNTS = pa.schema([("content", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and the library's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _encode(path: str):
    def run(batches):
        for digests, texts in common.columns_of(batches, "content", "text"):
            yield common.batch({"content": digests, "n_tokens": pieces.count_all(path, texts)}, _COUNTS)

    return run


def stored_counts(spark, cache_dir: str, version: str) -> DataFrame | None:
    """(content, n_tokens) of one tokenizer; a text stored twice by jobs that ran at
    the same time counts once."""
    if not common.exists(spark, cache_dir):
        return None
    rows = spark.read.schema("content binary, n_tokens long, tokenizer string").parquet(cache_dir)
    rows = rows.filter(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    A null text is an empty one. Rows with a null or repeated id keep their own row;
    an empty table gives no rows; other columns are ignored. Runs one job to fill the
    cache in ``cache_dir``.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("text"))
    keyed = keyed.withColumn("content", F.unhex(F.sha2("text", 256)))

    stored = stored_counts(spark, cache_dir, version)
    missed = keyed
    if stored is not None:
        # Digests alone meet the cache; texts are fetched for those not in it, whose table
        # Spark knows the size of: where few are new, no text is shuffled.
        new = common.written(keyed.select("content").distinct().join(stored, "content", "left_anti"), "new-digests")
        missed = keyed.join(new, "content", "left_semi")
    # One text per digest and task before the shuffle, so copies don't meet in one task.
    misses = missed.groupBy("content").agg(F.first("text").alias("text"))
    counted = common.bounded_batches(misses).mapInArrow(_encode(tokenizer), "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_dir)

    rows = keyed.select(id_col, "content", F.octet_length("text").cast("long").alias("n_bytes"))
    # Written first, so that nothing but a shuffle stands below the join, which Spark can
    # then split where a third of all rows have one text.
    counts = common.written(stored_counts(spark, cache_dir, version), "counts")
    return rows.join(counts, "content").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
