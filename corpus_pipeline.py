"""A corpus from raw documents to token files, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. What
it returns is written as Parquet before the next one reads it; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from holdline.llm import common, decontaminate, jaccard, mixing, quality, token_blocks
from holdline.llm.queries import MIX_DEFAULT, MIX_FACTOR, MIX_SEED, MIX_WEIGHTS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones here, accepts."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model, score_col="quality_score")
    return rows.filter(f"quality_score >= {quality.THRESHOLD}").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar word shingles connect."""
    return jaccard.without_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have their target shares, shuffled."""
    return mixing.mixed(docs, MIX_WEIGHTS, MIX_FACTOR, MIX_SEED, default=MIX_DEFAULT).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document's ids, as read from the files."""
    folder = common.new_folder(spark, "token-blocks")
    token_blocks.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_blocks.read_documents(spark, folder)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixture),
    ("token files", token_files),
]

# Compression, tokenizers and 64-bit fingerprints have no SQL; the tests recompute the
# stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, "stage")
    return docs
