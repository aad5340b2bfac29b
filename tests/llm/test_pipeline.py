"""The stages of the pipeline against plain versions on what each one got."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import groups, shingles, similar_pairs
from holdline.llm import common, quality
from test_decontaminate import brute
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into each stage, and what comes out of the last."""
    docs = common.table(spark, sf_dir, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, sf_dir, stages):
    model = quality.fit(stages[0], common.table(spark, sf_dir, "labels"))
    weights = np.array(model.weights)
    want = []
    for i, t in texts(stages[0]).items():
        x = np.array([*quality.features(model.dictionaries, (t or "").encode()), 1.0])
        if 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35))) >= 0.3:
            want.append(i)
    assert sorted(ids(stages[1])) == sorted(want) and len(want) < stages[0].count()


def test_near_copy_stage(stages):
    sets = {i: shingles(t) for i, t in texts(stages[1]).items()}
    first = groups(sets, similar_pairs(sets))
    assert sorted(ids(stages[2])) == sorted(i for i in sets if first[i] == i)


def test_benchmark_stage(spark, sf_dir, stages):
    items = {r["item_id"]: r["text"] for r in common.table(spark, sf_dir, "benchmark").collect()}
    found = {d for d, _ in brute(texts(stages[2]), items)}
    assert sorted(ids(stages[3])) == sorted(set(texts(stages[2])) - found)


def test_mixing_stage(stages):
    before, after = Counter(ids(stages[3])), Counter(ids(stages[4]))
    assert set(after) <= set(before) and max(before.values()) == 1
    sizes = {i: len(t or "") for i, t in texts(stages[3]).items()}
    total = sum(sizes[i] * n for i, n in after.items())
    assert 0.6 < total / sum(sizes.values()) < 1.6


def test_token_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in stages[4].collect())
    want, start = [], 0
    for i, t in rows:
        found = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(found), zlib.crc32(found.tobytes())))
        start += len(found)
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].collect()))


def test_no_documents(spark, sf_dir, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        docs = stages[0].limit(0)
