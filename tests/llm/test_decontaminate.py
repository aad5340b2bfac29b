"""Benchmark passages by SimHash windows against all windows and items."""

import numpy as np
from holdline.llm import common, decontaminate, queries
from holdline.llm.decontaminate import similarity, words
from holdline.llm.shingles import shingle_numbers


def brute(docs, items):
    """The best window's similarity for every document and item that reach it."""
    numbers = {i: words(t) for i, t in items.items()}
    out = {}
    for d, text in docs.items():
        w = words(text)
        for i, item in numbers.items():
            width = min(5, len(item))
            if not len(item) or not len(w):
                continue
            s, t = shingle_numbers(w, width), shingle_numbers(item)
            n = min(len(t), len(s))
            starts = np.nonzero(np.isin(s, t))[0]
            near = {k for p in starts for k in range(max(0, p - n + 1), min(p, len(s) - n) + 1)}
            best = max((similarity(s[k : k + n], t) for k in near), default=0)
            if best >= 0.75:
                out[d, i] = best
    return out


def test_op6(spark, sf_dir, texts):
    items = {r["item_id"]: r["text"] for r in common.table(spark, sf_dir, "benchmark").collect()}
    want = brute(texts, items)
    rows = queries.op6_decontaminate(spark, sf_dir).collect()
    assert want and len(rows) == len(want)
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows} == want


def edited(rng, item, edits):
    out = list(item)
    for p in rng.choice(len(out), edits, replace=False):
        out[p] = f"other{rng.integers(1000)}"
    return out


def test_edited_passages(spark):
    rng = np.random.default_rng(6)
    items = {i: " ".join(f"t{rng.integers(5000)}" for _ in range(rng.integers(15, 60))) for i in range(60)}
    docs = {}
    for d in range(240):
        filler = [f"f{rng.integers(3000)}" for _ in range(rng.integers(0, 200))]
        passage = edited(rng, items[d % 60].split(), int(rng.integers(0, 3)))
        if d % 5 == 0:  # cut short at its end, in a document of its own
            filler, passage = [], passage[: int(len(passage) * 0.85)]
        at = int(rng.integers(0, len(filler) + 1))
        docs[d] = " ".join(filler[:at] + passage + filler[at:])
    want = brute(docs, items)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(df, bench).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want) and len(want) > 100


def test_slices_find_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"q{i} " * 2 + "is what the item asks us all") for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"So q{i}  Q{i} is what the item, asks us all? yes") for i in range(20)], "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 100)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == one and len(one) >= 12
    assert decontaminate.without_benchmark(docs, bench).count() == 8


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "What is the answer"), (3, "what is the answer"), (3, "x " * 30_000), (4, "is the")]
    docs = spark.createDataFrame([(i, t, "u", 2) for i, t in rows], "doc_id long, text string, item_id string, similarity int")
    items = [(7, "What is the answer?"), (7, "What is the answer?"), (8, None), (9, " . "), (None, "is the"), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()), key=str)
    assert got == [(3, 7), (None, 7)]
    clean = decontaminate.without_benchmark(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 3, 4]
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_benchmark(docs, bench.limit(0)).count() == 6


def test_blocks_reach_every_hash_within_the_radius():
    rng = np.random.default_rng(9)
    items = [(i, rng.integers(0, 1 << 63, 12, dtype=np.uint64)) for i in range(50)]
    size = decontaminate._Size(items)
    for value in size.hashes:
        for flips in range(decontaminate.RADIUS + 3):
            bits = np.unpackbits(value)
            bits[rng.choice(64, flips, replace=False)] ^= 1
            probe = np.packbits(bits)
            apart = np.bitwise_count(size.hashes ^ probe).sum(axis=1)
            assert size.near(probe) == np.nonzero(apart <= decontaminate.RADIUS)[0].tolist()
