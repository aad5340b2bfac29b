"""The n-gram Jaccard join and connected components against brute force."""

import random

import numpy as np
import pytest
from helpers import groups, shingles, similar_pairs
from holdline.llm import components, jaccard, queries
from holdline.llm.shingles import shingle_set
from pyspark.sql import functions as F


def check(rows, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    want = groups(sets, similar_pairs(sets))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {
        i: (len(s), want[i]) for i, s in sets.items()
    }


def test_op10(spark, sf_dir, texts):
    rows = queries.op10_jaccard_join(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def families(seed, n=160):
    """Groups of near copies, of many degrees, and documents that share a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((6, 12, 30, 80, 200)))] for _ in range(8)]
    bases.append(passage)
    docs = {}
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            place = rng.randrange(len(words))
            rng.choice((words.insert, lambda p, w: words.__setitem__(p, w)))(place, rng.choice(vocabulary))
        if rng.random() < 0.3:
            words += passage
        docs[i] = " ".join(words)
    return docs


@pytest.mark.parametrize("frequent", [-1, 3, 256])
def test_rare_and_frequent_classes(spark, monkeypatch, frequent):
    """All tokens frequent, most of them, and none."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "DEVIATIONS", 0)
    docs = families(frequent)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(jaccard.similar_documents(df).collect(), docs)


def test_long_lists_of_rare_tokens(spark, monkeypatch):
    """Compared in blocks, of a few rows here; tables of twelve tasks merged two at a time."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard, "_BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "_FAN", 2)
    docs = families(11)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(12)
    check(jaccard.similar_documents(df).collect(), docs)


def test_similar_sets_meet_in_a_key():
    """The argument about prefixes, on random pairs at and around the threshold."""
    rng = np.random.default_rng(3)
    for trial in range(1500):
        n, m = rng.integers(1, 60, 2)
        both = int(rng.integers(0, min(n, m) + 1))
        union = rng.choice(10_000, n + m - both, replace=False).astype(np.uint64) << np.uint64(44)
        x, y = np.sort(union[:n]), np.sort(union[n - both :])
        if 100 * both < 75 * (n + m - both) or both == n == m:
            continue
        counts = rng.integers(0, 20, jaccard.COUNTERS)
        x, y = sorted((x, y), key=len)
        rare, rare_short, pairs, pairs_short = jaccard.index_keys(x, counts, 9, 75)
        other = jaccard.index_keys(y, counts, 9, 75)
        assert set(rare[:rare_short]) & set(other[0]) or set(pairs[:pairs_short]) & set(other[2]), trial


def test_bound_is_one():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[: len(a) // 2 + 1], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        most, may_link = jaccard.most_similar(jaccard.buckets(a), jaccard.buckets(b), 75)
        assert most >= true - 1e-12 and may_link >= (true >= 0.75)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (6, "one two three"),
        (None, "one two"), (8, "a b c d e"), (9, "A B C D E"), (10, "x " * 50_000), (11, "x " * 60_000), (12, "É b c d e"),
        (13, "é b c d e"),
    ]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, id string, n int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == sorted(
        [
            (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, None), (8, 1, 8),
            (9, 1, 8), (10, 1, 10), (11, 1, 10), (12, 1, 12), (13, 1, 13),
        ],
        key=str,
    )
    assert jaccard.similar_documents(df.limit(0)).count() == 0
    kept = jaccard.without_near_copies(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 6, None, 8, 10, 12, 13], key=str)


def test_texts_of_a_repeated_id_are_nodes_of_their_own(spark):
    near, clean, other, blank = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    rows = [(5, near), (7, near + " z"), (7, clean), (8, clean + " z"), (9, other), (9, other + " z"), (9, other), (10, " "), (10, blank), (None, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.withColumns({"own": F.lit(1), "OWN_": F.lit(2), "id": F.lit("x")})
    assert {tuple(r)[2:] for r in jaccard.without_near_copies(marked).collect()} == {(1, 2, "x")}
    got = sorted((tuple(r) for r in jaccard.similar_documents(docs).collect()), key=str)
    want = [(5, 36, 5), (7, 37, 5), (7, 36, 7), (8, 37, 7), (9, 36, 9), (9, 37, 9), (9, 36, 9), (10, 0, 10), (10, 36, 10), (None, 36, None)]
    assert got == sorted(want, key=str)
    kept = sorted((tuple(r) for r in jaccard.without_near_copies(docs).collect()), key=str)
    one = [r for r in kept if r[0] == 9]
    assert len(one) == 1 and one[0] in rows
    assert [r for r in kept if r[0] != 9] == sorted([(5, near), (7, clean), (10, " "), (10, blank), (None, near)], key=str)


def test_refused_thresholds(spark):
    with pytest.raises(ValueError):
        jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string"), percent=60)


def test_shingle_sets_agree():
    for text in (None, "", "a", "A b c d", "a b c d e a b c d e a", "x y z w v u"):
        assert len(shingle_set(None if text is None else text.encode())) == len(shingles(text))


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(30, i) for i in range(60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [(3, 3), (None, 4), (5, None)],
    }[kind]
    got = components.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = groups({x for e in real for x in e}, real)
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)
