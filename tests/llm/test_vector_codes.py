"""Vector codes against a plain search of all entries."""

import hashlib
import math

import numpy as np
import oracle
import pytest
from holdline.llm import common, queries, vector_codes

DDL = "vec_id long, embedding array<float>, label int"


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label error) of every usable row, and the books' digest."""
    rows = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if whole(v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return [], None
    width = len(rows[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    rows = [(i, cut(v), label) for i, v, label in rows]
    books = [[v[p] for _, v, _ in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near():
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in rows]

    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for (_, v, _), f in zip(rows, found) if f[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    errors, out = {}, []
    for (i, _, label), f in zip(rows, near()):
        error = sum(d for d, _ in f)
        errors[label] = errors.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in f), error, label))
    told = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, e, errors[label]) for i, c, e, label in out], hashlib.sha256(told.encode()).hexdigest()


def run(spark, rows, ddl=DDL, **options):
    got, books = vector_codes.compressed(spark.createDataFrame(rows, ddl).repartition(3), **options)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=str), books.sha256()


def test_op11(spark, sf_dir):
    got = queries.op11_vector_codes(spark, sf_dir)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    table = common.table(spark, sf_dir, "embeddings").collect()
    want, digest = brute([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    assert sorted(map(tuple, got.collect())) == sorted((*w, digest) for w in want)
    assert oracle.spark_rows(got) == oracle.sql_rows(oracle.connect(sf_dir), queries.ORACLES["op11_vector_codes"])


@pytest.mark.parametrize("spread", [0.001, 0.05, 3.0])
def test_search_is_exact(spread):
    rng = np.random.default_rng(7)
    entries = np.floor(256 * spread * rng.standard_normal((64, 4))).astype(np.int64)
    entries[40] = entries[3]  # equal entries: the lower index
    parts = np.floor(256 * spread * rng.standard_normal((500, 4)) * rng.choice((0.1, 1, 30), (500, 1))).astype(np.int64)
    parts = np.vstack([parts, entries])
    k, d = vector_codes.SlicedBook(entries.tolist()).nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (k == every.argmin(1)).all() and (d == every.min(1)).all()


def floats(rows):
    return [(i, np.float32(v), label) for i, v, label in rows]


def odd_rows(n=90, dim=32):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((n, dim)) * rng.choice((0.1, 1, 5), (n, 1))).round(2)
    rows = [(i * 3, [float(x) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(vectors)]
    rows += [rows[5], rows[5], (6, rows[9][1], 1), (None, rows[8][1], 2), (1000, [0.0] * dim, None), (1001, [-1e-9] * dim, None)]
    return rows


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = odd_rows()
    bad = [(1, None, 1), (2, [None] * 32, 1), (4, [math.nan] * 32, None), (5, [math.inf, *[0.0] * 31], 1), (7, [], 1), (8, [1.0] * 16, 1)]
    want, digest = brute(floats(rows))
    got, told = run(spark, rows + bad)
    assert told == digest and got == sorted(want, key=str)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = odd_rows()[:5]
    want, digest = brute(floats(rows))
    got, told = run(spark, rows)
    assert told == digest and got == sorted(want, key=str)
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 2), (2, [], 2)])[0] == []


def test_other_types_and_clashing_columns(spark):
    rows = odd_rows()
    named = [(i, [float(x) for x in v], str(label), 1, 2, "v", 3) for i, v, label in rows if i is not None]
    df = spark.createDataFrame(named, "vec_id int, embedding array<double>, label string, id int, error int, vector string, of_label int")
    got, _ = vector_codes.compressed(df)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    want, _ = brute([(i, v, str(label)) for i, v, label in rows if i is not None])
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got.collect()) == sorted(want)


def test_one_label_and_one_vector_hold_most_rows(spark):
    rng = np.random.default_rng(4)
    same = [float(x) for x in rng.standard_normal(16).round(3)]
    rows = [(i, same if i % 3 else [float(x) for x in rng.standard_normal(16).round(3)], 7) for i in range(400)]
    want, digest = brute([(i, np.float32(v), label) for i, v, label in rows])
    got, told = run(spark, rows)
    assert told == digest and got == sorted(want, key=str)
