"""Whitened vectors against numpy, and the exact polynomial against plain arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from holdline.llm import charpoly, common, queries, whitening

DDL = "vec_id long, embedding array<float>"


def brute(rows, most=8):
    """For each usable row: id, exact deviation, coordinates; and the shares."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    deviations = [int(sum(d * d for d in row)) for row in n * x - s]
    centred = (n * x - s).astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(most, int((e > 1e-9 * e.sum()).sum()))
    return n, kept, deviations, centred @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(got, rows, tolerance=1e-9):
    n, kept, deviations, want, shares = brute(rows)
    k = want.shape[1]
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    signs = {}
    for (i, _), d, w in zip(kept, deviations, want):
        for c in range(k):
            found = by[i, d][c + 1]
            if c not in signs and abs(w[c]) > 0.1:
                signs[c] = math.copysign(1, found[0] * w[c])
            assert any(abs(f - signs.get(c, 1) * w[c]) < tolerance or abs(w[c]) <= 0.1 and c not in signs for f in found)


def test_op13(spark, sf_dir):
    got = queries.op13_whitening(spark, sf_dir)
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    table = common.table(spark, sf_dir, "embeddings").collect()
    check(got.collect(), [(r["vec_id"], r["embedding"]) for r in table])


def whitened(spark, rows, ddl=DDL):
    return whitening.components(spark.createDataFrame(rows, ddl).repartition(3)).collect()


def cloud(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in np.float32(rng.standard_normal(dim) * np.arange(1, dim + 1))]) for i in range(n)]


def test_odd_rows(spark):
    rows = cloud(60, 12)
    bad = [(500, None), (501, [None] * 12), (502, [math.nan] * 12), (503, [math.inf] * 12), (504, []), (505, [1.0, 2.0])]
    rows += [rows[3], rows[3], (None, rows[4][1])]
    check(whitened(spark, rows + bad), rows)


def test_few_dimensions_and_few_vectors(spark):
    check(whitened(spark, cloud(40, 1)), cloud(40, 1))
    check(whitened(spark, cloud(40, 3)), cloud(40, 3))
    check(whitened(spark, cloud(4, 10)), cloud(4, 10))  # only three components vary


def test_nothing_varies_and_nothing_there(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [0.5, 2.0])]) == []
    assert whitened(spark, [(i, [0.5, 2.0]) for i in range(9)]) == []


def test_most_rows_are_one_vector(spark):
    rows = [(i, [0.25] * 6) if i % 3 else (i, v) for i, v in cloud(150, 6)]
    check(whitened(spark, rows), rows)


def test_large_and_close_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in 1e6 + rng.standard_normal(5) * (0.05, 0.05, 1, 1, 30)]) for i in range(80)]
    check(whitened(spark, rows, "vec_id long, embedding array<double>"), rows, 1e-6)


def test_clashing_columns(spark):
    rows = [(i, v, 1, "v", 2, 3.0) for i, v in cloud(20, 4)]
    ddl = "vec_id long, embedding array<float>, id int, vector string, n int, whitened double"
    check(whitened(spark, rows, ddl), cloud(20, 4))


def exact_sums(rows):
    """Faddeev-LeVerrier in fractions."""
    size = len(rows)
    a = [[Fraction(x) for x in r] for r in rows]
    m, out = [[Fraction(i == j) for j in range(size)] for i in range(size)], [1]
    for k in range(1, size + 1):
        am = [[sum(a[i][t] * m[t][j] for t in range(size)) for j in range(size)] for i in range(size)]
        c = -sum(am[i][i] for i in range(size)) / k
        m = [[am[i][j] + (c if i == j else 0) for j in range(size)] for i in range(size)]
        out.append(int(c) * (-1) ** k)
    return out


def gram(rng, size, rank, spread=50):
    x = rng.integers(-spread, spread, (rank, size)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("size,rank", [(1, 1), (2, 2), (5, 3), (9, 12), (14, 20)])
def test_polynomial(size, rank):
    rows = gram(np.random.default_rng(size), size, rank)
    sums = charpoly.combined({p: charpoly.residues(rows, p) for p in charpoly.enough_primes(rows)})
    assert sums == exact_sums(rows)


def test_hessenberg_with_zeros_on_the_way():
    rows = [[0] * 6 for _ in range(6)]
    for i in range(6):
        rows[i][i] = i + 1
    rows[0][5] = rows[5][0] = 1
    sums = charpoly.combined({p: charpoly.residues(rows, p) for p in charpoly.enough_primes(rows)})
    assert sums == exact_sums(rows)


def test_repeated_and_nearly_repeated_roots():
    rng = np.random.default_rng(3)
    v = rng.integers(-9, 10, 6).astype(object)
    square = int(v @ v)
    # A reflection times its length, so that all stays whole.
    turn = [[square * (i == j) - 2 * int(v[i] * v[j]) for j in range(6)] for i in range(6)]
    far = 10**15
    values = [7 * far, 7 * far, 5 * far + 1, 5 * far, 3, 0]
    t = np.array(turn, object)
    rows = (t @ np.diag(values).astype(object) @ t.T).tolist()
    sums = charpoly.combined({p: charpoly.residues(rows, p) for p in charpoly.enough_primes(rows)})
    roots, bits = charpoly.greatest_roots(sums, 8)
    assert [(Fraction(r, 1 << bits) / square**2).limit_denominator(1) for r, _ in roots] == [7 * far, 5 * far + 1, 5 * far, 3]
    assert [n for _, n in roots] == [2, 1, 1, 1]
    axes = np.array([a for r, n in roots for a in charpoly.null_vectors(rows, r, bits, n)])
    assert np.abs(axes @ axes.T - np.eye(5)).max() < 1e-14
    own = (t / square).astype(float)  # columns are the unit eigenvectors
    assert np.abs(axes[:2] @ own[:, 2:]).max() < 1e-14
    assert np.abs(np.abs(np.diag(axes[2:] @ own[:, 2:5])) - 1).max() < 1e-14
