"""The pivot-permutation index against all pairs."""

import numpy as np
import pytest
from helpers import groups
from holdline.llm import common, pivots, queries


def brute(rows, threshold=0.93):
    """n_links and component of every row of (id, vector, label)."""
    ok = {}
    for place, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None for x in v):
            x = np.array(v, float)
            if np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                ok.setdefault((label, len(x)), []).append((place, x / np.linalg.norm(x)))
    counts, edges = [0] * len(rows), []
    for members in ok.values():
        places, matrix = [p for p, _ in members], np.stack([x for _, x in members])
        linked = matrix @ matrix.T >= threshold
        np.fill_diagonal(linked, False)
        for a, b in zip(*np.nonzero(linked)):
            counts[places[a]] += 1
            edges.append((places[a], places[b]))
    reach = groups(range(len(rows)), edges)
    least = {}
    for place, root in reach.items():
        if rows[place][0] is not None:
            least[root] = min(rows[place][0], least.get(root, rows[place][0]))
    return [(i, counts[p], None if i is None else least[reach[p]], i is not None and i == least[reach[p]]) for p, (i, _, _) in enumerate(rows)]


def test_op3(spark, sf_dir):
    table = common.table(spark, sf_dir, "embeddings").collect()
    got = queries.op3_embedding_near_dedup(spark, sf_dir)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def cloud(seed, groups_of, dim=24, spread=0.03, labels=2):
    """Vectors around random centres, some groups dense, and single ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for n in groups_of:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        label = int(rng.integers(labels))
        for _ in range(n):
            v = centre + spread * rng.standard_normal(dim) * rng.choice((0.3, 1.0, 2.0))
            rows.append((len(rows), [float(x) for x in v * rng.uniform(0.1, 9)], label))
    return rows


def run(spark, rows, threshold=0.93):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(map(tuple, pivots.near_duplicates(df, threshold).collect()), key=str)


@pytest.mark.parametrize("dense, block", [(64, 1024), (8, 20)])
def test_dense_groups_cores_and_blocks(spark, monkeypatch, dense, block):
    """Recall and exactness with and without cores, in one block and in many. The two
    versions of the constants are read on the driver and, by the tasks, not at all."""
    monkeypatch.setattr(pivots, "DENSE", dense)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    rows = cloud(dense, [150, 60, 30, 5, 2, 2, *[1] * 150])
    got, want = run(spark, rows), sorted(brute(rows), key=str)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.9 * all_links and all_links > 10_000
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the threshold
    assert [g[2] for g in got] == [w[2] for w in want]


def test_cores_count_what_pairs_would():
    """Within half the linking angle of a centre, all link."""
    rng = np.random.default_rng(1)
    centre = pivots.directions(16, 1)
    x = centre + rng.standard_normal((400, 16)) * 0.06
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cores = pivots._Cores([(0, 16, centre[0])], 0.93)
    core, border = cores.place(0, x)
    inside = x[core == 0]
    assert 20 < len(inside) < 400 and (inside @ inside.T >= 0.93).all()
    outside = np.nonzero(core < 0)[0]
    reach = (x[outside] @ inside.T >= 0.93).any(axis=1)
    assert all(border[i] == [0] for i in outside[reach])


def test_diffuse_hot_group_with_many_pivots(spark, monkeypatch):
    """A third of all vectors around one centre that lies further off than half the
    linking angle, so that no core takes them, and as many pivots as a large table has."""
    monkeypatch.setattr(pivots, "LEAST_PIVOTS", 1000)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    x[:1000] = pivots.directions(64, 1) + 0.24 / 8 * x[:1000]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got, want = run(spark, rows), sorted(brute(rows), key=str)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.9 * all_links and all_links > 100_000
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0] * 3, 0), (4, [1.0, None, 2.0], 0), (5, [nan, 1.0, 1.0], 0), (6, [inf, 1.0, 1.0], 0),
        (7, v, None), (None, v, 0), (8, v, 0), (9, v, 0), (9, v, 0), (10, [2.0, 4.0, 6.0], 0), (11, v, 1), (12, [1.0, 2.0], 0),
        (13, [1e300, 2e300, 3e300], 0), (14, [1e-300, 2e-300, 3e-300], 0), (15, [-0.0, 1.0, 0.0], 0), (16, [0.0, 1.0, 0.0], 0),
        (9, [3.0, -1.0, 0.0], 0), (17, [3.0, -1.0, 0.0], 0), (18, [-1.0, -2.0, -3.0], 0),
    ]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    df = spark.createDataFrame([(1, v, 0, "x", 2)], "vec_id long, embedding array<double>, label int, content string, core int")
    assert pivots.near_duplicates(df).count() == 1 and pivots.near_duplicates(df.limit(0)).count() == 0
