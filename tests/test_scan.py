"""Windowed recurrences against their step-by-step definition."""

import random

import pytest
from pyspark.sql import functions as F

from holdline.operators import scan
from holdline.operators.history import History
from holdline.session import MAX_ROWS_CONF


def held(xs):
    """The held value, one sample at a time: start at 0, falling."""
    mem, up, out = 0, False, []
    for x in xs:
        old = mem
        moved = x - mem if up else mem - x
        if moved > 0 or moved < -1:
            up = up if moved > 0 else not up
            mem = x
        out.append((mem, int(old / 4) != int(mem / 4)))
    return out


def slots(ticks, limit):
    used, out = set(), []
    for t in ticks:
        free = next((s for s in range(t, t + limit) if s not in used), None)
        out.append(free)
        used.add(free)
    return out


def series(n, seed, draw):
    rng = random.Random(seed)
    return {k: [draw(rng, k) for _ in range(rng.randint(1, n))] for k in range(30)}


def frame(spark, data):
    return spark.createDataFrame(
        [(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)], "k int, i int, x int"
    )


def test_hysteresis(spark, split):
    data = series(60, 1, lambda r, k: r.randint(-3, 3) if k % 2 else r.randint(-30, 30))
    got = scan.hysteresis(frame(spark, data), ["k"], ["i"], "x").collect()
    assert len(got) == sum(map(len, data.values()))
    want = {k: held(xs) for k, xs in data.items()}
    for r in got:
        assert (r.x_mem, r.x_emit) == want[r.k][r.i]


def test_hysteresis_vector(spark):
    data = {0: [1, 2, 1, 0, 9]}
    got = scan.hysteresis(frame(spark, data), ["k"], ["i"], "x").orderBy("i").collect()
    assert [r.x_mem for r in got] == [0, 2, 2, 0, 9]
    assert [r.x_emit for r in got] == [False, False, False, False, True]


def test_compound_record(spark, split):
    a = series(40, 2, lambda r, k: r.randint(-9, 9))
    b = {k: [random.Random(k * 100 + i).randint(-9, 9) for i in range(len(xs))] for k, xs in a.items()}
    df = spark.createDataFrame(
        [(k, i, x, y) for k in a for i, (x, y) in enumerate(zip(a[k], b[k]))], "k int, i int, x int, y int"
    )
    got = {(r.k, r.i): (r.x, r.y) for r in scan.compound_record(df, ["k"], ["i"], ["x", "y"]).collect()}
    want = {}
    for k in a:
        for i, (p, q) in enumerate(zip(held(a[k]), held(b[k]))):
            if p[1] or q[1]:
                want[k, i] = (int(p[0] / 4), int(q[0] / 4))
    assert got == want


@pytest.mark.parametrize("limit", [1, 2, 20])
def test_uniquify(spark, split, limit):
    data = {k: sorted(xs) for k, xs in series(80, 3, lambda r, k: r.randint(0, 8 + 4 * k)).items()}
    got = {(r.k, r.i): r.slot for r in scan.uniquify(frame(spark, data), ["k"], "x", ["i"], limit).collect()}
    want = {}
    for k, xs in data.items():
        for i, s in enumerate(slots(xs, limit)):
            if s is not None:
                want[k, i] = s
    assert got == want


@pytest.mark.parametrize("alpha,seed", [(0.98, "zero"), (0.8, "first"), (0.1, "zero"), (0.5, "first")])
def test_ema(spark, split, alpha, seed):
    data = series(300, 4, lambda r, k: r.randint(-1000, 1000))
    got = scan.ema(frame(spark, data), ["k"], ["i"], "x", alpha, seed).collect()
    assert len(got) == sum(map(len, data.values()))
    want = {}
    for k, xs in data.items():
        y = 0.0 if seed == "zero" else float(xs[0])
        for i, x in enumerate(xs):
            y = alpha * y + (1 - alpha) * x
            want[k, i] = y
    for r in got:
        assert r.ema == pytest.approx(want[r.k, r.i], abs=1e-9)


def test_ema_long(spark, split):
    rng = random.Random(5)
    xs = [rng.randint(-8_000_000, 8_000_000) for _ in range(3000)]
    got = {r.i: r.ema for r in scan.ema(frame(spark, {0: xs}), ["k"], ["i"], "x", 0.98).collect()}
    y = 0.0
    for i, x in enumerate(xs):
        y = 0.98 * y + 0.02 * x
        assert got[i] == pytest.approx(y, abs=1e-6)


def test_after_warmup(spark, split):
    data = series(40, 6, lambda r, k: r.randint(0, 9))
    df = frame(spark, data).withColumn("s", F.floor(F.col("i") / 15))
    got = {(r.k, r.i) for r in scan.after_warmup(df, ["k"], "s", 3, ["i"]).collect()}
    assert got == {(k, i) for k, xs in data.items() for i in range(len(xs)) if i % 15 >= 3}


def test_history_steps(spark, split):
    data = series(40, 7, lambda r, k: r.choice([None, 1, 2, 3]))
    h = History.of(frame(spark, data), ["k"], ["i"])
    assert h.chunked == (split == "hot")
    x = F.col("x")
    h = h.previous("p", x).following("f", x).carry("c", x).carry("b", x, inclusive=False)
    h = h.running_max("m", x, inclusive=False).running_sum("s", x).number("n")
    for r in h.rows().collect():
        xs = data[r.k]
        some = [v for v in xs[: r.i + 1] if v is not None]
        past = [v for v in xs[: r.i] if v is not None]
        assert r.p == (xs[r.i - 1] if r.i else None)
        assert r.f == (xs[r.i + 1] if r.i + 1 < len(xs) else None)
        assert r.c == (some[-1] if some else None)
        assert r.b == (past[-1] if past else None)
        assert r.m == (max(past) if past else None)
        assert r.s == sum(some)
        assert r.n == r.i + 1


def test_hysteresis_without_samples(spark, split):
    """A NULL leaves the held value as it was, at the start and across chunks."""
    data = series(60, 8, lambda r, k: None if r.random() < 0.4 else r.randint(-9, 9))
    got = scan.hysteresis(frame(spark, data), ["k"], ["i"], "x").collect()
    want = {k: held([x for x in xs if x is not None]) for k, xs in data.items()}
    assert len(got) == sum(map(len, data.values()))
    for r in got:
        known = sum(x is not None for x in data[r.k][: r.i + 1])
        mem, emit = want[r.k][known - 1] if known else (0, False)
        assert (r.x, r.x_mem, r.x_emit) == (data[r.k][r.i], mem, emit and data[r.k][r.i] is not None)


@pytest.mark.parametrize("seed", ["zero", "first"])
@pytest.mark.parametrize("alpha", [0.02, 0.8, 0.98])
def test_smoothing_has_the_same_bits_for_hot_keys(spark, seed, alpha):
    rng = random.Random(9)
    rows = [(k, i, rng.uniform(-1e6, 1e6)) for k in range(3) for i in range(1500 if k == 1 else 40)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    results = []
    for limit in (None, "100"):
        if limit:
            spark.conf.set(MAX_ROWS_CONF, limit)
        try:
            results.append(sorted(map(tuple, scan.ema(df, ["k"], ["i"], "x", alpha, seed).select("k", "i", "ema").collect())))
        finally:
            spark.conf.unset(MAX_ROWS_CONF)
    assert results[0] == results[1]
    y, want = {}, []
    for k, i, x in rows:
        y[k] = alpha * y.get(k, x if seed == "first" else 0.0) + (1 - alpha) * x
        want.append(y[k])
    assert all(abs(a[2] - b) <= 1e-9 * max(1, abs(b)) + 1e-6 for a, b in zip(results[0], want))
