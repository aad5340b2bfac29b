"""Logs rebuilt from some days on against logs rebuilt as a whole."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from holdline.functions.scalars import crc8_word
from holdline.operators.recalibrate import Job, Smoothing, Tables, recalibrate
from holdline.functions.scalars import trunc_int
from holdline.operators import calibrate, history
from holdline.session import MAX_ROWS_CONF
from holdline.sources.logs import read_log

DAY = 86_400
FIRST = date(2024, 1, 1)
SEC0 = 19_723 * DAY


def archive(spark, seed, days=12, keys=3):
    """Words of a wandering temperature, close in time around midnight."""
    rng = random.Random(seed)
    rows, n = [], 0
    for k in range(keys):
        t = 26_000
        for d in range(days):
            if k == 2 and d in (3, 4):
                continue  # no samples on some days
            secs = sorted(rng.sample(range(0, DAY - 1, 60), 12)) + [DAY - 1] * rng.choice([0, 1, 4])
            for s in secs:
                t += rng.randint(-9, 9)
                rows.append((n, k, SEC0 + d * DAY + s, 118 if s == DAY - 1 else 0, t >> 8, t & 255, 90, rng.choice([7, 9]), rng.random() < 0.1))
                n += 1
    df = spark.createDataFrame(rows, "seq long, sensor_key long, sec long, cs int, b0 int, b1 int, b3 int, b4 int, broken boolean")
    crc = crc8_word("b0", "b1")
    df = df.withColumns({"b2": F.when(F.col("broken"), crc.bitwiseXOR(F.lit(1))).otherwise(crc), "b5": crc8_word("b3", "b4")})
    day = F.date_add(F.lit(FIRST), F.expr(f"int((sec - {SEC0}) div {DAY})"))
    # Columns named like those of the state are the samples' own.
    return df.withColumnRenamed("broken", "ok").withColumn("day", day).cache()


def decode(offset=0, days=()):
    def run(raw):
        rows = calibrate.sht31(raw)
        moved = F.when(F.col("day").isin([FIRST + timedelta(days=d) for d in days]), offset).otherwise(0)
        return rows.withColumn("temp", F.expr("temp div 8") + moved)

    return run


def rows_of(tables, name):
    df = tables.read(name)
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("seed,warmup", [(2, 7)])
def test_some_days_again_equals_all_again(spark, tmp_path, seed, warmup):
    raw = archive(spark, seed)
    right = Job("sht31", decode(), "seq", warmup=warmup)
    wrong = Job("sht31", decode(50, [2, 3]), "seq", warmup=warmup)
    recalibrate(raw, str(tmp_path / "all"), right)
    recalibrate(raw, str(tmp_path / "some"), wrong)
    want, got = (Tables(spark, str(tmp_path / n), right, raw) for n in ("all", "some"))
    assert rows_of(want, "log") != rows_of(got, "log")
    done = recalibrate(raw, str(tmp_path / "some"), right, [FIRST + timedelta(days=d) for d in (2, 3)])
    for name in ("log", "quarantine", "state"):
        assert rows_of(want, name) == rows_of(got, name)
    # The days before stay, and so do those behind the one on which all agree again.
    assert done[0] == FIRST + timedelta(days=2) and len(done) < 10
    stamps = [(r.sensor_key, r.sec, r.cs) for r in read_log(spark, str(tmp_path / "all" / "log"), "sht31").collect()]
    assert len(stamps) == len(set(stamps)) > 50


def test_only_touched_days_are_written(spark, tmp_path):
    raw = archive(spark, 3)
    job = Job("sht31", decode(), "seq")
    recalibrate(raw, str(tmp_path), job)
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/day=*/part-*")}
    before = files()
    done = recalibrate(raw, str(tmp_path), job, [FIRST + timedelta(days=4)])
    assert done == [FIRST + timedelta(days=4)]  # nothing differs behind it
    kept = {p for p, t in files().items() if before.get(p) == t}
    assert {p.parent.name for p in before if p not in kept} == {"day=2024-01-05"}


def test_a_day_that_loses_its_rows(spark, tmp_path):
    """A day whose bad samples have been mended has no quarantine left, and a sensor whose
    day is gone from the archive no longer changes its later days."""
    raw = archive(spark, 4)
    job = Job("sht31", decode(), "seq")
    recalibrate(raw, str(tmp_path / "some"), job)
    mended = raw.withColumn("b2", F.when(F.col("day") == F.lit(FIRST), crc8_word("b0", "b1")).otherwise(F.col("b2")))
    mended = mended.filter(~((F.col("sensor_key") == 1) & (F.col("day") == F.lit(FIRST))))
    recalibrate(mended, str(tmp_path / "some"), job, [FIRST])
    recalibrate(mended, str(tmp_path / "all"), job)
    want, got = (Tables(spark, str(tmp_path / n), job, raw) for n in ("all", "some"))
    for name in ("log", "quarantine", "state"):
        assert rows_of(want, name) == rows_of(got, name)
    assert got.read("quarantine").filter(F.col("day") == F.lit(FIRST)).count() == 0


def test_no_samples(spark, tmp_path):
    raw = archive(spark, 5).filter("false")
    assert recalibrate(raw, str(tmp_path), Job("sht31", decode(), "seq")) == []


def smoothing_job(alpha, warmup=5, offset=0, days=()):
    def run(raw):
        value = F.expr("(b0 * 256 + b1 - 26000) * 40")
        moved = F.when(F.col("day").isin([FIRST + timedelta(days=d) for d in days]), offset).otherwise(0)
        judged = raw.withColumn("reason", F.when(F.col("ok"), "missing"))
        return judged.withColumn("value", F.when(F.col("reason").isNull(), value + moved))

    return Job("max11201b", run, "seq", smooth=Smoothing("value", alpha, {"flux": trunc_int}, warmup))


def smoothed_by_rows(raw, alpha, warmup):
    """Changes of the held value sample by sample, with failures between them: rows of
    (sensor, value or None), in order."""
    out = []
    for k in range(3):
        rows = raw.filter(F.col("sensor_key") == k).orderBy("sec", "cs", "seq").collect()
        y, n, mem, up, failed, logged = 0.0, 0, 0, False, None, False
        for r in rows:
            if r.ok:
                if logged and failed is False:
                    out.append((k, None))
                failed = True
                continue
            y, n = alpha * y + (1 - alpha) * ((r.b0 * 256 + r.b1 - 26_000) * 40), n + 1
            old = mem
            if n > warmup:
                x = int(y)
                if (x > mem) if up else (x < mem):
                    mem = x
                elif (x < mem - 1) if up else (x > mem + 1):
                    mem, up = x, not up
            stored = lambda v: int(v / 4)
            if stored(mem) != stored(old) or (logged and failed):
                out.append((k, stored(mem)))
                logged = True
            failed = False
    return out


@pytest.mark.parametrize("alpha,limit", [(0.9, None), (0.001, None), (0.3, "90")])
def test_smoothing_goes_on_from_the_state(spark, tmp_path, alpha, limit):
    """Days again give the same to the last bit: blocks longer than a day, shorter ones, and
    more of them than the state keeps; the last with keys that are cut in chunks."""
    raw = archive(spark, 6, days=14, keys=2).filter("sec % 86400 < 86399")
    right = smoothing_job(alpha)
    if limit:
        spark.conf.set(MAX_ROWS_CONF, limit)
    try:
        recalibrate(raw, str(tmp_path / "all"), right)
        recalibrate(raw, str(tmp_path / "some"), smoothing_job(alpha, 5, 900, [11]))
        want, got = (Tables(spark, str(tmp_path / n), right, raw) for n in ("all", "some"))
        assert rows_of(want, "log") != rows_of(got, "log")
        recalibrate(raw, str(tmp_path / "some"), right, [FIRST + timedelta(days=11)])
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
    for name in ("log", "quarantine", "state"):
        assert rows_of(want, name) == rows_of(got, name)
    log = want.read("log").orderBy("sensor_key", "sec", "cs").collect()
    assert [(r.sensor_key, r.flux) for r in log] == smoothed_by_rows(raw, alpha, 5)
    assert want.read("state").agg(F.max(F.size("smooth_tail"))).first()[0] <= 128


def test_smoothing_before_any_sample(spark, tmp_path):
    """A first day of failures only, then samples: the state holds no sample, the log none
    of the failures."""
    raw = archive(spark, 7, days=3)
    raw = raw.withColumn("ok", F.col("ok") | (F.col("day") == F.lit(FIRST)))
    job = smoothing_job(0.3)
    recalibrate(raw, str(tmp_path / "all"), job)
    for d in range(3):
        recalibrate(raw, str(tmp_path / "some"), job, [FIRST + timedelta(days=d)])
    want, got = (Tables(spark, str(tmp_path / n), job, raw) for n in ("all", "some"))
    for name in ("log", "quarantine", "state"):
        assert rows_of(want, name) == rows_of(got, name)
    assert want.read("log").filter(F.col("day") == F.lit(FIRST)).isEmpty()


def test_keys_are_counted_without_decoding(spark, tmp_path, monkeypatch):
    """What is decoded may cost shuffles, so it is worked out once, not for the counts too."""
    raw = archive(spark, 8, days=2)
    tried, of = [], history.History.of.__func__

    def counting(cls, df, key, order, counted=None):
        tried.append(df.columns if counted is None else counted.columns)
        return of(cls, df, key, order, counted)

    monkeypatch.setattr(history.History, "of", classmethod(counting))
    recalibrate(raw, str(tmp_path / "all"), Job("sht31", decode(), "seq"))
    assert tried[0] == ["sensor_key"]
