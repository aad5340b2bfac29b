"""Streams against their batch operators; late rows, reruns and timers."""

import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holdline.operators import changelog, scan
from holdline.streaming import live, liveness
from holdline.streaming.keyed import read_stream
from holdline.streaming.snapshots import versions

NOW = {"availableNow": True}
KEY, ORDER = ["k"], ["t", "seq"]
SCHEMA = "k int, t long, seq long, x long, y long"


def rows(seed, n=400, step=4):
    rng = random.Random(seed)
    x = y = 0
    out = []
    for i in range(n):
        x, y = x + rng.randint(-step, step), y + rng.randint(-1, 1)
        out.append((rng.randint(0, 5), i // 3, i, x, y))
    return out


def feed(spark, tmp_path, data, cuts, make, schema=SCHEMA, name="job"):
    """Run the stream once per slice of ``data``; what it wrote."""
    source, job = str(tmp_path / f"{name}-in"), str(tmp_path / name)
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        spark.createDataFrame(data[a:b], schema).write.mode("append").parquet(source)
        run(make(read_stream(spark, source, schema)), job)
    return spark.read.parquet(f"{job}/out")


def run(stream, job):
    query = stream.writeStream.format("parquet").option("path", f"{job}/out")
    query = query.option("checkpointLocation", f"{job}/checkpoint").trigger(**NOW).start()
    query.awaitTermination()
    return query


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def taken(df):
    return df.filter("NOT late").drop("late")


@pytest.mark.parametrize("seed", [1, 2])
def test_hysteresis(spark, tmp_path, seed):
    data = rows(seed, n=300, step=2 + 5 * seed)
    data = [(k, t, s, None if s % 17 == 0 else x, y) for k, t, s, x, y in data]
    out = feed(spark, tmp_path, data, [1, 40, 43, 200], lambda s: live.stream_hysteresis(s, KEY, ORDER, ["x", "y"]))
    same(taken(out), scan.compound_record(spark.createDataFrame(data, SCHEMA), KEY, ORDER, ["x", "y"]))


def test_changes(spark, tmp_path):
    data = [(k, t, s, x // 6, None if y % 5 == 0 else y // 3) for k, t, s, x, y in rows(3)]
    out = feed(spark, tmp_path, data, [10, 200], lambda s: live.stream_changes(s, KEY, ORDER, ["x", "y"]))
    same(taken(out), changelog.change_only(spark.createDataFrame(data, SCHEMA), KEY, ["x", "y"], order=ORDER))


@pytest.mark.parametrize("cuts", [[], [2]])
def test_values_of_all_types_pass_the_state(spark, tmp_path, cuts):
    """Also whole numbers beyond those of doubles beside missing ones, and keys with NULL."""
    big, at = 2**60 + 1, datetime(2024, 5, 6, 7, 8, 9, 123456)
    schema = "k int, name string, t long, seq long, n long, ok boolean, x double, d decimal(9,2), at timestamp_ntz, day date"
    data = [
        (1, "a", 1, 0, big, True, 0.1, Decimal("1.25"), at, at.date()),
        (1, "a", 2, 1, None, None, None, None, None, None),
        (1, "a", 3, 2, None, None, None, None, None, None),
        (1, "a", 4, 3, big + 1, False, -0.5, Decimal("-2.50"), at, at.date()),
        (None, None, 5, 4, big, None, None, None, None, None),
        (None, "a", 6, 5, None, True, None, None, None, None),
    ]
    cols = ["n", "ok", "x", "d", "at", "day"]
    make = lambda s: live.stream_changes(s, ["k", "name"], ORDER, cols)
    out = feed(spark, tmp_path, data, cuts, make, schema)
    got = sorted((tuple(r) for r in taken(out).select("k", "name", *ORDER, *cols).collect()), key=lambda r: r[3])
    assert got == [data[i] for i in (0, 1, 3, 4, 5)]


def test_a_row_goes_through_the_state_as_one_column(spark, tmp_path):
    """The engine's cost per key is a multiple of the columns, which are many for frames."""
    source = str(tmp_path / "in")
    spark.createDataFrame(rows(1, n=9), SCHEMA).write.parquet(source)
    stream = read_stream(spark, source, SCHEMA)
    for made in (live.stream_hysteresis(stream, KEY, ORDER, ["x", "y"]), live.stream_ordered(stream, KEY, ORDER, 10)):
        plan = made._jdf.queryExecution().analyzed().toString()
        state = next(line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line)
        assert re.findall(r"__\w+", state.split("run(")[1].split(")")[0]) == ["__key0", "__row"]


@pytest.mark.parametrize("seed", ["zero", "first"])
def test_ema(spark, tmp_path, seed):
    data = rows(7, n=200)
    out = feed(spark, tmp_path, data, [30, 90], lambda s: live.stream_ema(s, KEY, ORDER, "x", 0.9, seed))
    batch = scan.ema(spark.createDataFrame(data, SCHEMA), KEY, ORDER, "x", 0.9, seed)
    values = lambda df: {r.seq: r.ema for r in df.collect()}
    assert values(taken(out)) == pytest.approx(values(batch))


def test_rows_of_the_past_are_told_apart(spark, tmp_path):
    data = rows(4, n=90)
    moved = data[:30] + data[60:] + data[30:60]
    out = feed(spark, tmp_path, moved, [30, 60], lambda s: live.stream_changes(s.withColumn("z", F.col("seq")), KEY, ORDER, ["z"]))
    late = {r.seq for r in out.filter("late").collect()}
    last = {}
    for r in data[:30] + data[60:]:
        last[r[0]] = max(last.get(r[0], -1), r[2])
    assert late == {r[2] for r in data[30:60] if last.get(r[0], -1) >= r[2]}
    assert out.count() == len(data)


@pytest.mark.parametrize("cuts", [[], [40], [10, 11, 12, 40, 77]])
def test_rows_are_put_in_order(spark, tmp_path, cuts):
    rng = random.Random(8)
    data = sorted(rows(8, n=120), key=lambda r: r[1] + rng.randint(0, 9))  # up to ten late
    out = feed(spark, tmp_path, data, cuts, lambda s: live.stream_ordered(s, KEY, ORDER, 10))
    newest = {}
    for r in data:
        newest[r[0]] = max(newest.get(r[0], 0), r[1])
    want = {}
    for r in sorted(data, key=lambda r: r[:3]):
        if r[1] <= newest[r[0]] - 10:
            want.setdefault(r[0], []).append(r)
    got = sorted(tuple(r) for r in out.filter("NOT late").select("k", "place", "t", "seq", "x", "y").collect())
    assert got == sorted((k, i, *r[1:]) for k, rs in want.items() for i, r in enumerate(rs, 1))
    assert out.filter("late").count() == 0


def test_rows_beyond_the_lateness_come_aside(spark, tmp_path):
    data = [(1, 100, 0, 1, 1), (1, 95, 1, 2, 2), (1, 89, 2, 3, 3), (1, 90, 3, 4, 4), (2, 5, 4, 5, 5), (1, 200, 5, 6, 6)]
    out = feed(spark, tmp_path, data, [1, 4], lambda s: live.stream_ordered(s, KEY, ORDER, 10))
    assert sorted(r.seq for r in out.filter("late").collect()) == [2, 3]
    assert [r.seq for r in out.filter("NOT late").orderBy("k", "place").collect()] == [1, 0]


def test_a_trigger_reads_the_state_of_its_own_keys(spark, tmp_path):
    """The engine updates one row of state when one key is active, however many are idle."""
    many = [(k, 1, k, 5, 5) for k in range(300)]
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    updated = []
    for part in (many, [(7, 2, 900, 6, 6)]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        query = run(live.stream_hysteresis(read_stream(spark, source, SCHEMA), KEY, ORDER, ["x"]), job)
        # A last batch without rows may follow.
        states = [p["stateOperators"][0] for p in map(dict, query.recentProgress) if p["numInputRows"]]
        updated.append((states[-1]["numRowsUpdated"], states[-1]["numRowsTotal"]))
    assert updated == [(300, 300), (1, 300)]


def test_a_rerun_batch_gives_the_same(spark, tmp_path):
    """As after a failure between writing the output and committing the batch."""
    data = rows(5, n=120)
    make = lambda s: live.stream_ema(s, KEY, ORDER, "x", 0.9)
    out = feed(spark, tmp_path, data, [50], make)
    before = sorted(map(tuple, out.select("seq", "ema").collect()))
    commits = tmp_path / "job" / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    run(make(read_stream(spark, str(tmp_path / "job-in"), SCHEMA)), str(tmp_path / "job"))
    again = spark.read.parquet(str(tmp_path / "job" / "out"))
    assert sorted(map(tuple, again.select("seq", "ema").collect())) == before


def test_presence_equals_the_batch_log(spark, tmp_path):
    rng = random.Random(9)
    schema = "site long, sensor_id long, day long, sec long, cs long, temp long"
    readings, scans = [], []
    for site in (1, 2):
        live_now = set()
        for day in range(12):
            for k in range(4):
                if rng.random() < 0.4:
                    live_now ^= {k}
            readings += [(site, 4 * site + k, day, 100 * day + k, 0, rng.randint(0, 1)) for k in sorted(live_now)]
            scans.append((site, None, day, 100 * day + 99, 0, None))
    both = sorted([*readings, *scans], key=lambda r: (r[2], r[1] is None, rng.random()))
    out = feed(spark, tmp_path, both, [5, 17, 30], lambda s: live.stream_presence(s, "site", "sensor_id", "day", ["sec", "cs"], "temp"), schema)
    batch = changelog.presence_log(
        spark.createDataFrame(readings, schema), spark.createDataFrame(scans, schema).drop("sensor_id", "temp"),
        "site", "sensor_id", "day", ["temp"],
    )
    same(out, batch)


def test_snapshot(spark, tmp_path):
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "k int, sec long, cs int, v int"
    for part in ([(1, 5, 0, 10), (2, 5, 0, 20)], [(1, 6, 0, None), (2, 4, 0, 99)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        live.stream_snapshot(read_stream(spark, source, schema), job, ["k"], ["v"], **NOW).awaitTermination()
    last = versions(spark, f"{job}/out")[-1]
    got = sorted(map(tuple, spark.read.parquet(f"{job}/out/batch={last}").select("k", "sec", "v").collect()))
    assert got == [(1, 6, None), (2, 5, 20)]


def test_heartbeat_table(spark, tmp_path):
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "sensor_name string, sec long, seq long"
    for part in ([("a", 9, 1), ("b", 1, 2)], [("a", 7, 3)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        live.stream_heartbeats(read_stream(spark, source, schema), job, **NOW).awaitTermination()
    last = versions(spark, f"{job}/out")[-1]
    got = sorted(map(tuple, spark.read.parquet(f"{job}/out/batch={last}").collect()))
    assert got == [("a", 7), ("b", 1)]


def test_timers_over_several_runs(spark, tmp_path):
    rng = random.Random(6)
    data, secs = [], {k: 0 for k in range(6)}
    for _ in range(200):
        k = rng.randint(0, 5)
        secs[k] += rng.choice([1, 1, 2, 4, 9, 30])
        data.append((k, secs[k], rng.random() < 0.1))
    data.sort(key=lambda r: r[1])
    data = [r for r in data if r[1] <= min(secs.values())] + [(9, 10_000, True)]
    schema = "sensor_key long, sec long, recorded boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Cuts within a second, one of them between its record and its other samples.
    cuts = [i for i in range(1, len(data)) if data[i][1] == data[i - 1][1]]
    cuts = sorted({cuts[len(cuts) // 4], cuts[len(cuts) // 2], cuts[-len(cuts) // 4]})
    for part in (data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        events = liveness.stream_liveness(read_stream(spark, source, schema))
        events.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(**NOW).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = []
    for k in {r[0] for r in data} - {9}:
        mine = {}
        for _, s, r in filter(lambda r: r[0] == k, data):
            mine[s] = mine.get(s, False) or r
        events, *state = liveness.step(sorted(mine.items()), None, None, 0)
        events += liveness.silence(10_000, state[1], state[2])
        want += [(k, e, s) for e, s in events]
    assert got == sorted(want)


def test_a_second_split_by_a_micro_batch(spark, tmp_path):
    """The record of a second that comes a batch later still counts for it."""
    data = [(1, 100, True), (1, 110, False), (2, 110, False), (1, 110, True), (1, 116, False), (2, 112, True), (3, 500, False)]
    schema = "sensor_key long, sec long, recorded boolean"
    results_of = []
    for name, cuts in (("one", []), ("two", [3]), ("each", [1, 2, 3, 4, 5, 6])):
        source, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            spark.createDataFrame(data[a:b], schema).write.mode("append").parquet(source)
            # Sensor 2 lags four seconds behind sensor 1.
            events = liveness.stream_liveness(read_stream(spark, source, schema), lateness=6)
            events.writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(**NOW).start().awaitTermination()
        results_of.append(sorted(map(tuple, spark.read.parquet(out).collect())))
    assert results_of[0] == results_of[1] == results_of[2]
    assert [e for e in results_of[0] if e[1] == "heartbeat"] == [(1, "heartbeat", 116)]


def test_a_sensor_behind_the_others_keeps_its_samples(spark, tmp_path):
    """Rows older than the newest of another sensor count; those older than what has
    counted of their own are given as late."""
    ahead = [(1, s, True) for s in (490, 495, 500)]
    behind = [(2, 100, True), (2, 104, False), (2, 110, False), (2, 130, False)]
    data = ahead + behind + [(3, 600, True)] + [(1, 480, True), (1, 481, False), (3, 700, True)]
    schema = "sensor_key long, sec long, recorded boolean"
    results_of = []
    for name, cuts in (("one", [8]), ("two", [3, 8]), ("each", [3, 4, 5, 6, 7, 8])):
        source, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            spark.createDataFrame(data[a:b], schema).write.mode("append").parquet(source)
            events = liveness.stream_liveness(read_stream(spark, source, schema))
            events.writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(**NOW).start().awaitTermination()
        results_of.append(sorted(map(tuple, spark.read.parquet(out).collect())))
    assert results_of[0] == results_of[1] == results_of[2]
    of = {k: sorted((e, s) for key, e, s in results_of[0] if key == k) for k in (1, 2)}
    assert of[1] == [("dead", 500), ("late", 481), ("late_record", 480), ("stalled", 500)]
    silent = [(e, s) for e, ends in (("dead", (104, 110, 130)), ("stalled", (110, 130))) for s in ends]
    assert of[2] == sorted([*silent, ("heartbeat", 110), ("heartbeat", 130)])


def test_routing_is_stateless(spark):
    stream = spark.readStream.format("rate").load().select(
        F.lit("hb/x").alias("topic"), F.col("value").cast("string").alias("payload"))
    assert live.stream_route(stream, "topic", "payload").isStreaming
