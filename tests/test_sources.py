"""Stored logs, text dumps, frames, registries."""

import re

import pytest
from pyspark.sql import functions as F

from holdline.sources import frames, logs, messages, onewire, registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_round_trip_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "log")
    day = 86_400
    rows = [(k, d * day + i, i, 100 * d + i, None) for d in range(3) for k in (1, 2) for i in range(3)]
    schema = "sensor_key long, sec long, cs int, temp int, hum int"
    logs.write_log(spark.createDataFrame(rows, schema), path, "sht31")
    df = logs.read_log(spark, path, "sht31", since="1970-01-02", until="1970-01-02")
    assert df.count() == 6
    assert re.search(r"PartitionFilters: \[[^]]*day", plan(df))
    assert df.filter("sensor_key = 1").select("event_us").orderBy("event_us").first()[0] == day * 1_000_000
    # A rebuilt day replaces only itself.
    again = spark.createDataFrame([(1, day, 0, 7, 7)], schema)
    logs.write_log(again, path, "sht31", mode="overwrite")
    got = logs.read_log(spark, path, "sht31").groupBy("day").count().collect()
    assert sorted(r["count"] for r in got) == [1, 6, 6]


def test_column_pruning_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 1, 1, 1, 1)], "sensor_key long, sec long, cs int, temp int, hum int")
    logs.write_log(rows, path, "sht31")
    text = plan(logs.read_log(spark, path, "sht31").filter("temp > 5").select("sec"))
    assert "ReadSchema: struct<sec:bigint,temp:int>" in text
    assert "GreaterThan(temp,5)" in text


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    logs.export_csv(spark.createDataFrame([(1, None)], "a int, b int"), path)
    texts = sorted(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert texts[-1].splitlines() == ["a,b", "1,"]


def test_w1_dumps(spark, tmp_path):
    ok, no = "50 05 4b 46 : crc=1c YES\n50 05 4b 46 t=%d\n", "00 : crc=1c NO\n00 t=1000\n"
    for serial, text in (("28-01", ok % 21_567), ("28-02", no), ("28-03", ok % 85_000), ("28-04", ""), ("28-05", "x YES\ny\n"), ("28-06", "\n")):
        folder = tmp_path / serial
        folder.mkdir()
        (folder / "w1_slave").write_text(text)
    got = onewire.parse_w1(onewire.read_w1(spark, str(tmp_path / "*" / "w1_slave")), "text").collect()
    assert {r.serial_code: (r.temp, r.reason) for r in got} == {
        "28-01": (2156, None), "28-02": (None, "crc"), "28-03": (None, "power_on"),
        "28-04": (None, "empty"), "28-05": (None, "unreadable"), "28-06": (None, "crc"),
    }


def test_frames_there_and_back(spark):
    df = spark.createDataFrame([(1, "a", 5, True), (1, "b", None, True), (1, "c", None, False)],
                               "site int, label string, v int, found boolean")
    frame = frames.encode_frames(df, ["site"], "label", "label", "v", "found")
    assert frame.first().frame == "a,b,c!5,null,n/a"
    got = [(r.field, r.value, r.status) for r in frames.decode_frames(frame, "frame").orderBy("pos").collect()]
    assert got == [("a", 5, "ok"), ("b", None, "null"), ("c", None, "missing")]


def test_broken_frames(spark):
    df = spark.createDataFrame([("a,b!1",), ("a",), ("wlan0_level!err",), ("x!-70.",)], "frame string")
    got = [(r.field, r.value, r.status) for r in frames.decode_frames(df, "frame").collect()]
    assert got == [("a", 1, "ok"), ("b", None, "invalid"), ("a", None, "invalid"),
                   ("wlan0_level", None, "invalid"), ("x", -70, "ok")]


@pytest.mark.parametrize("topic,payload,kind,node,value", [
    ("sensors/28-00000abcdef1/data", "2050", "data", "28-00000abcdef1", 2050),
    ("sensors/28-00000abcdef1/data", "offline", "data", "28-00000abcdef1", None),
    ("sensors/28-00000abcdef1/errors", "disappeared", "error", "28-00000abcdef1", None),
    ("sensors/28-00000abcdef1", "attached", "lifecycle", "28-00000abcdef1", None),
    ("sensors/w1/errors", "list full", "bus_error", None, None),
    ("sensors/vent", "1", "vent", None, 1),
    ("act/node1", "V", "act", "node1", None),
    ("hb/node1", "7", "hb", "node1", 7),
    ("sensors", "7", "other", None, None),
])
def test_topics(spark, topic, payload, kind, node, value):
    df = spark.createDataFrame([(topic, payload)], "topic string, payload string")
    r = messages.route_messages(df, "topic", "payload").first()
    assert (r.kind, r.node, r.value, r.tombstone) == (kind, node, value, payload == "offline")


def test_registry(spark):
    dim = spark.createDataFrame([(4, 1, "a", "x")], "sensor_id long, site long, serial_code string, label string")
    seen = spark.createDataFrame([(1, "a"), (2, "c"), (1, "b"), (2, "c")], "site long, serial_code string")
    got = {r.serial_code: (r.sensor_id, r.label) for r in registry.upsert_sensors(dim, seen).collect()}
    assert got == {"a": (4, "x"), "b": (5, "b"), "c": (6, "c")}
    assert registry.dimension_violations(dim).count() == 0
    twice = dim.unionByName(dim.withColumn("label", F.lit("")))
    rules = sorted(r.rule for r in registry.dimension_violations(twice).collect())
    assert rules == ["duplicate sensor_id", "duplicate serial_code", "empty label"]
