"""Queries: the live operators, fed with the events as a stream.

Stateful ones get the events in waves, one run of the stream per wave, so that
what they return depends on the state carried from run to run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.functions.scalars import idiv
from holdline.plans.basics import MESSAGES, ROUTED, message_rows, rounded
from holdline.plans.calibrations import _joint_walk
from holdline.plans.derived import _ALERT_CTES, FRAME_ORDER, frame_rows
from holdline.plans.histories import _EMA, _EMA_SAMPLES, _SAMPLES, PRESENCE_LOG, bus, ema_walk
from holdline.plans.registry import query, sql
from holdline.plans.tables import Tables, adapt_events, family_log
from holdline.session import shared_dir
from holdline.streaming import live, liveness
from holdline.streaming.keyed import read_stream
from holdline.streaming.snapshots import versions

FIRST_SEC = 1_704_067_200  # 2024-01-01, the start of the data
WAVES = 3
KEY, ORDER = ["sensor_key"], ["event_us", "event_id"]
NOW = {"availableNow": True}


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def by_time() -> Column:
    """Ten days a wave."""
    days = idiv(F.col("event_us") - FIRST_SEC * 1_000_000, 864_000_000_000)
    return F.least(F.lit(WAVES - 1), F.greatest(F.lit(0), days))


def replay(t: Tables, rows: DataFrame, wave: Column, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed ``rows`` wave by wave to the stream that ``make`` makes of them, one run of
    the job per wave; what it has written in the end is returned."""
    folder = _folder(t)
    rows.withColumn("wave", wave).write.partitionBy("wave").parquet(f"{folder}/in")
    for n in range(WAVES):
        # The job knows the files of the waves before by its checkpoint.
        waves = ",".join(map(str, range(n + 1)))
        source = read_stream(t.spark, f"{folder}/in/wave={{{waves}}}/*.parquet", rows.schema, None)
        out = make(source)
        job = (
            out.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**NOW)
            .start()
        )
        job.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{folder}/out")


def _event_stream(t: Tables) -> DataFrame:
    # As a pattern it may name one file or a folder; a plain path only a folder.
    path = f"{t.sf_dir}/event[s].parquet"
    return adapt_events(read_stream(t.spark, path, t.read("events").schema))


def _run(t: Tables, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and read its output."""
    folder = _folder(t)
    job = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**NOW)
        .start()
    )
    job.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "x1_stream_changes",
    sql(
        """SELECT sensor_key, event_id, q1, q2 FROM (SELECT e.event_id, f.*, lag(q1, 1, 0) OVER w AS p1, lag(q2, 1, 0) OVER w AS p2
        FROM furnace f JOIN ev e ON e.sensor_key = f.sensor_key AND e.us = f.us
        WINDOW w AS (PARTITION BY f.sensor_key ORDER BY f.us))
        WHERE q1 IS DISTINCT FROM p1 OR q2 IS DISTINCT FROM p2"""
    ),
)
def x1_changes(t: Tables):
    log = t.log("furnace").select(*KEY, *ORDER, "q1", "q2")
    start = {"q1": 0, "q2": 0}
    out = replay(t, log, by_time(), lambda s: live.stream_changes(s, KEY, ORDER, ["q1", "q2"], start))
    return out.filter("NOT late").select("sensor_key", "event_id", "q1", "q2")


@query(
    "x1_stream_hysteresis",
    sql(
        """SELECT s.event_id, a.mem // 4 AS x, b.mem // 4 AS y FROM samples s
        JOIN walk_x a ON a.sensor_key = s.sensor_key AND a.rn = s.rn JOIN walk_y b ON b.sensor_key = s.sensor_key AND b.rn = s.rn
        WHERE a.mem // 4 <> a.old // 4 OR b.mem // 4 <> b.old // 4""",
        samples=_SAMPLES.replace("// 50", "// 500").replace("k // 4", "k // 25"),
        **_joint_walk("sensor_key", ["x", "y"]),
    ),
)
def x1_hysteresis(t: Tables):
    x = F.when(F.col("k") % 11 != 0, idiv(F.col("v") - 5000, 500))
    y = F.when(F.col("k") % 7 != 0, idiv("k", 25))
    rows = t.events().select(*KEY, *ORDER, x.alias("x"), y.alias("y"))
    out = replay(t, rows, by_time(), lambda s: live.stream_hysteresis(s, KEY, ORDER, ["x", "y"]))
    return out.filter("NOT late").select("event_id", "x", "y")


@query(
    "x2_stream_snapshot",
    sql(
        """SELECT sensor_key, max(sec) AS sec, arg_max(cs, sec * 128 + cs) AS cs, arg_max_null(temp, sec * 128 + cs) AS temp,
        arg_max_null(pres, sec * 128 + cs) AS pres FROM bme680 GROUP BY sensor_key"""
    ),
)
def x2(t: Tables):
    folder = _folder(t)
    log = family_log(_event_stream(t), "bme680")
    live.stream_snapshot(log, folder, KEY, ["temp", "pres"], **NOW).awaitTermination()
    last = versions(t.spark, f"{folder}/out")[-1]
    return t.spark.read.parquet(f"{folder}/out/batch={last}")


@query("x3_stream_route", sql(ROUTED, messages=MESSAGES))
def x3(t: Tables):
    routed = live.stream_route(message_rows(_event_stream(t)), "topic", "payload")
    return _run(t, routed.select("event_id", "kind", "node", "value", "tombstone"))


@query(
    "x4_stream_liveness",
    sql(
        """SELECT sensor_key, 'heartbeat' AS event, sec FROM walk JOIN samples USING (sensor_key, rn, sec)
          WHERE beat AND sec <= mark
        UNION ALL SELECT sensor_key, 'dead', sec FROM samples WHERE least(coalesce(next, mark), mark) - sec > 5
        UNION ALL SELECT sensor_key, 'stalled', sec FROM samples WHERE least(coalesce(next, mark), mark) - sec > 15""",
        # The last second can still get samples, so time has come as far as the one before.
        samples="""SELECT *, row_number() OVER w AS rn, lead(sec) OVER w AS next, max(sec) OVER () - 1 AS mark FROM (
          SELECT sensor_key, sec // 3600 AS sec, bool_or(k % 16 = 0) AS recorded FROM ev GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY sensor_key ORDER BY sec)""",
        walk="""SELECT sensor_key, rn, sec, sec AS h, false AS beat FROM samples WHERE rn = 1
          UNION ALL SELECT s.sensor_key, s.rn, s.sec, CASE WHEN s.recorded OR s.sec - w.h > 5 THEN s.sec ELSE w.h END,
            NOT s.recorded AND s.sec - w.h > 5
          FROM samples s JOIN walk w ON s.sensor_key = w.sensor_key AND s.rn = w.rn + 1""",
    ),
)
def x4(t: Tables):
    # Hours stand in for seconds: the events are hours apart.
    samples = _event_stream(t).select(
        "sensor_key", idiv("sec", 3600).alias("sec"), (F.col("k") % 16 == 0).alias("recorded")
    )
    return _run(t, liveness.stream_liveness(samples))


def _stream_ema(t: Tables, alpha: float, seed: str):
    x = F.when(~F.col("tomb"), F.col("v") - 5000)
    rows = t.events().select(*KEY, *ORDER, x.alias("x"))
    out = replay(t, rows, by_time(), lambda s: live.stream_ema(s, KEY, ORDER, "x", alpha, seed))
    return rounded(out.filter("NOT late").select("event_id", "ema"))


@query(
    "x5_stream_ema",
    sql(_EMA, samples=_EMA_SAMPLES, walk=ema_walk("samples", "sensor_key", "0.98e0", "(1e0 - 0.98e0) * x") % "walk"),
)
def x5(t: Tables):
    return _stream_ema(t, 0.98, "zero")


@query(
    "x5_stream_ema_first",
    sql(_EMA, samples=_EMA_SAMPLES, walk=ema_walk("samples", "sensor_key", "0.8e0", "x") % "walk"),
)
def x5_first(t: Tables):
    return _stream_ema(t, 0.8, "first")


@query(
    "x6_stream_alerts",
    sql(
        """SELECT event_id, round(y, 6) AS irms_ema, coalesce(pf < 0.92e0 AND y > 150 AND ctrl = 1, false) AS furnace_actual,
        coalesce(ctrl = 1, false) AND NOT coalesce(pf < 0.92e0 AND y > 150 AND ctrl = 1, false) AS warning,
        coalesce(pf < 0.8e0 AND tmp > 1500 AND (y > 630 OR (ctrl = 0 AND y > 400)), false) AS fans FROM factor""",
        **_ALERT_CTES,
    ),
)
def x6(t: Tables):
    out = replay(t, frame_rows(t.events()), by_time(), lambda s: live.stream_alerts(s, ["site"], FRAME_ORDER))
    return rounded(out.filter("NOT late").select("event_id", "irms_ema", "furnace_actual", "warning", "fans"))


# Rows may come ten days late.
_LATENESS = 864_000_000_000


@query(
    "x7_stream_late",
    sql(
        f"""SELECT event_id, late, CASE WHEN NOT late THEN row_number() OVER (PARTITION BY sensor_key, late
          ORDER BY event_us, event_id) END AS place
        FROM (SELECT *, coalesce(event_us <= before - {_LATENESS}, false) AS late FROM clocks)
        WHERE late OR event_us <= newest - {_LATENESS}""",
        # The clock of a sensor when a wave begins, and in the end.
        clocks="""SELECT event_id, sensor_key, event_us, max(event_us) OVER (PARTITION BY sensor_key) AS newest,
          max(event_us) OVER (PARTITION BY sensor_key ORDER BY k % 3 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM ev""",
    ),
)
def x7(t: Tables):
    # Waves by payload, not by time: most rows of the later ones are out of order.
    rows = t.events().select(*KEY, *ORDER)
    wave = F.regexp_extract("props", "[0-9]+", 0).cast("bigint") % 3
    waves = t.read("events").select("event_id", wave.alias("__wave"))
    out = replay(
        t, rows.join(waves, "event_id").select(*KEY, *ORDER, "__wave"), F.col("__wave"),
        lambda s: live.stream_ordered(s.drop("__wave"), KEY, ORDER, _LATENESS),
    )
    return out.select("event_id", "late", "place")


@query("x4_stream_presence", PRESENCE_LOG)
def x4_presence(t: Tables):
    readings, scans = bus(t)
    ends = scans.withColumns({"sensor_id": F.lit(None).cast("bigint"), "temp": F.lit(None).cast("bigint")})
    rows = readings.unionByName(ends.select(readings.columns))
    rows = rows.withColumns({c: F.col(c).cast("bigint") for c in rows.columns})
    ten_days = idiv(F.col("day") - FIRST_SEC // 86_400, 10)
    out = replay(
        t, rows, F.least(F.lit(WAVES - 1), F.greatest(F.lit(0), ten_days)),
        lambda s: live.stream_presence(s, "site", "sensor_id", "day", ["sec", "cs"], "temp"),
    )
    return out.select("sensor_id", "sec", F.col("cs").cast("int").alias("cs"), "temp")
