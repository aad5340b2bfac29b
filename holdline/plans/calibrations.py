"""Queries: recalibration of raw samples."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import partial

from pyspark.sql import functions as F

from holdline.functions.scalars import crc1w, crc8_word, idiv
from holdline.functions.times import local_day
from holdline.operators import calibrate, recalibrate, scan
from holdline.plans.basics import rounded
from holdline.plans.histories import ema_walk, hysteresis_walk
from holdline.plans.registry import query, sql
from holdline.plans.tables import Tables
from holdline.session import shared_dir
from holdline.sources.logs import read_log


def _crc1w_sql(data: list[str]) -> str:
    """1-wire checksum bit by bit, not by table."""
    step = "CASE WHEN a & 1 > 0 THEN xor(a >> 1, 140) ELSE a >> 1 END"
    crc = "0::BIGINT"
    for byte in data:
        crc = f"list_reduce([xor({crc}, {byte}), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {step})"
    return crc


_PAD = ["w % 256", "w // 256", "u", "u", "r", "255", "12", "16"]


@query(
    "c1_ds18b20_raw",
    sql(
        """SELECT event_id, CASE WHEN event_id % 17 <> 0 AND event_id % 10 <> 0 THEN
          CAST((x - (x & CASE k % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END)) * 25 // 4 AS INTEGER) END AS temp,
          CASE WHEN event_id % 17 = 0 THEN 'crc' WHEN event_id % 10 = 0 THEN 'offline' END AS reason,
          CASE WHEN event_id % 17 <> 0 AND event_id % 10 <> 0 THEN CAST(b8 AS BIGINT) END AS b8
        FROM (SELECT *, CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS x FROM pads)""",
        words="""SELECT event_id, k, (v * 7) % 65536 AS w, CASE WHEN event_id % 10 = 0 THEN 75::BIGINT ELSE 255 END AS u,
          k % 4 * 32 + 31 AS r FROM ev""",
        pads=f"SELECT *, {_crc1w_sql(_PAD)} AS b8 FROM words",
    ),
)
def c1(t: Tables):
    word = (F.col("v") * 7) % 65536
    user = F.when(F.col("event_id") % 10 == 0, 75).otherwise(255)
    raw = t.events().select(
        "event_id",
        (word % 256).alias("b0"),
        idiv(word, 256).alias("b1"),
        user.alias("b2"),
        user.alias("b3"),
        (F.col("k") % 4 * 32 + 31).alias("b4"),
        F.lit(255).alias("b5"),
        F.lit(12).alias("b6"),
        F.lit(16).alias("b7"),
    )
    crc = crc1w([f"b{i}" for i in range(8)]).cast("bigint")
    broken = F.when(F.col("event_id") % 17 == 0, crc.bitwiseXOR(F.lit(1).cast("bigint"))).otherwise(crc)
    got = calibrate.ds18b20(raw.withColumn("b8", broken))
    return got.select("event_id", "temp", "reason", F.when(F.col("reason").isNull(), F.col("b8")).alias("b8"))


def _crc_sql(high: str, low: str) -> str:
    """Checksum bit by bit, not by table."""

    def byte(start: str) -> str:
        step = "CASE WHEN a & 128 > 0 THEN xor((a << 1) & 255, 49) ELSE (a << 1) & 255 END"
        return f"list_reduce([{start}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {step})"

    return byte(f"xor({byte(f'xor(255::BIGINT, {high})')}, {low})")


_SHT = """SELECT event_id, sensor_key, sec, cs, (v * 7) % 65536 AS tw, (v * 13 + k) % 65536 AS hw,
  event_id % 10 = 0 OR event_id % 13 = 0 OR event_id % 19 = 0 AS bad FROM ev"""
_SHT_GOOD = """SELECT *, tw * 175 * 400 // 65535 - 18000 AS temp, hw * 4000 // 65535 AS hum FROM words WHERE NOT bad"""


def _sht_raw(ev):
    """Words with a wrong checksum, without a checksum, or without a byte now and then."""
    tw, hw = (F.col("v") * 7) % 65536, (F.col("v") * 13 + F.col("k")) % 65536
    high = F.when(F.col("event_id") % 19 != 0, idiv(hw, 256))
    raw = ev.select(
        "event_id", "sensor_key", "sec", "cs",
        idiv(tw, 256).alias("b0"), (tw % 256).alias("b1"),
        high.alias("b3"), (hw % 256).alias("b4"),
    )
    good = crc8_word("b0", "b1")
    broken = F.when(F.col("event_id") % 10 == 0, good.bitwiseXOR(F.lit(1))).otherwise(good)
    return raw.withColumns({"b2": F.when(F.col("event_id") % 13 != 0, broken), "b5": crc8_word("b3", "b4")})


@query(
    "c4_sht31_raw",
    sql(
        f"""SELECT event_id, CASE WHEN NOT bad THEN tw * 175 * 400 // 65535 - 18000 END AS temp,
          CASE WHEN NOT bad THEN hw * 4000 // 65535 END AS hum, CASE WHEN bad THEN 'crc' END AS reason,
          CASE WHEN event_id % 19 <> 0 THEN CAST({_crc_sql("hw // 256", "hw % 256")} AS INTEGER) END AS b5 FROM words""",
        words=_SHT,
    ),
)
def c4(t: Tables):
    return calibrate.sht31(_sht_raw(t.events())).select("event_id", "temp", "hum", "reason", "b5")


def _joint_walk(key: str, columns: list[str]) -> dict[str, str]:
    return {f"walk_{c}": hysteresis_walk("samples", key, c) % f"walk_{c}" for c in columns}


@query(
    "c4_sht31_log",
    sql(
        """SELECT event_id, temp, hum FROM (SELECT *, lag(ok) OVER w AS was_ok, coalesce(bool_or(changed) OVER
            (PARTITION BY sensor_key ORDER BY sec, cs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS logged
          FROM steps WINDOW w AS (PARTITION BY sensor_key ORDER BY sec, cs, event_id))
        WHERE changed OR (logged AND ok <> was_ok)""",
        words=_SHT,
        samples=f"""SELECT sensor_key, sec, cs, event_id, temp // 100 AS temp, hum // 50 AS hum,
          row_number() OVER (PARTITION BY sensor_key ORDER BY sec, cs, event_id) AS rn FROM ({_SHT_GOOD})""",
        **_joint_walk("sensor_key", ["temp", "hum"]),
        steps="""SELECT s.sensor_key, s.sec, s.cs, s.event_id, true AS ok, a.mem // 4 AS temp, b.mem // 4 AS hum,
            a.mem // 4 <> a.old // 4 OR b.mem // 4 <> b.old // 4 AS changed FROM samples s
          JOIN walk_temp a ON a.sensor_key = s.sensor_key AND a.rn = s.rn JOIN walk_hum b ON b.sensor_key = s.sensor_key AND b.rn = s.rn
          UNION ALL SELECT sensor_key, sec, cs, event_id, false, NULL, NULL, false FROM words WHERE bad""",
    ),
)
def c4_log(t: Tables):
    rows = calibrate.sht31(_sht_raw(t.events()))
    # Coarser than stored, so that many samples change nothing.
    rows = rows.withColumns({"temp": idiv("temp", 100), "hum": idiv("hum", 50)})
    order = ["sec", "cs", "event_id"]
    return scan.record_log(rows, ["sensor_key"], order, ["temp", "hum"]).select("event_id", "temp", "hum")


# Days whose samples a wrong offset was applied to, by the day of the month.
_WRONG_DAYS = (8, 12)


def _archive(t: Tables, raw):
    """Raw samples by day. Stamps are coarse, so that records collide."""
    raw = raw.withColumns({"sec": idiv("sec", 7200) * 7200, "cs": F.lit(0)})
    folder = f"{shared_dir(t.spark)}/archive-{uuid.uuid4().hex}"
    raw.withColumn("day", local_day("sec")).write.partitionBy("day").parquet(folder)
    return t.spark.read.parquet(folder)


def _coarse_sht31(raw):
    rows = calibrate.sht31(raw)
    return rows.withColumns({"temp": idiv("temp", 100), "hum": idiv("hum", 50)})


def _off(decode, channel: str, by: int):
    """A decoder that is wrong on some days."""

    def run(raw):
        wrong = F.when(F.dayofmonth("day").between(*_WRONG_DAYS), by).otherwise(0)
        return decode(raw).withColumn(channel, F.col(channel) + wrong)

    return run


def _put_right(t: Tables, raw, job: recalibrate.Job, channel: str, by: int):
    """Log and quarantine of a log built with a wrong offset on some days, and put right on
    these alone."""
    folder = f"{shared_dir(t.spark)}/calibrated-{uuid.uuid4().hex}"
    recalibrate.recalibrate(raw, folder, replace(job, decode=_off(job.decode, channel, by)))
    wrong = raw.filter(F.dayofmonth("day").between(*_WRONG_DAYS)).select("day").distinct()
    recalibrate.recalibrate(raw, folder, job, [r["day"] for r in wrong.collect()])
    log = read_log(t.spark, f"{folder}/log", job.family).withColumn("reason", F.lit(None).cast("string"))
    bad = recalibrate.Tables(t.spark, folder, job, raw).read("quarantine")
    bad = bad.withColumns({c: F.lit(None).cast(dict(log.dtypes)[c]) for c in job.channels})
    columns = ["sensor_key", "sec", "cs", *job.channels, "reason"]
    return log.select(columns).unionByName(bad.select(columns))


def _recalibrated_sql(
    words: str, scaled: dict[str, str], stored: dict[str, str], reason: str, warmup: int = 0, kind: str = "INTEGER",
    **ctes: str
) -> str:
    """Log and quarantine of all ``words`` (grp, sensor_key, sec, cs, event_id, bad and what
    ``scaled`` needs) by rows, ``stored`` of what is held in ``<channel>.mem``, as ``kind``."""
    held = ", ".join(f"CAST({e} AS {kind}) AS {c}" for c, e in stored.items())
    nulls = ", ".join(f"NULL AS {c}" for c in scaled)
    emits = " OR ".join(f"{c}.mem // 4 <> {c}.old // 4" for c in scaled)
    walks = " ".join(f"JOIN walk_{c} {c} ON {c}.grp = s.grp AND {c}.rn = s.rn" for c in scaled)
    return sql(
        f"""SELECT sensor_key, s // 120 AS sec, CAST(s % 120 AS INTEGER) AS cs, {", ".join(scaled)}, CAST(NULL AS VARCHAR) AS reason
          FROM slots JOIN arrivals USING (sensor_key, rn) WHERE kept
        UNION ALL SELECT sensor_key, sec, cs, {nulls}, '{reason}' FROM words WHERE bad""",
        **ctes,
        words=words,
        samples=f"""SELECT grp, sensor_key, sec, cs, event_id, {", ".join(f"{e} AS {c}" for c, e in scaled.items())},
          row_number() OVER (PARTITION BY grp ORDER BY sec, cs, event_id) AS rn FROM words WHERE NOT bad""",
        **_joint_walk("grp", list(scaled)),
        steps=f"""SELECT s.grp, s.sensor_key, s.sec, s.cs, s.event_id, true AS ok, {held}, {emits} AS moved FROM samples s {walks}
          UNION ALL SELECT grp, sensor_key, sec, cs, event_id, false, {nulls}, false FROM words WHERE bad""",
        placed=f"""SELECT *, lag(ok) OVER w AS was_ok, moved AND row_number() OVER w > {warmup} AS changed FROM steps
          WINDOW w AS (PARTITION BY grp ORDER BY sec, cs, event_id)""",
        arrivals="""SELECT *, sec * 120 + cs AS tick, row_number() OVER (PARTITION BY sensor_key ORDER BY sec, cs, event_id) AS rn
          FROM (SELECT *, coalesce(bool_or(changed) OVER (PARTITION BY grp ORDER BY sec, cs, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS logged FROM placed)
          WHERE changed OR (logged AND ok <> was_ok)""",
        slots="""SELECT sensor_key, rn, tick AS s, true AS kept FROM arrivals WHERE rn = 1
          UNION ALL SELECT a.sensor_key, a.rn, least(greatest(w.s + 1, a.tick), a.tick + 19),
            least(greatest(w.s + 1, a.tick), a.tick + 19) > w.s
          FROM arrivals a JOIN slots w ON a.sensor_key = w.sensor_key AND a.rn = w.rn + 1""",
    )


@query(
    "r_sht31_recalibrated",
    sql(
        """SELECT sensor_key, s // 120 AS sec, CAST(s % 120 AS INTEGER) AS cs, temp, hum, CAST(NULL AS VARCHAR) AS reason
          FROM slots JOIN arrivals USING (sensor_key, rn) WHERE kept
        UNION ALL SELECT sensor_key, sec, cs, NULL, NULL, 'crc' FROM words WHERE bad""",
        words=_SHT.replace("sec, cs,", "sec // 7200 * 7200 AS sec, 0 AS cs,"),
        samples=f"""SELECT sensor_key, sec, cs, event_id, temp // 100 AS temp, hum // 50 AS hum,
          row_number() OVER (PARTITION BY sensor_key ORDER BY sec, cs, event_id) AS rn FROM ({_SHT_GOOD})""",
        **_joint_walk("sensor_key", ["temp", "hum"]),
        steps="""SELECT s.sensor_key, s.sec, s.cs, s.event_id, true AS ok, a.mem // 4 AS temp, b.mem // 4 AS hum,
            a.mem // 4 <> a.old // 4 OR b.mem // 4 <> b.old // 4 AS changed FROM samples s
          JOIN walk_temp a ON a.sensor_key = s.sensor_key AND a.rn = s.rn JOIN walk_hum b ON b.sensor_key = s.sensor_key AND b.rn = s.rn
          UNION ALL SELECT sensor_key, sec, cs, event_id, false, NULL, NULL, false FROM words WHERE bad""",
        arrivals="""SELECT sensor_key, CAST(temp AS INTEGER) AS temp, CAST(hum AS INTEGER) AS hum, sec * 120 + cs AS tick,
            row_number() OVER (PARTITION BY sensor_key ORDER BY sec, cs, event_id) AS rn
          FROM (SELECT *, lag(ok) OVER w AS was_ok, coalesce(bool_or(changed) OVER
              (PARTITION BY sensor_key ORDER BY sec, cs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS logged
            FROM steps WINDOW w AS (PARTITION BY sensor_key ORDER BY sec, cs, event_id))
          WHERE changed OR (logged AND ok <> was_ok)""",
        slots="""SELECT sensor_key, rn, tick AS s, true AS kept FROM arrivals WHERE rn = 1
          UNION ALL SELECT a.sensor_key, a.rn, least(greatest(w.s + 1, a.tick), a.tick + 19),
            least(greatest(w.s + 1, a.tick), a.tick + 19) > w.s
          FROM arrivals a JOIN slots w ON a.sensor_key = w.sensor_key AND a.rn = w.rn + 1""",
    ),
)
def r_sht31(t: Tables):
    raw = _archive(t, _sht_raw(t.events()))
    return _put_right(t, raw, recalibrate.Job("sht31", _coarse_sht31, "event_id"), "temp", 30)


_AVERAGES = """SELECT event_id, CAST(CASE WHEN vr >= 32768 THEN vr - 65536 ELSE vr END AS DOUBLE) * 1.25e0 / 1e3 * 4.746e0 * 2e0 * 1.11e0 + 0.6e0 AS vrms,
  CAST(CASE WHEN pr >= 32768 THEN pr - 65536 ELSE pr END AS DOUBLE) * 10e0 / 1e3 * 4.746e0 * 2e0 AS p
  FROM (SELECT event_id, (v * 7) % 65536 AS vr, (v * 11 + k) % 65536 AS pr FROM ev)"""


@query(
    "r_bme680_recalibrated",
    _recalibrated_sql(
        """SELECT event_id, sensor_key, sensor_key * 1000 + session AS grp, sec // 7200 * 7200 AS sec, 0 AS cs, v, k,
          event_id % 19 = 0 AS bad FROM sessions""",
        {
            "temp": "(v - 5000) // 50 * 4 // 10",
            "pres": "(84000 + k * 10) * 4 // 10",
            "hum": "v * 2 * 4 // 100",
            "gas": "k * 100000 * 4 // 100000",
        },
        {"temp": "temp.mem * 10 // 4", "pres": "pres.mem // 4", "hum": "hum.mem // 4", "gas": "gas.mem * 100 // 4"},
        "missing",
        warmup=2,
    ),
)
def r_bme680(t: Tables):
    """With a warm-up of each session, which may cross a day."""
    v, k = F.col("v"), F.col("k")
    raw = t.sessions().select(
        "event_id", "sensor_key", "session", "sec", "cs",
        idiv(v - 5000, 50).alias("temperature"),
        (k * 10 + 84_000).alias("pressure"),
        (v * 2).alias("humidity"),
        F.when(F.col("event_id") % 19 != 0, k * 100_000).alias("gas_resistance"),
    )
    stored = {c: partial(calibrate.air_stored, c) for c in calibrate.AIR_STORED}
    job = recalibrate.Job(
        "bme680", calibrate.bme680_judged, "event_id", key=("sensor_key", "session"), warmup=2, unscale=stored
    )
    return _put_right(t, _archive(t, raw), job, "hum", 30)


# Samples of a burst, too few for two whole cycles of a slow current.
_BURST = 24
_BURST_OFFSET = 0.00037


def _measure_ina260(raw):
    """Archived measurements, each with its burst of current samples."""
    bursts = raw.select("event_id", F.posexplode("burst").alias("seq", "raw"))
    rms = calibrate.burst_rms(bursts, ["event_id"], "seq", offset=_BURST_OFFSET).withColumnRenamed("rms", "irms")
    return calibrate.ina260_judged(calibrate.ina260_average(raw).join(rms, "event_id"))


@query(
    "r_ina260_recalibrated",
    _recalibrated_sql(
        """SELECT e.event_id, sensor_key, sensor_key AS grp, sec // 7200 * 7200 AS sec, 0 AS cs, vrms, p, sqrt(ms) AS irms, r.c < 3 AS bad
          FROM ev e JOIN averages a ON a.event_id = e.event_id JOIN rms r ON r.event_id = e.event_id""",
        {
            "vrms": "CAST(trunc(vrms * 4e0) AS BIGINT)",
            "irms": "CAST(trunc(irms * 4e0 * 1e2) AS BIGINT)",
            "pmean": "CAST(trunc((p + coalesce(p * 0.6e0 / nullif(vrms, 0), 0)) * 4e0) AS BIGINT)",
        },
        {"vrms": "vrms.mem // 4", "irms": "irms.mem // 4", "pmean": "pmean.mem // 4"},
        "cycle",
        averages=_AVERAGES,
        bursts=f"""SELECT event_id, i, (v + i * (5 + k % 60)) % 200 - 100 AS raw FROM ev, range({_BURST}) r(i)""",
        cycles="""SELECT event_id, raw * (1.25e0 / 1e3) + 0.00037e0 AS x, sum(CASE WHEN before <= 0 AND raw > 0 THEN 1 ELSE 0 END)
          OVER (PARTITION BY event_id ORDER BY i) AS c
          FROM (SELECT *, lag(raw) OVER (PARTITION BY event_id ORDER BY i) AS before FROM bursts)""",
        rms="""SELECT event_id, max(c) AS c, avg(x * x) FILTER (WHERE c BETWEEN 1 AND 2) AS ms FROM cycles GROUP BY event_id""",
    ),
)
def r_ina260(t: Tables):
    """Measurements whose burst holds no two whole cycles leave tombstones."""
    v, k = F.col("v"), F.col("k")
    sample = lambda i: ((v + i * (k % 60 + 5)) % 200 - 100).cast("int")
    raw = t.events().select(
        "event_id", "sensor_key", "sec", "cs",
        ((v * 7) % 65536).alias("v_raw"), ((v * 11 + k) % 65536).alias("p_raw"),
        F.transform(F.sequence(F.lit(0), F.lit(_BURST - 1)), sample).alias("burst"),
    )
    return _put_right(t, _archive(t, raw), recalibrate.Job("ina260", _measure_ina260, "event_id"), "vrms", 40)


_GROUPED = """row_number() OVER (PARTITION BY sensor_key, session ORDER BY event_id) AS rn"""


@query(
    "c5_bme680_scale",
    sql(
        """SELECT s.event_id, a.mem * 10 // 4 AS temp, b.mem // 4 AS pres, c.mem // 4 AS hum, d.mem * 100 // 4 AS gas FROM samples s
        JOIN walk_temp a ON a.grp = s.grp AND a.rn = s.rn JOIN walk_pres b ON b.grp = s.grp AND b.rn = s.rn
        JOIN walk_hum c ON c.grp = s.grp AND c.rn = s.rn JOIN walk_gas d ON d.grp = s.grp AND d.rn = s.rn
        WHERE s.rn > 2 AND (a.mem // 4 <> a.old // 4 OR b.mem // 4 <> b.old // 4
          OR c.mem // 4 <> c.old // 4 OR d.mem // 4 <> d.old // 4)""",
        samples=f"""SELECT event_id, sensor_key * 1000 + session AS grp, {_GROUPED}, (v - 5000) * 4 // 10 AS temp,
          (84000 + k * 10) * 4 // 10 AS pres, v * 2 * 4 // 100 AS hum, k * 100000 * 4 // 100000 AS gas FROM sessions""",
        **_joint_walk("grp", ["temp", "pres", "hum", "gas"]),
    ),
)
def c5(t: Tables):
    v, k = F.col("v"), F.col("k")
    raw = t.sessions().select(
        "sensor_key",
        "session",
        F.col("event_id").alias("seq"),
        (v - 5000).alias("temperature"),
        (k * 10 + 84_000).alias("pressure"),
        (v * 2).alias("humidity"),
        (k * 100_000).alias("gas_resistance"),
    )
    out = calibrate.bme680(raw, warmup=2)
    return out.select(F.col("seq").alias("event_id"), "temp", "pres", "hum", "gas")


_LIGHT = f"""SELECT event_id, ch, g, least(65535, (v % 3000 + ch * k) * CASE g WHEN 0 THEN 1 WHEN 1 THEN 24 WHEN 2 THEN 400 ELSE 9500 END
  + CASE WHEN k % 20 = 0 THEN 40000 ELSE 0 END) AS n FROM ev, (VALUES (0), (1)) c(ch), (VALUES (0), (1), (2), (3)) q(g)"""
_PICK = """SELECT l.event_id, l.ch, l.g, l.n FROM light l JOIN (SELECT event_id, ch, coalesce(max(g) FILTER (WHERE n <= 36863), 0) AS g
  FROM light GROUP BY 1, 2) b ON l.event_id = b.event_id AND l.ch = b.ch AND l.g = b.g"""
# Literals, so that a wrong constant of the operator would show.
_GAIN = {
    0: "CASE g0 WHEN 0 THEN 400e0 WHEN 1 THEN 400e0 / 24.5e0 WHEN 2 THEN 1e0 ELSE 400e0 / 9200e0 END",
    1: "CASE g1 WHEN 0 THEN 400e0 WHEN 1 THEN 400e0 / 24.5e0 WHEN 2 THEN 1e0 ELSE 400e0 / 9900e0 END",
}


def _light_counts(v, k, ch: int) -> list:
    """What channel ``ch`` counts at each gain, before it saturates."""
    bright = F.when(k % 20 == 0, 40_000).otherwise(0)
    return [(v % 3000 + k * ch) * times + bright for times in (1, 24, 400, 9500)]


@query(
    "c6_tsl2591_autorange",
    sql(
        f"""SELECT event_id, CAST(trunc(t * 4e0 * 1e6) AS BIGINT) AS total, CAST(trunc(i * 4e0 * 1e6) AS BIGINT) AS ired,
          round(t - i, 6) AS white FROM (SELECT event_id, CAST(n0 AS DOUBLE) * {_GAIN[0]} / 264.1e0 / 1e2 AS t,
            CAST(n1 AS DOUBLE) * {_GAIN[1]} * (154.1e0 / (154.1e0 + 34.9e0)) / 154.1e0 / 1e2 AS i
          FROM (SELECT p.event_id, p.g AS g0, p.n AS n0, q.g AS g1, q.n AS n1 FROM pick p JOIN pick q
            ON p.event_id = q.event_id WHERE p.ch = 0 AND q.ch = 1))""",
        light=_LIGHT,
        pick=_PICK,
    ),
)
def c6(t: Tables):
    v, k = F.col("v"), F.col("k")
    cells = F.array(
        *[
            F.struct(F.lit(ch).alias("channel"), F.lit(g).alias("gain"), F.least(F.lit(65535), n).alias("count"))
            for ch in (0, 1)
            for g, n in enumerate(_light_counts(v, k, ch))
        ]
    )
    raw = t.events().select("event_id", F.inline(cells))
    return rounded(calibrate.tsl2591(raw, ["event_id"]))


_UVA = f"CAST(v % 65536 AS DOUBLE) * {1 / 0.93!r}e0 / 1e2 * 4e0 * 1e3"
_UVB = f"CAST(k * 31 AS DOUBLE) * {1 / 2.1!r}e0 / 1e2 * 4e0 * 1e3"


@query(
    "c7_veml6075_raw",
    sql(
        f"SELECT event_id, CAST(trunc({_UVA}) AS BIGINT) AS uva, CAST(trunc({_UVB}) AS BIGINT) AS uvb FROM ev"
    ),
)
def c7(t: Tables):
    raw = t.events().select("event_id", (F.col("v") % 65536).alias("uva_raw"), (F.col("k") * 31).alias("uvb_raw"))
    return calibrate.veml6075(raw).select("event_id", "uva", "uvb")


_FLUX_X = "(v * 2111 + k * 65537) % 16777216"


@query(
    "c8_flux",
    sql(
        """SELECT event_id, w.mem // 4 AS flux FROM walk w JOIN samples s ON s.grp = w.grp AND s.rn = w.rn
        WHERE w.mem // 4 <> w.old // 4""",
        raw=f"""SELECT event_id, sensor_key * 1000 + session AS grp, {_GROUPED},
          CASE WHEN {_FLUX_X} >= 8388608 THEN {_FLUX_X} - 16777216 ELSE {_FLUX_X} END AS x FROM sessions""",
        smooth=ema_walk("raw", "grp", "0.98e0", "(1e0 - 0.98e0) * x") % "smooth",
        samples="""SELECT r.event_id, r.grp, r.rn - 2 AS rn,
          CAST(trunc(y * (3.3e6 / 8388608e0) / 1.21e0 * 4e0) AS BIGINT) AS flux
          FROM smooth e JOIN raw r ON r.grp = e.grp AND r.rn = e.rn WHERE r.rn > 2""",
        walk=hysteresis_walk("samples", "grp", "flux") % "walk",
    ),
)
def c8(t: Tables):
    raw24 = (F.col("v") * 2111 + F.col("k") * 65_537) % 16_777_216
    raw = t.sessions().select("sensor_key", "session", F.col("event_id").alias("seq"), raw24.alias("raw24"))
    return calibrate.flux(raw, t.cfg(), warmup=2).select(F.col("seq").alias("event_id"), "flux")


_COARSE = "sec // 7200 * 7200 AS sec, 0 AS cs"


@query(
    "r_max11201b_recalibrated",
    _recalibrated_sql(
        """SELECT event_id, sensor_key, grp, sec, cs, NULL::DOUBLE AS y, true AS bad FROM conversions WHERE bad
          UNION ALL SELECT g.event_id, g.sensor_key, g.grp, g.sec, g.cs, s.y, false
          FROM good g JOIN smooth s ON s.grp = g.grp AND s.rn = g.rn WHERE g.rn > 2""",
        {"flux": "CAST(trunc(y * (3.3e6 / 8388608e0) / 1.21e0 * 4e0) AS BIGINT)"},
        {"flux": "flux.mem // 4"},
        "missing",
        conversions=f"""SELECT event_id, sensor_key, sensor_key * 1000 + session AS grp, {_COARSE}, event_id % 19 = 0 AS bad,
          CASE WHEN {_FLUX_X} >= 8388608 THEN {_FLUX_X} - 16777216 ELSE {_FLUX_X} END AS x FROM sessions""",
        good="SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sec, cs, event_id) AS rn FROM conversions WHERE NOT bad",
        smooth=ema_walk("good", "grp", "0.98e0", "(1e0 - 0.98e0) * x") % "smooth",
    ),
)
def r_max11201b(t: Tables):
    """Smoothed over each session from zero, also over the end of a day."""
    raw24 = (F.col("v") * 2111 + F.col("k") * 65_537) % 16_777_216
    raw = t.sessions().select(
        "event_id", "sensor_key", "session", "sec", "cs", F.when(F.col("event_id") % 19 != 0, raw24).alias("raw24")
    )
    made = {"flux": partial(calibrate.flux_scaled, cfg=t.cfg())}
    smooth = recalibrate.Smoothing("value", calibrate.FLUX_ALPHA, made, warmup=2)
    job = recalibrate.Job(
        "max11201b", calibrate.flux_judged, "event_id", key=("sensor_key", "session"), smooth=smooth
    )
    return _put_right(t, _archive(t, raw), job, "value", 400_000)


@query(
    "r_tsl2591_recalibrated",
    _recalibrated_sql(
        f"""SELECT e.event_id, e.sensor_key, e.sensor_key AS grp, {_COARSE}, e.event_id % 19 = 0 AS bad,
          CAST(p.n AS DOUBLE) * {_GAIN[0].replace("g0", "p.g")} / 264.1e0 / 1e2 AS t,
          CAST(q.n AS DOUBLE) * {_GAIN[1].replace("g1", "q.g")} * (154.1e0 / (154.1e0 + 34.9e0)) / 154.1e0 / 1e2 AS i
          FROM ev e JOIN pick p ON p.event_id = e.event_id AND p.ch = 0 JOIN pick q ON q.event_id = e.event_id AND q.ch = 1""",
        {"total": "CAST(trunc(t * 4e0 * 1e6) AS BIGINT)", "ired": "CAST(trunc(i * 4e0 * 1e6) AS BIGINT)"},
        {"total": "total.mem // 4", "ired": "ired.mem // 4"},
        "missing",
        kind="BIGINT",
        light=_LIGHT,
        pick=_PICK,
    ),
)
def r_tsl2591(t: Tables):
    """Measurements that lack a count leave tombstones."""
    v, k = F.col("v"), F.col("k")

    def counts(ch: int):
        cells = [F.least(F.lit(65535), n) for n in _light_counts(v, k, ch)]
        if ch == 1:
            cells[2] = F.when(F.col("event_id") % 19 != 0, cells[2])
        return F.array(*cells).alias(f"c{ch}")

    raw = t.events().select("event_id", "sensor_key", "sec", "cs", counts(0), counts(1))
    job = recalibrate.Job("tsl2591", calibrate.tsl2591_judged, "event_id")
    return _put_right(t, _archive(t, raw), job, "total", 4_000_000)


@query(
    "r_veml6075_recalibrated",
    _recalibrated_sql(
        f"""SELECT event_id, sensor_key, sensor_key AS grp, {_COARSE}, event_id % 19 = 0 AS bad,
          CAST(trunc({_UVA}) AS BIGINT) AS a, CAST(trunc({_UVB}) AS BIGINT) AS b FROM ev""",
        {"uva": "a", "uvb": "b"},
        {"uva": "uva.mem // 4", "uvb": "uvb.mem // 4"},
        "missing",
    ),
)
def r_veml6075(t: Tables):
    raw = t.events().select(
        "event_id", "sensor_key", "sec", "cs", (F.col("v") % 65536).alias("uva_raw"),
        F.when(F.col("event_id") % 19 != 0, F.col("k") * 31).alias("uvb_raw"),
    )
    job = recalibrate.Job("veml6075", calibrate.veml6075_judged, "event_id")
    return _put_right(t, _archive(t, raw), job, "uva", 400)


def _averages(t: Tables):
    v, k = F.col("v"), F.col("k")
    raw = t.events().select(
        "event_id", "k", "sensor_key", ((v * 7) % 65536).alias("v_raw"), ((v * 11 + k) % 65536).alias("p_raw")
    )
    return calibrate.ina260_average(raw)


@query(
    "c9_ina260_avg",
    sql(
        "SELECT event_id, round(vrms, 6) AS vrms, round(p + coalesce(p * 0.6e0 / nullif(vrms, 0), 0), 6) AS pmean FROM averages",
        averages=_AVERAGES,
    ),
)
def c9(t: Tables):
    return rounded(_averages(t).select("event_id", "vrms", "pmean"))


_BURSTS = """SELECT sensor_key AS burst, event_id AS seq, v - 5000 AS raw FROM ev
  UNION ALL SELECT -1 - sensor_key, event_id, v - 5000 FROM (SELECT *, row_number() OVER
    (PARTITION BY sensor_key ORDER BY event_id) AS rn FROM ev) WHERE rn <= 5"""
_RMS = """SELECT burst, ok, CASE WHEN ok THEN sqrt(ms) ELSE 0 END AS rms FROM (
  SELECT burst, max(c) > 2 AS ok, avg(x * x) FILTER (WHERE c BETWEEN 1 AND 2) AS ms FROM (
    SELECT burst, raw * (1.25e0 / 1e3) AS x, sum(CASE WHEN before <= 0 AND raw > 0 THEN 1 ELSE 0 END) OVER
      (PARTITION BY burst ORDER BY seq) AS c FROM (SELECT *, lag(raw) OVER (PARTITION BY burst ORDER BY seq) AS before FROM bursts))
  GROUP BY burst)"""


def _bursts(t: Tables):
    ev = t.events().select("sensor_key", F.col("event_id").alias("seq"), (F.col("v") - 5000).alias("raw"))
    # A second burst per sensor, cut so short that no whole cycle fits.
    first = scan.History.of(ev, ["sensor_key"], ["seq"]).number("n").filter(F.col("n") <= 5).rows()
    cut = first.select((F.lit(-1) - F.col("sensor_key")).alias("burst"), "seq", "raw")
    return ev.withColumnRenamed("sensor_key", "burst").unionByName(cut)


@query("c10_burst_rms", sql("SELECT burst, ok, round(rms, 6) AS rms FROM rms", bursts=_BURSTS, rms=_RMS))
def c10(t: Tables):
    return rounded(calibrate.burst_rms(_bursts(t), ["burst"], "seq").select("burst", "ok", "rms"))


@query(
    "c11_power_factor",
    sql(
        """SELECT event_id, round(vrms * i, 6) AS apparent, round(CASE WHEN vrms * i = 0 THEN 1 ELSE pm / (vrms * i) END, 6) AS pf
        FROM (SELECT a.event_id, a.vrms, a.p + coalesce(a.p * 0.6e0 / nullif(a.vrms, 0), 0) AS pm,
            CASE WHEN e.k % 10 = 0 THEN 0 ELSE r.rms END AS i
          FROM averages a JOIN ev e ON e.event_id = a.event_id JOIN rms r ON r.burst = e.sensor_key WHERE r.ok)""",
        averages=_AVERAGES,
        bursts=_BURSTS,
        rms=_RMS,
    ),
)
def c11(t: Tables):
    rms = calibrate.burst_rms(_bursts(t), ["burst"], "seq")
    both = _averages(t).join(rms.withColumnRenamed("burst", "sensor_key"), "sensor_key")
    both = both.withColumn("irms", F.when(F.col("k") % 10 == 0, F.lit(0.0)).otherwise(F.col("rms")))
    return rounded(calibrate.power_factor(both).select("event_id", "apparent", "pf"))


@query(
    "c11_ina260_log",
    sql(
        """SELECT s.event_id, a.mem // 4 AS vrms, b.mem // 4 AS irms, c.mem // 4 AS pmean FROM samples s
        JOIN walk_vrms a ON a.sensor_key = s.sensor_key AND a.rn = s.rn JOIN walk_irms b ON b.sensor_key = s.sensor_key AND b.rn = s.rn
        JOIN walk_pmean c ON c.sensor_key = s.sensor_key AND c.rn = s.rn
        WHERE a.mem // 4 <> a.old // 4 OR b.mem // 4 <> b.old // 4 OR c.mem // 4 <> c.old // 4""",
        averages=_AVERAGES,
        samples="""SELECT e.sensor_key, e.event_id, CAST(trunc(vrms * 4e0) AS BIGINT) AS vrms, CAST(trunc(k * 0.37e0 * 4e0 * 1e2) AS BIGINT) AS irms,
          CAST(trunc((p + coalesce(p * 0.6e0 / nullif(vrms, 0), 0)) * 4e0) AS BIGINT) AS pmean,
          row_number() OVER (PARTITION BY e.sensor_key ORDER BY e.event_id) AS rn
          FROM averages a JOIN ev e ON e.event_id = a.event_id WHERE k % 10 <> 0""",
        **_joint_walk("sensor_key", ["vrms", "irms", "pmean"]),
    ),
)
def c11_log(t: Tables):
    measured = _averages(t).withColumns(
        {"ok": F.col("k") % 10 != 0, "irms": F.col("k").cast("double") * F.lit(0.37)}
    )
    log = scan.compound_record(calibrate.ina260(measured), ["sensor_key"], ["event_id"], ["vrms", "irms", "pmean"])
    return log.select("event_id", "vrms", "irms", "pmean")
