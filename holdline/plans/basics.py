"""Queries: event time, settings, registries, views, joins and snapshots."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from holdline.functions.scalars import idiv
from holdline.functions.times import client_text, event_us, local_day, split_event_time
from holdline.operators import changelog, latest, views
from holdline.plans.registry import query, sql
from holdline.plans.tables import LABELS, Tables
from holdline.session import shared_dir
from holdline.sources import config, frames, logs, messages, onewire, registry


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def rounded(df):
    """All doubles to six places, as in the SQL."""
    return df.select(*[r6(n) if t == "double" else F.col(n) for n, t in df.dtypes])


@query("s1_log_event_time", sql("SELECT sensor_key, sec, cs, temp, pres, hum, gas, event_us FROM bme680"))
def s1(t: Tables):
    return t.log("bme680").select("sensor_key", "sec", "cs", "temp", "pres", "hum", "gas", "event_us")


@query(
    "s1_stored_log",
    sql(
        """SELECT sensor_key, event_us, temp FROM sht31
        WHERE sec // 86400 BETWEEN (SELECT min(sec) // 86400 + 3 FROM ev) AND (SELECT min(sec) // 86400 + 12 FROM ev)"""
    ),
)
def s1_stored(t: Tables):
    """Ten days of a log that was written to files by day."""
    folder = f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}"
    logs.write_log(t.log("sht31"), folder, "sht31")
    first = t.events().agg(F.min(local_day("sec"))).first()[0]
    since, until = first + timedelta(days=3), first + timedelta(days=12)
    return logs.read_log(t.spark, folder, "sht31", str(since), str(until)).select("sensor_key", "event_us", "temp")


@query(
    "s2_config_typed",
    sql("SELECT site, count(*) AS n, 1482::BIGINT AS elevation, 0.59::DOUBLE AS gas_cost FROM ev GROUP BY site"),
)
def s2(t: Tables):
    cfg = t.cfg()
    return t.events().groupBy("site").agg(F.count(F.lit(1)).alias("n")).select(
        "site",
        "n",
        config.setting(cfg, "ELEVATION", "INT").alias("elevation"),
        config.setting(cfg, "Gas_Cost", "FLOAT").alias("gas_cost"),
    )


@query(
    "s3_new_sensors",
    sql(
        """SELECT sensor_id, site, serial_code, label FROM dim UNION ALL
        SELECT (SELECT max(sensor_id) FROM dim) + row_number() OVER (ORDER BY serial_code), site, serial_code, serial_code
        FROM all_ids WHERE serial_code NOT IN (SELECT serial_code FROM dim)"""
    ),
)
def s3(t: Tables):
    return registry.upsert_sensors(t.dim(), t.sensor_ids())


@query(
    "s4_heartbeat_upsert",
    sql(
        """SELECT sensor_name, coalesce(max(n), max(o)) AS sec FROM (
          SELECT 's' || sensor_key AS sensor_name, min(sec) AS o, NULL AS n FROM ev WHERE event_type <> 'view' GROUP BY 1
          UNION ALL
          SELECT 's' || sensor_key, NULL, arg_max(sec, event_id) FROM ev WHERE event_type = 'view' GROUP BY 1)
        GROUP BY 1"""
    ),
)
def s4(t: Tables):
    ev = t.events().withColumn("sensor_name", F.concat(F.lit("s"), "sensor_key"))
    hb = ev.filter("event_type <> 'view'").groupBy("sensor_name").agg(F.min("sec").alias("sec"))
    new = ev.filter("event_type = 'view'").select("sensor_name", "sec", F.col("event_id").alias("seq"))
    return registry.upsert_heartbeats(hb, new)


@query(
    "s5_w1_text",
    sql(
        """SELECT event_id, CASE WHEN reason IS NULL THEN CAST(floor(milli / 10.0::DOUBLE) AS INTEGER) END AS temp, reason
        FROM (SELECT event_id, milli, CASE WHEN k = 77 THEN 'empty' WHEN v % 10 = 0 THEN 'crc' WHEN milli IS NULL THEN 'unreadable'
          WHEN milli = 85000 THEN 'power_on' WHEN milli < -55000 OR milli > 125000 THEN 'range' END AS reason
          FROM (SELECT event_id, v, k, CASE WHEN k = 99 THEN NULL WHEN k = 85 THEN 85000 ELSE v * 7 - 60003 END AS milli FROM ev))"""
    ),
)
def s5(t: Tables):
    v, k = F.col("v"), F.col("k")
    crc = F.when(v % 10 == 0, "NO").otherwise("YES")
    milli = F.when(k == 85, F.lit("85000")).otherwise((v * 7 - 60_003).cast("string"))
    second = F.when(k == 99, F.lit("50 05 4b 46 7f")).otherwise(F.concat(F.lit("50 05 4b 46 7f t="), milli))
    text = F.concat(F.lit("50 05 4b 46 7f : crc=1c "), crc, F.lit("\n"), second, F.lit("\n"))
    text = F.when(k != 77, text)
    return onewire.parse_w1(t.events().select("event_id", text.alias("text")), "text").select("event_id", "temp", "reason")


_SERIAL = "'28-' || lpad(lower(to_hex(sensor_key)), 12, '0')"
MESSAGES = f"""SELECT event_id, site, event_us,
  CASE WHEN event_type = 'signup' THEN 'sensors/' || {_SERIAL}
    WHEN event_type = 'click' AND k % 3 = 0 THEN 'sensors/' || CASE WHEN k % 2 = 0 THEN 'vent' ELSE 'swamp_pump' END
    WHEN event_type = 'click' AND k % 3 = 1 THEN 'act/node1'
    WHEN event_type = 'click' THEN 'hb/node1'
    WHEN k = 50 THEN 'sensors/w1/errors' WHEN k = 51 THEN 'sensors/' || {_SERIAL} || '/errors'
    WHEN k = 52 THEN 'status' ELSE 'sensors/' || {_SERIAL} || '/data' END AS topic,
  CASE WHEN event_type = 'signup' THEN 'new'
    WHEN event_type = 'click' AND k % 3 = 0 THEN CAST(v % 2 AS VARCHAR)
    WHEN event_type = 'click' AND k % 3 = 1 THEN CASE v % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'v' ELSE 'x' END
    WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR)
    WHEN k = 50 THEN 'addr CRC' WHEN k = 51 THEN 'Invalid data CRC'
    WHEN tomb THEN 'offline' ELSE CAST(v - 5000 AS VARCHAR) END AS payload FROM ev"""


def message_rows(ev):
    """Events as publish/subscribe messages."""
    v, k, kind = F.col("v"), F.col("k"), F.col("event_type")
    serial = F.concat(F.lit("sensors/28-"), F.lpad(F.lower(F.hex("sensor_key")), 12, "0"))
    click = kind == "click"
    topic = (
        F.when(kind == "signup", serial)
        .when(click & (k % 3 == 0), F.when(k % 2 == 0, "sensors/vent").otherwise("sensors/swamp_pump"))
        .when(click & (k % 3 == 1), "act/node1")
        .when(click, "hb/node1")
        .when(k == 50, "sensors/w1/errors")
        .when(k == 51, F.concat(serial, F.lit("/errors")))
        .when(k == 52, "status")
        .otherwise(F.concat(serial, F.lit("/data")))
    )
    payload = (
        F.when(kind == "signup", "new")
        .when(click & (k % 3 == 0), (v % 2).cast("string"))
        .when(click & (k % 3 == 1), F.when(v % 3 == 0, "V").when(v % 3 == 1, "v").otherwise("x"))
        .when(click, F.col("event_id").cast("string"))
        .when(k == 50, "addr CRC")
        .when(k == 51, "Invalid data CRC")
        .when(F.col("tomb"), "offline")
        .otherwise((v - 5000).cast("string"))
    )
    return ev.select("event_id", "site", "event_us", topic.alias("topic"), payload.alias("payload"))


ROUTED = """SELECT event_id, kind, CASE WHEN kind IN ('data','error','lifecycle','act','hb') THEN split_part(topic, '/', 2) END AS node,
  CASE WHEN kind IN ('data','vent','swamp_pump','hb') THEN TRY_CAST(payload AS BIGINT) END AS value,
  kind = 'data' AND payload = 'offline' AS tombstone
  FROM (SELECT *, CASE WHEN topic LIKE 'sensors/28-%/data' THEN 'data' WHEN topic LIKE 'sensors/28-%/errors' THEN 'error'
    WHEN topic LIKE 'sensors/28-%' THEN 'lifecycle' WHEN topic = 'sensors/w1/errors' THEN 'bus_error'
    WHEN topic = 'sensors/vent' THEN 'vent' WHEN topic = 'sensors/swamp_pump' THEN 'swamp_pump'
    WHEN topic LIKE 'act/%' THEN 'act' WHEN topic LIKE 'hb/%' THEN 'hb' ELSE 'other' END AS kind FROM messages)"""


@query("s6_topic_route", sql(ROUTED, messages=MESSAGES))
def s6(t: Tables):
    routed = messages.route_messages(message_rows(t.events()), "topic", "payload")
    return routed.select("event_id", "kind", "node", "value", "tombstone")


@query(
    "s7_frame_decode",
    sql(
        """SELECT event_id, 0 AS line, 0 AS pos, 'temp' AS field,
            CASE WHEN NOT tomb THEN v - 5000 END AS value, CASE WHEN tomb THEN 'null' ELSE 'ok' END AS status FROM ev
        UNION ALL SELECT event_id, 0, 1, 'hum', CASE k % 10 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 12 ELSE k END,
            CASE k % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'invalid' ELSE 'ok' END FROM ev
        UNION ALL SELECT event_id, 1, 0, 'wlan0_level', -k, 'ok' FROM ev"""
    ),
)
def s7(t: Tables):
    k = F.col("k")
    temp = F.when(F.col("tomb"), "null").otherwise((F.col("v") - 5000).cast("string"))
    hum = F.when(k % 10 == 3, "n/a").when(k % 10 == 4, "err").when(k % 10 == 5, "12abc").otherwise(k.cast("string"))
    frame = F.concat(
        F.lit("temp,hum!"), F.concat_ws(",", temp, hum), F.lit("\nwlan0_level!"), (-k).cast("string"), F.lit("\n")
    )
    out = frames.decode_frames(t.events().select("event_id", frame.alias("frame")), "frame")
    return out.select("event_id", "line", "pos", "field", "value", "status")


_WITHIN = """SELECT d.site, d.sensor_id, d.label, r.temp, r.sensor_id IS NOT NULL AS found FROM dim d LEFT JOIN (
  SELECT sensor_id, arg_max_null(temp, sec * 128 + cs) AS temp FROM ds18b20
  WHERE sec > (SELECT max(sec) FROM ev) - 86400 GROUP BY sensor_id) r ON r.sensor_id = d.sensor_id"""


def _within(t: Tables):
    return latest.latest_within(t.log("ds18b20"), t.dim(), t.now(), 86_400)


@query(
    "s8_frame_encode",
    sql(
        """SELECT site, string_agg(label, ',' ORDER BY sensor_id) || '!' || string_agg(
          CASE WHEN NOT found THEN 'n/a' WHEN temp IS NULL THEN 'null' ELSE CAST(temp AS VARCHAR) END, ',' ORDER BY sensor_id) AS frame
        FROM within_day GROUP BY site""",
        within_day=_WITHIN,
    ),
)
def s8(t: Tables):
    return frames.encode_frames(_within(t), ["site"], "sensor_id", "label", "temp", "found")


def _snapshot_sql(strict: bool) -> str:
    parts, cols = [], []
    for family, names in latest.SNAPSHOT.items():
        source = "furnace_state" if family == "furnace" else family
        picks = ", ".join(f"arg_max_null({c}, sec * 128 + cs) AS {n}" for c, n in names.items())
        parts.append(f"(SELECT site, {picks} FROM {source} GROUP BY site) USING (site)")
        cols += list(names.values())
    how = "JOIN" if strict else "LEFT JOIN"
    return f"""SELECT site, sec, 1482::BIGINT AS elevation, 400::BIGINT AS flux_area, 757::BIGINT AS exch_flow_rate,
      {", ".join(cols)} FROM (SELECT site, max(sec) AS sec FROM ev GROUP BY site) {" ".join(f"{how} {p}" for p in parts)}"""


SNAPSHOT_SQL = _snapshot_sql(False)


@query("j3_last_logs", sql(SNAPSHOT_SQL))
def j3(t: Tables):
    return latest.last_logs(t.logs(), t.cfg())


@query("j3_last_logs_strict", sql(_snapshot_sql(True)))
def j3_strict(t: Tables):
    return latest.last_logs(t.logs(), t.cfg(), strict=True)


@query(
    "s8_frame_wide",
    sql(
        """SELECT site, 'sec,tflux,furnace_ctrl,plocal!' || concat_ws(',', sec, coalesce(CAST(tflux AS VARCHAR), 'null'),
        coalesce(CAST(furnace_ctrl AS VARCHAR), 'null'), coalesce(CAST(plocal AS VARCHAR), 'null')) AS frame FROM snap""",
        snap=SNAPSHOT_SQL,
    ),
)
def s8_wide(t: Tables):
    snap = latest.last_logs(t.logs(), t.cfg())
    return frames.encode_wide(snap, ["site"], ["sec", "tflux", "furnace_ctrl", "plocal"])


@query("s9_export", sql(SNAPSHOT_SQL))
def s9(t: Tables):
    snap = latest.last_logs(t.logs(), t.cfg())
    path = f"{shared_dir(t.spark)}/export-{uuid.uuid4().hex}"
    logs.export_csv(snap, path)
    return t.spark.read.schema(snap.schema).option("header", True).csv(path)


@query(
    "s11_timestamp_codec",
    sql(
        """SELECT event_id, sec, cs, cs100, sec * 1000000 + (CAST(cs AS BIGINT) << 23) // 1000 AS tick_us,
        sec * 1000000 + cs100 * 10000 AS centi_us FROM ev"""
    ),
)
def s11(t: Tables):
    ev = t.events().select("event_id", "us")
    tick = split_event_time(ev, "us").withColumn("tick_us", event_us("sec", "cs"))
    both = split_event_time(tick.withColumnRenamed("cs", "ticks"), "us", "centi")
    return both.select(
        "event_id",
        "sec",
        F.col("ticks").alias("cs"),
        F.col("cs").alias("cs100"),
        "tick_us",
        event_us("sec", "cs", "centi").alias("centi_us"),
    )


@query(
    "s11_client_time",
    sql("SELECT event_id, strftime(make_timestamp((sec - 25200) * 1000000), '%Y-%-m-%-d   %H:%M:%S') AS shown FROM ev"),
)
def s11_client(t: Tables):
    return t.events().select("event_id", client_text("sec").alias("shown"))


@query(
    "s6_topic_name",
    sql(
        """SELECT event_id, 'sensors/28-' || lpad(lower(to_hex(event_id * 7919 + 281000000000000)), 12, '0') || '/data' AS topic FROM ev"""
    ),
)
def s6_topic(t: Tables):
    serial = F.col("event_id") * 7919 + 281_000_000_000_000
    low_first = [F.shiftright(serial, 8 * i).bitwiseAND(F.lit(255)) for i in range(6)]
    addr = [F.lit(0x28).cast("bigint"), *low_first, F.lit(0)]
    return t.events().select("event_id", messages.sensor_topic(addr, "/data").alias("topic"))


# -- views ---------------------------------------------------------------------


@query("v1_furnace_state", sql("SELECT sensor_key, sec, cs, q1, q2, furnace_ctrl, furnace_power FROM furnace_state"))
def v1(t: Tables):
    return views.furnace_state(t.log("furnace")).select(
        "sensor_key", "sec", "cs", "q1", "q2", "furnace_ctrl", "furnace_power"
    )


@query(
    "v2_light_lux",
    sql(
        """SELECT sensor_key, sec, cs, total, ired, total - ired AS white,
        round((total - ired) * 683.0::DOUBLE / 1000000.0::DOUBLE, 6) AS lux FROM tsl2591"""
    ),
)
def v2(t: Tables):
    return rounded(
        views.light_lux(t.log("tsl2591")).select("sensor_key", "sec", "cs", "total", "ired", "white", "lux")
    )


_TS = "strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp"
_TEMP = """round(temp / 100.0::DOUBLE, 6) AS celsius,
  round(temp / 100.0::DOUBLE * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE, 6) AS fahrenheit"""
_AMPS = "(irms / 100.0::DOUBLE)"

_FORMATTED = {
    "v4_flux_formatted": ("max11201b", "flux AS flux_w_per_sq_m"),
    "v5_furnace_formatted": (
        "furnace",
        """CASE furnace_ctrl WHEN 1 THEN 'on' WHEN 0 THEN 'off' END AS control_state,
        CASE furnace_power WHEN 1 THEN 'live' WHEN 0 THEN 'dead' END AS power_state""",
    ),
    "v6_bme680_formatted": (
        "bme680",
        f"""{_TEMP}, round(pres / 10.0::DOUBLE, 6) AS pressure_mbar,
        round(hum / 10.0::DOUBLE, 6) AS humidity_percent, gas AS gas_raw_kohm""",
    ),
    "v7_sht31_formatted": ("sht31", f"{_TEMP}, round(hum / 10.0::DOUBLE, 6) AS humidity_percent"),
    "v8_light_formatted": (
        "tsl2591",
        """round(total / 1e6, 6) AS ptotal_w_per_sq_m, round(ired / 1e6, 6) AS pinfrared_w_per_sq_m,
        round((total - ired) / 1e6, 6) AS pvisible_w_per_sq_m, round((total - ired) * 683e0 / 1e6, 6) AS lux""",
    ),
    "v9_uv_formatted": (
        "veml6075",
        "round(uva / 1e3, 6) AS puva_w_per_sq_m, round(uvb / 1e3, 6) AS puvb_w_per_sq_m",
    ),
    "v10_power_formatted": (
        "ina260",
        f"""vrms AS vrms_v, round({_AMPS}, 6) AS irms_a, pmean AS pmean_w, round(vrms * {_AMPS}, 6) AS papparent_w,
        round(pmean / nullif(vrms * {_AMPS}, 0), 6) AS power_factor""",
    ),
}


def _register_formatted(name: str, family: str, columns: str) -> None:
    source = "furnace_state" if family == "furnace" else family

    @query(name, sql(f"SELECT site, sensor_key, sec, cs, {_TS}, {columns} FROM {source}"))
    def formatted(t: Tables):
        return rounded(views.formatted(t.log(family), family))


for _name, (_family, _columns) in _FORMATTED.items():
    _register_formatted(_name, _family, _columns)


@query(
    "v3_ds18b20_formatted",
    sql(f"SELECT l.site, sensor_id, sec, cs, {_TS}, label, {_TEMP} FROM ds18b20 l JOIN dim USING (sensor_id)"),
)
def v3(t: Tables):
    return rounded(views.formatted(views.labeled(t.log("ds18b20"), t.dim()), "ds18b20"))


@query(
    "v11_valid_temp",
    sql(
        """SELECT event_id, CASE WHEN reason IS NULL THEN CAST(floor(milli / 10.0::DOUBLE) AS INTEGER) END AS temp, reason
        FROM (SELECT *, CASE WHEN milli = 85000 THEN 'power_on' WHEN milli < -55000 OR milli > 125000 THEN 'range' END AS reason
          FROM (SELECT event_id, CASE WHEN k = 85 THEN 85000 ELSE v * 9 - 60001 END AS milli FROM ev))"""
    ),
)
def v11(t: Tables):
    milli = F.when(F.col("k") == 85, F.lit(85_000)).otherwise(F.col("v") * 9 - 60_001)
    rows = t.events().select("event_id", milli.alias("milli"))
    return views.valid_temperature(rows, "milli").select("event_id", "temp", "reason")


# -- joins and latest rows --------------------------------------------------------


@query("j1_labeled", sql("SELECT sensor_id, sec, cs, label, temp FROM ds18b20 JOIN dim USING (sensor_id)"))
def j1(t: Tables):
    return views.labeled(t.log("ds18b20"), t.dim()).select("sensor_id", "sec", "cs", "label", "temp")


@query(
    "j2_serial_lookup",
    sql(
        """SELECT event_id, serial_code, dim.sensor_id FROM (
          SELECT event_id, '28-' || lpad(lower(to_hex(sensor_id)), 12, '0') AS serial_code FROM ds18b20)
        LEFT JOIN dim USING (serial_code)"""
    ),
)
def j2(t: Tables):
    serial = F.concat(F.lit("28-"), F.lpad(F.lower(F.hex("sensor_id")), 12, "0"))
    seen = t.log("ds18b20").select("event_id", serial.alias("serial_code"))
    return views.with_sensor_id(seen, t.dim()).select("event_id", "serial_code", "sensor_id")


@query(
    "j4_asof",
    sql(
        """SELECT p.sensor_id, p.event_id AS probe_id, l.temp FROM (
          SELECT event_id, site * 4 + (k + 1) % 4 AS sensor_id, sec * 1000 + cs100 AS t FROM ev) p
        ASOF LEFT JOIN (SELECT sensor_id, sec * 1000 + cs AS t, temp FROM ds18b20) l
          ON p.sensor_id = l.sensor_id AND p.t >= l.t"""
    ),
)
def j4(t: Tables):
    # At every event, the reading then in force at the next thermometer.
    probes = t.events().select(
        (F.col("site") * 4 + (F.col("k") + 1) % 4).alias("sensor_id"),
        "sec",
        F.col("cs100").alias("cs"),
        F.col("event_id").alias("probe_id"),
    )
    return changelog.asof(t.log("ds18b20"), probes, ["sensor_id"], ["temp"]).select("sensor_id", "probe_id", "temp")


@query(
    "j5_disappeared",
    sql(
        """SELECT sensor_key, day + 1 AS day FROM present p WHERE day < (SELECT max(day) FROM present)
        AND NOT EXISTS (SELECT 1 FROM present q WHERE q.sensor_key = p.sensor_key AND q.day = p.day + 1)""",
        present="SELECT DISTINCT sensor_key, sec // 86400 AS day FROM ev WHERE NOT tomb",
    ),
)
def j5(t: Tables):
    present = t.events().filter("NOT tomb").select("sensor_key", idiv("sec", 86_400).alias("day"))
    last = present.agg(F.max("day")).scalar()
    before = present.filter(F.col("day") < last).withColumn("day", F.col("day") + 1)
    return changelog.disappeared(before, present, ["sensor_key", "day"])


@query(
    "t1_latest",
    sql(
        """SELECT sensor_key, max(sec) AS sec, arg_max(cs, sec * 128 + cs) AS cs, arg_max_null(temp, sec * 128 + cs) AS temp,
        arg_max_null(pres, sec * 128 + cs) AS pres FROM bme680 GROUP BY sensor_key"""
    ),
)
def t1(t: Tables):
    return latest.latest(t.log("bme680"), ["sensor_key"], ["temp", "pres"])


_TIMES = " UNION ".join(
    f"SELECT * FROM (SELECT sec, cs FROM {f} ORDER BY sec DESC, cs DESC LIMIT 1)"
    for f in ("ds18b20", "max11201b", "furnace", "bme680", "sht31", "tsl2591", "veml6075", "ina260")
)


@query("t2_last_log_times", sql(_TIMES))
def t2(t: Tables):
    return latest.last_log_times(list(t.logs().values()))


@query("t3_last_log_time", sql(f"SELECT sec, cs FROM ({_TIMES}) ORDER BY sec DESC, cs DESC LIMIT 1"))
def t3(t: Tables):
    return latest.last_log_time(list(t.logs().values()))


@query("t4_last_log_sec", sql("SELECT max(sec) AS sec FROM ev"))
def t4(t: Tables):
    return latest.last_log_sec(list(t.logs().values()))


@query("t5_latest_hour", sql(_WITHIN))
def t5(t: Tables):
    return _within(t)


@query(
    "t7_pivot_labels",
    sql(
        "SELECT site, "
        + ", ".join(f"max(temp) FILTER (WHERE label = '{x}') AS {x}" for x in LABELS)
        + """ FROM (SELECT d.site, label, arg_max_null(temp, sec * 128 + cs) AS temp FROM ds18b20 JOIN dim d USING (sensor_id)
        GROUP BY 1, 2) GROUP BY site"""
    ),
)
def t7(t: Tables):
    newest = latest.latest(t.log("ds18b20"), ["sensor_id"], ["temp"])
    return latest.pivot_labels(newest.join(t.dim(), "sensor_id"), list(LABELS))


def flagship(t: Tables):
    """Latest reading of every sensor, labelled and in display units."""
    newest = latest.latest(t.log("ds18b20"), ["sensor_id"], ["temp"])
    return rounded(views.formatted(views.labeled(newest, t.dim()), "ds18b20"))


query(
    "t1_latest_formatted",
    sql(
        f"""SELECT sensor_id, sec, cs, {_TS}, label, {_TEMP} FROM (SELECT sensor_id, max(sec) AS sec,
        arg_max(cs, sec * 128 + cs) AS cs, arg_max_null(temp, sec * 128 + cs) AS temp FROM ds18b20 GROUP BY sensor_id)
        JOIN dim USING (sensor_id)"""
    ),
)(flagship)
