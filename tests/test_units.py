"""Hand-checked values and the edge rules of the data model."""

import pytest
from pyspark.sql import functions as F

from holdline.functions import scalars, times
from holdline.model import FAMILIES
from holdline.operators import calibrate, changelog, derive, latest, scan, views
from holdline.sources import config


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row[0] if len(row) == 1 else row


def test_checksums(spark):
    lit = F.lit
    assert one(spark, c=scalars.crc8_word(lit(0xBE), lit(0xEF))) == 0x92
    assert one(spark, c=scalars.crc8_word(lit(0), lit(0))) == 0x81
    # A device address: family 0x28 and its serial; the ROM's last byte.
    rom = [0x02, 0x1C, 0xB8, 0x01, 0x00, 0x00, 0x00]
    assert one(spark, c=scalars.crc1w([lit(b) for b in rom])) == 0xA2


def test_time_codec(spark):
    assert one(spark, c=times.cs_of(F.lit(999_999))) == 119
    assert one(spark, c=times.cs_of(F.lit(999_999), "centi")) == 99
    assert one(spark, c=times.event_us(F.lit(5), F.lit(119))) == 5_998_244
    assert one(spark, c=times.sec_of(F.lit(-1))) == -1
    with pytest.raises(ValueError):
        times.event_us(F.lit(0), F.lit(0), "days")


def test_time_texts_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        sec = F.lit(1_704_067_205)
        assert one(spark, c=times.local_text(sec)) == "2024-01-01 00:00:05"
        assert one(spark, c=times.local_text(sec, "America/Denver")) == "2023-12-31 17:00:05"
        assert one(spark, c=times.client_text(sec)) == "2023-12-31   17:00:05"
        # The last Sunday of March has 23 hours in Berlin.
        day = F.lit("2024-03-31").cast("date")
        start = times.day_start_sec(day, "Europe/Berlin")
        end = times.day_start_sec(F.date_add(day, 1), "Europe/Berlin")
        assert one(spark, c=end - start) == 23 * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_temperature_rules(spark):
    df = spark.createDataFrame([(85_000,), (125_001,), (-55_000,), (-15,), (None,)], "m int")
    got = {r.m: (r.temp, r.reason) for r in views.valid_temperature(df, "m").collect()}
    assert got == {
        -55_000: (-5500, None), -15: (-2, None), 85_000: (None, "power_on"), 125_001: (None, "range"), None: (None, "unreadable"),
    }


def test_furnace_state_has_three_values(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (None, 0), (None, 1)], "q1 int, q2 int")
    got = [(r.furnace_ctrl, r.furnace_power) for r in views.furnace_state(df).collect()]
    assert got == [(1, 1), (0, 1), (0, 0), (None, 1), (0, None)]


def test_power_factor_without_load(spark):
    log = spark.createDataFrame([(1, 1, 0, 120, 0, 0)], "sensor_key long, sec long, cs int, vrms int, irms int, pmean int")
    assert views.formatted(log, "ina260").first().power_factor is None
    raw = spark.createDataFrame([(120.0, 0.0, 0.0, True), (120.0, 1.0, 60.0, True), (120.0, 1.0, 60.0, False)],
                                "vrms double, irms double, pmean double, ok boolean")
    assert [r.pf for r in calibrate.power_factor(raw).collect()] == [1.0, 0.5]


def test_humidity_chip_range(spark):
    zero = (0, 0, 0x81, 0, 0, 0x81)
    missing = [tuple(None if i == k else b for i, b in enumerate(zero)) for k in range(6)]
    raw = spark.createDataFrame([zero, (255, 255, 0xAC, 255, 255, 0xAC), (0, 0, 0x80, 0, 0, 0x81), *missing],
                                "b0 int, b1 int, b2 int, b3 int, b4 int, b5 int")
    got = calibrate.sht31(raw).collect()
    # In quarter hundredths: -45 and 130 degrees, past the reach of 32-bit products.
    assert sorted(r.temp for r in got if r.reason is None) == [-18_000, 52_000]
    assert [(r.temp, r.hum, r.reason) for r in got[2:]] == [(None, None, "crc")] * 7


def test_signed_registers(spark):
    assert one(spark, c=calibrate.signed(F.lit(0xFFFFFF), 24)) == -1
    assert one(spark, c=calibrate.signed(F.lit(0x8000), 16)) == -32768
    assert calibrate.FLUX_WARMUP == 249


def test_asof_sees_tombstones(spark):
    log = spark.createDataFrame([(1, 10, 0, 5), (1, 20, 0, None)], "k int, sec long, cs int, temp int")
    probes = spark.createDataFrame([(1, 5, 0, 1), (1, 15, 0, 2), (1, 20, 0, 3), (1, 25, 0, 4), (2, 25, 0, 5)],
                                   "k int, sec long, cs int, probe_id long")
    got = {r.probe_id: r.temp for r in changelog.asof(log, probes, ["k"], ["temp"]).collect()}
    assert got == {1: None, 2: 5, 3: None, 4: None, 5: None}


def test_collisions(spark):
    df = spark.createDataFrame([(1, 7, 0), (1, 7, 1), (1, 8, 2)], "k int, t long, i int")
    got = sorted((r.i, r.slot) for r in scan.uniquify(df, ["k"], "t", ["i"]).collect())
    assert got == [(0, 7), (1, 8), (2, 9)]


def test_intervals_close_at_tombstones(spark):
    log = spark.createDataFrame([(1, 10, 5), (1, 20, None), (1, 30, 6)], "k int, event_us long, temp int")
    got = [tuple(r) for r in changelog.intervals(log, ["k"], ["temp"], 99).orderBy("start_us").collect()]
    assert got == [(1, 10, 20, 5), (1, 30, 99, 6)]


def test_shutdown_carries_over_the_second(spark):
    dim = spark.createDataFrame([(3,)], "sensor_id long")
    assert tuple(changelog.shutdown_tombstones(dim, 10, 99).first()) == (11, 0, 3, None)
    assert tuple(changelog.shutdown_tombstones(dim, 10, 5).first()) == (10, 6, 3, None)


def test_settings(spark):
    cfg = config.default_config(spark)
    assert config.config_value(cfg, "ELEVATION", "INT").first().value == 1482
    for name, kind in (("nothing", "INT"), ("elevation", "FLOAT")):
        with pytest.raises(Exception, match=name):
            config.config_value(cfg, name, kind).collect()


def test_empty_logs_have_a_time(spark):
    empty = spark.createDataFrame([], "sec long, cs int")
    assert tuple(latest.last_log_time([empty, empty]).first()) == (0, 0)
    assert latest.last_log_sec([empty]).first().sec == 0
    assert latest.last_log_times([empty]).count() == 0


def test_a_missing_family_empties_only_the_strict_snapshot(spark):
    logs = {}
    for f in FAMILIES.values():
        cols = ", ".join(f"{n} {t.simpleString()}" for n, t in f.channels)
        rows = [(s, 10 + s, 0, *[1] * len(f.channels)) for s in (1, 2) if (s, f.name) != (2, "sht31")]
        logs[f.name] = spark.createDataFrame(rows, f"site long, sec long, cs int, {cols}")
    cfg = config.default_config(spark)
    loose = {r.site: r.hum_out for r in latest.last_logs(logs, cfg).collect()}
    assert loose == {1: 1, 2: None}
    assert [r.site for r in latest.last_logs(logs, cfg, strict=True).collect()] == [1]


def test_missing_outdoor_temperature_gives_no_pressure(spark):
    snap = spark.createDataFrame([(8400, None), (8400, 2000)], "plocal int, fencepost int")
    got = [r.psea for r in derive.sea_level_pressure(snap, config.default_config(spark)).collect()]
    assert got[0] is None and got[1] == pytest.approx(840.0 * (1 - 9.633 / (20 + 9.633 + 273.15)) ** -5.257)


def test_unknown_light_stays_unknown(spark):
    snap = spark.createDataFrame([(None, 5, 1, 1), (3, 5, 1, 1)], "vis_ir long, ired long, uva int, uvb int")
    got = [(r.vis_w, r.lux) for r in derive.light_totals(snap).collect()]
    assert got == [(None, None), (0.0, 0.0)]


def test_heartbeats_follow_the_chain(spark):
    def walk(samples):
        last, beat = None, None
        for sec, rec in samples:
            if rec:
                last, beat = sec, None
            elif last is not None and sec - max(last, beat or 0) > 5:
                beat = sec
        return beat

    import random

    rng = random.Random(8)
    data = {}
    for k in range(40):
        secs = sorted(rng.sample(range(1000, 1000 + rng.choice([60, 400, 300_000])), rng.randint(2, 60)))
        data[k] = [(s, i == 0 or rng.random() < 0.03) for i, s in enumerate(secs)]
    df = spark.createDataFrame([(k, s, r) for k, xs in data.items() for s, r in xs], "k int, sec long, recorded boolean")
    got = {r.k: r.sec for r in changelog.idle_heartbeats(df, ["k"]).collect()}
    assert got == {k: walk(xs) for k, xs in data.items()}


def test_tombstones_of_failed_readings(spark):
    good = [(1, 1, 40, None), (1, 3, 40, None), (1, 4, 40, None), (1, 7, 80, None)]
    bad = [(1, t, None, "crc") for t in (0, 2, 5, 6)]
    rows = spark.createDataFrame(good + bad, "k int, t int, x int, reason string")
    got = [(r.t, r.x) for r in scan.record_log(rows, ["k"], ["t"], ["x"]).orderBy("t").collect()]
    assert got == [(1, 10), (2, None), (3, 10), (5, None), (7, 20)]


def test_bursts_need_whole_cycles(spark):
    wave = [-1, 3, 3, -3, -3, 4, 4, -4, -4, 5]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(wave)] + [(2, i, x) for i, x in enumerate(wave[:-1])],
                               "b int, i int, raw int")
    got = {r.b: (r.ok, r.rms) for r in calibrate.burst_rms(df, ["b"], "i", scale=1.0).collect()}
    assert got == {1: (True, pytest.approx(12.5**0.5)), 2: (False, 0.0)}


def refused_sessions(sessions):
    """One after the other: (session, first, last) of a key."""
    top, out = None, set()
    for session, first, last in sorted(sessions):
        if top is not None and first < top:
            out.add(session)
        else:
            top = last
    return out


def test_clock_guard_depends_on_what_was_accepted(spark):
    import random

    rng = random.Random(12)
    data = {}
    for k in range(60):
        at, sessions = 1000, []
        for i in range(rng.choice([1, 2, 3, 9, 70])):
            at += rng.randint(0, 40)
            first = at + rng.choice([0, 0, 0, -30, -90, 60, 400, 5000])
            sessions.append((i, first, first + rng.randint(0, 50)))
        data[k] = sessions
    # An hour ahead once refuses all that follow, until the time is reached.
    data[99] = [(0, 10, 20), (1, 3600, 3700), (2, 30, 40), (3, 3690, 3695), (4, 3700, 3701), (5, 50, 60)]
    rows = [(k, s, t, 0) for k, xs in data.items() for s, a, b in xs for t in {a, b}]
    df = spark.createDataFrame(rows, "k int, session int, sec long, cs int")
    got = changelog.clock_guard(df, ["k"], "session").collect()
    assert len(got) == len(rows)
    assert {(r.k, r.session) for r in got if r.refused} == {(k, s) for k, xs in data.items() for s in refused_sessions(xs)}
    assert refused_sessions(data[99]) == {2, 3, 5}


def test_stamps_move_over_the_second(spark):
    rows = [(1, 7, 118, i) for i in range(5)] + [(1, 8, 0, 9), (2, 7, 118, 0)]
    df = spark.createDataFrame(rows, "k int, sec long, cs int, i int")
    got = sorted((r.k, r.i, r.sec, r.cs, r.dropped) for r in scan.uniquify_stamps(df, ["k"], ["i"], 4).collect())
    assert got == [
        (1, 0, 7, 118, False), (1, 1, 7, 119, False), (1, 2, 8, 0, False), (1, 3, 8, 1, False), (1, 4, 7, 118, True),
        (1, 9, 8, 2, False), (2, 0, 7, 118, False),
    ]


def test_presence_log_and_reads_of_it(spark):
    scans = spark.createDataFrame([(1, n, 10 * n + 9, 0) for n in range(1, 6)], "site int, scan int, sec long, cs int")
    # Sensor 4 is missing from scans 2 and 3; sensor 5 answers in the first only; nothing does in scan 3.
    rows = [(1, 4, 1, 11, 0, 20), (1, 4, 4, 41, 0, 20), (1, 4, 5, 51, 0, 20), (1, 5, 1, 12, 0, 7), (1, 6, 2, 21, 0, 1)]
    readings = spark.createDataFrame(rows, "site int, k int, scan int, sec long, cs int, temp int")
    log = changelog.presence_log(readings, scans, "site", "k", "scan", ["temp"])
    got = sorted((r.k, r.sec, r.temp) for r in log.collect())
    assert got == [(4, 11, 20), (4, 29, None), (4, 41, 20), (5, 12, 7), (5, 29, None), (6, 21, 1), (6, 39, None)]
    probes = spark.createDataFrame([(4, 28, 0, 1), (4, 35, 0, 2), (4, 60, 0, 3)], "k int, sec long, cs int, probe_id int")
    found = changelog.asof(log.select("k", "sec", "cs", "temp"), probes, ["k"], ["temp"])
    assert sorted((r.probe_id, r.temp) for r in found.collect()) == [(1, 20), (2, None), (3, 20)]


def test_long_silences_make_no_long_arrays(spark):
    from holdline.operators import cost

    year = 700_000  # 4 of them are more than two levels of 1,024
    log = spark.createDataFrame([(1, 500_000, 5), (1, 4 * year * 1_000_000 + 250_000, 9)], "k int, event_us long, x int")
    out = cost.time_weighted(log, ["k"], "x", 1, 4 * year * 1_000_000 + 750_000)
    total = out.agg(F.count("*"), F.sum("coverage"), F.sum(F.col("mean") * F.col("coverage"))).first()
    assert tuple(total) == (4 * year + 1, 4 * year + 0.25, 5.0 * (4 * year - 0.25) + 9 * 0.5)
    cut = {r.bucket: tuple(r) for r in out.filter(f"bucket IN (0, 1, {4 * year})").collect()}
    assert cut[0] == (1, 0, 5.0, 5, 5, 0.5) and cut[1] == (1, 1, 5.0, 5, 5, 1.0)
    assert cut[4 * year] == (1, 4 * year, pytest.approx((0.25 * 5 + 0.5 * 9) / 0.75), 5, 9, 0.75)


def test_heartbeats_over_many_years(spark):
    """Blocks of days are chained as days are."""
    import random

    rng = random.Random(3)
    secs = sorted({rng.randrange(200 * 365) * 86_400 + rng.choice([0, 86_397, 86_399, 3, 7]) for _ in range(3000)})
    beat = secs[0]
    for s in secs[1:]:
        beat = s if s - beat > 5 else beat
    df = spark.createDataFrame([(1, s, i == 0) for i, s in enumerate(secs)], "k int, sec long, recorded boolean")
    assert changelog.idle_heartbeats(df, ["k"]).first().sec == beat


def test_a_stall_hides_what_was_known(spark):
    minute = 60_000_000
    rows = [(1, 0, "vent", None, "1"), (1, minute, "act", "n", "V"), (1, 2 * minute, "hb", "n", "1"), (1, 9 * minute, "hb", "n", "2"),
            (1, 10 * minute, "vent", None, "0"), (1, 11 * minute, "data", "s1", "2050"), (1, 12 * minute, "data", "s1", "offline")]
    routed = spark.createDataFrame(rows, "site int, arrival_us long, kind string, node string, payload string")
    out = derive.known_states(routed, ["site"], 13 * minute, 90, F.lit("s1"))
    got = sorted((r.field, r.start_us // minute, r.end_us and r.end_us // minute, r.state) for r in out.collect())
    assert got == [("swamp", 11, 12, 2050), ("vent", 0, 2, 1), ("vent", 9, 10, 1), ("vent", 10, None, 0), ("vent_sys", 1, None, 1)]
