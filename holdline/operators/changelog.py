"""Change logs: building them, their gaps, intervals and as-of reads."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdline.functions.scalars import differs, join_on
from holdline.functions.times import TICKS_PER_SECOND, when_key
from holdline.operators.history import History
from holdline.session import materialize

ORDER = ["sec", "cs"]
DAY = 86_400
BLOCK_DAYS = 256


def is_known(cols: list[str]) -> Column:
    """False on a tombstone, where every channel is NULL."""
    return reduce(operator.or_, [F.col(c).isNotNull() for c in cols])


def change_only(
    df: DataFrame,
    key: list[str],
    cols: list[str],
    initial: dict[str, object] | None = None,
    order: list[str] = ORDER,
) -> DataFrame:
    """Rows where a channel differs from the row before. Before the first row the
    channels are ``initial``, by default unknown."""
    initial = initial or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    start = F.struct(*[F.lit(initial.get(c)).cast(types[c]).alias(c) for c in cols])
    h = History.of(df, key, order).previous("__prev", F.struct(*cols), start)
    changed = differs([F.col(c) for c in cols], [F.col(f"__prev.{c}") for c in cols])
    return h.filter(changed).drop("__prev").rows()


def lifecycle(scans: DataFrame, site: str, key: str, scan: str) -> DataFrame:
    """Presence events of a scanned bus: ``appeared`` in the first scan a sensor is
    in, ``disappeared`` in the first it is missing from. Events: site, key, scan,
    event. A disappearance is where the log gets its tombstone."""
    seen = scans.groupBy(site, key, scan).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    clock = History.of(seen.select(site, scan).distinct(), [site], [scan])
    clock = clock.previous("__before", F.col(scan)).following("__after", F.col(scan)).rows()
    at = join_on(seen, clock, [site, scan], "inner")
    h = History.of(at, [site, key], [scan]).previous("__was", F.col(scan)).following("__will", F.col(scan))
    came = F.when(
        F.col("__was").isNull() | ~F.col("__was").eqNullSafe(F.col("__before")),
        F.struct(F.col(scan).alias(scan), F.lit("appeared").alias("event")),
    )
    gone = F.when(
        F.col("__after").isNotNull() & ~F.col("__will").eqNullSafe(F.col("__after")),
        F.struct(F.col("__after").alias(scan), F.lit("disappeared").alias("event")),
    )
    events = h.rows().select(site, key, F.explode(F.array_compact(F.array(came, gone))).alias("e"))
    return events.select(site, key, "e.*")


def presence_log(
    readings: DataFrame, scans: DataFrame, site: str, key: str, scan: str, cols: list[str], order: list[str] = ORDER
) -> DataFrame:
    """The change log of a scanned bus, tombstones included.

    ``readings`` has a row for every sensor that answered in a scan, with ``cols`` and the
    time it was read; ``scans`` one for every finished scan of a site, with its time, also
    of one that nothing answered in. A reading is logged when it differs from the one
    before, or when the sensor was missing from the scan before; a sensor missing from a
    scan for the first time gets a row of NULLs at the end of that scan.
    """
    clock = History.of(scans.select(site, scan, *order), [site], [scan])
    clock = clock.previous("__before", F.col(scan)).following("__after", F.struct(scan, *order)).rows()
    clock = clock.select(site, scan, "__before", "__after")
    at = join_on(readings.select(site, key, scan, *order, *cols), clock, [site, scan], "inner")
    h = History.of(at, [site, key], [scan]).previous("__was", F.struct(scan, *cols)).following("__will", F.col(scan))
    came = F.col("__was").isNull() | ~F.col(f"__was.{scan}").eqNullSafe(F.col("__before"))
    changed = differs([F.col(c) for c in cols], [F.col(f"__was.{c}") for c in cols])
    gone = F.col("__after").isNotNull() & ~F.col("__will").eqNullSafe(F.col(f"__after.{scan}"))
    types = dict(readings.dtypes)
    value = F.struct(*order, *cols)
    stone = F.struct(
        *[F.col(f"__after.{c}").cast(types[c]).alias(c) for c in order],
        *[F.lit(None).cast(types[c]).alias(c) for c in cols],
    )
    both = F.array_compact(F.array(F.when(came | changed, value), F.when(gone, stone)))
    return h.rows().select(site, key, F.inline(both))


# Fixed values of the two user bytes in a sensor's scratchpad.
ONLINE_BYTE, RESET_BYTE = 0xFF, 0x00


def attach_events(scans: DataFrame, site: str, key: str, scan: str, byte_a: str, byte_b: str) -> DataFrame:
    """Lifecycle as a bus master reports it: ``new`` or ``attached`` while the user
    bytes show a power reset, ``reappeared`` after a missed scan, ``offline`` in
    the first missed scan. One row per sensor and scan goes in."""
    clock = History.of(scans.select(site, scan).distinct(), [site], [scan])
    clock = clock.previous("__before", F.col(scan)).following("__after", F.col(scan)).rows()
    at = join_on(scans.select(site, key, scan, byte_a, byte_b), clock, [site, scan], "inner")
    h = History.of(at, [site, key], [scan]).previous("__was", F.col(scan)).following("__will", F.col(scan))

    def both(value: int) -> Column:
        return (F.col(byte_a) == value) & (F.col(byte_b) == value)

    missed = F.col("__was").isNull() | ~F.col("__was").eqNullSafe(F.col("__before"))
    state = (
        F.when(~both(ONLINE_BYTE) & ~both(RESET_BYTE), "new")
        .when(~both(ONLINE_BYTE), "attached")
        .when(missed, "reappeared")
    )
    here = F.when(state.isNotNull(), F.struct(F.col(scan).alias(scan), state.alias("event")))
    gone = F.when(
        F.col("__after").isNotNull() & ~F.col("__will").eqNullSafe(F.col("__after")),
        F.struct(F.col("__after").alias(scan), F.lit("offline").alias("event")),
    )
    events = h.rows().select(site, key, F.explode(F.array_compact(F.array(here, gone))).alias("e"))
    return events.select(site, key, "e.*")


def disappeared(prev: DataFrame, cur: DataFrame, key: list[str]) -> DataFrame:
    """Sensors of the previous scan that are missing from the current one."""
    return join_on(prev.select(*key).distinct(), cur.select(*key), key, "left_anti")


def _successors(rows: DataFrame, part: list[str], longest: int) -> DataFrame:
    """Add ``__next``: the place of the first later row of ``part`` whose ``__first`` is
    not before this row's ``__last``, NULL if there is none. ``__at`` numbers the rows of a
    part from 1; ``longest`` is the largest part.

    Maxima of ``__first`` over 1, 2, 4, ... rows come from doubling; from the longest
    stretch down, those in which no row qualifies are jumped over.
    """
    w = Window.partitionBy(*part).orderBy("__at")
    reach, tops = 1, ["__m0"]
    rows = rows.withColumn("__m0", F.col("__first"))
    while 2 * reach < longest:
        new = f"__m{len(tops)}"
        rows = rows.withColumn(new, F.greatest(F.col(tops[-1]), F.lead(tops[-1], reach).over(w)))
        tops, reach = [*tops, new], 2 * reach
    rows = materialize(rows)
    found = rows.select(*part, "__at", "__last", (F.col("__at") + 1).alias("__next"))
    for k in range(len(tops) - 1, -1, -1):
        there = rows.select(*part, F.col("__at").alias("__next"), F.col(tops[k]).alias("__top"))
        found = join_on(found, there, [*part, "__next"], "left")
        skip = F.coalesce(F.col("__top") < F.col("__last"), F.lit(False))
        found = found.withColumn("__next", F.when(skip, F.col("__next") + (1 << k)).otherwise(F.col("__next")))
        found = found.drop("__top")
    return found.select(*part, "__at", "__next")


def clock_guard(df: DataFrame, key: list[str], session: str) -> DataFrame:
    """Rows with ``refused``: the session began before the newest time that an accepted
    session of the same key had logged. A refused session logs nothing, so it refuses none.

    A session that begins after all earlier ones ended is accepted in any case. Between
    two of these, each accepted session has a successor: the next one that begins at or
    after its end. Following the successors, twice as far every time, gives all of them.
    Only sessions that a wrong clock involves take part in that, one small row each.
    """
    ends = df.groupBy(*key, session).agg(
        F.min(when_key()).alias("__first"), F.max(when_key()).alias("__last")
    )
    h = History.of(ends, key, [session]).running_max("__top", F.col("__last"), inclusive=False)
    sure = F.col("__top").isNull() | (F.col("__first") >= F.col("__top"))
    h = h.with_columns(__sure=sure).running_sum("__stretch", F.col("__sure").cast("bigint"))
    part = [*key, "__stretch"]
    rows = materialize(h.rows().withColumn("__at", F.row_number().over(Window.partitionBy(*part).orderBy(session))))
    longest = rows.agg(F.max("__at")).first()[0] or 0
    accepted = rows.filter("__at = 1").select(*part, "__at")
    if longest > 1:
        doubtful = join_on(rows, rows.filter("__at = 2").select(*part), part, "left_semi")
        step = materialize(_successors(doubtful, part, longest))
        reach = 1
        while reach < longest:
            onward = step.filter(F.col("__next").isNotNull())
            more = join_on(accepted, onward, [*part, "__at"], "inner").select(*part, F.col("__next").alias("__at"))
            accepted = accepted.unionByName(more).distinct()
            far = onward.select(*part, F.col("__at").alias("__next"), F.col("__next").alias("__then"))
            step = join_on(step, far, [*part, "__next"], "left").select(*part, "__at", F.col("__then").alias("__next"))
            reach *= 2
            accepted, step = materialize(accepted), materialize(step)
    rows = join_on(rows, accepted.withColumn("__taken", F.lit(True)), [*part, "__at"], "left")
    flags = rows.select(*key, session, F.col("__taken").isNull().alias("refused"))
    return join_on(df, flags, [*key, session], "inner")


def _next_tick(sec: Column, cs: Column, per_second: int) -> tuple[Column, Column]:
    wrap = cs + 1 >= per_second
    return F.when(wrap, sec + 1).otherwise(sec), F.when(wrap, F.lit(0)).otherwise(cs + 1).cast("int")


def restart_tombstones(
    log: DataFrame,
    key: list[str],
    cols: list[str],
    session: str,
    heartbeats: DataFrame,
    per_second: int = TICKS_PER_SECOND,
) -> DataFrame:
    """Tombstones for the time between sessions: where a session follows a known
    record, one tick after that record or after the heartbeat standing at the
    session start (``heartbeats``: key, session, ``sec``), whichever is later."""
    h = History.of(log, key, ORDER).previous("__p", F.struct(session, *ORDER, *cols))
    known = F.greatest(*[F.col(f"__p.{c}").isNotNull().cast("int") for c in cols], F.lit(0)) == 1
    starts = h.filter((F.col(f"__p.{session}") != F.col(session)) & known).rows()
    beat = heartbeats.select(*key, session, F.col("sec").alias("__hb"))
    starts = join_on(starts, beat, [*key, session], "left")
    from_hb = F.coalesce(F.col("__hb") > F.col("__p.sec"), F.lit(False))
    sec = F.when(from_hb, F.col("__hb")).otherwise(F.col("__p.sec"))
    cs = F.when(from_hb, F.lit(0)).otherwise(F.col("__p.cs"))
    sec, cs = _next_tick(sec, cs, per_second)
    types = {f.name: f.dataType for f in log.schema.fields}
    stones = starts.select(
        *key, sec.alias("t_sec"), cs.alias("t_cs"), when_key().alias("__start"),
        *[F.lit(None).cast(types[c]).alias(c) for c in cols],
    )
    before = F.col("t_sec") * 128 + F.col("t_cs") < F.col("__start")
    return stones.filter(before).select(*key, F.col("t_sec").alias("sec"), F.col("t_cs").alias("cs"), *cols)


def shutdown_tombstones(dim: DataFrame, now_sec: Column | int, now_cs: Column | int) -> DataFrame:
    """A NULL record for every known sensor, one hundredth after ``now``."""
    sec, cs = _next_tick(F.lit(now_sec).cast("bigint"), F.lit(now_cs), 100)
    return dim.select(
        sec.alias("sec"), cs.alias("cs"), "sensor_id", F.lit(None).cast("int").alias("temp")
    )


def idle_heartbeats(samples: DataFrame, key: list[str], period: int = 5) -> DataFrame:
    """The heartbeat standing at the end: while readings stay unchanged, one is
    written when record and heartbeat are more than ``period`` seconds old.

    ``samples`` has ``sec`` and ``recorded`` (the reading changed and was logged).
    NULL when no heartbeat followed the last record. A heartbeat chain depends on
    its start only through how many seconds ago that was, so each day of distinct
    seconds (at most 86,400) is folded once per possible start; so are blocks of 256 days,
    and then the blocks of a key, of which 179 idle years have 256.
    """
    recs = samples.filter("recorded").groupBy(*key).agg(F.max("sec").alias("__rec"))
    idle = join_on(samples.select(*key, "sec"), recs, key, "inner").filter(F.col("sec") > F.col("__rec"))
    day = F.expr(f"(sec - __rec - 1) div {DAY}")
    days = idle.groupBy(*key, "__rec", day.alias("__day")).agg(F.sort_array(F.collect_set("sec")).alias("__secs"))
    origin = F.col("__rec") + 1 + F.col("__day") * DAY

    def beat(start: Column) -> Column:
        return F.aggregate("__secs", start, lambda h, t: F.when(t - h > period, t).otherwise(h))

    after = F.array(*[beat(origin - age) for age in range(1, period + 2)])
    maps = days.select(*key, "__rec", "__day", F.struct(origin.alias("o"), after.alias("after")).alias("__map"))

    def chain(h: Column, m: Column) -> Column:
        age = F.least(m["o"] - h, F.lit(period + 1)).cast("int")
        ended = F.get(m["after"], age - 1)
        return F.when(ended >= m["o"], ended).otherwise(h)

    # Days in a row make up one map as well: what each start has become after them.
    def joint(a: Column, m: Column) -> Column:
        return F.struct(a["o"].alias("o"), F.transform(a["after"], lambda h: chain(h, m)).alias("after"))

    blocks = maps.groupBy(*key, "__rec", F.expr(f"__day div {BLOCK_DAYS}")).agg(
        F.sort_array(F.collect_list("__map")).alias("__maps")
    )
    joined = F.aggregate(F.slice("__maps", 2, BLOCK_DAYS), F.get("__maps", F.lit(0)), joint)
    blocks = blocks.select(*key, "__rec", joined.alias("__map"))
    per_key = blocks.groupBy(*key, "__rec").agg(F.sort_array(F.collect_list("__map")).alias("__maps"))
    last = F.aggregate("__maps", F.col("__rec"), chain)
    beats = per_key.select(*key, F.when(last > F.col("__rec"), last).alias("sec"))
    return join_on(recs.select(*key), beats, key, "left")


def dead_sensors(log: DataFrame, hb: DataFrame, now: Column | int, key: list[str], cols: list[str], period: int = 5) -> DataFrame:
    """Sensors whose last record is known while it and the heartbeat (``hb``: key,
    ``sec``) are both more than ``period`` seconds old."""
    last = log.groupBy(*key).agg(
        F.max("sec").alias("sec"), *[F.max_by(c, when_key()).alias(c) for c in cols]
    )
    both = join_on(last, hb.select(*key, F.col("sec").alias("hb_sec")), key, "left")
    quiet = F.lit(now) - F.greatest("sec", F.coalesce("hb_sec", F.lit(0))) > period
    return both.filter(is_known(cols) & quiet).select(*key, "sec", "hb_sec")


def intervals(
    log: DataFrame, key: list[str], cols: list[str], horizon_us: Column | int | None = None
) -> DataFrame:
    """``[start_us, end_us)`` per row of a log with ``event_us``; the last one ends
    at ``horizon_us`` (NULL: open). Tombstones close the interval before them and
    start none."""
    horizon = horizon_us if isinstance(horizon_us, Column) else F.lit(horizon_us).cast("bigint")
    h = History.of(log, key, ["event_us"]).following("end_us", F.col("event_us"))
    rows = h.filter(is_known(cols)).rows()
    return rows.select(
        *key, F.col("event_us").alias("start_us"), F.coalesce("end_us", horizon).alias("end_us"), *cols
    )


def gaps(
    log: DataFrame, key: list[str], cols: list[str], threshold_us: int, now_us: Column | int
) -> DataFrame:
    """Spans in which a sensor is ``unknown`` (a tombstone holds) or ``silent``
    (known, but without a row for longer than the threshold). A span that lasts at
    ``now_us`` has no end."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us).cast("bigint")
    h = History.of(log, key, ["event_us"]).following("end_us", F.col("event_us"))
    kind = F.when(~is_known(cols), "unknown").when(
        F.coalesce("end_us", now) - F.col("event_us") > threshold_us, "silent"
    )
    rows = h.rows().select(*key, F.col("event_us").alias("start_us"), "end_us", kind.alias("kind"))
    return rows.filter(F.col("kind").isNotNull())


def asof(log: DataFrame, probes: DataFrame, key: list[str], cols: list[str], order: list[str] = ORDER,
         probe_id: str = "probe_id", keep: list[str] = []) -> DataFrame:
    """For every probe the record in force at its time, and the probe's own columns
    ``keep``. A tombstone in force gives NULLs. ``probe_id`` is unique per key. One pass
    over log and probes together; no range join."""
    types = {f.name: f.dataType for f in [*log.schema.fields, *probes.schema.fields]}
    own = probes.schema
    record = log.select(
        *key, *order, F.lit(0).alias("__kind"), F.lit(None).cast(types[probe_id]).alias(probe_id), *cols,
        *[F.lit(None).cast(own[c].dataType).alias(f"__keep_{c}") for c in keep],
    )
    probe = probes.select(
        *key, *order, F.lit(1).alias("__kind"), probe_id, *[F.lit(None).cast(types[c]).alias(c) for c in cols],
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    h = History.of(record.unionByName(probe), key, [*order, "__kind", probe_id])
    h = h.carry("__held", F.when(F.col("__kind") == 0, F.struct(*cols)))
    found = h.filter(F.col("__kind") == 1).rows()
    kept = [F.col(f"__keep_{c}").alias(c) for c in keep]
    return found.select(*key, probe_id, *order, *[F.col(f"__held.{c}").alias(c) for c in cols], *kept)


def last_known(log: DataFrame, key: list[str], cols: list[str], order: list[str] = ORDER) -> DataFrame:
    """Each channel with its last known value and ``<col>_stale`` where the row
    itself says unknown."""
    h = History.of(log, key, order)
    for c in cols:
        h = h.carry(f"{c}_known", F.col(c))
    return h.with_columns(
        **{f"{c}_stale": F.col(c).isNull() & F.col(f"{c}_known").isNotNull() for c in cols}
    ).rows()


# Fields that other derived fields depend on, whatever the case of their
# names; always passed on.
DEPENDED_ON = ("vrms", "irms", "pmean", "vis_ir", "ired", "uva", "uvb")


def field_updates(
    df: DataFrame, key: list[str], always: tuple[str, ...] = DEPENDED_ON, order: list[str] = ORDER
) -> DataFrame:
    """Long rows ``(key, field, value)`` that change their field, or belong to
    ``always``."""
    h = History.of(df, [*key, "field"], order).previous("__prev", F.col("value"))
    keep = ~F.col("value").eqNullSafe(F.col("__prev")) | F.lower("field").isin(*[f.lower() for f in always])
    return h.filter(keep).drop("__prev").rows()


def stall_spans(
    df: DataFrame, key: list[str], now_us: Column | int, seconds: int = 15, order: list[str] | None = None
) -> DataFrame:
    """Spans between arrivals (``event_us``) more than ``seconds`` apart. A stall that
    lasts at ``now_us`` has no end."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us).cast("bigint")
    h = History.of(df, key, order or ["event_us"]).following("end_us", F.col("event_us"))
    rows = h.filter(F.coalesce("end_us", now) - F.col("event_us") > seconds * 1_000_000).rows()
    return rows.select(*key, F.col("event_us").alias("start_us"), "end_us")
