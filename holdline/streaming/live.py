"""The live operators: change filter, hysteresis, smoothing, alerts, presence, snapshots.

Each takes a stream and returns one. State lies with the engine (see ``keyed``), so a job
writes the result to any sink with a checkpoint, and replaying a log through the stream
gives the rows that the batch operator gives.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdline.functions.times import when_key
from holdline.operators.derive import SMOOTHING, fan_flag, frame_factor, furnace_flags
from holdline.sources.messages import route_messages
from holdline.streaming.keyed import ddl, ordered, reordered
from holdline.streaming.snapshots import drop_versions


def stream_changes(
    stream: DataFrame, key: list[str], order: list[str], cols: list[str], initial: dict[str, object] | None = None
) -> DataFrame:
    """Rows in which a channel differs from the row before; before the first row the
    channels are ``initial``, by default unknown."""
    start = tuple((initial or {}).get(c) for c in cols)

    def step(values: tuple, held: tuple):
        return (values if values != held else None), values

    return ordered(stream, key, order, cols, step, start, ddl(stream, cols))


def hold(x: int | None, mem: int, up: bool) -> tuple[int, bool]:
    """One sample of the hysteresis: the value held and its direction."""
    if x is None:
        return mem, up
    if x > mem if up else x < mem:
        return x, up
    if x < mem - 1 if up else x > mem + 1:
        return x, not up
    return mem, up


def stream_hysteresis(stream: DataFrame, key: list[str], order: list[str], cols: list[str], scale: int = 4) -> DataFrame:
    """Log records: all held values whenever one channel emits."""

    def step(values: tuple, held: tuple):
        new = [hold(x, *held[2 * i : 2 * i + 2]) for i, x in enumerate(values)]
        stored = tuple(math.trunc(mem / scale) for mem, _ in new)
        changed = any(v != math.trunc(held[2 * i] / scale) for i, v in enumerate(stored))
        return (stored if changed else None), tuple(x for pair in new for x in pair)

    state = ", ".join(f"`{c}_mem` bigint, `{c}_up` boolean" for c in cols)
    rows = stream.withColumns({c: F.col(c).cast("bigint") for c in cols})
    return ordered(rows, key, order, cols, step, (0, False) * len(cols), state)


def stream_ema(
    stream: DataFrame, key: list[str], order: list[str], col: str, alpha: float, seed: str = "zero"
) -> DataFrame:
    """Smoothed samples in ``ema``; rows without a sample are left out."""
    if seed not in ("zero", "first"):
        raise ValueError("seed must be 'zero' or 'first'")

    def step(values: tuple, held: tuple):
        (x,), (y,) = values, held
        y = x if y is None else alpha * y + (1 - alpha) * x
        return (x, y), (y,)

    rows = stream.filter(F.col(col).isNotNull()).withColumn(col, F.col(col).cast("double"))
    start = (0.0 if seed == "zero" else None,)
    return ordered(rows, key, order, [col], step, start, "ema double", f"`{col}` double, ema double")


_FIELDS = ["vrms", "pmean", "furnace_ctrl", "tmp_ctrl_module"]


def stream_alerts(stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Furnace and fan flags for every frame that brings a current. What is kept of a site
    is the value last received of each field, and the smoothed current."""

    def step(values: tuple, held: tuple):
        irms, fields, brought = values[0], values[1:5], values[5:]
        now = tuple(new if has else old for new, has, old in zip(fields, brought, held))
        smooth = held[4]
        if irms is None:
            return None, (*now, smooth)
        smooth = irms if smooth is None else SMOOTHING * smooth + (1 - SMOOTHING) * irms
        return (irms, *now, smooth), (*now, smooth)

    rows = stream.withColumn("irms", F.col("irms").cast("double"))
    cols = ["irms", *_FIELDS, *[f"has_{c}" for c in _FIELDS]]
    state = f"{ddl(stream, _FIELDS)}, irms_ema double"
    out = f"irms double, {ddl(stream, _FIELDS)}, irms_ema double"
    done = ordered(rows, key, order, cols, step, (None,) * 5, state, out).withColumn("pf", frame_factor())
    return done.withColumns({**furnace_flags(), "fans": fan_flag()})


def stream_ordered(stream: DataFrame, key: list[str], order: list[str], lateness: int) -> DataFrame:
    """Rows in event order, although they come up to ``lateness`` late; later ones aside."""
    return reordered(stream, key, order, [c for c in stream.columns if c not in (*key, *order)], lateness)


def stream_presence(stream: DataFrame, site: str, key: str, scan: str, order: list[str], value: str) -> DataFrame:
    """The change log of a scanned bus, tombstones included, as a stream.

    A finished scan is a row without ``key``, with the scan's number and time; a reading is
    a row with it. Readings may come in any order before the row that finishes their scan.
    Then each is logged that differs from the one remembered, and every sensor remembered
    that did not answer gets a row without a value at the time of the scan and is
    forgotten. State is one row per site: its open readings, and the sensors of its bus.
    """
    types = dict(stream.dtypes)
    fields = [scan, key, *order, value]
    n = len(fields)

    def step(values: tuple, held: tuple):
        number, sensor, *_ = values
        opened, live, ended = held[:n], held[n : n + 2], held[-1]
        if sensor is not None:
            return None, (*[[*xs, x] for xs, x in zip(opened, values)], *live, ended)
        if number == ended:  # told twice
            return None, held
        rows = list(zip(*opened))
        here = sorted((r for r in rows if r[0] == number), key=lambda r: r[2 : 2 + len(order)])
        known, out = dict(zip(*live)), []
        for _, k, *stamp, x in here:
            if k not in known or known[k] != x:
                out.append((k, *stamp, x))
            known[k] = x
        answered = {r[1] for r in here}
        for k in sorted(set(known) - answered):
            out.append((k, *values[2 : 2 + len(order)], None))
            del known[k]
        rest = [list(c) for c in zip(*[r for r in rows if r[0] != number])] or [[] for _ in fields]
        found = tuple(list(c) for c in zip(*out)) if out else None
        return found, (*rest, list(known), list(known.values()), number)

    rows = stream.withColumn("__end", F.col(key).isNull().cast("bigint"))
    names = [key, *order, value]
    state = ", ".join(f"`__{c}` array<{types[c]}>" for c in fields)
    state += f", __live array<{types[key]}>, __values array<{types[value]}>, __ended {types[scan]}"
    out = ", ".join(f"`__{c}` array<{types[c]}>" for c in names)
    start = (*[[] for _ in range(n + 2)], None)
    # The readings of a scan, in any order, come before its end.
    done = ordered(rows, [site], [scan, "__end"], fields, step, start, state, out, repeats=True)
    cells = F.arrays_zip(*[F.col(f"__{c}").alias(c) for c in names])
    return done.filter("NOT late").select(site, F.inline(cells))


def stream_route(stream: DataFrame, topic: str, payload: str) -> DataFrame:
    """Routing keeps no state, so it is the batch expression itself."""
    return route_messages(stream, topic, payload)


def _rewritten(newest: DataFrame, path: str, trigger: dict) -> StreamingQuery:
    """Write a running aggregate as a whole at every trigger, keeping two versions."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        drop_versions(batch.sparkSession, f"{path}/out", n - 1)

    return (
        newest.writeStream.outputMode("complete")
        .foreachBatch(each)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"processingTime": "250 milliseconds"}))
        .start()
    )


def stream_snapshot(
    stream: DataFrame, path: str, key: list[str], cols: list[str], **trigger
) -> StreamingQuery:
    """The newest row per key under ``<path>/out/batch=<n>``; read the last version.
    A running aggregate: combined map-side, its state kept by the engine."""
    names = ["sec", "cs", *cols]
    newest = stream.groupBy(*key).agg(*[F.max_by(c, when_key()).alias(c) for c in names])
    return _rewritten(newest, path, trigger)


def stream_heartbeats(stream: DataFrame, path: str, **trigger) -> StreamingQuery:
    """The heartbeat table ``(sensor_name, sec)``, last write by ``seq`` winning."""
    newest = stream.groupBy("sensor_name").agg(F.max_by("sec", "seq").alias("sec"))
    return _rewritten(newest, path, trigger)
