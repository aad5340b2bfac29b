"""Timers on a live stream: idle heartbeats, silent and stalled sensors.

The one operator with a clock of its own, so it runs on the engine's keyed state
with event-time timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds until a heartbeat is due and until a feed counts as stalled.
HEARTBEAT_S = 5
STALL_S = 15

_OUT = "sensor_key bigint, event string, sec bigint"
# The seconds that may still get samples, and whether one of theirs was recorded.
_STATE = "beat bigint, last bigint, warned int, open_sec array<bigint>, open_recorded array<boolean>"


def step(seconds: list[tuple[int, bool]], beat: int | None, last: int | None, warned: int):
    """Advance one sensor over its distinct seconds ``(sec, recorded)``.

    ``beat`` is the later of last record and last heartbeat, ``last`` the last
    arrival, ``warned`` how many of the silence events were already given.
    """
    events = []
    for sec, recorded in seconds:
        events += silence(sec, last, warned)
        warned, last = 0, sec
        if recorded or beat is None:
            beat = sec
        elif sec - beat > HEARTBEAT_S:
            beat = sec
            events.append(("heartbeat", sec))
    return events, beat, last, warned


def silence(now: int, last: int | None, warned: int) -> list[tuple[str, int]]:
    """``dead`` and ``stalled`` events due at ``now``, each once per silence."""
    due = [("dead", HEARTBEAT_S), ("stalled", STALL_S)]
    if last is None:
        return []
    return [(name, last) for name, limit in due[warned:] if now - last > limit]


def _advance(lateness: int):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        beat, last, warned, *lists = state.get if state.exists else (-1, -1, 0, [], [])
        beat, last = (None if x < 0 else x for x in (beat, last))
        # One entry per second, whatever the sample rate: bounded by the clock.
        open_ = dict(zip(*lists))
        late = {}
        now = state.getCurrentWatermarkMs() // 1000
        if state.hasTimedOut:
            ended = now
        else:
            for frame in frames:
                # Rows of the clock have no second and fall out here.
                for sec, recorded in frame.groupby("sec")["recorded"].any().items():
                    if last is None or sec > last:
                        open_[int(sec)] = open_.get(int(sec), False) or bool(recorded)
                    else:
                        late[int(sec)] = late.get(int(sec), False) or bool(recorded)
            # What comes later is newer than this, or late.
            ended = max(open_, default=now) - lateness
        done = sorted(s for s in open_ if s <= ended)
        events, beat, last, warned = step([(s, open_.pop(s)) for s in done], beat, last, warned)
        if state.hasTimedOut:
            due = silence(now, last, warned)
            events, warned = events + due, warned + len(due)
        if open_ or last is not None:
            held = (-1 if x is None else int(x) for x in (beat, last))
            state.update((*held, warned, list(open_), list(open_.values())))
            # When the watermark reaches the end of a second, or of the allowed silence.
            ends = [s * 1000 - 1 for s in open_]
            if last is not None and warned < 2:
                ends.append((last + (HEARTBEAT_S, STALL_S)[warned]) * 1000 + 999)
            if ends:
                state.setTimeoutTimestamp(max(min(ends), state.getCurrentWatermarkMs() + 1))
        events += [("late_record" if r else "late", s) for s, r in sorted(late.items())]
        yield pd.DataFrame(
            {
                "sensor_key": pd.Series([key[0]] * len(events), dtype="int64"),
                "event": pd.Series([e for e, _ in events], dtype="object"),
                "sec": pd.Series([s for _, s in events], dtype="int64"),
            }
        )

    return run


def _thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sensor and second of each Arrow batch, before the shuffle, and one
    for the clock: the newest second. Only that one has a time for the engine, which
    discards rows behind the watermark of all sensors, but none without a time."""
    for frame in frames:
        rows = frame.groupby(["sensor_key", "sec"], as_index=False)["recorded"].any()
        rows = rows.astype({"sensor_key": "Int64", "sec": "Int64"}).assign(clock=pd.array([pd.NA] * len(rows), "Int64"))
        newest = rows.nlargest(1, "sec").assign(clock=lambda r: r["sec"], sec=pd.array([pd.NA] * min(1, len(rows)), "Int64"))
        yield pd.concat([rows, newest])


def stream_liveness(samples: DataFrame, lateness: int = 1) -> DataFrame:
    """Events ``heartbeat`` (at a sample), ``dead`` and ``stalled`` (at the last
    sample before more than 5 and 15 seconds of silence), and ``late`` or ``late_record``
    for each second of samples that came when a second as new of their sensor had counted.

    ``samples`` has ``sensor_key``, ``sec`` and ``recorded``. Samples may come up to
    ``lateness`` seconds (one at least) after newer ones: a second counts when no sample
    of it can come any more, so events do not depend on where micro-batches end. Samples
    further behind other sensors count as long as they are newer than what has counted of
    their own; a silence that the clock of all sensors has already told stays told.
    """
    if lateness < 1:
        raise ValueError("a second can end within a micro-batch: lateness is 1 at least")
    thin = samples.select(
        F.col("sensor_key").cast("bigint"), F.col("sec").cast("bigint"), F.coalesce("recorded", F.lit(False)).alias("recorded")
    ).mapInPandas(_thin, "sensor_key bigint, sec bigint, recorded boolean, clock bigint")
    timed = thin.withColumn("at", F.timestamp_seconds("clock")).withWatermark("at", f"{lateness} seconds")
    return timed.groupBy("sensor_key").applyInPandasWithState(
        _advance(lateness), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
