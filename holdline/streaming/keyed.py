"""Ordered work on a live stream, in the engine's keyed state.

The state of a key is one typed row: the stamp of the last row taken, and what the
operator remembers. A trigger reads and writes the state of the keys it has rows of and
of no others; the engine keeps its versions, and replays a trigger after a failure.

Rows of a key are taken in order within a trigger. Rows not newer than the last one
taken come out unchanged, with ``late`` true; write them aside by that column. The rows
of one key and trigger go through one task, so the size of a trigger (for files, see
``read_stream``) bounds them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

# What an operator does with a row of values: (values, remembered) -> (output, remembered).
# An output of None means that the row is not passed on.
Step = Callable[[tuple, tuple], tuple[tuple | None, tuple]]

# The column that holds a whole row.
ROW = "__row"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1000) -> DataFrame:
    """A parquet folder as a stream; the limit bounds the size of a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ddl(df: DataFrame, cols: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


def packed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``n`` columns, and the others as one: tuples of Python's values, pickled,
    missing ones and NaN None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in batch.columns[n:]:
                if pa.types.is_floating(c.type):
                    c = pc.if_else(pc.is_nan(c), pa.scalar(None, c.type), c)
                lists.append(c.to_pylist())
            rows = pa.array([pickle.dumps(r) for r in zip(*lists)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], rows], [*batch.schema.names[:n], ROW])

    return run


def rows_of(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    return [pickle.loads(r) for f in frames for r in f[ROW]]


def rows_frame(rows: list[tuple], cols: list[str]) -> pd.DataFrame:
    return pd.DataFrame({ROW: [dict(zip(cols, r)) for r in rows]})


def by_key(stream: DataFrame, key: list[str], cols: list[str], run: Callable, out: str, state: str) -> DataFrame:
    """``run`` over the keys, their rows of ``key`` and ``cols``, and their state.

    The engine turns each column of each key into pandas by itself, which costs more than
    the work where keys have few rows in a trigger. So a row goes in as one packed column
    and comes out as one struct; whole numbers in keys go as text, which needs no check for
    missing values.
    """
    whole = {c for c, t in stream.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    at = [(F.col(c).cast("string") if c in whole else F.col(c)).alias(f"__key{i}") for i, c in enumerate(key)]
    flat = stream.select(*at, *key, *cols)
    rows = flat.mapInArrow(packed(len(at)), StructType(flat.schema.fields[: len(at)]).add(ROW, "binary"))
    made = StructType().add(ROW, stream.sparkSession.createDataFrame([], out).schema)
    groups = rows.groupBy(*rows.columns[: len(at)])
    return groups.applyInPandasWithState(run, made, state, "append", GroupStateTimeout.NoTimeout).select(f"{ROW}.*")


def ordered(
    stream: DataFrame,
    key: list[str],
    order: list[str],
    cols: list[str],
    step: Step,
    initial: tuple,
    state: str,
    out: str | None = None,
    repeats: bool = False,
) -> DataFrame:
    """Apply ``step`` to the values ``cols`` of every key's rows, in ``order`` (numbers,
    unique within a key, or with ``repeats`` equal for rows that may come in any order).

    ``initial`` is what is remembered before the first row, of the types ``state``.
    Output: key, order, the columns ``out`` (by default those that came in) and ``late``;
    columns that a late row has no value for are NULL.
    """
    out = out or ddl(stream, cols)
    # An empty schema tells the names.
    names = stream.sparkSession.createDataFrame([], out).columns
    came = {c: i for i, c in enumerate(cols)}
    all_cols = [*key, *order, *names, "late"]
    needed = list(dict.fromkeys([*key, *order, *cols]))
    stamp_of, values_of = ([needed.index(c) for c in some] for some in (order, cols))
    k, n = len(key), len(order)

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = held.get if held.exists else None
        mark, remembered = (old[:n], old[n:]) if old else (None, initial)
        given = rows_of(frames)
        at, done = given[0][:k], []
        rows = [(tuple(r[i] for i in stamp_of), tuple(r[i] for i in values_of)) for r in given]
        for stamp, values in sorted(rows, key=lambda r: r[0]):
            if mark is not None and (stamp < mark if repeats else stamp <= mark):
                kept = [values[came[c]] if c in came else None for c in names]
                done.append((*at, *stamp, *kept, True))
                continue
            result, remembered = step(values, remembered)
            mark = stamp
            if result is not None:
                done.append((*at, *stamp, *result, False))
        held.update((*mark, *remembered))
        yield rows_frame(done, all_cols)

    return by_key(
        stream, key, needed[k:], run,
        f"{ddl(stream, [*key, *order])}, {out}, late boolean", f"{ddl(stream, order)}, {state}",
    )


def reordered(stream: DataFrame, key: list[str], order: list[str], cols: list[str], lateness: int) -> DataFrame:
    """Rows in the order of their time, although they come up to ``lateness`` late.

    ``order`` are whole numbers, the first one the time, in the unit of ``lateness``. A
    key's clock is the newest time it has had, less ``lateness``. Rows behind the clock of
    the triggers before come out at once with ``late`` true and no ``place``. Others wait
    in the state until the clock has reached them, and come out with their ``place``, which
    counts a key's rows in order. What waits is bounded by what comes within ``lateness``.
    """
    types = dict(stream.dtypes)
    held_cols = [*order, *cols]
    out_cols, k = [*key, *held_cols, "place", "late"], len(key)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, place, *lists = state.get if state.exists else (None, 0, *[[] for _ in held_cols])
        waiting = list(zip(*lists))
        given = rows_of(frames)
        at, done, new = given[0][:k], [], [r[k:] for r in given]
        if newest is not None:
            done = [(*at, *r, None, True) for r in sorted(new, key=lambda r: r[: len(order)]) if r[0] <= newest - lateness]
            new = [r for r in new if r[0] > newest - lateness]
        waiting = sorted([*waiting, *new], key=lambda r: r[: len(order)])
        newest = max([x for x in (newest, *[r[0] for r in new]) if x is not None])
        ready = [r for r in waiting if r[0] <= newest - lateness]
        for r in ready:
            place += 1
            done.append((*at, *r, place, False))
        rest = waiting[len(ready) :]
        state.update((newest, place, *[[r[i] for r in rest] for i in range(len(held_cols))]))
        yield rows_frame(done, out_cols)

    held = ", ".join(f"`{c}` array<{types[c]}>" for c in held_cols)
    return by_key(
        stream, key, held_cols, run, f"{ddl(stream, [*key, *held_cols])}, place bigint, late boolean",
        f"newest bigint, place bigint, {held}",
    )
