"""Recalibration: a stored log rebuilt from archived raw samples, whole or from some days on.

A job decodes raw samples of one family, applies the hysteresis, tombstones, warm-up and
collision rules, and keeps three tables by day of the sample, below one folder:

* ``log``: the change log, as ``sources.logs`` reads it;
* ``quarantine``: the samples that did not decode, with a ``reason``;
* ``state``: for every key and day with samples the state it ended the day in.

After a coefficient or an archived day has changed, only the days concerned are computed
again. They start from the state of the day before. The days behind them follow, for the
sensors whose state at the end of the last computed day is not the stored one, until all
agree; as a state is all that a day hands over, later days would come out as they are.
Only the day partitions computed are replaced. All rows are worked on in one pass, of
which the three tables are views.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdline.functions.scalars import idiv, join_on
from holdline.functions.times import TICKS_PER_SECOND, day_start_sec
from holdline.model import FAMILIES
from holdline.operators.history import History
from holdline.operators.scan import HYSTERESIS_SCALE, compound_over, ema_resumed, state_samples, uniquify_stamps
from holdline.session import materialize, stored

# Sorts before any sample; rows that bring a key into its state get it.
BEFORE = -1
_SEEDS = 3


@dataclass(frozen=True)
class Smoothing:
    """Exponential smoothing before the hysteresis. ``decode`` adds ``value`` in place of
    the channels; it is smoothed with ``alpha`` from zero along a key, and ``channels`` are
    made of what comes out, but for the first ``warmup`` values of a key."""

    value: str
    alpha: float
    channels: dict[str, Callable[[Column], Column]]
    warmup: int = 0


@dataclass(frozen=True)
class Job:
    """How samples of ``family`` become log rows.

    ``decode`` adds the family's channels, multiplied by the hysteresis scale, and
    ``reason`` to samples without them. Samples have ``key``, ``day``, ``sec``, ``cs`` and,
    after these in order, ``seq``. Records of the first ``warmup`` samples of a key are
    dropped; with a session in ``key`` that is its warm-up. ``unscale`` turns held values
    into stored ones where that is not a division by the scale. With ``smooth`` the state
    holds that of the smoothing too.
    """

    family: str
    decode: Callable[[DataFrame], DataFrame]
    seq: str
    key: tuple[str, ...] = ("sensor_key",)
    warmup: int = 0
    unscale: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    smooth: Smoothing | None = None

    @property
    def channels(self) -> list[str]:
        return FAMILIES[self.family].columns

    @property
    def order(self) -> list[str]:
        return ["sec", "cs", self.seq]

    def stored(self, c: str) -> Column:
        held = F.col(f"{c}_mem")
        value = self.unscale[c](held) if c in self.unscale else idiv(held, HYSTERESIS_SCALE)
        return value.cast(dict(FAMILIES[self.family].channels)[c])

    @property
    def state_fields(self) -> list[str]:
        held = [f"{c}_{n}" for c in self.channels for n in ("x", "rise", "up")] + ["ok", "logged", "places"]
        return held + [f"smooth_{n}" for n in ("n", "s", "tail") if self.smooth]


def _seeds(state: DataFrame, job: Job) -> DataFrame:
    """Rows that bring every key of ``state`` into its state, before all samples."""
    cells = F.arrays_zip(
        *[state_samples(*[F.col(f"{c}_{n}") for n in ("x", "rise", "up")]).alias(c) for c in job.channels]
    )
    rows = state.select(*job.key, "ok", "logged", "places", F.posexplode(cells).alias("__n", "__cell"))
    return rows.select(
        *job.key,
        F.lit(BEFORE).cast("bigint").alias("sec"),
        F.col("__n").cast("int").alias("cs"),
        F.lit(BEFORE).cast("bigint").alias(job.seq),
        *[F.col(f"__cell.{c}").alias(c) for c in job.channels],
        F.lit(True).alias("__seed"),
        F.col("ok").alias("__ok"),
        F.col("logged").alias("__was_logged"),
        F.when(F.col("__n") == 0, F.col("places")).otherwise(F.lit(0)).alias("__count"),
    )


def _smoothed(rows: DataFrame, state: DataFrame, job: Job) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the channels of their smoothed values, and the tails of blocks."""
    how = job.smooth
    held = state.select(*job.key, *[F.col(f"smooth_{n}").alias(f"__smooth_{n}") for n in ("n", "s", "tail")])
    rows = rows.withColumn("__value", F.when(F.col("reason").isNull(), F.col(how.value)))
    rows, tails = ema_resumed(rows, held, list(job.key), job.order, "__value", "__smooth", how.alpha)
    warm = F.col("__smooth_n") > how.warmup
    cells = {c: F.when(warm, make(F.col("__smooth"))) for c, make in how.channels.items()}
    return rows.withColumns(cells).drop("__value", "__smooth"), tails


def _worked(raw: DataFrame, state: DataFrame, job: Job) -> tuple[DataFrame, DataFrame | None]:
    """The samples with what becomes of them; the one pass over the raw rows. With
    smoothing also the tails of blocks, by key and block."""
    decoded, tails = job.decode(raw), None
    added = [job.smooth.value] if job.smooth else job.channels
    more = [c for c in (*added, "reason") if c not in raw.columns]
    rows = decoded.select(*raw.columns, *more).withColumn(job.seq, F.col(job.seq).cast("bigint"))
    if job.smooth:
        rows, tails = _smoothed(rows, state, job)
    rows = rows.withColumns({c: F.col(c).cast("bigint") for c in job.channels})
    rows = rows.withColumns(
        {
            "__seed": F.lit(False),
            "__ok": F.col("reason").isNull(),
            "__was_logged": F.lit(False),
            "__count": F.lit(1),
        }
    )
    both = rows.unionByName(_seeds(state, job), allowMissingColumns=True)
    # What is decoded may cost shuffles of its own, and has the samples' keys.
    h = History.of(both, list(job.key), job.order, counted=raw.select(*job.key).unionByName(state.select(*job.key)))
    h = compound_over(h, job.channels, HYSTERESIS_SCALE, directions=True)
    h = h.running_sum("places", F.col("__count").cast("bigint")).previous("__before", F.col("__ok"))
    counts = F.col("changed") & ~F.col("__seed") & (F.col("places") > job.warmup)
    h = h.with_columns(changed=counts)
    h = h.running_max("__logged", F.col("changed") | F.col("__was_logged"), inclusive=False)
    logged = F.coalesce("__logged", F.lit(False))
    turned = logged & (F.col("__ok") != F.col("__before")) & ~F.col("__seed")
    h = h.with_columns(__emit=F.col("changed") | turned, logged=logged | F.col("changed") | F.col("__was_logged"))
    return stored(h.rows().filter(~F.col("__seed"))), tails


def _log(worked: DataFrame, spilled: DataFrame, job: Job) -> DataFrame:
    """Log rows with ``day``, each at a stamp of its own.

    ``spilled`` has, for some keys, the stamps already used in the first day by rows of
    the day before (``sec``, ``cs``); they count as taken.
    """
    values = [F.when(F.col("__ok"), job.stored(c)).alias(c) for c in job.channels]
    rows = worked.filter("__emit").select(*job.key, "day", *job.order, *values)
    rows = rows.unionByName(spilled.withColumn(job.seq, F.lit(BEFORE).cast("bigint")), allowMissingColumns=True)
    stamped = uniquify_stamps(rows, [FAMILIES[job.family].key], [job.seq]).filter(~F.col("dropped"))
    return stamped.filter(F.col(job.seq) != BEFORE).drop("dropped", job.seq)


def _ends(worked: DataFrame, tails: DataFrame | None, job: Job) -> DataFrame:
    """The state of every key at the end of every day with samples of it."""
    smooth = {f"smooth_{n}": F.col(f"__smooth_{n}") for n in ("n", "s", "b") if job.smooth}
    held = [f for f in job.state_fields if not f.startswith("smooth_")]
    state = worked.select(
        *job.key,
        "day",
        *job.order,
        *[F.col(c).alias(f"{c}_x") for c in job.channels],
        *[f"{c}_{n}" for c in job.channels for n in ("rise", "up")],
        F.col("__ok").alias("ok"),
        "logged",
        F.least("places", F.lit(job.warmup + 1)).alias("places"),
        *[c.alias(n) for n, c in smooth.items()],
    )
    last = F.max_by(F.struct(*held, *smooth), F.struct(*job.order)).alias("s")
    ends = state.groupBy(*job.key, "day").agg(last).select(*job.key, "day", "s.*")
    if job.smooth:
        tails = tails.withColumnsRenamed({"__smooth_b": "smooth_b", "__smooth_tail": "smooth_tail"})
        ends = join_on(ends, tails, [*job.key, "smooth_b"], "left")
        none = F.array().cast("array<double>")
        ends = ends.withColumn("smooth_tail", F.coalesce("smooth_tail", none)).drop("smooth_b")
    return ends


class Tables:
    """The three tables of a job below ``path``."""

    def __init__(self, spark: SparkSession, path: str, job: Job, raw: DataFrame):
        self.spark, self.path, self.job, self.sensor = spark, path, job, FAMILIES[job.family].key
        types = dict(raw.dtypes)
        keys = ", ".join(f"`{k}` {types[k]}" for k in job.key)
        cells = ", ".join(f"{c}_x bigint, {c}_rise boolean, {c}_up boolean" for c in job.channels)
        if job.smooth:
            cells += ", smooth_n bigint, smooth_s double, smooth_tail array<double>"
        kinds = dict(FAMILIES[job.family].channels)
        channels = ", ".join(f"{c} {kinds[c].simpleString()}" for c in job.channels)
        left = ", ".join(f"`{c}` {t}" for c, t in raw.dtypes if c != "day")
        self.schemas = {
            "log": f"{keys}, sec bigint, cs int, {channels}, day date",
            "quarantine": f"{left}, reason string, day date",
            "state": f"{keys}, {cells}, ok boolean, logged boolean, places bigint, day date",
        }

    def _folder(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, name: str) -> DataFrame:
        fs, p = self._folder(name)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame, days: list[date]) -> None:
        """Put ``rows`` in place of the partitions ``days``; a day without rows goes."""
        order = ["day", *self.job.key, *[c for c in ("sec", "cs") if c in rows.columns]]
        (
            rows.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(f"{self.path}/{name}")
        )
        kept = {r["day"] for r in rows.select("day").distinct().collect()}
        for day in days:
            fs, p = self._folder(f"{name}/day={day}")
            if day not in kept and fs.exists(p):
                fs.delete(p, True)

    def last_states(self, first: date | None, last: date) -> DataFrame:
        """The last state of every key in the days from ``first`` to ``last``."""
        here = F.col("day") <= F.lit(last)
        here = here if first is None else here & (F.col("day") >= F.lit(first))
        top = F.max_by(F.struct(*self.job.state_fields), "day").alias("s")
        return self.read("state").filter(here).groupBy(*self.job.key).agg(top).select(*self.job.key, "s.*")

    def tops(self, day: date) -> DataFrame:
        """For sensors with rows of the day before at stamps of ``day``: how many stamps,
        from the last one of the day before on, these take up."""
        start = day_start_sec(F.lit(day))
        near = self.read("log").filter((F.col("day") < F.lit(day)) & (F.col("day") >= F.date_sub(F.lit(day), 1)))
        tick = F.max(F.col("sec") * TICKS_PER_SECOND + F.col("cs"))
        late = near.filter(F.col("sec") >= start).groupBy(self.sensor)
        return late.agg((tick - start * TICKS_PER_SECOND + 2).alias("n"))

    def spilled(self, day: date) -> DataFrame:
        """These stamps as rows that arrive at the last stamp of the day before, one after
        the other; a collision tries few, so they are few."""
        stamps = self.tops(day).select(self.sensor, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
        before = (day_start_sec(F.lit(day)) - 1).cast("bigint")
        return stamps.select(self.sensor, before.alias("sec"), F.lit(TICKS_PER_SECOND - 1).alias("cs"))


def recalibrate(raw: DataFrame, path: str, job: Job, days: list[date] | None = None) -> list[date]:
    """Compute ``days`` of ``raw`` (with a ``day`` column; None: all of it) and the days
    behind them that come out differently. Returns the days whose partitions were replaced.

    ``days`` need not follow each other; what lies between them is computed too. The days
    behind them are taken in growing stretches, for the sensors not yet in agreement.
    """
    tables = Tables(raw.sparkSession, path, job, raw)
    sensor = [tables.sensor]
    every = sorted(r["day"] for r in raw.select("day").distinct().collect())
    chosen = every if days is None else [d for d in every if min(days) <= d <= max(days)]
    replaced, only, span = [], None, len(chosen)
    while chosen:
        first, last = chosen[0], chosen[-1]
        behind = [d for d in every if d > last]
        part = raw.filter(F.col("day").between(F.lit(first), F.lit(last)))
        state, spilled = tables.last_states(None, first - timedelta(days=1)), tables.spilled(first)
        if only is not None:
            part, state = (join_on(x, only, sensor, "left_semi") for x in (part, state))
        if behind:
            old = [materialize(x) for x in (tables.last_states(first, last), tables.tops(behind[0]))]
        worked, tails = _worked(part, state, job)
        new = {
            "log": _log(worked, spilled, job),
            "quarantine": worked.filter(F.col("reason").isNotNull()).select(*raw.columns, "reason"),
            "state": _ends(worked, tails, job),
        }
        for name, rows in new.items():
            if only is not None:
                # The other sensors' rows of these days stay; written elsewhere first, as
                # what is replaced is read for it.
                kept = tables.read(name).filter(F.col("day").between(F.lit(first), F.lit(last)))
                rows = rows.unionByName(join_on(kept, only, sensor, "left_anti").select(rows.columns))
            # Once: it is read to find the ranges, for its rows and for its days.
            tables.replace(name, stored(rows), chosen)
        replaced += chosen
        if not behind:
            break
        now = tables.last_states(first, last), tables.tops(behind[0])
        differ = [x.select(sensor) for a, b in zip(now, old) for x in (a.exceptAll(b), b.exceptAll(a))]
        if only is not None:  # those without a sample here have not met the stored log again
            met = now[0].select(sensor).unionByName(old[0].select(sensor))
            differ.append(join_on(only, met, sensor, "left_anti"))
        only = materialize(reduce(DataFrame.unionByName, differ).distinct())
        if only.isEmpty():
            break
        chosen, span = behind[:span], 2 * span
    return replaced
