"""Recurrences over a sensor's samples, written as windows.

Each of them looks sequential; each has a form in which a row only needs its
neighbour, the last value that mattered, or a composition of steps that can be
doubled. No Python runs per row, and a hot key stays spread (see History).
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdline.functions.scalars import clamp, idiv, join_on
from holdline.functions.times import TICKS_PER_SECOND
from holdline.operators.history import CHUNK, History
from holdline.session import materialize

# Samples per stored unit, and slots tried on a time stamp collision.
HYSTERESIS_SCALE = 4
COLLISION_LIMIT = 20


def _hold(df: DataFrame, window, cols: list[str], start: dict[str, Column], scale: int) -> DataFrame:
    """Hysteresis along ``window``, from the state ``<col>_x``, ``<col>_rise`` and
    ``<col>_up`` in ``start``. Adds ``_rise``, ``_up``, ``_mem`` and ``_emit``."""
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)

    def last_sign(step: Column) -> Column:
        return F.last(F.when(step != 0, step > 0), ignorenulls=True).over(so_far)

    def each(make) -> dict[str, Column]:
        return {name: value for c in cols for name, value in make(c).items()}

    low0 = {c: start[f"{c}_x"] - start[f"{c}_rise"].cast("bigint") for c in cols}
    mem0 = {c: low0[c] + start[f"{c}_up"].cast("bigint") for c in cols}
    x = F.col
    df = df.withColumns(each(lambda c: {f"__p_{c}": F.coalesce(F.lag(c).over(window), start[f"{c}_x"])}))
    df = df.withColumns(each(lambda c: {
        f"{c}_rise": F.coalesce(last_sign(x(c) - x(f"__p_{c}")), start[f"{c}_rise"])}))
    df = df.withColumns(each(lambda c: {f"__low_{c}": x(c) - x(f"{c}_rise").cast("bigint")}))
    df = df.withColumns(each(lambda c: {f"__p_{c}": F.coalesce(F.lag(f"__low_{c}").over(window), low0[c])}))
    df = df.withColumns(each(lambda c: {
        f"{c}_up": F.coalesce(last_sign(x(f"__low_{c}") - x(f"__p_{c}")), start[f"{c}_up"])}))
    df = df.withColumns(each(lambda c: {f"{c}_mem": x(f"__low_{c}") + x(f"{c}_up").cast("bigint")}))
    df = df.withColumns(each(lambda c: {f"__p_{c}": F.coalesce(F.lag(f"{c}_mem").over(window), mem0[c])}))
    df = df.withColumns(each(lambda c: {f"{c}_emit": idiv(f"{c}_mem", scale) != idiv(f"__p_{c}", scale)}))
    return df.drop(*[f"__{n}_{c}" for n in ("p", "low") for c in cols])


def state_samples(x: Column, rise: Column, up: Column) -> Column:
    """Three samples that bring the hysteresis from anywhere into the given state:
    the first is far enough away to move the held value in the wanted direction."""
    far = F.when(up, x - 10).otherwise(x + 10)
    turn = F.when(rise == up, far).otherwise(F.when(up, x + 1).otherwise(x - 1))
    return F.array(far, turn, x)


def _chunk_entries(h: History, cols: list[str], start: dict[str, Column], scale: int) -> DataFrame:
    """The state with which each chunk of a hot key begins.

    Three samples per chunk have the effect of all its rows: those that set the
    state it ends in, or, when nothing in it is known to have moved the value (it
    only steps to and fro by one), its first, its second and its last value.
    """
    w, at = h.window(), F.struct(*h.order)
    rows = h.df.filter(F.col(CHUNK) > 0)
    for c in cols:
        rows = rows.withColumn(f"__d_{c}", F.col(c) - F.lag(c).over(w))
    for c in cols:
        step = F.col(f"__d_{c}")
        sign = F.last(F.when(step != 0, step > 0), ignorenulls=True)
        rows = rows.withColumn(f"__was_{c}", sign.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ends = []
    for c in cols:
        step, was = F.col(f"__d_{c}"), F.col(f"__was_{c}")
        rose, turned = F.when(step != 0, step > 0), ((step == 1) & ~was) | ((step == -1) & was)
        ends += [
            F.min_by(c, at).alias(f"{c}_first"),
            F.min_by(c, F.when(step != 0, at)).alias(f"{c}_second"),
            F.max_by(c, at).alias(f"{c}_last"),
            F.max_by(rose, F.when(step != 0, at)).alias(f"{c}_rise"),
            F.max_by(rose, F.when((step != 0) & was.isNotNull() & ~turned, at)).alias(f"{c}_up"),
        ]
    ends = rows.groupBy(*h.part).agg(*ends)

    def samples(c: str) -> Column:
        first, last = F.col(f"{c}_first"), F.col(f"{c}_last")
        known = state_samples(last, F.col(f"{c}_rise"), F.col(f"{c}_up"))
        open_ = F.array(first, F.coalesce(F.col(f"{c}_second"), first), last)
        return F.when(F.col(f"{c}_up").isNull(), open_).otherwise(known)

    few = ends.select(*h.part, F.posexplode(F.arrays_zip(*[samples(c).alias(c) for c in cols])).alias("__n", "__s"))
    few = materialize(few.select(*h.part, "__n", *[F.col(f"__s.{c}").alias(c) for c in cols]))
    done = _hold(few, Window.partitionBy(*h.key).orderBy(CHUNK, "__n"), cols, start, scale).filter("__n = 2")
    before = F.lag(F.struct(*[F.col(c).alias(f"{c}_x") for c in cols],
                            *[f"{c}_{n}" for c in cols for n in ("rise", "up")]))
    over = Window.partitionBy(*h.key).orderBy(CHUNK)
    return done.select(*h.part, before.over(over).alias("__in"))


def hysteresis_over(
    h: History, cols: list[str], scale: int = HYSTERESIS_SCALE, directions: bool = False
) -> History:
    """Add ``<col>_mem`` (value held) and ``<col>_emit`` to samples scaled by
    ``scale``; with ``directions`` also ``<col>_rise`` and ``<col>_up``, which
    together with the last known sample, then in ``<col>``, are the whole state. A
    NULL is no sample: it leaves the state as it was and emits nothing.

    The held value moves freely in its direction; to turn round, a sample has to
    differ by more than one. That is an interval of width one pushed along by the
    samples: its lower end is the sample itself after a fall and the sample less
    one after a rise, and the direction is that of its last move. It starts at
    zero, going down.
    """
    h = h.with_columns(**{f"__raw_{c}": F.col(c).cast("bigint") for c in cols})
    start = {}
    for c in cols:
        # A sample repeated changes nothing, nor does the zero it starts from.
        h = h.carry(c, F.col(f"__raw_{c}"))
        h = h.with_columns(**{c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))})
        start |= {f"{c}_x": F.lit(0).cast("bigint"), f"{c}_rise": F.lit(False), f"{c}_up": F.lit(False)}
    df = h.df
    if h.chunked:
        df = h.join_entry(df, _chunk_entries(h, cols, start, scale))
        start = {n: F.coalesce(F.col(f"__in.{n}"), v) for n, v in start.items()}
    df = _hold(df, h.window(), cols, start, scale).drop("__in")
    if not directions:
        df = df.withColumns({c: F.col(f"__raw_{c}") for c in cols})
        df = df.drop(*[f"{c}_{n}" for c in cols for n in ("rise", "up")])
    return replace(h, df=df.drop(*[f"__raw_{c}" for c in cols]))


def hysteresis(df: DataFrame, key: list[str], order: list[str], col: str, scale: int = HYSTERESIS_SCALE) -> DataFrame:
    return hysteresis_over(History.of(df, key, order), [col], scale).rows()


def compound_over(
    h: History, cols: list[str], scale: int = HYSTERESIS_SCALE, directions: bool = False
) -> History:
    """All channels through :func:`hysteresis_over`; ``changed`` when any emits."""
    h = hysteresis_over(h, cols, scale, directions)
    changed = F.lit(False)
    for c in cols:
        changed = changed | F.col(f"{c}_emit")
    return h.with_columns(changed=changed)


def compound_record(
    df: DataFrame, key: list[str], order: list[str], cols: list[str], scale: int = HYSTERESIS_SCALE
) -> DataFrame:
    """Rows in which any channel emits, with the held value of every channel."""
    h = compound_over(History.of(df, key, order), cols, scale).filter(F.col("changed"))
    h = h.with_columns(**{c: idiv(f"{c}_mem", scale) for c in cols})
    return h.drop("changed", *[f"{c}_{n}" for c in cols for n in ("mem", "emit")]).rows()


def record_log(
    judged: DataFrame, key: list[str], order: list[str], cols: list[str], scale: int = HYSTERESIS_SCALE
) -> DataFrame:
    """The change log of samples and failed readings, which have a ``reason`` and no
    channels. A failure writes a tombstone unless one holds or nothing was logged yet; it
    does not touch the hysteresis. The first good sample after a tombstone is logged even
    when no channel emits."""
    ok = F.col("reason").isNull()
    h = compound_over(History.of(judged, key, order).with_columns(__ok=ok), cols, scale)
    h = h.previous("__was_ok", F.col("__ok")).running_max("__logged", F.col("changed"), inclusive=False)
    turned = F.coalesce("__logged", F.lit(False)) & (F.col("__ok") != F.col("__was_ok"))
    rows = h.filter(F.col("changed") | turned).rows()
    return rows.select(*key, *order, *[F.when(F.col("__ok"), idiv(f"{c}_mem", scale)).alias(c) for c in cols])


def after_warmup(df: DataFrame, key: list[str], session: str, n: int, order: list[str]) -> DataFrame:
    """Rows past the first ``n`` of each session."""
    h = History.of(df, [*key, session], order).number("__place")
    return h.filter(F.col("__place") > n).drop("__place").rows()


# -- time stamp collisions ----------------------------------------------------


def _then(first: str, n: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Step (n, lo, hi) after the step struct ``first``: shift by n, then clamp."""
    return (
        F.col(f"{first}.n") + n,
        clamp(F.col(f"{first}.lo") + n, lo, hi),
        clamp(F.col(f"{first}.hi") + n, lo, hi),
    )


def _compose_prefixes(df: DataFrame, window, longest: int) -> DataFrame:
    """Turn the step ``__f`` of every row into the composition of all steps of its
    window group up to the row, doubling the reach each time."""
    reach = 1
    while reach < longest:
        df = df.withColumn("__g", F.lag("__f", reach).over(window))
        n, lo, hi = _then("__g", F.col("__f.n"), F.col("__f.lo"), F.col("__f.hi"))
        joint = F.struct(n.alias("n"), lo.alias("lo"), hi.alias("hi"))
        df = df.withColumn("__f", F.when(F.col("__g").isNull(), F.col("__f")).otherwise(joint))
        reach *= 2
    return df.drop("__g")


def _longest(df: DataFrame, part: list[str]) -> int:
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.agg(F.max("__n")).first()[0] or 0


def _crowded_slots(rows: DataFrame, key: list[str], order: list[str], limit: int) -> DataFrame:
    """``slot`` for runs of rows in which some find none, NULL for those.

    The last slot used moves by "add one, then clamp to the row's range"; such
    steps compose to "add n, then clamp", so all prefixes come from doubling.
    """
    h = History.of(rows, key, order)
    t = F.col("__t")
    step = F.struct(F.lit(1).cast("bigint").alias("n"), t.alias("lo"), (t + (limit - 1)).alias("hi"))
    w = h.window()
    steps = h.df.withColumn("__f", step)
    steps = _compose_prefixes(steps, w, _longest(h.df, h.part))
    slot = F.col("__f.lo")  # nothing was used before the first row
    before = F.lag("slot").over(w)
    if h.chunked:
        steps = materialize(steps)
        ends = (
            steps.filter(F.col(CHUNK) > 0)
            .groupBy(*h.part)
            .agg(F.max_by("__f", F.struct(*h.order)).alias("__f"))
        )
        over = Window.partitionBy(*key).orderBy(CHUNK)
        ends = _compose_prefixes(ends, over, _longest(ends, key))
        steps = h.join_entry(steps, ends.select(*h.part, F.lag("__f.lo").over(over).alias("__in")))
        slot = F.when(F.col("__in").isNull(), slot).otherwise(
            clamp(F.col("__in") + F.col("__f.n"), F.col("__f.lo"), F.col("__f.hi"))
        )
        before = F.coalesce(before, F.col("__in"))
    steps = steps.withColumn("slot", slot).withColumn("__before", before)
    kept = F.col("__before").isNull() | (F.col("slot") > F.col("__before"))
    return steps.withColumn("slot", F.when(kept, F.col("slot"))).drop("__f", "__before", "__in", CHUNK)


def uniquify(
    df: DataFrame, key: list[str], tick: str, seq: list[str], limit: int = COLLISION_LIMIT, dropped: bool = False
) -> DataFrame:
    """Give each row its own ``slot``: its tick, or the next free one, trying
    ``limit`` slots in all; rows that find none are left out, or with ``dropped`` kept
    without a slot.

    Arrivals are taken by tick, then ``seq``. Without the limit the slot of row i
    is i plus the largest (tick - i) so far: a running maximum. That splits the
    rows into runs, a new one beginning where a tick is still free; a run in which
    no row is moved too far is settled. Only crowded runs go the longer way.
    """
    order = [tick, *seq]
    h = History.of(df.withColumn("__t", F.col(tick).cast("bigint")), key, order).number("__i")
    h = h.running_max("__lead", F.col("__t") - F.col("__i"))
    h = h.with_columns(slot=F.col("__i") + F.col("__lead")).previous("__p", F.col("slot"))
    fresh = F.coalesce(F.col("__t") > F.col("__p"), F.lit(True)).cast("bigint")
    rows = h.running_sum("__run", fresh).rows().drop("__i", "__lead", "__p")
    runs, late = [*key, "__run"], F.col("slot") - F.col("__t") >= limit
    if h.chunked:
        rows = materialize(rows)
        crowded = materialize(rows.filter(late).select(*runs).distinct())
        settled = join_on(rows, crowded, runs, "left_anti")
        others = join_on(rows, crowded, runs, "left_semi")
    else:
        # On the partitioning at hand: a run lies within its key.
        rows = rows.withColumn("__late", F.max(late).over(Window.partitionBy(*runs)))
        settled = rows.filter(~F.col("__late")).drop("__late")
        others = rows.filter("__late").drop("__late")
    others = materialize(others.drop("slot"))
    if not others.isEmpty():
        settled = settled.unionByName(_crowded_slots(others, runs, order, limit))
    settled = settled.drop("__t", "__run")
    return settled if dropped else settled.filter(F.col("slot").isNotNull())


def uniquify_stamps(
    df: DataFrame, key: list[str], seq: list[str], limit: int = COLLISION_LIMIT, per_second: int = TICKS_PER_SECOND
) -> DataFrame:
    """Rows with ``sec`` and ``cs`` (of ``per_second`` a second) moved to the next free
    stamp, over the end of a second if need be. A row that finds none in ``limit`` tries
    keeps its stamp and is ``dropped``; the log takes the others."""
    rows = df.withColumn("__tick", F.col("sec").cast("bigint") * per_second + F.col("cs"))
    rows = uniquify(rows, key, "__tick", seq, limit, dropped=True)
    at = F.coalesce("slot", "__tick")
    stamp = {"sec": idiv(at, per_second), "cs": (at % per_second).cast("int"), "dropped": F.col("slot").isNull()}
    return rows.withColumns(stamp).drop("__tick", "slot")


# -- exponential smoothing ------------------------------------------------------

# What a row's weight falls to over one block.
_BLOCK_WEIGHT = 1e-4


def _block_size(alpha: float) -> int:
    return max(1, math.ceil(math.log(_BLOCK_WEIGHT) / math.log(alpha)))


def _composed_blocks(ends: DataFrame, over, decay: float) -> tuple[DataFrame, int]:
    """``__c`` of each block's end with all blocks before it, and how many blocks back
    that reaches: those further off weigh nothing in doubles."""
    factor, blocks = decay, 1
    while factor > 0:
        before = F.coalesce(F.lag("__c", blocks).over(over), F.lit(0.0))
        ends = ends.withColumn("__c", F.col("__c") + before * F.lit(factor))
        blocks, factor = 2 * blocks, factor * factor
    return ends, blocks


def ema_over(h: History, col: str, out: str, alpha: float, seed: str = "zero") -> History:
    """Add ``out``: ``y = alpha * y + (1 - alpha) * x`` over non-NULL samples,
    starting from zero or (``seed="first"``) from the first sample.

    Rows are numbered and cut into blocks of B, with alpha ** B = 1e-4. Inside a
    block the sum is a running sum of x / alpha ** r, which cannot overflow. Each
    block is a step "times alpha ** B, plus c"; the steps are composed by doubling, so
    every earlier row counts. Small and hot keys compute the same sums in the same
    order.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    if seed not in ("zero", "first"):
        raise ValueError("seed must be 'zero' or 'first'")
    size = _block_size(alpha)
    decay = alpha**size
    h = h.number("__i")
    h = h.with_columns(__b=idiv(F.col("__i") - 1, size), __r=(F.col("__i") - 1) % size)
    a = F.lit(alpha)
    weighted = F.col(col).cast("double") * F.lit(1 - alpha) * F.pow(a, -F.col("__r"))
    h = h.with_columns(__w=weighted)
    if h.chunked:  # a block may lie in two chunks
        h = replace(h, df=materialize(h.df))
    block = Window.partitionBy(*h.key, "__b").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    h = h.with_columns(__s=F.sum("__w").over(block))
    end = F.when(F.col("__r") == size - 1, F.col("__s") * F.lit(alpha ** (size - 1)))
    if not h.chunked:
        # Small keys: everything on the window already sorted.
        whole = Window.partitionBy(*h.key).orderBy(*h.order)
        df = h.df.withColumn("__c", end)
        factor, blocks = decay, 1
        while factor > 0:
            before = F.coalesce(F.lag("__c", blocks * size).over(whole), F.lit(0.0))
            df = df.withColumn("__c", F.col("__c") + before * F.lit(factor))
            blocks, factor = 2 * blocks, factor * factor
        h = replace(h, df=df).carry("__enter", F.col("__c"), inclusive=False)
        df = h.df
        if seed == "first":
            first = F.first(F.col(col).cast("double")).over(whole.rowsBetween(Window.unboundedPreceding, 0))
            df = df.withColumn("__x0", first)
    else:
        ends = h.df.select(*h.key, "__b", end.alias("__c")).filter(F.col("__c").isNotNull())
        ends, _ = _composed_blocks(ends, Window.partitionBy(*h.key).orderBy("__b"), decay)
        ends = ends.select(*h.key, (F.col("__b") + 1).alias("__b"), F.col("__c").alias("__enter"))
        df = join_on(h.df, ends, [*h.key, "__b"], "left")
        if seed == "first":
            start = h.df.filter(F.col("__i") == 1).select(*h.key, F.col(col).cast("double").alias("__x0"))
            df = join_on(df, start, list(h.key), "left")
    y = F.pow(a, F.col("__r")) * (F.col("__s") + a * F.coalesce(F.col("__enter"), F.lit(0.0)))
    if seed == "first":
        y = y + F.col("__x0") * F.pow(a, F.col("__i"))
    df = df.withColumn(out, y).drop("__i", "__b", "__r", "__w", "__s", "__c", "__enter", "__x0")
    return replace(h, df=df)


def ema(df: DataFrame, key: list[str], order: list[str], col: str, alpha: float, seed: str = "zero",
        out: str = "ema") -> DataFrame:
    """Smoothed rows of ``df``; rows without a sample are left out first."""
    return ema_over(History.of(df.filter(F.col(col).isNotNull()), key, order), col, out, alpha, seed).rows()


def ema_resumed(
    rows: DataFrame, state: DataFrame, key: list[str], order: list[str], col: str, out: str, alpha: float
) -> tuple[DataFrame, DataFrame]:
    """Smoothing from zero as :func:`ema_over`, gone on with from a ``state`` by key.

    The state is ``<out>_n``, the number of samples so far, ``<out>_s``, the sum in the
    last one's block, and ``<out>_tail``, the ends of the blocks before it as far back as
    they weigh anything, which is a fixed number. All sums are then added in the order in
    which one run over everything adds them, so the results are the same to the last bit.

    Returns the rows with ``out`` (NULL where there is no sample), ``<out>_n``, ``<out>_s``
    and ``<out>_b``, their block, and the tails by key and ``<out>_b``. ``order`` must be
    unique within a key.
    """
    size = _block_size(alpha)
    n, s, b, tail = (f"{out}_{x}" for x in ("n", "s", "b", "tail"))
    none, at = F.lit(None).cast("double"), idiv(F.col(n) - 1, size)

    def cell(block: Column, end: Column, total: Column, count: Column, place: Column) -> Column:
        return F.struct(block.alias(b), end.alias("__c"), total.alias("__w"), count.alias("__count"), place.alias("__o"))

    # One row for every known block, the last one with its samples' number and sum.
    ended = F.transform(
        tail, lambda c, j: cell(at - F.size(tail) + j, c, none, F.lit(0).cast("bigint"), j - F.size(tail) - 1)
    )
    cells = F.concat(ended, F.array(cell(at, none, F.col(s), F.col(n), F.lit(-1))))
    x, a = F.col(col).cast("double"), F.lit(alpha)
    rows = rows.withColumns({"__o": F.lit(0), "__count": x.isNotNull().cast("bigint")})
    rows = rows.unionByName(state.select(*key, F.inline(cells)), allowMissingColumns=True)
    df = History.of(rows, key, ["__o", *order]).running_sum(n, F.col("__count")).rows()
    df = df.withColumns({b: F.coalesce(b, at), "__r": (F.col(n) - 1) % size})
    df = df.withColumn("__w", F.coalesce("__w", x * F.lit(1 - alpha) * F.pow(a, -F.col("__r"))))
    # Rows without a sample come after the one whose place they share.
    block = Window.partitionBy(*key, b).orderBy("__r", F.col("__w").isNull())
    df = df.withColumn(s, F.sum("__w").over(block.rowsBetween(Window.unboundedPreceding, 0)))
    full = (F.col("__r") == size - 1) & F.col("__w").isNotNull()
    end = F.when(full, F.col(s) * F.lit(alpha ** (size - 1)))
    df = materialize(df.withColumn("__c", F.coalesce("__c", end)))
    ends = df.filter(F.col("__c").isNotNull()).select(*key, (F.col(b) + 1).alias(b), "__c", F.col("__c").alias("__own"))
    over = Window.partitionBy(*key).orderBy(b)
    ends, reach = _composed_blocks(ends, over, alpha**size)
    kept = F.collect_list("__own").over(over.rowsBetween(1 - reach, 0))
    ends = materialize(ends.select(*key, b, F.col("__c").alias("__enter"), kept.alias(tail)))
    df = join_on(df.filter("__o = 0"), ends.drop(tail), [*key, b], "left")
    y = F.pow(a, F.col("__r")) * (F.col(s) + a * F.coalesce(F.col("__enter"), F.lit(0.0)))
    df = df.withColumn(out, F.when(x.isNotNull(), y))
    return df.drop("__o", "__count", "__r", "__w", "__c", "__enter"), ends.select(*key, b, tail)
