"""Ordered, per-key views of a table that stay balanced when one key is hot.

A plain window puts all rows of a key into one task. ``History`` counts the rows
per key first. While every key is small it is exactly that plain window: one
shuffle on the key, one sort. Rows of keys above the limit are range-partitioned
on (key, order) and the partition number becomes part of the window key, so a
hot key is worked on by many tasks. What has to cross from one chunk to the next
is one small row per chunk, brought in by an equi join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdline.functions.scalars import col, join_on
from holdline.session import materialize, max_rows

CHUNK = "__chunk"

# Handed-over rows are broadcast up to this many; their number is known.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for ``rows`` rows at most; beyond the bound the planner
    chooses, a sort-merge join if need be."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class History:
    """Rows of ``df`` by ``key``, ascending in ``order`` (unique within a key)."""

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool = False
    edges: int = 0  # at most so many chunks, each key's counted

    @classmethod
    def of(cls, df: DataFrame, key: list[str], order: list[str], counted: DataFrame | None = None) -> History:
        """``counted``, where ``df`` costs much to make: rows with the keys of ``df``, about
        as many of each. They decide only how the work is dealt."""
        limit = max_rows(df.sparkSession)
        counts = (df if counted is None else counted).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        small = F.col("__n") <= limit
        keys, rows = counts.agg(F.count_if(~small), F.sum(F.when(~small, F.col("__n")))).first()
        if not keys:
            return cls(df, tuple(key), tuple(order))
        hot = _small(materialize(counts.filter(~small).select(*key)), keys)
        chunks = max(math.ceil(rows / limit), 2)
        spread = (
            join_on(df, hot, key, "left_semi")
            .repartitionByRange(chunks, *key, *order)
            .withColumn(CHUNK, F.spark_partition_id() + 1)
        )
        # Written once: partition numbers must not change between the reads below.
        spread = materialize(spread)
        rest = join_on(df, hot, key, "left_anti").withColumn(CHUNK, F.lit(0))
        return cls(rest.unionByName(spread), tuple(key), tuple(order), True, chunks + keys)

    # -- plumbing -----------------------------------------------------------

    @property
    def part(self) -> list[str]:
        return [*self.key, CHUNK] if self.chunked else list(self.key)

    def window(self):
        """The rows of a key, or of one chunk of it, in order."""
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def _before(self, inclusive: bool):
        return self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def _with(self, df: DataFrame) -> History:
        return replace(self, df=df)

    def _enter(self, name: str, summary: Column, over_chunks) -> DataFrame:
        """Join, per chunk of a hot key, what the other chunks hand over.

        ``over_chunks`` maps the summary column to an expression over the chunks
        of the key; there is one summary row per chunk.
        """
        edges = self.df.filter(F.col(CHUNK) > 0).groupBy(*self.part).agg(summary.alias("__edge"))
        entry = edges.select(*self.part, over_chunks(F.col("__edge")).alias(name))
        return self.join_entry(self.df, entry)

    def join_entry(self, df: DataFrame, entry: DataFrame) -> DataFrame:
        """Left join of one row per chunk. That side is written first, or every
        further step would plan all the steps before it twice."""
        return join_on(df, _small(materialize(entry), self.edges), self.part, "left")

    def _chunks(self):
        return Window.partitionBy(*self.key).orderBy(CHUNK)

    def _rank(self) -> Column:
        return F.struct(*self.order)

    # -- row by row ----------------------------------------------------------

    def with_columns(self, **cols: Column) -> History:
        return self._with(self.df.withColumns(cols))

    def filter(self, cond: Column) -> History:
        return self._with(self.df.filter(cond))

    def drop(self, *cols: str) -> History:
        return self._with(self.df.drop(*cols))

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK)

    # -- ordered -------------------------------------------------------------

    def _neighbour(self, name, expr, default, step, pick) -> History:
        box = F.struct(col(expr).alias("v"))
        near = step(box).over(self.window())
        df = self.df
        if self.chunked:
            df = self._enter("__in", pick(box, self._rank()), lambda e: step(e).over(self._chunks()))
            near = F.coalesce(near, F.col("__in"))
        if default is not None:
            near = F.coalesce(near, F.struct(default.alias("v")))
        return self._with(df.withColumn(name, near).withColumn(name, F.col(f"{name}.v")).drop("__in"))

    def previous(self, name: str, expr: Column | str, default: Column | None = None) -> History:
        """``expr`` at the row before; ``default`` at the first row of a key."""
        return self._neighbour(name, expr, default, F.lag, F.max_by)

    def following(self, name: str, expr: Column | str, default: Column | None = None) -> History:
        """``expr`` at the row after; ``default`` at the last row of a key."""
        return self._neighbour(name, expr, default, F.lead, F.min_by)

    def carry(self, name: str, expr: Column, inclusive: bool = True) -> History:
        """Last non-NULL ``expr`` so far. Wrap a value in a struct to carry its NULLs."""
        held = F.last(expr, ignorenulls=True).over(self._before(inclusive))
        df = self.df
        if self.chunked:
            df = self._enter(
                "__in",
                F.max_by(expr, F.when(expr.isNotNull(), self._rank())),
                lambda e: F.last(e, ignorenulls=True).over(
                    self._chunks().rowsBetween(Window.unboundedPreceding, -1)
                ),
            )
            held = F.coalesce(held, F.col("__in"))
        return self._with(df.withColumn(name, held).drop("__in"))

    def running_max(self, name: str, expr: Column, inclusive: bool = True) -> History:
        top = F.max(expr).over(self._before(inclusive))
        df = self.df
        if self.chunked:
            df = self._enter(
                "__in",
                F.max(expr),
                lambda e: F.max(e).over(
                    self._chunks().rowsBetween(Window.unboundedPreceding, -1)
                ),
            )
            top = F.greatest(top, F.col("__in"))
        return self._with(df.withColumn(name, top).drop("__in"))

    def running_sum(self, name: str, expr: Column, inclusive: bool = True) -> History:
        total = F.coalesce(F.sum(expr).over(self._before(inclusive)), F.lit(0))
        df = self.df
        if self.chunked:
            df = self._enter(
                "__in",
                F.sum(expr),
                lambda e: F.sum(e).over(
                    self._chunks().rowsBetween(Window.unboundedPreceding, -1)
                ),
            )
            total = total + F.coalesce(F.col("__in"), F.lit(0))
        return self._with(df.withColumn(name, total).drop("__in"))

    def number(self, name: str) -> History:
        """Position of the row within its key, from 1."""
        place = F.row_number().over(self.window()).cast("bigint")
        df = self.df
        if self.chunked:
            df = self._enter(
                "__in",
                F.count(F.lit(1)),
                lambda e: F.sum(e).over(
                    self._chunks().rowsBetween(Window.unboundedPreceding, -1)
                ),
            )
            place = place + F.coalesce(F.col("__in"), F.lit(0))
        return self._with(df.withColumn(name, place).drop("__in"))
