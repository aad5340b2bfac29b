"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of times each of its documents should occur on average:
its target share of the wanted total over its present total. Every row draws its number
of copies from a Poisson distribution with that rate, by inverting the distribution at
a uniform number made from a keyed hash of the row. Copies are numbered and put in the
order of another keyed hash, so the same rows and seed always give the same mixture, and
a lost task repeats exactly what it did.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.llm import common

# A sum of independent draws has the Poisson distribution of the summed rates, so rates
# above this are drawn as several equal ones.
LARGEST_DRAW = 8.0
# The draw ends here: at the largest rate, the chance of more is below 2^-52.
_TERMS = 48
_UNIT = float(1 << 52)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a keyed MD5."""
    texts = [F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / _UNIT


def cumulative(rate: Column) -> Column:
    """The distribution of a draw with ``rate``: the chances of at most 0, 1, 2, ..."""
    none = F.exp(-rate)
    start = F.struct(none.alias("term"), F.array(none).alias("upto"))

    def step(state, k):
        term = state["term"] * rate / k.cast("double")
        upto = F.array_append(state["upto"], F.element_at(state["upto"], -1) + term)
        return F.struct(term.alias("term"), upto.alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS - 1)), start, step, lambda s: s["upto"])


def poisson(draws: Column, upto: Column, seed: int, *parts: Column) -> Column:
    """The sum of ``draws`` inversions of the distribution ``upto``, each at a number of
    its own that seed and ``parts`` make."""

    def drawn(u: Column) -> Column:
        return F.size(F.filter(upto, lambda chance: u >= chance)).cast("bigint")

    first = drawn(uniform(seed, *parts))
    more = F.sequence(F.lit(1), draws.cast("int") - 1)
    rest = F.aggregate(more, F.lit(0).cast("bigint"), lambda n, j: n + drawn(uniform(seed, *parts, j)))
    return F.when(draws > 1, first + rest).otherwise(first)


def rates(
    docs: DataFrame,
    weights: Mapping[str, float],
    factor: float = 1.0,
    source_col: str = "source",
    default: float = 0.0,
) -> DataFrame:
    """(mix_source, mix_rate, mix_draws, mix_upto): copies wanted of each row on average,
    in how many draws, and the distribution of one.

    ``factor`` is the size wanted, in characters of the present total. Weights are
    divided by the sum of those of the sources that are there with some text. Sources
    that ``weights`` does not name, the null one included, have the weight ``default``;
    a weight of 0 leaves a source out.
    """
    spark = docs.sparkSession
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(size).alias("size"))
    sizes = common.written(sizes, "source-sizes")  # read three times below
    given = [(str(k), float(v)) for k, v in weights.items()]
    wanted = spark.createDataFrame(given, "mix_source string, weight double")
    rows = sizes.filter("size > 0").join(F.broadcast(wanted), "mix_source", "left")
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(float(default)))).filter("weight > 0")
    total = sizes.agg(F.sum("size").alias("total"))
    share = rows.agg(F.sum("weight").alias("weights"))
    rate = F.lit(factor) * F.col("weight") / F.col("weights") * F.col("total") / F.col("size")
    # One row each, so these are no joins of rows with rows.
    rows = rows.crossJoin(F.broadcast(share)).crossJoin(F.broadcast(total))
    rows = rows.select("mix_source", rate.alias("mix_rate"))
    rows = rows.withColumn("mix_draws", F.greatest(F.lit(1.0), F.ceil(F.col("mix_rate") / LARGEST_DRAW).cast("double")))
    return rows.withColumn("mix_upto", cumulative(F.col("mix_rate") / F.col("mix_draws")))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float],
    factor: float = 1.0,
    seed: int = 0,
    source_col: str = "source",
    default: float = 0.0,
) -> DataFrame:
    """The rows of ``docs`` as often as drawn, with ``copy`` (from 0) and ``position``,
    the number they are sorted by all over.

    A repeated row draws with its id like the first, so equal rows have equal counts. A
    null id draws as itself; a null text has no size but is replicated like any row of
    its source. Columns named copy or position are replaced. An empty table, or one
    without a weighted source, gives no rows.
    """
    docs = docs.drop("copy", "position")
    # As many rows as there are sources with a weight; the planner sees their size.
    given = common.written(rates(docs, weights, factor, source_col, default), "source-rates")
    # The row in a place of its own, so its columns may have any name.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.join(given, F.col("row").getField(source_col).eqNullSafe(F.col("mix_source")))
    own_id = F.col("row").getField("doc_id")
    drawn = poisson(F.col("mix_draws"), F.col("mix_upto"), seed, own_id)
    rows = rows.withColumn("mix_copies", drawn).filter("mix_copies > 0")
    rows = rows.select("row", F.explode(F.expr("sequence(0L, mix_copies - 1)")).alias("copy"))
    rows = rows.withColumn("position", uniform(seed + 1, own_id, F.col("copy")))
    # Positions are spread evenly, so equal ranges of them need no sample of the rows.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(n, F.floor(F.col("position") * n).cast("int"))
    rows = rows.sortWithinPartitions("position", own_id, "copy")
    return rows.select("row.*", "copy", "position")


def mixed_sql(
    weights: Mapping[str, float], factor: float, seed: int, columns: str, docs: str = "documents", default: float = 0.0
) -> str:
    """SQL that gives the same rows as ``mixed``, where ids are there and name a row each."""
    values = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in weights.items())
    unit = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    own = f"'{seed}|' || doc_id || CASE WHEN j = 0 THEN '' ELSE '|' || j END"
    return f"""WITH RECURSIVE docs AS (SELECT * FROM {docs}),
    wanted(name, given) AS (VALUES {values}),
    sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM docs GROUP BY source),
    weighted AS (SELECT source, size, coalesce(given, CAST({default!r} AS DOUBLE)) AS weight
      FROM sizes LEFT JOIN wanted ON source = name WHERE size > 0),
    rated AS (
      SELECT source, CAST({factor!r} AS DOUBLE) * weight / sum(weight) OVER ()
        * CAST((SELECT sum(size) FROM sizes) AS BIGINT) / CAST(size AS BIGINT) AS rate
      FROM weighted WHERE weight > 0),
    parts AS (SELECT source, greatest(1, ceil(rate / 8.0)) AS draws, rate / greatest(1, ceil(rate / 8.0)) AS rest FROM rated),
    terms(source, rest, k, term, upto) AS (
      SELECT source, rest, 0, exp(-rest), exp(-rest) FROM parts
      UNION ALL
      SELECT source, rest, k + 1, term * rest / CAST(k + 1 AS DOUBLE), upto + term * rest / CAST(k + 1 AS DOUBLE)
      FROM terms WHERE k < 47),
    draws AS (SELECT doc_id, d.source, unnest(range(CAST(p.draws AS BIGINT))) AS j
      FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
    drawn AS (
      SELECT doc_id, count(*) FILTER (WHERE u >= t.upto) AS copies
      FROM (SELECT *, {unit.format(own)} AS u FROM draws) d
      JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY doc_id),
    copies AS (SELECT doc_id, unnest(range(copies)) AS copy FROM drawn)
    SELECT {columns}, copy, {unit.format(f"'{seed + 1}|' || doc_id || '|' || copy")} AS position
    FROM docs JOIN copies USING (doc_id)"""
