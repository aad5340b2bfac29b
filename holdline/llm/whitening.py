"""Whitened vectors, by the exact characteristic polynomial of their scatter.

Components become integers x. One pass adds up the sums S over the n vectors, a second one
the products of the integers less a whole centre near the mean. From them follows, without
rounding, the matrix C = n * (sum of x x^T) - S S^T, n squared times the covariance V. Its
characteristic polynomial is computed modulo many primes, one task of Spark for some
primes each, and its greatest roots and their null vectors to double precision and beyond
(see ``charpoly``). Only matrices of length by length are on the driver.

A vector's whitened coordinate is its centred projection on a unit eigenvector over the
square root of the eigenvalue.

Defined cases. Vectors that are null or hold null or non-finite components are dropped, and
so are those of another length than most have (of several the greatest). Equal eigenvalues
have orthogonal components in some order. Components without variance cannot be whitened
and are left out, so that equal vectors, or a single one, have no rows. Repeated rows and
rows without an id count and come out like others; other columns are ignored. An empty
table gives an empty table. An exact deviation has up to 38 digits; a larger one ends the
job with an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StringType, StructField, StructType

from holdline.llm import charpoly, common, vectors

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8

_SUMS_DDL = "i int, j int, total string, n long"
_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.string()), ("n", pa.int64())])


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: number and sums of the integers fitted to, and for every
    component, by falling eigenvalue, its unit vector, root and share of the variance."""

    n: int
    sums: list[int]
    axes: list[list[float]]
    roots: list[float]
    shares: list[float]


def _integers(batch: pa.RecordBatch, length: int) -> np.ndarray:
    x = np.floor(vectors.matrix(batch, length) * SCALE)
    if len(x) and np.abs(x).max() >= 1 << 52:
        raise ValueError("a component too large for an exact deviation")
    return x.astype(np.int64) + OFFSET


def _squares(x: np.ndarray) -> np.ndarray:
    """x^T x exactly, as Python's integers."""
    most = int(np.abs(x).max()) if x.size else 0
    if most * most * max(1, len(x)) < 1 << 53:  # every sum fits a double
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _totals(rows: DataFrame, length: int, centre: list[int] | None = None) -> tuple[int, dict[tuple[int, int], int]]:
    """The number of rows, and the sums of the integers by place (i, -1) or, given a
    centre, of the products of two centred ones by places i <= j."""

    def sums(batches):
        n, total = 0, np.zeros((length, length) if centre else length, object)
        for b in vectors.joined(batches):
            x = _integers(b, length)
            n += len(x)
            total = total + (_squares(x - np.array(centre, np.int64)) if centre else x.sum(0).astype(object))
        places = [(i, j) for i in range(length) for j in range(i, length)] if centre else [(i, -1) for i in range(length)]
        values = [str(total[i, j] if centre else total[i]) for i, j in places]
        i, j = zip(*places)
        yield common.batch({"i": i, "j": j, "total": values, "n": [n] * len(places)}, _SUMS)

    found = rows.select("vector").mapInArrow(sums, _SUMS_DDL).groupBy("i", "j")
    found = found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = found.collect()  # a row for each place of the matrix
    return max((r["n"] for r in out), default=0), {(r["i"], r["j"]): int(r["total"]) for r in out}


def _polynomial(spark: SparkSession, matrix: charpoly.Matrix) -> list[int]:
    """The matrix' sums of products of eigenvalues; each task takes some primes."""
    primes = charpoly.enough_primes(matrix)
    residues = F.udf(lambda p: charpoly.residues(matrix, p), "array<long>")
    table = spark.createDataFrame([(p,) for p in primes], "prime long")
    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = table.repartition(tasks).select("prime", residues("prime").alias("residues")).collect()
    return charpoly.combined({r["prime"]: r["residues"] for r in rows})


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """The greatest ``components`` of the ``vector`` column of ``rows``."""
    n, found = _totals(rows, length)
    sums = [found[i, -1] for i in range(length)] if n else [0] * length
    if not n:
        return Whitening(0, sums, [], [], [])
    centre = [(2 * s + n) // (2 * n) for s in sums]
    _, products = _totals(rows, length, centre)
    rest = [s - n * c for s, c in zip(sums, centre)]
    matrix = [[n * products[min(i, j), max(i, j)] - rest[i] * rest[j] for j in range(length)] for i in range(length)]
    trace = sum(matrix[i][i] for i in range(length))
    if not trace:
        return Whitening(n, sums, [], [], [])
    roots, bits = charpoly.greatest_roots(_polynomial(rows.sparkSession, matrix), components)
    axes, values = [], []
    for root, times in roots:
        axes += charpoly.null_vectors(matrix, root, bits, times)
        values += [root] * times
    with localcontext() as context:
        context.prec = 60
        scaled = [Decimal(v) / (1 << bits) for v in values[:components]]
        shares = [float(v / trace) for v in scaled]
        deviations = [float(v.sqrt() / n) for v in scaled]
    return Whitening(n, sums, axes[:components], deviations, shares)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """For every row the sum of (n * x - S)^2, exactly."""
    if not len(x):
        return []
    if n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62:
        d = n * x - sums.astype(np.int64)
        if int(np.abs(d).max()) ** 2 * len(sums) < 1 << 63:
            return [int(v) for v in (d * d).sum(1)]
    d = n * x.astype(object) - sums
    return list((d * d).sum(1))


def whitened(rows: DataFrame, length: int, model: Whitening) -> DataFrame:
    """``rows`` as (id, deviation decimal(38,0), whitened array of doubles)."""
    out = StructType([rows.schema["id"], StructField("deviation", StringType()), StructField("whitened", ArrayType(DoubleType()))])
    k = len(model.axes)

    def coordinates(batches):
        n, sums = model.n, np.array(model.sums, object)
        centre = np.array([s // n for s in model.sums], np.int64)
        rest = np.array([(s % n) / n for s in model.sums])
        axes = np.array(model.axes).T / np.array(model.roots)
        for b in vectors.joined(batches):
            x = _integers(b, length)
            w = ((x - centre).astype(np.float64) - rest) @ axes
            deviations = [str(d) for d in _deviations(x, n, sums)]
            offsets = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            columns = [b.column("id"), pa.array(deviations, pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "deviation", "whitened"])

    done = rows.select("id", "vector").mapInArrow(coordinates, out)
    return done.withColumn("deviation", F.col("deviation").cast(DecimalType(38, 0)))


def identity_error(done: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = done.select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(components)])
    # Spark's covariance is of centred values, merged as such.
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def components(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for every vector and component: (``id_col``, component from 1, n, deviation
    decimal(38,0), whitened, explained, identity_error)."""
    rows, length = vectors.usable(df, id=id_col, vector=vector_col)
    common.bounded_batches(rows)
    model = fit(rows, length, components) if length else Whitening(0, [], [], [], [])
    if model.axes:
        done = common.written(whitened(rows, length, model), "whitened")
        error = identity_error(done, len(model.axes))
    else:
        done = rows.filter("false").select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"), "vector")
        done, error = done.withColumnRenamed("vector", "whitened"), 0.0
    out = done.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(x) for x in model.shares]).cast("array<double>")
    return out.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
