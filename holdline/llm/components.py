"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest of itself and all."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written: a join splits a frequent key only if it stands on two plain shuffles.
    least = common.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = common.written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    own = least.select("a", F.col("m").alias("b"))
    others = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none upwards."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("end")).select("end.*")
    ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node that the columns ``a`` and ``b`` name; the
    component is its smallest node.

    Large and small stars alternate, each written to the shared folder. A node with
    many edges costs a partial minimum per task and a join that Spark can split.
    Loops, repeated edges and edges with a null end are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.dropna(subset=["a", "b"]).filter("a <> b")
    edges = common.written(edges.select(high.alias("a"), low.alias("b")).distinct(), "edges")
    while not _is_settled(edges):
        edges = common.written(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def block_roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches by ``links`` among the rows of a block."""
    labels = ids.copy()
    while True:
        least = np.where(links, labels[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        least = np.minimum(labels, least)
        if (least == labels).all():
            return labels
        labels = least
