"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order. Inverted
lists by label and pivot hold the vectors that name a pivot; two vectors are compared
in the list of the first pivot they share, and link if the cosine, in double precision,
reaches the threshold. Pivots are a bounded sample, no two of them close: members of a
group that link although they lie on different sides of its centre would else name
different ones of the group's many pivots. Every vector is indexed.

Equal vectors of a label are one node. A dense group would fill a list, so dense cells
of the index get a centre each. All vectors within half the linking angle of a centre
link with one another, whatever they are (angles obey the triangle inequality), so they
are counted, not compared, and stay out of the lists. They are compared only with
vectors close enough to the centre to reach them, which are few.

Long lists are cut in blocks by a hash, and pairs of blocks are compared in one task
each; what leaves it is a count and one edge per vector, never a pair per link.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common
from holdline.llm.components import block_roots, components

THRESHOLD = 0.93
# Pivots: the square root of the number of vectors, within these bounds; of a dimension
# that the sample has fewer of, fixed directions are added up to the lower one.
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
# Pivots that describe a vector, and the least angle of two pivots in linking angles.
NAMED, APART = 8, 1.5
# Vectors of a cell that make it dense, cells that get a centre, and the angle (radians)
# under which two centres are one.
DENSE, MOST_CENTRES, SAME_CENTRE = 64, 1024, 0.05
BLOCK_ROWS = 1024

_ROWS_DDL = "id long, label int, dim int, content binary, vector binary"
_ROWS = pa.schema(
    [("id", pa.int64()), ("label", pa.int32()), ("dim", pa.int32()), ("content", pa.binary()), ("vector", pa.binary())]
)
_FOUND_DDL = "id long, links long, root long"
_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _valid(values) -> np.ndarray | None:
    """The unit vector, if there is one."""
    if values is None or not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()  # so that no square over- or underflows
    return x / np.sqrt(x @ x)


def _prepared(batches):
    for ids, labels, vectors in common.columns_of(batches, "id", "label", "vector"):
        rows = []
        for i, label, values in zip(ids, labels, vectors):
            unit = None if i is None or label is None else _valid(values)
            if unit is None:
                rows.append((i, label, None, None, None))
            else:
                given = np.array(values, np.float64) + 0.0  # minus zero is zero
                rows.append((i, label, len(unit), xxhash.xxh3_128_digest(given.tobytes()), unit.tobytes()))
        yield common.batch({f.name: list(c) for f, c in zip(_ROWS, zip(*rows))} if rows else {f.name: [] for f in _ROWS}, _ROWS)


def apart(vectors: list[bytes], threshold: float) -> list[bytes]:
    """Those of unit ``vectors`` that are not close to an earlier one that stays."""
    x = np.stack([np.frombuffer(v) for v in vectors])
    limit = math.cos(min(math.pi, APART * math.acos(threshold)))
    free, out = np.ones(len(x), bool), []
    for i, vector in enumerate(vectors):
        if free[i]:
            out.append(vector)
            free &= x @ x[i] <= limit
    return out


def directions(dim: int, n: int) -> np.ndarray:
    x = np.random.default_rng(dim).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Pivots:
    """Reference points by dimension."""

    def __init__(self, sample: dict[int, list[bytes]]):
        self.of = {d: np.stack([np.frombuffer(v) for v in vs]) for d, vs in sample.items()}

    def matrix(self, dim: int) -> np.ndarray:
        own = self.of.get(dim, np.empty((0, dim)))
        if len(own) < LEAST_PIVOTS:
            own = self.of[dim] = np.concatenate([own, directions(dim, LEAST_PIVOTS - len(own))])
        return own

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The numbers of the nearest pivots of each row, the nearest first."""
        near = vectors @ self.matrix(vectors.shape[1]).T
        top = np.argpartition(-near, NAMED - 1, axis=1)[:, :NAMED]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1).astype(np.int32)


def _by_dim(dims: list[int], vectors: list[bytes]):
    """Rows of one dimension together: their places and their matrix."""
    places = defaultdict(list)
    for i, d in enumerate(dims):
        places[d].append(i)
    for at in places.values():
        yield at, np.stack([np.frombuffer(vectors[i]) for i in at])


def _indexed(shared):
    schema = pa.schema([*(f for f in _NODES), ("named", pa.list_(pa.int32())), ("cell", pa.int64())])

    def run(batches):
        for cols in common.columns_of(batches, *(f.name for f in _NODES)):
            rows = dict(zip((f.name for f in _NODES), cols))
            named, cell = [None] * len(rows["id"]), [0] * len(rows["id"])
            for at, matrix in _by_dim(rows["dim"], rows["vector"]):
                for i, pivots in zip(at, shared.value.nearest(matrix)):
                    named[i] = pivots
                    cell[i] = int(pivots[0]) << 32 | int(pivots[1]) << 16 | int(pivots[2])
            yield common.batch(rows | {"named": named, "cell": cell}, schema)

    return run


_NODES = (
    pa.field("id", pa.int64()),
    pa.field("label", pa.int32()),
    pa.field("dim", pa.int32()),
    pa.field("copies", pa.int64()),
    pa.field("vector", pa.binary()),
)
_NODES_DDL = "id long, label int, dim int, copies long, vector binary"


def _cell_sums(batches):
    """The number and sum of each partition's vectors by cell."""
    sums, counts = {}, defaultdict(int)
    for rows in common.columns_of(batches, "label", "dim", "cell", "vector"):
        for label, dim, cell, vector in zip(*rows):
            key = label, dim, cell
            counts[key] += 1
            sums[key] = sums.get(key, 0) + np.frombuffer(vector)
    schema = pa.schema([("label", pa.int32()), ("dim", pa.int32()), ("cell", pa.int64()), ("sums", pa.list_(pa.float64()))])
    keys = list(counts)
    cols = dict(zip(("label", "dim", "cell"), zip(*keys))) if keys else {"label": [], "dim": [], "cell": []}
    yield common.batch({k: list(v) for k, v in cols.items()} | {"sums": [sums[k] for k in keys]}, schema)


def _centres(nodes: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(label, dim, unit vector) of the densest cells, those close to a denser one left
    out; at most ``MOST_CENTRES``."""
    cells = nodes.groupBy("label", "dim", "cell").count().filter(F.col("count") >= DENSE)
    cells = cells.orderBy(F.desc("count"), "label", "dim", "cell").limit(MOST_CENTRES)
    cells = common.written(cells, "dense-cells")  # few rows by the limit
    inside = nodes.join(F.broadcast(cells.drop("count")), ["label", "dim", "cell"], "left_semi")
    parts = common.bounded_batches(inside).mapInArrow(_cell_sums, "label int, dim int, cell long, sums array<double>")
    parts = parts.select("label", "dim", "cell", F.posexplode("sums").alias("axis", "part"))
    sums = parts.groupBy("label", "dim", "cell", "axis").agg(F.sum("part").alias("part"))
    sums = sums.groupBy("label", "dim", "cell").agg(F.collect_list(F.struct("axis", "part")).alias("parts"))
    rows = sums.join(cells, ["label", "dim", "cell"]).orderBy(F.desc("count"), "label", "dim", "cell").collect()
    out = []
    for row in rows:
        x = np.array([p["part"] for p in sorted(row["parts"], key=lambda p: p["axis"])])
        if x.any():
            x = x / np.linalg.norm(x)
            near = (c @ x > math.cos(SAME_CENTRE) for label, dim, c in out if (label, dim) == (row["label"], row["dim"]))
            if not any(near):
                out.append((row["label"], row["dim"], x))
    return out


class _Cores:
    """Centres by label and dimension, and the angles around them."""

    def __init__(self, centres, threshold: float):
        places = defaultdict(list)
        for n, (label, dim, vector) in enumerate(centres):
            places[label, dim].append((n, vector))
        self.of = {k: (np.array([n for n, _ in v]), np.stack([x for _, x in v])) for k, v in places.items()}
        angle = math.acos(threshold)
        # Just inside and outside the exact angles, so rounding decides nothing.
        self.core, self.reach = math.cos(angle / 2 - 1e-7), math.cos(min(math.pi, angle * 1.5 + 1e-7))

    def place(self, label: int, matrix: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The core of each vector, or -1, and the other cores whose members it may
        link with."""
        numbers, centres = self.of.get((label, matrix.shape[1]), (None, None))
        if numbers is None:
            return np.full(len(matrix), -1), [[] for _ in matrix]
        near = matrix @ centres.T
        best = near.argmax(axis=1)
        core = np.where(near[np.arange(len(matrix)), best] >= self.core, numbers[best], -1)
        # Of two cores the pair is looked at from the later one.
        close = (near >= self.reach) & ((core[:, None] < 0) | (numbers[None, :] < core[:, None]))
        return core, [numbers[row].tolist() for row in close]


def _placed(shared):
    schema = pa.schema([*_NODES, ("named", pa.list_(pa.int32())), ("core", pa.int32()), ("border", pa.list_(pa.int32()))])

    def run(batches):
        for cols in common.columns_of(batches, *(f.name for f in _NODES), "named"):
            rows = dict(zip((*(f.name for f in _NODES), "named"), cols))
            core, border = [-1] * len(rows["id"]), [[]] * len(rows["id"])
            for label in set(rows["label"]):
                of = [i for i, x in enumerate(rows["label"]) if x == label]
                for at, matrix in _by_dim([rows["dim"][i] for i in of], [rows["vector"][i] for i in of]):
                    for i, c, b in zip(at, *shared.value.place(label, matrix)):
                        core[of[i]], border[of[i]] = int(c), b
            yield common.batch(rows | {"core": core, "border": border}, schema)

    return run


def _compared(threshold: float):
    """Compare two blocks of a list, or one with itself. Rows: id, copies, vector, named,
    side (0: the first block, 1: the second, 2: both), pivot (-1: members of a core with
    those around it)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        side = np.array(rows["side"])
        ids, copies = np.array(rows["id"], np.int64), np.array(rows["copies"], np.int64)
        pivot = rows["pivot"][0]
        x = np.stack([np.frombuffer(v) for v in rows["vector"]])
        a, b = (np.nonzero(side != other)[0] for other in (1, 0))
        links = x[a] @ x[b].T >= threshold
        if pivot >= 0:
            # Pairs with an earlier pivot in common are compared in its list.
            named = np.array(rows["named"])
            earlier = named < pivot
            values, places = np.unique(np.where(earlier, named, -1), return_inverse=True)
            has = np.zeros((len(x), len(values)), np.float32)
            np.put_along_axis(has, places.reshape(named.shape), 1, axis=1)
            has[:, values < 0] = 0
            links &= has[a] @ has[b].T == 0
        whole = np.zeros((len(x), len(x)), bool)
        whole[np.ix_(a, b)] = links
        whole |= whole.T
        np.fill_diagonal(whole, False)
        counts = whole @ copies
        found = np.nonzero(counts)[0]
        roots = block_roots(whole, ids)
        return pa.table([ids[found], counts[found], roots[found]], schema=_FOUND)

    return run


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (with their ``side``) dealt to pairs of blocks of the lists that ``keys``
    name: ``first`` and ``second``."""
    sizes = rows.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    rows = rows.join(common.written(sizes, "list-sizes"), list(keys))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})


def _list_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links among vectors outside the cores, through the inverted lists."""
    rows = nodes.filter("core < 0").select("*", F.explode("named").alias("pivot"))
    rows = _blocks(rows, "label", "dim", "pivot")
    side = F.when(F.col("first") == F.col("second"), 2).when(F.col("own") == F.col("first"), 0).otherwise(1)
    rows = rows.withColumn("side", side)
    # A list of one has nothing to compare.
    rows = rows.select("label", "dim", "pivot", "first", "second", "side", "id", "copies", "vector", "named")
    return rows.groupBy("label", "dim", "pivot", "first", "second").applyInArrow(_compared(threshold), _FOUND_DDL)


def _core_links(nodes: DataFrame) -> DataFrame:
    """Links within each core: all of them."""
    cores = nodes.filter("core >= 0").groupBy("core").agg(F.sum("copies").alias("all"), F.min("id").alias("root"))
    # As many rows as centres.
    rows = nodes.filter("core >= 0").join(F.broadcast(cores), "core").filter(F.col("all") > F.col("copies"))
    return rows.select("id", (F.col("all") - F.col("copies")).alias("links"), "root")


def _border_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links between members of a core and the vectors around it."""
    columns = ("id", "copies", "vector", "named")
    around = nodes.select(F.explode("border").alias("core"), *columns, F.lit(1).alias("side"))
    around = common.written(around, "core-borders")
    members = nodes.filter("core >= 0").select("core", *columns, F.lit(0).alias("side"))
    # As many cores as centres.
    members = members.join(F.broadcast(around.select("core").distinct()), "core", "left_semi")
    both = members.unionByName(around)
    sizes = both.groupBy("core", "side").count().select("core", "side", F.ceil(F.col("count") / BLOCK_ROWS).alias("n"))
    sizes = sizes.groupBy("core").agg(*[F.max(F.when(F.col("side") == s, F.col("n"))).alias(f"n{s}") for s in (0, 1)])
    both = both.join(F.broadcast(sizes), "core").filter("n0 IS NOT NULL AND n1 IS NOT NULL")
    mine = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))
    theirs = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    both = both.withColumn("own", F.pmod(F.xxhash64("id"), mine))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), theirs - 1)))
    first, second = (F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("own", "other"), ("other", "own")))
    both = both.select("core", first.alias("first"), second.alias("second"), *columns, "side", F.lit(-1).alias("pivot"))
    return both.groupBy("core", "first", "second").applyInArrow(_compared(threshold), _FOUND_DDL)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: the other rows of its label whose
    cosine with it was found to reach ``threshold``, the smallest id that links reach,
    and whether that is its own.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null label or id, link with nothing, as do vectors of different dimensions. A
    row with a null id has a null component and is not kept. Rows that repeat a vector
    under their label link with each other, under the same id too. Other columns are
    ignored, an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a positive cosine")
    spark = vectors.sparkSession
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("int").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = common.written(common.bounded_batches(given).mapInArrow(_prepared, _ROWS_DDL), "vectors")
    nodes = rows.filter("content IS NOT NULL").groupBy("label", "content", "dim")
    nodes = nodes.agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # A node's number, fixed as it is written: ids may be repeated under other vectors.
    own = common.written(nodes.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(own.count())))
    sample = defaultdict(list)
    for row in own.orderBy(F.xxhash64("content"), "id").limit(wanted).select("dim", "vector").collect():
        sample[row["dim"]].append(bytes(row["vector"]))
    pivots = spark.sparkContext.broadcast(_Pivots({dim: apart(of, threshold) for dim, of in sample.items()}))
    indexed = own.select("id", "label", "dim", "copies", "vector").mapInArrow(
        _indexed(pivots), f"{_NODES_DDL}, named array<int>, cell long"
    )
    indexed = common.written(indexed, "pivot-index")
    cores = spark.sparkContext.broadcast(_Cores(_centres(indexed), threshold))
    placed = indexed.select(*(f.name for f in _NODES), "named").mapInArrow(
        _placed(cores), f"{_NODES_DDL}, named array<int>, core int, border array<int>"
    )
    placed = common.written(placed, "placed-vectors")

    found = _core_links(placed).unionByName(_list_links(placed, threshold)).unionByName(_border_links(placed, threshold))
    found = common.written(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = own.select("id", "label", "content", "node", "copies")
    named = named.join(counts, "id", "left").join(tied, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    # Components were of numbers; their smallest ids.
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    named = named.join(common.written(least, "vector-components"), "component")
    links = F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("bigint"))
    named = common.written(named.select("label", "content", links.alias("n_links"), "component_id"), "vector-names")

    out = rows.select("id", "label", "content").join(named, ["label", "content"], "left")
    out = out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
