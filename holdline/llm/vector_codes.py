"""Vectors as short codes: the nearest codebook entry of each part, exactly.

Components become integers, a vector is cut in equal parts, and every part position has
a codebook of at most 64 entries, trained by a fixed number of rounds of k-means in
integers. All results are the same whatever the partitions.

The nearest entry is found by slicing and intersecting. For each dimension of a part the
entries' coordinates are sorted, and a uint64 mask is kept for every prefix of that order:
which entries it has. A radius around a coordinate is a range of the order, two prefix
masks differ by the entries in it, and the AND over the dimensions leaves the entries in
the box. Their distances are computed; the least one is exact once it is not greater than
the radius, as every entry that near lies in the box. An initial radius, from the
distances of the entries to one another, settles most parts. The others go on with the
distance found, which always settles them, or with twice the radius if the box is empty.

Only sums and counts per entry leave a task, and only the codebooks, of fixed size, are on
the driver.

Defined cases. Vectors that are null or hold null or non-finite components are dropped, and
so are those of another length than most have (of several the greatest; a multiple of the
number of parts). With fewer vectors than entries the codebooks are shorter. Rows without
an id come last in the order that codebooks start with, rows of equal id by their vector;
repeated rows count each. Labels are compared in their own type, null with null. Other
columns are ignored. An empty table gives an empty table. A component beyond 65,536 ends
the job with an error, as no long can be sure to hold its squares.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from holdline.llm import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 24
_FAR = np.iinfo(np.int64).max

_SUMS_DDL = "part int, entry int, place int, total long, n long"
_SUMS = pa.schema(
    [("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())]
)


class SlicedBook:
    """The entries of one part position, ready to be searched."""

    def __init__(self, entries: list[list[int]]):
        if len(entries) > 64:
            raise ValueError("a mask has 64 bits, for 64 entries at most")
        self.entries = np.array(entries, np.int64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, 0).T.copy()
        seen = np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=0)
        self.masks = np.vstack([np.zeros((1, seen.shape[1]), np.uint64), seen]).T.copy()
        apart = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(apart, _FAR)
        near = int(np.median(apart.min(1))) if len(entries) > 1 else 1
        self.radius = max(1, math.isqrt(near))

    def _box(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each part a mask of the entries within ``radius`` of it in every dimension."""
        out = np.full(len(parts), ~np.uint64(0))
        for j, (line, masks) in enumerate(zip(self.sorted, self.masks)):
            first = np.searchsorted(line, parts[:, j] - radius, "left")
            behind = np.searchsorted(line, parts[:, j] + radius, "right")
            out &= masks[first] ^ masks[behind]
        return out

    def _least(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry among those of the masks, the lowest of equals, and its
        squared distance."""
        entry, distance = np.zeros(len(parts), np.int64), np.full(len(parts), _FAR)
        left = np.flatnonzero(masks)
        while len(left):
            lowest = masks[left] & (~masks[left] + np.uint64(1))
            k = np.frexp(lowest.astype(np.float64))[1] - 1
            d = ((parts[left] - self.entries[k]) ** 2).sum(1)
            nearer = d < distance[left]
            entry[left[nearer]], distance[left[nearer]] = k[nearer], d[nearer]
            masks[left] ^= lowest
            left = left[masks[left] != 0]
        return entry, distance

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance for every row of ``parts``."""
        entry, distance = np.zeros(len(parts), np.int64), np.full(len(parts), _FAR)
        open_, radius = np.arange(len(parts)), np.full(len(parts), self.radius, np.int64)
        while len(open_):
            here = parts[open_]
            k, d = self._least(here, self._box(here, radius))
            settled = d <= radius * radius
            entry[open_[settled]], distance[open_[settled]] = k[settled], d[settled]
            found = np.sqrt(np.where(d == _FAR, 0, d).astype(np.float64)).astype(np.int64) + 1
            radius = np.where(d == _FAR, 2 * radius, found)[~settled]
            open_ = open_[~settled]
        return entry, distance


@dataclass(frozen=True)
class Codebooks:
    """Entries by part position, for vectors of ``length`` components."""

    books: list[list[list[int]]]
    length: int
    scale: int = SCALE

    def sha256(self) -> str:
        """Of all components by part, entry and place, comma-joined."""
        told = ",".join(str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(told.encode()).hexdigest()


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(values * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component beyond {MOST // scale} cannot be coded")
    return x.astype(np.int64)


def _assigned(batches, books: Codebooks):
    """(batch, parts by position, entries, squared distances) of each batch."""
    sliced = [SlicedBook(b) for b in books.books]
    for b in vectors.joined(batches):
        x = _integers(vectors.matrix(b, books.length), books.scale)
        parts = x.reshape(len(x), len(sliced), -1).transpose(1, 0, 2)
        found = [book.nearest(np.ascontiguousarray(p)) for book, p in zip(sliced, parts)]
        yield b, parts, np.array([k for k, _ in found]), np.array([d for _, d in found])


def _updated(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floored mean of the parts nearest to it."""

    def sums(batches):
        shape = (len(books.books), max(map(len, books.books)), books.length // len(books.books))
        total, n = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for _, parts, entries, _ in _assigned(batches, books):
            for p in range(shape[0]):
                np.add.at(total[p], entries[p], parts[p])
                n[p] += np.bincount(entries[p], minlength=shape[1])
        part, entry, place = np.nonzero(np.broadcast_to(n[:, :, None] > 0, shape))
        values = {"part": part, "entry": entry, "place": place, "total": total[part, entry, place], "n": n[part, entry]}
        yield common.batch(values, _SUMS)

    found = rows.select("vector").mapInArrow(sums, _SUMS_DDL).groupBy("part", "entry", "place")
    found = found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = [[list(e) for e in book] for book in books.books]
    for r in found.collect():  # a row for each component of the codebooks
        new[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(new, books.length, books.scale)


def trained(rows: DataFrame, length: int, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE) -> Codebooks:
    """Codebooks for the ``vector`` column of ``rows``, which start as the parts of the
    vectors with the smallest ``id``."""
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    x = _integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), length), scale)
    books = Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).tolist(), length, scale)
    for _ in range(rounds):
        books = _updated(rows, books)
    return books


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` as (id, label, code, error): two hex digits for every part's entry, and
    the sum of the squared distances."""
    keep = [rows.schema["id"], rows.schema["label"]]
    out = StructType([*keep, StructField("code", StringType()), StructField("error", LongType())])

    def code(batches):
        for b, _, entries, distances in _assigned(batches, books):
            hexes = entries.T.astype(np.uint8).tobytes().hex()
            width = 2 * len(entries)
            codes = [hexes[i : i + width] for i in range(0, len(hexes), width)]
            errors = pa.array(distances.sum(0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array(codes, pa.string()), errors], ["id", "label", "code", "error"]
            )

    return rows.select("id", "label", "vector").mapInArrow(code, out)


def compressed(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Codebooks trained on ``df``, and its vectors as (``id_col``, ``label_col``, code,
    error, label_error), the last being the sum of ``error`` over equal labels."""
    rows, length = vectors.usable(df, parts, id=id_col, label=label_col, vector=vector_col)
    common.bounded_batches(rows)
    books = trained(rows, length, parts, entries, rounds, scale) if length else Codebooks([], 0, scale)
    codes = common.written(coded(rows, books), "vector-codes")
    # Written, so that the size decides whether it is broadcast, and so that a frequent
    # label can be split where it is not.
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    labels = common.written(labels.withColumnRenamed("label", "of_label"), "label-errors")
    out = codes.join(labels, codes["label"].eqNullSafe(labels["of_label"]), "left")
    names = [F.col("id").alias(id_col), F.col("label").alias(label_col)]
    return out.select(*names, "code", "error", "label_error"), books
