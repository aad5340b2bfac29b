"""Benchmark passages in documents, by SimHash over windows of the items' sizes.

Every window of a document that is as long as some item gets a 64-bit SimHash of its
five-word shingles, each weighted by how often it occurs. Items of that size are looked
up by blocks of the hash: with eight blocks, hashes at most 20 bits apart agree in some
block but for two bits, so the lists of all block values two bits around it hold every
item within the radius. Candidates are then compared exactly: the sum of the smaller
weights over the sum of the larger ones, of all shingles, must reach the threshold.

At that similarity, 0.75, hashes differ in 11 bits of 64 on average and in over 20 in
one case of a thousand. Windows too few of whose shingles occur in any item cannot
reach it and are passed over unhashed.

Items go to the tasks in slices of bounded size, one pass over the documents each.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common
from holdline.llm.shingles import WIDTH, shingle_numbers, word_numbers

SIMILARITY = 0.75
BLOCKS, RADIUS = 8, 20
# Text of items that one pass may hold.
SLICE_BYTES = 32 << 20
# Window starts hashed together.
_STRETCH = 1 << 15

_MATCHES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("start_word", pa.int64()),
        ("n_words", pa.int64()),
        ("similarity", pa.float64()),
    ]
)

_AROUND = [
    [v ^ sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(8), k)]
    for v in range(256)
]


def words(text: str | None) -> np.ndarray:
    """Numbers of the words in lower case, without punctuation at their ends."""
    found = (w.strip(b".,;:!?\"'()[]{}") for w in (text or "").lower().encode().split())
    return word_numbers([w for w in found if w])


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _hash(sums: np.ndarray) -> np.ndarray:
    """The eight bytes of each SimHash, from the sums of the signs."""
    return np.packbits(sums > 0, axis=1)


def simhash(shingles: np.ndarray) -> np.ndarray:
    return _hash(_signs(shingles).sum(axis=0, keepdims=True))[0]


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard index of two lists of shingles."""
    values, which = np.unique(np.concatenate([x, y]), return_inverse=True)
    a = np.bincount(which[: len(x)], minlength=len(values))
    b = np.bincount(which[len(x) :], minlength=len(values))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class _Size:
    """The items of one number of words: hashes, and lists by block value."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.shingles = [s for _, s in items]
        self.hashes = np.array([simhash(s) for s in self.shingles])
        self.lists = [defaultdict(list) for _ in range(BLOCKS)]
        for row, value in enumerate(self.hashes):
            for block in range(BLOCKS):
                for near in _AROUND[value[block]]:
                    self.lists[block][near].append(row)

    def near(self, value: np.ndarray) -> list[int]:
        """Items whose hash is within the radius."""
        rows = sorted({r for block in range(BLOCKS) for r in self.lists[block].get(int(value[block]), ())})
        if not rows:
            return rows
        apart = np.bitwise_count(self.hashes[rows] ^ value).sum(axis=1)
        return [r for r, d in zip(rows, apart) if d <= RADIUS]


class Index:
    """Items by their size; items without words are left out."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = SIMILARITY):
        by_size, self.threshold = defaultdict(list), threshold
        for item, text in sorted(items, key=lambda x: x[0]):
            numbers = words(text)
            if len(numbers):
                by_size[len(numbers)].append((item, shingle_numbers(numbers)))
        self.sizes = {n: _Size(found) for n, found in by_size.items()}
        self.known = {}  # shingle width -> sorted shingles, and a table of their top bits
        for width in {min(n, WIDTH) for n in by_size}:
            own = [s for n, found in by_size.items() if min(n, WIDTH) == width for _, s in found]
            values = np.unique(np.concatenate(own))
            some = np.zeros(1 << 16, bool)
            some[(values >> np.uint64(48)).astype(np.int64)] = True
            self.known[width] = values, some

    def _hits(self, shingles: np.ndarray, width: int) -> np.ndarray:
        values, some = self.known[width]
        hit = some[(shingles >> np.uint64(48)).astype(np.int64)]
        at = np.nonzero(hit)[0]
        found = np.searchsorted(values, shingles[at])
        hit[at] = values[np.minimum(found, len(values) - 1)] == shingles[at]
        return hit

    def matches(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """Item id to (similarity, first word, words) of its best window, the first of
        equal ones."""
        numbers, best = words(text), {}
        for width in sorted(self.known):
            if not len(numbers):
                break
            shingles = shingle_numbers(numbers, width)
            # A text of fewer words is one shingle, which no item of this width has.
            hit = self._hits(shingles, width)
            if not hit.any():
                continue
            upto = np.concatenate([[0], np.cumsum(hit)])
            for size, items in self.sizes.items():
                if min(size, WIDTH) == width:
                    # A text shorter than the item is one window.
                    length = min(size - width + 1, len(shingles))
                    counts = upto[length:] - upto[:-length]
                    starts = np.nonzero(counts >= self.threshold * length - 1e-9)[0]
                    self._compare(shingles, starts, length, items, width, best)
        return best

    def _compare(self, shingles, starts, length, items, width, best) -> None:
        while len(starts):
            group = starts[starts < starts[0] + _STRETCH]
            starts = starts[len(group) :]
            part = shingles[group[0] : group[-1] + length]
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(part), axis=0, dtype=np.int32)])
            at = group - group[0]
            for start, value in zip(group, _hash(sums[at + length] - sums[at])):
                for row in items.near(value):
                    score = similarity(shingles[start : start + length], items.shingles[row])
                    if score >= self.threshold and score > best.get(items.ids[row], (0,))[0]:
                        best[items.ids[row]] = (score, int(start), length + width - 1)


def _indexes(benchmark: DataFrame, threshold: float):
    """For each slice of the items, in the order of a hash of their ids: its index, shared
    with the executors until the next one is, and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // SLICE_BYTES + 1
    for k in range(slices):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        index = Index([(r["item_id"], r["text"]) for r in some.collect()], threshold)
        last = k == slices - 1
        if index.sizes:
            shared = items.sparkSession.sparkContext.broadcast(index)
            yield shared, last
            if not last:
                shared.unpersist()


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): a row for each document row
    and item found in it, with the item's best window.

    Null and blank texts, on either side, match nothing; an item with a null id is left
    out; items with equal ids count as one, by the better. Other columns are ignored,
    an empty table on either side gives no rows.
    """
    docs = common.bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ddl = "doc_id long, item_id long, start_word long, n_words long, similarity double"

    def found_with(shared):
        def run(batches):
            for ids, texts in common.columns_of(batches, "doc_id", "text"):
                rows = [
                    (doc, item, start, n, score)
                    for doc, text in zip(ids, texts)
                    for item, (score, start, n) in sorted(shared.value.matches(text).items())
                ]
                cols = zip(*rows) if rows else [()] * len(_MATCHES)
                yield common.batch({f.name: list(c) for f, c in zip(_MATCHES, cols)}, _MATCHES)

        return run

    out = docs.sparkSession.createDataFrame([], ddl)
    for shared, last in _indexes(benchmark, threshold):
        found = docs.mapInArrow(found_with(shared), ddl)
        out = out.unionByName(found if last else common.written(found, "benchmark-slice"))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item was found."""
    out = common.bounded_batches(docs)

    def clean_with(shared):
        def run(batches):
            for b in batches:
                found = [bool(shared.value.matches(t)) for t in b.column("text").to_pylist()]
                yield b.filter(pa.array([not f for f in found], pa.bool_()))

        return run

    for shared, last in _indexes(benchmark, threshold):
        out = out.mapInArrow(clean_with(shared), docs.schema)
        out = out if last else common.bounded_batches(common.written(out, "benchmark-slice"))
    return out
