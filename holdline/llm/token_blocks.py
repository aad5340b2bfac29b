"""Token ids in patched frame-of-reference files.

Documents are put in order of their id, encoded and cut into segments of whole
documents. A segment packs its ids in blocks of 128: the block's minimum is
subtracted, the differences are packed at the width that holds nine tenths of them,
and the high bits of the others go to an exception list. The block index holds where
each block and its exceptions start, so one block can be read alone.

Segments are rows of a Parquet folder: Spark commits the files of a task as a whole,
and any store that Spark reaches can hold them. Segment layout, little-endian:

    magic "PFR1", ids u32, blocks u32
    per block: minimum u32, start of its packed words u32, first exception u32, width u8
    packed words u32; exception places u8; exception high bits u32
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdline.llm import common, pieces

MAGIC = b"PFR1"
BLOCK = 128
# The packed width holds this share of a block's differences.
PERCENTILE = 0.9
# A segment is closed after the document that brings it to so many ids.
SEGMENT_IDS = 1 << 18
END_ID = 1

_SEGMENTS = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int64()),
        ("n_ids", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("data", pa.binary()),
    ]
)
SEGMENT_DDL = "part int, segment long, n_ids long, ids array<long>, lengths array<long>, data binary"
_DOCS = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int64()),
        ("doc_id", pa.int64()),
        ("before", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _lanes(width: int):
    for lane in range(BLOCK):
        word, shift = divmod(lane * width, 32)
        yield lane, word, np.uint32(shift), shift + width > 32


def pack(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    rows = np.empty((blocks, BLOCK), np.uint32)
    rows.reshape(-1)[:n] = ids
    if n:
        rows.reshape(-1)[n:] = ids[(blocks - 1) * BLOCK :].min()
    least = rows.min(axis=1) if n else np.empty(0, np.uint32)
    rows = rows - least[:, None]
    need = _widths(rows)
    width = np.sort(need, axis=1)[:, int(PERCENTILE * BLOCK) - 1] if n else np.empty(0, np.uint8)
    odd = need > width[:, None]
    owner, place = np.nonzero(odd)
    high = rows[odd] >> width[owner].astype(np.uint32)
    first = np.searchsorted(owner, np.arange(blocks)).astype(np.uint32)
    size = width.astype(np.int64) * (BLOCK // 32)
    start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.nonzero(width == w)[0]
        low = np.ascontiguousarray((rows[at] & np.uint32((1 << int(w)) - 1)).T)
        out = np.zeros((int(w) * BLOCK // 32, len(at)), np.uint32)
        for lane, word, shift, over in _lanes(int(w)):
            out[word] |= low[lane] << shift
            if over:
                out[word + 1] |= low[lane] >> (np.uint32(32) - shift)
        words[start[at][:, None] + np.arange(len(out))] = out.T
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    index = [least.astype("<u4"), start.astype("<u4"), first.astype("<u4"), width]
    body = [words.astype("<u4"), place.astype(np.uint8), high.astype("<u4")]
    return head + b"".join(x.tobytes() for x in index + body)


def _parts(data: bytes):
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    at, index = 12, []
    for kind in ("<u4", "<u4", "<u4", "u1"):
        index.append(np.frombuffer(data, kind, blocks, at))
        at += index[-1].nbytes
    n_words = int(index[3].astype(np.int64).sum()) * (BLOCK // 32)
    words = np.frombuffer(data, "<u4", n_words, at)
    at += words.nbytes
    n_odd = (len(data) - at) // 5
    place = np.frombuffer(data, "u1", n_odd, at)
    high = np.frombuffer(data, "<u4", n_odd, at + n_odd)
    return n, *index, words, place, high


def unpack(data: bytes, block: int | None = None) -> np.ndarray:
    """All ids of a segment, or those of one block."""
    n, least, start, first, width, words, place, high = _parts(data)
    chosen = np.arange(len(least)) if block is None else np.array([block])
    rows = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[chosen]):
        if not w:
            continue
        at = np.nonzero(width[chosen] == w)[0]
        got = words[start[chosen[at]].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 32)].T
        got = np.ascontiguousarray(got)
        mask = np.uint32((1 << int(w)) - 1)
        low = np.empty((BLOCK, len(at)), np.uint32)
        for lane, word, shift, over in _lanes(int(w)):
            low[lane] = got[word] >> shift
            if over:
                low[lane] |= got[word + 1] << (np.uint32(32) - shift)
        rows[at] = (low & mask).T
    ends = np.append(first[1:], len(place)).astype(np.int64)
    counts = (ends - first)[chosen]
    owner = np.repeat(np.arange(len(chosen)), counts)
    odd = np.repeat(first[chosen].astype(np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    rows[owner, place[odd]] |= high[odd] << width[chosen][owner].astype(np.uint32)
    flat = (rows + least[chosen][:, None]).reshape(-1)
    return flat[: n if block is None else min(BLOCK, n - block * BLOCK)]


def _segments(path: str):
    def run(batches):
        part, segment = TaskContext.get().partitionId(), 0
        ids, lengths, kept, total = [], [], [], 0

        def close():
            data = pack(np.frombuffer(b"".join(kept), "<u4"))
            row = (part, segment, total, ids, lengths, data)
            return common.batch({f.name: [v] for f, v in zip(_SEGMENTS, row)}, _SEGMENTS)

        end = np.array([END_ID], "<u4").tobytes()
        for keys, texts in common.columns_of(batches, "doc_id", "text"):
            for key, got in zip(keys, pieces.ids_all(path, texts)):
                ids.append(key)
                kept.append(got + end)
                lengths.append(len(got) // 4 + 1)
                total += lengths[-1]
                if total >= SEGMENT_IDS:
                    yield close()
                    segment += 1
                    ids, lengths, kept, total = [], [], [], 0
        if ids:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all of ``docs`` in ascending id order, an end id after each
    document, as segments in ``folder``.

    A null text is an empty one and has the end id alone. Null ids come first, rows
    with equal ids in the order of a digest of their texts; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # The texts are dealt out, not the ids: sampling the ranges would encode them twice.
    # With a digest, so that rows without an id, or with one id, are dealt out as well.
    digest = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id"), digest).sortWithinPartitions("doc_id", digest, "text")
    common.bounded_batches(rows).mapInArrow(_segments(tokenizer), SEGMENT_DDL).write.parquet(folder)


def _checked(batches):
    for part, segment, keys, lengths, data in common.columns_of(
        batches, "part", "segment", "ids", "lengths", "data"
    ):
        for p, s, ks, ns, d in zip(part, segment, keys, lengths, data):
            ids = unpack(d).astype("<u4", copy=False)
            ends = np.cumsum(np.array(ns, np.int64))
            if len(ids) != ends[-1]:
                raise ValueError(f"segment {p}/{s}: {len(ids)} ids, {ends[-1]} expected")
            starts = ends - ns
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            cols = {"part": [p] * len(ks), "segment": [s] * len(ks), "doc_id": ks}
            yield common.batch(cols | {"before": starts, "n_tokens": ns, "ids_crc32": crc}, _DOCS)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    Segments are decoded where they lie. Starts come from the segments' sizes: summed
    per part, then over the parts, of which there are as many as writing tasks.
    """
    segments = spark.read.schema(SEGMENT_DDL).parquet(folder)
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    parts = parts.select("part", (F.sum("all_ids").over(Window.orderBy("part")) - F.col("all_ids")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment")
    sizes = sizes.withColumn("within", F.sum("n_ids").over(within) - F.col("n_ids"))
    sizes = sizes.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("within")).alias("base"))
    ddl = "part int, segment long, doc_id long, before long, n_tokens long, ids_crc32 long"
    docs = common.bounded_batches(segments).mapInArrow(_checked, ddl)
    return docs.join(sizes, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
