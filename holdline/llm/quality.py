"""Quality scores from compression.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled
bad. A text is compressed with each, in chunks so that a long text does not become its
own dictionary. How much smaller it gets with the good one, per byte, together with
how small it gets without any (which tells repetition), is turned into a probability
by logistic regression on labelled texts that trained no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdline.llm import common

# The training sample: at most so many texts and bytes of each class, the first in the
# order of a hash of the id. Whole texts, which go to the driver.
SAMPLE_TEXTS, SAMPLE_BYTES = 3000, 12 << 20
DICTIONARY_BYTES = 112 << 10
CHUNK, LEVEL = 1024, 3
# Bytes of no evidence added to each text, so that a few words decide little.
PRIOR_BYTES = 50
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text, each with whether it was trained, and the
    weights of the difference, of the size and of a constant."""

    dictionaries: tuple[tuple[bytes, bool], ...]
    weights: tuple[float, float, float]


def _chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def _dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    parts = [c for t in texts for c in _chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes(), True
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(parts)[-DICTIONARY_BYTES:], False


def _compressor(known: zstandard.ZstdCompressionDict | None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


@lru_cache(maxsize=4)
def _compressors(dictionaries) -> list:
    """One for each dictionary, and one without."""
    out = []
    for data, trained in dictionaries:
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        known = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
        if known:
            known.precompute_compress(level=LEVEL)
        out.append(_compressor(known))
    return [*out, _compressor(None)]


def features(dictionaries, text: bytes) -> tuple[float, float]:
    """(difference, size) per byte: the difference drawn towards 0 for short texts, the
    size without a dictionary, 1 at most. An empty text has 0 and 1."""
    if not text:
        return 0.0, 1.0
    chunks = _chunks(text)
    bad, good, plain = (sum(len(c.compress(x)) for x in chunks) for c in _compressors(dictionaries))
    return 10 * (bad - good) / (len(text) + PRIOR_BYTES), min(1.0, plain / len(text))


def _probability(weights, x) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small penalty; steps are halved where they overshoot."""
    weights, penalty = np.zeros(x.shape[1] + 1), 1e-3
    ones = np.column_stack([x, np.ones(len(x))])

    def loss(w):
        p = _probability(w, x)
        return -(y * np.log(p) + (1 - y) * np.log1p(-p)).sum() + penalty * (w @ w) / 2

    for _ in range(50):
        p = _probability(weights, x)
        curve = ones.T @ (ones * (p * (1 - p))[:, None]) + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, ones.T @ (y - p) - penalty * weights)
        while loss(weights + step) > loss(weights) and np.abs(step).max() > 1e-9:
            step = step / 2
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(w) for w in weights)


def train(samples: list[tuple[bytes, int]]) -> Model:
    """From (text, label) pairs: the even ones of each class make its dictionary, the
    odd ones the calibration. With one class only, all scores are its share, 0 or 1,
    drawn in; without samples they are one half."""
    texts = [[t for t, label in samples if label == q] for q in (0, 1)]
    dictionaries = tuple(_dictionary(t[::2]) for t in texts)
    if not all(texts):
        share = (len(texts[1]) + 1) / (len(samples) + 2)
        return Model(dictionaries, (0.0, 0.0, float(np.log(share / (1 - share)))))
    held = [(t, q) for q in (0, 1) for t in (texts[q][1::2] or texts[q])]
    x = np.array([features(dictionaries, t) for t, _ in held])
    y = np.array([q for _, q in held], float)
    return Model(dictionaries, _logistic(x, y))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the checksum of its id as text is 0 mod 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_sample(
    docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES
) -> tuple[list[tuple[bytes, int]], float]:
    """Labelled texts outside the held-out fold, and the share of good ones among all
    such labels. A document with both labels counts as bad; of an id with several texts,
    each text counts, once. At most ``texts`` texts and ``size`` bytes of each class."""
    labels = labels.select("doc_id", "quality").dropna().filter(~held_out())
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = labels.agg(F.avg("quality")).first()[0]
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = []
    for q in (0, 1):
        order = F.xxhash64("doc_id")
        ids = labels.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(texts).select("doc_id")
        found = docs.join(F.broadcast(ids), "doc_id").withColumn("content", F.xxhash64("text"))
        sizes = found.select(order.alias("h"), "doc_id", "content", F.octet_length("text").alias("n")).distinct()
        # An id may stand for any number of texts.
        sizes = sizes.orderBy("h", "doc_id", "content").limit(texts).collect()
        total, wanted = 0, []
        for row in sizes:
            if total + row["n"] <= size:
                total += row["n"]
                wanted.append((row["doc_id"], row["content"]))
        if wanted:
            ids = docs.sparkSession.createDataFrame(wanted, "doc_id long, content long")
            rows = found.join(F.broadcast(ids), ["doc_id", "content"], "left_semi").dropDuplicates(["doc_id", "content"])
            rows = rows.select(order.alias("h"), "text").collect()
            out += [(bytes(r["text"]), q) for r in sorted(rows, key=lambda r: (r["h"], bytes(r["text"])))]
    return out, share


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    """A model from labelled documents outside the held-out fold."""
    samples, share = training_sample(docs, labels, **bounds)
    model = train(samples)
    good = sum(q for _, q in samples)
    if 0 < good < len(samples) and 0 < share < 1:
        # The sample holds the classes in other shares than the labels.
        shift = np.log(share / (1 - share)) - np.log(good / (len(samples) - good))
        a, b, c = model.weights
        model = Model(model.dictionaries, (a, b, float(c + shift)))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good, from its whole text alone.

    A null text is scored as an empty one. Every row is kept, repeated ones too. A
    column of the score's name is replaced.
    """
    kept = docs.drop(score_col)
    # The text in a place of its own, so other columns may have any type and name.
    given = kept.select(F.struct(*kept.columns).alias("row"), F.col(text_col).cast("binary").alias("text"))
    schema = f"row {kept.schema.simpleString()}, score double"

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            x = np.array([features(model.dictionaries, t) for t in texts]).reshape(-1, 2)
            scores = pa.array(_probability(model.weights, x), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("row"), scores], ["row", "score"])

    out = common.bounded_batches(given).mapInArrow(run, schema)
    return out.select("row.*", F.col("score").alias(score_col))


def classified(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; a null id is not held out."""
    rows = scored(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= threshold).cast("int")
    return rows.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted")
    )
