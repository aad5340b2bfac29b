"""The compression classifier: held-out accuracy and odd input."""

import math
import zlib

import zstandard
from holdline.llm import common, quality, queries


def test_op5(spark, sf_dir, texts):
    rows = queries.op5_quality(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r["predicted"] == labels[r["doc_id"]] for r in held if labels.get(r["doc_id"]) is not None]
    assert sum(right) >= 0.85 * len(right)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_on_more_rows(spark):
    """At a hundred times the rows, nearly all of the held-out labels."""
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    model = quality.fit(docs, labels)
    held = docs.join(labels.filter(quality.held_out()).select("doc_id", "quality"), "doc_id")
    rows = quality.scored(held, model).collect()
    right = [(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]
    good = [r["score"] >= 0.3 for r in rows if r["quality"] == 1]
    assert sum(right) >= 0.97 * len(right) and sum(good) >= 0.985 * len(good)


def test_scores_see_the_text_alone(spark, sf_dir):
    model = quality.train([(b"good words here " * 9, 1), (b"BAD!! " * 30, 0)] * 3)
    rows = [(1, "good words", 0.5), (2, "good words", None), (None, None, 1.0), (3, "", 1.0), (3, "z" * 200_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality.scored(df, model).collect()
    assert len(got) == 5 and got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"]
    out = quality.classified(df, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {r["held_out"] for r in out.collect() if r["doc_id"] is None} == {False}
    assert quality.classified(df.limit(0), model).count() == 0


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    for rows in ([], [(i, 1) for i in range(20)], [(i, None) for i in range(20)], [(i, i % 2) for i in range(20)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        scores = [r["score"] for r in quality.classified(docs, quality.fit(docs, labels)).collect()]
        assert len(scores) == 20 and all(0 < s < 1 for s in scores)


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, "w" * 100) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 2, "doc_id long, quality int")
    sample, share = quality.training_sample(docs, labels, texts=50, size=2000)
    assert len(sample) == 40 and 0.4 < share < 0.6  # twenty of 100 bytes in each class
    # A labelled id that stands for many rows and for many texts.
    many = docs.unionByName(docs.selectExpr("2L AS doc_id", "concat('t', doc_id) AS text")).unionByName(docs)
    sample, _ = quality.training_sample(many, labels, texts=50, size=2000)
    assert len(sample) <= 100 and all(sum(len(t) for t, q in sample if q == k) <= 2000 for k in (0, 1))
    one = docs.filter("doc_id IN (2, 3)")
    assert quality.training_sample(one, labels) == quality.training_sample(one.unionByName(one), labels)


def score_again(model, text):
    """The score of one text by a compressor made for it alone."""

    def size(data=b"", trained=False):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        known = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
        if known:
            known.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_dict_id=False)
        return sum(len(press.compress(text[at : at + 1024])) for at in range(0, len(text), 1024))

    (bad, good), (a, b, c) = model.dictionaries, model.weights
    gain = 10 * (size(*bad) - size(*good)) / (len(text) + 50)
    plain = min(1.0, size() / len(text)) if text else 1.0
    return 1 / (1 + math.exp(-(a * gain + b * plain + c)))


def test_scores_by_the_formula(spark, sf_dir):
    """Every score of the query from the model's parts, computed row by row."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    want = {r["doc_id"]: score_again(model, (r["text"] or "").encode()) for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op5_quality(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
