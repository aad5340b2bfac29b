"""Poisson replication against SQL, and its statistics."""

import math
from collections import Counter

import duckdb
import pytest
from holdline.llm import common, mixing, queries
from pyspark.sql import functions as F


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    out = con.sql(sql)
    return out.columns, out.fetchall()


def test_op2(spark, sf_dir):
    got = queries.op2_mixing(spark, sf_dir)
    columns, rows = sql_rows(queries.ORACLES["op2_mixing"], documents=f"{sf_dir}/documents.parquet")
    got_rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(got.columns) == sorted(columns) and sorted(got_rows) == sorted(rows) and rows
    places = [r["position"] for r in got.collect()]
    assert places == sorted(places)


def test_large_rates_agree_with_sql(spark, tmp_path):
    rows = [(i, "x" * (1 + i % 3), "big" if i % 50 else "small", "s", i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    weights = {"small": 3.0, "big": 1.0, "absent": 5.0}
    got = mixing.mixed(docs, weights, 2.0, 5).select("doc_id", "copy", "position").collect()
    sql = mixing.mixed_sql(weights, 2.0, 5, "doc_id")
    # A weight without documents counts for nothing.
    columns, want = sql_rows(sql, documents=str(tmp_path / "d" / "*.parquet"))
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(Counter(r["doc_id"] for r in got).values()) > 50


def test_shares(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.lit("abcd").alias("text"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise(None).alias("source"),
    )
    got = Counter(r["source"] for r in mixing.mixed(docs, {"a": 3, "b": 1}, 0.5, 1).select("source").collect())
    assert set(got) == {"a", "b"}
    assert abs(got["a"] - 11_250) < 5 * math.sqrt(11_250) and abs(got["b"] - 3750) < 5 * math.sqrt(3750)
    same = Counter(r["source"] for r in mixing.mixed(docs, {"a": 3, "b": 1}, 0.5, 1).select("source").collect())
    assert same == got


@pytest.mark.parametrize("rate", [0.1, 1.0, 7.9, 8.1, 30.0, 100.0])
def test_counts_are_poisson(spark, rate):
    n = 20_000
    draws = max(1, math.ceil(rate / mixing.LARGEST_DRAW))
    rows = spark.range(n).withColumn("mix_draws", F.lit(float(draws)))
    upto = mixing.cumulative(F.lit(rate / draws))
    rows = rows.select(mixing.poisson(F.col("mix_draws"), upto, 3, F.col("id")).alias("k"))
    counts = Counter(r["k"] for r in rows.collect())
    for k in {*range(4), int(rate) - 5, int(rate), int(rate) + 7}:
        want = n * math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if k >= 0 else 0
        assert abs(counts[k] - want) < 5 * math.sqrt(want + 1)
    mean = sum(k * c for k, c in counts.items()) / n
    variance = sum((k - mean) ** 2 * c for k, c in counts.items()) / n
    assert abs(mean - rate) < 5 * math.sqrt(rate / n) and abs(variance / rate - 1) < 0.1


def test_default_weight_and_null_source_agree_with_sql(spark, tmp_path):
    rows = [(i, "x" * (1 + i % 3), ["a", "b", None, "other"][i % 4], "s", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    weights = {"a": 3.0, "b": 0.0}
    got = mixing.mixed(docs, weights, 2.0, 5, default=0.5).select("doc_id", "copy", "position").collect()
    sql = mixing.mixed_sql(weights, 2.0, 5, "doc_id", default=0.5)
    _, want = sql_rows(sql, documents=str(tmp_path / "d" / "*.parquet"))
    assert sorted(map(tuple, got)) == sorted(want) and {r["doc_id"] % 4 for r in got} == {0, 2, 3}


def test_odd_rows(spark):
    rows = [(1, None, "a", 9), (None, "xx", "a", 9), (2, "", "b", 9), (2, "", "b", 9), (3, "y", None, 9), (4, "z" * 100_000, "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_rate int")
    out = mixing.mixed(docs, {"a": 1, "b": 1, "c": 1}, 5.0, 2)
    assert out.columns == [*docs.columns, "copy", "position"]
    got = out.collect()
    # Source b has no text, so nothing of it can make a share; c's one text is the whole.
    assert {r["source"] for r in got} <= {"a", "c"}
    assert mixing.mixed(docs.limit(0), {"a": 1}).count() == 0
    assert mixing.mixed(docs, {}).count() == 0
    clash = docs.withColumn("copy", F.lit("x")).withColumn("position", F.lit("y"))
    assert mixing.mixed(clash, {"a": 1}, 9.0).schema["position"].dataType.simpleString() == "double"


def test_sources_without_a_name_have_the_default_weight(spark, tmp_path):
    names = ["src0", "src7", "another", None]
    docs = spark.createDataFrame([(i, "abcd", names[i % 4]) for i in range(8000)], "doc_id long, text string, source string")
    docs.coalesce(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(r["source"] for r in queries.op2_mixing(spark, str(tmp_path)).select("source").collect())
    want = {"src0": 3200, "src7": 1600, "another": 1600, None: 1600}
    assert set(got) == set(want) and all(abs(got[s] - n) < 5 * math.sqrt(n) for s, n in want.items())
    # A weight of 0 leaves a source out.
    rows = mixing.mixed(docs, {"src0": 1, "another": 0}, default=0.5).select("source").distinct().collect()
    assert {r["source"] for r in rows} == {"src0", "src7", None}


def test_tables_are_read_whole(spark, sf_dir):
    sources = {r["source"] for r in common.table(spark, sf_dir, "documents").select("source").distinct().collect()}
    assert sources <= set(queries.MIX_WEIGHTS)
