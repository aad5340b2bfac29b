"""Physical plans of the core steps; those of the queries are in test_queries."""

from pyspark.sql import functions as F

from holdline.operators import changelog, latest, scan
from holdline.operators.history import History
from oracle import plan_lines as lines

def test_latest_combines_before_the_shuffle(spark):
    log = spark.createDataFrame([(1, 1, 1, 1)], "k int, sec long, cs int, temp int")
    plan = "\n".join(lines(latest.latest(log, ["k"], ["temp"])))
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_plain_history_shuffles_once(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 5)], "k int, i int, x int")
    for out in (
        scan.hysteresis(df, ["k"], ["i"], "x"),
        scan.uniquify(df, ["k"], "x", ["i"]),
        scan.ema(df, ["k"], ["i"], "x", 0.9),
        changelog.change_only(df, ["k"], ["x"], order=["i"]),
    ):
        assert "\n".join(lines(out)).count("Exchange hashpartitioning") == 1


def test_a_hot_key_is_spread(spark):
    spark.conf.set("holdline.maxRowsPerTask", "1000")
    try:
        df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 7).alias("x"))
        h = History.of(df, ["k"], ["i"])
    finally:
        spark.conf.unset("holdline.maxRowsPerTask")
    sizes = [r["count"] for r in h.df.groupBy("__chunk").count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 3000
