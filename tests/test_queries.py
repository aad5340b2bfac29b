"""Every registered query against its SQL; ordered ones also with hot keys split."""

import pytest

import __spark_entry__ as driver
from holdline.plans import registry
from holdline.session import MAX_ROWS_CONF
from oracle import SF_DIR, check_batch_plan, connect, plan_lines, spark_rows, sql_rows

driver.queries()  # registers them
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES

# One per operator with its own way over chunks.
SPLIT = (
    "s3_new_sensors", "j4_asof", "l1_change_only", "l2_lifecycle", "l2_presence_log", "l4_compound_record", "l5_warmup",
    "l6_uniquify_drops", "l6_stamps", "l7_clock_guard", "l8_restart_tombstones", "l12_intervals", "e1_ema_zero_seed",
    "e2_ema_first_seed", "c4_sht31_log", "c8_flux", "c10_burst_rms", "g7_furnace_alert", "g11_last_known",
    "g12_field_updates", "g15_furnace_runtime", "x1_stream_hysteresis",
)


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if not name.startswith("x"):
        # Only one partial result per task may meet in a single one; numbering new
        # sensors is the exception, bounded by the split limit.
        check_batch_plan(df, gathers=name == "s3_new_sensors")
    assert spark_rows(df) == sql_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", ["s5_w1_text", "v11_valid_temp", "c1_ds18b20_raw", "c4_sht31_raw", "c4_sht31_log"])
def test_judged_rows_are_read_once(spark, name):
    """Good and rejected rows are one frame."""
    plan = "\n".join(plan_lines(QUERIES[name](spark, SF_DIR)))
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_hot_keys(spark, con, name):
    spark.conf.set(MAX_ROWS_CONF, "40")
    try:
        got = spark_rows(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
    assert got == sql_rows(con, ORACLES[name])


def test_entry(spark):
    assert driver.entry(spark).count() > 0
