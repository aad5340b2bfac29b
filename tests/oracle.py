"""Compare a registered query with its SQL on the same tables."""

import math
import os
import re

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=SF_DIR):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def _rows(rows):
    rows = [tuple(_cell(x) for x in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, _rows([tuple(r[c] for c in columns) for r in df.collect()])


def sql_rows(con, sql):
    out = con.sql(sql)
    columns = sorted(out.columns)
    places = [out.columns.index(c) for c in columns]
    return columns, _rows([tuple(r[i] for i in places) for r in out.fetchall()])


def plan_lines(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.sub(r"[:+\-|*]", " ", text).splitlines() if x.strip()]


def check_batch_plan(df, gathers=False):
    """No Python, no cross join, and no rows gathered in one task."""
    plan = plan_lines(df)
    text = "\n".join(plan)
    assert not re.search(r"Python|MapInPandas|MapInArrow|FlatMapGroups|ArrowEval", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for above, line in zip(plan, plan[1:]):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in above or gathers, above
