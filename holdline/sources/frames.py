"""Text frames ``name,name!value,value``: the live wire format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a frame writes a recorded NULL and a value that is missing.
NULL_TEXT, MISSING_TEXT = "null", "n/a"


def decode_frames(df: DataFrame, frame_col: str) -> DataFrame:
    """Long rows ``(line, pos, field, text, value, status)``; a message may hold
    several lines. Status: ``ok``, ``null``, ``missing`` or ``invalid``. An integer
    prefix is read as the value, as the browser client does."""
    lines = df.select("*", F.posexplode(F.split(F.col(frame_col), "\n")).alias("line", "__line"))
    lines = lines.filter(F.col("__line") != "")
    pair = F.split("__line", "!")
    names = F.split(F.get(pair, F.lit(0)), ",")
    values = F.split(F.coalesce(F.get(pair, F.lit(1)), F.lit("")), ",")
    zipped = F.transform(names, lambda name, i: F.struct(name.alias("field"), F.get(values, i).alias("text")))
    rows = lines.select("*", F.posexplode(zipped).alias("pos", "__cell")).select(
        *[c for c in df.columns if c != frame_col], "line", "pos", "__cell.field", "__cell.text"
    )
    number = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    status = (
        F.when(F.col("text") == NULL_TEXT, "null")
        .when(F.col("text") == MISSING_TEXT, "missing")
        .when(number.isNull(), "invalid")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ok", number))


def cell(value: Column, found: Column | None = None) -> Column:
    """A value as frame text; ``found`` false means there was no row at all."""
    text = F.coalesce(value.cast("string"), F.lit(NULL_TEXT))
    return text if found is None else F.when(found, text).otherwise(F.lit(MISSING_TEXT))


def encode_wide(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One frame per row of a wide snapshot, columns in the given order."""
    frame = F.concat(F.lit(",".join(columns) + "!"), F.concat_ws(",", *[cell(F.col(c)) for c in columns]))
    return df.select(*key, frame.alias("frame"))


def encode_frames(df: DataFrame, key: list[str], order: str, name: str, value: str, found: str) -> DataFrame:
    """One frame per key from long rows, fields in ``order``. A key holds as many
    rows as the site has sensors."""
    cells = F.sort_array(
        F.collect_list(F.struct(order, F.col(name).alias("n"), cell(F.col(value), F.col(found)).alias("v")))
    )
    grouped = df.groupBy(*key).agg(cells.alias("__cells"))
    frame = F.concat_ws(
        "!",
        F.array_join(F.transform("__cells", lambda c: c["n"]), ","),
        F.array_join(F.transform("__cells", lambda c: c["v"]), ","),
    )
    return grouped.select(*key, frame.alias("frame"))
