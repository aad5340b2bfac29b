"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdline.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOG = "SELECT site, sensor_key, sec, cs, us, event_us, event_id, {} FROM ev"


def _nulled(**channels: str) -> str:
    return ", ".join(f"CASE WHEN NOT tomb THEN {e} END AS {c}" for c, e in channels.items())


# The driver's tables seen as sensor logs, the same mapping as in Tables.
_COMMON = {
    "raw_ev": """SELECT event_id, user_id AS site, user_id AS sensor_key,
      epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec,
      CAST(((epoch_us(ts) % 1000000) * 1000) >> 23 AS INTEGER) AS cs,
      CAST((epoch_us(ts) % 1000000) // 10000 AS INTEGER) AS cs100,
      CAST(round(value * 100) AS BIGINT) AS v, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
      event_type = 'error' AS tomb, event_type FROM events""",
    "ev": "SELECT *, sec * 1000000 + (CAST(cs AS BIGINT) << 23) // 1000 AS event_us FROM raw_ev",
    "ds18b20": """SELECT site, site * 4 + k % 4 AS sensor_id, sec, cs100 AS cs,
      sec * 1000000 + CAST(cs100 AS BIGINT) * 10000 AS event_us, event_id, event_type,
      CASE WHEN NOT tomb THEN CAST(v - 5000 AS INTEGER) END AS temp FROM ev""",
    "max11201b": _LOG.format(_nulled(flux="CAST((v - 5000) // 100 AS INTEGER)")),
    "furnace": _LOG.format(_nulled(q1="CAST(k % 2 AS INTEGER)", q2="CAST((k // 2) % 2 AS INTEGER)")),
    "bme680": _LOG.format(
        _nulled(
            temp="CAST(v - 5000 AS INTEGER)",
            pres="CAST(8400 + k AS INTEGER)",
            hum="CAST(v % 1001 AS INTEGER)",
            gas="CAST(k + 1 AS INTEGER)",
        ),
    ),
    "sht31": _LOG.format(_nulled(temp="CAST(v - 5000 AS INTEGER)", hum="CAST(v % 1001 AS INTEGER)")),
    "tsl2591": _LOG.format(_nulled(total="v * 1000", ired="k * 10000")),
    "veml6075": _LOG.format(_nulled(uva="CAST(v AS INTEGER)", uvb="CAST(k * 10 AS INTEGER)")),
    "ina260": _LOG.format(
        _nulled(
            vrms="CAST(115 + k % 10 AS INTEGER)",
            irms="CAST(CASE WHEN k % 10 = 0 THEN 0 ELSE v % 2000 END AS INTEGER)",
            pmean="CAST(v % 2400 AS INTEGER)",
        ),
    ),
    "all_ids": """SELECT DISTINCT sensor_id, site, '28-' || lpad(lower(to_hex(sensor_id)), 12, '0') AS serial_code,
      CASE sensor_id % 4 WHEN 0 THEN 'fencepost' WHEN 1 THEN 'heat_exch_inlet'
        WHEN 2 THEN 'heat_exch_outlet' ELSE 'tank_1' END AS label FROM ds18b20""",
    "dim": "SELECT * FROM all_ids WHERE sensor_id IN (SELECT sensor_id FROM ds18b20 WHERE event_type = 'signup')",
    "furnace_state": """SELECT *, CAST(q1 = 0 AND q2 = 0 AS INTEGER) AS furnace_ctrl,
      CAST(q1 = 0 OR q2 = 0 AS INTEGER) AS furnace_power FROM furnace""",
    "sessions": """SELECT *, 1 + CAST(sum(CASE WHEN us - prev_us > 86400000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY sensor_key ORDER BY us, event_id) AS BIGINT) AS session
      FROM (SELECT *, lag(us) OVER (PARTITION BY sensor_key ORDER BY us, event_id) AS prev_us FROM ev)""",
}


def sql(body: str, **ctes: str) -> str:
    """``body`` after the shared and the given common table expressions."""
    names = {**_COMMON, **ctes}
    # Recursive ones name their own columns, as in ``walk(k, n)``.
    parts = ",\n".join(f"{name} AS ({text})" for name, text in names.items())
    return f"WITH RECURSIVE {parts}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
