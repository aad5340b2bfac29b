"""Decoding views: state flags, light, unit-converted rows, labels, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.functions.scalars import milli_to_centi, to_fahrenheit
from holdline.functions.times import local_text

LUMENS_PER_WATT = 683.0
MICRO = 1_000_000.0

# Fixed values of the 1-wire temperature chip, in thousandths of a degree C.
POWER_ON_MILLI = 85_000
MIN_MILLI, MAX_MILLI = -55_000, 125_000


def furnace_state(log: DataFrame) -> DataFrame:
    """``furnace_ctrl`` (both lines low) and ``furnace_power`` (any line low) as
    0/1; NULL where a NULL line leaves the answer open."""
    q1, q2 = F.col("q1") == 0, F.col("q2") == 0
    return log.withColumns(
        {"furnace_ctrl": (q1 & q2).cast("int"), "furnace_power": (q1 | q2).cast("int")}
    )


def light_lux(log: DataFrame) -> DataFrame:
    white = F.col("total") - F.col("ired")
    return log.withColumns({"white": white, "lux": white * F.lit(LUMENS_PER_WATT) / F.lit(MICRO)})


def _scaled(name: str, divisor: float) -> Column:
    return F.col(name) / F.lit(divisor)


def _celsius() -> dict[str, Column]:
    c = _scaled("temp", 100.0)
    return {"celsius": c, "fahrenheit": to_fahrenheit(c)}


def _power() -> dict[str, Column]:
    amps = _scaled("irms", 100.0)
    apparent = F.col("vrms") * amps
    return {
        "vrms_v": F.col("vrms"),
        "irms_a": amps,
        "pmean_w": F.col("pmean"),
        "papparent_w": apparent,
        "power_factor": F.try_divide(F.col("pmean"), apparent),
    }


def _switch(name: str, on: str, off: str) -> Column:
    return F.when(F.col(name) == 1, on).when(F.col(name) == 0, off)


def formatted(log: DataFrame, family: str, tz: str = "UTC") -> DataFrame:
    """A family's log in display units, with a local timestamp.

    ``ds18b20`` expects the labelled log (:func:`labeled`).
    """
    if family == "furnace":
        log = furnace_state(log)
    elif family == "tsl2591":
        log = light_lux(log)
    columns = {
        "ds18b20": lambda: {"label": F.col("label"), **_celsius()},
        "max11201b": lambda: {"flux_w_per_sq_m": F.col("flux")},
        "furnace": lambda: {
            "control_state": _switch("furnace_ctrl", "on", "off"),
            "power_state": _switch("furnace_power", "live", "dead"),
        },
        "bme680": lambda: {
            **_celsius(),
            "pressure_mbar": _scaled("pres", 10.0),
            "humidity_percent": _scaled("hum", 10.0),
            "gas_raw_kohm": F.col("gas"),
        },
        "sht31": lambda: {**_celsius(), "humidity_percent": _scaled("hum", 10.0)},
        "tsl2591": lambda: {
            "ptotal_w_per_sq_m": _scaled("total", MICRO),
            "pinfrared_w_per_sq_m": _scaled("ired", MICRO),
            "pvisible_w_per_sq_m": _scaled("white", MICRO),
            "lux": F.col("lux"),
        },
        "veml6075": lambda: {
            "puva_w_per_sq_m": _scaled("uva", 1000.0),
            "puvb_w_per_sq_m": _scaled("uvb", 1000.0),
        },
        "ina260": _power,
    }[family]()
    keys = [c for c in ("site", "sensor_key", "sensor_id") if c in log.columns]
    return log.select(
        *keys,
        "sec",
        "cs",
        local_text("sec", tz).alias("timestamp"),
        *[c.alias(name) for name, c in columns.items()],
    )


def valid_temperature(df: DataFrame, milli: str, crc_ok: Column | None = None) -> DataFrame:
    """Add ``temp`` in hundredths, and ``reason`` to rows that are not usable, whose
    ``temp`` is NULL. The power-on value cannot be told from a real 85 degrees, so it is
    rejected."""
    m = F.col(milli)
    reason = (
        F.when(~F.coalesce(crc_ok, F.lit(False)) if crc_ok is not None else F.lit(False), "crc")
        .when(m.isNull(), "unreadable")
        .when(m == POWER_ON_MILLI, "power_on")
        .when((m < MIN_MILLI) | (m > MAX_MILLI), "range")
    )
    return df.withColumns({"temp": F.when(reason.isNull(), milli_to_centi(m)), "reason": reason})


def labeled(log: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner join with the sensor dimension. No hint: the planner broadcasts the
    dimension only while its measured size allows it."""
    return log.join(dim.select("sensor_id", "label"), "sensor_id")


def with_sensor_id(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Look up ``sensor_id`` by ``serial_code``; an unknown serial gives NULL."""
    return df.join(dim.select("serial_code", "sensor_id"), "serial_code", "left")
