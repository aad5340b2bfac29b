"""Schemas of the change logs and of the small tables around them.

A log row is a change point: its values hold until the next row of the same key.
A row whose channels are all NULL says that the values are unknown from there on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Family:
    name: str
    key: str
    channels: tuple[tuple[str, T.DataType], ...]
    scale: str = "tick"

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.channels]

    @property
    def schema(self) -> T.StructType:
        fields = [
            T.StructField(self.key, T.LongType(), False),
            T.StructField("sec", T.LongType(), False),
            T.StructField("cs", T.IntegerType(), False),
        ]
        return T.StructType(fields + [T.StructField(n, t, True) for n, t in self.channels])


_INT, _LONG = T.IntegerType(), T.LongType()

# The sensor families and their channels. Units: temp hundredths of
# a degree C, pres daPa, hum per mille, gas kOhm, flux W/m2, total and ired
# uW/m2, uva and uvb mW/m2, vrms V, irms hundredths of an ampere, pmean W.
FAMILIES = {
    f.name: f
    for f in (
        Family("ds18b20", "sensor_id", (("temp", _INT),), "centi"),
        Family("max11201b", "sensor_key", (("flux", _INT),)),
        Family("furnace", "sensor_key", (("q1", _INT), ("q2", _INT))),
        Family("bme680", "sensor_key", (("temp", _INT), ("pres", _INT), ("hum", _INT), ("gas", _INT))),
        Family("sht31", "sensor_key", (("temp", _INT), ("hum", _INT))),
        Family("tsl2591", "sensor_key", (("total", _LONG), ("ired", _LONG))),
        Family("veml6075", "sensor_key", (("uva", _INT), ("uvb", _INT))),
        Family("ina260", "sensor_key", (("vrms", _INT), ("irms", _INT), ("pmean", _INT))),
    )
}

CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("var", T.StringType(), False),
        T.StructField("val", T.StringType(), False),
        T.StructField("val_type", T.StringType(), False),
    ]
)

# The site settings a new installation starts with.
DEFAULT_CONFIG = [
    ("PHFS_01e_serial_number", "11053", "INT"),
    ("PHFS_01e_S_calib", "1.21", "FLOAT"),
    ("electricity_cost", "0.15", "FLOAT"),
    ("gas_cost", "0.59", "FLOAT"),
    ("furnace_burn_rate", "130000", "INT"),
    ("furnace_ignition_delay", "30", "INT"),
    ("elevation", "1482", "INT"),
    ("flux_area", "400", "INT"),
    ("exch_flow_rate", "757", "INT"),
    ("csp_flow_rate", "0", "INT"),
]
