"""Quantities and alerts derived from snapshots and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdline.functions.scalars import to_fahrenheit
from holdline.operators.changelog import intervals, stall_spans
from holdline.operators.history import History
from holdline.operators.scan import ema_over
from holdline.operators.views import LUMENS_PER_WATT, MICRO
from holdline.sources.config import setting

# Barometric formula and heat capacity of water (J/g/K).
LAPSE_RATE = 0.0065
KELVIN = 273.15
PRESSURE_EXPONENT = -5.257
WATER_HEAT = 4.184

# Current thresholds in hundredths of an ampere, power factors and
# the control temperature in hundredths of a degree.
SMOOTHING = 0.8
FANS_CURRENT = 400
FURNACE_CURRENT = 230
FURNACE_LEAST = 150
FURNACE_PF = 0.92
FANS_PF = 0.8
FANS_TEMP = 1500


def sea_level_pressure(snap: DataFrame, cfg: DataFrame, pressure: str = "plocal", outdoor: str = "fencepost") -> DataFrame:
    """``psea`` in mbar from local pressure (daPa) and an outdoor temperature
    (hundredths of a degree); NULL when either is unknown."""
    rise = F.lit(LAPSE_RATE) * setting(cfg, "elevation", "INT")
    t = F.col(outdoor) / F.lit(100.0)
    ratio = F.lit(1.0) - rise / (t + rise + F.lit(KELVIN))
    return snap.withColumn("psea", F.col(pressure) / F.lit(10.0) * F.pow(ratio, F.lit(PRESSURE_EXPONENT)))


def heat_flow(flux: DataFrame, cfg: DataFrame, col: str = "flux") -> DataFrame:
    """``flow_kw`` through the whole ceiling and its ``direction``."""
    area = setting(cfg, "flux_area", "INT")
    return flux.withColumns(
        {
            "flow_kw": F.abs(F.col(col)) * area / F.lit(1000.0),
            "direction": F.when(F.col(col) >= 0, "up").when(F.col(col) < 0, "down"),
        }
    )


def exchanger_heat(wide: DataFrame, cfg: DataFrame, inlet: str, outlet: str, flow_var: str) -> DataFrame:
    """``delta_c``, ``delta_f`` and ``heat_kw`` of a water loop. The collector loop
    uses the same form with its own flow setting; that use is our reading of the
    goal, as no formula for it was ever given."""
    delta = (F.col(outlet) - F.col(inlet)) / F.lit(100.0)
    flow = setting(cfg, flow_var, "INT")
    out = wide.withColumn("delta_c", delta)
    return out.withColumns(
        {
            "delta_f": to_fahrenheit("delta_c", delta=True),
            "heat_kw": flow * F.lit(WATER_HEAT) / F.lit(1000.0) * F.abs("delta_c"),
            "direction": F.when(F.col("delta_c") < 0, "up").when(F.col("delta_c") >= 0, "down"),
        }
    )


def _apparent(current: Column) -> Column:
    return F.col("vrms") * current / F.lit(100.0)


def snapshot_power(snap: DataFrame) -> DataFrame:
    """``apparent`` and ``pf``; no load gives a NULL power factor."""
    s = _apparent(F.col("irms"))
    return snap.withColumns({"apparent": s, "pf": F.try_divide(F.col("pmean"), s)})


def light_totals(snap: DataFrame) -> DataFrame:
    """Visible light (never below zero), lux and the sum of all bands in W/m2."""
    white = F.col("vis_ir") - F.col("ired")
    vis = F.when(white.isNotNull(), F.greatest(white, F.lit(0)))
    total = F.col("vis_ir") / F.lit(MICRO) + F.col("uva") / F.lit(1000.0) + F.col("uvb") / F.lit(1000.0)
    return snap.withColumns(
        {
            "vis_w": vis / F.lit(MICRO),
            "lux": vis * F.lit(LUMENS_PER_WATT) / F.lit(MICRO),
            "total_w": total,
        }
    )


def held_frames(frames: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Frames with the smoothed current ``irms_ema`` and, in every field, the value
    last received. A frame without a current changes nothing in the average."""
    fields = [c for c in ("vrms", "pmean", "furnace_ctrl", "tmp_ctrl_module") if c in frames.columns]
    h = History.of(frames, key, order)
    for c in fields:
        # A frame either brings the field (its NULL included) or does not.
        h = h.carry(f"__{c}", F.when(F.col(f"has_{c}"), F.struct(F.col(c).alias("v"))))
    h = h.with_columns(**{c: F.col(f"__{c}.v") for c in fields}).drop(*[f"__{c}" for c in fields])
    h = h.filter(F.col("irms").isNotNull())
    return ema_over(h, "irms", "irms_ema", SMOOTHING, "first").rows()


def frame_factor() -> Column:
    return F.try_divide(F.col("pmean"), _apparent(F.col("irms_ema")))


def furnace_flags() -> dict[str, Column]:
    burning = (F.col("pf") < FURNACE_PF) & (F.col("irms_ema") > FURNACE_LEAST) & (F.col("furnace_ctrl") == 1)
    actual = F.coalesce(burning, F.lit(False))
    return {
        "furnace_actual": actual,
        "warning": F.coalesce(F.col("furnace_ctrl") == 1, F.lit(False)) & ~actual,
    }


def fan_flag() -> Column:
    strong = F.col("irms_ema") > FANS_CURRENT + FURNACE_CURRENT
    alone = (F.col("furnace_ctrl") == 0) & (F.col("irms_ema") > FANS_CURRENT)
    return F.coalesce((F.col("pf") < FANS_PF) & (F.col("tmp_ctrl_module") > FANS_TEMP) & (strong | alone), F.lit(False))


def furnace_alert(frames: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Per frame with a current: is the furnace really burning, and a warning when
    it is commanded on but is not. The frame's own power is used."""
    held = held_frames(frames, key, order).withColumn("pf", frame_factor())
    return held.withColumns(furnace_flags())


def fans_on(frames: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    held = held_frames(frames, key, order).withColumn("pf", frame_factor())
    return held.withColumn("fans", fan_flag())


# Payloads of the actuator topic.
VENT_PAYLOADS = {"V": 1, "v": 0}


def actuator_events(routed: DataFrame) -> DataFrame:
    """Rows ``(arrival_us, field, state)`` of routed messages; a lost connection
    makes the sensed fields unknown."""
    sent = (
        F.when((F.col("kind") == "act") & (F.col("payload") == "V"), VENT_PAYLOADS["V"])
        .when((F.col("kind") == "act") & (F.col("payload") == "v"), VENT_PAYLOADS["v"])
        .when(F.col("kind").isin("vent", "swamp_pump"), F.col("payload").try_cast("int"))
    )
    field = F.when(F.col("kind") == "act", "vent_sys").when(
        F.col("kind").isin("vent", "swamp_pump"), F.col("kind")
    )
    fields = F.when(F.col("kind") == "lost", F.array(F.lit("vent"), F.lit("swamp_pump"))).when(
        field.isNotNull() & ((F.col("kind") != "act") | sent.isNotNull()), F.array(field)
    )
    keep = [c for c in routed.columns if c not in ("kind", "payload")]
    return routed.select(*keep, F.explode(fields).alias("field"), sent.cast("int").alias("state"))


def actuator_state(routed: DataFrame, key: list[str], horizon_us: int | None = None) -> DataFrame:
    """Intervals in which an actuator is known to be on (1) or off (0)."""
    events = actuator_events(routed).withColumnRenamed("arrival_us", "event_us")
    h = History.of(events, [*key, "field"], ["event_us"]).previous("__was", F.struct("state"))
    changed = F.col("__was").isNull() | ~F.col("state").eqNullSafe(F.col("__was.state"))
    return intervals(h.filter(changed).drop("__was").rows(), [*key, "field"], ["state"], horizon_us)


# The fields that a lost connection makes unknown.
LOST_FIELDS = ("vent", "swamp_pump", "swamp")


def known_states(
    routed: DataFrame, key: list[str], now_us: Column | int, seconds: int = 15, swamp: Column | None = None
) -> DataFrame:
    """Intervals in which an actuator's state, or the temperature of the sensor ``swamp``
    (a node), is known: from the message that tells it to the next one, less the stalls, in
    which no message of the site came for over ``seconds``. The command sent to an actuator
    stays known in a stall.

    State changes and both ends of the stalls are put in one order per field, and every
    stretch between two of them is known or not.
    """
    arrivals = routed.withColumnRenamed("arrival_us", "event_us")
    events = actuator_events(arrivals).select(*key, "event_us", "field", F.col("state").cast("bigint").alias("state"))
    if swamp is not None:
        data = arrivals.filter((F.col("kind") == "data") & (F.col("node") == swamp))
        told = F.col("payload").try_cast("bigint").alias("state")
        events = events.unionByName(data.select(*key, "event_us", F.lit("swamp").alias("field"), told))
    h = History.of(events, [*key, "field"], ["event_us"]).previous("__was", F.struct("state"))
    changed = F.col("__was").isNull() | ~F.col("state").eqNullSafe(F.col("__was.state"))
    states = h.filter(changed).rows().select(*key, "field", "event_us", F.lit(1).alias("__kind"), F.struct("state").alias("__state"))
    stalls = stall_spans(arrivals.select(*key, "event_us").distinct(), key, now_us, seconds)
    ends = F.array(
        F.struct(F.col("start_us").alias("event_us"), F.lit(2).alias("__kind")),
        F.struct(F.col("end_us").alias("event_us"), F.lit(0).alias("__kind")),
    )
    ends = stalls.select(*key, F.inline(ends)).filter(F.col("event_us").isNotNull())
    ends = ends.select(*key, F.explode(F.array(*[F.lit(f) for f in LOST_FIELDS])).alias("field"), "event_us", "__kind")
    both = History.of(states.unionByName(ends, allowMissingColumns=True), [*key, "field"], ["event_us", "__kind"])
    both = both.carry("__now", F.col("__state")).carry("__mark", F.when(F.col("__kind") != 1, F.col("__kind")))
    both = both.following("end_us", F.col("event_us"))
    state = F.col("__now.state")
    known = state.isNotNull() & F.coalesce(F.col("__mark") != 2, F.lit(True))
    rows = both.filter(known & (F.col("end_us").isNull() | (F.col("end_us") > F.col("event_us")))).rows()
    return rows.select(*key, "field", F.col("event_us").alias("start_us"), "end_us", state.alias("state"))
