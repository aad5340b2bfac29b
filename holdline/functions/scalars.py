"""Column helpers. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column | str, b: Column | int) -> Column:
    """Integer division that truncates toward zero; BIGINT result."""
    return F.call_function("div", col(a), b if isinstance(b, Column) else F.lit(b))


def trunc_int(x: Column) -> Column:
    """Double to integer, dropping the fraction toward zero."""
    return x.cast("bigint")


def milli_to_centi(milli: Column | str) -> Column:
    """Milli-units to centi-units, rounding down (``-15`` becomes ``-2``)."""
    return F.floor(col(milli) / F.lit(10.0)).cast("int")


def to_fahrenheit(celsius: Column | str, delta: bool = False) -> Column:
    """Degrees (or, with ``delta``, a difference of degrees) Celsius to Fahrenheit."""
    scaled = col(celsius) * F.lit(9.0) / F.lit(5.0)
    return scaled if delta else scaled + F.lit(32.0)


def differs(a: Iterable[Column], b: Iterable[Column]) -> Column:
    """True when any pair differs, counting NULL as a value."""
    out = F.lit(False)
    for x, y in zip(a, b, strict=True):
        out = out | ~x.eqNullSafe(y)
    return out


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


# Checksum of a two-byte word: polynomial x^8+x^5+x^4+1, register preset to ones.
CRC8_POLYNOMIAL = 0x31
CRC8_INIT = 0xFF


def _crc8_step(value: int) -> int:
    for _ in range(8):
        value = ((value << 1) ^ (CRC8_POLYNOMIAL if value & 0x80 else 0)) & 0xFF
    return value


def crc8_word(high: Column | str, low: Column | str) -> Column:
    """Checksum of the word ``high, low`` by table lookup."""
    table = F.array(*[F.lit(_crc8_step(i)) for i in range(256)])
    first = F.get(table, F.lit(CRC8_INIT).bitwiseXOR(col(high).cast("int")))
    return F.get(table, first.bitwiseXOR(col(low).cast("int")))


# Checksum of a 1-wire device: the same polynomial, low bit first, register zero.
CRC1W_POLYNOMIAL = 0x8C


def _crc1w_step(value: int) -> int:
    for _ in range(8):
        value = (value >> 1) ^ (CRC1W_POLYNOMIAL if value & 1 else 0)
    return value


def crc1w(data: list[Column | str]) -> Column:
    """Checksum of a row of 1-wire bytes."""
    table = F.array(*[F.lit(_crc1w_step(i)) for i in range(256)])
    array = F.array(*[col(b).cast("int") for b in data])
    return F.aggregate(array, F.lit(0), lambda crc, b: F.get(table, crc.bitwiseXOR(b)))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join that also matches NULL keys; keeps the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])
