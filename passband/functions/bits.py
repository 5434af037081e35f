"""Bit fields of a BINARY column as Column expressions (big-endian, bit 0 = most significant)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(number: Column, divisor: int) -> Column:
    """Exact integer floor division; ``/`` would go through a double and lose large instants."""
    return F.call_function("div", number - F.pmod(number, F.lit(divisor)), F.lit(divisor))


def _octets(b: Column, first: int | Column, count: int) -> Column:
    """``count`` octets from zero-based offset ``first`` as an unsigned number, up to seven as BIGINT."""
    start = F.lit(first + 1) if isinstance(first, int) else first + F.lit(1)
    number = F.conv(F.hex(F.substring(b, start, F.lit(count))), 16, 10)
    return number.cast("decimal(20,0)" if count > 7 else "bigint")


def unsigned(b: Column, offset: int, bits: int) -> Column:
    """``bits`` bits at bit ``offset``; null when the packet is too short to hold them.

    BIGINT up to 63 bits, DECIMAL(20,0) for 64.
    """
    if not 1 <= bits <= 64:
        raise ValueError(f"a field of {bits} bits cannot be read as one integer")
    first, last = offset // 8, (offset + bits - 1) // 8
    count = last - first + 1
    spare = (last + 1) * 8 - (offset + bits)
    if count <= 7:
        value = _octets(b, first, count)
        if spare:
            value = F.shiftright(value, spare)
        if spare + bits < count * 8:
            value = value.bitwiseAND(F.lit((1 << bits) - 1))
    elif bits == 64 and spare == 0:
        value = _octets(b, first, 8)
    elif bits <= 32:
        raise AssertionError("a 32-bit field never covers eight octets")
    else:
        # Wider than one accumulator: read the two halves and join them arithmetically.
        low_bits = 32
        high = unsigned(b, offset, bits - low_bits)
        low = unsigned(b, offset + bits - low_bits, low_bits)
        kind = "decimal(20,0)" if bits == 64 else "bigint"
        value = high.cast(kind) * F.lit(1 << low_bits).cast(kind) + low.cast(kind)
        value = value.cast(kind)
    return F.when(F.length(b) > last, value)


def signed(b: Column, offset: int, bits: int) -> Column:
    """Two's complement field as BIGINT."""
    raw = unsigned(b, offset, bits)
    half = 1 << (bits - 1)
    if bits == 64:
        wide = F.when(raw >= F.lit(half).cast("decimal(20,0)"), raw - F.lit(1 << 64).cast("decimal(21,0)")).otherwise(raw)
        return wide.cast("bigint")
    return F.when(raw >= half, raw - F.lit(1 << bits)).otherwise(raw)


def ieee754(b: Column, offset: int, bits: int) -> Column:
    """A 32- or 64-bit IEEE 754 field as DOUBLE, assembled from its three parts."""
    exponent_bits, bias = {32: (8, 127), 64: (11, 1023)}[bits]
    mantissa_bits = bits - 1 - exponent_bits
    sign = F.when(unsigned(b, offset, 1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = unsigned(b, offset + 1, exponent_bits)
    mantissa = unsigned(b, offset + 1 + exponent_bits, mantissa_bits).cast("double")
    scale = float(1 << mantissa_bits)
    special = (1 << exponent_bits) - 1
    # 2^(1-bias) over the scale underflows as one factor for 64 bits, so it is applied in two steps.
    subnormal = mantissa / F.lit(scale) * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
    normal = (mantissa / F.lit(scale) + 1.0) * F.pow(F.lit(2.0), (exponent - bias).cast("double"))
    return (
        F.when((exponent == special) & (mantissa > 0), F.lit(float("nan")))
        .when(exponent == special, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * subnormal)
        .otherwise(sign * normal)
    )


def big_endian(field: Column) -> Column:
    """A whole BINARY value of at most eight octets as an unsigned DECIMAL(20,0); empty is 0."""
    number = F.conv(F.hex(field), 16, 10).cast("decimal(20,0)")
    return F.when(F.length(field) == 0, F.lit(0).cast("decimal(20,0)")).when(
        F.length(field) <= 8, number
    )


def to_octets(value: Column, count: int) -> Column:
    """The low ``count`` octets of a non-negative integer, big-endian."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * count, "0"))
