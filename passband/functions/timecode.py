"""Spacecraft time codes to nanoseconds since 1970 (BIGINT); null where there is no instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passband.functions.bits import big_endian

# Epochs as seconds since 1970, and limits of the codes.
EPOCHS = {"unix": 0, "ccsds": -378_691_200, "gps": 315_964_800}
NANOS = 1_000_000_000
MAX_TIME_BYTES = 8
MILLISECOND_BYTES = 4
MAX_MILLISECONDS_OF_DAY = 86_401_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

WIDE = "decimal(38,0)"


def _wide(value: int | Column) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast(WIDE)


def _wide_product(value: Column, factor: int) -> Column:
    """value * factor kept as DECIMAL(38,0) whatever the operand's width was."""
    return (value.cast("decimal(20,0)") * F.lit(factor).cast("decimal(18,0)")).cast(WIDE)


def _instant(epoch: str | int, nanos: Column) -> Column:
    """Nanoseconds after an epoch, or null outside what 64 bits of nanoseconds can name."""
    seconds = EPOCHS[epoch] if isinstance(epoch, str) else epoch
    total = (nanos + _wide(seconds * NANOS)).cast(WIDE)
    return total.try_cast("bigint")


def _power(bits: int) -> Column:
    return F.lit(1 << bits).cast("decimal(20,0)")


def _cuc_nanos(coarse: Column, fine: Column, fine_bytes: int) -> Column:
    if fine_bytes == 0:
        return _wide_product(coarse, NANOS)
    # The fraction is a shift, not a double multiply: truncated to the nanosecond, exactly.
    # fine < 2^56 and 2^56 * 10^9 < 10^38, so the product is exact.
    scaled = _wide_product(fine, NANOS)
    fraction = F.call_function("div", scaled, _power(8 * fine_bytes)).cast(WIDE)
    return (_wide_product(coarse, NANOS) + fraction).cast(WIDE)


def _cuc_fits(coarse_bytes: int, fine_bytes: int) -> bool:
    return coarse_bytes >= 1 and fine_bytes >= 0 and coarse_bytes + fine_bytes <= MAX_TIME_BYTES


def cuc_from_bytes(
    field: Column, coarse_bytes: int, fine_bytes: int, epoch: str | int = "ccsds"
) -> Column:
    """Unsegmented code: whole seconds, then a binary fraction; longer fields are read in front."""
    if not _cuc_fits(coarse_bytes, fine_bytes):
        return F.lit(None).cast("bigint")
    coarse = big_endian(F.substring(field, 1, coarse_bytes))
    fine = big_endian(F.substring(field, coarse_bytes + 1, fine_bytes))
    whole = F.length(field) >= coarse_bytes + fine_bytes
    return F.when(whole, _instant(epoch, _cuc_nanos(coarse, fine, fine_bytes)))


def cuc_from_unsigned(
    value: Column, coarse_bytes: int, fine_bytes: int, epoch: str | int = "ccsds"
) -> Column:
    """The same number as one unsigned integer, the fraction in its low octets."""
    if not _cuc_fits(coarse_bytes, fine_bytes):
        return F.lit(None).cast("bigint")
    number = value.cast("decimal(20,0)")
    if fine_bytes == 0:
        return _instant(epoch, _cuc_nanos(number, F.lit(0), 0))
    modulus = _power(8 * fine_bytes)
    fine = F.pmod(number, modulus)
    coarse = F.call_function("div", number - fine, modulus)
    return _instant(epoch, _cuc_nanos(coarse, fine, fine_bytes))


def cds_from_bytes(
    field: Column, day_bytes: int = 2, sub_bytes: int = 0, epoch: str | int = "ccsds"
) -> Column:
    """Day segmented code: days, milliseconds of day, then microseconds (2) or picoseconds (4)."""
    if not 1 <= day_bytes <= MAX_TIME_BYTES or sub_bytes not in (0, 2, 4):
        return F.lit(None).cast("bigint")
    days = big_endian(F.substring(field, 1, day_bytes))
    millis = big_endian(F.substring(field, day_bytes + 1, MILLISECOND_BYTES))
    nanos = (_wide_product(days, 86_400 * NANOS) + _wide_product(millis, 1_000_000)).cast(WIDE)
    if sub_bytes:
        sub = big_endian(F.substring(field, day_bytes + MILLISECOND_BYTES + 1, sub_bytes))
        part = _wide_product(sub, 1000) if sub_bytes == 2 else _wide(F.call_function("div", sub, F.lit(1000)))
        nanos = (nanos + part).cast(WIDE)
    whole = F.length(field) >= day_bytes + MILLISECOND_BYTES + sub_bytes
    valid = whole & (millis < MAX_MILLISECONDS_OF_DAY)
    return F.when(valid, _instant(epoch, nanos))


def cds_from_unsigned(
    value: Column, day_bytes: int = 2, sub_bytes: int = 0, epoch: str | int = "ccsds"
) -> Column:
    """The same octets as the low end of one unsigned integer of at most eight."""
    width = day_bytes + MILLISECOND_BYTES + sub_bytes
    if not 1 <= day_bytes <= MAX_TIME_BYTES or width > MAX_TIME_BYTES:
        return F.lit(None).cast("bigint")
    number = value.cast("decimal(20,0)")
    low = F.pmod(number, F.lit(1 << 32).cast("decimal(20,0)"))
    high = F.call_function("div", number - low, F.lit(1 << 32).cast("decimal(20,0)"))
    octets = F.concat(
        F.unhex(F.lpad(F.hex(high.cast("bigint")), 8, "0")),
        F.unhex(F.lpad(F.hex(low.cast("bigint")), 8, "0")),
    )
    return cds_from_bytes(F.substring(octets, 9 - width, width), day_bytes, sub_bytes, epoch)


def from_seconds(seconds: Column, epoch: str | int = "unix") -> Column:
    """Seconds as a double, rounded half away from zero to the nanosecond."""
    nanos = seconds * F.lit(float(NANOS))
    finite = ~F.isnan(nanos) & (F.abs(nanos) < F.lit(float(1 << 63)))
    magnitude = F.abs(nanos)
    # floor(x + 0.5) would round 0.49999999999999994 up; the remainder decides instead.
    down = F.floor(magnitude)
    rounded = down + F.when(magnitude - down >= 0.5, 1).otherwise(0)
    signed = F.when(nanos < 0, -rounded).otherwise(rounded)
    return F.when(finite, _instant(epoch, signed.cast(WIDE)))


def from_value(code: str, value: Column, engineering: Column, **layout) -> Column:
    """Read one decoded parameter as an instant.

    ``cuc`` and ``cds`` read the raw tagged value, as octets or as one unsigned integer;
    ``seconds`` reads the engineering number.  Any other kind of value is no instant.
    """
    if code == "seconds":
        return from_seconds(engineering, layout.get("epoch", "unix"))
    readers = {
        "cuc": (cuc_from_bytes, cuc_from_unsigned),
        "cds": (cds_from_bytes, cds_from_unsigned),
    }
    if code not in readers:
        raise ValueError(f"no such time code: {code}")
    from_octets, from_number = readers[code]
    return F.when(value["kind"] == "Bytes", from_octets(value["x"], **layout)).when(
        value["kind"] == "Unsigned", from_number(value["i"], **layout)
    )


def offset(instant: Column, nanos: Column) -> Column:
    """An instant moved by nanoseconds, held at the ends of what 64 bits can name."""
    total = (_wide(instant) + _wide(nanos)).cast(WIDE)
    return F.least(F.greatest(total, _wide(LOWEST)), _wide(HIGHEST)).cast("bigint")


def since(later: Column, earlier: Column) -> Column:
    """Signed nanoseconds between two instants, saturating."""
    total = (_wide(later) - _wide(earlier)).cast(WIDE)
    return F.least(F.greatest(total, _wide(LOWEST)), _wide(HIGHEST)).cast("bigint")


def seconds_since(later: Column, earlier: Column) -> Column:
    return since(later, earlier).cast("double") / F.lit(1e9)
