"""Reading integers and slices out of binary columns; offsets are 0-based and may be columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(data: Column, offset, length) -> Column:
    at = F.lit(offset + 1) if isinstance(offset, int) else offset.cast("int") + 1
    return F.substring(data, at, F.lit(length) if isinstance(length, int) else length.cast("int"))


def rest(data: Column, offset) -> Column:
    return take(data, offset, F.octet_length(data))


def u8(data: Column, offset) -> Column:
    """Byte at an offset, null past the end."""
    return F.conv(F.hex(take(data, offset, 1)), 16, 10).cast("int")


def u16(data: Column, offset) -> Column:
    return u8(data, offset) * 256 + u8(data, offset + 1)


def u32(data: Column, offset) -> Column:
    return u16(data, offset).cast("long") * 65536 + u16(data, offset + 2)


def u16le(data: Column, offset) -> Column:
    return u8(data, offset) + 256 * u8(data, offset + 1)


def u32le(data: Column, offset) -> Column:
    return u16le(data, offset).cast("long") + 65536 * u16le(data, offset + 2).cast("long")


def nbytes(data: Column) -> Column:
    return F.octet_length(data)


def bits(value: Column, mask: int) -> Column:
    return value.bitwiseAND(mask)


def ipv6_text(sixteen: Column) -> Column:
    """Sixteen bytes as compressed IPv6 text: the longest run of zero groups becomes '::'."""
    h = F.lower(F.hex(sixteen))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(h, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    wrapped = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    packed = wrapped
    for run in range(2, 9):
        pattern = ":" + "0:" * run
        at = F.locate(pattern, wrapped)
        packed = F.when(at > 0, F.concat(F.substring(wrapped, F.lit(1), at - 1), F.lit("::"), F.substring(wrapped, at + len(pattern), F.length(wrapped)))
                        ).otherwise(packed)
    packed = F.when(packed.startswith("::"), packed).otherwise(F.regexp_replace(packed, "^:", ""))
    return F.when(packed.endswith("::"), packed).otherwise(F.regexp_replace(packed, ":$", ""))
