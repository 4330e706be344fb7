"""Scalar functions: rates, sizes, durations, names, block ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Fixed value: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16
#: White space.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def rate(units: Column, seconds: Column) -> Column:
    """Units a second; no time counts as EPSILON."""
    return units.cast("double") / F.greatest(seconds.cast("double"), F.lit(EPSILON))


def mib_per_sec(size: Column, seconds: Column) -> Column:
    return size.cast("double") / F.lit(1048576.0) / F.greatest(seconds.cast("double"), F.lit(EPSILON))


def mib_per_sec_of_record(size: Column, elapsed_ms: Column) -> Column:
    """The same for a history record, whose time is whole milliseconds, 1 at least."""
    return mib_per_sec(size, F.greatest(elapsed_ms, F.lit(1)) / F.lit(1000.0))


def percent_delta(previous: Column, current: Column) -> Column:
    """Change in percent; 0 if there was nothing before."""
    return F.when(F.abs(previous) <= F.lit(EPSILON), F.lit(0.0)).otherwise((current - previous) / previous * F.lit(100.0))


def duration_ms(text: Column) -> Column:
    """Milliseconds of `10s`, `500ms`, `2m`, `1h` or plain seconds; null if it is none of these."""
    number = F.regexp_extract(text, r"^([0-9]{1,15})(ms|s|m|h|)$", 1)
    unit = F.regexp_extract(text, r"^([0-9]{1,15})(ms|s|m|h|)$", 2)
    scale = F.when(unit == "ms", 1).when(unit == "m", 60_000).when(unit == "h", 3_600_000).otherwise(1000)
    return F.when(number != "", number).cast("long") * scale.cast("long")


def round_up(length: Column, align: Column) -> Column:
    """The next multiple of align; null where align is not above 0."""
    safe = F.when(align > 0, align)
    over = length % safe
    return F.when(over == 0, length).otherwise(length + safe - over)


def segment_name(number: Column) -> Column:
    return F.format_string("seg-%06d", number.cast("long"))


def column_bytes(rows: Column, width: Column) -> Column:
    """Flat size of a column of this width."""
    return rows.cast("long") * width.cast("long")


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def is_multicast(ip: Column, port: Column) -> Column:
    """A class D address (224 to 239 in front) and a port."""
    first = F.regexp_extract(ip, r"^([0-9]{1,3})\.", 1)
    return F.coalesce(F.when(first != "", first).cast("int").between(224, 239), F.lit(False)) & (port != 0)


def truthy(text: Column) -> Column:
    """Whether a flag's text, without white space around it, means yes."""
    return F.lower(F.btrim(text, F.lit("".join(map(chr, SPACES))))).isin("1", "true", "yes", "on")


def lba_range(offset: Column, length: Column, sector: Column, capacity: Column, most: Column) -> Column:
    """struct(error, lba, count) of a byte range; the first rule it breaks is its error."""
    lba, count = _div(offset, sector), _div(length, sector)
    error = (
        F.when(length == 0, "ZeroLength")
        .when(length > most, "TooLarge")
        .when(offset % sector != 0, "Unaligned")
        .when(length % sector != 0, "Unaligned")
        .when(lba + count > capacity, "OutOfRange")
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), lba).alias("lba"), F.when(error.isNull(), count).alias("count"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs that are not negative."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def meminfo_number(text: Column, key: str) -> Column:
    """The first word after key on the first line that begins with it, if that is a whole number below 2**63."""
    found = F.regexp_extract(text, rf"(?m)^{re.escape(key)}:?[^\S\n]*(\S*)", 1)
    return F.when(found.rlike(r"^\+?[0-9]+$"), found).try_cast("long")


def meminfo_size(text: Column, key: str) -> Column:
    """The rest of the line after `key:`, white space made single."""
    found = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*([^\n]*)", 1)
    return F.regexp_replace(F.trim(found), r"\s+", " ")


def little_endian_long(data: Column) -> Column:
    """The signed long in the first eight bytes; null for other lengths."""
    part = [F.substring(F.hex(data), 2 * i + 1, 2) for i in range(7, -1, -1)]
    return F.when(F.octet_length(data) == 8, F.conv(F.concat(*part), 16, -10).cast("long"))


def little_endian_double(data: Column) -> Column:
    """The IEEE double in the first eight bytes; null for other lengths. All not-a-numbers are one."""
    bits = little_endian_long(data)
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(2047)
    part = bits.bitwiseAND((1 << 52) - 1).cast("double")
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    whole = F.when(exponent == 0, part * F.lit(5e-324)).otherwise((F.lit(1.0) + part / F.lit(2.0**52)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))
    special = F.when(part == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(bits.isNotNull(), F.when(exponent == 2047, special).otherwise(sign * whole))
