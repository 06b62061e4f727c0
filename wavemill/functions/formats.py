"""Bytes of samples and of containers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int16_hex(x: Column) -> Column:
    """A 16-bit sample as the hex of its two bytes, low byte first."""
    u = F.pmod(x, F.lit(65536))
    return F.concat(F.lpad(F.hex(u.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(u, 8)), 2, "0"))


def csv_line(s: Column, delimiter: str = ",") -> Column:
    return F.array_join(s.cast("array<string>"), delimiter)


def base64_text(x: Column) -> Column:
    """Base64 of a text in one line: base64() may put a line break after every 76 characters."""
    return F.translate(F.base64(F.encode(x, "utf-8")), "\r\n", "")


def mu_law(x: Column) -> Column:
    """G.711 mu-law code of a 16-bit sample: sign, segment and four bits of the biased magnitude, inverted."""
    m = F.least(F.abs(x), F.lit(32635)) + 132
    segment = F.greatest(F.floor(F.log2(m.cast("double"))).cast("int") - 7, F.lit(0))
    mantissa = F.floor(m / F.pow(F.lit(2), segment + 3)).cast("int").bitwiseAND(15)
    code = F.when(x < 0, 128).otherwise(0) + segment * 16 + mantissa
    return F.lit(255) - code


def mu_law_decoded(code: Column) -> Column:
    c = F.lit(255) - code
    m = ((c.bitwiseAND(15) * 8 + 132) * F.pow(F.lit(2), F.floor(c.bitwiseAND(127) / 16)) - 132).cast("int")
    return F.when(c >= 128, -m).otherwise(m)


def little_endian(content: Column, offset: int, size: int) -> Column:
    """An unsigned integer of `size` bytes of a binary column."""
    digits = F.concat(*[F.hex(F.substring(content, offset + k + 1, 1)) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("long")
