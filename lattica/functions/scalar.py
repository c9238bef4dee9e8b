"""Small functions: products, exact logarithms, fills and copies of bytes, revisions and times."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mul(args: Iterable, start=1):
    """The product of ``args`` and ``start``; integers of any size."""
    return reduce(operator.mul, args, start)


def mul_of(xs: Column) -> Column:
    """The product of an array of integers, as decimal(38,0); of an empty one 1. More digits fail."""
    one = F.lit(1).cast("decimal(38,0)")
    return F.aggregate(xs, one, lambda acc, x: (acc * x.cast("decimal(38,0)")).cast("decimal(38,0)"))


def ilog2_exact(x: int) -> int:
    """The exponent of a power of two; anything else is refused."""
    if x <= 0 or x & (x - 1):
        raise ValueError(f"{x} is no power of two")
    return x.bit_length() - 1


def ilog2_exact_of(x: Column) -> Column:
    exact = (x > 0) & (F.bit_count(x) == 1)
    return F.when(exact, F.length(F.bin(x)) - 1).when(x.isNotNull(), F.raise_error(F.concat(x.cast("string"), F.lit(" is no power of two"))).cast("int"))


def memset(data: Column, byte: Column) -> Column:
    """As many bytes as ``data`` has, all of one value."""
    one = F.unhex(F.lpad(F.hex(byte.cast("long")), 2, "0"))
    return F.unhex(F.repeat(F.hex(one), F.octet_length(data)))


def bzero(data: Column) -> Column:
    return memset(data, F.lit(0))


def memcpy(target: Column, source: Column) -> Column:
    """``target`` with ``source`` over its beginning; a longer source is refused."""
    n, m = F.octet_length(target), F.octet_length(source)
    copied = F.unhex(F.concat(F.hex(source), F.substr(F.hex(target), 2 * m + 1)))
    return F.when(m <= n, copied).when(m > n, F.raise_error(F.lit("the source is longer than the target")).cast("binary"))


def before(rev: Column) -> Column:
    """The revision up to which everything before ``rev`` is seen."""
    return rev - 1


def time_of(rev: Column) -> Column:
    """The UTC time of a time-like revision: the high 32 bits count minutes since 1900 in months of
    31 days, the low ones parts of a minute."""
    minutes = F.shiftrightunsigned(rev, 32)
    part = rev.bitwiseAND(F.lit(0xFFFFFFFF))
    div = lambda x, n: F.floor(x / n).cast("int")
    minute, hours = minutes % 60, div(minutes, 60)
    hour, days = hours % 24, div(hours, 24)
    day, months = days % 31 + 1, div(days, 31)
    month, year = months % 12 + 1, div(months, 12) + 1900
    # a double holds these microseconds exactly
    micros = F.floor(part * F.lit(60_000_000.0) / F.lit(4294967296.0)).cast("long")
    return F.timestamp_micros(F.unix_micros(F.make_timestamp(year, month, day.cast("int"), hour.cast("int"), minute.cast("int"), F.lit(0), F.lit("UTC"))) + micros)


def parse_uint(text: Column) -> Column:
    """A decimal without sign, as decimal(20,0); else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(20,0)"))


def parse_hex64(text: Column) -> Column:
    """16 hex digits as a long, two's complement; else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("long"))
