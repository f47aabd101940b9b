"""Column expressions: stable hashes, calendar buckets, ranks."""

from __future__ import annotations

import hashlib
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVALS = ("day", "week", "month", "quarter", "year", "hour", "minute")


def key_text(key: Column, kind: T.DataType | None = None) -> Column:
    """A key's text, one for all values that are equal: -0.0 is 0.0, and a moment's does not depend on the session's zone."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        key = key + F.lit(0.0).cast(kind)
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(key)
    return key.cast("string")


def text_hash(key: Column, kind: T.DataType | None = None) -> Column:
    """The first 32 bits of the MD5 of a key's text."""
    return F.conv(F.substring(F.md5(key_text(key, kind).cast("binary")), 1, 8), 16, 10).cast("long")


def hash_bucket(key: Column, n: int, kind: T.DataType | None = None) -> Column:
    """The shard of a key among n: whole numbers by remainder, all else by the first 32 bits of its text's MD5."""
    if isinstance(kind, T.IntegralType):
        return F.pmod(key.cast("long"), F.lit(n)).cast("int")
    return (text_hash(key, kind) % n).cast("int")


def as_key(value, kind: T.DataType) -> Column | None:
    """A literal as a value of a key's type, if a comparison with the key is one in that type; else nothing can be told."""
    number = isinstance(value, int | float | Decimal) and not isinstance(value, bool)
    fits = {
        T.StringType: isinstance(value, str),
        T.BooleanType: isinstance(value, bool),
        T.DateType: isinstance(value, date) and not isinstance(value, datetime),
        T.TimestampType: isinstance(value, date | str),
        T.TimestampNTZType: isinstance(value, date | str),
        T.DecimalType: number and not isinstance(value, float),
        T.FloatType: False,
        T.DoubleType: number and not isinstance(value, Decimal),
    }
    if isinstance(kind, T.IntegralType):
        # text is compared with whole numbers as a whole number
        ok = isinstance(value, int | str) and not isinstance(value, bool)
    else:
        ok = fits.get(type(kind), False)
    return F.lit(value).try_cast(kind) if ok else None


def hash_of(value, n: int) -> int | None:
    """The same in Python, for planning."""
    if value is None:
        return None
    if isinstance(value, int) and not isinstance(value, bool):
        return value % n
    return int(hashlib.md5(str(value).encode()).hexdigest()[:8], 16) % n


def bucket_start(unit: str, ts: Column) -> Column:
    """date_trunc that gives a timestamp without zone for one."""
    if unit not in INTERVALS:
        raise ValueError(unit)
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def first_letter(key: Column) -> Column:
    return F.upper(F.substring(key.cast("string"), 1, 1))


def unused(names, *wanted: str) -> list[str]:
    """Names that no column has, one for each wanted one."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def rank_of(value: Column, order: list) -> Column:
    """The place of a value in order, from 0; what is not in it comes last."""
    out = F.when(F.lit(False), 0)
    for k, v in enumerate(order):
        out = out.when(value == v, k)
    return out.otherwise(len(order))


def period_overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether half-open periods overlap; a null end is open."""
    return (e2.isNull() | (s1 < e2)) & (e1.isNull() | (s2 < e1))
