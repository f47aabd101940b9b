"""Reads of versioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Containment, TemporalSpec
from ..functions.columns import period_overlaps, unused


def _end(t: TemporalSpec) -> Column | None:
    """The end of validity, null while open."""
    if t.valid_to is None:
        return None
    end = F.col(t.valid_to)
    return end if t.open_end is None else F.when(end != F.lit(t.open_end), end)


def _at(moment) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp_ntz")


def valid_at(df: DataFrame, t: TemporalSpec | None, moment) -> DataFrame:
    """Rows valid at a moment: from it on, up to and without the end. A table without validity is whole."""
    if t is None:
        return df
    out = df.where(F.col(t.valid_from) <= _at(moment))
    end = _end(t)
    return out if end is None else out.where(end.isNull() | (end > _at(moment)))


def valid_between(df: DataFrame, t: TemporalSpec | None, start, end) -> DataFrame:
    """Rows whose period meets [start, end]; both ends count."""
    if t is None:
        return df
    out = df.where(F.col(t.valid_from) <= _at(end))
    to = _end(t)
    return out if to is None else out.where(to.isNull() | (to >= _at(start)))


def versions_of(df: DataFrame, key: str, valid_from: str, valid_to: str, *ties: str) -> DataFrame:
    """Adds valid_to to a log of states: the next state's start."""
    w = Window.partitionBy(key).orderBy(valid_from, *ties)
    return df.withColumn(valid_to, F.lead(valid_from).over(w))


def history(df: DataFrame, t: TemporalSpec, **key) -> DataFrame:
    for c, v in key.items():
        df = df.where(F.col(c) == v)
    return df.orderBy(t.valid_from)


def compare(df: DataFrame, t: TemporalSpec, key: str, first, second, values: list[str]) -> DataFrame:
    """Both states of every key that has either, and whether they differ in values."""
    side = lambda at, n: valid_at(df, t, at).select(key, *[F.col(v).alias(f"{v}_{n}") for v in values])
    both = side(first, 1).join(side(second, 2), key, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_1").eqNullSafe(F.col(f"{v}_2"))
    return both.withColumn("has_changes", ~same)


def _units(start: Column, end: Column, unit: str) -> Column:
    """The calendar units that a period meets, up to the unit of end."""
    return F.sequence(F.date_trunc(unit, start), F.greatest(F.date_trunc(unit, start), F.date_trunc(unit, end)), F.expr(f"INTERVAL 1 {unit}"))


def overlaps(df: DataFrame, t: TemporalSpec, key: str, ident: str, unit: str = "month") -> DataFrame:
    """Pairs of versions of one key whose periods overlap, the earlier first.

    The later one of a pair starts while the earlier one is valid: so each version meets those that start in the calendar
    units of its period, and a key of any size is many groups. No unit after a key's last start is looked at.
    """
    start, end = F.col(t.valid_from), _end(t)
    rows = df.select(F.col(key), F.col(ident).alias("id"), start.alias("s"), (F.lit(None).cast("timestamp_ntz") if end is None else end).alias("e"))
    last = rows.groupBy(key).agg(F.max("s").alias("last"))
    a = rows.join(last, key).where("e is null or e > s").withColumn("unit", F.explode(_units(F.col("s"), F.least(F.coalesce("e", "last"), F.col("last")), unit)))
    a = a.select(key, "unit", F.col("id").alias("first_id"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = rows.select(key, F.date_trunc(unit, "s").alias("unit"), F.col("id").alias("second_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    order = (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("first_id") < F.col("second_id")))
    return a.join(b, [key, "unit"]).where(order & period_overlaps(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))).select(key, "first_id", "second_id")


def containment_violations(child: DataFrame, ct: TemporalSpec, child_key: str, parent: DataFrame, pt: TemporalSpec, parent_key: str, rule: Containment, unit: str = "year") -> DataFrame:
    """Child versions for which no parent version holds the rule.

    EXACT compares by key and start. WITHIN looks for parents in the calendar unit of the child's start only; a parent is
    in all units of its period up to the last start of its key's children.
    """
    if rule is Containment.NONE:
        return child.limit(0)
    none = F.lit(None).cast("timestamp_ntz")
    ce, pe = (F.col(t.valid_to) if t.valid_to else none for t in (ct, pt))
    k, s, e, u = unused(child.columns, "__parent_key", "__parent_start", "__parent_end", "__unit")
    p = parent.select(F.col(parent_key).alias(k), F.col(pt.valid_from).alias(s), pe.alias(e))
    if rule is Containment.EXACT:
        return child.join(p, (F.col(child_key) == F.col(k)) & F.col(ct.valid_from).eqNullSafe(F.col(s)) & ce.eqNullSafe(F.col(e)), "left_anti")
    last = child.groupBy(F.col(child_key).alias(k)).agg(F.max(ct.valid_from).alias("last"))
    p = p.join(last, k).where(F.col(s) <= F.col("last"))
    p = p.withColumn(u, F.explode(_units(F.col(s), F.least(F.coalesce(F.col(e), F.col("last")), F.col("last")), unit))).drop("last")
    holds = (F.col(s) <= F.col(ct.valid_from)) & (F.col(e).isNull() | (ce.isNotNull() & (ce <= F.col(e))))
    return child.join(p, (F.col(child_key) == F.col(k)) & (F.date_trunc(unit, F.col(ct.valid_from)) == F.col(u)) & holds, "left_anti")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, before: str, after: str, values: list[str], unit: str = "hour") -> DataFrame:
    """Pairs of a left and a right row of a key with left_ts - before <= right_ts <= left_ts + after.

    before and after are interval texts such as "10 MINUTES". A left row is in the calendar units of its interval, a right
    row in its own; so the join is one of equal keys and units.
    """
    low, high = F.col(left_ts) - F.expr(f"INTERVAL {before}"), F.col(left_ts) + F.expr(f"INTERVAL {after}")
    u, lo, hi = unused([*left.columns, *right.columns], "__unit", "__low", "__high")
    a = left.withColumns({lo: low, hi: high}).withColumn(u, F.explode(_units(F.col(lo), F.col(hi), unit)))
    b = right.select(key, F.col(right_ts).alias(f"matched_{right_ts}"), *[F.col(v).alias(f"matched_{v}") for v in values]).withColumn(u, F.date_trunc(unit, F.col(f"matched_{right_ts}")))
    return a.join(b, [key, u]).where((F.col(f"matched_{right_ts}") >= F.col(lo)) & (F.col(f"matched_{right_ts}") <= F.col(hi))).drop(u, lo, hi)


def with_period(df: DataFrame, t: TemporalSpec, name: str = "validity") -> DataFrame:
    """df with its validity as one struct: start, end (null while open), whether it is open, and its length in whole days."""
    start, end = F.col(t.valid_from), _end(t)
    end = F.lit(None).cast("timestamp_ntz") if end is None else end
    return df.withColumn(name, F.struct(start.alias("start"), end.alias("end"), end.isNull().alias("open"), F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000).cast("long").alias("days")))


def temporal_join(left: DataFrame, lt: TemporalSpec, right: DataFrame, rt: TemporalSpec | None, on, moment, how: str = "inner") -> DataFrame:
    """Both sides as of one moment, then an equi-join."""
    return valid_at(left, lt, moment).join(valid_at(right, rt, moment), on, how)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], unit: str = "day") -> DataFrame:
    """Each left row with the latest right values not after it.

    Rows are sorted within a key's calendar unit only, so that a key of any size is many groups. What a unit starts with
    is the last right row of the key's earlier units: a running last over one row for each unit.
    """
    found = F.struct(F.col(right_ts), *[F.col(v) for v in values])
    r = right.select(F.col(key), F.col(right_ts).alias("__ts"), F.date_trunc(unit, F.col(right_ts)).alias("__unit"), found.alias("__right"))
    lft = left.select(F.col(key), F.col(left_ts).alias("__ts"), F.date_trunc(unit, F.col(left_ts)).alias("__unit"), F.struct("*").alias("__left"))
    units = r.groupBy(key, "__unit").agg(F.max_by("__right", "__ts").alias("__last")).unionByName(lft.select(key, "__unit").distinct(), allowMissingColumns=True)
    units = units.groupBy(key, "__unit").agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = Window.partitionBy(key).orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)
    carried = units.select(key, "__unit", F.last("__last", ignorenulls=True).over(before).alias("__right")).where("__right is not null")
    rows = carried.select(key, F.lit(None).cast(r.schema["__ts"].dataType).alias("__ts"), "__unit", "__right", F.lit(0).alias("__side"))
    rows = rows.unionByName(r.withColumn("__side", F.lit(1))).unionByName(lft.withColumn("__side", F.lit(2)), allowMissingColumns=True)
    w = Window.partitionBy(key, "__unit").orderBy(F.col("__ts").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 2")
    return out.select("__left.*", F.col(f"__right.{right_ts}").alias(f"matched_{right_ts}"), *[F.col(f"__right.{v}").alias(f"matched_{v}") for v in values])
