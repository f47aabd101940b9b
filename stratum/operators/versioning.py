"""Versioned writes, as transforms of whole tables: the rows of after, given those of before and a table of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import TemporalSpec
from ..errors import TemporalError, VersionConflict
from ..functions.columns import unused


def _closing(t: TemporalSpec, at: Column) -> Column:
    return at if not t.close_offset_us else at - F.expr(f"INTERVAL {t.close_offset_us} MICROSECOND")


def _open_end(t: TemporalSpec) -> Column:
    return F.lit(t.open_end).cast("timestamp_ntz")


def is_open(t: TemporalSpec) -> Column:
    end = F.col(t.valid_to)
    return end.isNull() if t.open_end is None else end.isNull() | (end == F.lit(t.open_end))


def add(rows: DataFrame, t: TemporalSpec, effective: Column) -> DataFrame:
    """New rows, valid from effective on."""
    out = rows.withColumn(t.valid_from, effective.cast("timestamp_ntz"))
    return out.withColumn(t.valid_to, _open_end(t)) if t.valid_to else out


def _matched(table: DataFrame, t: TemporalSpec, key: str, changes: DataFrame) -> tuple[DataFrame, str]:
    """table with what changes say of its open versions, in a struct column, and that column's name."""
    k, c = unused(table.columns, "__key", "__change")
    said = changes.select(F.col(key).alias(k), F.struct("*").alias(c))
    return table.join(said, (F.col(key) == F.col(k)) & is_open(t), "left").drop(k), c


def _refuse(table: DataFrame, t: TemporalSpec, key: str, changes: DataFrame, moment: str, late: str) -> None:
    """In one job: no key may change twice at once, and no change may come before (or with) the version that it ends."""
    said = changes.groupBy(key).agg(F.count("*").alias("n_changes"), F.min(moment).alias("first_change"))
    state = table.where(is_open(t)).select(key, F.col(t.valid_from).alias("began"))
    bad = said.join(state, key, "left").where(f"n_changes > 1 or first_change {late} began").select("n_changes").limit(1).collect()
    if bad:
        raise VersionConflict("a key changes twice at once" if bad[0][0] > 1 else "a version must start before it is ended or followed")


def create_versions(table: DataFrame, t: TemporalSpec, key: str, changes: DataFrame, effective: str, new_id: tuple[str, Column] | None = None, check: bool | str = True) -> DataFrame:
    """Closes the open version of each changed key at its effective moment and opens the next, with the changed columns.

    changes: key (once), effective, and a column of a new value for each changed column. new_id: the row id column and
    what it is in new versions (a column over the old row). check="inline" puts the checks into the plan, which then fails
    when it runs, without a job before.
    """
    if t.valid_to is None:
        raise TemporalError("versions need an end column")
    if check is True:
        _refuse(table, t, key, changes, effective, "<=")
    elif check == "inline":
        twice = F.raise_error(F.lit("a key changes twice at once")).cast("long")
        n, = unused(changes.columns, "__n")
        once = changes.groupBy(key).agg(F.count("*").alias(n), F.first(F.struct("*")).alias("c"))
        changes = once.where(F.when(F.col(n) > 1, twice).otherwise(F.col(n)) == 1).select("c.*")
    m, c_ = _matched(table, t, key, changes)
    hit = F.col(c_).isNotNull()
    at = F.col(f"{c_}.{effective}")
    if check == "inline":
        late = F.raise_error(F.lit("a version must start before it is followed")).cast("timestamp_ntz")
        at = F.when(at <= F.col(t.valid_from), late).otherwise(at)
    kept = m.withColumn(t.valid_to, F.when(hit, _closing(t, at)).otherwise(F.col(t.valid_to))).drop(c_)
    new = m.where(hit)
    for c in changes.columns:
        if c not in (key, effective):
            new = new.withColumn(c, F.col(f"{c_}.{c}"))
    if new_id:
        new = new.withColumn(new_id[0], new_id[1])
    new = new.withColumn(t.valid_from, at).withColumn(t.valid_to, _open_end(t)).drop(c_)
    return kept.unionByName(new)


def terminate(table: DataFrame, t: TemporalSpec, key: str, ends: DataFrame, moment: str, check: bool = True) -> DataFrame:
    """Ends the open version of each key at its moment, which may be the version's start."""
    if t.valid_to is None:
        raise TemporalError("a table without an end column cannot end a version")
    if check:
        _refuse(table, t, key, ends, moment, "<")
    m, c = _matched(table, t, key, ends)
    return m.withColumn(t.valid_to, F.when(F.col(c).isNotNull(), F.col(f"{c}.{moment}")).otherwise(F.col(t.valid_to))).drop(c)


def transfer(table: DataFrame, t: TemporalSpec, key: str, moves: DataFrame, effective: str, shard: str, new_id: tuple[str, Column] | None = None) -> DataFrame:
    """Closes versions on their shard and opens them on the one that moves names; on the same shard that is a new version."""
    return create_versions(table, t, key, moves.select(key, effective, shard), effective, new_id)


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows win over those of table with their key."""
    return table.join(rows, key, "left_anti").unionByName(rows)
