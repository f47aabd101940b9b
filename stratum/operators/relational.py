"""Shapes that queries share: pages, nested children, distribution over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StratumError


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a total order; numbers start at 1. Only skip + take rows leave a task; for deep pages see page_after()."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: tuple | None, size: int) -> DataFrame:
    """The page after a row of a total order, by that row's keys: however deep, only size rows leave a task.

    order: columns that hold no null, and whether each ascends; last: the keys of the last row seen, None for the first page.
    """
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for (c, up), v in zip(order, last, strict=True):
            after = after | (same & (F.col(c) > F.lit(v) if up else F.col(c) < F.lit(v)))
            same = same & (F.col(c) == F.lit(v))
        # the first key alone bounds the scan
        (c, up), v = order[0], last[0]
        df = df.where(F.col(c) >= F.lit(v) if up else F.col(c) <= F.lit(v)).where(after)
    return df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page whose rows carry the number of all rows and pages, from one aggregate beside the top-k."""
    total = df.agg(F.count("*").alias("total_count")).withColumn("total_pages", F.ceil(F.col("total_count") / size).cast("long"))
    return page(df, order, number, size).join(F.broadcast(total))


def include(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str, columns: list[str]) -> DataFrame:
    """parent with its children as a sorted array of structs; empty for none."""
    nested = child.groupBy(F.col(child_key).alias("__fk")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    kind = nested.schema[name].dataType
    return parent.join(nested, parent[parent_key] == F.col("__fk"), "left").drop("__fk").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def distribution(df: DataFrame, bucket: Column) -> DataFrame:
    """Rows of each bucket, with the population deviation of all counts."""
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.stddev_pop("n").alias("deviation"))))


def single(df: DataFrame):
    """The only row; any other number is an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise StratumError(f"{'no row' if not rows else 'more than one row'}; one was asked for")
    return rows[0]


def first_or_none(df: DataFrame):
    return next(iter(df.limit(1).collect()), None)


def any_row(df: DataFrame, condition: Column) -> bool:
    return bool(df.where(condition).limit(1).count())


def all_rows(df: DataFrame, condition: Column) -> bool:
    return not any_row(df, ~F.coalesce(condition, F.lit(False)))
