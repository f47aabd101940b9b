"""Shards in databases, read over JDBC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ShardSpec, TableSpec
from ..plans.strategies import Known, resolve


def options(shard: ShardSpec, table: str, pattern: str = "{Table}_{ShardId}", key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> dict[str, str]:
    """What spark.read.format("jdbc") needs for a table of one shard, split by key into parts where that is given."""
    name = shard.table_name(table, pattern)
    out = {"url": shard.path or "", "dbtable": f"{shard.schema}.{name}" if shard.schema else name, "pushDownPredicate": "true", "pushDownAggregate": "true"}
    if key:
        out |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def scan(spark: SparkSession, spec: TableSpec, shards: list[ShardSpec], known: Known | None = None, hint: str | None = None, **how) -> DataFrame:
    """The shards that a read needs as one table with the shard's id; predicates go to each database.

    Shards are chosen by the equality on the strategy's key and by the dates of the read; without any the table is empty.
    """
    k = known or Known({}, {})
    by = spec.strategy.columns[0] if spec.strategy and spec.strategy.columns else None
    shards = resolve(shards, k.equal.get(by), hint=hint)
    latest = k.as_of if k.as_of is not None else k.between and k.between[1]
    if latest is not None:
        # a version of an earlier shard may be valid still
        shards = [s for s in shards if s.date_range is None or s.date_range.start <= latest]
    if not shards:
        return spark.createDataFrame([], spec.schema).withColumn("shard", F.lit(None).cast("string"))
    parts = [spark.read.format("jdbc").options(**options(s, spec.name, **how)).load().select(*spec.schema.names).withColumn("shard", F.lit(s.id)) for s in shards]
    return reduce(DataFrame.unionByName, parts)
