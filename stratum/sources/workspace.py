"""Sharded copies of the driver tables, written once for each session and input folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, TableSpec
from ..errors import StratumError
from ..plans.strategies import Strategy
from ..plans.table import Engine, Session, ShardedTable
from .layouts import Directories

_made: dict[tuple, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise StratumError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="stratum-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def sharded(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, strategy: Strategy, temporal=None) -> ShardedTable:
    """rows as a table sharded by strategy, behind an engine."""
    spec = TableSpec(name, rows.schema, temporal=temporal, strategy=strategy)
    catalog = Catalog()
    catalog.add_table(spec)
    key = (spark.sparkContext.applicationId, sf_dir, name, str(strategy))
    if key not in _made:
        root = f"{scratch(spark)}/stratum/{name}-{uuid.uuid4().hex}"
        Directories(root).write(rows, spec, check=False)
        _made[key] = root
    engine = Engine(Session(spark), catalog)
    engine.mount(name, Directories(_made[key], keep_listing=True))
    return engine.table(name)


def published(spark: SparkSession, name: str, rows: DataFrame, strategy: Strategy, temporal=None, beside: ShardedTable | None = None) -> ShardedTable:
    """An empty table behind a manifest of its own, or of another such table's."""
    from .published import Published

    spec = TableSpec(name, rows.schema, temporal=temporal, strategy=strategy)
    catalog = Catalog()
    catalog.add_table(spec)
    engine = Engine(Session(spark), catalog)
    engine.mount(name, beside.source if beside else Published(spark, f"{scratch(spark)}/stratum/{name}-{uuid.uuid4().hex}"))
    return engine.table(name)


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of a customer's contract: valid from the order's date to that of the customer's next order."""
    from ..operators.temporal import versions_of

    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    return versions_of(o, "o_custkey", "valid_from", "valid_to", "o_orderkey")
