"""Where a sharded table's rows lie: directories of one root, a root for each shard, or existing paths with predicates."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ShardSpec, TableSpec, Tier
from ..errors import ReadOnlyShard, RoutingError
from ..functions.columns import unused
from ..plans.strategies import Known, resolve, shard_levels

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, spec: TableSpec, paths: list[str], fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.schema(spec.schema).format(fmt).options(**options).load(paths)


def _null_keys(df: DataFrame, spec: TableSpec) -> None:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.strategy.columns], F.lit(False))
    if df.where(bad).limit(1).count():
        raise RoutingError(f"a row of {spec.name} has no shard key")


#: What keep_listing keeps: a table's rows with the list of its files, by session, root and schema.
_listed: dict[tuple, tuple[DataFrame, T.StructType]] = {}


@dataclass(frozen=True)
class Directories:
    """One root, a directory for each shard value. Dynamic overwrite replaces only the shards that rows go to.

    keep_listing: files are listed once for a session, and again after a write of this session or refresh(); for tables
    that no one else writes. Otherwise each read lists them, which takes a job where there are many shards.
    """

    root: str
    fmt: str = "parquet"
    keep_listing: bool = False

    def scan(self, spark: SparkSession, spec: TableSpec, known: Known, hint: str | None = None) -> DataFrame:
        rows, levels = self._table(spark, spec)
        if hint is not None:
            # outermost first: EU, or EU/3 for one shard of two levels
            for level, part in zip(levels.names, hint.split("/", len(levels.names) - 1), strict=False):
                rows = rows.where(F.col(level).cast("string") == part)
            return rows
        keep = spec.strategy.prune(known, spec.schema) if spec.strategy else None
        return rows if keep is None else rows.where(keep)

    def _table(self, spark: SparkSession, spec: TableSpec) -> tuple[DataFrame, T.StructType]:
        """All rows, and the shard columns."""
        key = (spark.sparkContext.applicationId, self.root, spec.schema.json())
        if self.keep_listing and key in _listed:
            return _listed[key]
        # the schema is known: no footer is read to find it, and shard values keep their types
        levels = spark.createDataFrame([], spec.schema).select(*[c.alias(k) for k, c in shard_levels(spec.strategy, spec.schema).items()]).schema if spec.strategy else T.StructType()
        found = spark.read.schema(T.StructType([*spec.schema.fields, *levels.fields])).format(self.fmt).load(self.root), levels
        if self.keep_listing:
            _listed[key] = found
        return found

    def refresh(self) -> None:
        for key in [k for k in _listed if k[1] == self.root]:
            del _listed[key]

    def write(self, df: DataFrame, spec: TableSpec, mode: str = "append", check: bool = True) -> None:
        """One shuffle by shard and row, so that a shard of any size is written by many tasks and each task has few files."""
        if check and spec.strategy:
            _null_keys(df, spec)
        levels = shard_levels(spec.strategy, spec.schema)
        df.select(*spec.schema.names).withColumns(levels).hint("rebalance", *levels).write.option("partitionOverwriteMode", "dynamic").partitionBy(*levels).mode(mode).format(self.fmt).save(self.root)
        self.refresh()

    def create(self, spark: SparkSession, spec: TableSpec) -> None:
        """An empty table with its schema."""
        empty = spark.createDataFrame([], spec.schema).withColumns(shard_levels(spec.strategy, spec.schema))
        empty.write.mode("ignore").format(self.fmt).save(self.root)


def _union(parts: list[DataFrame], spark: SparkSession, spec: TableSpec) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], spec.schema).withColumn("shard", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Roots:
    """A root for each shard; shards that a request rules out are never listed."""

    shards: tuple[ShardSpec, ...]
    key: str | None = None
    fmt: str = "parquet"
    on_archive_error: str = "raise"
    date_key: str | None = None

    def scan(self, spark: SparkSession, spec: TableSpec, known: Known, hint: str | None = None) -> DataFrame:
        at = known.equal.get(self.date_key) if self.date_key else None
        found = resolve(list(self.shards), known.equal.get(self.key), at, None, hint)
        temporal = known.as_of if known.as_of is not None else known.between and known.between[1]
        if temporal is not None:
            # a version of an earlier shard may be valid still
            found = [s for s in found if s.date_range is None or s.date_range.start <= temporal]
        parts = []
        for s in found:
            try:
                part = spark.read.schema(spec.schema).format(self.fmt).load(s.path)
            except Exception:
                if s.tier is Tier.ARCHIVE and self.on_archive_error == "skip":
                    continue
                raise
            parts.append(part.withColumn("shard", F.lit(s.id)))
        return _union(parts, spark, spec)

    def write(self, df: DataFrame, spec: TableSpec, mode: str = "append") -> None:
        """Each writable shard gets its rows; a row of none, or of a read-only one, is an error before anything is written."""
        column, taken = F.upper(F.col(self.key).cast("string")), F.lit(False)
        rules = []
        for s in self.shards:
            if s.key_value:
                mine = column == s.key_value.upper()
                rules.append((s, mine))
                taken = taken | mine
        rules += [(s, column.isNotNull() & ~taken) for s in self.shards if not s.key_value][:1]
        covered = reduce(lambda a, b: a | b, [r for _, r in rules], F.lit(False))
        no = F.count_if(~F.coalesce(covered, F.lit(False))).alias("none")
        closed = [(s, F.count_if(mine).alias(f"n{k}")) for k, (s, mine) in enumerate(rules) if not s.writable]
        found = df.agg(no, *[n for _, n in closed]).first()
        if found[0]:
            raise RoutingError(f"a row of {spec.name} has no shard")
        for (s, _), n in zip(closed, found[1:], strict=True):
            if n:
                raise ReadOnlyShard(s.qualified)
        # one pass: all rows to one folder, a directory for each shard, whose files then go to the shards' roots
        open_ = [(s, mine) for s, mine in rules if s.writable]
        if not open_:
            return
        which = F.coalesce(*[F.when(mine, k) for k, (_, mine) in enumerate(open_)])
        at, = unused(df.columns, "__root")
        staged = f"{open_[0][0].path.rstrip('/')}-staged-{uuid.uuid4().hex}"
        spark = df.sparkSession
        df.select(*spec.schema.names, which.alias(at)).hint("rebalance", at).write.partitionBy(at).format(self.fmt).save(staged)
        try:
            for k, (s, _) in enumerate(open_):
                _move(spark, f"{staged}/{at}={k}", s.path, spec, self.fmt, mode)
        finally:
            _delete(spark, staged)

    def create(self, spark: SparkSession, spec: TableSpec) -> None:
        for s in self.shards:
            spark.createDataFrame([], spec.schema).write.mode("ignore").format(self.fmt).save(s.path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _move(spark: SparkSession, folder: str, to: str, spec: TableSpec, fmt: str, mode: str) -> None:
    """Files of a folder into a root; copied by a job where that is on another file system."""
    (here, source), (there, goal) = _fs(spark, folder), _fs(spark, to)
    some = here.exists(source)
    if mode == "overwrite" and there.exists(goal):
        there.delete(goal, True)
    there.mkdirs(goal)
    if not some:
        return
    if here.getUri().toString() != there.getUri().toString():
        spark.read.schema(spec.schema).format(fmt).load(folder).write.mode("append").format(fmt).save(to)
        return
    for f in here.listStatus(source):
        if not there.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/{f.getPath().getName()}")):
            raise OSError(f"{f.getPath()} could not be moved to {to}")


@dataclass(frozen=True)
class Mapped:
    """Existing paths, each with a condition on its rows (SQL text)."""

    paths: tuple[tuple[str, str], ...]
    fmt: str = "parquet"

    def scan(self, spark: SparkSession, spec: TableSpec, known: Known, hint: str | None = None) -> DataFrame:
        return _union([spark.read.schema(spec.schema).format(self.fmt).load(p).where(c).withColumn("shard", F.lit(p)) for p, c in self.paths if hint is None or p == hint], spark, spec)


def refused(df: DataFrame, spec: TableSpec, shard: ShardSpec) -> DataFrame:
    """Rows that a shard may not take: all of them if it is closed to writes, else those that start outside its dates."""
    if not shard.writable:
        return df
    if shard.date_range is None or spec.temporal is None:
        return df.limit(0)
    start = F.col(spec.temporal.valid_from)
    return df.where(~F.coalesce((start >= F.lit(shard.date_range.start)) & (start < F.lit(shard.date_range.end)), F.lit(False)))


class SinkChain:
    """Bulk sinks: the first that can take a table writes it, else the layout does."""

    def __init__(self, *sinks):
        self.sinks = list(sinks)

    def insert(self, df: DataFrame, spec: TableSpec, layout) -> int | None:
        """The number of rows, of sinks and layouts that know it."""
        for s in self.sinks:
            if s.can_handle(spec):
                return s.write(df, spec)
        return layout.write(df, spec)


def bulk_insert(df: DataFrame, spec: TableSpec, layout, chain: SinkChain | None = None) -> int:
    """Writes rows to their shards; gives their number, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    n = (chain or SinkChain()).insert(df.observe(seen, F.count(F.lit(1)).alias("n")), spec, layout)
    if n is not None:
        return n
    try:
        return seen.get["n"]
    except Py4JJavaError:
        # of a table that is known to be empty nothing runs, and nothing is observed
        return 0
