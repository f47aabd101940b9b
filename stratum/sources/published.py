"""Sharded tables behind one manifest: whatever a write changes, on however many shards and tables, is published at once.

A write reads the shards that it touches, stages their next state in one job (a directory for each shard, below a folder
that only this attempt uses) and publishes a manifest that names the new directories. Readers see the version before or
the one after. Directories of older versions stay for readers of those until vacuum().
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TableSpec, TemporalSpec
from ..errors import CommitFailed, RoutingError
from ..operators import versioning
from ..plans.strategies import Known, shard_levels
from ..transactions import Coordinator, Options

STAGED = "_staged"


class Published:
    """A layout for any number of tables below one root."""

    def __init__(self, spark: SparkSession, root: str, log=None, options: Options | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.coordinator = Coordinator(spark, self.root, log, options=options)
        self.manifest = self.coordinator.manifest

    # ---- reads

    def scan(self, spark: SparkSession, spec: TableSpec, known: Known, hint: str | None = None, version: int | None = None) -> DataFrame:
        keep = spec.strategy.prune(known, spec.schema) if spec.strategy and hint is None else None
        state = self.manifest.load(version)
        return self._read(spec, state, self._names(spec, state, keep, hint))

    def _read(self, spec: TableSpec, state: dict, names: list[str]) -> DataFrame:
        paths = [p for n in names for p in state[n]]
        rows = self.spark.read.schema(spec.schema).parquet(*paths) if paths else self.spark.createDataFrame([], spec.schema)
        return rows.withColumns(shard_levels(spec.strategy, spec.schema))

    def _names(self, spec: TableSpec, state: dict, keep: Column | None = None, hint: str | None = None) -> list[str]:
        """Manifest entries of a table's shards, of those that pass a filter on the shard columns. One row is one shard."""
        own = sorted(n for n in state if n.split("/", 1)[0] == spec.name)
        if hint is not None:
            parts = hint.split("/")
            return [n for n in own if [x.split("=", 1)[1] for x in n.split("/")[1:]][: len(parts)] == parts]
        if keep is None or not own:
            return own
        levels = self.spark.createDataFrame([], spec.schema).select(*[c.alias(k) for k, c in shard_levels(spec.strategy, spec.schema).items()]).schema
        shards = self.spark.createDataFrame([(n, [x.split("=", 1)[1] for x in n.split("/")[1:]]) for n in own], "name string, at array<string>")
        shards = shards.select("name", *[F.col("at")[k].cast(f.dataType).alias(f.name) for k, f in enumerate(levels)])
        return sorted(r["name"] for r in shards.where(keep).select("name").collect())

    # ---- writes

    def write(self, df: DataFrame, spec: TableSpec, mode: str = "append") -> int:
        """Adds rows, or puts them in the place of the shards that they go to (overwrite); gives their number."""
        return self.insert_all([(df, spec)], mode)

    def insert_all(self, parts: list[tuple[DataFrame, TableSpec]], mode: str = "append") -> int:
        """Rows of several tables, such as parents and their children, in one version."""

        def work(state, ident):
            after, n = dict(state), 0
            for k, (df, spec) in enumerate(parts):
                staged, rows = self._stage(df, spec, f"{ident}-{k}")
                n += rows
                for name, path in staged.items():
                    after[name] = [*(after.get(name, []) if mode == "append" else []), path]
            return after, n

        return self._commit(work)

    def update(self, spec: TableSpec, condition: Column, values: dict[str, Column], known: Known | None = None) -> int:
        """Rewrites the shards that hold rows of the condition; gives their number. A row whose key changes moves."""
        return self._rewrite(spec, known, condition, lambda rows: versioning.update_where(rows, condition, values))

    def delete(self, spec: TableSpec, condition: Column, known: Known | None = None) -> int:
        return self._rewrite(spec, known, condition, lambda rows: versioning.delete_where(rows, condition))

    def create_versions(self, spec: TableSpec, key: str, changes: DataFrame, effective: str, new_id: tuple[str, Column] | None = None) -> int:
        """Closes versions on the shards that hold them and opens the next ones where those belong, in one version of the
        table; gives the number of versions closed."""
        t = spec.temporal

        def touched(rows):
            return rows.where(versioning.is_open(t)).join(changes.select(key), key, "left_semi")

        return self._rewrite(spec, None, touched, lambda rows: versioning.create_versions(rows, t, key, changes, effective, new_id, check="inline"))

    def transfer(self, spec: TableSpec, key: str, moves: DataFrame, effective: str, new_id: tuple[str, Column] | None = None) -> int:
        """create_versions() whose changes include the shard key: old and new shard are published together."""
        return self.create_versions(spec, key, moves, effective, new_id)

    def _rewrite(self, spec: TableSpec, known: Known | None, condition, transform) -> int:
        def work(state, ident):
            keep = spec.strategy.prune(known, spec.schema) if known and spec.strategy else None
            names = self._names(spec, state, keep)
            levels = list(shard_levels(spec.strategy, spec.schema))
            rows = self._read(spec, state, names)
            hit = condition(rows) if callable(condition) else rows.where(F.coalesce(condition, F.lit(False)))
            # one row for each shard
            counts = hit.groupBy(*levels).agg(F.count("*").alias("n")).collect()
            if not counts:
                return None, 0
            touched = {"/".join([spec.name, *[f"{c}={r[c]}" for c in levels]]) for r in counts}
            old = self._read(spec, state, sorted(touched)).select(*spec.schema.names)
            staged, _ = self._stage(transform(old), spec, f"{ident}-0")
            after = {n: p for n, p in state.items() if n not in touched}
            for name, path in staged.items():
                after[name] = [*after.get(name, []), path]
            return after, sum(r["n"] for r in counts)

        return self._commit(work)

    def _stage(self, df: DataFrame, spec: TableSpec, folder: str) -> tuple[dict[str, str], int]:
        """Writes rows below a folder of this attempt; gives the directory of each shard and the number of rows."""
        levels, root = shard_levels(spec.strategy, spec.schema), f"{self.root}/{STAGED}/{folder}"
        rows = df.select(*spec.schema.names).withColumns(levels)
        rows = rows.hint("rebalance", *levels) if levels else rows
        rows.write.partitionBy(*levels).parquet(root)
        found = self._leaves(spec.name, root, len(levels))
        if any(part.endswith("=__HIVE_DEFAULT_PARTITION__") for name in found for part in name.split("/")):
            raise RoutingError(f"a row of {spec.name} has no shard")
        # from the footers of what has been written
        return found, self.spark.read.schema(spec.schema).parquet(*found.values()).count() if found else 0

    def _leaves(self, name: str, root: str, depth: int) -> dict[str, str]:
        jvm = self.spark.sparkContext._jvm
        fs, found = self.manifest._fs(), {name: root}
        unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for _ in range(depth):
            found = {f"{n}/{unescape(s.getPath().getName())}": f"{p}/{s.getPath().getName()}" for n, p in found.items() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(p)) if s.isDirectory()}
        return found

    def _commit(self, work) -> int:
        """work(state, ident) gives the next state and a number; tried again on the newer state if another writer was first."""
        o = self.coordinator.options
        wait = o.first_wait
        for attempt in range(1, o.retries + 1):
            base = self.manifest.version()
            ident = f"XS-{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:8]}"
            log = lambda state, i=ident, b=base: self.coordinator.log.append(id=i, state=state, shards=[STAGED], base=b)
            log("prepared")
            try:
                after, n = work(self.manifest.load(base) if base else {}, ident)
                if after is not None:
                    self.manifest.publish(base, after)
                log("committed")
                return n
            except BaseException as e:
                self.manifest.forget(ident, [STAGED])
                log("rolled_back")
                if not isinstance(e, CommitFailed) or attempt == o.retries:
                    raise
            time.sleep(min(wait, o.longest_wait))
            wait *= o.factor
        return 0

    def vacuum(self) -> int:
        """Deletes staged directories that the current version does not name; older versions cannot be read after it."""
        live = {p for paths in self.manifest.load().values() for p in paths}
        fs, gone = self.manifest._fs(), 0
        staged = self.manifest._path(STAGED)
        for folder in fs.listStatus(staged) if fs.exists(staged) else ():
            at = f"{self.root}/{STAGED}/{folder.getPath().getName()}"
            if not any(p == at or p.startswith(at + "/") for p in live):
                fs.delete(folder.getPath(), True)
                gone += 1
        return gone


def audit_trail(table: DataFrame, rows: DataFrame, key: str, t: TemporalSpec, at: Column, who: Column) -> tuple[DataFrame, DataFrame]:
    """The audit mode of versions: (the table after, where rows take the place of their keys' rows; the trail of what each key had before)."""
    old = table.join(rows.select(key), key, "left_semi")
    trail = old.withColumns({"changed_at": at.cast("timestamp_ntz"), "changed_by": who, "was_valid_from": F.col(t.valid_from)})
    return versioning.upsert(table, rows, key), trail


def append_only(table: DataFrame, rows: DataFrame, t: TemporalSpec, key: str) -> tuple[DataFrame, DataFrame]:
    """The append-only mode: (all rows ever written, which are never touched; the newest of each key)."""
    every = table.unionByName(rows)
    newest = every.groupBy(key).agg(F.max_by(F.struct("*"), F.col(t.valid_from)).alias("r")).select("r.*")
    return every, newest
