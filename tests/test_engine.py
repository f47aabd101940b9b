"""Layouts, pruning seen in plans, sessions, transactions, streams, and every registered query against its SQL."""

import glob
import math
import shutil
from datetime import datetime as D

import duckdb
import pytest
from pyspark.sql import functions as F

from stratum.catalog import Catalog, DateRange, ShardSpec, StorageMode, TableSpec, TemporalSpec, Tier
from stratum.errors import CommitFailed, NestedTransaction, ReadOnlyShard, RoutingError, ShardNotFound, TransactionError
from stratum.plans import workload
from stratum.plans.strategies import ByDate, ByHash, ByValue, Known
from stratum.plans.table import Engine, Session
from stratum.sources.layouts import Directories, Mapped, Roots, SinkChain, bulk_insert
from stratum.streaming.events import append_to, read_stream, windowed
from stratum.transactions import Coordinator, FileLog, Options, State

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def regions(spark):
    return spark.createDataFrame([(k, r, f"n{k}") for k, r in enumerate(["EU", "US", "APAC"] * 10)], "id int, region string, name string")


def mounted(spark, spec, source):
    c = Catalog()
    c.add_table(spec)
    e = Engine(Session(spark), c)
    e.mount(spec.name, source)
    return e.table(spec.name)


def test_directories_prune_and_route(spark, tmp_path):
    rows = regions(spark)
    spec = TableSpec("customer", rows.schema, strategy=ByValue("region"))
    layout = Directories(str(tmp_path / "t"))
    layout.create(spark, spec)
    assert bulk_insert(rows, spec, layout) == 30
    t = mounted(spark, spec, layout)
    eu = t.where_eq(region="eu")
    assert eu.count() == 10 and t.count() == 30 and "PartitionFilters: [isnotnull(shard" in plan(eu.df())
    assert t.where_eq(name="EU").count() == 0  # a value of another column prunes nothing
    assert t.shard_hint("US").count() == 10 and t.where(F.col("id") < 5).count() == 5
    assert sorted(r["id"] for r in t.stream()) == list(range(30))
    assert t.scalar(F.count("*"), sum) == 30 and t.where_eq(region="US").scalar(F.max("id"), max) == 28
    with pytest.raises(RoutingError):
        layout.write(rows.withColumn("region", F.lit(None).cast("string")), spec)
    kept = mounted(spark, spec, Directories(layout.root, keep_listing=True))
    assert kept.count() == 30
    # one shard's rows replaced, the others untouched
    layout.write(rows.where("region = 'EU'").limit(2), spec, mode="overwrite")
    assert t.count() == 22 and kept.count() == 22


def test_hash_and_date_pruning_reach_the_scan(spark, tmp_path):
    e = workload.events(spark, SF)
    spec = TableSpec("events", e.schema, strategy=ByHash("user_id", 8))
    layout = Directories(str(tmp_path / "h"))
    layout.write(e, spec)
    t = mounted(spark, spec, layout).where_eq(user_id=3)
    assert t.count() == e.where("user_id = 3").count() and "shard" in plan(t.df()).split("PartitionFilters: [")[1].split("]")[0]
    spec = TableSpec("by_day", e.schema, strategy=ByDate("ts", "day"))
    layout = Directories(str(tmp_path / "d"))
    layout.write(e, spec)
    t = mounted(spark, spec, layout).where_range("ts", D(2024, 1, 3), D(2024, 1, 5), closed=False)
    assert t.count() == e.where((F.col("ts") >= D(2024, 1, 3)) & (F.col("ts") < D(2024, 1, 5))).count() > 0
    assert "shard" in plan(t.df()).split("PartitionFilters: [")[1].split("]")[0]


def test_versions_of_earlier_shards_are_found(spark):
    whole = workload.order_versions(spark, SF)
    t = workload.year_sharded(spark, SF)
    from stratum.operators.temporal import valid_at

    assert t.valid_at(D(1997, 6, 1)).count() == valid_at(whole, workload.VALID, D(1997, 6, 1)).count()
    t.session.at(D(1997, 6, 1))
    assert t.count() == t.valid_at(D(1997, 6, 1)).count()
    t.session.with_history()
    assert t.count() == whole.count()
    t.session.clear()
    assert t.count() == whole.count() and t.all_versions().count() == whole.count()


def test_roots_and_mapped_paths(spark, tmp_path):
    rows = regions(spark)
    spec = TableSpec("customer", rows.schema)
    shard = lambda s, **m: ShardSpec(s, mode=StorageMode.DATABASES, path=str(tmp_path / s), **m)
    roots = Roots((shard("eu", key_value="EU"), shard("us", key_value="US"), shard("rest")), "region")
    roots.create(spark, spec)
    roots.write(rows, spec)
    assert roots.scan(spark, spec, Known({"region": "eu"}, {})).count() == 10 and roots.scan(spark, spec, Known({}, {})).count() == 30
    assert {r["shard"] for r in roots.scan(spark, spec, Known({}, {})).select("shard").distinct().collect()} == {"eu", "us", "rest"}
    with pytest.raises(RoutingError):
        Roots(roots.shards[:2], "region").write(rows, spec)
    with pytest.raises(ReadOnlyShard):
        Roots((shard("eu", key_value="EU", read_only=True), shard("rest")), "region").write(rows, spec)
    gone = shard("old", key_value="OLD", tier=Tier.ARCHIVE)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Roots((*roots.shards, gone), "region").scan(spark, spec, Known({}, {})).count()
    assert Roots((*roots.shards, gone), "region", on_archive_error="skip").scan(spark, spec, Known({}, {})).count() == 30
    both = Mapped(((str(tmp_path / "eu"), "id < 9"), (str(tmp_path / "us"), "id > 20")))
    assert both.scan(spark, spec, Known({}, {})).count() == 3 + 3
    ranged = Roots((shard("eu", date_range=DateRange(D(2023, 1, 1), D(2024, 1, 1))), shard("us", date_range=DateRange(D(2024, 1, 1), D(2025, 1, 1)))))
    assert ranged.scan(spark, spec, Known({}, {}, D(2023, 6, 1))).count() == 10 and ranged.scan(spark, spec, Known({}, {}, D(2024, 6, 1))).count() == 20


def test_sinks_are_asked_in_order(spark, tmp_path):
    taken = []

    class Own:
        def can_handle(self, spec):
            return spec.name == "mine"

        def write(self, df, spec):
            taken.append(df.count())

    rows = regions(spark)
    layout = Directories(str(tmp_path / "t"))
    SinkChain(Own()).insert(rows, TableSpec("mine", rows.schema, strategy=ByValue("region")), layout)
    SinkChain(Own()).insert(rows, TableSpec("other", rows.schema, strategy=ByValue("region")), layout)
    assert taken == [30] and spark.read.parquet(layout.root).count() == 30


def test_plain_tables_jdbc_options_and_refused_rows(spark, tmp_path):
    from stratum.sources.jdbc import options
    from stratum.sources.layouts import refused

    rows = regions(spark)
    spec = TableSpec("plain", rows.schema)
    layout = Directories(str(tmp_path / "p"))
    assert bulk_insert(rows, spec, layout) == 30 and bulk_insert(rows.limit(0), spec, layout) == 0
    assert mounted(spark, spec, layout).where_eq(region="EU").count() == 10
    s = ShardSpec("eu", mode=StorageMode.DATABASES, path="jdbc:x", schema="sales", date_range=DateRange(D(1996, 1, 1), D(1997, 1, 1)))
    assert options(s, "orders")["dbtable"] == "sales.orders" and options(s, "orders", key="id", high=9, parts=3)["numPartitions"] == "3"
    v = workload.order_versions(spark, SF)
    spec = TableSpec("contract", v.schema, temporal=workload.VALID)
    assert refused(v, spec, s).count() == v.where("year(valid_from) <> 1996").count() and refused(v, spec, ShardSpec("x")).count() == 0
    assert refused(v, spec, ShardSpec("x", read_only=True)).count() == v.count()


def test_transactions(spark, tmp_path):
    log = FileLog(str(tmp_path / "log"))
    c = Coordinator(spark, str(tmp_path / "t"), log, {"eu", "us"}, Options(retries=2, first_wait=0.01))
    rows = spark.range(3)
    with c.transaction() as t:
        t.stage("eu", rows)
        t.stage("us", rows)
        assert c.read("eu").count() == 3  # its own writes
        point = t.savepoint()
        t.stage("eu", rows)
        t.rollback_to(point)
        assert t.read("eu").count() == 3
        with pytest.raises(NestedTransaction), c.transaction():
            pass
    assert t.state is State.COMMITTED and c.read("eu").count() == 3 and c.manifest.version() == 1
    with pytest.raises(ZeroDivisionError), c.transaction() as t:
        t.stage("eu", rows)
        1 / 0  # noqa: B018
    assert t.state is State.ROLLED_BACK and c.read("eu").count() == 3
    with pytest.raises(TransactionError):
        t.stage("eu", rows)
    with c.transaction() as t, pytest.raises(ShardNotFound):
        t.enlist("asia")
    c.run(lambda t: t.stage("us", spark.range(10), replace=True))
    assert c.read("us").count() == 10 and c.read("us", 1).count() == 3
    # another writer was first
    with pytest.raises(CommitFailed), c.transaction() as t:
        t.stage("eu", rows)
        c.manifest.publish(t.base, t.snapshot)
    assert t.state is State.FAILED
    # a log that stops after prepare: the manifest decides
    log.append(id="XS-lost", state="prepared", shards=["eu"], base=99)
    with open(log.path, "a") as f:
        f.write("{broken\n")
    assert c.recover() == 1 and log.read()[-1]["state"] == "rolled_back" and c.recover() == 0


def test_streams(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    shutil.copy(f"{SF}/events.parquet", files / "a.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream = read_stream(spark, str(files), spark.read.parquet(str(files)).schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    q = append_to(windowed(stream, "ts", ["event_type"], "value", "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["w"], r["event_type"]): r["n"] for r in e.groupBy(F.window("ts", "1 day").start.alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 10  # windows open at the end are not final


def norm(v):
    if v is None:
        return "none"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = workload.queries()[name](spark, SF)
    rel = duck.sql(workload.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(workload.queries()) <= set(__spark_entry__.queries())
    assert TemporalSpec("a").valid_to is None
