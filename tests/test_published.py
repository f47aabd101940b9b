"""Tables behind a manifest: counts, moves, whole versions, races, recovery; scopes; odd requests."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from stratum.catalog import Catalog, ShardSpec, TableSpec, TemporalSpec
from stratum.errors import CommitFailed, RoutingError, StratumError, VersionConflict
from stratum.operators import versioning as V
from stratum.plans.strategies import ByHash, ByValue, Composite, Known
from stratum.plans.table import Engine, Session
from stratum.sources import jdbc
from stratum.sources.layouts import Directories, bulk_insert
from stratum.sources.published import STAGED, Published
from stratum.transactions import Coordinator, Manifest, Options, SharedLog

VALID = TemporalSpec("valid_from", "valid_to")


def table(spark, rows, strategy, source, name="t", temporal=None):
    c = Catalog()
    spec = TableSpec(name, rows.schema, strategy=strategy, temporal=temporal)
    c.add_table(spec)
    e = Engine(Session(spark), c)
    e.mount(name, source)
    return e.table(name)


def people(spark):
    return spark.createDataFrame([(k, r, f"n{k}") for k, r in enumerate(["EU", "EU", "US", "APAC", "US"])], "id int, region string, name string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_bulk_writes_count_rewrite_and_move(spark, tmp_path):
    rows, store = people(spark), Published(spark, str(tmp_path / "t"))
    t = table(spark, rows, ByValue("region"), store)
    assert t.count() == 0 and store.write(rows.limit(0), t.spec) == 0
    assert bulk_insert(rows, t.spec, store) == 5 and t.count() == 5 and ids(t.where_eq(region="eu").df()) == [0, 1] and ids(t.shard_hint("US").df()) == [2, 4]
    before = store.manifest.load()
    assert store.update(t.spec, F.col("id") == 3, {"name": F.lit("new")}) == 1
    after = store.manifest.load()
    assert {n for n in after if after[n] != before[n]} == {"t/shard=APAC"}
    # a row whose key changes moves; both shards change in one version
    v = store.manifest.version()
    assert store.update(t.spec, F.col("id") == 0, {"region": F.lit("APAC")}) == 1 and store.manifest.version() == v + 1
    assert ids(t.where_eq(region="APAC").df()) == [0, 3] and ids(t.where_eq(region="EU").df()) == [1]
    assert store.delete(t.spec, F.col("region") == "EU") == 1 and store.delete(t.spec, F.col("id") == 99) == 0
    assert ids(t.df()) == [0, 2, 3, 4] and ids(store.scan(spark, t.spec, Known({}, {}), version=v)) == [0, 1, 2, 3, 4]
    with pytest.raises(RoutingError):
        store.write(rows.withColumn("region", F.lit(None).cast("string")), t.spec)
    assert ids(t.df()) == [0, 2, 3, 4] and store.vacuum() >= 1 and ids(t.df()) == [0, 2, 3, 4]
    assert store.write(rows.where("region = 'US'").limit(1), t.spec, mode="overwrite") == 1 and len(ids(t.where_eq(region="US").df())) == 1


def test_versions_and_transfers_over_shards(spark, tmp_path):
    rows = spark.createDataFrame([(1, "EU", 10.0, D(2024, 1, 1), None), (2, "EU", 20.0, D(2024, 1, 1), None), (3, "US", 30.0, D(2024, 1, 1), D(2024, 2, 1))], "id int, region string, amount double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    store = Published(spark, str(tmp_path / "t"))
    t = table(spark, rows, ByValue("region"), store, temporal=VALID)
    store.write(rows, t.spec)
    move = spark.createDataFrame([(1, D(2024, 5, 1), "US")], "id int, effective timestamp_ntz, region string")
    assert store.transfer(t.spec, "id", move, "effective") == 1
    assert sorted((r["region"], r["valid_to"]) for r in t.all_versions().where_eq(id=1).df().collect() if r["valid_to"]) == [("EU", D(2024, 5, 1))]
    assert ids(t.valid_at(D(2024, 6, 1)).where_eq(region="US").df()) == [1] and ids(t.valid_at(D(2024, 4, 1)).where_eq(region="EU").df()) == [1, 2]
    # nothing changes where a change is late or a key changes twice
    state = store.manifest.version()
    for bad in ([(2, D(2023, 1, 1), "US")], [(2, D(2024, 7, 1), "US"), (2, D(2024, 8, 1), "EU")]):
        with pytest.raises(Exception, match="must start|twice"):
            store.transfer(t.spec, "id", spark.createDataFrame(bad, move.schema), "effective")
        with pytest.raises(VersionConflict):
            V.create_versions(rows, VALID, "id", spark.createDataFrame(bad, move.schema), "effective")
    assert store.manifest.version() == state and store.manifest._fs().listStatus(store.manifest._path(STAGED)) is not None
    odd = rows.withColumns({"__key": F.lit(1), "__change": F.lit(2)})
    assert V.create_versions(odd, VALID, "id", move, "effective").count() == 4


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    store = Published(spark, str(tmp_path / "t"))
    rows = people(spark)
    parents, children = table(spark, rows, ByValue("region"), store, "parents"), table(spark, rows, ByHash("id", 3), store, "children")
    assert store.insert_all([(rows, parents.spec), (rows, children.spec)]) == 10 and parents.count() == children.count() == 5
    with pytest.raises(RoutingError):
        store.insert_all([(rows, parents.spec), (rows.withColumn("id", F.lit(None).cast("int")), children.spec)])
    assert parents.count() == children.count() == 5


def test_one_of_two_writers_publishes(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))

    def publish(k):
        try:
            m.publish(0, {"s": [str(k)]})
            return k
        except CommitFailed:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(publish, range(8)) if k is not None]
    assert len(won) == 1 and m.load() == {"s": [str(won[0])]} and m.version() == 1
    # a writer that comes second works on what the first has left
    store = Published(spark, str(tmp_path / "t"), options=Options(retries=6, first_wait=0.01))
    t = table(spark, people(spark), ByValue("region"), store)
    with ThreadPoolExecutor(3) as pool:
        assert sum(pool.map(lambda _: store.write(people(spark), t.spec), range(3))) == 15
    assert t.count() == 15


def test_recovery_removes_what_was_staged(spark, tmp_path):
    log = SharedLog(spark, str(tmp_path / "log"))
    assert log.read() == []
    c = Coordinator(spark, str(tmp_path / "c"), log)
    people(spark).write.parquet(str(tmp_path / "c" / "EU" / "XS-1-0"))
    log.append(id="XS-1", state="prepared", shards=["EU", "US"], base=0)
    log.append(id="XS-2", state="committed", shards=["EU"], base=0)
    assert c.recover() == 1 and not (tmp_path / "c" / "EU" / "XS-1-0").exists()
    assert log.read()[-1]["state"] == "rolled_back" and c.recover() == 0


def test_scopes_hold_for_reads_and_writes(spark, tmp_path):
    t = table(spark, people(spark), ByValue("region"), Directories(str(tmp_path / "t")))
    t.source.write(people(spark), t.spec)
    mine = replace(t, session=t.session.scoped(region="EU"))
    assert ids(mine.df()) == [0, 1] and ids(mine.where_eq(region="US").df()) == [] and ids(mine.where(F.col("id") > 0).df()) == [1]
    assert "shard" in mine.df()._jdf.queryExecution().executedPlan().toString() and t.count() == 5
    mine.session.refuse_others(people(spark).where("region = 'EU'"))
    with pytest.raises(StratumError):
        mine.session.refuse_others(people(spark))
    other = table(spark, people(spark).select("id"), ByHash("id", 2), Directories(str(tmp_path / "u")), "u")
    other.source.write(people(spark), other.spec)
    assert replace(other, session=mine.session).count() == 5  # a table without the column


def test_hints_of_two_levels_and_databases_without_shards(spark, tmp_path):
    s = Composite((ByValue("region", shard_column="s_region"), ByHash("id", 2, shard_column="s_hash")))
    t = table(spark, people(spark), s, Directories(str(tmp_path / "t")))
    t.source.write(people(spark), t.spec)
    assert ids(t.shard_hint("EU").df()) == [0, 1] and ids(t.shard_hint("EU/1").df()) == [1] and ids(t.shard_hint("XX").df()) == []
    assert jdbc.scan(spark, t.spec, []).count() == 0
    shards = [ShardSpec("a", key_value="EU"), ShardSpec("b", key_value="US")]
    with pytest.raises(Exception, match="(?i)url|driver|jdbc"):
        jdbc.scan(spark, t.spec, shards, Known({"region": "EU"}, {})).count()
