"""Catalog, routing and pruning, temporal rules, versioned writes."""

import json
from datetime import date
from datetime import datetime as D
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.catalog import Catalog, Containment, DateRange, KeyRange, RelationSpec, ShardSpec, StorageMode, TableSpec, TemporalSpec, Tier
from stratum.errors import MetadataError, ReadOnlyShard, RoutingError, ShardNotFound, StratumError, TemporalError, VersionConflict
from stratum.functions.columns import hash_bucket, hash_of, period_overlaps
from stratum.operators import relational as R
from stratum.operators import temporal as TP
from stratum.operators import versioning as V
from stratum.plans.strategies import ByAlphabet, ByDate, ByHash, ByRange, ByRows, ByValue, Known, Range, Ring, resolve, route, route_date
from stratum.plans.table import stated

VALID = TemporalSpec("valid_from", "valid_to")
CONTRACT = "id int, contract_number string, customer_name string, amount double, valid_from timestamp_ntz, valid_to timestamp_ntz"


def contracts(spark, *rows):
    return spark.createDataFrame([(k, r[0], "Customer", r[3] if len(r) > 3 else 0.0, r[1], r[2]) for k, r in enumerate(rows)], CONTRACT)


def numbers(df):
    return sorted(r["contract_number"] for r in df.collect())


def test_date_ranges_are_half_open():
    q = DateRange(D(2024, 1, 1), D(2024, 4, 1))
    assert q.contains(D(2024, 1, 1)) and not q.contains(D(2024, 4, 1)) and not q.contains(D(2023, 12, 31))
    assert not q.intersects(DateRange(D(2024, 4, 1), D(2024, 5, 1)))
    assert q.intersection(DateRange(D(2024, 3, 1), D(2024, 9, 1))) == DateRange(D(2024, 3, 1), D(2024, 4, 1))
    assert KeyRange(1, 5).contains(5)
    with pytest.raises(MetadataError):
        DateRange(D(2024, 1, 1), D(2024, 1, 1))


def test_catalog_groups_shards_and_tiers(tmp_path):
    c = Catalog()
    c.add_shard("s2023", date_range=DateRange(D(2023, 1, 1), D(2024, 1, 1)), tier=Tier.ARCHIVE)
    c.add_shard("s2024", date_range=DateRange(D(2024, 1, 1), D(2025, 1, 1)), priority=1)
    c.add_group("eu", [ShardSpec("s2024")])
    assert [s.id for s in c.shards()] == ["s2024", "s2023"]
    assert c.shard("eu::s2024").qualified == "eu::s2024" and c.shard("s2024").qualified == "s2024"
    assert [s.id for s in c.in_range(DateRange(D(2023, 6, 1), D(2024, 6, 1)))] == ["s2024", "s2023"]
    assert c.for_date(D(2024, 5, 1)).id == "s2024" and [s.id for s in c.writable()] == ["s2024"] and [s.id for s in c.by_tier(Tier.ARCHIVE)] == ["s2023"]
    for bad in (lambda: c.add_shard("s2024"), lambda: c.add_group("default", []), lambda: ShardSpec("x", mode=StorageMode.DATABASES), lambda: ShardSpec("")):
        with pytest.raises(MetadataError):
            bad()
    with pytest.raises(ShardNotFound):
        c.shards("nowhere")
    (tmp_path / "s.json").write_text(json.dumps({"shards": [{"shardId": "a", "tier": "COLD", "dateRangeStart": "2020-01-01T00:00:00Z", "dateRangeEnd": "2021-01-01T00:00:00Z", "isReadOnly": True, "priority": 7}, {"shardId": "b", "tier": "odd"}]}))
    a, b = Catalog().load_shards(str(tmp_path / "s.json"))
    assert (a.tier, a.read_only, a.priority, a.date_range.start) == (Tier.COLD, True, 7, D(2020, 1, 1)) and b.tier is Tier.HOT and b.date_range is None
    with pytest.raises(FileNotFoundError):
        Catalog().load_shards(str(tmp_path / "none.json"))
    assert ShardSpec("eu").table_name("Customer") == "Customer_eu"


def test_specs_and_validation():
    s = T.StructType([T.StructField("customer_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("start", T.TimestampNTZType())])
    t = TableSpec.build("customer", s, temporal=TemporalSpec("start"))
    assert t.key == "customer_id"
    for bad in ({"key": "x"}, {"temporal": TemporalSpec("name")}, {"temporal": TemporalSpec("x")}, {"strategy": ByHash("x", 2)}):
        with pytest.raises(MetadataError):
            TableSpec.build("customer", s, **bad)
    c = Catalog()
    c.add_table(t)
    c.add_table(TableSpec("log", T.StructType([T.StructField("k", T.IntegerType())])))
    assert c.validate().ok and c.validate().warnings
    c.add_relation(RelationSpec("customer", "log", "customer_id", "k", containment=Containment.WITHIN))
    assert not c.validate().ok


def test_routing():
    shards = [ShardSpec("eu", key_value="EU"), ShardSpec("us", key_value="US", read_only=True), ShardSpec("rest")]
    assert route("eu", shards).id == "eu" and route("APAC", shards).id == "rest"
    with pytest.raises(ReadOnlyShard):
        route("US", shards)
    with pytest.raises(RoutingError):
        route(None, shards)
    with pytest.raises(RoutingError):
        route("APAC", shards[:2])
    quarters = [ShardSpec("q1", date_range=DateRange(D(2024, 1, 1), D(2024, 4, 1))), ShardSpec("q2", date_range=DateRange(D(2024, 4, 1), D(2024, 7, 1)))]
    assert route_date(D(2024, 4, 1), quarters).id == "q2"
    assert [s.id for s in resolve(quarters, at=D(2024, 2, 15))] == ["q1"]
    assert [s.id for s in resolve(shards, key_value="us")] == ["us"] and len(resolve(shards)) == 3
    assert [s.id for s in resolve(shards, hint="rest")] == ["rest"]


def test_hashes_agree_with_python(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(-5, 40)], "i long, s string")
    rows = df.select("i", "s", hash_bucket(F.col("i"), 7, T.LongType()).alias("a"), hash_bucket(F.col("s"), 7).alias("b"), Ring("s", ("x", "y")).shard(df.schema).alias("r")).collect()
    ring = Ring("s", ("x", "y")).ring()
    for r in rows:
        assert r["a"] == hash_of(r["i"], 7) and r["b"] == hash_of(r["s"], 7)
        h = hash_of(r["s"], 1 << 32)
        assert r["r"] == next((n for at, n in ring if h <= at), ring[0][1])


def test_pruning_filters(spark):
    schema = T.StructType([T.StructField("region", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    known = Known({"region": "eu", "id": 12}, {"ts": Range(D(2024, 2, 3), D(2024, 3, 1), False)}, D(2024, 5, 5))
    one = spark.range(1).select(F.lit("EU").alias("a"), F.lit(4).alias("b"), F.lit("2024-02-01").alias("c"), F.lit("2024-03-01").alias("d"))
    hit = lambda s, k=known: one.where(s.prune(k, schema)).count()
    assert hit(ByValue("region", shard_column="a")) and hit(ByHash("id", 8, shard_column="b")) and hit(ByDate("ts", shard_column="c"))
    assert not hit(ByDate("ts", shard_column="d"))  # the end is not in the range
    assert hit(ByValue("region", ("US",), shard_column="a")) == 0 and ByHash("id", 8).prune(Known({"id": None}, {}), schema) is None
    assert ByDate("ts").prune(Known({}, {}), schema) is None


LITERALS = [
    ("k long", [5, 6, None, -3], 5), ("k long", [5, 6], "5"), ("k int", [5, -1], -1), ("k string", ["5", "05"], 5), ("k string", ["5", "a"], "5"), ("k string", ["x", "X"], "x"), ("k double", [1e20, 2.5], 1e20),
    ("k double", [5.0, 0.1], 5), ("k double", [-0.0, 0.0, 1.0], 0.0), ("k float", [0.1, 2.0], 0.1), ("k long", [5, 6], 5.0), ("k timestamp_ntz", [D(2024, 1, 1, 0, 0, 0, 500_000), D(2024, 1, 1)], D(2024, 1, 1, 0, 0, 0, 500_000)),
    ("k timestamp", [D(2024, 1, 1, 0, 0, 0, 500_000), D(2024, 1, 1)], D(2024, 1, 1)), ("k date", [date(2024, 1, 1), date(2024, 1, 2)], date(2024, 1, 1)), ("k date", [date(2024, 1, 1)], D(2024, 1, 1)), ("k boolean", [True, False], True),
    ("k decimal(10,2)", [Decimal("1.50"), Decimal("2.00")], Decimal("1.5")), ("k decimal(10,2)", [Decimal("2.00")], 2), ("k timestamp_ntz", [D(2024, 1, 1), D(2024, 1, 2)], date(2024, 1, 2)),
]


@pytest.mark.parametrize("schema,values,literal", LITERALS)
def test_a_pruned_read_finds_what_a_plain_filter_finds(spark, schema, values, literal):
    df = spark.createDataFrame([(v,) for v in values], schema)
    kind = df.schema["k"].dataType
    plain = df.where(F.col("k") == F.lit(literal)).count()
    strategies = [ByHash("k", 7), ByHash("k", 2), Ring("k", ("x", "y", "z"), 4), ByValue("k")]
    if isinstance(kind, T.NumericType):
        strategies += [ByRange("k", (0, 2, 5))] + [ByRows("k", 2)] * isinstance(kind, T.IntegralType)
    if isinstance(kind, T.TimestampNTZType | T.DateType):
        strategies += [ByDate("k", "day"), ByDate("k", "month")]
    if isinstance(kind, T.StringType):
        strategies.append(ByAlphabet("k"))
    for s in strategies:
        rows = df.where("k is not null").withColumn("shard", s.shard(df.schema)).where(F.col("k") == F.lit(literal))
        keep = s.prune(Known({"k": literal}, {}), df.schema)
        assert (rows if keep is None else rows.where(keep)).count() == plain, s


def test_conditions_say_what_prunes():
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
    assert stated("id = 5 and 'EU' == region AND ts >= timestamp '2024-01-01 10:00:00' and date '2025-01-01' > ts", schema) == [("Id", "=", 5), ("region", "=", "EU"), ("ts", ">=", D(2024, 1, 1, 10)), ("ts", "<", date(2025, 1, 1))]
    assert stated("region = 'a and id = 4' and `Id` <= 7", schema) == [("region", "=", "a and id = 4"), ("Id", "<=", 7)]
    for text in ("id = 5 or region = 'x'", "not id = 5", "(id = 5)", "id between 1 and 5", "region like 'a%' and id = 1", "upper(region) = 'X'", "id = id", "5 = 5", "other = 3", "ts = timestamp 'soon'"):
        assert stated(text, schema) == [], text
    assert stated("region = 'it''s' and id + 1 = 5 and id is null", schema) == [("region", "=", "it's")]


def test_as_of_and_between(spark):
    df = contracts(spark, ("C001", D(2024, 1, 1), D(2024, 6, 30)), ("C002", D(2024, 4, 1), D(2024, 12, 31)), ("C003", D(2024, 7, 1), None))
    assert numbers(TP.valid_at(df, VALID, D(2024, 5, 15))) == ["C001", "C002"]
    assert numbers(TP.valid_at(df, VALID, D(2024, 8, 15))) == ["C002", "C003"]
    assert numbers(TP.valid_at(df, VALID, D(2024, 7, 1))) == ["C002", "C003"] and numbers(TP.valid_at(df, VALID, D(2024, 12, 31))) == ["C003"]
    b = contracts(spark, ("C001", D(2024, 1, 1), D(2024, 3, 31)), ("C002", D(2024, 4, 1), D(2024, 6, 30)), ("C003", D(2024, 7, 1), D(2024, 9, 30)), ("C004", D(2024, 10, 1), None))
    assert numbers(TP.valid_between(b, VALID, D(2024, 4, 1), D(2024, 6, 30))) == ["C002"]
    assert numbers(TP.valid_between(b, VALID, D(2024, 3, 31), D(2024, 4, 1))) == ["C001", "C002"]
    assert TP.valid_at(b, None, D(2024, 1, 1)).count() == 4
    assert numbers(TP.valid_at(b, TemporalSpec("valid_from"), D(2024, 4, 1))) == ["C001", "C002"]
    sentinel = contracts(spark, ("C1", D(2024, 1, 1), D(9999, 12, 31)))
    assert numbers(TP.valid_at(sentinel, TemporalSpec("valid_from", "valid_to", D(9999, 12, 31)), D(9999, 12, 31))) == ["C1"]


@pytest.mark.parametrize("s1,e1,s2,e2,expected", [("01-01", "06-30", "03-01", "09-30", True), ("01-01", "06-30", "07-01", "12-31", False), ("01-01", "12-31", "06-01", "06-30", True), ("01-01", None, "06-01", "12-31", True), ("01-01", "06-30", "07-01", None, False)])
def test_period_overlap(spark, s1, e1, s2, e2, expected):
    day = lambda x: F.lit(None if x is None else f"2024-{x}").cast("timestamp_ntz")
    assert spark.range(1).select(period_overlaps(day(s1), day(e1), day(s2), day(e2)).alias("x")).first()["x"] is expected


def test_versions(spark):
    df = contracts(spark, ("C-VERSION", D(2024, 1, 1), None, 1000.0))
    change = spark.createDataFrame([("C-VERSION", D(2024, 7, 1), 1500.0, "Updated Customer")], "contract_number string, at timestamp_ntz, amount double, customer_name string")
    out = V.create_versions(df, TemporalSpec("valid_from", "valid_to", close_offset_us=1), "contract_number", change, "at", ("id", F.col("id") + 100)).orderBy("valid_from").collect()
    assert [r["amount"] for r in out] == [1000, 1500] and out[0]["valid_to"] == D(2024, 6, 30, 23, 59, 59, 999999) and out[1]["valid_to"] is None and out[1]["customer_name"] == "Updated Customer"
    half_open = V.create_versions(df, VALID, "contract_number", change, "at").where("valid_to is not null").first()
    assert half_open["valid_to"] == D(2024, 7, 1)
    early = change.withColumn("at", F.lit(D(2024, 1, 1)).cast("timestamp_ntz"))
    with pytest.raises(VersionConflict):
        V.create_versions(df, VALID, "contract_number", early, "at")
    ended = V.terminate(df, VALID, "contract_number", early.select("contract_number", "at"), "at").first()
    assert ended["valid_to"] == D(2024, 1, 1)
    with pytest.raises(TemporalError):
        V.terminate(df, TemporalSpec("valid_from"), "contract_number", early, "at")
    with pytest.raises(VersionConflict):
        V.terminate(df, VALID, "contract_number", early.withColumn("at", F.lit(D(2023, 1, 1)).cast("timestamp_ntz")), "at")
    added = V.add(df.drop("valid_from", "valid_to"), VALID, F.lit(D(2024, 5, 1))).first()
    assert added["valid_from"] == D(2024, 5, 1) and added["valid_to"] is None


def test_bulk_transforms(spark):
    df = spark.createDataFrame([(1, "EU", "old"), (2, "EU", "old"), (3, "US", None), (4, "APAC", "old")], "id int, region string, name string")
    assert V.update_where(df, F.col("name") == "old", {"name": F.lit("new")}).where("name = 'new'").count() == 3
    assert [r["id"] for r in V.delete_where(df, F.col("name") == "old").collect()] == [3]
    new = spark.createDataFrame([(4, "US", "x"), (9, "EU", "y")], df.schema)
    assert sorted(r["id"] for r in V.upsert(df, new, "id").collect()) == [1, 2, 3, 4, 9]


def test_pages_after_a_row(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(30)], "a int, b int").repartition(3)
    want, got, last = sorted(((r["a"], r["b"]) for r in df.collect()), key=lambda r: (-r[0], r[1])), [], None
    while page := [tuple(r) for r in R.page_after(df, [("a", False), ("b", True)], last, 7).collect()]:
        got, last = [*got, *page], page[-1]
    assert got == want


def test_pages_and_single(spark):
    df = spark.range(25)
    assert [r["id"] for r in R.page(df, [F.desc("id")], 2, 10).collect()] == list(range(14, 4, -1))
    rows = R.page_with_total(df, [F.asc("id")], 3, 10).collect()
    assert len(rows) == 5 and rows[0]["total_count"] == 25 and rows[0]["total_pages"] == 3
    assert R.single(df.where("id = 3"))["id"] == 3 and R.first_or_none(df.where("id < 0")) is None
    for bad in (df.where("id < 0"), df):
        with pytest.raises(StratumError):
            R.single(bad)
    assert R.any_row(df, F.col("id") > 20) and not R.all_rows(df, F.col("id") > 20) and R.all_rows(df, F.col("id") >= 0)
