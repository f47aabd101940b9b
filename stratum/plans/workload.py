"""Registered queries of the sharded and temporal engine, with their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import Containment, TemporalSpec
from ..functions.columns import bucket_start, first_letter, hash_bucket, rank_of
from ..operators import relational as R
from ..operators import temporal as T
from ..operators import versioning as V
from ..sources.workspace import load, order_versions, published, sharded
from .strategies import ByAlphabet, ByDate, ByHash, ByRange, ByRows, ByValue, Composite, Ring

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

VALID = TemporalSpec("valid_from", "valid_to")
POINT, LATER = datetime(1997, 6, 1), datetime(1999, 3, 15)
#: Versions of a customer's contract, as in order_versions().
VERSIONS = """v AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, o_totalprice AS amount, o_orderstatus,
     lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""
AT = "valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01')"
AT2 = "valid_from <= TIMESTAMP '1999-03-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-03-15')"
CUSTOMERS = "cr AS (SELECT c.*, r_name AS region FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def query(sql: str | None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def money(c):
    return F.round(F.sum(c), 2)


def mean(c):
    return F.round(F.avg(c), 6)


def rows():
    return F.count("*")



def regional(spark, d):
    """Customers with their region."""
    return load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", F.col("r_name").alias("region"))


def events(spark, d):
    e = load(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- temporal reads


def year_sharded(spark, d):
    return sharded(spark, d, "contract", order_versions(spark, d), ByDate("valid_from", "year", "valid_from"), VALID)


@query(f"WITH {VERSIONS} SELECT * FROM v WHERE {AT}")
def temporal_valid_at(spark, d):
    return year_sharded(spark, d).valid_at(POINT).df()


@query(f"WITH {VERSIONS} SELECT * FROM v WHERE valid_from <= TIMESTAMP '1997-06-30' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1997-06-01')")
def temporal_valid_between(spark, d):
    return year_sharded(spark, d).valid_between(POINT, datetime(1997, 6, 30)).df()


@query(f"WITH {VERSIONS} SELECT * FROM v")
def temporal_all_versions(spark, d):
    return year_sharded(spark, d).all_versions().df()


@query(f"WITH {VERSIONS} SELECT * FROM v WHERE {AT}")
def temporal_session_point(spark, d):
    t = year_sharded(spark, d)
    t.session.at(POINT)
    return t.df()


@query(f"WITH {VERSIONS} SELECT * FROM v WHERE o_custkey = 7")
def temporal_history_of_key(spark, d):
    return T.history(year_sharded(spark, d).all_versions().df(), VALID, o_custkey=7)


@query(f"""WITH {VERSIONS}, a AS (SELECT o_custkey, o_orderkey, amount FROM v WHERE {AT}), b AS (SELECT o_custkey, o_orderkey, amount FROM v WHERE {AT2})
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_orderkey AS o_orderkey_1, a.amount AS amount_1, b.o_orderkey AS o_orderkey_2, b.amount AS amount_2,
       a.o_orderkey IS DISTINCT FROM b.o_orderkey OR a.amount IS DISTINCT FROM b.amount AS has_changes FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def temporal_compare(spark, d):
    return T.compare(order_versions(spark, d), VALID, "o_custkey", POINT, LATER, ["o_orderkey", "amount"])


@query(f"WITH {VERSIONS} SELECT count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean FROM v WHERE {AT}")
def temporal_agg(spark, d):
    return year_sharded(spark, d).valid_at(POINT).df().agg(rows().alias("n"), money("amount").alias("total"), mean("amount").alias("mean"))


@query(f"WITH {VERSIONS} SELECT c_mktsegment, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean FROM v JOIN customer ON o_custkey = c_custkey WHERE {AT} GROUP BY c_mktsegment ORDER BY c_mktsegment")
def temporal_join_segments(spark, d):
    v = T.valid_at(order_versions(spark, d), VALID, POINT)
    return v.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(rows().alias("n"), money("amount").alias("total"), mean("amount").alias("mean")).orderBy("c_mktsegment")


SUPPLY = """s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS valid_to FROM lineitem)"""


def supply_versions(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("valid_from"))
    return T.versions_of(li, "l_suppkey", "valid_from", "valid_to", "l_orderkey", "l_linenumber")


@query(f"""WITH {VERSIONS}, l AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-06-01' GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey, amount, lines, quantity FROM v JOIN l ON o_orderkey = l_orderkey WHERE {AT}""")
def temporal_join(spark, d):
    lines = load(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    shipped = T.valid_at(lines, TemporalSpec("l_shipdate"), POINT).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows().alias("lines"), money("l_quantity").alias("quantity"))
    return T.temporal_join(order_versions(spark, d), VALID, shipped, None, "o_orderkey", POINT).select("o_custkey", "o_orderkey", "amount", "lines", "quantity")


CONTRACT = "p AS (SELECT o_custkey, min(o_orderdate) AS valid_from, max(o_orderdate) + INTERVAL 30 DAY AS valid_to FROM orders GROUP BY o_custkey)"


@query(f"""WITH {VERSIONS}, {CONTRACT} SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.o_custkey = v.o_custkey AND p.valid_from <= v.valid_from AND (p.valid_to IS NULL OR (v.valid_to IS NOT NULL AND v.valid_to <= p.valid_to)))""")
def temporal_containment(spark, d):
    v = order_versions(spark, d)
    p = v.groupBy("o_custkey").agg(F.min("valid_from").alias("valid_from"), (F.max("valid_from") + F.expr("INTERVAL 30 DAYS")).alias("valid_to"))
    return T.containment_violations(v, VALID, "o_custkey", p, VALID, "o_custkey", Containment.WITHIN)


LONG = "w AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, o_orderdate + INTERVAL 60 DAY AS valid_to FROM orders)"


@query(f"""WITH {LONG} SELECT a.o_custkey, a.o_orderkey AS first_id, b.o_orderkey AS second_id FROM w a JOIN w b ON a.o_custkey = b.o_custkey
AND (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.o_orderkey < b.o_orderkey)) AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to""")
def temporal_overlap(spark, d):
    w = order_versions(spark, d).withColumn("valid_to", F.col("valid_from") + F.expr("INTERVAL 60 DAYS"))
    return T.overlaps(w, VALID, "o_custkey", "o_orderkey")


@query("""SELECT e.event_id, e.user_id, e.ts, p.ts AS matched_ts, p.value AS matched_value FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def temporal_asof_join(spark, d):
    e = events(spark, d)
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return T.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "ts", ["value"])


# ---- versioned writes

CHANGES = "ch AS (SELECT c_custkey AS o_custkey, TIMESTAMP '2002-01-01' AS effective, round(c_acctbal, 2) AS amount FROM customer WHERE c_mktsegment = 'BUILDING')"


def changes(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return c.select(F.col("c_custkey").alias("o_custkey"), F.lit(datetime(2002, 1, 1)).cast("timestamp_ntz").alias("effective"), F.round("c_acctbal", 2).alias("amount"))


@query(f"""WITH {VERSIONS}, {CHANGES} SELECT o_orderkey, v.o_custkey, valid_from, v.amount, o_orderstatus, CASE WHEN valid_to IS NULL AND ch.o_custkey IS NOT NULL THEN effective ELSE valid_to END AS valid_to FROM v LEFT JOIN ch ON v.o_custkey = ch.o_custkey
UNION ALL SELECT -o_orderkey - 1, v.o_custkey, effective, ch.amount, o_orderstatus, NULL FROM v JOIN ch ON v.o_custkey = ch.o_custkey WHERE valid_to IS NULL""")
def version_create(spark, d):
    return V.create_versions(order_versions(spark, d), VALID, "o_custkey", changes(spark, d), "effective", ("o_orderkey", -F.col("o_orderkey") - 1), check="inline")


@query(f"""WITH {VERSIONS}, {CHANGES} SELECT o_orderkey, v.o_custkey, valid_from, v.amount, o_orderstatus, CASE WHEN valid_to IS NULL AND ch.o_custkey IS NOT NULL THEN effective - INTERVAL 1 MICROSECOND ELSE valid_to END AS valid_to FROM v LEFT JOIN ch ON v.o_custkey = ch.o_custkey
UNION ALL SELECT -o_orderkey - 1, v.o_custkey, effective, ch.amount, o_orderstatus, NULL FROM v JOIN ch ON v.o_custkey = ch.o_custkey WHERE valid_to IS NULL""")
def version_create_with_gap(spark, d):
    t = TemporalSpec("valid_from", "valid_to", close_offset_us=1)
    return V.create_versions(order_versions(spark, d), t, "o_custkey", changes(spark, d), "effective", ("o_orderkey", -F.col("o_orderkey") - 1))


@query(f"""WITH {VERSIONS}, {CHANGES} SELECT o_orderkey, v.o_custkey, valid_from, v.amount, o_orderstatus, CASE WHEN valid_to IS NULL AND ch.o_custkey IS NOT NULL THEN effective ELSE valid_to END AS valid_to FROM v LEFT JOIN ch ON v.o_custkey = ch.o_custkey""")
def version_terminate(spark, d):
    return V.terminate(order_versions(spark, d), VALID, "o_custkey", changes(spark, d).drop("amount"), "effective")


@query("SELECT c_custkey, c_mktsegment, TIMESTAMP '2002-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM customer")
def version_add(spark, d):
    return V.add(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), VALID, F.lit(datetime(2002, 1, 1)))


ACCOUNTS = "a AS (SELECT c_custkey, region, TIMESTAMP '1995-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM cr)"


@query(f"""WITH {CUSTOMERS}, {ACCOUNTS} SELECT c_custkey, region, valid_from, CASE WHEN region = 'ASIA' THEN TIMESTAMP '2000-01-01' ELSE valid_to END AS valid_to FROM a
UNION ALL SELECT c_custkey, 'EUROPE', TIMESTAMP '2000-01-01', NULL FROM a WHERE region = 'ASIA'""")
def version_transfer(spark, d):
    a = V.add(regional(spark, d).select("c_custkey", "region"), VALID, F.lit(datetime(1995, 1, 1)))
    moves = a.where("region = 'ASIA'").select("c_custkey", F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz").alias("effective"), F.lit("EUROPE").alias("region"))
    return V.transfer(a, VALID, "c_custkey", moves, "effective", "region")


# ---- shards


@query(f"WITH {CUSTOMERS} SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, region FROM cr WHERE region = 'EUROPE'")
def shard_property_prune(spark, d):
    return sharded(spark, d, "customer_region", regional(spark, d), ByValue("region")).where_eq(region="europe").df()


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01'")
def shard_date_prune(spark, d):
    return orders_by_month(spark, d).where_range("o_orderdate", datetime(1998, 3, 1), datetime(1998, 4, 1), closed=False).df()


def orders_by_month(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return sharded(spark, d, "orders_month", o, ByDate("o_orderdate", "month"))


def events_by_hash(spark, d):
    return sharded(spark, d, "events_hash", events(spark, d), ByHash("user_id", 8))


@query("SELECT * FROM events WHERE user_id = 46")
def shard_hash_prune(spark, d):
    return events_by_hash(spark, d).where_eq(user_id=46).df()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def shard_range_prune(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sharded(spark, d, "orders_range", o, ByRange("o_totalprice", (50_000.0, 100_000.0, 200_000.0))).where_range("o_totalprice", 100_000.0, 150_000.0).df()


@query("SELECT upper(substr(p_name, 1, 1)) AS letter, count(*) AS n FROM part WHERE upper(substr(p_name, 1, 1)) BETWEEN 'A' AND 'M' GROUP BY 1")
def shard_alphabet(spark, d):
    t = sharded(spark, d, "part_alphabet", load(spark, d, "part").select("p_partkey", "p_name"), ByAlphabet("p_name"))
    return t.shard_hint("A-F").df().unionByName(t.shard_hint("G-L").df()).unionByName(t.shard_hint("M-R").where("p_name < 'n' and p_name >= 'M'").df()).where(first_letter(F.col("p_name")).between("A", "M")).groupBy(first_letter(F.col("p_name")).alias("letter")).agg(rows().alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey // 500 = 1")
def shard_maxrows(spark, d):
    return sharded(spark, d, "customer_rows", load(spark, d, "customer").select("c_custkey", "c_name"), ByRows("c_custkey", 500)).shard_hint("1").df()


@query(f"WITH {CUSTOMERS} SELECT c_custkey, c_mktsegment, region FROM cr WHERE region = 'ASIA' AND c_custkey % 4 = 1")
def shard_composite(spark, d):
    s = Composite((ByValue("region", shard_column="s_region"), ByHash("c_custkey", 4, shard_column="s_hash")))
    c = regional(spark, d).select("c_custkey", "c_mktsegment", "region")
    return sharded(spark, d, "customer_composite", c, s).shard_hint("ASIA/1").df()


@query("SELECT o_orderkey, o_orderstatus, 'open' AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderstatus, 'done' FROM orders WHERE o_orderstatus = 'F'")
def shard_manual(spark, d):
    from ..catalog import TableSpec
    from ..sources.layouts import Mapped
    from .strategies import Known

    path = f"{d}/orders.parquet"
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    spec = TableSpec("orders_manual", o.schema)
    part = lambda status: Mapped(((path, f"o_orderstatus = '{status}'"),)).scan(spark, spec, Known({}, {}))
    return part("O").drop("shard").withColumn("part", F.lit("open")).unionByName(part("F").drop("shard").withColumn("part", F.lit("done")))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id % 8 = 3 GROUP BY user_id")
def shard_hint(spark, d):
    return events_by_hash(spark, d).shard_hint("3").df().groupBy("user_id").agg(rows().alias("n"))


@query("SELECT CASE WHEN year(o_orderdate) >= 1999 THEN 'hot' ELSE 'warm' END AS tier, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1")
def shard_tier_filter(spark, d):
    """Orders of the years whose shards are hot or warm, by tier."""
    from ..catalog import Catalog, DateRange, Tier

    c, tiers = Catalog(), {y: Tier.HOT if y >= 1999 else Tier.WARM if y >= 1997 else Tier.ARCHIVE for y in range(1995, 2002)}
    for k, (y, tier) in enumerate(tiers.items(), 1):
        c.add_shard(f"{y}-01-01", tier=tier, priority=k, date_range=DateRange(datetime(y, 1, 1), datetime(y + 1, 1, 1)))
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    t = sharded(spark, d, "orders_year", o, ByDate("o_orderdate", "year"))
    parts = [t.shard_hint(s.id).df().withColumn("tier", F.lit(name)) for name, kind in (("hot", Tier.HOT), ("warm", Tier.WARM)) for s in c.by_tier(kind)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("tier").agg(rows().alias("n"))


@query("WITH b AS (SELECT user_id % 8 AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket::INTEGER AS bucket, n, round((SELECT stddev_pop(n) FROM b), 6) AS deviation FROM b")
def shard_distribution(spark, d):
    e = load(spark, d, "events")
    return R.distribution(e, hash_bucket(F.col("user_id"), 8, e.schema["user_id"].dataType)).withColumn("deviation", F.round("deviation", 6))


@query("SELECT (('0x' || substr(md5(c_name), 1, 8))::BIGINT % 6)::INTEGER AS bucket, count(*) AS n FROM customer GROUP BY 1")
def shard_hash_text(spark, d):
    return load(spark, d, "customer").groupBy(hash_bucket(F.col("c_name"), 6).alias("bucket")).agg(rows().alias("n"))


@query("""WITH p AS (SELECT 'n' || n AS node, ('0x' || substr(md5('n' || n || '#' || i), 1, 8))::BIGINT AS point FROM range(1, 4) a(n), range(16) b(i)),
c AS (SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT AS h FROM customer)
SELECT coalesce((SELECT arg_min(node, point) FROM p WHERE point >= h), (SELECT arg_min(node, point) FROM p)) AS node, count(*) AS n FROM c GROUP BY 1""")
def shard_ring(spark, d):
    """Customers by node of a consistent-hash ring."""
    c = load(spark, d, "customer")
    return c.groupBy(Ring("c_name", ("n1", "n2", "n3")).shard(c.schema).alias("node")).agg(rows().alias("n"))


@query("SELECT count(*) AS n FROM events")
def fanout_count(spark, d):
    return events_by_hash(spark, d).df().agg(rows().alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def fanout_groupby(spark, d):
    return events_by_hash(spark, d).df().groupBy("event_type").agg(rows().alias("n"), money("value").alias("total"))


# ---- filters, order, pages


@query("SELECT * FROM orders WHERE o_orderkey = 4242")
def point_lookup(spark, d):
    return load(spark, d, "orders").where(F.col("o_orderkey") == 4242)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def range_scan_topk(spark, d):
    o = load(spark, d, "orders")
    return o.where(F.col("o_orderdate").between(datetime(1996, 1, 1), datetime(1996, 12, 31))).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 10 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'O'")
def compound_filter(spark, d):
    return load(spark, d, "orders").where((F.col("o_custkey") == 10) & (F.col("o_orderdate") >= datetime(1996, 1, 1)) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, upper(p_name) AS shouted, p_brand || '/' || substr(p_type, 1, 4) AS tag FROM part WHERE contains(p_name, 'ring') AND starts_with(p_type, 'E') OR ends_with(p_name, 'bolt') OR lower(p_type) = 'promo'")
def string_search(spark, d):
    p = load(spark, d, "part")
    hit = F.col("p_name").contains("ring") & F.col("p_type").startswith("E") | F.col("p_name").endswith("bolt") | (F.lower("p_type") == F.lower(F.lit("PROMO")))
    return p.where(hit).select("p_partkey", "p_name", F.upper("p_name").alias("shouted"), F.concat("p_brand", F.lit("/"), F.substring("p_type", 1, 4)).alias("tag"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND o_orderstatus IN ('O', 'P')")
def in_list_semi(spark, d):
    rich = load(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"WITH {VERSIONS} SELECT count(*) FILTER (valid_to IS NULL) AS open, count(*) FILTER (valid_to IS NOT NULL) AS closed, bool_or(amount > 400000) AS any_large, bool_and(amount > 0) AS all_positive FROM v")
def null_tests_and_quantifiers(spark, d):
    v = order_versions(spark, d)
    return v.agg(F.count_if(F.col("valid_to").isNull()).alias("open"), F.count_if(F.col("valid_to").isNotNull()).alias("closed"), F.bool_or(F.col("amount") > 400000).alias("any_large"), F.bool_and(F.col("amount") > 0).alias("all_positive"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def case_rank_paging(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.page(o, [rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25)


@query("SELECT event_id, ts, value, count(*) OVER () AS total_count, ceil(count(*) OVER () / 30)::BIGINT AS total_pages FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 30 OFFSET 30")
def page_with_total(spark, d):
    e = events(spark, d).where("event_type = 'purchase'").select("event_id", "ts", "value")
    return R.page_with_total(e, [F.desc("ts"), F.asc("event_id")], 2, 30)


@query("SELECT event_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id > 100) ORDER BY ts DESC, event_id LIMIT 30")
def keyset_page(spark, d):
    """The page after the row of a moment and an id."""
    e = events(spark, d).select("event_id", "ts", "value")
    return R.page_after(e, [("ts", False), ("event_id", True)], (datetime(2024, 1, 15), 100), 30)


@query("SELECT DISTINCT event_type FROM events ORDER BY event_type")
def distinct_sorted(spark, d):
    return load(spark, d, "events").select("event_type").distinct().orderBy("event_type")


@query("SELECT event_id FROM events ORDER BY user_id, ts DESC, event_id LIMIT 40")
def order_mixed(spark, d):
    return events(spark, d).orderBy("user_id", F.desc("ts"), "event_id").limit(40).select("event_id")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS class, coalesce(n_name, 'none') AS nation, sha256(c_name) AS name_hash FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def projection_dto(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    kind = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "normal").otherwise("rich")
    return c.select("c_custkey", kind.alias("class"), F.coalesce("n_name", F.lit("none")).alias("nation"), F.sha2("c_name", 256).alias("name_hash"))


@query("""SELECT event_id, abs(value - 10) AS distance, round(sqrt(value * value + 1), 6) AS root, ceil(value)::BIGINT AS up, (event_id % 7)::BIGINT AS rest, year(ts)::INTEGER AS y, month(ts)::INTEGER AS m, day(ts)::INTEGER AS d, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi,
ts + INTERVAL 30 DAY AS due, printf('txn-%04d-%02d', year(ts), month(ts)) AS label FROM events""")
def scalar_functions(spark, d):
    v, ts = F.col("value"), F.col("ts")
    return events(spark, d).select("event_id", F.abs(v - 10).alias("distance"), F.round(F.sqrt(v * v + 1), 6).alias("root"), F.ceil(v).alias("up"), F.pmod(F.col("event_id"), F.lit(7)).cast("long").alias("rest"), F.year(ts).alias("y"), F.month(ts).alias("m"), F.day(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), (ts + F.expr("INTERVAL 30 DAYS")).alias("due"), F.format_string("txn-%04d-%02d", F.year(ts), F.month(ts)).alias("label"))


# ---- joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def inner_join(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return load(spark, d, "orders").where("o_totalprice > 200000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_acctbal > 9500")
def three_way_join(spark, d):
    return load(spark, d, "customer").where("c_acctbal > 9500").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_agg(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(rows().alias("n"), money("o_totalprice").alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    """Customers without a large order."""
    return load(spark, d, "customer").join(load(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def include_children(spark, d):
    c = R.include(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders"), "c_custkey", "o_custkey", "orders", ["o_orderkey", "o_totalprice"])
    return c.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("keys"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(sum(lines), 0)::BIGINT AS n_lines FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def include_nested(spark, d):
    o = R.include(load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "lines", ["l_linenumber", "l_partkey", "l_quantity"])
    c = R.include(load(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_custkey", "orders", ["o_orderkey", "lines"])
    total = F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + F.size(x["lines"]))
    return c.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), total.alias("n_lines"))


@query("SELECT c_custkey, count(o_orderkey) AS n_large FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey GROUP BY c_custkey")
def filtered_include(spark, d):
    c = R.include(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey", "large", ["o_orderkey"])
    return c.select("c_custkey", F.size("large").cast("long").alias("n_large"))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY n_name, s_suppkey")
def deep_navigation(spark, d):
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.where("r_name = 'ASIA'").select("s_suppkey", "s_name", "n_name", "r_name").orderBy("n_name", "s_suppkey")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def last_ten_activities(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 10").select("user_id", "event_id", "ts")


# ---- aggregates


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2) AS returned_total FROM lineitem")
def conditional_agg(spark, d):
    r = F.col("l_returnflag") == "R"
    return load(spark, d, "lineitem").agg(rows().alias("n"), money("l_extendedprice").alias("total"), F.count_if(r).alias("returned"), F.round(F.coalesce(F.sum(F.when(r, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("returned_total"))


@query(f"WITH {CUSTOMERS} SELECT region, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM cr JOIN orders ON c_custkey = o_custkey GROUP BY region")
def region_totals(spark, d):
    return load(spark, d, "orders").join(regional(spark, d), F.col("o_custkey") == F.col("c_custkey")).groupBy("region").agg(rows().alias("n"), money("o_totalprice").alias("total"), mean("o_totalprice").alias("mean"))


@query("SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_count_by_day(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(rows().alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def month_rollup(spark, d):
    return load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(rows().alias("n"), money("o_totalprice").alias("total"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def time_bucket(spark, d):
    return events(spark, d).groupBy(bucket_start("hour", F.col("ts")).alias("bucket"), "event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), mean("value").alias("mean"), money("value").alias("total"), rows().alias("n"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id, event_type")
def latest_per_key(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1")
def mode_per_group(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(rows().alias("n"))
    best = c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "event_type")).alias("b"))
    return best.select("user_id", "b.event_type", (-F.col("b.k")).alias("n"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, sum(n)::BIGINT AS n, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS by_type FROM c GROUP BY user_id")
def nested_group(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(rows().alias("n"))
    kinds = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    return c.groupBy("user_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(kinds, lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ";").alias("by_type"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)")
def grand_total_rollup(spark, d):
    return load(spark, d, "orders").rollup("o_orderstatus").agg(rows().alias("n"), money("o_totalprice").alias("total"))


@query("SELECT round(sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice END), 2) AS before, round(sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' THEN o_totalprice END), 2) AS after FROM orders")
def period_compare(spark, d):
    at, v = F.col("o_orderdate"), F.col("o_totalprice")
    span = lambda y: money(F.when((at >= datetime(y, 1, 1)) & (at < datetime(y + 1, 1, 1)), v))
    return load(spark, d, "orders").agg(span(1997).alias("before"), span(1998).alias("after"))


@query("""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN -value ELSE value END AS amount FROM events),
b AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS balance FROM t)
SELECT user_id, round(arg_min(balance - amount, (ts, event_id)), 2) + 0 AS opening, round(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END), 2) AS credits, round(abs(sum(CASE WHEN amount < 0 THEN amount ELSE 0 END)), 2) AS debits FROM b GROUP BY user_id""")
def account_statement(spark, d):
    t = events(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("amount"))
    a = F.col("amount")
    b = t.withColumn("balance", F.sum("amount").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("user_id").agg((F.round(F.min_by(F.col("balance") - a, F.struct("ts", "event_id")), 2) + 0).alias("opening"), F.round(F.sum(F.when(a > 0, a).otherwise(0.0)), 2).alias("credits"), F.round(F.abs(F.sum(F.when(a < 0, a).otherwise(0.0))), 2).alias("debits"))


@query("SELECT max(n) FILTER (o_orderstatus = 'F') AS f, max(n) FILTER (o_orderstatus = 'O') AS o, max(n) FILTER (o_orderstatus = 'P') AS p FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def status_dictionary(spark, d):
    m = load(spark, d, "orders").groupBy("o_orderstatus").agg(rows().alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select(*[F.col("m")[s].alias(s.lower()) for s in "FOP"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") <= datetime(1998, 9, 2))
    return li.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), rows().alias("n"))


# ---- bulk writes


@query("SELECT user_id % 8 AS shard, count(*) AS n, count(DISTINCT user_id) AS users, (SELECT count(*) FROM events) AS inserted FROM events GROUP BY 1")
def bulk_insert(spark, d):
    """Events inserted into hash shards in one version, and what the insert says that it wrote."""
    from ..sources.layouts import bulk_insert as insert

    t = published(spark, "events_bulk", events(spark, d), ByHash("user_id", 8))
    n = insert(events(spark, d), t.spec, t.source)
    return t.df().groupBy(F.pmod("user_id", F.lit(8)).cast("long").alias("shard")).agg(rows().alias("n"), F.countDistinct("user_id").alias("users")).withColumn("inserted", F.lit(n).cast("long"))


@query("SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'error' THEN value * 2 ELSE value END AS value, props FROM events")
def bulk_update(spark, d):
    return V.update_where(events(spark, d), F.col("event_type") == "error", {"value": F.col("value") * 2})


@query("SELECT * FROM events WHERE event_type <> 'view'")
def bulk_delete(spark, d):
    return V.delete_where(events(spark, d), F.col("event_type") == "view")


@query("""WITH n AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey < 5)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""")
def upsert(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    tenth = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return V.upsert(c, tenth.union(c.where("c_custkey < 5").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)), "c_custkey")


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' AND user_id < 20 THEN value * 2 ELSE value END AS value, (SELECT count(*) FROM events WHERE event_type = 'error' AND user_id < 20) AS changed FROM events")
def bulk_update_shards(spark, d):
    """Only the shards that hold such rows are rewritten, all in one version."""
    e = events(spark, d).select("event_id", "user_id", "event_type", "value")
    t = published(spark, "events_update", e, ByHash("user_id", 8))
    t.source.write(e, t.spec)
    n = t.source.update(t.spec, (F.col("event_type") == "error") & (F.col("user_id") < 20), {"value": F.col("value") * 2})
    return t.df().withColumn("changed", F.lit(n).cast("long"))


@query("SELECT event_id, user_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'view' AND user_id % 8 IN (1, 2)) AS deleted FROM events WHERE NOT (event_type = 'view' AND user_id % 8 IN (1, 2))")
def bulk_delete_shards(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type")
    t = published(spark, "events_delete", e, ByHash("user_id", 8))
    t.source.write(e, t.spec)
    n = t.source.delete(t.spec, (F.col("event_type") == "view") & F.pmod("user_id", F.lit(8)).isin(1, 2))
    return t.df().withColumn("deleted", F.lit(n).cast("long"))


@query(f"""WITH {VERSIONS}, {CHANGES}, hit AS (SELECT v.*, effective, ch.amount AS next_amount FROM v JOIN ch ON v.o_custkey = ch.o_custkey WHERE valid_to IS NULL)
SELECT o_orderkey, v.o_custkey, valid_from, v.amount, o_orderstatus, CASE WHEN valid_to IS NULL AND ch.o_custkey IS NOT NULL THEN effective ELSE valid_to END AS valid_to, (SELECT count(*) FROM hit) AS closed FROM v LEFT JOIN ch ON v.o_custkey = ch.o_custkey
UNION ALL SELECT -o_orderkey - 1, o_custkey, effective, next_amount, o_orderstatus, NULL, (SELECT count(*) FROM hit) FROM hit""")
def version_commit(spark, d):
    """New versions land on the shard of their start; it and the shards of the closed ones change in one version."""
    v = order_versions(spark, d)
    t = published(spark, "contract_versions", v, ByDate("valid_from", "year", "valid_from"), VALID)
    t.source.write(v, t.spec)
    n = t.source.create_versions(t.spec, "o_custkey", changes(spark, d), "effective", ("o_orderkey", -F.col("o_orderkey") - 1))
    return t.all_versions().df().withColumn("closed", F.lit(n).cast("long"))


@query(f"""WITH {CUSTOMERS}, {ACCOUNTS} SELECT c_custkey, region, valid_from, CASE WHEN region = 'ASIA' THEN TIMESTAMP '2000-01-01' ELSE valid_to END AS valid_to, (SELECT count(*) FROM a WHERE region = 'ASIA') AS moved FROM a
UNION ALL SELECT c_custkey, 'EUROPE', TIMESTAMP '2000-01-01', NULL, (SELECT count(*) FROM a WHERE region = 'ASIA') FROM a WHERE region = 'ASIA'""")
def transfer_commit(spark, d):
    """Accounts closed on one region's shard and opened on another's, published together."""
    a = V.add(regional(spark, d).select("c_custkey", "region"), VALID, F.lit(datetime(1995, 1, 1)))
    t = published(spark, "accounts", a, ByValue("region"), VALID)
    t.source.write(a, t.spec)
    moves = a.where("region = 'ASIA'").select("c_custkey", F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz").alias("effective"), F.lit("EUROPE").alias("region"))
    n = t.source.transfer(t.spec, "c_custkey", moves, "effective")
    return t.all_versions().df().withColumn("moved", F.lit(n).cast("long"))


@query("""SELECT o_orderkey, count(l_linenumber) AS n_lines, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') AS inserted
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def cascade_insert(spark, d):
    """Orders with their lines, parents and children in one version of two tables."""
    o = load(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    li = load(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")
    parents = published(spark, "parents", o, ByHash("o_orderkey", 4))
    children = published(spark, "children", li, ByHash("l_orderkey", 4), beside=parents)
    n = parents.source.insert_all([(o, parents.spec), (li, children.spec)])
    lines = children.df().groupBy("l_orderkey").agg(rows().alias("n_lines"))
    return parents.df().join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.lit(n).cast("long").alias("inserted"))


@query("""SELECT c_custkey, c_name || CASE WHEN c_custkey % 7 = 0 THEN '!' ELSE '' END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS trail FROM customer""")
def version_audit_trail(spark, d):
    """Rows replaced in place, with a trail of what they were."""
    from ..sources.published import audit_trail

    c = load(spark, d, "customer").select("c_custkey", "c_name", F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    renamed = c.where("c_custkey % 7 = 0").withColumn("c_name", F.concat("c_name", F.lit("!")))
    after, trail = audit_trail(c, renamed, "c_custkey", VALID, F.lit(datetime(2000, 1, 1)), F.lit("job"))
    n = trail.groupBy("c_custkey").agg(rows().alias("trail"))
    return after.join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("trail", F.lit(0)).alias("trail"))


@query(f"WITH {VERSIONS} SELECT o_custkey, arg_max(amount, valid_from) AS amount, max(valid_from) AS valid_from FROM (SELECT o_custkey, max(amount) AS amount, valid_from FROM v GROUP BY o_custkey, valid_from) GROUP BY o_custkey")
def version_append_only(spark, d):
    """A log that is only ever added to, and its newest state of each key."""
    from ..sources.published import append_only

    v = order_versions(spark, d).groupBy("o_custkey", "valid_from").agg(F.max("amount").alias("amount"))
    early = v.where(F.col("valid_from") < POINT)
    _, newest = append_only(early, v.where(F.col("valid_from") >= POINT), VALID, "o_custkey")
    return newest.select("o_custkey", "amount", "valid_from")


# ---- scopes, conditions, graphs, sets, cubes, intervals


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def tenant_scope(spark, d):
    """Every read of the session sees one tenant; its shard is the only one that is read."""
    t = sharded(spark, d, "customer_tenant", load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), ByValue("c_mktsegment"))
    return replace(t, session=t.session.scoped(c_mktsegment="BUILDING")).where(F.col("c_acctbal") > 1000).df().select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01' AND o_totalprice > 1000.5")
def condition_prune(spark, d):
    """Shards ruled out by what a condition says, literals on either side."""
    return orders_by_month(spark, d).where("o_orderdate >= timestamp '1998-03-01' and timestamp '1998-04-01' > o_orderdate and 1000.5 < o_totalprice").df()


@query("SELECT c_custkey, c_name, p_segment, p_balance, coalesce(p_segment, 'none') AS shown FROM customer LEFT JOIN (SELECT c_custkey AS p_custkey, c_mktsegment AS p_segment, c_acctbal AS p_balance FROM customer WHERE c_acctbal > 0) ON c_custkey = p_custkey")
def one_to_one(spark, d):
    """Each customer with its profile, which there is at most one of."""
    c = load(spark, d, "customer")
    profile = c.where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("p_segment"), F.col("c_acctbal").alias("p_balance"))
    return c.select("c_custkey", "c_name").join(profile, "c_custkey", "left").withColumn("shown", F.coalesce("p_segment", F.lit("none")))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY l_orderkey)
SELECT c_custkey, c_mktsegment AS p_segment, n_name, count(o_orderkey) AS n_orders, coalesce(sum(n_lines), 0)::BIGINT AS n_lines, round(coalesce(sum(amount), 0), 2) AS amount
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN l ON o_orderkey = l_orderkey WHERE c_custkey % 3 = 0 GROUP BY 1, 2, 3""")
def object_graph(spark, d):
    """A customer with its profile (1:1), nation (N:1), orders (1:N) and their lines (1:N), as one nested row, and sums over it."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = R.include(load(spark, d, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", "l_orderkey", "lines", ["l_linenumber", "l_extendedprice"])
    c = load(spark, d, "customer").where("c_custkey % 3 = 0")
    profile = c.select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), "c_acctbal").alias("profile"))
    c = c.select("c_custkey", "c_nationkey").join(profile, "c_custkey", "left").join(load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    g = R.include(c, o, "c_custkey", "o_custkey", "orders", ["o_orderkey", "lines"])
    lines = F.flatten(F.transform("orders", lambda x: x["lines"]))
    return g.select("c_custkey", F.col("profile.segment").alias("p_segment"), "n_name", F.size("orders").cast("long").alias("n_orders"), F.size(lines).cast("long").alias("n_lines"), F.round(F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["l_extendedprice"]), 2).alias("amount"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, event_id, event_type, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
n AS (SELECT user_id, session, max(ts) AS last, count(*) AS n FROM s GROUP BY 1, 2),
a AS (SELECT user_id, count(*) AS n_sessions, count(*) FILTER (last >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS n_active FROM n GROUP BY 1),
r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT a.user_id, n_sessions, n_active, string_agg(event_type, ',' ORDER BY k) AS recent FROM a JOIN r ON r.user_id = a.user_id WHERE k <= 10 AND n_active > 0 GROUP BY 1, 2, 3""")
def user_overview(spark, d):
    """Users with an active session, how many sessions they had, and their last ten activities."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w)
    s = e.withColumn("opens", F.when(F.col("ts") <= gap + F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)).withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    now = e.agg(F.max("ts").alias("now"))
    n = s.groupBy("user_id", "session").agg(F.max("ts").alias("last")).join(F.broadcast(now))
    a = n.groupBy("user_id").agg(rows().alias("n_sessions"), F.count_if(F.col("last") >= F.col("now") - F.expr("INTERVAL 1 DAY")).alias("n_active")).where("n_active > 0")
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    ten = e.withColumn("k", F.row_number().over(back)).where("k <= 10").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "event_type"))).alias("r"))
    return a.join(ten, "user_id").select("user_id", "n_sessions", "n_active", F.array_join(F.transform("r", lambda x: x["event_type"]), ",").alias("recent"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersect(spark, d):
    e = load(spark, d, "events")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).subtract(load(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, d):
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(rows().alias("n"), money("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_set_counts(spark, d):
    o = load(spark, d, "orders")
    return o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(rows().alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 10 AND avg(value) > 0")
def percentiles_having(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), rows().alias("n"), F.avg("value").alias("mean")).where("n > 10 and mean > 0").drop("mean")


@query("""SELECT e.event_id, e.user_id, e.ts, p.ts AS matched_ts, p.event_id AS matched_event_id FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts + INTERVAL 30 MINUTE
WHERE e.event_type = 'purchase' AND p.event_type = 'click'""")
def temporal_interval_join(spark, d):
    e = events(spark, d)
    return T.interval_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("event_id", "user_id", "ts"), "user_id", "ts", "ts", "2 HOURS", "30 MINUTES", ["event_id"])


@query(f"WITH {VERSIONS} SELECT o_orderkey, valid_to IS NULL AS open, date_diff('day', valid_from, valid_to)::BIGINT AS days FROM v")
def temporal_period(spark, d):
    return T.with_period(order_versions(spark, d), VALID).select("o_orderkey", "validity.open", "validity.days")


@query(f"""WITH {VERSIONS}, q AS (SELECT o_custkey, valid_from, valid_to FROM v WHERE o_orderkey % 2 = 0) SELECT o_orderkey, v.o_custkey FROM v WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.o_custkey = v.o_custkey AND q.valid_from = v.valid_from AND q.valid_to IS NOT DISTINCT FROM v.valid_to)""")
def temporal_containment_exact(spark, d):
    v = order_versions(spark, d)
    return T.containment_violations(v, VALID, "o_custkey", v.where("o_orderkey % 2 = 0"), VALID, "o_custkey", Containment.EXACT).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, pow(o_orderkey % 10, 3)::DOUBLE AS cube, o_orderdate + INTERVAL 3 MONTH AS due, o_orderdate + INTERVAL 90 MINUTE AS later, log2(o_totalprice + 1) > 10 AS large, quarter(o_orderdate)::INTEGER AS q FROM orders")
def scalar_dates_and_powers(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return load(spark, d, "orders").select("o_orderkey", F.pow(F.col("o_orderkey") % 10, F.lit(3)).alias("cube"), (at + F.expr("INTERVAL 3 MONTHS")).alias("due"), (at + F.expr("INTERVAL 90 MINUTES")).alias("later"), (F.log2(F.col("o_totalprice") + 1) > 10).alias("large"), F.quarter(at).alias("q"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END <= 1")
def enum_at_least(spark, d):
    """A filter by the rank of an ordered enumeration."""
    return load(spark, d, "orders").where(rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]) <= 1).select("o_orderkey", "o_orderpriority")


# ---- streams


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_windows(spark, d):
    """Hourly windows that the watermark has closed, by a stream that runs until it has read all events, into an exactly-once sink."""
    from ..sources.workspace import scratch
    from ..streaming.events import append_to, read_stream, windowed

    at, path = f"{scratch(spark)}/stratum/stream-{uuid.uuid4().hex}", f"{d}/[e]vents.parquet"  # a pattern, as the table may be one file
    e = read_stream(spark, path, load(spark, d, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    append_to(windowed(e, "ts", ["event_type"], "value"), f"{at}/out", f"{at}/state").awaitTermination()
    out = spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(f"{at}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS inserted FROM events WHERE user_id % 4 = 2 GROUP BY event_type")
def sink_chain(spark, d):
    """A bulk write that a sink of the caller's takes, before the table's own layout is asked."""
    from ..sources.layouts import SinkChain
    from ..sources.layouts import bulk_insert as insert

    t = published(spark, "events_sink", events(spark, d), ByHash("user_id", 4))

    class Passing:
        def can_handle(self, spec):
            return False

    class Taking:
        def can_handle(self, spec):
            return spec.name == "events_sink"

        def write(self, df, spec):
            return t.source.write(df, spec)

    n = insert(events(spark, d), t.spec, None, SinkChain(Passing(), Taking()))
    return t.shard_hint("2").df().groupBy("event_type").agg(rows().alias("n")).withColumn("inserted", F.lit(n).cast("long"))
