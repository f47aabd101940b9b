"""What the exchanges of near copies hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.minhash import deduplicate


@pytest.fixture
def unbroadcast(spark):
    """As on large tables, where no lookup is small enough for a broadcast by itself."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def exchanged(spark, run) -> int:
    """Bytes that the stages of run() wrote for exchanges."""
    sc = spark.sparkContext
    sc.setJobGroup("exchanged", "exchanged")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store, n = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for k in {s for j in tracker.getJobIdsForGroup("exchanged") for s in tracker.getJobInfo(j).stageIds}:
        try:
            n += store.lastStageAttempt(k).shuffleWriteBytes()
        except Exception:  # noqa: BLE001 - a stage that was skipped
            pass
    return n


def test_exchanges_hold_only_texts_that_meet_others(unbroadcast, tmp_path):
    spark, rng = unbroadcast, np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, 12_000))) for _ in range(300)]
    texts = [" ".join(t[i : i + 6] for i in range(0, len(t), 6)) for t in texts]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(300, texts[0].upper(), "x"), (301, "one two " + texts[1], "x")]
    spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(4).write.parquet(path := str(tmp_path / "docs"))
    docs, kept = spark.read.parquet(path), []
    n = exchanged(spark, lambda: kept.extend(r["doc_id"] for r in deduplicate(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).collect()))
    assert sorted(kept) == list(range(300))
    assert 0 < n < sum(map(len, texts)) / 4


@pytest.mark.parametrize("maps", [None, 1])
def test_sift_loses_no_key(unbroadcast, monkeypatch, maps):
    if maps:
        monkeypatch.setattr(common, "SIEVE_MAPS", maps)
    spark = unbroadcast
    df = spark.range(-10_000, 30_000).select(F.col("id").cast("int").alias("a.b"), F.lit("x").alias("__at")).union(spark.sql("select cast(null as int), 'x'"))
    keys = spark.range(0, 30_000, 5).withColumnRenamed("id", "__bits")
    may, stay = common.sift(df, "a.b", keys)
    assert may.columns == stay.columns == df.columns
    may, stay = ([r[0] for r in x.collect()] for x in (may, stay))
    assert sorted(map(str, may + stay)) == sorted(map(str, [*range(-10_000, 30_000), None]))
    assert set(range(0, 30_000, 5)) <= set(may)
    assert len(may) < 6_000 + (0.3 if maps else 0.06) * 34_000
    assert [x.count() for x in common.sift(df, "a.b", keys.limit(0))] == [0, 40_001]
