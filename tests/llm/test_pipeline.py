"""Each stage of the pipeline against a plain version, and run() against the stages one after another."""

import base64
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from stratum.llm import quality_rules, toxicity
from stratum.llm.common import written
from test_pairs import brute_texts
from test_rules import brute_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "mixing", "byte-level BPE"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_rules_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = quality_rules.statistics(stages[0], "text")
    rules, stats = quality_rules.learn(quality_rules.labelled(table, labels)), table.collect()
    f = lambda r: {"words": r["n_words"], "word_length": 1000 * r["word_chars"] // max(1, r["n_words"]), "symbols": 1000 * r["n_symbols"] // max(1, r["word_chars"]), "dup_lines": 1000 * r["n_dup_lines"] // max(1, r["n_lines"]), "repeats": 1000 * r["n_repeat_words"] // max(1, r["n_words"]), "upper": 1000 * r["n_upper"] // max(1, r["word_chars"]), "marks": 1000 * r["n_marks"] // max(1, r["word_chars"]), "distinct": 1000 * r["n_distinct_words"] // max(1, r["n_words"])}
    hit = lambda c, x: (x[c.feature] >= c.threshold) == c.least
    keep = {r["doc_id"] for r in stats if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"] and not any(all(hit(c, f(r)) for c in rule.conditions) for rule in rules)}
    assert {i for i, _ in pairs(stages[1])} == keep


def test_toxicity_stage(spark, stages):
    model = toxicity.fit(stages[1], spark.read.parquet(f"{SF}/labels.parquet"))
    s = toxicity.Scorer(model)
    assert {i for i, _ in pairs(stages[2])} == {i for i, t in pairs(stages[1]) if toxicity._scores(s, [t])[0] < 0.5}


def test_near_duplicate_stage(stages):
    want = brute_texts(pairs(stages[2]))
    assert sorted(i for i, _ in pairs(stages[3])) == sorted(i for i, (_, _, kept) in want.items() if kept)


def test_mixing_stage(stages):
    rows = stages[3].select("doc_id", "source", "text").collect()
    times = {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        n, s = len(WORD.findall(r["text"])), r["source"]
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + n * times.get(r["doc_id"], 0)
        largest[s] = max(largest.get(s, 0), n)
    want = brute_targets(sizes)
    assert set(times) <= {r["doc_id"] for r in rows} and max(times.values()) <= 2
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s]) for s in sizes)


def test_encoding_stage_and_run(spark, stages):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, np.array(ref.encode_ordinary(t), np.uint32).tobytes()) for i, t in pairs(stages[4]))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in stages[5].collect()) == want
    assert stages[5].where("not round_trip").count() == 0
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_give_heap_back_first(spark, stages):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    name, stage = corpus_pipeline.STAGES[4]
    before = full()
    stage(spark, stages[4], SF)
    assert name == "byte-level BPE" and full() > before


def test_stages_take_odd_tables(spark, stages):
    docs = stages[0]
    odd = docs.limit(5).withColumns({"text": F.lit(None).cast("string"), "kept": F.lit(1), "size": F.lit("x")}).union(docs.limit(5).withColumns({"doc_id": F.lit(None).cast("long"), "kept": F.lit(1), "size": F.lit("x")}))
    for d in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, SF)
            assert k == 4 or out.columns == d.columns, name
            out.count()
