"""Rules, classifiers, the mix and license scans: brute force, held-out accuracy and SQL."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import licenses, mixing, quality_kernel, quality_rules, toxicity
from stratum.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "one", "a b c a b c a b c", "a b c d a b c x a b", "x\nx\n\n y \ny \nx", "# $ | <> &*%", "é ß\x0bñ\x0c\r z", "the cat sat " * 40, "w " * 60, "Z! Z? " * 30]


def brute_counts(t):
    w = WORD.findall(t or "")
    seen, at = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at.update(p + k for p in places for k in range(3))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(at)


def test_statistics_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (3, "one")]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words int")
    out = quality_rules.statistics(df, "text")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "", tuple(r[c] for c in quality_rules.COUNTS)) for r in out.collect())
    assert got == sorted(((i is not None, i or 0), t or "", brute_counts(t)) for i, t in rows)
    assert quality_rules.statistics(df.limit(0), "text").count() == 0


def test_lines_keep_white_space_at_the_ends_of_a_text(spark):
    texts = [" a\na", "a\r\nb\r\na\r\n", "a\r\nb\r\na", "\ta\n\ta\na", "a \nb\na ", "\n\n a\nb\n a\n\n", " \n \n", "a\x0b\na\x0b\x0c\na\x0b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.statistics(df, "text").collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_rules_reject_low_quality_and_keep_the_rest(spark):
    out = queries()["op6_quality_rules"](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    low, high = [r["kept"] for r in rows if not r["quality"]], [r["kept"] for r in rows if r["quality"]]
    assert sum(high) >= 0.98 * len(high) and sum(low) <= 0.25 * len(low)
    bad = out.where((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    assert bad.where("kept or not base_failed").count() == 0


def test_rules_without_labels_and_pushed_filters(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(quality_rules.labelled(quality_rules.statistics(docs, "text"), labels)) == []
    kept = quality_rules.passing(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 0
    long = docs.limit(1).withColumn("text", F.lit(" ".join(f"w{i} v{i}" for i in range(3000))))
    assert quality_rules.passing(long, labels).count() == 1


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize("name,label,least,sf", [("op2_toxicity", "toxic", 0.9, "/root/testdata/sf0.1"), ("op4_quality_kernel", "quality", 0.9, SF)])
def test_classifiers_on_held_out_documents(spark, name, label, least, sf):
    out = queries()[name](spark, sf)
    n, fold = (5, 0) if label == "toxic" else (3, 1)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == fold) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert auc(np.array([r["score"] for r in held]), np.array([r[label] for r in held])) > least


def test_classifiers_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(TEXTS)] + [(None, "x", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.keep_documents(docs, model).columns == docs.columns and toxicity.keep_documents(docs, model).count() == docs.count()
    stats = quality_kernel.document_statistics(docs)
    kernel = quality_kernel.fit(quality_kernel.training_rows(stats, none))
    assert quality_kernel.score(stats, kernel, ["doc_id"]).count() == docs.count()
    assert quality_kernel.score(stats.limit(0), kernel, ["doc_id"]).count() == 0
    assert list(quality_kernel.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4))) == [1, 2.5, 2.5, 4]


def test_kernel_scores_do_not_depend_on_partitions(spark):
    stats = quality_kernel.document_statistics(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = (quality_kernel.fit(quality_kernel.training_rows(s, labels)) for s in (stats, stats.repartition(7)))
    assert np.allclose(a.beta, b.beta, atol=1e-6)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        t = {s: 2.0 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix_meets_targets(spark):
    out = queries()["op7_mixing"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken = {}, {}
    for r in out:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] + 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 30), s
    again = {(r["doc_id"], r["taken"]) for r in queries()["op7_mixing"](spark, SF).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}


def test_last_documents_fill_the_rest():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 100):
        docs = [(h, int(s)) for h, s in enumerate(rng.integers(50, 900, n))]
        size = dict(docs)
        for left in (0, 10, 700, 20_000):
            got = mixing._fitting(docs, left)
            assert len(got) == len(set(got)) and sum(size[h] for h in got) <= left
            rest = left - sum(size[h] for h in got)
            assert all(size[h] > rest for h in size if h not in got)
            if n == 100 and left >= 20_000:
                assert rest <= 2
    # sizes far beyond the steps in which they are counted
    docs = [(h, int(s)) for h, s in enumerate(rng.integers(10**8, 10**10, 200))]
    size = dict(docs)
    got = mixing._fitting(docs, 5 * 10**11)
    rest = 5 * 10**11 - sum(size[h] for h in got)
    assert 0 <= rest < 10**6 and len(got) == len(set(got))


def test_mix_goes_on_past_documents_that_do_not_fit(spark):
    """Very long documents lie among many short ones; what is left is less than any document left out."""
    sizes = {i: 500 if i % 40 else 200_000 for i in range(1, 500)} | {i: 3 + i % 7 for i in range(1000, 6000)} | {9000 + i: 30_000 for i in range(4)}
    rows = [(i, "w " * n, "a" if i < 1000 else "b") for i, n in sizes.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        out = mixing.mix(docs, seed=seed).collect()
        assert {r["doc_id"]: r["size"] for r in out} == sizes
        for a in (True, False):
            mine = [r for r in out if (r["doc_id"] < 1000) == a]
            left, once = mine[0]["target"] - sum(r["taken"] for r in mine), min(r["copies"] for r in mine)
            assert -1 < left < min(r["size"] for r in mine if r["copies"] == once), (seed, a, left)


def test_flow_over_overlapping_sources():
    """Shared documents go where they are needed; repeats only once single passes are used up."""
    flows = mixing.route({("a",): 100, ("b",): 50, ("a", "b"): 60}, {"a": 120, "b": 90})
    assert sum(f.get("a", 0) for f in flows.values()) == 120 and sum(f.get("b", 0) for f in flows.values()) == 90
    assert all(sum(flows[p].values()) <= s for p, s in {("a",): 100, ("b",): 50, ("a", "b"): 60}.items())
    more = mixing.route({("a",): 100, ("a", "b"): 60}, {"a": 180, "b": 100})
    assert sum(sum(f.values()) for f in more.values()) == 280 and sum(more["a", "b"].values()) <= 120


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", "x", [None]), (2, None, "x", ["s"]), (3, "", None, ["s"]), (4, "d e", None, ["s", "t"]), (None, "f g h i", "y", ["t"]), (5, "one", "y", []), (5, "one", "y", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size array<string>")
    out = mixing.mix(docs).collect()
    assert len(out) == 7 and all(r["taken"] <= 2 * r["size"] for r in out)
    many = mixing.mix_documents(docs, members=F.col("size"))
    assert many.columns == docs.columns and many.where("doc_id = 5").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_license_scan_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(oracle_sql()["op8_license_scan"]).fetchall())
    got = sorted(tuple(r) for r in queries()["op8_license_scan"](spark, SF).select("doc_id", "license", "n_shingles", "n_found", "containment", "at_word").collect())
    assert got == want and len(got) > 10


def test_licenses_are_found_after_edits(spark):
    """Of edited notices that still hold 80 % of a template's shingles nearly all are found; the formula says 0.9997 of a window."""
    rng, rows, want = np.random.default_rng(6), [], set()
    words = lambda t: [x for x in re.split(licenses.BETWEEN, t.lower()) if x]
    for name, template in licenses.TEMPLATES.items():
        w = words(template)
        if len(w) < 40:
            continue
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for _ in range(25):
            x = [f"edit{rng.integers(9)}" if rng.random() < 0.03 else v for v in w]
            i = len(rows)
            rows.append((i, "some words before " + " ".join(x) + " and after"))
            if 100 * len(own & {tuple(x[k : k + 5]) for k in range(len(x) - 4)}) >= licenses.PERCENT * len(own):
                want.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 60 and len(want & got) >= 0.99 * len(want)


def test_license_windows_and_edge_cases(spark):
    filler = " ".join(f"word{i}" for i in range(500))
    mit = licenses.TEMPLATES["MIT text"]
    words = mit.split()
    changed = " ".join(words[:20] + ["odd"] + words[21:])
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler} {changed.upper()}"), (3, filler), (4, None), (5, ""), (6, " ".join(words[: len(words) // 2])), (7, "Released under the MIT License."), (7, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect())
    assert got == [(1, "MIT text"), (2, "MIT text"), (7, "MIT"), (7, "MIT")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_very_long_texts_and_clashing_names(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    model = toxicity.train([" ".join(rng.choice(words, 30)) + " vile" * (k % 2) for k in range(100)], np.arange(100) % 2)
    notice = licenses.TEMPLATES["ISC text"]
    long = " ".join(rng.choice(words, 200_000)) + " " + notice
    rows = [(1, long, "a"), (2, "x" * 300_000, "a"), (3, "short text", "b"), (4, None, None)]
    docs = spark.createDataFrame([(*r, "y", 1, 2.0) for r in rows], "doc_id long, text string, source string, __text string, __row int, score double")
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "source", "__text", "__row", "score", "predicted"] and scored.count() == 4
    assert toxicity.keep_documents(docs, model).columns == docs.columns
    n = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.statistics(docs, "text").collect()}
    assert n[1] == (brute_counts(long)[0], brute_counts(long)[4]) and n[2] == (1, 0) and n[4] == (0, 0)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: n[1][0], 2: 1, 3: 2, 4: 0}
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()] == [(1, "ISC text")]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    kept = quality_rules.passing(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1}
