"""Near copies of texts and vectors, against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm.components import components
from stratum.llm.embeddings import bucket_keys, hadamard, near_vectors
from stratum.llm.minhash import classes, deduplicate, least_matches, shingles

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_texts(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for s in "\t\n\x0b\x0c\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i, s in sets.items() if s]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    up = roots(sets, links)
    return {i: (len(sets[i]), up[i], up[i] == i) for i in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(classes(docs)) == brute_texts([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_chains_hubs_and_copies(spark):
    """A hub whose copies are not similar to each other, a chain, exact copies and decoys that share a passage."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    hub = [word() for _ in range(300)]
    rows = [(1000, " ".join(hub))]

    def edited(words, n):
        w = list(words)
        for k in rng.choice(len(w), n, replace=False):
            w[k] = word()
        return w

    for i in range(40):
        rows.append((i, " ".join(edited(hub, 7))))
    rows += [(2000 + i, " ".join(hub).upper()) for i in range(5)]
    chain = [word() for _ in range(200)]
    for i in range(6):
        rows.append((3000 + i, " ".join(chain)))
        chain = edited(chain, 3)
    passage = [word() for _ in range(60)]
    rows += [(4000 + i, " ".join(passage + [word() for _ in range(25)])) for i in range(30)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one two three"), (5004, "One  two\nthree"), (5005, "one two"), (5006, " ".join(word() for _ in range(60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(classes(docs)) == brute_texts(rows)
    kept = {r["doc_id"] for r in deduplicate(docs).collect()}
    assert kept == {i for i, (_, _, k) in brute_texts(rows).items() if k}


def test_documents_edge_cases(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, kept int")
    out = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in classes(docs).collect()), key=str)
    assert out == sorted([(-1, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (-1, 0, None, True)], key=str)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2]
    empty = docs.limit(0)
    assert classes(empty).count() == 0 and deduplicate(empty).count() == 0


def test_pruning_keeps_what_may_be_similar():
    need = least_matches()
    rng = np.random.default_rng(0)
    lost = sum(any((rng.random(64 * (k + 1)) < 0.85).sum() < n for k, n in enumerate(need)) for _ in range(2000))
    assert lost == 0
    assert need[-1] > 0.7 * 512


def test_shingles_know_ascii_only():
    assert (shingles("A b\tc d e") == shingles("a B C\x0bd  E")).all()
    assert (shingles("É b c d e") != shingles("é b c d e")).all()
    assert len(shingles("a\xa0b c d e f")) == 1


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (200, 200)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == roots(sorted({x for p in links[:-1] for x in p}), links[:-1])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    good = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        if len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    ids = list(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    up, n = roots([i for i, _ in rows], links), dict.fromkeys([i for i, _ in rows], 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], up[i], up[i] == i) for i, _ in rows}


def test_vectors_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in df.collect()]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert out == brute_vectors(rows)


def test_vectors_edge_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.15).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [1.0] * 15 + [None]), (104, [1.0] * 15 + [float("nan")]), (105, [1e-200] * 16), (106, [1e200] * 16), (107, [1.0] * 3), (108, [2.0] * 3), (109, [float("inf")] + [1.0] * 15)]
    rows += [(200 + i, base.tolist()) for i in range(4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert out == brute_vectors(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs of cosine 0.9 exactly meet in some bucket."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=(3000, 64))
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = bucket_keys(x), bucket_keys(y)
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.998
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), 1)


@pytest.mark.parametrize("percent", [50, 85])
def test_threshold_is_a_parameter(spark, percent):
    words = [f"w{i}" for i in range(54)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:44], *(f"x{i}" for i in range(10))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = {r["component_id"] for r in classes(docs, percent=percent).select("component_id").collect()}
    assert len(same) == (1 if percent == 50 else 2)
    assert docs.where(F.col("doc_id") == 1).count() == 1
