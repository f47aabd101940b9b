"""The models against plain versions: a dense forward pass, numeric gradients, closed-form ridge, pooled means, covering by hand."""

from itertools import pairwise
from math import ceil, log2

import numpy as np
import pytest

from stratum.llm import quality_kernel, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def small_model(rng):
    return toxicity.Model(
        rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32),
        [rng.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        rng.normal(0, 0.2, (len(toxicity.WIDTHS), toxicity.FILTERS)).astype(np.float32), rng.normal(0, 0.5, len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), 0.1, np.zeros((1, toxicity.LETTERS)), np.zeros(1), 1.0,
    )


def dense_logit(m, text):
    """Filter by filter and place by place; windows that reach over the end of the text see nothing there."""
    x = []
    for w in text.lower().split():
        p = toxicity.parts(w)
        x.append(sum(m.embed[b].astype(float) for b in p) / np.sqrt(len(p)))
    pooled = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            at = [sum(float(x[i + j] @ m.filters[k][j][:, f]) for j in range(width) if i + j < len(x)) for i in range(len(x))]
            pooled.append(max(max(at) + float(m.bias[k, f]), 0.0))
    return float(np.dot(pooled, m.out)) + m.out_bias


TEXTS = ["one", "two words", "The cat, the hat! and the BAT", "a b c d e f g", "repeat repeat repeat other", "señor niño über alles", " ".join(f"w{i} v{i % 7}" for i in range(3000))]


def test_forward_pass_is_the_dense_one():
    m = small_model(np.random.default_rng(1))
    assert np.allclose(toxicity.Scorer(m).logits(TEXTS), [dense_logit(m, t) for t in TEXTS], atol=1e-3)
    # words that a full cache has let go score alike
    s = toxicity.Scorer(m)
    first = s.logits(TEXTS)
    s.index.clear()
    assert s.logits(TEXTS) == first and toxicity.Scorer(m).logits(["", " \t", None or ""]) == [None] * 3


def test_gradients_are_the_numeric_ones(monkeypatch):
    """The first step of Adagrad tells the gradient; it must be that of the weighted log loss."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rng = np.random.default_rng(2)
    m = small_model(rng)
    texts, y = ["good day to you", "bad bad words here", "you bad", "day"], np.array([0.0, 1.0, 1.0, 0.0])
    before = small_model(np.random.default_rng(2))
    words, docs = {}, []
    for t in texts:
        docs.append(np.array([words.setdefault(w, len(words)) for w in t.split()]))
    toxicity._descend(m, docs, [np.array(toxicity.parts(w)) for w in words], y, np.arange(4), rng)

    def loss():
        z = np.array([dense_logit(before, t) for t in texts])
        return float((np.log1p(np.exp(-z * (2 * y - 1))) * np.where(y == 1, 4 / (2 * 2), 4 / (2 * 2))).mean())

    def numeric(a, at, h=1e-3):
        old = a[at]
        a[at] = old + h
        up = loss()
        a[at] = old - h
        down = loss()
        a[at] = old
        return (up - down) / (2 * h)

    def stepped(old, new):
        s = (float(old) - float(new)) / toxicity.RATE
        return s * np.sqrt(1e-3 / max(1e-9, 1 - s * s))

    bucket = toxicity.parts("bad")[0]
    places = [("out", before.out, m.out, (k,)) for k in range(0, 24, 5)] + [("bias", before.bias, m.bias, (k, f)) for k in range(3) for f in (0, 3)]
    places += [(f"filter {k}", before.filters[k], m.filters[k], (j, 4, f)) for k in range(3) for j in range(k + 1) for f in (1, 6)] + [("embed", before.embed, m.embed, (bucket, d)) for d in range(0, 12, 3)]
    for name, old, new, at in places:
        want = numeric(old, at)
        assert stepped(old[at], new[at]) == pytest.approx(want, abs=2e-3, rel=0.05), (name, at)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_convolution_learns_what_log_odds_of_words_cannot(monkeypatch):
    """Both labels hold the same words; only those of label 1 have two of them side by side."""
    monkeypatch.setattr(toxicity, "EPOCHS", 12)
    rng = np.random.default_rng(3)
    filler = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]

    def document(toxic):
        w = list(rng.choice(filler, 40))
        at = int(rng.integers(0, 18))
        if toxic:
            w[at : at + 2] = ["vile", "zealot"]
        else:
            w[at], w[at + 20] = ("vile", "zealot") if rng.random() < 0.5 else ("zealot", "vile")
        return " ".join(w)

    y = np.arange(1600) % 2
    texts = [document(k) for k in y]
    m = toxicity.train(texts[:1200], y[:1200].astype(np.int64))
    full = auc(np.array(toxicity.Scorer(m).logits(texts[1200:])), y[1200:])
    words = [set(t.split()) for t in texts]
    vocabulary = sorted(set().union(*words))
    seen = {w: [1 + sum(w in words[i] for i in range(1200) if y[i] == k) for k in (0, 1)] for w in vocabulary}
    odds = auc(np.array([sum(np.log(seen[w][1] / seen[w][0]) for w in x) for x in words[1200:]]), y[1200:])
    assert full > 0.9 and odds < 0.65, (full, odds)


def test_training_and_scores_repeat():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(100)]
    texts = [" ".join(rng.choice(words, 30)) + (" vile" if k % 2 else "") for k in range(120)]
    a, b = (toxicity.train(texts, np.arange(120) % 2) for _ in range(2))
    assert np.array_equal(a.embed, b.embed) and toxicity.Scorer(a).logits(texts) == toxicity.Scorer(b).logits(texts)


def test_isotonic_is_the_max_min_of_means():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        v, w = np.round(rng.random(n), 1), rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(quality_kernel.isotonic(v, w), want)


@pytest.fixture(scope="module")
def labelled(spark):
    stats = quality_kernel.document_statistics(spark.read.parquet(f"{SF}/documents.parquet"))
    return stats, spark.read.parquet(f"{SF}/labels.parquet")


def test_kernel_is_closed_form_ridge(spark, labelled):
    rows = quality_kernel.training_rows(*labelled)
    k = quality_kernel.fit(rows)
    got = rows.collect()
    part = lambda c: [r for r in got if r["calibrate"] == c]
    read = lambda rs: quality_kernel.vectors({c: np.array([r[c] for r in rs]) for c in quality_kernel.STATS})
    x, y = read(part(False)), np.array([r["label"] for r in part(False)], float)
    assert np.allclose(k.mean, x.mean(0), atol=1e-4) and np.allclose(k.scale, x.std(0) + 1e-3, atol=1e-3)
    z = np.column_stack([np.ones(len(x)), np.sqrt(2 / quality_kernel.FEATURES) * np.cos(np.clip((x - k.mean) / k.scale, -6, 6) @ k.w + k.b)])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = quality_kernel.RIDGE * len(y) * np.diag([0, *np.ones(quality_kernel.FEATURES)])
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + ridge, z.T @ (w * y))
    assert np.abs(z @ beta - k.raw(x)).max() < 2e-3
    # the features approximate a Gaussian kernel
    u = np.clip((x[:60] - k.mean) / k.scale, -6, 6)
    gauss = np.exp(-(quality_kernel.WIDTH**2) * ((u[:, None] - u[None]) ** 2).sum(2) / 2)
    assert np.abs(z[:60, 1:] @ z[:60, 1:].T - gauss).mean() < 0.08
    # calibrated scores do not fall where raw scores rise
    raw = np.linspace(-0.5, 1.5, 500)
    assert all(a <= b + 1e-12 for a, b in pairwise(np.interp(raw, k.knots, k.values)))
    again = quality_kernel.fit(rows.repartition(5))
    assert np.array_equal(again.beta, quality_kernel.fit(rows.repartition(5)).beta)


def cover(rows):
    """Sequential covering over lists of (label, grow, features), as learn() says that it is done."""
    names = list(rows[0][2]) if rows else []
    edges = {}
    for n in names:
        v = sorted(int(str(r[2][n])[:3].ljust(len(str(r[2][n])), "0")) for r in rows)
        edges[n] = sorted({v[max(0, ceil(k / quality_rules.BINS * len(v)) - 1)] for k in range(1, quality_rules.BINS)})
    hit = lambda c, f: (f[c[0]] >= c[2]) == c[1]
    left, out = list(rows), []
    while len(out) < quality_rules.RULES:
        rule = []
        while len(rule) < quality_rules.CONDITIONS:
            inside = [r for r in left if r[1] and all(hit(c, r[2]) for c in rule)]
            low, high = sum(r[0] == 0 for r in inside), sum(r[0] != 0 for r in inside)
            if not low or not high:
                break
            best = (1e-9, None)
            for n in names:
                for e in edges[n]:
                    for least in (False, True):
                        p = sum(r[0] == 0 and hit((n, least, e), r[2]) for r in inside)
                        q = sum(r[0] != 0 and hit((n, least, e), r[2]) for r in inside)
                        if p and (gain := p * (log2(p / (p + q)) - log2(low / (low + high)))) > best[0]:
                            best = (gain, (n, least, e), q)
            if best[1] is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        scores = []
        for k in range(1, len(rule) + 1):
            there = [r for r in left if not r[1] and all(hit(c, r[2]) for c in rule[:k])]
            p = sum(r[0] == 0 for r in there)
            scores.append((p / max(1, len(there)), -k, p))
        if not scores or (best := max(scores))[0] < quality_rules.PRECISION or best[2] < quality_rules.LEAST:
            return out
        rule = rule[: -best[1]]
        out.append(tuple(rule))
        left = [r for r in left if not all(hit(c, r[2]) for c in rule)]
    return out


def test_rules_are_those_of_covering_by_hand(spark, labelled):
    import zlib

    table = quality_rules.labelled(*labelled)
    f = quality_rules.features()
    rows = [(r["label"], zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0, {n: r[n] for n in f}) for r in table.where(~quality_rules.base_failed()).select("doc_id", "label", *[c.alias(n) for n, c in f.items()]).collect()]
    some = rows[:300]
    assert {x[0] for x in some} == {0, 1}
    got = [tuple((c.feature, c.least, c.threshold) for c in r.conditions) for r in quality_rules.learn(table)]
    assert got == cover(rows) and got
    # however the rows are dealt out
    assert [str(r) for r in quality_rules.learn(table.repartition(13))] == [str(r) for r in quality_rules.learn(table)]
