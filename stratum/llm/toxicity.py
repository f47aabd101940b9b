"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of the embeddings of its hashed parts (the word and its character 4-grams, with marks at
both ends) over the root of their number. Filters of widths 1, 2 and 3 run over the words; each filter's maximum over
the whole text goes to a logistic output. Back-propagation reaches the words at the maxima only. One embedding axis
starts as the shrunk log odds of each part, the others as noise.

Thresholds are calibrated by language. As a score may not use the lang column, languages are clusters of letter
profiles (k-means over the frequencies of letters), found on the training texts, as many as narrow the profiles of
left-out texts by GAIN each; a text has the threshold of its
cluster, chosen on texts that training left out. score = 1 / (1 + exp(-slope * (logit - threshold))), so that 0.5 is
the threshold. Only labels of the training fold are used, of at most TRAIN_DOCS documents for each label, those with the
least hash of their id, as far as TRAIN_CHARS characters of whole texts go in that order; every document is scored on its
whole text.

Defined cases: null and wordless texts score 0; repeated rows score alike; labels that are null do not count, and of
several labels of one document the greatest does; without training documents of both labels every score is 0.
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cached, crc_fold, hidden, trim

TRAIN_DOCS, TRAIN_CHARS = 3_000, 60_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 3, 64, 0.01, 17
#: Standard errors by which log odds shrink.
DOUBT = 1.5
#: What a share of clean documents marked costs, against the same share of toxic ones missed: a choice of whoever filters.
FALSE_COST = 4
#: The most languages, and the share by which another must narrow the profiles of left-out texts.
LANGUAGES, GAIN, LETTERS = 16, 0.05, 256
#: Words that a worker remembers.
CACHE = 200_000

_STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’…–—¡¿·"


def parts(word: str) -> list[int]:
    """Buckets of a word and its character 4-grams."""
    w = f"<{word.strip(_STRIP) or word}>"
    return [zlib.crc32(w.encode()) % BUCKETS, *{zlib.crc32(b"4" + w[i : i + 4].encode()) % BUCKETS for i in range(max(0, len(w) - 3))}]


def letter_profile(text: str) -> np.ndarray:
    """Root frequencies of letters, hashed into LETTERS cells."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = code[code > 96]
    if not len(code):
        return np.zeros(LETTERS)
    return np.sqrt(np.bincount(code % LETTERS, minlength=LETTERS) / len(code))


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray  # of the filters
    out: np.ndarray
    out_bias: float
    centres: np.ndarray  # letter profiles of the languages
    thresholds: np.ndarray  # of logits, by language
    slope: float
    empty: bool = False

    def language(self, text: str) -> int:
        return int(((self.centres - letter_profile(text)) ** 2).sum(1).argmin())

    def score(self, logit: float, language: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (logit - self.thresholds[language]), -30, 30))))


class Scorer:
    """Scores texts; keeps the filters' products with words that it has seen."""

    def __init__(self, model: Model):
        self.m = model
        self.kernel = np.concatenate([f for w in model.filters for f in w], axis=1)  # DIM x (sum of widths * FILTERS)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, self.kernel.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        n = len(self.index)
        if n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(words)), self.rows.shape[1]), np.float32)])
        self.rows[n : n + len(words)] = embeddings(self.m.embed, [parts(w) for w in words]) @ self.kernel
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def logits(self, texts: list[str]) -> list[float | None]:
        out: list[float | None] = []
        for t in texts:
            words = t.lower().split()
            if not words or self.m.empty:
                out.append(None)
                continue
            if new := [w for w in dict.fromkeys(words) if w not in self.index]:
                if len(self.index) + len(new) > CACHE:
                    self.index.clear()
                    self.rows = self.rows[:4096]
                    new = [*dict.fromkeys(words)]
                self._learn(new)
            got = self.rows[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]
            out.append(float(self.pool(got) @ self.m.out + self.m.out_bias))
        return out

    def pool(self, got: np.ndarray) -> np.ndarray:
        at, pooled = 0, []
        for k, width in enumerate(WIDTHS):
            conv = got[:, at : at + FILTERS].copy()
            for j in range(1, width):
                conv[:-j] += got[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            pooled.append(np.maximum(conv.max(0) + self.m.bias[k], 0))
            at += width * FILTERS
        return np.concatenate(pooled)


def embeddings(embed: np.ndarray, buckets: list[list[int]]) -> np.ndarray:
    size = np.array([len(b) for b in buckets])
    flat = np.fromiter((x for b in buckets for x in b), np.int64, size.sum())
    return (np.add.reduceat(embed[flat], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None]).astype(np.float32)


def train(texts: list[str], label: np.ndarray) -> Model:
    """Fits the network on four fifths of the texts and the thresholds on the others."""
    rng = np.random.default_rng(SEED)
    words: dict[str, int] = {}
    docs = []
    for t in texts:
        docs.append(np.fromiter((words.setdefault(w, len(words)) for w in t.lower().split()), np.int64))
    used = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)
    left_out = used[4::5]
    fit = np.setdiff1d(used, left_out)
    bags = [np.array(parts(w), np.int64) for w in words]
    # log odds of each part by document, shrunk by their standard error
    seen = np.zeros((2, BUCKETS))
    for i in fit:
        seen[int(label[i]), np.unique(np.concatenate([bags[w] for w in np.unique(docs[i])]))] += 1
    n = [max(1, int((label[fit] == k).sum())) for k in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = 0.3 * np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * error, 0)
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :2] = 1 / len(f)
    m = Model(embed, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -0.5, np.zeros((1, LETTERS)), np.zeros(1), 1.0)
    _descend(m, docs, bags, label, fit, rng)
    _calibrate(m, texts, label, left_out, used)
    return m


def _descend(m: Model, docs, bags, label, fit, rng) -> None:
    """Adagrad over mini-batches; the gradient flows to the words at each filter's maximum."""
    power = {k: np.zeros_like(getattr(m, k)) + 1e-3 for k in ("bias", "out", "embed")} | {f"f{k}": np.zeros_like(f) + 1e-3 for k, f in enumerate(m.filters)} | {"b": 1e-3}
    weight = {k: len(fit) / (2 * max(1, (label[fit] == k).sum())) for k in (0, 1)}
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            size = np.array([len(docs[i]) for i in some])
            all_words = np.concatenate([docs[i] for i in some])
            unique, place = np.unique(all_words, return_inverse=True)
            vectors = embeddings(m.embed, [bags[w] for w in unique])
            x = vectors[place]
            start = np.cumsum(size) - size
            end = start + size
            doc_of = np.repeat(np.arange(len(some)), size)
            pooled, wins = [], []
            for k, width in enumerate(WIDTHS):
                conv = x @ m.filters[k][0]
                for j in range(1, width):
                    inside = np.arange(len(x) - j)[doc_of[: len(x) - j] == doc_of[j:]]
                    conv[inside] += x[inside + j] @ m.filters[k][j]
                top = np.maximum.reduceat(conv, start, axis=0)
                win = np.zeros((len(some), FILTERS), np.int64)
                rows, cols = np.nonzero(conv == top[doc_of])
                win[doc_of[rows[::-1]], cols[::-1]] = rows[::-1]
                pooled.append(top + m.bias[k])
                wins.append(win)
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            logit = hidden @ m.out + m.out_bias
            y = label[some]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * np.where(y == 1, weight[1], weight[0]) / len(some)
            back = error[:, None] * m.out[None, :] * (raw > 0)
            step = lambda name, value, grad: _step(power, name, value, grad)
            d_out, d_bias = hidden.T @ error, back.sum(0).reshape(len(WIDTHS), FILTERS)
            hit, grads = [], []
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                d_f = np.zeros_like(m.filters[k])
                for j in range(width):
                    pos = wins[k] + j
                    inside = pos < end[:, None]
                    pos = np.where(inside, pos, 0)
                    gj = np.where(inside, g, 0)
                    d_f[j] = np.einsum("bfd,bf->df", x[pos], gj)
                    hit.append(place[pos].ravel())
                    grads.append((gj[:, :, None] * m.filters[k][j].T[None]).reshape(-1, DIM))
                m.filters[k] = step(f"f{k}", m.filters[k], d_f)
            m.out, m.bias = step("out", m.out, d_out), step("bias", m.bias, d_bias)
            power["b"] += error.sum() ** 2
            m.out_bias -= RATE * float(error.sum()) / np.sqrt(power["b"])
            rows, inverse = np.unique(np.concatenate(hit), return_inverse=True)
            by_word = np.zeros((len(rows), DIM))
            np.add.at(by_word, inverse, np.concatenate(grads))
            bag = [bags[unique[r]] for r in rows]
            counts = np.array([len(b) for b in bag])
            buckets, inverse = np.unique(np.concatenate(bag), return_inverse=True)
            by_bucket = np.zeros((len(buckets), DIM))
            np.add.at(by_bucket, inverse, np.repeat(by_word / np.sqrt(counts)[:, None], counts, axis=0))
            power["embed"][buckets] += by_bucket**2
            m.embed[buckets] -= (RATE * by_bucket / np.sqrt(power["embed"][buckets])).astype(np.float32)


def _step(power: dict, name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
    power[name] = power[name] + grad**2
    return (value - RATE * grad / np.sqrt(power[name])).astype(np.float32)


def _calibrate(m: Model, texts, label, left_out, used) -> None:
    profiles = np.array([letter_profile(texts[i]) for i in used])
    m.centres = _languages(profiles)
    logits = np.array(Scorer(m).logits([texts[i] for i in left_out]), float)
    y, group = label[left_out], np.array([m.language(texts[i]) for i in left_out])
    overall = _threshold(logits, y)
    m.thresholds = np.full(len(m.centres), overall)
    for g in range(len(m.centres)):
        if min((y[group == g] == k).sum() for k in (0, 1)) >= 10:
            m.thresholds[g] = _threshold(logits[group == g], y[group == g])
    margin = logits - m.thresholds[group]
    # the slope at which scores are likeliest, on a grid
    grid = [0.25, 0.5, 1, 2, 4]
    m.slope = min(grid, key=lambda a: np.log1p(np.exp(-np.clip(a * margin * np.where(y == 1, 1, -1), -30, 30))).sum())


def _threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap of least cost."""
    if min((y == k).sum() for k in (0, 1)) == 0:
        return 0.0
    order = np.argsort(logit, kind="stable")
    v, t = logit[order], y[order]
    w = np.where(t == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    missed = np.concatenate([[0], np.cumsum(w * (t == 1))])
    false = (w * (t == 0)).sum() - np.concatenate([[0], np.cumsum(w * (t == 0))])
    edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    cost = missed + FALSE_COST * false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points and centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def _languages(x: np.ndarray) -> np.ndarray:
    """Centres of profiles: one more as long as that narrows every fifth profile, left out, by GAIN."""
    rest = np.arange(len(x)) % 5 == 4
    if not rest.any() or rest.all():
        return _clusters(x, 1)
    best, spread = 1, _far(x[rest], _clusters(x[~rest], 1)).min(1).mean()
    while best < min(LANGUAGES, (~rest).sum()):
        narrower = _far(x[rest], _clusters(x[~rest], best + 1)).min(1).mean()
        if narrower > (1 - GAIN) * spread:
            break
        best, spread = best + 1, narrower
    return _clusters(x, best)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from farthest points."""
    centres = [x.mean(0)]
    for _ in range(k):
        centres.append(x[_far(x, np.array(centres)).min(1).argmax()])
    c = np.array(centres[1:])
    for _ in range(15):
        near = _far(x, c).argmin(1)
        c = np.array([x[near == g].mean(0) if (near == g).any() else c[g] for g in range(len(c))])
    return c


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_fold=None) -> Model:
    """Trains on labelled documents outside the held-out fold. Only ids of the bounded choice are broadcast; the texts
    leave the driver's memory with the training."""
    model = _fitted(docs, labels, doc_id, text, label, train_fold)
    gc.collect()
    trim()
    return model


def _fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, train_fold) -> Model:
    lab = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label is not null and doc_id is not null")
    lab = lab.where(crc_fold(F.col("doc_id"), 5) != 0 if train_fold is None else train_fold).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = []
    for k in (0, 1):
        chosen += [(r["doc_id"], k) for r in lab.where(F.col("label") == k).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(TRAIN_DOCS).collect()]
    if len({k for _, k in chosen}) < 2:
        return _nothing()
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("label", T.IntegerType())]))
    some = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    # how long they are, then the texts of as many as the characters go for, in the order of hashes
    length = {r["doc_id"]: r["n"] for r in some.select("doc_id", F.length("text").alias("n")).join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    taken = []
    for k in (0, 1):
        left = TRAIN_CHARS
        for i, label_ in chosen:
            if label_ == k and i in length:
                left -= length[i]
                if left < 0:
                    break
                taken.append((i, k))
    if len({k for _, k in taken}) < 2:
        return _nothing()
    ids = docs.sparkSession.createDataFrame(taken, ids.schema)
    found = some.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text").toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), found["text"].to_pylist(), strict=True))
    rows = [rows[i] for i in np.argsort([zlib.crc32(str(r[0]).encode()) for r in rows], kind="stable")]
    y = np.array([r[1] for r in rows], np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return _nothing()
    return train([r[2] for r in rows], y)


def _nothing() -> Model:
    return Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, np.zeros((1, LETTERS)), np.zeros(1), 1.0, True)


_scorers: dict = {}


def _forget() -> None:
    _scorers.clear()


def _scorer(shared) -> Scorer:
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = Scorer(shared.value)
    return _scorers[shared.id]


class _Shared:
    """A broadcast value with an id that workers can keep things by."""

    def __init__(self, spark, value):
        self.b = spark.sparkContext.broadcast(value)
        self.id = self.b._jbroadcast.id()

    def __reduce__(self):
        return _Sent, (self.b, self.id)


class _Sent:
    def __init__(self, b, key):
        self.b, self.id = b, key

    @property
    def value(self):
        return self.b.value


def _scores(scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    texts = [t or "" for t in texts]
    return np.array([0.0 if x is None else scorer.m.score(x, scorer.m.language(t)) for x, t in zip(scorer.logits(texts), texts, strict=True)])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all but the text, if not given), score and predicted of every document; those two replace columns of their names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted") and (keep is not None or c != text)]
    shared = _Shared(docs.sparkSession, model)
    n = len(keep)

    def run(batches):
        with cached("toxicity", _forget):
            s = _scorer(shared)
            for b in batches:
                p = _scores(s, b.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(*hidden(keep, "text"))).mapInArrow(run, schema)


def keep_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    shared, at = _Shared(docs.sparkSession, model), docs.columns.index(text)

    def run(batches):
        with cached("toxicity", _forget):
            s = _scorer(shared)
            for b in batches:
                yield b.filter(pa.array(_scores(s, b.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
