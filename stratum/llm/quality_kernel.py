"""Quality classifier: ridge scores on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics come from DataFrame expressions (quality_rules.statistics). Standardized, they go through
sqrt(2 / D) cos(Wx + b) with Gaussian W, whose products approximate a Gaussian kernel. Each partition sums its normal
equations, one row for each row of the matrix; the sums of all partitions are added by key, in two levels, so that the
driver gets one matrix however many labelled rows there are. All sums are of whole numbers (features and weights count in
steps of 2 ** -16 and 2 ** -8), so that they do not depend on the order in which rows come. A score histogram of a fifth
of the training rows, left out of the equations, is made monotone by pooling adjacent violators.

Defined cases: a null or empty text has all-zero statistics and the score of that point; null labels do not count; several
labels of one document count each; without training rows of both labels every score is the mean label (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold
from .quality_rules import COUNTS, MORE, statistics

FEATURES, WIDTH, RIDGE, SEED = 192, 0.35, 1e-3, 29
CALIBRATION_BINS = 512
#: Steps of a statistic or feature, steps of a weight, and the greatest statistic: products of a batch stay exact.
UNIT, WEIGHT_UNIT, MOST = 1 << 16, 1 << 8, 1024.0
#: Groups in which partial sums meet first.
GROUPS = 64
#: Sums are held as a high and a low part, split here.
_LOW = 31
STATS = [*COUNTS, *MORE]


def vectors(columns: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each document: logarithms of lengths, and shares."""
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    columns = np.column_stack([np.log1p(c["n_words"]), np.log1p(c["n_lines"]), c["word_chars"] / words, np.log1p(1000 * c["n_symbols"] / chars), c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log1p(1000 * c["n_upper"] / chars), np.log1p(1000 * c["n_marks"] / chars), c["n_distinct_words"] / words])
    return np.minimum(columns, MOST)


def steps(x: np.ndarray, unit: int = UNIT) -> np.ndarray:
    return np.round(x * unit).astype(np.int64)


N_IN = 9


@dataclass
class Kernel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores
    values: np.ndarray  # what they are calibrated to

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        # a trace of the raw score keeps the order inside the steps of the isotonic fit
        return np.clip(0.999 * np.interp(r, self.knots, self.values) + 0.001 / (1 + np.exp(-8 * (r - 0.5))), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to value: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _read(batch, names) -> np.ndarray:
    return vectors({k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)})


def fit(rows: DataFrame, seed: int = SEED) -> Kernel:
    """rows: STATS, label (0 or 1) and calibrate (boolean: for the isotonic fit rather than the equations)."""
    rng = np.random.default_rng(seed)
    kernel = Kernel(np.zeros(N_IN), np.ones(N_IN), rng.normal(0, WIDTH, (N_IN, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    # moments first: one row of sums from each partition, added by key
    moments = _added(rows.where("not calibrate"), lambda x, y: np.concatenate([[len(x), int(y.sum())], steps(x).sum(0), (steps(x) ** 2 >> 16).sum(0)])[None], 2 + 2 * N_IN)
    if not len(moments):
        return kernel
    n, ones = moments[0, 0], moments[0, 1]
    if ones in (0, n):
        kernel.values = np.full(2, ones / n)
        return kernel
    kernel.mean = moments[0, 2 : 2 + N_IN] / UNIT / n
    kernel.scale = np.sqrt(np.maximum(moments[0, 2 + N_IN :] / UNIT / n - kernel.mean**2, 1e-12)) + 1e-3

    def equations(x, y):
        # both labels weigh alike
        high, low = (min(n / (2 * k), 4096) for k in (ones, n - ones))
        # few enough rows at once that whole numbers stay below 2 ** 53, so that floating-point products and sums are exact
        total, size = 0, 4096 if max(high, low) <= 128 else 128
        for at in range(0, len(x), size):
            z, some = steps(kernel.map(x[at : at + size])).astype(float), y[at : at + size]
            z[:, 0] = 1
            w = steps(np.where(some == 1, high, low), WEIGHT_UNIT).astype(float)
            total = total + np.column_stack([(z * w[:, None]).T @ z, z.T @ (w * some)]).astype(np.int64)
        return total

    m = _added(rows.where("not calibrate"), equations, FEATURES + 2)
    # back from steps: those of the two features of a cell, and of the weight
    unit = np.array([1.0, *[UNIT] * FEATURES])
    a, b = m[:, :-1] / WEIGHT_UNIT / unit[:, None] / unit[None], m[:, -1] / WEIGHT_UNIT / unit
    ridge = RIDGE * n * np.eye(len(a))
    ridge[0, 0] = 0
    kernel.beta = np.linalg.solve(a + ridge, b)
    return _calibrated(kernel, rows.where("calibrate"))


def _added(rows: DataFrame, sums, width: int) -> np.ndarray:
    """The sum over all partitions of sums(vectors, labels), a matrix of whole numbers; partials meet by row of the matrix."""
    names = STATS
    schema = "row int, spot int, part binary"

    def partial(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                x, y = _read(b, names), b.column(len(names)).to_numpy(zero_copy_only=False).astype(float)
                s = sums(x, y)
                s = np.concatenate([s >> _LOW, s & (1 << _LOW) - 1], axis=1)
                total = s if total is None else total + s
        if total is not None:
            yield given(dict(enumerate(total)), TaskContext.get().partitionId() % GROUPS)

    def given(by: dict, spot: int):
        return pa.RecordBatch.from_arrays([pa.array(by, pa.int32()), pa.array([spot] * len(by), pa.int32()), pa.array([v.tobytes() for v in by.values()], pa.binary())], names=["row", "spot", "part"])

    def add(batches):
        by: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                by[k] = by.get(k, 0) + np.frombuffer(v, np.int64)
        if by:
            yield given(by, 0)

    parts = rows.select(*names, F.col("label").cast("double")).mapInArrow(partial, schema)
    met = parts.repartition("row", "spot").mapInArrow(add, schema)
    got = sorted((r["row"], bytes(r["part"])) for r in met.repartition(8, "row").mapInArrow(add, schema).collect())
    whole = np.array([np.frombuffer(v, np.int64) for _, v in got]).reshape(-1, 2 * width)
    return whole[:, :width].astype(float) * (1 << _LOW) + whole[:, width:].astype(float)


def _calibrated(kernel: Kernel, rows: DataFrame) -> Kernel:
    """Counts of labels by bins of the raw score, over all calibration rows, made monotone."""
    k = CALIBRATION_BINS

    def bins(batches):
        low, high = np.zeros(k), np.zeros(k)
        for b in batches:
            if b.num_rows:
                at = np.clip(((kernel.raw(_read(b, STATS)) + 0.5) / 2 * k).astype(int), 0, k - 1)
                y = b.column(len(STATS)).to_numpy(zero_copy_only=False)
                low += np.bincount(at[y == 0], minlength=k)
                high += np.bincount(at[y == 1], minlength=k)
        used = np.flatnonzero(low + high)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(low[used]), pa.array(high[used])], names=["bin", "low", "high"])

    got = rows.select(*STATS, "label").mapInArrow(bins, "bin long, low double, high double").groupBy("bin").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).orderBy("bin").collect()
    low, high = (np.array([r[c] for r in got]) for c in ("low", "high"))
    if min(low.sum(), high.sum()) < 1:
        kernel.values = np.array([0.0, 1.0])
        return kernel
    # labels weigh alike, as in the equations
    wl, wh = low / low.sum(), high / high.sum()
    kernel.knots = (np.array([r["bin"] for r in got]) + 0.5) / k * 2 - 0.5
    kernel.values = isotonic(wh / (wl + wh), wl + wh)
    return kernel


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality", train=None) -> DataFrame:
    """Statistics of labelled documents outside the held-out fold; both tables have doc_id."""
    lab = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label is not null")
    lab = lab.where(crc_fold(F.col("doc_id"), 3) != 1 if train is None else train)
    return stats.join(lab, "doc_id").select(*STATS, "label", (crc_fold(F.col("doc_id"), 5) == 0).alias("calibrate"))


def score(stats: DataFrame, kernel: Kernel, keep: list[str]) -> DataFrame:
    """keep, score and predicted of every row of statistics."""
    n = len(STATS)

    def run(batches):
        for b in batches:
            p = kernel.score(_read(b, STATS)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[n:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = T.StructType([stats.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return stats.select(*STATS, *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return statistics(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text").drop("text")
