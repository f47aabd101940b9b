"""Near copies of vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe and verified pairs.

A hash rotates a unit vector by three rounds of random signs and a fast Hadamard transform; its value is the axis of
largest magnitude, with its sign. A table joins HASHES such values. Every vector goes to all buckets that its PROBES
largest axes name, so two vectors meet if any of theirs agree. Members of a bucket are compared in blocks, by inner
products in double precision, each pair in its first common bucket only. A block returns, for each vector, its number of
links and the least vector that it reaches inside the block; pairs are never listed. Equal vectors are one node of a weight.

At cosine 0.9 in 64 dimensions two vectors agree in a table with probability 0.68, so TABLES = 10 miss one pair in 90,000.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is its
own component; vectors of different lengths never link; rows without an id are members without a name (they count as
links of others and have no component); rows that share an id and a vector count as two vectors; other columns play no
part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, mix64, written
from .components import components

COSINE, TABLES, HASHES, PROBES, SEED = 0.9, 10, 2, 2, 3
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of the rows of x, whose length is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """rows x tables x (probes ** hashes): the buckets of unit vectors; those of one table are sorted."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng, out = np.random.default_rng([seed, d]), []
    probes = min(probes, width)
    for t in range(tables):
        key = np.full((n, 1), t * 1_000_003 + d, np.uint64)
        for _ in range(hashes):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            value = (top * 2 + (np.take_along_axis(y, top, 1) > 0)).astype(np.uint64)
            key = mix64(key[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + value[:, None, :] + np.uint64(1)).reshape(n, -1)
        out.append(np.sort(key, axis=1))
    return np.stack(out, axis=1).view(np.int64)


def _usable(row) -> np.ndarray | None:
    if not row or None in row:
        return None
    v = np.array(row, float)
    if not np.isfinite(v).all():
        return None
    # scaled first, so that neither very large nor very small components lose their norm
    top = np.abs(v).max()
    return v / top / np.linalg.norm(v / top) if top else None


def hashed(df: DataFrame) -> DataFrame:
    """vec_id, node (hash of the unit vector), unit (its bytes) and keys of df (vec_id, embedding array<double>)."""
    import xxhash

    def run(batches):
        for b in batches:
            ids, rows = b.column(0), [_usable(r) for r in b.column(1).to_pylist()]
            keys: list = [None] * len(rows)
            for d in {len(r) for r in rows if r is not None}:
                at = [i for i, r in enumerate(rows) if r is not None and len(r) == d]
                for i, k in zip(at, bucket_keys(np.array([rows[i] for i in at])).reshape(len(at), -1), strict=True):
                    keys[i] = k.tolist()
            unit = [None if r is None else (r + 0.0).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if u is None else xxhash.xxh3_64_intdigest(u) - (1 << 63) for u in unit], pa.int64()), pa.array(unit, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "node", "unit", "keys"])

    return df.mapInArrow(run, "vec_id long, node long, unit binary, keys array<long>")


def _first_common(p: np.ndarray, q: np.ndarray, key: int) -> np.ndarray:
    """Which pairs have key as the least common bucket of the first table in which they have one."""
    alive, out = np.arange(len(p)), np.zeros(len(p), bool)
    for t in range(p.shape[1]):
        same = (p[alive, t, :, None] == q[alive, t, None, :]).any(2)
        some = same.any(1)
        first = p[alive, t][np.arange(len(alive)), same.argmax(1)]
        out[alive[some & (first == key)]] = True
        alive = alive[~some]
        if not len(alive):
            break
    return out


def _reach(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least index that each of n vertices reaches over the edges (p, q)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[p], at[q])
        new = at.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = np.minimum(new, new[new])
        if (new == at).all():
            return at
        at = new


def _linked(rows: DataFrame, cosine: float) -> DataFrame:
    """node, links (weight of the nodes linked to it in a block) and least (a node that it reaches) by block."""
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for (key, i, j), t in grouped(batches, ["key", "i", "j"]):
            node, weight, side = (t[n].to_numpy() for n in ("node", "weight", "side"))
            unit, members = t["unit"].to_pylist(), t["keys"].to_pylist()
            size, found = np.array([len(u) for u in unit]), []
            # vectors of another length may share a key by chance; they are not compared
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                x = np.frombuffer(b"".join(unit[k] for k in mine), float).reshape(len(mine), -1)
                keys = np.array([members[k] for k in mine], np.int64).reshape(len(mine), TABLES, -1)
                left, right = (np.arange(len(mine)),) * 2 if i == j else (np.flatnonzero(side[mine] == 0), np.flatnonzero(side[mine] == 1))
                for at in range(0, len(left), 256):
                    some = left[at : at + 256]
                    p, q = np.nonzero(x[some] @ x[right].T >= cosine)
                    p, q = some[p], right[q]
                    if i == j:
                        p, q = p[p < q], q[p < q]
                    for k in range(0, len(p), 1 << 16):
                        a, b = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                        own = _first_common(keys[a], keys[b], key)
                        found.append(np.column_stack([mine[a[own]], mine[b[own]]]))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if not len(pairs):
                continue
            p, q = pairs.T
            links = np.bincount(p, weight[q], len(node)) + np.bincount(q, weight[p], len(node))
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[_reach(len(node), p, q)[hit]])], names=["node", "links", "least"])

    return rows.select("key", "i", "j", "node", "weight", "side", "unit", "keys").mapInArrow(run, "node long, links long, least long")


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    signed = written(hashed(df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))), "vectors")
    good = signed.where("node is not null")
    nodes = written(good.groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("unit").alias("unit"), F.first("keys").alias("keys")), "nodes")
    members = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    inside = written(members.join(buckets, "key"), "buckets")
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = inside.withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")}).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "node", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"))
    rows = dealt.join(nodes.select("node", "weight", "unit", "keys"), "node")
    found = written(_linked(rows, cosine), "found")
    final = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "vec_id", "weight").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = written(named.join(ids, "component").join(count, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "classes")
    out = signed.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
