"""Near copies by MinHash bands and sequential Bayesian verification.

1. One pass over the texts: each document's set of five-word shingles (64-bit hashes), of it a fingerprint, SIGNATURE
   minimum hashes (a byte each) and BANDS keys of ROWS full minimum hashes. Documents with equal sets are one node.
2. Documents that share a key are candidates. First each is compared with the least node of its bucket, which is linear
   however large the bucket; links found give provisional components. Then, in buckets with several components, documents
   of different ones are compared, in blocks of bounded size, each pair in its first shared band only. Pairs within a
   component need no comparison: they are connected already. A block returns which nodes it connects, never its pairs.
3. A comparison reads the signatures in batches of STEP. After each, the pair goes if the posterior probability (uniform
   prior) that its similarity reaches the threshold is under MISS. Survivors are verified on their full sets, in a block
   likeliest first and only if no chain of links connects them yet.
4. Components of all verified links; a document's is the least id in it.

At similarity 0.85 a pair shares no band with probability (1 - 0.85 ** ROWS) ** BANDS < 1e-6. Nothing is capped: buckets
of any size are taken whole, in blocks.

Defined cases: null and wordless texts have no shingles, link with nothing and are kept; shorter texts than five words
have one shingle, the whole sequence; rows without an id link with nothing, have no component and are kept; rows that
share an id and a text are alike (deduplicate() keeps one of them); other columns play no part.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, discard, grouped, hidden, mix64, sift, written
from .components import components

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, SIGNATURE, STEP, MISS = 24, 5, 512, 64, 1e-6
#: Members of a side of a block, and shingles of their sets together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Partners of a hub that are verified in one group.
PARTNERS = 4096
#: Words whose hashes a worker remembers.
CACHE = 500_000

_rng = np.random.default_rng(5)
_MUL = (_rng.integers(0, 1 << 32, SIGNATURE, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SIGNATURE, np.uint64).astype(np.uint32)
_PLACE = [np.uint64(x) for x in _rng.integers(1 << 60, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _forget() -> None:
    _words.clear()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    # bytes know ASCII letters and ASCII white space only
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    h = w[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        h = mix64(h) + w[j : n - k + 1 + j] * _PLACE[j]
    return np.unique(mix64(h + np.uint64(k)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """SIGNATURE x documents: least permuted hashes of sets that are not empty."""
    out = np.empty((SIGNATURE, len(sets)), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 15):
            n += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        size = np.array([len(s) for s in sets[i:j]])
        start, v = np.cumsum(size) - size, np.empty_like(x)
        for k in range(SIGNATURE):
            np.multiply(x, _MUL[k], out=v)
            np.add(v, _ADD[k], out=v)
            np.minimum.reduceat(v, start, out=out[k, i:j])
        i = j
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """documents x BANDS."""
    out = np.empty((m.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(m.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[b * ROWS + r])
        out[:, b] = h
    return out.view(np.int64)


def _fingerprint(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), node (fingerprint of the set), signature and bands of docs (doc_id, text)."""

    def run(batches):
        with cached("minhash", _forget):
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for i in range(0, len(texts), 512):
                    sets = [shingles(t) for t in texts[i : i + 512]]
                    full = [k for k, s in enumerate(sets) if len(s)]
                    node, sig, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                    if full:
                        m = minima([sets[k] for k in full])
                        keys = band_keys(m)
                        byte = np.ascontiguousarray(((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T)
                        for r, k in enumerate(full):
                            node[k], sig[k], bands[k] = _fingerprint(sets[k]), byte[r].tobytes(), keys[r].tolist()
                    yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "signature", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, signature binary, bands array<long>")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch, how many of the hashes so far must agree for a pair to go on.

    With a uniform prior and m of n agreeing, similarity reaches t with probability P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(STEP, SIGNATURE + 1, STEP):
        p = 0.0
        for m in range(n + 1):
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= miss:
                break
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature arrays survive all batches, and how many of their hashes agree."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(need):
        cols = slice(k * STEP, (k + 1) * STEP)
        seen = seen + (a[alive, cols] == b[alive, cols]).sum(1)
        go = seen >= least
        alive, seen = alive[go], seen[go]
        if not len(alive):
            break
    return alive, seen


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def prune(pairs: DataFrame, nodes: DataFrame, need: list[int]) -> DataFrame:
    """The plausible ones of pairs (a, b, parts)."""
    s = nodes.select("node", "signature")
    both = pairs.join(s.withColumnsRenamed({"node": "a", "signature": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "signature": "sb"}), "b").select("a", "b", "parts", "sa", "sb")

    def run(batches):
        for x in batches:
            if x.num_rows:
                alive, _ = plausible(_signatures(x.column(3)), _signatures(x.column(4)), need)
                yield x.select(["a", "b", "parts"]).take(pa.array(alive))

    return both.mapInArrow(run, "a long, b long, parts int")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    All partners of a node come after its own set, in as many groups as parts says; one set of each side is held at a time.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    hubs = pairs.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "members")
    partners = pairs.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "members")
    rows = hubs.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        hub, own = None, None
        for x in batches:
            found = []
            for a, part, b, members in zip(*(c.to_pylist() for c in x.columns), strict=True):
                s = np.frombuffer(members, np.uint64)
                if b is None:
                    hub, own = (a, part), s
                elif hub == (a, part) and similar(own, s, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(docs: DataFrame) -> DataFrame:
    """node and members (its set's sorted hashes) of docs (doc_id, text)."""

    def run(batches):
        with cached("minhash", _forget):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for i in range(0, len(texts), 256):
                    s = [x for t in texts[i : i + 256] if len(x := shingles(t))]
                    yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], names=["node", "members"])

    return docs.mapInArrow(run, "node long, members binary")


def _across(rows: DataFrame, need: list[int], percent: int) -> DataFrame:
    """Links (a, b) that connect the components of rows (key, kind, i, j, node, label, side, signature, bands, members).

    Kind 0 sets the bucket's largest component against the others; kind 1 sets the others against each other, blocks
    i and j of them.
    """
    rows = rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")

    def block(kind, i, j, key, part):
        node, label, side, sig, bands, members = part
        if kind == 0 or i != j:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            p, q = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            p, q = np.triu_indices(len(node), 1)
        go = label[p] != label[q]
        p, q = p[go], q[go]
        found = []
        # in pieces, so that memory is bounded
        for at in range(0, len(p), 1 << 16):
            a, b = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
            alive, agree = plausible(sig[a], sig[b], need)
            a, b = a[alive], b[alive]
            same = bands[a] == bands[b]
            go = bands[a, same.argmax(1)] == key
            found.append(np.column_stack([a[go], b[go], agree[go]]).astype(np.int32))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int32)
        root = dict.fromkeys(label.tolist())
        root = {x: x for x in root}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links, sets = [], {}
        for a, b, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
            if (x := top(label[a])) != (y := top(label[b])):
                for k in (a, b):
                    if k not in sets:
                        sets[k] = np.frombuffer(members[k].as_py(), np.uint64)
                if similar(sets[a], sets[b], percent):
                    root[x] = y
                    links.append((node[a], node[b]))
        return links

    def run(batches):
        for (key, kind, i, j), t in grouped(batches, ["key", "kind", "i", "j"]):
            part = [t[n].to_numpy() for n in ("node", "label", "side")] + [_signatures(t["signature"]), t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS), t["members"]]
            links = block(kind, i, j, key, part)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("key", "kind", "i", "j", "node", "label", "side", "signature", "bands", "members").mapInArrow(run, "a long, b long")


def _blocks(rest: DataFrame, keys: DataFrame) -> DataFrame:
    """Deals members of unsettled buckets (key, node, label) to blocks; keys: key, top (largest component), number and shingles of its members and of the others."""
    many = lambda n, size: F.greatest(F.ceil(F.col(n) / F.lit(BLOCK)), F.ceil(F.col(size) / F.lit(BLOCK_SHINGLES))).cast("int")
    d = rest.join(keys, "key").withColumns({"main": F.col("label") == F.col("top"), "cm": many("n_top", "size_top"), "cr": many("n_other", "size_other")})
    own = F.when(F.col("main"), F.pmod(F.xxhash64("node"), F.col("cm"))).otherwise(F.pmod(F.xxhash64("node"), F.col("cr"))).cast("int")
    d = d.withColumn("own", own)
    against = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("cr")).otherwise(F.col("cm")) - 1)))
    against = against.select("key", "node", "label", F.lit(0).alias("kind"), F.when(F.col("main"), F.col("own")).otherwise(F.col("o")).alias("i"), F.when(F.col("main"), F.col("o")).otherwise(F.col("own")).alias("j"), F.when(F.col("main"), 0).otherwise(1).alias("side"))
    among = d.where("not main and n_other > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cr") - 1)))
    among = among.select("key", "node", "label", F.lit(1).alias("kind"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"))
    return against.union(among)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = written(sign(docs), "signed")
    full = signed.where("n > 0 and doc_id is not null")
    # signatures and texts are large: exchanges hold those of rows that meet others only
    copied = written(full.groupBy("node").count().where("count > 1").select("node"), "copied")
    several, single = sift(full, "node", copied)
    least = several.groupBy("node").agg(F.min(F.struct("doc_id", "n", "signature", "bands")).alias("r"))
    least = least.select("node", *[F.col(f"r.{c}").alias(c) for c in ("doc_id", "n", "signature", "bands")])
    nodes = written(least.union(single.select(least.columns)), "nodes")
    rows = written(signed.select("doc_id", "n", "node"), "rows")
    discard(signed, copied)
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = written(members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"), "buckets")
    shared = written(sift(members, "key", buckets.select("key"))[0].join(buckets, "key"), "members")
    some = written(shared.select("node").distinct(), "some")
    met = written(sift(nodes, "node", some)[0].join(some, "node", "left_semi"), "met")
    names = written(nodes.select("node", "doc_id"), "names")
    discard(nodes, some)
    need = least_matches(percent)

    some = met.select("doc_id")
    sets = written(_sets(sift(docs, "doc_id", some)[0].join(some, "doc_id", "left_semi")), "sets")
    stars = shared.where("node <> least").groupBy(F.col("least").alias("a"), F.col("node").alias("b")).agg(F.ceil(F.max("size") / F.lit(PARTNERS)).cast("int").alias("parts"))
    first = written(verify(prune(stars, met, need), sets, percent), "links")
    label = written(components(first), "labels")

    # buckets whose members are of several components; their least nodes have met all others
    rest = shared.where("size > 2 and node <> least").select("key", "node", "n").join(label, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    tally = rest.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    tally = tally.groupBy("key").agg(F.max(F.struct("rows", "n", "label")).alias("m"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    keys = written(tally.select("key", F.col("m.label").alias("top"), F.col("m.rows").alias("n_top"), (F.col("rows") - F.col("m.rows")).alias("n_other"), F.col("m.n").alias("size_top"), (F.col("n") - F.col("m.n")).alias("size_other")), "keys")
    dealt = _blocks(rest.select("key", "node", "label"), keys)
    second = _across(dealt.join(met.select("node", "signature", "bands").join(sets, "node"), "node"), need, percent)
    links = second.union(label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))

    final = components(links)
    named = names.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(named.join(ids, "component").select("node", "component_id"), "classes")
    discard(buckets, shared, met, names, sets, first, label, keys)
    out = rows.join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one document of each class, and its own columns only."""
    gone_id, = hidden(docs.columns, "gone")
    found = written(classes(docs, doc_id, text, percent).select("doc_id", "n_shingles", "kept"), "found")
    gone = written(found.where("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    may, stay = sift(docs, doc_id, gone)
    out = may.join(gone, may[f"`{doc_id}`"] == F.col(gone_id), "left_anti").union(stay)
    # rows that share an id: only then are rows compared with each other
    if found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").limit(1).count():
        some = out.where(F.col(f"`{doc_id}`").isNotNull()).dropDuplicates([doc_id])
        out = some.union(out.where(F.col(f"`{doc_id}`").isNull()))
    return out
