"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed up by membership pattern (the set of sources they count for). Flow runs from each pattern, one arc
for each repetition at the convex cost of its number, to the sources of the pattern, and from each source to the sink
at the capacity of its quota. The least cost says how many words each pattern gives: whole passes over its documents and
a rest. The rest goes to documents in the order of a seeded hash: a histogram of hashes finds the cell where the rest
runs out; cells before it are taken whole, and documents from there on if they fit, the last few so chosen that little is
left. While words are left, the search goes on after these among the documents that are no longer than that, to the end of
the hashes: what is left at last is less than any document (equal rows count as one) that is left out.

Only patterns (their number is bounded by MOST_PATTERNS), histogram cells and the documents of the cells where a search of
a pattern ends (a bounded number of hashes) reach the driver.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, after all
others; documents of no source are not taken; equal rows have one hash and are taken or left together; a null id is hashed as
null; an empty table gives an empty mix. Columns of the input stay as they are; the plan's own are named in decide().
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, written

WEIGHTS, SHARE, COPIES, SEED = (5, 2, 1), 1.5, 2, 11
MOST_PATTERNS, CELL, MOST_LEAVES = 20_000, 512, 4096
#: The last documents of a pattern that are chosen together, and the steps in which their sizes are counted for that.
TAIL, TAIL_STEPS = 16, 1 << 22
#: The greatest hash.
LAST = (1 << 63) - 1
#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, share: float = SHARE, weights=WEIGHTS, copies: int = COPIES) -> dict:
    """Words each source should give: share of all sizes by weight, at most copies times its size, the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > copies * sizes[s]]
        if not full:
            out.update((s, unit * weight[s]) for s in open_)
            break
        for s in full:
            out[s] = float(copies * sizes[s])
            left -= out[s]
            open_.remove(s)
    return {s: out[s] for s in order}


class Flow:
    """Min-cost flow by successive shortest paths with potentials; all costs are at least 0."""

    def __init__(self):
        self.arcs: list[list] = []  # to, capacity, cost; the reverse arc is at the index xor 1
        self.out: dict[object, list[int]] = {}

    def arc(self, a, b, capacity: int, cost: int = 0) -> int:
        for u, v, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(u, []).append(len(self.arcs))
            self.out.setdefault(v, [])
            self.arcs.append([v, c, w])
        return len(self.arcs) - 2

    def run(self, source, sink) -> int:
        potential, total = dict.fromkeys(self.out, 0), 0
        while True:
            far, via, todo, n = {source: 0}, {}, [(0, 0, source)], 1
            done = set()
            while todo:
                d, _, u = heapq.heappop(todo)
                if u in done:
                    continue
                done.add(u)
                for k in self.out[u]:
                    v, c, w = self.arcs[k]
                    if c and v not in done and (e := d + w + potential[u] - potential[v]) < far.get(v, float("inf")):
                        far[v], via[v] = e, k
                        heapq.heappush(todo, (e, n, v))
                        n += 1
            if sink not in far:
                return total
            most = max(far.values())
            for u in potential:
                potential[u] += far.get(u, most)
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.arcs[via[v] ^ 1][0]
            push = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= push
                self.arcs[k ^ 1][1] += push
            total += push

    def sent(self, k: int) -> int:
        return self.arcs[k ^ 1][1]


def route(patterns: dict[tuple, int], quotas: dict, copies: int = COPIES) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources."""
    f, arcs = Flow(), {}
    for p, size in patterns.items():
        for k in range(1, copies + 1):
            f.arc("from", ("pattern", p), size, k * k)
        arcs[p] = {s: f.arc(("pattern", p), ("source", s), copies * size) for s in p}
    for s, q in quotas.items():
        f.arc(("source", s), "to", floor(q + 0.5))
    if patterns:
        f.run("from", "to")
    return {p: {s: f.sent(k) for s, k in a.items()} for p, a in arcs.items()}


@dataclass
class Plan:
    sizes: dict  # by source
    targets: dict
    flows: dict  # by pattern and source
    by_pattern: DataFrame  # pattern, passes, cuts (stretches of hashes, and the most words of documents taken once more there), source_size, target
    leaves: DataFrame  # pattern, hash: taken once more as well
    small: bool


def _keys(df: DataFrame, members: Column, text: Column, doc_id: Column, names: list[str], seed: int = SEED) -> DataFrame:
    """df with pattern (JSON of its sorted sources), hash (63 bits) and size."""
    pattern, hash_, size = names
    m = F.array_sort(F.array_distinct(members))
    return df.withColumns({pattern: F.to_json(F.coalesce(m, F.array().cast("array<string>"))), hash_: F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1), size: F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")})


def plan_mix(rows: DataFrame, share: float = SHARE, weights=WEIGHTS, copies: int = COPIES) -> Plan:
    """rows: pattern, hash and size of every document, as a table."""
    import json

    spark = rows.sparkSession
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns; merge sources first")
    count = {r["pattern"]: r["n"] for r in found}
    patterns = {tuple(json.loads(r["pattern"])): r["size"] for r in found}
    name = {tuple(json.loads(r["pattern"])): r["pattern"] for r in found}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    want = targets(sizes, share, weights, copies)
    flows = route({p: s for p, s in patterns.items() if p}, want, copies)
    passes, rest = {}, {}
    for p, f in flows.items():
        passes[p], rest[p] = divmod(sum(f.values()), patterns[p]) if patterns[p] else (0, 0)
    cuts, leaves = _cuts(rows, {name[p]: r for p, r in rest.items() if r}, count)
    listing = [(name[p], passes.get(p, 0), cuts.get(name[p], []), sum(sizes[s] for s in p) if p else None, float(sum(want[s] for s in p)) if p else None) for p in patterns]
    return Plan(sizes, want, flows, spark.createDataFrame(listing, "pattern string, passes long, cuts array<struct<low: long, last: long, most: long>>, source_size long, target double"), spark.createDataFrame(leaves, "pattern string, hash long"), len(leaves) <= 200_000)


def _cuts(rows: DataFrame, rest: dict[str, int], count: dict[str, int]) -> tuple[dict[str, list[tuple[int, int, int]]], list[tuple[str, int]]]:
    """For each pattern the stretches (low, last, most) of the hash line of which documents of at most most words are taken, and hashes taken besides."""
    spark = rows.sparkSession
    rows = rows.where("size > 0")
    left, cuts, leaves = dict(rest), {p: [] for p in rest}, []
    # from where each pattern goes on; documents before that are decided on, those left out are longer than what is left
    go = dict.fromkeys(rest, 0)
    while go:
        most = {p: left[p] for p in go}
        # the part of the hash line under search: from low, cells of 2 ** shift
        search = {p: (low, 63 - max(0, min(12, (count[p] // CELL).bit_length()))) for p, low in go.items()}
        window: dict[str, tuple[int, int]] = {}
        while search:
            s = F.broadcast(spark.createDataFrame([(p, low, shift, most[p]) for p, (low, shift) in search.items()], "pattern string, low long, shift int, most long"))
            inside = rows.join(s, "pattern").where((F.col("size") <= F.col("most")) & (F.col("hash") >= F.col("low")) & (F.expr("shiftright(hash - low, shift)") < 4096))
            cells = inside.groupBy("pattern", F.expr("shiftright(hash - low, shift)").alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in cells:
                by.setdefault(r["pattern"], {})[r["cell"]] = (r["size"], r["n"])
            again = {}
            for p, (low, shift) in search.items():
                cell = by.get(p, {})
                order, k = sorted(cell), 0
                while k < len(order) and cell[order[k]][0] <= left[p]:
                    left[p] -= cell[order[k]][0]
                    k += 1
                if k == len(order):
                    # cells of a part searched again do not all fit, so this is the whole line from go[p] on
                    cuts[p].append((go[p], LAST, most[p]))
                    continue
                start, n = low + (order[k] << shift), cell[order[k]][1]
                if n > MOST_LEAVES and shift:
                    again[p] = (start, max(0, shift - 12))
                    continue
                # the last cell, and as many after it as stay few
                while k + 1 < len(order) and n + cell[order[k + 1]][1] <= CELL:
                    k += 1
                    n += cell[order[k]][1]
                whole = k + 1 == len(order) and low + (4096 << shift) > LAST
                window[p] = (start, LAST if whole else min(low + (order[k] + 1 << shift) - 1, LAST))
                if start > go[p]:
                    cuts[p].append((go[p], start - 1, most[p]))
            search = again
        if not window:
            break
        s = F.broadcast(spark.createDataFrame([(p, start, last, most[p]) for p, (start, last) in window.items()], "pattern string, start long, last long, most long"))
        near = rows.join(s, "pattern").where((F.col("size") <= F.col("most")) & (F.col("hash") >= F.col("start")) & (F.col("hash") <= F.col("last"))).groupBy("pattern", "hash").agg(F.sum("size").alias("size")).collect()
        by_pattern: dict[str, list[tuple[int, int]]] = {}
        for r in near:
            by_pattern.setdefault(r["pattern"], []).append((r["hash"], r["size"]))
        for p in sorted(by_pattern):
            taken, size = _fitting(sorted(by_pattern[p]), left[p]), dict(by_pattern[p])
            left[p] -= sum(size[h] for h in taken)
            leaves += [(p, h) for h in taken]
        go = {p: last + 1 for p, (_, last) in window.items() if left[p] and last < LAST}
    return cuts, leaves


def _fitting(docs: list[tuple[int, int]], left: int) -> list[int]:
    """Hashes of the documents (hash, size) that fit, in order; the last ones are chosen so that little is left.

    What is left is less than any document that is left out.
    """
    taken, over = [], []
    for d in docs:
        if d[1] <= left:
            left -= d[1]
            taken.append(d)
        else:
            over.append(d)
    open_: list[tuple[int, int]] = []
    while taken and len(open_) < TAIL:
        open_.append(taken.pop())
        left += open_[-1][1]
    # what was taken comes first; sizes are rounded up to steps, so that what is chosen fits
    open_ += [d for d in over if d[1] <= left][: 4 * TAIL - len(open_)]
    step = -(-left // TAIL_STEPS) or 1
    # bit k of a row: k steps can be reached with the documents so far
    rows, mask = [1], (1 << (left // step + 1)) - 1
    for _, size in open_:
        rows.append((rows[-1] | rows[-1] << -(-size // step)) & mask)
    at, chosen = rows[-1].bit_length() - 1, set()
    for k in range(len(open_), 0, -1):
        if not rows[k - 1] >> at & 1:
            chosen.add(open_[k - 1][0])
            at -= -(-open_[k - 1][1] // step)
    left -= sum(size for h, size in open_ if h in chosen)
    # whatever still fits, so that what is left is less than any document that is left out
    for h, size in sorted([d for d in {*open_, *over} if d[0] not in chosen]):
        if size <= left:
            left -= size
            chosen.add(h)
    return [h for h, _ in taken] + sorted(chosen)


def decide(df: DataFrame, plan: Plan, names: list[str]) -> DataFrame:
    """df, which has the plan's keys under names, with __copies, __source_size and __target."""
    pattern, hash_, size = names
    hint = F.broadcast if plan.small else (lambda x: x)
    p = F.broadcast(plan.by_pattern.select(F.col("pattern").alias("__p"), "passes", "cuts", F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    leaf = hint(plan.leaves.select(F.col("pattern").alias("__lp"), F.col("hash").alias("__lh"), F.lit(1).alias("__leaf")))
    out = df.join(p, F.col(pattern) == F.col("__p"), "left").join(leaf, (F.col(pattern) == F.col("__lp")) & (F.col(hash_) == F.col("__lh")), "left")
    cut = F.exists("cuts", lambda c: (F.col(hash_) >= c["low"]) & (F.col(hash_) <= c["last"]) & (F.col(size) <= c["most"]))
    more = (cut | F.col("__leaf").isNotNull()).cast("long")
    copies = F.when(F.col(size) > 0, F.coalesce(F.col("passes") + more, F.lit(0))).otherwise(0)
    return out.withColumn("__copies", copies).drop("__p", "__lp", "__lh", "__leaf", "passes", "cuts")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", members: Column | None = None, seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target (of its sources together), copies and taken of every document.

    members: an array column of the sources that a document counts for; its source, if not given.
    """
    t = F.col(f"`{text}`")
    keyed = _keys(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), _members(members, source).alias("members")), F.col("members"), F.col("text"), F.col("doc_id"), ["pattern", "hash", "size"], seed)
    rows = written(keyed.select("doc_id", "pattern", "hash", "size"), "mix")
    out = decide(rows, plan_mix(rows, **how), ["pattern", "hash", "size"])
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("size") * F.col("__copies")).alias("taken"))


def _members(members: Column | None, source: str) -> Column:
    return F.array(F.col(f"`{source}`").cast("string")) if members is None else members.cast("array<string>")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", members: Column | None = None, seed: int = SEED, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, with their own columns."""
    row, copy = hidden(["pattern", "hash", "size", "members", "text", "doc_id"], "row", "copy")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), _members(members, source).alias("members"))
    keyed = _keys(d, F.col("members"), F.col("text"), F.col("doc_id"), ["pattern", "hash", "size"], seed).drop("members", "text", "doc_id")
    plan = plan_mix(written(keyed.select("pattern", "hash", "size"), "mix"), **how)
    out = decide(keyed, plan, ["pattern", "hash", "size"]).where("__copies > 0")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
