"""Quality rules: fixed base rules, then a learned list of threshold conjunctions, all in DataFrame expressions.

statistics() counts words, characters, symbols, repeated lines and repeated three-word windows inside each row; nothing
is shuffled. learn() grows a decision list on labelled statistics by sequential covering: a rule starts empty and takes,
again and again, the condition (a statistic at least, or below, a threshold) of highest information gain on two thirds
of the labelled rows; then its last conditions go if that makes it more precise on the other third. A rule stays if it
is precise enough there; the rows that it covers leave; the next rule follows. Each step is one aggregation over binned
statistics, so that all labelled rows count and none reach the driver. The list is applied as one CASE expression.

Defined cases: a null or empty text has no words and fails the base rules; rows without a label, or with a null label,
are not learned from; several labels of one document count each; without labels of both kinds the list is empty and the
base rules alone decide; columns of the input named like a statistic are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, bound, crc_fold, hidden, written

SYMBOLS = "#*$%&|<>"
#: Base rules: fewer words fail, and so do more repeated words than this per cent of all.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Learning: bins of each statistic, conditions of a rule, rules of a list, precision on the pruning rows, least rows covered there.
BINS, CONDITIONS, RULES, PRECISION, LEAST = 48, 4, 12, 0.95, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks", "n_lines", "n_distinct_words"]


def statistics(df: DataFrame, text: str) -> DataFrame:
    """df with COUNTS and MORE (all long) of its text."""
    own = [*COUNTS, *MORE]
    df = df.select(*[c for c in (f"`{c}`" for c in df.columns if c not in own or c == text)])
    t, w, h, z, lines, at, s = hidden(df.columns, "t", "w", "h", "z", "lines", "at", "s")
    col = F.col
    gone = lambda chars: F.length(t) - F.length(F.translate(col(t), chars, ""))
    has_word = lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0
    out = df.withColumn(t, F.coalesce(F.trim(col(f"`{text}`"), F.lit(SPACE)), F.lit("")))
    out = out.withColumns({w: F.when(col(t) == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS, -1)), lines: F.filter(F.split(F.coalesce(col(f"`{text}`"), F.lit("")), "\n", -1), has_word)})
    # the hash of each window of three words
    out = out.withColumn(h, F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(col(w), i + 1), F.get(col(w), i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))
    # (hash, place) in order, only where a window comes twice
    out = out.withColumn(z, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(x["h"] == F.get(col(z), k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(col(z), k + 1)["h"], F.lit(False))
    out = out.withColumn(at, F.when(F.size(z) > 0, F.sort_array(F.transform(F.filter(z, same), lambda x: x["i"]))))
    # windows from p on hold words p, p+1, p+2: each adds what the one before has not counted
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(3))).alias("n")), lambda a: a["n"])
    counts = {
        "n_words": F.size(w), "word_chars": F.length(F.translate(col(t), SPACE, "")), "n_symbols": gone(SYMBOLS), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_marks": gone("!?"), "n_lines": F.size(lines), "n_distinct_words": F.size(F.array_distinct(w)),
    }
    keep = [c for c in df.columns if c not in own]
    out = bound(out, s, F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))
    return out.select(*[f"`{c}`" for c in keep], *[F.col(s)[k].alias(k) for k in counts])


def features() -> dict[str, Column]:
    """What conditions are about, as whole numbers: statistics, and statistics in thousandths of others."""
    c = F.col
    part = lambda a, b: F.floor(1000 * c(a) / F.greatest(c(b), F.lit(1))).cast("long")
    return {"words": c("n_words"), "word_length": part("word_chars", "n_words"), "symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "upper": part("n_upper", "word_chars"), "marks": part("n_marks", "word_chars"), "distinct": part("n_distinct_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    least: bool  # at least the threshold, or below it
    threshold: int

    def column(self) -> Column:
        f = features()[self.feature]
        return f >= self.threshold if self.least else f < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<'} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: tuple[int, int] = (0, 0)  # (low, high) quality on the pruning rows

    def column(self) -> Column:
        return _all(c.column() for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def labelled(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """A table of statistics (with doc_id) of labelled documents with their label, in the shared folder."""
    lab = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label is not null")
    return written(stats.select("doc_id", *COUNTS, *MORE).join(lab, "doc_id"), "labelled")


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list that rejects documents of label 0; rows as of labelled_statistics()."""
    names = [*features()]
    rows = rows.where(~base_failed())
    grow = crc_fold(F.col("doc_id"), 3) != 0
    f = features()
    edges = _edges(rows, f)
    if not any(edges.values()):
        return []
    # a value's bin is the number of edges not above it; so conditions on bins are conditions on values
    binned = written(rows.select(F.col("label"), grow.alias("grow"), *[_bin(f[n], edges[n]).alias(n) for n in names]), "binned")

    def test(c: Condition) -> Column:
        k = edges[c.feature].index(c.threshold) + 1
        return F.col(c.feature) >= k if c.least else F.col(c.feature) < k

    rest, rules = F.lit(True), []
    while len(rules) < RULES:
        rule: list[Condition] = []
        while len(rule) < CONDITIONS:
            best, clean = _grow(binned.where(F.col("grow") & rest & _all(map(test, rule))), names, edges)
            if best is None:
                break
            rule.append(best)
            if clean:
                break
        rule, covered = _prune(binned.where(~F.col("grow") & rest), rule, test)
        if not rule:
            break
        rules.append(Rule(tuple(rule), covered))
        rest = rest & ~_all(map(test, rule))
    return rules


def _edges(rows: DataFrame, f: dict[str, Column]) -> dict[str, list[int]]:
    """Quantiles of each feature, of all rows. Values are counted by their first three digits, of which there are few."""
    tens = {n: F.pow(F.lit(10), F.greatest(F.length(c.cast("string")) - 3, F.lit(0))).cast("long") for n, c in f.items()}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), (c - F.pmod(c, tens[n])).alias("v")) for n, c in f.items()])).alias("cell")
    counts: dict[str, list[tuple[int, int]]] = {n: [] for n in f}
    for r in rows.select(cells).groupBy("cell.f", "cell.v").count().collect():
        counts[r["f"]].append((r["v"], r["count"]))
    out = {}
    for n, cell in counts.items():
        ranks = [-(-k * sum(c for _, c in cell) // BINS) for k in range(1, BINS)]
        found, under = set(), 0
        for v, c in sorted(cell):
            if any(under < k <= under + c for k in ranks):
                found.add(v)
            under += c
        out[n] = sorted(found)
    return out


def _bin(value: Column, edges: list[int]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return out


def _grow(rows: DataFrame, names: list[str], edges: dict) -> tuple[Condition | None, bool]:
    """The condition of highest gain, and whether it leaves no row of label 1."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("bin")) for i, n in enumerate(names)])).alias("cell")
    counts = rows.select("label", cells).groupBy("cell.f", "cell.bin").agg(F.sum((F.col("label") == 0).cast("long")).alias("low"), F.sum((F.col("label") != 0).cast("long")).alias("high")).collect()
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["bin"]] = (r["low"], r["high"])
    best = (1e-9, None, False)
    for i, n in enumerate(names):
        cell = by.get(i, {})
        low, high = sum(x[0] for x in cell.values()), sum(x[1] for x in cell.values())
        if not low or not high:
            return None, not high
        under = [0, 0]
        for k, e in enumerate(edges[n], 1):
            under = [u + x for u, x in zip(under, cell.get(k - 1, (0, 0)), strict=True)]
            for least, (p, q) in ((False, under), (True, (low - under[0], high - under[1]))):
                if p and (gain := p * (log2(p / (p + q)) - log2(low / (low + high)))) > best[0]:
                    best = (gain, Condition(n, least, e), q == 0)
    return best[1], best[2]


def _prune(rows: DataFrame, rule: list[Condition], test) -> tuple[list[Condition], tuple[int, int]]:
    """The shortest beginning of the rule that is most precise on rows; nothing if that is not precise enough."""
    if not rule:
        return [], (0, 0)
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all(map(test, rule[:k]))
        sums += [F.sum((hit & (F.col("label") == 0)).cast("long")).alias(f"p{k}"), F.sum((hit & (F.col("label") != 0)).cast("long")).alias(f"q{k}")]
    r = rows.agg(*sums).first()
    worth = [((r[f"p{k}"] or 0) / max(1, (r[f"p{k}"] or 0) + (r[f"q{k}"] or 0)), -k) for k in range(1, len(rule) + 1)]
    precision, k = max(worth)
    covered = (r[f"p{-k}"] or 0, r[f"q{-k}"] or 0)
    return (rule[:-k], covered) if precision >= PRECISION and covered[0] >= LEAST else ([], covered)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, from 1; 0 for rows that all rules let pass; -1 where the base rules fail."""
    out = F.when(base_failed(), -1)
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), k)
    return out.otherwise(0)


def decide(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """A table of statistics with rule, base_failed and kept."""
    return stats.withColumn("rule", verdict(rules)).withColumns({"base_failed": F.col("rule") < 0, "kept": F.col("rule") == 0})


def passing(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents that pass the base rules and the list learned from labels, with their own columns only.

    Statistics are computed once: they are written beside the documents, and learning reads their columns only.
    """
    row, = hidden([*COUNTS, *MORE, "text"], "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{text}`").alias("text"))
    rows = written(statistics(packed, "text").drop("text"), "statistics")
    rules = learn(labelled(rows.withColumn("doc_id", F.col(row).getField(doc_id)).drop(row), labels, doc_id, label))
    return decide(rows, rules).where("kept").select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
