"""Sharded tables: a request of structured predicates, planned into a pruned DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ShardSpec, TableSpec
from ..errors import StratumError
from ..operators.temporal import valid_at, valid_between
from .strategies import Composite, Known, Range, resolve


_COMPARED = re.compile(r"""\s*(?:(?P<c>`[^`]+`|\w+)\s*(?P<op>=|==|<=|>=|<|>)\s*(?P<v>{0})|(?P<v2>{0})\s*(?P<op2>=|==|<=|>=|<|>)\s*(?P<c2>`[^`]+`|\w+))\s*$""".format(r"'(?:[^'\\]|'')*'|-?\d+(?:\.\d+)?|(?:timestamp|timestamp_ntz|date)\s*'[^']*'"), re.I)


def stated(condition: str, schema) -> list[tuple[str, str, object]]:
    """(column, operator, literal) of the plain comparisons that a condition joins by AND. Whatever is anything else, and
    all of a condition with an OR, NOT, CASE or parentheses, says nothing."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", condition)
    if re.search(r"[()]|\b(or|not|case|between|like|in)\b|--|/\*", bare, re.I):
        return []
    out, names = [], {n.lower(): n for n in schema.names}
    marks = [m.span() for m in re.finditer(r"'(?:[^']|'')*'", condition)]
    cuts = [m for m in re.finditer(r"\band\b", condition, re.I) if not any(s <= m.start() < e for s, e in marks)]
    parts = [condition[a:b] for a, b in zip([0, *[m.end() for m in cuts]], [*[m.start() for m in cuts], len(condition)], strict=True)]
    for part in parts:
        if not (m := _COMPARED.match(part)):
            continue
        column, op, text = (m["c"], m["op"], m["v"]) if m["c"] else (m["c2"], m["op2"], m["v2"])
        name = names.get(column.strip("`").lower())
        if name is None:
            continue
        if m["c2"]:
            op = op.translate(str.maketrans("<>", "><"))
        if text[0] == "'":
            value = text[1:-1].replace("''", "'")
        elif text[-1] == "'":
            try:
                value = datetime.fromisoformat(text.split("'")[1].strip())
            except ValueError:
                continue
            if value.tzinfo:
                continue
            value = value.date() if text[:4].lower() == "date" else value
        else:
            value = Decimal(text) if "." in text else int(text)
        out.append((name, "=" if op == "==" else op, value))
    return out


@dataclass
class Session:
    """Defaults that every table read looks at: at most one of a moment and all history."""

    spark: SparkSession
    moment: datetime | None = None
    history: bool = False
    #: Values that columns must have in every table that has them, such as the tenant of a request.
    scope: dict = field(default_factory=dict)

    def scoped(self, **values) -> Session:
        """A session whose reads see rows of these values only, and whose writes may hold no others."""
        return replace(self, scope=self.scope | values)

    def refuse_others(self, rows: DataFrame) -> None:
        """An error if a row is outside the scope."""
        out = F.lit(False)
        for c, v in self.scope.items():
            if c in rows.columns:
                out = out | ~F.col(c).eqNullSafe(F.lit(v))
        if self.scope and rows.where(out).limit(1).count():
            raise StratumError(f"a row is outside {self.scope}")

    def at(self, moment: datetime) -> None:
        self.moment, self.history = moment, False

    def with_history(self) -> None:
        self.moment, self.history = None, True

    def clear(self) -> None:
        self.moment, self.history = None, False


@dataclass(frozen=True)
class ShardedTable:
    """An immutable scan request. read() gives the rows of one or more shards; df() is the planned DataFrame."""

    spec: TableSpec
    session: Session
    source: object  # a layout of stratum.sources
    equal: dict = field(default_factory=dict)
    ranges: dict = field(default_factory=dict)
    moment: datetime | None = None
    span: tuple | None = None
    all: bool = False
    hint: str | None = None
    others: tuple[Column, ...] = ()
    # what conditions of where() say; they prune only, as the conditions stay
    hints: dict = field(default_factory=dict)
    spans: dict = field(default_factory=dict)

    def where_eq(self, **values) -> ShardedTable:
        return replace(self, equal=self.equal | values)

    def where_range(self, column: str, low=None, high=None, closed: bool = True) -> ShardedTable:
        return replace(self, ranges=self.ranges | {column: Range(low, high, closed)})

    def where(self, condition: Column | str) -> ShardedTable:
        """Any condition. Of SQL text, comparisons of a column with a literal that must all hold prune as well, in either
        order of their sides; a Column is left to Catalyst, which pushes it down to the rows."""
        if not isinstance(condition, str):
            return replace(self, others=(*self.others, condition))
        out = self
        for column, op, value in stated(condition, self.spec.schema):
            low, high, closed = (value, None, True) if op in (">", ">=") else (None, value, op == "<=")
            if op == "=":
                out = out if column in out.equal else replace(out, hints=out.hints | {column: value})
            elif column not in out.ranges and column not in out.spans:
                out = replace(out, spans=out.spans | {column: Range(low, high, closed)})
            elif column in out.spans:
                r = out.spans[column]
                out = replace(out, spans=out.spans | {column: Range(r.low if low is None else low, r.high if high is None else high, r.closed if high is None else closed)})
        return replace(out, others=(*out.others, F.expr(condition)))

    def valid_at(self, moment: datetime) -> ShardedTable:
        return replace(self, moment=moment, span=None, all=False)

    def valid_between(self, start: datetime, end: datetime) -> ShardedTable:
        return replace(self, span=(start, end), moment=None, all=False)

    def all_versions(self) -> ShardedTable:
        return replace(self, all=True, moment=None, span=None)

    def shard_hint(self, shard: str) -> ShardedTable:
        return replace(self, hint=shard)

    def scope(self) -> dict:
        return {c: v for c, v in self.session.scope.items() if c in self.spec.schema.names}

    def known(self) -> Known:
        # the scope prunes too; a request for another value of its columns finds nothing, as both filters stay
        equal, ranges = self.hints | self.equal | self.scope(), self.spans | self.ranges
        if self.spec.temporal is None or self.all or self.session.history and self.moment is None:
            return Known(equal, ranges, None, self.span if self.spec.temporal else None)
        return Known(equal, ranges, self.moment if self.moment is not None or self.span else self.session.moment, self.span)

    def df(self) -> DataFrame:
        """Shards first, then the temporal filter, then the row filters, which pruning never replaces."""
        k, s = self.known(), self.spec.strategy
        rows = self.source.scan(self.session.spark, self.spec, k, self.hint)
        if k.as_of is not None:
            rows = valid_at(rows, self.spec.temporal, k.as_of)
        if k.between is not None:
            rows = valid_between(rows, self.spec.temporal, *k.between)
        fold = {p.key for p in ([s] if not isinstance(s, Composite) else s.parts) if type(p).__name__ == "ByValue"} if s else set()
        for c, v in [*self.scope().items(), *self.equal.items()]:
            if v is None:
                rows = rows.where(F.col(c).isNull())
            elif c in fold and isinstance(v, str):
                rows = rows.where(F.upper(c) == v.upper())
            else:
                rows = rows.where(F.col(c) == F.lit(v))
        for c, r in self.ranges.items():
            if r.low is not None:
                rows = rows.where(F.col(c) >= F.lit(r.low))
            if r.high is not None:
                rows = rows.where(F.col(c) <= F.lit(r.high) if r.closed else F.col(c) < F.lit(r.high))
        for c in self.others:
            rows = rows.where(c)
        return rows.select(*self.spec.schema.names)

    def stream(self, prefetch: bool = True):
        """Rows one partition at a time, as they come."""
        return self.df().toLocalIterator(prefetchPartitions=prefetch)

    def count(self) -> int:
        return self.df().count()

    def scalar(self, per_shard: Column, combine):
        """A value of each shard, and what combine makes of the list; SQL aggregates over df() need no combine."""
        levels = self.spec.strategy.shard_columns if isinstance(self.spec.strategy, Composite) else [self.spec.strategy.shard_column]
        rows = self.source.scan(self.session.spark, self.spec, self.known(), self.hint).groupBy(*levels).agg(per_shard.alias("value")).collect()
        return combine([r["value"] for r in rows])


@dataclass(frozen=True)
class Engine:
    """Tables by name. engine.table(name) always routes."""

    session: Session
    catalog: object
    sources: dict = field(default_factory=dict)

    def table(self, name: str) -> ShardedTable:
        try:
            return ShardedTable(self.catalog.tables[name], self.session, self.sources[name])
        except KeyError:
            raise StratumError(f"no table {name}") from None

    def mount(self, name: str, source) -> None:
        self.sources[name] = source

    def shards(self, group: str = "default", **known) -> list[ShardSpec]:
        return resolve(self.catalog.shards(group), **known)
