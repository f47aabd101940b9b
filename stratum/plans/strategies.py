"""Sharding strategies: a shard column for writes, and a pruning filter for reads.

Each strategy gives the shard of a row as a column, and turns what a scan knows (equalities, ranges, a moment) into a
filter on the shard column, which reaches the scan as a partition filter. The row filter always stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ShardSpec
from ..errors import ReadOnlyShard, RoutingError
from ..functions.columns import as_key, bucket_start, first_letter, hash_bucket, hash_of, key_text, text_hash


@dataclass(frozen=True)
class Range:
    """low <= value < high, or value <= high where closed; None is open."""

    low: object = None
    high: object = None
    closed: bool = True


@dataclass(frozen=True)
class Known:
    """What a scan request says of columns."""

    equal: dict
    ranges: dict
    as_of: datetime | None = None
    between: tuple | None = None


class Strategy:
    """A strategy says which shard a key is in, as a column; a literal goes through the same expression, which is folded
    when the query is planned, so that reads and writes agree on every type. What a literal of another type equals is not
    known: then nothing is pruned."""

    columns: tuple[str, ...] = ()
    shard_column = "shard"

    def of(self, key: Column, kind: T.DataType) -> Column:
        raise NotImplementedError

    def shard(self, schema: T.StructType) -> Column:
        return self.of(F.col(self.columns[0]), schema[self.columns[0]].dataType)

    def shard_of(self, value, schema: T.StructType) -> Column | None:
        kind = schema[self.columns[0]].dataType
        key = None if value is None else as_key(value, kind)
        return None if key is None else self.of(key, kind)

    def prune(self, known: Known, schema: T.StructType) -> Column | None:
        mine = self.shard_of(known.equal.get(self.columns[0]), schema)
        return None if mine is None else F.col(self.shard_column) == mine


@dataclass(frozen=True)
class ByValue(Strategy):
    """The key's text, upper-cased: keys differ by case in rows, not in shards. others is the shard of unknown values."""

    key: str
    values: tuple[str, ...] | None = None
    others: str | None = None
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def of(self, key, kind):
        v = F.upper(key_text(key, kind))
        if self.values is None:
            return v
        known = v.isin([x.upper() for x in self.values])
        return F.when(known, v).when(v.isNotNull(), F.lit(self.others))


@dataclass(frozen=True)
class ByDate(Strategy):
    """The start of the calendar interval. On a table with validity whose start is the key, a moment leaves out later shards only: an older version may be valid still."""

    key: str
    interval: str = "month"
    valid_from: str | None = None
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def of(self, key, kind):
        return F.date_format(bucket_start(self.interval, key), "yyyy-MM-dd")

    def _day(self, moment, before: bool = False) -> Column:
        """The shard of a moment, or of the microsecond before it."""
        at = F.lit(moment).cast("timestamp_ntz")
        return self.of(at - F.expr("INTERVAL 1 MICROSECOND") if before else at, None)

    def prune(self, known, schema):
        s, out = F.col(self.shard_column), None
        both = lambda a, b: b if a is None else a & b
        if (mine := super().prune(known, schema)) is not None:
            out = both(out, mine)
        if r := known.ranges.get(self.key):
            if r.low is not None:
                out = both(out, s >= self._day(r.low))
            if r.high is not None:
                out = both(out, s <= self._day(r.high, not r.closed))
        if self.key == self.valid_from:
            latest = known.as_of if known.as_of is not None else known.between and known.between[1]
            if latest is not None:
                out = both(out, s <= self._day(latest))
        return out


@dataclass(frozen=True)
class ByHash(Strategy):
    key: str
    n: int
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def of(self, key, kind):
        return hash_bucket(key, self.n, kind)


@dataclass(frozen=True)
class ByRange(Strategy):
    """Bounds cut the key's values: shard i holds bounds[i - 1] <= key < bounds[i]."""

    key: str
    bounds: tuple
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def of(self, key, kind):
        out = F.lit(0)
        for b in self.bounds:
            out = out + (key >= b).cast("int")
        return out

    def prune(self, known, schema):
        s, out = F.col(self.shard_column), super().prune(known, schema)
        if r := known.ranges.get(self.key):
            for end, inside in ((r.low, lambda x: s >= x), (r.high, lambda x: s <= x)):
                if (at := self.shard_of(end, schema)) is not None:
                    out = inside(at) if out is None else out & inside(at)
        return out


@dataclass(frozen=True)
class ByAlphabet(Strategy):
    """Groups of first letters, such as A-F; what fits none is in others."""

    key: str
    groups: tuple[str, ...] = ("A-F", "G-L", "M-R", "S-Z")
    others: str = "other"
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def of(self, key, kind):
        letter, out = first_letter(key), None
        for g in self.groups:
            hit = letter.between(g[0], g[-1])
            out = F.when(hit, g) if out is None else out.when(hit, g)
        return out.otherwise(self.others)


@dataclass(frozen=True)
class ByRows(Strategy):
    """At most so many rows in a shard, by a dense whole-number key such as a sequence."""

    key: str
    rows: int
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def of(self, key, kind):
        return F.floor(key / self.rows).cast("int")


@dataclass(frozen=True)
class Ring(Strategy):
    """Consistent hashing: a key goes to the node whose point on the ring follows its hash. Points are 32-bit MD5 heads."""

    key: str
    nodes: tuple[str, ...]
    points: int = 16
    shard_column: str = "shard"

    @property
    def columns(self):
        return (self.key,)

    def ring(self) -> list[tuple[int, str]]:
        return sorted((hash_of(f"{n}#{i}", 1 << 32), n) for n in self.nodes for i in range(self.points))

    def of(self, key, kind):
        h = text_hash(key, kind)
        ring, out = self.ring(), None
        for at, node in ring:
            out = F.when(h <= at, node) if out is None else out.when(h <= at, node)
        return F.when(h.isNotNull(), out.otherwise(ring[0][1]))


@dataclass(frozen=True)
class Composite(Strategy):
    """One directory level for each part; parts need shard columns of their own."""

    parts: tuple[Strategy, ...]

    @property
    def columns(self):
        return tuple(c for p in self.parts for c in p.columns)

    @property
    def shard_columns(self):
        return [p.shard_column for p in self.parts]

    def prune(self, known, schema):
        out = None
        for p in self.parts:
            if (f := p.prune(known, schema)) is not None:
                out = f if out is None else out & f
        return out


@dataclass(frozen=True)
class Custom(Strategy):
    """Any column, and any pruning function of Known."""

    keys: tuple[str, ...]
    column: object  # schema -> Column
    pruner: object = None
    shard_column: str = "shard"

    @property
    def columns(self):
        return self.keys

    def shard(self, schema):
        return self.column(schema)

    def prune(self, known, schema):
        return self.pruner(known) if self.pruner else None


def shard_levels(strategy: Strategy | None, schema: T.StructType) -> dict[str, Column]:
    """Shard columns by name, outermost first; none for a plain table."""
    if strategy is None:
        return {}
    if isinstance(strategy, Composite):
        return {p.shard_column: p.shard(schema) for p in strategy.parts}
    return {strategy.shard_column: strategy.shard(schema)}


def route(value: str | None, shards: list[ShardSpec]) -> ShardSpec:
    """The shard that a key value is written to: its own, else the one without a value."""
    if value is None:
        raise RoutingError("the shard key is null")
    own = [s for s in shards if s.key_value is not None and s.key_value.lower() == value.lower()]
    found = own or [s for s in shards if not s.key_value]
    if not found:
        raise RoutingError(f"no shard takes {value!r}")
    for s in found:
        if s.writable:
            return s
    raise ReadOnlyShard(f"{found[0].qualified} is read-only")


def route_date(at: datetime, shards: list[ShardSpec]) -> ShardSpec:
    found = [s for s in shards if s.date_range and s.date_range.contains(at)] or [s for s in shards if s.date_range is None]
    if not found:
        raise RoutingError(f"no shard holds {at}")
    for s in found:
        if s.writable:
            return s
    raise ReadOnlyShard(f"{found[0].qualified} is read-only")


def resolve(shards: list[ShardSpec], key_value=None, at: datetime | None = None, span=None, hint: str | None = None) -> list[ShardSpec]:
    """Shards that a read needs, by priority; read-only ones too. Shards without a range hold any date."""
    if hint is not None:
        found = [s for s in shards if hint in (s.id, s.qualified)]
        if not found:
            raise RoutingError(f"no shard {hint}")
        return found
    if key_value is not None:
        own = [s for s in shards if s.key_value and s.key_value.lower() == str(key_value).lower()]
        shards = own or [s for s in shards if not s.key_value] or shards
    if at is not None:
        shards = [s for s in shards if s.date_range is None or s.date_range.contains(at)]
    if span is not None:
        shards = [s for s in shards if s.date_range is None or s.date_range.intersects(span)]
    return shards
