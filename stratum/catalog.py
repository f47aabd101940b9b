"""What the driver knows of tables: shards, validity periods, relations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import Enum, IntEnum

from pyspark.sql import types as T

from .errors import MetadataError, ShardNotFound

DEFAULT_GROUP = "default"


class Tier(IntEnum):
    HOT = 0
    WARM = 1
    COLD = 2
    ARCHIVE = 3

    @classmethod
    def parse(cls, name: str | None) -> Tier:
        return cls.__members__.get((name or "hot").upper(), cls.HOT)


class StorageMode(Enum):
    TABLES = "tables"  # directories of one table
    DATABASES = "databases"  # a root for each shard
    MANUAL = "manual"  # existing paths with predicates


class Containment(Enum):
    NONE = "none"
    WITHIN = "within"
    EXACT = "exact"


class RelationKind(Enum):
    ONE_TO_ONE = "one_to_one"
    ONE_TO_MANY = "one_to_many"
    MANY_TO_MANY = "many_to_many"


@dataclass(frozen=True)
class DateRange:
    """Half-open: start is in, end is not."""

    start: datetime
    end: datetime

    def __post_init__(self):
        if self.end <= self.start:
            raise MetadataError(f"empty range {self.start} .. {self.end}")

    def contains(self, at: datetime) -> bool:
        return self.start <= at < self.end

    def intersects(self, other: DateRange) -> bool:
        return self.start < other.end and other.start < self.end

    def intersection(self, other: DateRange) -> DateRange | None:
        return DateRange(max(self.start, other.start), min(self.end, other.end)) if self.intersects(other) else None


@dataclass(frozen=True)
class KeyRange:
    """Closed: both bounds are in."""

    low: object
    high: object

    def contains(self, value) -> bool:
        return self.low <= value <= self.high


@dataclass(frozen=True)
class ShardSpec:
    id: str
    group: str = DEFAULT_GROUP
    name: str | None = None
    mode: StorageMode = StorageMode.TABLES
    table: str | None = None
    schema: str | None = None
    path: str | None = None
    key_value: str | None = None
    date_range: DateRange | None = None
    key_range: KeyRange | None = None
    tier: Tier = Tier.HOT
    read_only: bool = False
    priority: int = 100
    predicate: str | None = None

    def __post_init__(self):
        if not self.id or "::" in self.id:
            raise MetadataError(f"bad shard id {self.id!r}")
        if self.mode is StorageMode.DATABASES and not self.path:
            raise MetadataError(f"shard {self.id} has no path of its own")
        if self.mode is StorageMode.MANUAL and not (self.table or self.path):
            raise MetadataError(f"shard {self.id} maps no table")

    @property
    def qualified(self) -> str:
        return self.id if self.group == DEFAULT_GROUP else f"{self.group}::{self.id}"

    @property
    def writable(self) -> bool:
        return not self.read_only and self.tier is not Tier.ARCHIVE

    def table_name(self, table: str, pattern: str = "{Table}_{ShardId}") -> str:
        if self.table:
            return self.table
        if self.mode is StorageMode.DATABASES:
            return table
        return pattern.replace("{Table}", table).replace("{Schema}", self.schema or "default").replace("{ShardId}", self.id)


@dataclass(frozen=True)
class TemporalSpec:
    valid_from: str
    valid_to: str | None = None
    open_end: datetime | None = None  # what stands for an open end besides null
    close_offset_us: int = 0


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: str | None = None
    temporal: TemporalSpec | None = None
    strategy: object | None = None
    database: str = "default"

    @classmethod
    def build(cls, name: str, schema: T.StructType, **more) -> TableSpec:
        if more.get("key") is None:
            by = {c.lower(): c for c in schema.names}
            more["key"] = by.get("id") or by.get(f"{name.lower()}id") or by.get(f"{name.lower()}_id")
        spec = cls(name, schema, **more)
        spec.check()
        return spec

    def check(self) -> None:
        if self.key and self.key not in self.schema.names:
            raise MetadataError(f"{self.name} has no column {self.key}")
        if t := self.temporal:
            for c in filter(None, (t.valid_from, t.valid_to)):
                if c not in self.schema.names:
                    raise MetadataError(f"{self.name} has no column {c}")
                if not isinstance(self.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                    raise MetadataError(f"{self.name}.{c} is not a date or timestamp")
        if self.strategy is not None:
            for c in self.strategy.columns:
                if c not in self.schema.names:
                    raise MetadataError(f"{self.name} has no shard key {c}")


@dataclass(frozen=True)
class RelationSpec:
    parent: str
    child: str
    parent_key: str
    child_key: str
    kind: RelationKind = RelationKind.ONE_TO_MANY
    containment: Containment = Containment.NONE


@dataclass
class Validation:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


class Catalog:
    """Tables, relations and shards by group. Local ids are unique in a group; groups don't see each other."""

    def __init__(self):
        self.tables: dict[str, TableSpec] = {}
        self.relations: list[RelationSpec] = []
        self.groups: dict[str, dict[str, ShardSpec]] = {DEFAULT_GROUP: {}}

    def add_table(self, spec: TableSpec) -> TableSpec:
        spec.check()
        self.tables[spec.name] = spec
        return spec

    def add_relation(self, relation: RelationSpec) -> None:
        self.relations.append(relation)

    def relations_of(self, table: str) -> list[RelationSpec]:
        return [r for r in self.relations if table in (r.parent, r.child)]

    def add_shard(self, shard: ShardSpec | str, **more) -> ShardSpec:
        s = shard if isinstance(shard, ShardSpec) else ShardSpec(shard, **more)
        own = self.groups.setdefault(s.group, {})
        if s.id in own:
            raise MetadataError(f"shard {s.qualified} is there already")
        own[s.id] = s
        return s

    def add_group(self, name: str, shards: list[ShardSpec]) -> None:
        if name == DEFAULT_GROUP:
            raise MetadataError("the default group has its name already")
        for s in shards:
            self.add_shard(replace(s, group=name))

    def load_shards(self, path: str) -> list[ShardSpec]:
        """Shards of a JSON file: shards[] of shardId, name, connectionString, dateRangeStart, dateRangeEnd, tier, isReadOnly, priority."""
        with open(path, encoding="utf-8") as f:
            rows = json.load(f).get("shards", [])
        at = lambda x: datetime.fromisoformat(x.rstrip("Z")) if x else None
        out = []
        for r in rows:
            start, end = at(r.get("dateRangeStart")), at(r.get("dateRangeEnd"))
            out.append(self.add_shard(ShardSpec(r["shardId"], name=r.get("name"), path=r.get("connectionString"), mode=StorageMode.DATABASES if r.get("connectionString") else StorageMode.TABLES, date_range=DateRange(start, end) if start and end else None, tier=Tier.parse(r.get("tier")), read_only=bool(r.get("isReadOnly", False)), priority=int(r.get("priority", 100)))))
        return out

    def shards(self, group: str = DEFAULT_GROUP) -> list[ShardSpec]:
        if group not in self.groups:
            raise ShardNotFound(f"no group {group}")
        return sorted(self.groups[group].values(), key=lambda s: (s.priority, s.id))

    def shard(self, name: str) -> ShardSpec:
        group, _, local = name.rpartition("::")
        try:
            return self.groups[group or DEFAULT_GROUP][local]
        except KeyError:
            raise ShardNotFound(name) from None

    def writable(self, group: str = DEFAULT_GROUP) -> list[ShardSpec]:
        return [s for s in self.shards(group) if s.writable]

    def by_tier(self, tier: Tier, group: str = DEFAULT_GROUP) -> list[ShardSpec]:
        return [s for s in self.shards(group) if s.tier is tier]

    def in_range(self, span: DateRange, group: str = DEFAULT_GROUP) -> list[ShardSpec]:
        return [s for s in self.shards(group) if s.date_range and s.date_range.intersects(span)]

    def for_date(self, at: datetime, group: str = DEFAULT_GROUP) -> ShardSpec:
        for s in self.shards(group):
            if s.tier is Tier.HOT and s.writable and s.date_range and s.date_range.contains(at):
                return s
        raise ShardNotFound(f"no hot shard holds {at}")

    def validate(self) -> Validation:
        """Errors make a catalog invalid; warnings don't."""
        v = Validation()
        for r in self.relations:
            for t, k in ((r.parent, r.parent_key), (r.child, r.child_key)):
                if t not in self.tables:
                    v.errors.append(f"relation names {t}, which is no table")
                elif k not in self.tables[t].schema.names:
                    v.errors.append(f"{t} has no column {k}")
            ends = [self.tables.get(t) for t in (r.parent, r.child)]
            if r.containment is not Containment.NONE and all(ends) and not all(t.temporal for t in ends):
                v.errors.append(f"{r.child} cannot be contained in {r.parent}: one of them has no validity")
        for t in self.tables.values():
            if t.key is None:
                v.warnings.append(f"{t.name} has no key")
        return v

    def frame(self, spark):
        """The shards as a small table."""
        rows = [(s.id, s.group, s.tier.name.lower(), s.read_only, s.priority, s.key_value, s.date_range and s.date_range.start, s.date_range and s.date_range.end) for g in self.groups for s in self.shards(g)]
        return spark.createDataFrame(rows, "shard_id string, shard_group string, tier string, read_only boolean, priority int, key_value string, range_start timestamp_ntz, range_end timestamp_ntz")
