"""Declared tables: fields, keys, indexes, foreign keys and row lifetime, with their Spark types and checks."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from enum import StrEnum
from typing import Any

from pyspark.sql import types as T


class FieldType(StrEnum):
    integer = "integer"
    bigInt = "bigInt"
    double = "double"
    text = "text"
    blob = "blob"
    boolean = "boolean"
    datetime = "datetime"
    array = "array"
    vector = "vector"
    json = "json"


#: Arbitrary-precision integers are held to 38 digits; JSON and array elements are text.
SPARK_TYPES: dict[FieldType, T.DataType] = {
    FieldType.integer: T.LongType(),
    FieldType.bigInt: T.DecimalType(38, 0),
    FieldType.double: T.DoubleType(),
    FieldType.text: T.StringType(),
    FieldType.blob: T.BinaryType(),
    FieldType.boolean: T.BooleanType(),
    FieldType.datetime: T.TimestampNTZType(),
    FieldType.array: T.ArrayType(T.StringType()),
    FieldType.vector: T.ArrayType(T.DoubleType()),
    FieldType.json: T.StringType(),
}

NUMERIC = (FieldType.integer, FieldType.bigInt, FieldType.double)


class KeyKind(StrEnum):
    none = "none"
    sequential = "sequential"
    timestampBased = "timestampBased"
    datePrefixed = "datePrefixed"
    shortCode = "shortCode"


class Action(StrEnum):
    restrict = "restrict"
    noAction = "noAction"
    cascade = "cascade"
    setNull = "setNull"
    setDefault = "setDefault"


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class SchemaError(ValueError):
    """A declaration that cannot hold."""


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    nullable: bool = True
    default: Any = None
    default_now: bool = False
    unique: bool = False
    index: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    field_id: str | None = None
    width: int | None = None  # of a vector
    comment: str | None = None

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[FieldType(self.type)]


@dataclass(frozen=True)
class Index:
    fields: tuple[str, ...]
    name: str | None = None
    unique: bool = False
    kind: str = "btree"  # or "vector"

    def label(self, table: str) -> str:
        return self.name or f"{'uniq' if self.unique else 'idx'}_{table}_{'_'.join(self.fields)}"


@dataclass(frozen=True)
class ForeignKey:
    fields: tuple[str, ...]
    table: str
    referenced: tuple[str, ...]
    name: str | None = None
    on_delete: Action = Action.restrict
    on_update: Action = Action.restrict
    enabled: bool = True

    def label(self, child: str) -> str:
        return self.name or f"fk_{child}_{'_'.join(self.fields)}"


@dataclass(frozen=True)
class Ttl:
    """Rows live ``ms`` milliseconds from ``field``, or from their ingest time if no field is named."""

    ms: int
    field: str | None = None


#: The field that holds the ingest time of rows whose lifetime names no field. It is not part of what queries show by default.
INGESTED = "ingested_at__"


@dataclass(frozen=True)
class PrimaryKey:
    name: str = "id"
    kind: KeyKind = KeyKind.sequential
    start: int = 1
    step: int = 1
    type: FieldType = FieldType.integer


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...] = ()
    key: PrimaryKey = field(default_factory=PrimaryKey)
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    is_global: bool = False
    ttl: Ttl | None = None

    def __post_init__(self):
        for n in ("fields", "indexes", "foreign_keys"):
            object.__setattr__(self, n, tuple(getattr(self, n)))
        self.check()

    def check(self) -> None:
        """Names, duplicates, and that keys, indexes and lifetimes name declared fields."""
        names = [self.key.name, *(f.name for f in self.fields)]
        for n in (self.name, *names):
            if not _NAME.fullmatch(n):
                raise SchemaError(f"{n!r} is not a name")
        if len({n.lower() for n in names}) < len(names):
            raise SchemaError(f"{self.name}: a field name occurs twice")
        known = set(names)
        for part, what in [(i.fields, "index") for i in self.indexes] + [(k.fields, "foreign key") for k in self.foreign_keys]:
            if not part or not set(part) <= known:
                raise SchemaError(f"{self.name}: {what} over unknown fields {part}")
        labels = [i.label(self.name) for i in self.indexes]
        if len(set(labels)) < len(labels):
            raise SchemaError(f"{self.name}: an index occurs twice")
        for k in self.foreign_keys:
            if len(k.fields) != len(k.referenced):
                raise SchemaError(f"{self.name}: {k.label(self.name)} pairs {len(k.fields)} fields with {len(k.referenced)}")
        for f in self.fields:
            if f.type == FieldType.vector and not f.width:
                raise SchemaError(f"{self.name}.{f.name}: a vector needs a width")
        if self.ttl and (self.ttl.ms <= 0 or self.ttl.field and self.field(self.ttl.field).type != FieldType.datetime):
            raise SchemaError(f"{self.name}: a lifetime needs a positive span and a datetime field")

    def field(self, name: str) -> Field:
        if name == self.key.name:
            return Field(name, self.key.type, nullable=False, unique=True)
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name!r}")

    @property
    def columns(self) -> list[str]:
        """The primary key first, then the fields in order."""
        return [self.key.name, *(f.name for f in self.fields)]

    @property
    def shown(self) -> list[str]:
        """The columns that a query shows if it names none."""
        return [c for c in self.columns if c != INGESTED]

    @property
    def ttl_source(self) -> str | None:
        """The field that a row's lifetime is counted from."""
        return self.ttl and (self.ttl.field or INGESTED)

    def with_ingest_time(self) -> Table:
        """With the field that holds the ingest time, if the lifetime is counted from that."""
        if not self.ttl or self.ttl.field or INGESTED in self.columns:
            return self
        return self.with_(fields=(*self.fields, Field(INGESTED, FieldType.datetime, default_now=True)))

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, self.field(n).spark) for n in self.columns])

    def unique_keys(self) -> dict[str, tuple[str, ...]]:
        """Every field set that must be unique, by label, the primary key first."""
        out = {"primary": (self.key.name,)}
        out |= {Index((f.name,), unique=True).label(self.name): (f.name,) for f in self.fields if f.unique}
        return out | {i.label(self.name): i.fields for i in self.indexes if i.unique}

    def with_(self, **changes) -> Table:
        return replace(self, **changes)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Table:
        return cls(
            d["name"], tuple(Field(**f | {"type": FieldType(f["type"])}) for f in d["fields"]),
            PrimaryKey(**d["key"] | {"kind": KeyKind(d["key"]["kind"]), "type": FieldType(d["key"]["type"])}),
            tuple(Index(**i | {"fields": tuple(i["fields"])}) for i in d["indexes"]),
            tuple(ForeignKey(**k | {"fields": tuple(k["fields"]), "referenced": tuple(k["referenced"]), "on_delete": Action(k["on_delete"]), "on_update": Action(k["on_update"])}) for k in d["foreign_keys"]),
            d["is_global"], Ttl(**d["ttl"]) if d["ttl"] else None,
        )


def creation_order(tables: list[Table]) -> list[Table]:
    """Tables so that parents come before children; a cycle keeps its members in the given order."""
    by_name, out, state = {t.name: t for t in tables}, [], {}

    def visit(t: Table) -> None:
        if state.get(t.name):
            return
        state[t.name] = "open"
        for k in t.foreign_keys:
            if k.table in by_name:
                visit(by_name[k.table])
        out.append(t)

    for t in tables:
        visit(t)
    return out
