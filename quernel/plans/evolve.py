"""Schema changes: a builder, the difference of two declarations, and their effect on stored rows."""

from __future__ import annotations

import dataclasses
import difflib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.values import convert_column, literal
from quernel.operators.constraints import duplicates, orphans
from quernel.operators.write import rules
from quernel.schema import INGESTED, Field, FieldType, ForeignKey, Index, PrimaryKey, SchemaError, Table, Ttl


#: How much of two names must agree for a rename that no id tells, as difflib counts it.
ALIKE = 0.6


def _alike(a: Field, b: Field) -> bool:
    same = dataclasses.replace(a, name=b.name, field_id=b.field_id, comment=b.comment) == b
    return same and difflib.SequenceMatcher(None, a.name.lower(), b.name.lower()).ratio() >= ALIKE


def diff(old: Table, new: Table) -> list[tuple]:
    """Operations that turn ``old`` into ``new``.

    A field of another name but the same ``field_id`` (or old name) is a rename; so is one that has no id and takes the place of the
    one field gone that is like it: of the same type and rules, with a name of which at least ``ALIKE`` agrees. Where two would do, none is.
    """
    ops: list[tuple] = []
    if old.key != new.key:
        ops.append(("set_key", new.key.name, new.key))
    was = {f.name: f for f in old.fields}
    ids = {f.field_id or f.name: f.name for f in old.fields}
    kept, gone = set(), [f for f in old.fields if f.name not in {x.name for x in new.fields} and f.field_id not in {x.field_id for x in new.fields if x.field_id}]
    fresh = [f for f in new.fields if f.name not in was and not (f.field_id and f.field_id in ids)]
    like = {f.name: [g.name for g in gone if not f.field_id and _alike(f, g)] for f in fresh}
    taken = [n for found in like.values() for n in found]
    for f in new.fields:
        source = f.name if f.name in was else ids.get(f.field_id) if f.field_id else None
        if source is None and len(like.get(f.name, ())) == 1 and taken.count(like[f.name][0]) == 1:
            source = like[f.name][0]
        if source is None or source in kept:
            ops.append(("add_field", f.name, f))
            continue
        kept.add(source)
        if source != f.name:
            ops.append(("rename_field", source, f.name))
        if dataclasses.replace(was[source], name=f.name, field_id=f.field_id) != f:
            ops.append(("modify_field", f.name, f))
    ops += [("remove_field", n, None) for n in was if n not in kept]
    for kind, a, b in (("index", old.indexes, new.indexes), ("foreign_key", old.foreign_keys, new.foreign_keys)):
        ops += [(f"remove_{kind}", x.label(old.name), None) for x in a if x not in b]
        ops += [(f"add_{kind}", x.label(new.name), x) for x in b if x not in a]
    if old.ttl != new.ttl:
        ops.append(("set_ttl", "", new.ttl))
    return ops


def broken(schema: Table, frame: DataFrame, ops: list[tuple], parents: dict[str, DataFrame]) -> str | None:
    """What the rows, as ``apply_changes`` left them, break of the fields, indexes and foreign keys that ``ops`` are about."""
    names, keys, fks = set(), [], []
    for op, name, x in ops:
        if op in ("add_field", "modify_field"):
            names.add(x.name)
        elif op == "add_index" and x.unique:
            keys.append((x.label(schema.name), x.fields))
        elif op == "add_foreign_key" and x.enabled:
            fks.append(x)
    fields = [f for f in schema.fields if f.name in names]
    keys += [(Index((f.name,), unique=True).label(schema.name), (f.name,)) for f in fields if f.unique]
    why = [r for f in fields for r in rules(f.name, f, F.col(f.name))]
    if why and (row := frame.select(F.coalesce(*why).alias("why")).where("why is not null").first()):
        return row.why
    for label, key in keys:
        if not duplicates(frame, tuple(key)).isEmpty():
            return f"{label}: rows share a value"
    for fk in fks:
        parent = frame if fk.table == schema.name else parents.get(fk.table)
        if parent is None or not orphans(frame, parent, fk).isEmpty():
            return f"{fk.label(schema.name)}: no parent"
    return None


def apply_changes(schema: Table, frame: DataFrame, ops: list[tuple]) -> tuple[Table, DataFrame]:
    """The schema and rows after the operations. Rows are projected, never collected."""
    removed = {name for op, name, _ in ops if op == "remove_field"}
    for op, name, x in ops:
        fields = list(schema.fields)
        at = next((i for i, f in enumerate(fields) if f.name == name), None)
        if op in ("remove_field", "rename_field", "modify_field") and at is None:
            raise SchemaError(f"{schema.name} has no field {name!r}")
        if op == "add_field":
            if name in schema.columns:
                raise SchemaError(f"{schema.name} has a field {name!r}")
            value = literal(x.default, x.spark) if x.default is not None else F.current_timestamp().cast("timestamp_ntz") if x.default_now else F.lit(None).cast(x.spark)
            frame = frame.withColumn(name, value)
            schema = schema.with_(fields=(*fields, x))
        elif op == "remove_field":
            frame = frame.drop(name)
            schema = Table(schema.name, tuple(f for f in fields if f.name != name), schema.key, tuple(i for i in schema.indexes if name not in i.fields), tuple(k for k in schema.foreign_keys if name not in k.fields), schema.is_global, schema.ttl if not schema.ttl or schema.ttl.field != name else None)
        elif op == "rename_field":
            frame = frame.withColumnRenamed(name, x)
            swap = lambda names: tuple(x if n == name else n for n in names)  # noqa: B023, E731
            fields[at] = dataclasses.replace(fields[at], name=x)
            schema = Table(
                schema.name, tuple(fields), schema.key, tuple(dataclasses.replace(i, fields=swap(i.fields)) for i in schema.indexes),
                tuple(dataclasses.replace(k, fields=swap(k.fields)) for k in schema.foreign_keys), schema.is_global, dataclasses.replace(schema.ttl, field=x) if schema.ttl and schema.ttl.field == name else schema.ttl,
            )
        elif op == "modify_field":
            col = convert_column(F.col(name), frame.schema[name].dataType, x)
            if frame.schema[name].dataType != x.spark and not frame.where(F.col(name).isNotNull() & col.isNull()).isEmpty():
                raise SchemaError(f"{schema.name}.{name}: a value cannot become {FieldType(x.type).value}")
            if x.default is not None and not x.nullable:
                col = F.coalesce(col, literal(x.default, x.spark))
            if x.max_length and x.type == FieldType.text:
                col = F.substring(col, 1, x.max_length)
            frame = frame.withColumn(name, col)
            fields[at] = x
            schema = schema.with_(fields=tuple(fields))
        elif op == "add_index":
            schema = schema.with_(indexes=(*schema.indexes, x))
        elif op == "remove_index":
            schema = schema.with_(indexes=tuple(i for i in schema.indexes if i.label(schema.name) != name))
        elif op == "add_foreign_key":
            schema = schema.with_(foreign_keys=(*schema.foreign_keys, x))
        elif op == "remove_foreign_key":
            schema = schema.with_(foreign_keys=tuple(k for k in schema.foreign_keys if k.label(schema.name) != name))
        elif op == "set_ttl":
            schema = schema.with_(ttl=x)
            if x and schema.with_ingest_time() != schema:  # rows that are there begin their life now
                schema = schema.with_ingest_time()
                frame = frame.withColumn(INGESTED, F.current_timestamp().cast("timestamp_ntz"))
        elif op == "set_key":
            if x.name != schema.key.name:
                frame = frame.withColumnRenamed(schema.key.name, x.name)
            schema = schema.with_(key=x)
        elif op == "rename_table":
            schema = schema.with_(name=x)
        else:
            raise SchemaError(f"unknown operation {op!r}")
    assert not removed & set(frame.columns)
    return schema, frame.select(*schema.columns)


class SchemaBuilder:
    """Collects operations on one table; ``run`` submits them as one task and returns its id."""

    def __init__(self, table: str, submit: Callable[[list[tuple]], str]):
        self.table, self._submit, self.ops = table, submit, []

    def _op(self, *op: Any) -> SchemaBuilder:
        self.ops.append(op)
        return self

    def add_field(self, name: str, type: FieldType, **options):
        return self._op("add_field", name, Field(name, FieldType(type), **options))

    def remove_field(self, name: str):
        return self._op("remove_field", name, None)

    def rename_field(self, old: str, new: str):
        return self._op("rename_field", old, new)

    def modify_field(self, name: str, type: FieldType, **options):
        return self._op("modify_field", name, Field(name, FieldType(type), **options))

    def add_index(self, fields: list[str], name: str | None = None, unique: bool = False, kind: str = "btree"):
        i = Index(tuple(fields), name, unique, kind)
        return self._op("add_index", i.label(self.table), i)

    def remove_index(self, name: str | None = None, fields: list[str] | None = None, unique: bool = False):
        return self._op("remove_index", name or Index(tuple(fields or ()), unique=unique).label(self.table), None)

    def rename_table(self, name: str):
        return self._op("rename_table", name, name)

    def set_primary_key_config(self, key: PrimaryKey):
        return self._op("set_key", key.name, key)

    def set_ttl_config(self, ttl: Ttl):
        return self._op("set_ttl", "", ttl)

    def disable_ttl(self):
        return self._op("set_ttl", "", None)

    def add_foreign_key(self, fk: ForeignKey):
        return self._op("add_foreign_key", fk.label(self.table), fk)

    def remove_foreign_key(self, name: str):
        return self._op("remove_foreign_key", name, None)

    def modify_foreign_key(self, fk: ForeignKey):
        return self.remove_foreign_key(fk.label(self.table)).add_foreign_key(fk)

    def allow_after_data_migration(self):
        """Rows are migrated with the schema in one commit, so this is always so."""
        return self

    def run(self) -> str:
        return self._submit(self.ops)
