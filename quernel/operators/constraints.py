"""Unique keys and foreign keys as joins: violations, orphans, and what deleting or re-keying a parent does to children."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.schema import Action, ForeignKey, SchemaError, Table


class ConstraintError(ValueError):
    """A change that a constraint forbids."""


def _set(names: tuple[str, ...]) -> Column:
    """True if all fields of a key have values."""
    return functools.reduce(operator.and_, (F.col(n).isNotNull() for n in names))


def duplicates(frame: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Values of ``key`` that more than one row has, with their number ``n`` (``n_rows`` if a field has that name); keys with a null are never equal."""
    return frame.where(_set(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").withColumnRenamed("_rows", "n_rows" if "n" in key else "n")


def taken(rows: DataFrame, existing: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows whose ``key`` an existing row has."""
    return rows.join(existing.select(*key), list(key), "left_semi")


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows that refer to no parent. All null refers to nothing; a key of which a part is null is an orphan."""
    refs = parent.select(*(F.col(b).alias(a) for a, b in zip(fk.fields, fk.referenced, strict=True)))
    some = functools.reduce(operator.or_, (F.col(n).isNotNull() for n in fk.fields))
    return child.where(some).join(refs, list(fk.fields), "left_anti")


def children(child: DataFrame, parents: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows that refer to one of ``parents``."""
    refs = parents.select(*(F.col(b).alias(a) for a, b in zip(fk.fields, fk.referenced, strict=True)))
    return child.join(refs, list(fk.fields), "left_semi")


@dataclass
class Cascade:
    """Tables after a cascade, and the keys of rows that went from each."""

    frames: dict[str, DataFrame]
    deleted: dict[str, DataFrame] = field(default_factory=dict)


def referencing(schemas: dict[str, Table], table: str) -> list[tuple[Table, ForeignKey]]:
    return [(s, k) for s in schemas.values() for k in s.foreign_keys if k.enabled and k.table == table]


def _emptied(frame: DataFrame, schema: Table, fk: ForeignKey, hit: DataFrame, default: bool) -> DataFrame:
    """``frame`` with the foreign key of rows in ``hit`` set to null or to its fields' defaults."""
    for n in fk.fields:
        f = schema.field(n)
        if not f.nullable and (not default or f.default is None):
            raise ConstraintError(f"{schema.name}.{n} cannot be null")
    key = schema.key.name
    marked = frame.join(hit.select(F.col(key), F.lit(True).alias("_hit")), key, "left")
    value = {n: F.lit(schema.field(n).default if default else None).cast(frame.schema[n].dataType) for n in fk.fields}
    return marked.select(*(F.when(F.col("_hit"), value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in frame.columns))


def cascade_delete(frames: dict[str, DataFrame], schemas: dict[str, Table], table: str, victims: DataFrame, persist=None) -> Cascade:
    """Deletes ``victims`` (rows of ``table``) with all that their foreign keys say.

    Restricting children that are not themselves deleted by the cascade forbid it. Level by level: the children of
    the last level's rows that are not yet deleted make the next; cycles end when a level adds nothing. ``persist``
    cuts the lineage of a level's keys (a checkpoint, say).
    """
    persist = persist or (lambda df: df)
    out = Cascade(dict(frames))
    gone: dict[str, DataFrame] = {table: persist(victims.select(schemas[table].key.name).distinct())}
    level: dict[str, DataFrame] = dict(gone)
    while level:
        following: dict[str, DataFrame] = {}
        for name, keys in level.items():
            rows = frames[name].join(keys, schemas[name].key.name, "left_semi")
            for schema, fk in referencing(schemas, name):
                if fk.on_delete != Action.cascade:
                    continue
                key = schema.key.name
                new = children(frames[schema.name], rows, fk).select(key)
                if schema.name in gone:
                    new = new.join(gone[schema.name], key, "left_anti")
                new = persist(new.distinct())
                if not new.isEmpty():
                    gone[schema.name] = persist(gone[schema.name].unionByName(new).distinct()) if schema.name in gone else new
                    following[schema.name] = following[schema.name].unionByName(new).distinct() if schema.name in following else new
        level = following
    for name, keys in gone.items():
        rows = frames[name].join(keys, schemas[name].key.name, "left_semi")
        for schema, fk in referencing(schemas, name):
            if fk.on_delete == Action.cascade:
                continue
            hit = children(frames[schema.name], rows, fk)
            if schema.name in gone:
                hit = hit.join(gone[schema.name], schema.key.name, "left_anti")
            if fk.on_delete in (Action.restrict, Action.noAction):
                if not hit.isEmpty():
                    raise ConstraintError(f"{schema.name} still refers to rows of {name}")
            else:
                out.frames[schema.name] = _emptied(out.frames[schema.name], schema, fk, hit, fk.on_delete == Action.setDefault)
    for name, keys in gone.items():
        out.frames[name] = out.frames[name].join(keys, schemas[name].key.name, "left_anti")
    out.deleted = gone
    return out


def cascade_update(frames: dict[str, DataFrame], schemas: dict[str, Table], table: str, changes: DataFrame) -> Cascade:
    """Re-keys rows of ``table``. ``changes`` has ``old`` and ``new`` keys; children follow, are emptied, or forbid it."""
    schema = schemas[table]
    key = schema.key.name
    out = Cascade(dict(frames))
    moved = frames[table].join(changes.select(F.col("old").alias(key)), key, "left_semi")
    clash = changes.select(F.col("new").alias(key)).join(frames[table].join(moved.select(key), key, "left_anti").select(key), key, "left_semi")
    if not clash.isEmpty() or not duplicates(changes, ("new",)).isEmpty():
        raise ConstraintError(f"{table}: a new key is taken")
    for child, fk in referencing(schemas, table):
        if fk.referenced != (key,):
            continue
        (name,) = fk.fields
        frame = out.frames[child.name]
        hit = children(frame, moved, fk)
        if fk.on_update in (Action.restrict, Action.noAction):
            if not hit.isEmpty():
                raise ConstraintError(f"{child.name} refers to a key of {table} that is to change")
        elif fk.on_update == Action.cascade:
            joined = frame.join(changes.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(name) == F.col("_old"), "left")
            out.frames[child.name] = joined.select(*(F.coalesce("_new", name).cast(frame.schema[c].dataType).alias(c) if c == name else F.col(c) for c in frame.columns))
        else:
            out.frames[child.name] = _emptied(frame, child, fk, hit, fk.on_update == Action.setDefault)
    frame = out.frames[table]
    joined = frame.join(changes.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(key) == F.col("_old"), "left")
    out.frames[table] = joined.select(*(F.coalesce("_new", key).cast(frame.schema[c].dataType).alias(c) if c == key else F.col(c) for c in frame.columns))
    return out


def check_references(schemas: dict[str, Table], table: Table) -> None:
    """Foreign keys of ``table`` name existing tables and unique fields there."""
    for k in table.foreign_keys:
        parent = table if k.table == table.name else schemas.get(k.table)
        if parent is None:
            raise SchemaError(f"{table.name}: {k.label(table.name)} refers to unknown table {k.table}")
        if tuple(k.referenced) not in parent.unique_keys().values():
            raise SchemaError(f"{table.name}: {k.label(table.name)} refers to fields of {k.table} that are not unique")
