"""Writes as functions of snapshots: (rows, changes, schema) to (new rows, report)."""

from __future__ import annotations

import datetime as dt
import functools
import itertools
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import IntEnum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernel.functions import keys
from quernel.functions.expr import Expr, compile_expr
from quernel.functions.values import convert_column, literal
from quernel.operators.constraints import orphans
from quernel.plans.condition import Condition
from quernel.schema import Field, FieldType, KeyKind, SchemaError, Table


class Status(IntEnum):
    """Result codes."""

    success = 0
    partialSuccess = 1
    unknown = -1
    uniqueViolation = -2
    primaryKeyViolation = -3
    foreignKeyViolation = -4
    notNullViolation = -5
    validationFailed = -6
    notFound = -11
    tableExists = -12
    fieldExists = -13
    indexExists = -14
    ioError = -90
    dbError = -91


@dataclass
class Written:
    """The table after a write and a report: (key, action, error), error null for rows that were accepted."""

    frame: DataFrame
    report: DataFrame
    applied: bool = True  # False: one bad row stopped all

    def status(self) -> Status:
        """Success, partial success, or the failure of all rows. Runs the report."""
        good, bad = self.report.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
        return Status.success if not bad else Status.partialSuccess if good and self.applied else Status.validationFailed


Persist = Callable[[DataFrame], DataFrame] | None


def _same(frame: DataFrame) -> DataFrame:
    return frame


def resolver(frame: DataFrame):
    return lambda n: (F.col(f"`{n}`"), frame.schema[n].dataType)


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _given(rows: DataFrame, name: str) -> Column:
    """Whether a row supplies a field: all do, unless ``_given`` lists those that do."""
    return F.array_contains("_given", name) if "_given" in rows.columns else F.lit(name in rows.columns)


def rules(name: str, f: Field, value: Column, key: bool = False) -> list[Column]:
    """What a stored value may break; each is a message or null."""
    out = [] if f.nullable or key else [F.when(value.isNull(), F.lit(f"{name}: null"))]
    if f.min_length:
        out.append(F.when(F.char_length(value) < f.min_length, F.lit(f"{name}: too short")))
    if f.min_value is not None:
        out.append(F.when(value < f.min_value, F.lit(f"{name}: too small")))
    if f.max_value is not None:
        out.append(F.when(value > f.max_value, F.lit(f"{name}: too large")))
    if f.width:
        out.append(F.when(F.size(value) != f.width, F.lit(f"{name}: width is not {f.width}")))
    return out


def cut_to_length(f: Field, value: Column) -> Column:
    return F.substring(value, 1, f.max_length) if f.max_length and f.type == FieldType.text else value


def validate(rows: DataFrame, schema: Table, now: Column | None = None, updating: bool = False) -> DataFrame:
    """Rows as they would be stored, with ``_error``: converted, defaults filled in, over-long text cut, rules checked.

    Fields that the schema lacks raise. When ``updating``, only the fields that a row supplies are converted and checked, and
    others stay null; a field that ``_x_<name>`` gives an expression for is not checked. A value that cannot be converted is an error,
    as is a null in a field that forbids it.
    """
    keep = [c for c in rows.columns if c.startswith("_")]
    unknown = [c for c in rows.columns if c not in schema.columns and c not in keep]
    if unknown:
        raise SchemaError(f"{schema.name} has no field {unknown[0]!r}")
    at = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    cols, errors = [], []
    for name in schema.columns:
        f = schema.field(name)
        given = name in rows.columns
        if not given and updating:
            continue
        value = convert_column(F.col(name), rows.schema[name].dataType, f) if given else F.lit(None).cast(f.spark)
        wrong = [F.when(F.col(name).isNotNull() & value.isNull(), F.lit(f"{name}: not a {f.type.value if isinstance(f.type, FieldType) else f.type}"))] if given else []
        if f.default is not None:
            value = F.coalesce(value, literal(f.default, f.spark))
        elif f.default_now:
            value = F.coalesce(value, at)
        value = cut_to_length(f, value)
        wrong += rules(name, f, value, name == schema.key.name)
        if updating:
            there = _given(rows, name)
            if f"_x_{name}" in keep:
                there = there & F.col(f"_x_{name}").isNull()
            value, wrong = F.when(there, value), [F.when(there, w) for w in wrong]
        cols.append(value.alias(name))
        errors += wrong
    return rows.select(*(F.col(c) for c in keep if c != "_error"), *cols, _first(errors).alias("_error"))


def _order(rows: DataFrame) -> list[Column]:
    """Arrival order: ``_seq`` if the rows carry it, else a hash of the row, so that the outcome is repeatable."""
    return [F.col("_seq")] if "_seq" in rows.columns else [F.xxhash64(*(F.col(c) for c in rows.columns if c != "_error"))]


def _reject(rows: DataFrame, bad: DataFrame, on: list[str], error: str) -> DataFrame:
    """Marks rows without an error whose ``on`` fields are in ``bad``."""
    joined = rows.join(bad.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(on)), F.lit(True).alias("_bad")).distinct(), functools.reduce(operator.and_, (F.col(c) == F.col(f"_b{i}") for i, c in enumerate(on))), "left")
    return joined.withColumn("_error", F.coalesce("_error", F.when(F.col("_bad"), F.lit(error)))).drop("_bad", *(f"_b{i}" for i in range(len(on))))


def _keyed(rows: DataFrame, existing: DataFrame, schema: Table, at: dt.datetime | None = None) -> DataFrame:
    """Missing keys: sequential ones continue behind the largest there is; those of time-based kinds begin at the time
    (milliseconds, or date and time, with five digits for a sequence) or behind the largest, and short codes are such numbers in base 62.
    """
    key = schema.key
    if key.kind == KeyKind.none or key.kind == KeyKind.sequential and key.type != FieldType.integer:
        return rows.withColumn("_error", F.coalesce("_error", F.when(F.col(key.name).isNull(), F.lit("no key"))))
    text = key.type == FieldType.text
    value = keys.from_base62(F.col(key.name)) if key.kind == KeyKind.shortCode else F.col(key.name).try_cast("long")
    tops = [x for x in (f.agg(F.max(value)).first()[0] for f in (existing, rows)) if x is not None]
    if key.kind == KeyKind.sequential:
        first, step = max([key.start, *(x + key.step for x in tops)]), key.step
    else:
        now = at or dt.datetime.now(dt.UTC)
        base = int(now.strftime("%Y%m%d%H%M%S")) if key.kind == KeyKind.datePrefixed else int(now.replace(tzinfo=dt.UTC).timestamp() * 1000)
        first, step = max([base * keys.SEQUENCE, *(x + 1 for x in tops)]), 1
    missing = F.col(key.name).isNull() & F.col("_error").isNull()
    number = F.col("_number") * step + F.lit(first).cast("long")
    made = keys.base62(number) if key.kind == KeyKind.shortCode else number.cast("string") if text else number
    # rows without a key are numbered on their own, so those with one are not moved
    numbered = _numbered(rows.where(missing)).withColumn(key.name, made.cast(key_type(schema))).drop("_number")
    return rows.where(~missing).withColumn(key.name, F.col(key.name).cast(key_type(schema))).unionByName(numbered)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_number`` from 0 without gaps, in arrival order if they carry one.

    Arrival numbers come from lists that the driver held, so one task can take them. Rows of a frame have no order of their own: they
    are dealt by hash, the parts are counted, and a row's number is its rank within its part plus the rows of the parts before.
    """
    if "_seq" in rows.columns:
        return rows.withColumn("_number", F.row_number().over(Window.orderBy("_seq")) - 1)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (spot,) = _order(rows)
    dealt = rows.withColumn("_part", F.pmod(spot, F.lit(parts)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}  # a row a part
    ahead = list(itertools.accumulate((counts.get(i, 0) for i in range(parts)), initial=0))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(spot)) - 1
    return dealt.withColumn("_number", rank + F.get(F.array(*(F.lit(n).cast("long") for n in ahead)), F.col("_part"))).drop("_part")


def key_type(schema: Table) -> T.DataType:
    return schema.field(schema.key.name).spark


def insert(existing: DataFrame, rows: DataFrame, schema: Table, allow_partial: bool = True, parents: dict[str, DataFrame] | None = None, now: Column | None = None) -> Written:
    """Adds rows. A row is rejected for a broken rule, a key that an earlier row of the batch or the table has, or a parent that is missing.

    Without ``allow_partial`` one rejected row rejects all.
    """
    made = _keyed(validate(rows, schema, now), existing, schema)
    for label, fields in schema.unique_keys().items():
        ok = functools.reduce(operator.and_, (F.col(k).isNotNull() for k in fields)) & F.col("_error").isNull()
        (arrival,) = _order(made)
        # rows that cannot clash are dealt by their arrival, so that nulls are no hot key
        rank = F.row_number().over(Window.partitionBy(*fields, F.when(~ok, F.xxhash64(arrival))).orderBy(arrival))
        made = made.withColumn("_rank", rank).withColumn("_error", F.coalesce("_error", F.when(ok & (F.col("_rank") > 1), F.lit(f"{label}: twice in the batch")))).drop("_rank")
        made = _reject(made, existing.select(*fields), list(fields), f"{label}: taken")
    for fk in schema.foreign_keys:
        if fk.enabled and parents and fk.table in parents:
            others = parents[fk.table].select(*fk.referenced)
            if fk.table == schema.name:  # rows of the batch may refer to one another
                others = others.unionByName(made.where("_error is null").select(*fk.referenced))
            made = _reject(made, orphans(made.select(*fk.fields).distinct(), others, fk), list(fk.fields), f"{fk.label(schema.name)}: no parent")
            if len(fk.fields) > 1:
                n = sum((F.col(c).isNull().cast("int") for c in fk.fields), F.lit(0))
                made = made.withColumn("_error", F.coalesce("_error", F.when((n > 0) & (n < len(fk.fields)), F.lit(f"{fk.label(schema.name)}: part is null"))))
    report = made.select(F.col(schema.key.name).alias("key"), F.lit("insert").alias("action"), F.col("_error").alias("error"))
    if not allow_partial and not report.where("error is not null").isEmpty():
        return Written(existing, report, False)
    return Written(existing.unionByName(made.where("_error is null").select(*existing.columns)), report)


def violations(existing: DataFrame, frame: DataFrame, schema: Table, touched: set[str], parents: dict[str, DataFrame] | None, persist: Persist = None) -> DataFrame | None:
    """(``_id``, ``_why``) of changed rows that share a unique value with another row, or refer to no parent; None if nothing can clash.

    ``frame`` is the table after a write to ``existing``, with ``_changed`` and, for changed rows, ``_id``. Of changed rows that share a
    value that no other row has, the one of the smallest id stays. Only values of changed rows are looked up, in ``existing``. Primary keys
    cannot clash: a row of the same key is the row itself, and made keys are new.
    """
    key, parts = schema.key.name, []
    keys = {label: fields for label, fields in schema.unique_keys().items() if fields != (key,) and touched & set(fields)}
    fks = [fk for fk in schema.foreign_keys if fk.enabled and touched & set(fk.fields) and parents and fk.table in parents]
    if not keys and not fks:
        return None
    changed = (persist or _same)(frame.where("_changed"))
    for label, fields in keys.items():
        mine = changed.where(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in fields))).select("_id", *fields)
        others = existing.join(changed.select(F.col(key).alias("_moved")), F.col(key) == F.col("_moved"), "left_anti").select(*fields).join(mine.select(*fields).distinct(), list(fields), "left_semi")
        both = mine.select(*fields, "_id", F.lit(0).alias("_other")).unionByName(others.select(*fields, F.lit(None).cast("string").alias("_id"), F.lit(1).alias("_other")))
        held = both.groupBy(*fields).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_other").alias("_others"), F.min("_id").alias("_one")).where("_rows > 1")
        clash = mine.join(held, list(fields)).where((F.col("_others") > 0) | (F.col("_id") != F.col("_one")))
        parts.append(clash.select("_id", F.lit(f"{label}: taken").alias("_why")))
    for fk in fks:
        refs = frame if fk.table == schema.name else parents[fk.table]
        parts.append(orphans(changed.select("_id", *fk.fields), refs, fk).select("_id", F.lit(f"{fk.label(schema.name)}: no parent").alias("_why")))
    return functools.reduce(DataFrame.unionAll, parts)


def _settled(existing: DataFrame, made: DataFrame, merge, schema: Table, touched: set[str], parents: dict[str, DataFrame] | None, persist: Persist = None) -> tuple[DataFrame, DataFrame, str | None]:
    """(rows with their errors, the table after those without, what is still broken). ``merge`` makes the table from rows.

    Rows that break a constraint are taken out once; if that leaves another one broken, the write fails as a whole.
    """
    frame = merge(made)
    bad = violations(existing, frame, schema, touched, parents, persist)
    if bad is None or (bad := bad.groupBy("_id").agg(F.min("_why").alias("_why"))).isEmpty():
        return made, frame, None
    made = made.join(bad.withColumnRenamed("_id", "_bad"), F.col("_id") == F.col("_bad"), "left").withColumn("_error", F.coalesce("_error", "_why")).drop("_bad", "_why")
    made = (persist or _same)(made)
    frame = merge(made)
    left = violations(existing, frame, schema, touched, parents, persist).select("_why").first()
    return made, frame, left[0] if left else None


def _merged(existing: DataFrame, made: DataFrame, schema: Table, given: list[str], exprs: dict[str, list[Expr]], now: Column | None, insert: bool) -> DataFrame:
    """The table with the accepted rows of ``made`` in it, and ``_changed`` and ``_id``.

    ``made`` has ``_id``, the row it is about, and ``_target``, the key of that row or null. Rows of one id are taken together: each
    field has its last value in arrival order. Fields that no row supplies stay as they were, or get their default.
    """
    key = schema.key.name
    seq = F.struct(*(c.alias(f"s{i}") for i, c in enumerate(_order(made))))
    fields = [c for c in schema.columns if c in given or c in exprs]

    def last(c: str) -> Column:
        number = F.col(f"_x_{c}") if f"_x_{c}" in made.columns else F.lit(None).cast("int")
        value = F.col(c) if c in given else F.lit(None).cast(schema.field(c).spark)
        return F.max_by(F.struct(value.alias("v"), number.alias("x")), F.when(_given(made, c) | number.isNotNull(), seq)).alias(f"_n_{c}")

    good = made.where("_error is null").groupBy("_id").agg(F.max("_target").alias("_target"), *map(last, fields))
    old = existing.select(*(F.col(c).alias(f"_old_{c}") for c in existing.columns), F.lit(True).alias("_was"))
    both = old.join(good, F.col("_target") == F.col(f"_old_{key}"), "full" if insert else "left")
    was = F.coalesce("_was", F.lit(False))
    old_of = lambda n: (F.col(f"_old_{n}"), existing.schema[n].dataType)
    out = []
    for c in existing.columns:
        kind, f = existing.schema[c].dataType, schema.field(c)
        default = literal(f.default, f.spark) if f.default is not None else now if f.default_now and now is not None else F.current_timestamp().cast("timestamp_ntz") if f.default_now else F.lit(None).cast(kind)
        value = F.when(was, F.col(f"_old_{c}")).otherwise(F.lit(None).cast(kind) if c == key else default)
        if c in fields:
            n = F.col(f"_n_{c}")
            if c == key:
                value = F.when(was, F.col(f"_old_{c}")).otherwise(n["v"])
            else:
                value = F.when(n.isNotNull(), n["v"]).otherwise(value)
            for i, e in enumerate(exprs.get(c, [])):
                made_of = compile_expr(e, old_of, was, now)
                new = cut_to_length(f, convert_column(made_of, both.select(made_of.alias("x")).schema["x"].dataType, f))
                value = F.when(n["x"] == i, new.cast(kind)).otherwise(value)
        out.append(value.cast(kind).alias(c))
    frame = both.select(*out, F.col("_id").isNotNull().alias("_changed"), "_id")
    if insert and schema.key.kind != KeyKind.none:
        frame = _keyed(frame.withColumn("_error", F.lit(None).cast("string")), existing, schema).drop("_error")
    return frame


def _broken_rules(frame: DataFrame, schema: Table, names: Iterable[str]) -> DataFrame:
    """Changed rows whose computed fields break a rule."""
    why = _first([r for c in names for r in rules(c, schema.field(c), F.col(c))])
    return frame.where(F.col("_changed")).select("_id", why.alias("_why")).where("_why is not null")


def _apply(existing: DataFrame, made: DataFrame, schema: Table, given: list[str], exprs: dict[str, list[Expr]], now, insert: bool, parents, persist: Persist) -> tuple[DataFrame, DataFrame, str | None]:
    """``_settled`` after the rules of computed fields."""
    made = (persist or _same)(made)
    merge = lambda rows: _merged(existing, rows, schema, given, exprs, now, insert)
    if exprs:
        bad = _broken_rules(merge(made), schema, exprs).withColumnRenamed("_id", "_bad")
        made = (persist or _same)(made.join(bad, F.col("_id") == F.col("_bad"), "left").withColumn("_error", F.coalesce("_error", "_why")).drop("_bad", "_why"))
    touched = set(given) | set(exprs) | (set(schema.columns) if insert else set())
    return _settled(existing, made, merge, schema, touched if insert else touched - {schema.key.name}, parents, persist)


def _exprs(rows: DataFrame, updates: dict[str, Expr | list[Expr]] | None) -> tuple[DataFrame, dict[str, list[Expr]]]:
    """Expressions by field. One that is no list is for all rows; of a list a row names its own by number in ``_x_<field>``."""
    out = {}
    for name, e in (updates or {}).items():
        out[name] = e if isinstance(e, list) else [e]
        if not isinstance(e, list):
            rows = rows.withColumn(f"_x_{name}", F.lit(0))
    return rows, out


def upsert(existing: DataFrame, rows: DataFrame, schema: Table, updates: dict[str, Expr | list[Expr]] | None = None, now: Column | None = None, parents: dict[str, DataFrame] | None = None, persist: Persist = None) -> Written:
    """Updates the row that a new row matches, by primary key or else by any complete unique key; inserts it if none.

    Only the fields that a row supplies change. Of several rows that match one, the last in arrival order counts, field by field. A
    row is rejected if its unique keys match different rows, if it leaves a unique value or a foreign key broken, or if it is new and lacks a
    field that may not be null. ``updates`` are expressions that see the old row; for inserts fields count as 0.
    ``persist`` writes the batch down (a checkpoint, say), so that the checks do not each work it out anew.
    """
    key = schema.key.name
    rows, exprs = _exprs(rows, updates)
    given = [c for c in rows.columns if c in schema.columns]
    made = validate(rows, schema, now, updating=True)
    targets, owns = [], []
    for i, (label, fields) in enumerate(schema.unique_keys().items()):
        if not set(fields) <= set(given):
            continue
        hit = existing.select(*(F.col(c).alias(f"_u{j}") for j, c in enumerate(fields)), F.col(key).alias(f"_t{i}"))
        made = made.join(hit, functools.reduce(operator.and_, (F.col(c) == F.col(f"_u{j}") for j, c in enumerate(fields))), "left").drop(*(f"_u{j}" for j in range(len(fields))))
        targets.append(f"_t{i}")
        owns.append(F.when(functools.reduce(operator.and_, (F.col(c).isNotNull() for c in fields)), F.to_json(F.struct(F.lit(label).alias("_key"), *fields))))
    target = F.coalesce(*targets) if targets else F.lit(None).cast(existing.schema[key].dataType)
    split = functools.reduce(operator.or_, (F.col(t).isNotNull() & (F.col(t) != target) for t in targets), F.lit(False))
    made = made.withColumn("_target", target).withColumn("_error", F.coalesce("_error", F.when(split, F.lit("matches several rows")))).drop(*targets)
    lacking = []
    for f in schema.fields:
        if not f.nullable and f.default is None and not f.default_now:
            there = _given(made, f.name) | (F.col(f"_x_{f.name}").isNotNull() if f"_x_{f.name}" in made.columns else F.lit(False))
            lacking.append(F.when(F.col("_target").isNull() & ~there, F.lit(f"{f.name}: null")))
    made = made.withColumn("_error", F.coalesce("_error", _first(lacking)))
    # identity of a row within the batch: what it matches, else its own key, else itself
    itself = F.concat(F.lit("row "), F.col("_seq").cast("string")) if "_seq" in made.columns else F.to_json(F.struct(*given))
    made = made.withColumn("_id", F.coalesce(F.col("_target").cast("string"), *owns, itself))
    made, frame, broken = _apply(existing, made, schema, given, exprs, now, True, parents, persist)
    action = F.when(F.col("_target").isNull(), "insert").otherwise("update")
    report = made.select((F.coalesce("_target", key) if key in given else F.col("_target")).alias("key"), action.alias("action"), F.col("_error").alias("error"))
    if broken:
        return Written(existing, report.withColumn("error", F.lit(broken)), False)
    return Written(frame.select(*existing.columns), report)


def batch_update(existing: DataFrame, rows: DataFrame, schema: Table, allow_partial: bool = True, now: Column | None = None, updates: dict[str, Expr | list[Expr]] | None = None, parents: dict[str, DataFrame] | None = None, persist: Persist = None) -> Written:
    """Updates rows by primary key; only the fields that a row supplies change. Unknown keys are errors, as are unique values that
    another row has and parents that are missing; of equal keys the last row counts, field by field. ``updates`` as for ``upsert``.
    """
    key = schema.key.name
    rows, exprs = _exprs(rows, updates)
    given = [c for c in rows.columns if c in schema.columns]
    made = validate(rows, schema, now, updating=True)
    known = existing.select(F.col(key).alias("_target"))
    made = made.join(known, F.col(key) == F.col("_target"), "left").withColumn("_error", F.coalesce("_error", F.when(F.col("_target").isNull(), F.lit("no such key")))).withColumn("_id", F.col("_target").cast("string"))
    made, frame, broken = _apply(existing, made, schema, given, exprs, now, False, parents, persist)
    report = made.select(F.col(key).alias("key"), F.lit("update").alias("action"), F.col("_error").alias("error"))
    if broken:
        return Written(existing, report.withColumn("error", F.lit(broken)), False)
    if not allow_partial and not report.where("error is not null").isEmpty():
        return Written(existing, report, False)
    return Written(frame.select(*existing.columns), report)


def chosen(existing: DataFrame, schema: Table, where: Condition, order: list[tuple[str, bool]] | None = None, limit: int | None = None, offset: int | None = None) -> Column | DataFrame:
    """The rows that a write is about: a predicate, or the keys of those that order, limit and offset pick."""
    test = where.to_column(resolver(existing))
    if limit is None and not offset:
        return F.coalesce(test, F.lit(False))
    key = schema.key.name
    by = [F.col(n).desc() if d else F.col(n).asc() for n, d in order or []] + [F.col(key)]
    picked = existing.where(test).orderBy(*by)
    if offset:
        picked = picked.offset(offset)
    return (picked if limit is None else picked.limit(limit)).select(key)


def _flag(existing: DataFrame, schema: Table, pick: Column | DataFrame) -> tuple[DataFrame, Column]:
    if isinstance(pick, Column):
        return existing, pick
    key = schema.key.name
    return existing.join(pick.select(F.col(key).alias("_pick")), F.col(key) == F.col("_pick"), "left"), F.col("_pick").isNotNull()


def update(existing: DataFrame, schema: Table, where: Condition, changes: dict[str, Any], allow_all: bool = False, order=None, limit=None, offset=None, now: Column | None = None, parents: dict[str, DataFrame] | None = None, persist: Persist = None) -> Written:
    """Sets fields to values or expressions in the rows that match. Primary keys do not change here. No match is ``notFound``.

    Rules hold as for new rows. A row that would come out with a unique value that another row has, or without its parent, stays
    as it was and is reported.
    """
    if where.is_empty and not allow_all and limit is None:
        raise ValueError("an update without a predicate needs allow_all")
    key = schema.key.name
    if key in changes:
        raise SchemaError("the primary key changes by rekey only")
    flagged, hit = _flag(existing, schema, chosen(existing, schema, where, order, limit, offset))
    cols, errors = {}, []
    for name, value in changes.items():
        f = schema.field(name)
        if isinstance(value, Expr):
            new = compile_expr(value, resolver(existing), True, now)
            new = convert_column(new, existing.select(new.alias("x")).schema["x"].dataType, f)
        else:
            new = literal(value, f.spark)
            if value is not None:
                errors.append(F.when(new.isNull(), F.lit(f"{name}: not a {FieldType(f.type).value}")))
        new = cut_to_length(f, new)
        errors += rules(name, f, new)
        cols[name] = new.cast(existing.schema[name].dataType)
    marked = flagged.withColumn("_hit", hit).withColumn("_error", F.when(F.col("_hit"), _first(errors))).withColumn("_id", F.when(F.col("_hit"), F.col(key).cast("string")))

    def merge(rows: DataFrame) -> DataFrame:
        """All right-hand sides see the old row."""
        change = F.col("_hit") & F.col("_error").isNull()
        return rows.select(*(F.when(change, cols[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in existing.columns), change.alias("_changed"), "_id")

    marked, frame, broken = _settled(existing, marked, merge, schema, set(changes), parents, persist)
    report = marked.where("_hit").select(F.col(key).alias("key"), F.lit("update").alias("action"), F.col("_error").alias("error"))
    if broken:
        return Written(existing, report.withColumn("error", F.lit(broken)), False)
    return Written(frame.select(*existing.columns), report)


def delete(existing: DataFrame, schema: Table, where: Condition, allow_all: bool = False, order=None, limit=None, offset=None) -> Written:
    """Removes the rows that match. No match is a success without keys."""
    if where.is_empty and not allow_all and limit is None:
        raise ValueError("a delete without a predicate needs allow_all")
    flagged, hit = _flag(existing, schema, chosen(existing, schema, where, order, limit, offset))
    report = flagged.where(hit).select(F.col(schema.key.name).alias("key"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("error"))
    return Written(flagged.where(~hit).select(*existing.columns), report)
