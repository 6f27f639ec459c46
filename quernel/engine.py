"""The database object: spaces of tables, queries, writes, transactions, key-value pairs, schema changes and backups."""

from __future__ import annotations

import contextlib
import dataclasses
import datetime as dt
import itertools
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.expr import Expr, field, greatest, least, now
from quernel.operators import constraints, lifetime, vector_search
from quernel.operators import write as W
from quernel.operators.vector_index import VectorIndex
from quernel.operators.write import Status, Written
from quernel.plans.condition import Condition
from quernel.plans.evolve import SchemaBuilder, apply_changes, broken, diff
from quernel.plans.query import QueryBuilder, StreamQueryBuilder
from quernel.schema import Field, FieldType, SchemaError, Table, creation_order
from quernel.sources.snapshots import Folder, Store

GLOBAL = "__global__"
KV = "__kv__"


@dataclasses.dataclass
class Result:
    """Outcome of a write. Keys are read from the report when asked for."""

    status: Status
    message: str = ""
    report: DataFrame | None = None

    @property
    def is_success(self) -> bool:
        return self.status == Status.success

    @property
    def is_partial(self) -> bool:
        return self.status == Status.partialSuccess

    @property
    def is_failed(self) -> bool:
        return self.status < 0

    def _keys(self, good: bool) -> list[str]:
        if self.report is None:
            return []
        rows = self.report.where(F.col("error").isNull() if good else F.col("error").isNotNull()).select(F.col("key").cast("string"))
        return [r[0] for r in rows.toLocalIterator()]

    @property
    def success_keys(self) -> list[str]:
        return self._keys(True)

    @property
    def failed_keys(self) -> list[str]:
        return self._keys(False)


class QueryCache:
    """Cached frames by query, dropped when a table they read changes or their time is over."""

    def __init__(self) -> None:
        self.held: dict[tuple, tuple[DataFrame, list[str], float]] = {}

    def get(self, key: tuple, tables: list[str], make: Callable[[], DataFrame], seconds: float) -> DataFrame:
        hit = self.held.get(key)
        if hit and hit[2] > time.monotonic():
            return hit[0]
        self.drop(key)
        frame = make().cache()
        self.held[key] = (frame, tables, time.monotonic() + seconds)
        return frame

    def drop(self, key: tuple) -> bool:
        hit = self.held.pop(key, None)
        if hit:
            hit[0].unpersist()
        return hit is not None

    def changed(self, table: str) -> None:
        for k in [k for k, (_, tables, _) in self.held.items() if table in tables]:
            self.drop(k)


class ConflictError(RuntimeError):
    """A table that a serializable transaction read was changed meanwhile."""


class Database:
    """Tables by space; global tables belong to all spaces. Frames are immutable snapshots, and a write makes a new one.

    With a ``path`` each write is a Parquet version plus a new manifest. In memory a new snapshot is checkpointed, so
    that plans do not grow from write to write.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, schemas: Iterable[Table] = ()):
        self.spark, self.path = spark, path
        self.space = "default"
        self.store = Store(Folder(spark, path)) if path else None
        self.manifest = self.store.load() if self.store else {"version": 0, "user_version": 0, "tables": {}}
        self.schemas: dict[tuple[str, str], Table] = {}
        self.frames: dict[tuple[str, str], DataFrame] = {}
        self.versions: dict[tuple[str, str], int] = {}
        self.cache = QueryCache()
        self.vector_indexes: dict[tuple, list] = {}  # (table, field) -> [index, the snapshot it is of]
        self.listeners: list[Callable[[dict], None]] = []
        self._transaction: dict | None = None
        self.migrations: dict[str, dict] = {}
        self.closed = False
        for entry in self.manifest["tables"].values():
            where = (entry["space"], entry["name"])
            self.schemas[where] = Table.from_dict(entry["schema"])
            self.frames[where] = self.store.folder.read_frame(entry["folder"])
            self.versions[where] = entry["version"]
        if list(schemas):
            self.declare(list(schemas))

    # -- opening and closing -----------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str = "db", schemas: Iterable[Table] = (), reinitialize: bool = False) -> Database:
        where = f"{path.rstrip('/')}/{name}"
        if reinitialize:
            Folder(spark, where).delete()
        return cls(spark, where, schemas)

    @classmethod
    def memory(cls, spark: SparkSession, schemas: Iterable[Table] = ()) -> Database:
        return cls(spark, None, schemas)

    @classmethod
    def over(cls, spark: SparkSession, folder: str, schemas: Iterable[Table]) -> Database:
        """Read-only use of existing Parquet tables ``folder/<table>.parquet``."""
        db = cls(spark)
        for s in schemas:
            db.schemas[db._where(s.name, s)] = s
            db.frames[db._where(s.name, s)] = spark.read.parquet(f"{folder}/{s.name}.parquet")
        return db

    def close(self) -> None:
        for k in list(self.cache.held):
            self.cache.drop(k)
        self.closed = True

    def flush(self) -> None:
        """Writes are durable when they return; nothing waits."""

    def delete_database(self) -> None:
        if self.store:
            self.store.folder.delete()
        self.schemas, self.frames, self.versions = {}, {}, {}
        self.manifest = {"version": 0, "user_version": 0, "tables": {}}

    @property
    def instance_path(self) -> str | None:
        return self.path

    @property
    def config(self) -> dict:
        return {"path": self.path, "space": self.space, "default_page": 1000, "most_offset": 10_000}

    @property
    def status(self) -> dict:
        return {"open": not self.closed, "space": self.space, "tables": len(self.schemas), "version": self.manifest["version"], "cached_queries": len(self.cache.held), "migrations": list(self.migrations.values())}

    def get_version(self) -> int:
        return self.manifest["user_version"]

    def set_version(self, n: int) -> None:
        self.manifest["user_version"] = n
        if self.store:
            self.store.commit(self.manifest)

    # -- catalog -----------------------------------------------------------------------------------------------

    def _where(self, table: str, schema: Table | None = None) -> tuple[str, str]:
        if schema is not None:
            return (GLOBAL if schema.is_global else self.space, table)
        return (GLOBAL, table) if (GLOBAL, table) in self.schemas else (self.space, table)

    def schema(self, table: str) -> Table:
        where = self._where(table)
        if where not in self.schemas:
            raise KeyError(f"no table {table!r} in space {self.space!r}")
        return self.schemas[where]

    def frame(self, table: str) -> DataFrame:
        """The current snapshot; within a transaction, that of the transaction."""
        where = self._where(table)
        self.schema(table)
        if self._transaction is not None:
            self._transaction["read"].setdefault(where, self.versions.get(where, 0))
            if where in self._transaction["frames"]:
                return self._transaction["frames"][where]
        return self.frames[where]

    def _all(self) -> dict[str, Table]:
        return {name: s for (space, name), s in self.schemas.items() if space in (self.space, GLOBAL)}

    def _set(self, new: dict[str, DataFrame], event: dict | None = None) -> None:
        """Makes frames current: within a transaction its own, else committed at once."""
        changed = {self._where(t): f for t, f in new.items()}
        if self._transaction is not None:
            self._transaction["frames"] |= changed
            self._transaction["events"] += [event] if event else []
            return
        self._commit(changed, [event] if event else [])

    def _commit(self, changed: dict[tuple[str, str], DataFrame], events: list[dict]) -> None:
        """All snapshots are written before the manifest names any of them."""
        for where, frame in changed.items():
            folder = None
            if self.store:
                folder, frame = self.store.write(*where, frame)
            else:
                frame = _checkpoint(frame)
            self.frames[where] = frame
            self.versions[where] = self.versions.get(where, 0) + 1
            self.manifest["tables"]["/".join(where)] = {"space": where[0], "name": where[1], "folder": folder, "version": self.versions[where], "schema": json.loads(json.dumps(self.schemas[where].to_dict(), default=str))}
            self.cache.changed(where[1])
        if self.store:
            self.store.commit(self.manifest)
        for e in events:
            for listen in list(self.listeners):
                listen(e)

    def create_table(self, schema: Table) -> Result:
        return self.create_tables([schema])

    def create_tables(self, schemas: list[Table]) -> Result:
        """Parents first; a table that exists already fails the call."""
        made: dict[tuple[str, str], DataFrame] = {}
        schemas = [s.with_ingest_time() for s in schemas]
        for s in creation_order(schemas):
            where = self._where(s.name, s)
            if where in self.schemas:
                return Result(Status.tableExists, s.name)
            constraints.check_references(self._all() | {x.name: x for x in schemas}, s)
            self.schemas[where] = s
            made[where] = self.spark.createDataFrame([], s.struct)
        self._commit(made, [])
        return Result(Status.success)

    def declare(self, schemas: list[Table]) -> list[str]:
        """Creates tables that are missing and migrates those whose stored schema differs. Returns what was done."""
        done = []
        schemas = [s.with_ingest_time() for s in schemas]
        missing = [s for s in schemas if self._where(s.name, s) not in self.schemas]
        if missing:
            self.create_tables(missing)
            done += [f"create {s.name}" for s in missing]
        for s in schemas:
            old = self.schemas[self._where(s.name, s)]
            ops = diff(old, s)
            if ops:
                self._migrate(s.name, ops)
                done += [f"{op[0]} {s.name}.{op[1]}" for op in ops]
        return done

    def _migrate(self, table: str, ops: list[tuple]) -> str:
        """One commit of schema and rows. Rows that break what is new, or values that cannot be converted, raise and leave all as it was."""
        where = self._where(table)
        task = uuid.uuid4().hex
        self.migrations[task] = state = {"id": task, "table": table, "operations": len(ops), "state": "failed"}
        schema, frame = apply_changes(self.schemas[where], self.frames[where], ops)
        constraints.check_references(self._all() | {schema.name: schema}, schema)
        why = broken(schema, frame, ops, {k.table: self.frame(k.table) for k in schema.foreign_keys if k.table not in (table, schema.name) and self.table_exists(k.table)})
        if why:
            raise SchemaError(f"{table}: {why}")
        state["state"] = "done"
        if schema.name != table:
            for k in ("schemas", "frames", "versions"):
                getattr(self, k).pop(where, None)
            self.manifest["tables"].pop("/".join(where), None)
            for w, s in list(self.schemas.items()):
                if any(k.table == table for k in s.foreign_keys):
                    self.schemas[w] = s.with_(foreign_keys=tuple(dataclasses.replace(k, table=schema.name) if k.table == table else k for k in s.foreign_keys))
            where = (where[0], schema.name)
        self.schemas[where] = schema
        self._commit({where: frame}, [])
        return task

    def update_schema(self, table: str) -> SchemaBuilder:
        self.schema(table)
        return SchemaBuilder(table, lambda ops: self._migrate(table, ops))

    def query_migration_task_status(self, task: str) -> dict | None:
        return self.migrations.get(task)

    def table_exists(self, table: str) -> bool:
        return self._where(table) in self.schemas

    def get_table_schema(self, table: str) -> Table | None:
        return self.schemas.get(self._where(table))

    def get_table_info(self, table: str) -> dict:
        where, s = self._where(table), self.schema(table)
        return {"name": table, "space": where[0], "rows": self.frame(table).count(), "columns": s.columns, "version": self.versions.get(where, 0), "indexes": [i.label(table) for i in s.indexes]}

    def drop_table(self, table: str) -> Result:
        """Fails if rows of other tables refer to it and restrict; otherwise they cascade."""
        if not self.table_exists(table):
            return Result(Status.notFound, table)
        result = self.clear(table)
        if result.is_failed:
            return result
        where = self._where(table)
        for k in ("schemas", "frames", "versions"):
            getattr(self, k).pop(where, None)
        self.manifest["tables"].pop("/".join(where), None)
        if self.store:
            self.store.commit(self.manifest)
        return Result(Status.success)

    def switch_space(self, space: str = "default") -> bool:
        self.space = space
        return True

    @property
    def current_space_name(self) -> str:
        return self.space

    def list_spaces(self) -> list[str]:
        return sorted({s for s, _ in self.schemas if s != GLOBAL} | {"default"})

    def get_space_info(self) -> dict:
        tables = [n for (s, n) in self.schemas if s == self.space]
        return {"space": self.space, "tables": tables, "rows": sum(self.frame(t).count() for t in tables)}

    def delete_space(self, space: str) -> Result:
        if space == self.space:
            return Result(Status.dbError, "the current space stays")
        for where in [w for w in self.schemas if w[0] == space]:
            for k in ("schemas", "frames", "versions"):
                getattr(self, k).pop(where, None)
            self.manifest["tables"].pop("/".join(where), None)
        if self.store:
            self.store.commit(self.manifest)
            self.store.folder.delete(space)
        return Result(Status.success)

    # -- reading -----------------------------------------------------------------------------------------------

    def query(self, table: str) -> QueryBuilder:
        return QueryBuilder(self, table)

    def stream_query(self, table: str) -> StreamQueryBuilder:
        return StreamQueryBuilder(self, table)

    def query_each_batch(self, query: QueryBuilder, each: Callable[[list], Any], size: int = 1000) -> int:
        """Rows in the query's order to ``each``, ``size`` at a time, until it returns False. Returns the rows seen.

        The query runs and sorts once; its partitions then come to the driver one after the other.
        """
        seen, rows = 0, query.clone().ordered().iter()
        while part := list(itertools.islice(rows, size)):
            seen += len(part)
            if each(part) is False:
                break
        return seen

    def vector_search(self, table: str, name: str, query: list[float], top_k: int = 10, metric: str = "cosine", threshold: float | None = None, ef_search: int | None = None) -> DataFrame:
        """The nearest rows: over all rows, or with ``ef_search`` through the field's index, which is made or brought up to date first; both are exact."""
        frame, key = self.frame(table), self.schema(table).key.name
        if ef_search is None:
            return vector_search.search(frame, name, query, top_k, metric, key, threshold)
        return self.vector_index(table, name).search(frame, query, top_k, metric, threshold, ef_search)

    def vector_index(self, table: str, name: str, parts: int = 16) -> VectorIndex:
        """The index of a field, as of the table's current rows."""
        where, frame = self._where(table), self.frame(table)
        held = self.vector_indexes.get((where, name))
        if held is None:
            held = [VectorIndex(frame, name, self.schema(table).key.name, parts, _checkpoint), frame]
            self.vector_indexes[where, name] = held
        elif held[1] is not frame:
            held[0].refresh(frame)
            held[1] = frame
        return held[0]

    # -- writing -----------------------------------------------------------------------------------------------

    def rows_frame(self, table: str, rows: DataFrame | list[dict]) -> DataFrame:
        return self.rows_and_exprs(table, rows)[0]

    def rows_and_exprs(self, table: str, rows: DataFrame | list[dict]) -> tuple[DataFrame, dict[str, list[Expr]]]:
        """Dicts as a frame with their arrival order in ``_seq`` and the fields each supplies in ``_given``; and the expressions
        among the values by field, which rows name by number in ``_x_<field>``.
        """
        if isinstance(rows, DataFrame):
            return rows, {}
        names = list(dict.fromkeys(k for r in rows for k in r))
        kinds, exprs = [], {}
        schema = self.schema(table)
        for n in names:
            values = [r.get(n) for r in rows if r.get(n) is not None]
            if n in schema.columns and any(isinstance(v, str) for v in values) and schema.field(n).type not in (FieldType.text, FieldType.json):
                kinds.append("string")
            elif n in schema.columns:
                kinds.append(schema.field(n).spark.simpleString())
            else:
                raise SchemaError(f"{table} has no field {n!r}")
            found = {repr(v): v for v in values if isinstance(v, Expr)}  # by repr, for 1 and True are equal
            if found:
                exprs[n] = found
        from quernel.functions.values import convert_literal

        def cell(n: str, kind: str, v: Any) -> Any:
            if v is None or isinstance(v, Expr):
                return None
            if isinstance(v, list) or kind == "string" and isinstance(v, str):
                return v
            # a text among other values: all become text, so that what cannot be converted is seen as that
            return convert_literal(v, T.StringType() if kind == "string" else schema.field(n).spark)

        def number(n: str, v: Any) -> int | None:
            return list(exprs[n]).index(repr(v)) if isinstance(v, Expr) else None

        data = [(i, list(r), *(number(n, r.get(n)) for n in exprs), *(cell(n, k, r.get(n)) for n, k in zip(names, kinds, strict=True))) for i, r in enumerate(rows)]
        kinds = ["_seq long", "_given array<string>", *(f"`_x_{n}` int" for n in exprs), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))]
        return self.spark.createDataFrame(data, ", ".join(kinds)), {n: list(found.values()) for n, found in exprs.items()}

    def _parents(self, table: str) -> dict[str, DataFrame]:
        return {k.table: self.frame(k.table) for k in self.schema(table).foreign_keys if self.table_exists(k.table)}

    def _written(self, table: str, written: Written, op: str) -> Result:
        report = _checkpoint(written.report)
        status = Written(written.frame, report, written.applied).status()
        if status >= 0:
            event = {"op": op, "table": table, "report": report, "before": self.frame(table)}
            self._set({table: written.frame}, event)
        return Result(status, "" if status >= 0 else str(report.where("error is not null").select("error").limit(1).collect()[0][0]), report)

    def insert(self, table: str, row: dict) -> Result:
        return self.batch_insert(table, [row], allow_partial_errors=False)

    def batch_insert(self, table: str, rows, allow_partial_errors: bool = True) -> Result:
        return self._written(table, W.insert(self.frame(table), self.rows_frame(table, rows), self.schema(table), allow_partial_errors, self._parents(table)), "insert")

    def upsert(self, table: str, row: dict) -> Result:
        return self.batch_upsert(table, [row])

    def batch_upsert(self, table: str, rows) -> Result:
        frame, exprs = self.rows_and_exprs(table, rows)
        return self._written(table, W.upsert(self.frame(table), frame, self.schema(table), exprs, parents=self._parents(table), persist=_checkpoint), "upsert")

    def batch_update(self, table: str, rows, allow_partial_errors: bool = True) -> Result:
        frame, exprs = self.rows_and_exprs(table, rows)
        return self._written(table, W.batch_update(self.frame(table), frame, self.schema(table), allow_partial_errors, updates=exprs, parents=self._parents(table), persist=_checkpoint), "update")

    def update(self, table: str, values: dict | None = None) -> UpdateBuilder:
        return UpdateBuilder(self, table, values)

    def delete(self, table: str) -> DeleteBuilder:
        return DeleteBuilder(self, table)

    def clear(self, table: str) -> Result:
        return DeleteBuilder(self, table).allow_delete_all().run()

    def rekey(self, table: str, changes: DataFrame) -> Result:
        """Changes primary keys: ``changes`` has ``old`` and ``new``. Foreign keys follow, are emptied or forbid it."""
        schemas = self._all()
        try:
            done = constraints.cascade_update({t: self.frame(t) for t in schemas}, schemas, table, changes)
        except constraints.ConstraintError as e:
            return Result(Status.foreignKeyViolation, str(e))
        changed = {t: f for t, f in done.frames.items() if f is not self.frame(t)}
        self._set(changed, {"op": "update", "table": table, "tables": list(changed)})
        return Result(Status.success)

    def cleanup_ttl(self, table: str, at: dt.datetime | None = None) -> Result:
        """Deletes rows whose lifetime, from its field or from when they were written, is over."""
        source = self.schema(table).ttl_source
        if not source:
            return Result(Status.success)
        frame = self.frame(table)
        over = lifetime.expired(source, self.schema(table).ttl.ms, at)
        report = frame.where(over).select(F.col(self.schema(table).key.name).alias("key"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("error"))
        return self._written(table, Written(frame.where(~over), report), "delete")

    # -- transactions ------------------------------------------------------------------------------------------

    @contextlib.contextmanager
    def transaction(self, serializable: bool = False):
        """Writes inside are one commit at the end; an exception drops them all. Inner transactions join the outer one.

        ``serializable``: the commit fails if a table that was read has a newer version by then.
        """
        if self._transaction is not None:
            yield self
            return
        mine = self._transaction = {"frames": {}, "read": {}, "events": []}
        try:
            yield self
        except BaseException:
            self._transaction = None
            raise
        self._transaction = None
        if serializable and any(self._current(w) != v for w, v in mine["read"].items()):
            raise ConflictError("a table changed while the transaction ran")
        self._commit(mine["frames"], mine["events"])

    def _current(self, where: tuple[str, str]) -> int:
        entry = (self.store.load() if self.store else self.manifest)["tables"].get("/".join(where))
        return entry["version"] if entry else self.versions.get(where, 0)

    # -- key-value pairs ---------------------------------------------------------------------------------------

    @property
    def kv(self):
        from quernel.kv import KeyValues

        return KeyValues(self)

    def set_value(self, key: str, value: Any, **options) -> Result:
        return self.kv.set(key, value, **options)

    def get_value(self, key: str, is_global: bool = False) -> Any:
        return self.kv.get(key, is_global=is_global)

    def remove_value(self, key: str, is_global: bool = False) -> Result:
        return self.kv.remove(key, is_global=is_global)

    def watch_value(self, key: str, **options):
        return self.kv.watch(key, **options)

    def watch_values(self, keys: Iterable[str], **options):
        return self.kv.watch_values(keys, **options)

    # -- backup ------------------------------------------------------------------------------------------------

    def backup(self, path: str, scope: str = "spaceWithGlobal") -> str:
        """Copies the snapshots of a ``space``, a ``spaceWithGlobal`` or the whole ``database`` to ``path``, with a manifest."""
        target = Store(Folder(self.spark, path))
        out = {"version": target.load()["version"], "user_version": self.manifest["user_version"], "tables": {}}
        for where, s in self.schemas.items():
            if scope == "database" or where[0] == self.space or scope == "spaceWithGlobal" and where[0] == GLOBAL:
                folder, _ = target.write(*where, self.frames[where])
                out["tables"]["/".join(where)] = {"space": where[0], "name": where[1], "folder": folder, "version": 1, "schema": json.loads(json.dumps(s.to_dict(), default=str))}
        target.commit(out)
        return path

    def restore(self, path: str, cleanup: bool = True) -> bool:
        """Brings back the tables of a backup. ``cleanup``: other tables of the restored spaces go first."""
        source = Store(Folder(self.spark, path))
        found = source.load()["tables"].values()
        if not found:
            return False
        if cleanup:
            spaces = {e["space"] for e in found}
            for where in [w for w in self.schemas if w[0] in spaces]:
                for k in ("schemas", "frames"):
                    getattr(self, k).pop(where, None)
                self.manifest["tables"].pop("/".join(where), None)
        changed = {}
        for e in found:
            where = (e["space"], e["name"])
            self.schemas[where] = Table.from_dict(e["schema"])
            changed[where] = source.folder.read_frame(e["folder"])
        self._commit(changed, [])
        return True


class _WriteBuilder(Condition):
    def __init__(self, db: Database, table: str):
        super().__init__()
        self.db, self.table = db, table
        self.order: list[tuple[str, bool]] = []
        self.limit_rows: int | None = None
        self.offset_rows: int | None = None
        self.all = False

    def order_by_asc(self, name: str):
        self.order.append((name, False))
        return self

    def order_by_desc(self, name: str):
        self.order.append((name, True))
        return self

    def limit(self, n: int):
        self.limit_rows = n
        return self

    def offset(self, n: int):
        self.offset_rows = n
        return self


class UpdateBuilder(_WriteBuilder):
    """Collects changes; ``run`` applies them to the rows that match."""

    def __init__(self, db: Database, table: str, values: dict | None = None):
        super().__init__(db, table)
        self.changes: dict[str, Any] = dict(values or {})
        self.partial = False

    def set(self, values: dict):
        self.changes |= values
        return self

    def set_field(self, name: str, value: Any):
        return self.set({name: value})

    def compute(self, name: str, expr: Expr):
        return self.set({name: expr})

    def _own(self, name: str) -> Expr:
        return self.changes[name] if isinstance(self.changes.get(name), Expr) else field(name)

    def increment(self, name: str, by=1):
        return self.compute(name, self._own(name) + by)

    def decrement(self, name: str, by=1):
        return self.compute(name, self._own(name) - by)

    def multiply(self, name: str, by):
        return self.compute(name, self._own(name) * by)

    def divide(self, name: str, by):
        return self.compute(name, self._own(name) / by)

    def min(self, name: str, limit):
        """The smaller of the value and ``limit``."""
        return self.compute(name, least(self._own(name), limit))

    def max(self, name: str, limit):
        return self.compute(name, greatest(self._own(name), limit))

    def clamp(self, name: str, low, high):
        return self.compute(name, least(greatest(self._own(name), low), high))

    def set_server_timestamp(self, name: str):
        return self.compute(name, now())

    def allow_update_all(self):
        self.all = True
        return self

    def allow_partial_errors(self):
        self.partial = True
        return self

    def run(self) -> Result:
        written = W.update(self.db.frame(self.table), self.db.schema(self.table), self, self.changes, self.all, self.order, self.limit_rows, self.offset_rows, parents=self.db._parents(self.table))
        report = _checkpoint(written.report)
        if report.isEmpty():
            return Result(Status.notFound, "no row matches", report)
        if not self.partial and not report.where("error is not null").isEmpty():
            return Result(Status.validationFailed, report.where("error is not null").first().error, report)
        return self.db._written(self.table, Written(written.frame, report, written.applied), "update")


class DeleteBuilder(_WriteBuilder):
    def allow_delete_all(self):
        self.all = True
        return self

    def run(self) -> Result:
        db, schemas = self.db, self.db._all()
        schema = db.schema(self.table)
        written = W.delete(db.frame(self.table), schema, self, self.all, self.order, self.limit_rows, self.offset_rows)
        if not constraints.referencing(schemas, self.table):
            return db._written(self.table, written, "delete")
        victims = written.report.select(F.col("key").alias(schema.key.name))
        try:
            done = constraints.cascade_delete({t: db.frame(t) for t in schemas}, schemas, self.table, victims, persist=_checkpoint)
        except constraints.ConstraintError as e:
            return Result(Status.foreignKeyViolation, str(e))
        report = _checkpoint(written.report)
        changed = {t: f for t, f in done.frames.items() if f is not db.frame(t)}
        db._set(changed, {"op": "delete", "table": self.table, "tables": list(changed), "report": report, "before": db.frame(self.table)})
        return Result(Status.success, "", report)


def _checkpoint(frame: DataFrame) -> DataFrame:
    """Cuts the lineage of a snapshot, in the folder ``spark.checkpoint.dir`` that the driver and all executors share.

    Where it is unset, a local session gets one of its own; on a cluster that is an error, for executors would not find it.
    """
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"quernel-{os.getpid()}"))
    return frame.checkpoint(eager=True)


def table_of(name: str, key: str, fields: dict[str, str], **options) -> Table:
    """A schema from a dict of field types."""
    from quernel.schema import PrimaryKey

    return Table(name, tuple(Field(n, FieldType(t)) for n, t in fields.items()), PrimaryKey(key), **options)
