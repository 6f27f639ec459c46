"""The query builder: a chain of calls that becomes one lazy DataFrame."""

from __future__ import annotations

import copy
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernel.functions.values import literal
from quernel.plans import cursor as keyset
from quernel.plans.aggregate import Agg
from quernel.plans.condition import Condition
from quernel.schema import INGESTED, Table

DEFAULT_PAGE = 1000
MOST_OFFSET = 10_000
_ALIAS = re.compile(r"(.+?)\s+as\s+([A-Za-z0-9_]+)", re.IGNORECASE)


@dataclass
class Page:
    rows: list[Row]
    next_cursor: str | None
    prev_cursor: str | None
    has_more: bool
    has_prev: bool
    elapsed_ms: int
    query: QueryBuilder = field(repr=False)

    def next(self) -> Page | None:
        return self.query.clone().cursor(self.next_cursor).page() if self.has_more else None

    def prev(self) -> Page | None:
        return self.query.clone().cursor(self.prev_cursor).page() if self.has_prev else None

    @property
    def total(self) -> int:
        """Rows of the table, whatever the predicate."""
        return self.query.source(self.query.table).count()


@dataclass(frozen=True)
class Join:
    table: str
    pairs: tuple[tuple[str, str, str], ...]  # left field, operator, right field
    how: str


class QueryBuilder(Condition):
    """Reads one table of a database, joined to others if asked. Nothing runs before a terminal is called.

    ``df()`` is the lazy result without an implicit limit; ``page()`` applies the default of 1000 rows. Limits apply
    behind joins, filters and grouping, and every order ends in the primary key.
    """

    def __init__(self, database, table: str):
        super().__init__()
        self.database, self.table = database, table
        self.items: list[Any] = []
        self.groups_by: list[str] = []
        self.having_condition: Condition | None = None
        self.distinct_fields: list[str] | None = None
        self.joins: list[Join] = []
        self.order: list[tuple[str, bool]] = []
        self.limit_rows: int | None = None
        self.offset_rows: int | None = None
        self.cursor_token: str | None = None
        self.cache_seconds: float | None = None

    def source(self, table: str) -> DataFrame:
        return self.database.frame(table)

    # -- building ---------------------------------------------------------------------------------------------

    def clone(self) -> QueryBuilder:
        out = copy.copy(self)
        for k in ("groups", "items", "groups_by", "joins", "order"):
            setattr(out, k, copy.deepcopy(getattr(self, k)))
        return out

    def select(self, items: list):
        """Fields, ``"field as name"``, and aggregates."""
        self.items = list(items)
        return self

    def select_agg(self, items: list):
        self.items += list(items)
        return self

    def group_by(self, fields: list[str]):
        self.groups_by = list(fields)
        return self

    def having(self, condition: Condition):
        """A predicate on output columns; tests may name an aggregate itself."""
        self.having_condition = condition
        return self

    def distinct(self, fields: list[str] | None = None):
        """Distinct rows, or the first row, in the query's order, of each value of ``fields``."""
        self.distinct_fields = list(fields or [])
        return self

    def _join(self, table: str, first: str, op: str, second: str, how: str):
        op = "!=" if op == "<>" else op
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise ValueError(f"joins do not know {op!r}")
        self.joins.append(Join(table, ((first, op, second),), how))
        return self

    def join(self, table: str, first: str, op: str, second: str):
        return self._join(table, first, op, second, "inner")

    def left_join(self, table: str, first: str, op: str, second: str):
        return self._join(table, first, op, second, "left")

    def right_join(self, table: str, first: str, op: str, second: str):
        return self._join(table, first, op, second, "right")

    def join_referenced_table(self, table: str, how: str = "inner"):
        """Child to parent, by the foreign key of this table or one joined before."""
        for child in (self.table, *(j.table for j in self.joins)):
            for k in self.database.schema(child).foreign_keys:
                if k.table == table:
                    self.joins.append(Join(table, tuple((f"{child}.{a}", "=", f"{table}.{b}") for a, b in zip(k.fields, k.referenced, strict=True)), how))
                    return self
        raise ValueError(f"no foreign key of {self.table} refers to {table}")

    def join_referencing_table(self, table: str, how: str = "left"):
        """Parent to child, by the foreign key of ``table``."""
        for parent in (self.table, *(j.table for j in self.joins)):
            for k in self.database.schema(table).foreign_keys:
                if k.table == parent:
                    self.joins.append(Join(table, tuple((f"{parent}.{b}", "=", f"{table}.{a}") for a, b in zip(k.fields, k.referenced, strict=True)), how))
                    return self
        raise ValueError(f"no foreign key of {table} refers to {self.table}")

    def join_with_foreign_key(self, table: str, how: str = "inner"):
        """Whichever direction a foreign key exists in."""
        try:
            return self.join_referenced_table(table, how)
        except ValueError:
            return self.join_referencing_table(table, how)

    def order_by(self, text: str):
        """``-field``, ``field DESC`` or ``field ASC``."""
        name, _, way = text.strip().partition(" ")
        return self.order_by_desc(name.lstrip("-")) if name.startswith("-") or way.strip().upper() == "DESC" else self.order_by_asc(name)

    def order_by_asc(self, name: str):
        self.order.append((name, False))
        return self

    def order_by_desc(self, name: str):
        self.order.append((name, True))
        return self

    def limit(self, n: int):
        if n < 0:
            raise ValueError("a limit cannot be negative")
        self.limit_rows = n
        return self

    def offset(self, n: int):
        if not 0 <= n <= MOST_OFFSET:
            raise ValueError(f"an offset is from 0 to {MOST_OFFSET}; use a cursor beyond that")
        self.offset_rows, self.cursor_token = n, None
        return self

    def cursor(self, token: str | None):
        self.cursor_token, self.offset_rows = token, None
        return self

    def use_query_cache(self, seconds: float = 60.0):
        """Keep the rows of ``df()`` in the executors until the table changes or the time is over."""
        self.cache_seconds = seconds
        return self

    def no_query_cache(self):
        self.cache_seconds = None
        return self

    def clear_query_cache(self) -> bool:
        return self.database.cache.drop(self._cache_key())

    # -- compiling --------------------------------------------------------------------------------------------

    def _resolver(self, frame: DataFrame):
        """Field to (column, type): ``t.c``, ``t_c``, then ``c`` of the main table or of the one table that has it, then a path."""
        kinds = {f.name: f.dataType for f in frame.schema}

        def resolve(name: str) -> tuple[Column, T.DataType]:
            name = getattr(name, "name", name)
            if not self.joins:
                tries = [name, name.removeprefix(f"{self.table}."), name.removeprefix(f"{self.table}_")]
            else:
                tables = [self.table, *(j.table for j in self.joins)]
                tries = [name, *(f"{t}.{name[len(t) + 1 :]}" for t in tables if name.startswith(f"{t}_")), *(f"{t}.{name}" for t in tables)]
            for x in tries:
                if x in kinds:
                    return F.col(f"`{x}`"), kinds[x]
            head, _, rest = name.partition(".")
            if rest and head != name:
                try:
                    col, kind = resolve(head)
                except KeyError:
                    raise KeyError(f"no field {name!r} in {sorted(kinds)}") from None
                if isinstance(kind, (T.StructType, T.MapType)):
                    inner = frame.select(col.getItem(rest) if "." not in rest else col[rest.split(".")[0]]).schema[0].dataType
                    return col.getItem(rest), inner
                if isinstance(kind, T.StringType):
                    return F.get_json_object(col, f"$.{rest}"), T.StringType()
            raise KeyError(f"no field {name!r} in {sorted(kinds)}")

        return resolve

    def _joined(self) -> DataFrame:
        if not self.joins:
            return self.source(self.table)

        def named(table: str) -> DataFrame:
            frame = self.source(table)
            return frame.select(*(F.col(f"`{c}`").alias(f"{table}.{c}") for c in frame.columns))

        out, seen = named(self.table), [self.table]
        for j in self.joins:
            if j.table in seen:
                raise ValueError(f"{j.table} is joined twice")
            right = named(j.table)

            def side(name: str, right=right, out=out, seen=seen, table=j.table) -> tuple[str, bool]:
                """The column a join field means and whether it is the new table's."""
                if name in right.columns or name in out.columns:
                    return name, name in right.columns
                return next(((f"{t}.{name}", t == table) for t in [*seen, table] if f"{t}.{name}" in (right if t == table else out).columns), ("", False))

            on = None
            for first, op, second in j.pairs:
                (a, _), (b, b_right) = side(first), side(second)
                if not b_right and f"{j.table}.{second}" in right.columns:
                    b = f"{j.table}.{second}"
                if not a or not b:
                    raise KeyError(f"cannot join {self.table} and {j.table} on {first} {op} {second}")
                x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
                test = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
                on = test if on is None else on & test
            out = out.join(right, on, j.how)
            seen.append(j.table)
        return out

    def _default_items(self, frame: DataFrame) -> list[Column]:
        """All columns; after joins without their table's name unless two tables share a field's."""
        columns = [c for c in frame.columns if c.rpartition(".")[2] != INGESTED]
        if not self.joins:
            return [F.col(f"`{c}`") for c in columns]
        short = [c.partition(".")[2] for c in columns]
        return [F.col(f"`{c}`").alias(s if short.count(s) == 1 else c) for c, s in zip(columns, short, strict=True)]

    def _items(self, frame: DataFrame, resolve) -> list[Column]:
        plain = [i for i in self.items if not isinstance(i, Agg)]
        if not plain:
            return self._default_items(frame)
        out = []
        for i in plain:
            m = _ALIAS.fullmatch(i)
            out.append(resolve(m[1])[0].alias(m[2]) if m else resolve(i)[0].alias(i if self.joins and "." in i and resolve(i)[0] is not None else i))
        return out

    @property
    def aggregates(self) -> list[Agg]:
        return [i for i in self.items if isinstance(i, Agg)]

    def _key(self) -> str | None:
        schema = self.database.schema(self.table)
        return (f"{self.table}.{schema.key.name}" if self.joins else schema.key.name) if schema and schema.key.name else None

    def _grouped(self, frame: DataFrame, resolve) -> DataFrame:
        names = {}
        for i in self.items:
            if isinstance(i, str) and (m := _ALIAS.fullmatch(i)):
                names[m[1]] = m[2]
        keys = [resolve(g)[0].alias(names.get(g, g)) for g in self.groups_by]
        aggs = [a.column(resolve) for a in self.aggregates]
        if keys:
            out = frame.groupBy(*keys).agg(*aggs) if aggs else frame.select(*keys).distinct()
        else:
            out = frame.agg(*aggs)
        if self.having_condition:
            out = out.where(self.having_condition.to_column(lambda n: (F.col(f"`{n}`"), out.schema[n].dataType)))
        return out

    def _filtered(self) -> tuple[DataFrame, Any]:
        frame = self._joined()
        resolve = self._resolver(frame)
        return (frame if self.is_empty else frame.where(self.to_column(resolve))), resolve

    def _sorted(self, frame: DataFrame, order: list[tuple[str, bool]], resolve, reverse: bool = False) -> DataFrame:
        cols = [resolve(n)[0] for n, _ in order]
        return frame.orderBy(*(c.desc() if d != reverse else c.asc() for c, (_, d) in zip(cols, order, strict=True))) if cols else frame

    def _full_order(self, frame: DataFrame, default: bool = False) -> list[tuple[str, bool]]:
        """The order with the primary key behind it; the key alone if ``default``."""
        key = self._key()
        order = list(self.order)
        if (order or default) and key in frame.columns and key not in [n for n, _ in order]:
            order.append((key, False))
        return order

    def _compiled(self) -> DataFrame:
        frame, resolve = self._filtered()
        if self.aggregates or self.groups_by:
            out = self._grouped(frame, resolve)
            out = self._sorted(out, self.order, lambda n: (F.col(f"`{n}`"), None))
        elif self.distinct_fields is not None and not self.distinct_fields:
            out = frame.select(*self._items(frame, resolve)).distinct()
            out = self._sorted(out, self.order, lambda n: (F.col(f"`{n}`"), None))
        else:
            order = self._full_order(frame, self.limit_rows is not None or bool(self.offset_rows) or bool(self.distinct_fields))
            if self.distinct_fields:
                frame = self._first_rows(frame, resolve, order)
            items = self._items(frame, resolve)
            return self._limited(self._sorted(frame, order, resolve)).select(*items)
        return self._limited(out)

    def ordered(self) -> QueryBuilder:
        """The query in its order, else in that of the primary key."""
        key = self._key()
        if not self.order and key and not (self.aggregates or self.groups_by or self.distinct_fields is not None):
            self.order.append((key, False))
        return self

    def _first_rows(self, frame: DataFrame, resolve, order: list[tuple[str, bool]]) -> DataFrame:
        """The first row of each value of the distinct fields; pre-aggregated where the order has one direction."""
        keys = [resolve(n)[0] for n in self.distinct_fields]
        ways = {d for _, d in order}
        if order and len(ways) == 1:
            best = F.max_by if ways == {True} else F.min_by
            row = F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(frame.columns)))
            by = F.struct(*(resolve(n)[0].alias(f"k{i}") for i, (n, _) in enumerate(order)))
            found = frame.groupBy(*(k.alias(f"g{i}") for i, k in enumerate(keys))).agg(best(row, by).alias("r"))
            return found.select(*(F.col(f"r._{i}").alias(c) for i, c in enumerate(frame.columns)))
        by = [resolve(n)[0].desc() if d else resolve(n)[0].asc() for n, d in order] or [F.lit(1)]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

    def _limited(self, frame: DataFrame) -> DataFrame:
        if self.offset_rows:
            frame = frame.offset(self.offset_rows)
        return frame if self.limit_rows is None else frame.limit(self.limit_rows)

    # -- terminals --------------------------------------------------------------------------------------------

    def _cache_key(self) -> tuple:
        return (self.table, str(self.build()), str(self.items), str(self.groups_by), str(self.joins), str(self.order), self.limit_rows, self.offset_rows, str(self.distinct_fields), str(self.having_condition and self.having_condition.build()))

    def df(self) -> DataFrame:
        if self.cursor_token:
            return self._page_frame(self.limit_rows or DEFAULT_PAGE)[0]
        if self.cache_seconds is not None:
            return self.database.cache.get(self._cache_key(), [self.table, *(j.table for j in self.joins)], self._compiled, self.cache_seconds)
        return self._compiled()

    def _page_frame(self, n: int) -> tuple[DataFrame, list[tuple[str, bool]], bool, int]:
        """(frame of up to n rows from the cursor on with all columns, order, whether it goes backward, signature)."""
        frame, resolve = self._filtered()
        order = [(n_ if n_ in frame.columns else resolve(n_)[0]._jc.toString().strip("`"), d) for n_, d in self._full_order(frame, True)]
        sig = keyset.signature(self.table, self.build(), order)
        backward = False
        if self.cursor_token:
            values, backward = keyset.decode(self.cursor_token, self.table, sig)
            kinds = [frame.schema[c].dataType for c, _ in order]
            frame = frame.where(keyset.after(order, values, kinds, backward))
        elif self.offset_rows:
            return self._sorted(frame, order, resolve).offset(self.offset_rows).limit(n), order, backward, sig
        return self._sorted(frame, order, resolve, backward).limit(n), order, backward, sig

    def page(self) -> Page:
        """Up to ``limit`` rows (1000 by default) with cursors to the pages around them."""
        began = time.monotonic()
        n = DEFAULT_PAGE if self.limit_rows is None else self.limit_rows
        if self.aggregates or self.groups_by or self.distinct_fields is not None:
            rows = self.clone().limit(n).df().collect()
            return Page(rows, None, None, False, False, int(1000 * (time.monotonic() - began)), self)
        frame, order, backward, sig = self._page_frame(n + 1)
        keys = [F.col(f"`{c}`").alias(f"_key{i}") for i, (c, _) in enumerate(order)]
        resolve = self._resolver(frame)
        found = frame.select(*self._items(frame, resolve), *keys).collect()
        more = len(found) > n
        found = found[:n]
        if backward:
            found.reverse()

        def token(row: Row, back: bool) -> str:
            return keyset.encode(self.table, sig, [row[f"_key{i}"] for i in range(len(order))], back)

        has_more, has_prev = (True, more) if backward else (more, bool(self.cursor_token or self.offset_rows))
        width = len(found[0]) - len(order) if found else 0
        rows = [Row(*r.__fields__[:width])(*r[:width]) for r in found]
        return Page(rows, token(found[-1], False) if found and has_more else None, token(found[0], True) if found and has_prev else None, has_more and bool(found), has_prev and bool(found), int(1000 * (time.monotonic() - began)), self)

    def first(self) -> Row | None:
        rows = self.clone().limit(1).df().collect()
        return rows[0] if rows else None

    def count(self) -> int:
        if self.aggregates or self.groups_by or self.distinct_fields is not None or self.limit_rows is not None or self.offset_rows:
            return self.df().count()
        return self._filtered()[0].count()

    def exists(self) -> bool:
        return not self._filtered()[0].isEmpty()

    def _scalar(self, agg: Agg) -> Any:
        frame, resolve = self._filtered()
        return frame.agg(agg.column(resolve)).first()[0]

    def sum(self, name: str):
        return self._scalar(Agg.sum(name))

    def avg(self, name: str):
        return self._scalar(Agg.avg(name))

    def min(self, name: str):
        return self._scalar(Agg.min(name))

    def max(self, name: str):
        return self._scalar(Agg.max(name))

    def iter(self) -> Iterator[Row]:
        """Rows one by one; a partition at a time is on the driver."""
        return self.df().toLocalIterator(prefetchPartitions=True)

    def watch(self, **options):
        from quernel.streaming.watch import watch_query

        return watch_query(self, **options)


class StreamQueryBuilder(QueryBuilder):
    """A pull stream of rows: fields that do not exist are left out of the projection."""

    def select(self, items: list):
        known = self.source(self.table).columns
        return super().select([i for i in items if i in known])


def typed(value: Any, schema: Table, name: str) -> Column:
    return literal(value, schema.field(name).spark)
