"""Predicates: a chain of tests joined by AND and OR, compiled to a Catalyst column or matched against a dict."""

from __future__ import annotations

import copy
import functools
import operator
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.values import convert_literal, literal

#: The operators of the query language.
COMPARISONS = ("=", "!=", "<>", ">", ">=", "<", "<=")
OPERATORS = (*COMPARISONS, "IN", "NOT IN", "BETWEEN", "LIKE", "NOT LIKE", "IS", "IS NOT")

Resolve = Callable[[str], tuple[Column, T.DataType]]


def _like_pattern(p: str) -> str:
    """Backslashes stand for themselves."""
    return p.replace("\\", "\\\\")


def _wild(value: str) -> bool:
    return "%" in value or "_" in value


class Condition:
    """``where`` and its relatives add a test with AND; after ``or_()``, or with an ``or_`` form, with OR. AND binds tighter.

    A null in the data makes every test false but ``!=``, ``NOT IN``, ``IS`` null and emptiness. Literals are converted
    to the type of their field. LIKE knows % and _, each matching line breaks too, and no escapes.
    """

    def __init__(self) -> None:
        self.groups: list[list[Any]] = [[]]
        self._next_or = False

    # -- building ---------------------------------------------------------------------------------------------

    def _add(self, node: Any, with_or: bool = False):
        if (with_or or self._next_or) and self.groups[-1]:
            self.groups.append([])
        self._next_or = False
        self.groups[-1].append(node)
        return self

    def _test(self, name: str, op: str, value: Any, with_or: bool = False):
        name = getattr(name, "name", name)
        op = " ".join(op.upper().split())
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        if op in ("IS", "IS NOT"):
            if value is not None:
                raise ValueError(f"{op} is for null only")
        elif value is None:
            raise ValueError(f"{name} {op} null: use IS or IS NOT")
        if op in ("IN", "NOT IN"):
            value = list(value)
        if op == "BETWEEN":
            value = list(value)
            if len(value) != 2:
                raise ValueError("BETWEEN takes two bounds")
        return self._add(("test", name, "!=" if op == "<>" else op, value), with_or)

    def where(self, name, op: str, value: Any = None):
        return self._test(name, op, value)

    def or_where(self, name, op: str, value: Any = None):
        return self._test(name, op, value, True)

    def or_(self):
        self._next_or = True
        return self

    def condition(self, other: Condition):
        """AND a whole condition, in parentheses."""
        return self._add(copy.deepcopy(other)) if not other.is_empty else self

    def or_condition(self, other: Condition):
        return self._add(copy.deepcopy(other), True) if not other.is_empty else self

    def where_equal(self, name, value):
        return self.where(name, "=", value)

    def where_not_equal(self, name, value):
        return self.where(name, "!=", value)

    def where_greater_than(self, name, value):
        return self.where(name, ">", value)

    def where_greater_than_or_equal_to(self, name, value):
        return self.where(name, ">=", value)

    def where_less_than(self, name, value):
        return self.where(name, "<", value)

    def where_less_than_or_equal_to(self, name, value):
        return self.where(name, "<=", value)

    def where_in(self, name, values):
        return self.where(name, "IN", values)

    def where_not_in(self, name, values):
        return self.where(name, "NOT IN", values)

    def where_between(self, name, low, high):
        return self.where(name, "BETWEEN", [low, high])

    def where_like(self, name, pattern: str):
        return self.where(name, "LIKE", pattern)

    def where_not_like(self, name, pattern: str):
        return self.where(name, "NOT LIKE", pattern)

    def where_null(self, name):
        return self.where(name, "IS", None)

    def where_not_null(self, name):
        return self.where(name, "IS NOT", None)

    def where_contains(self, name, value: str):
        """Wildcards inside ``value`` stay active."""
        return self.where(name, "LIKE", f"%{value}%")

    def where_not_contains(self, name, value: str):
        return self.where(name, "NOT LIKE", f"%{value}%")

    def where_starts_with(self, name, value: str):
        return self.where(name, "LIKE", f"{value}%")

    def where_ends_with(self, name, value: str):
        return self.where(name, "LIKE", f"%{value}")

    @staticmethod
    def _any_of(name, values) -> Condition:
        c = Condition()
        for v in values:
            c.or_where(name, "LIKE", f"%{v}%")
        return c

    def where_contains_any(self, name, values):
        """True if any value is contained; false for no values."""
        return self._add(("never",)) if not list(values) else self.condition(self._any_of(name, values))

    def or_contains_any(self, name, values):
        return self if not list(values) else self.or_condition(self._any_of(name, values))

    def where_empty(self, name):
        return self.condition(Condition().where_null(name).or_where(name, "=", ""))

    def where_not_empty(self, name):
        return self.condition(Condition().where_not_null(name).where(name, "!=", ""))

    def where_true(self, name):
        return self.where(name, "=", True)

    def where_false(self, name):
        return self.where(name, "=", False)

    @classmethod
    def from_map(cls, tree: dict) -> Condition:
        """From ``{"AND": [...]}``, ``{"OR": [...]}`` and ``{field: {operator: value}}``; several entries are joined by AND."""
        out = cls()
        for k, v in tree.items():
            if k.upper() in ("AND", "OR") and isinstance(v, list):
                part = cls()
                for x in v:
                    (part.condition if k.upper() == "AND" else part.or_condition)(cls.from_map(x))
                out.condition(part)
            elif isinstance(v, dict):
                for op, value in v.items():
                    out.where(k, op, value)
            else:
                out.where(k, "=", v)
        return out

    def build(self) -> dict:
        """The map form."""

        def node(n) -> dict:
            return n.build() if isinstance(n, Condition) else {n[1]: {n[2]: n[3]}} if n[0] == "test" else {"OR": []}

        parts = [{"AND": [node(n) for n in g]} if len(g) > 1 else node(g[0]) for g in self.groups if g]
        return {} if not parts else parts[0] if len(parts) == 1 else {"OR": parts}

    # -- reading ----------------------------------------------------------------------------------------------

    @property
    def is_empty(self) -> bool:
        return not any(self.groups)

    def fields(self) -> set[str]:
        return {x for g in self.groups for n in g for x in (n.fields() if isinstance(n, Condition) else {n[1]} if n[0] == "test" else ())}

    def to_column(self, resolve: Resolve) -> Column:
        """The predicate; its nulls are false. ``resolve`` gives a field's column and type."""
        if self.is_empty:
            return F.lit(True)

        def node(n) -> Column:
            return n.to_column(resolve) if isinstance(n, Condition) else test_column(resolve, *n[1:]) if n[0] == "test" else F.lit(False)

        return functools.reduce(operator.or_, (functools.reduce(operator.and_, map(node, g)) for g in self.groups if g))

    def matches(self, record: dict, types: dict[str, T.DataType] | None = None) -> bool:
        """The same test on one record in Python."""
        if self.is_empty:
            return True

        def node(n) -> bool:
            return n.matches(record, types) if isinstance(n, Condition) else test_value(record.get(n[1]), (types or {}).get(n[1]), *n[2:]) if n[0] == "test" else False

        return any(all(map(node, g)) for g in self.groups if g)


def test_column(resolve: Resolve, name: str, op: str, value: Any) -> Column:
    col, kind = resolve(name)
    if op == "IS":
        return col.isNull()
    if op == "IS NOT":
        return col.isNotNull()
    if op in ("LIKE", "NOT LIKE"):
        return _like(col if isinstance(kind, T.StringType) else col.cast("string"), str(value), op == "NOT LIKE")
    if op in ("IN", "NOT IN"):
        values = [literal(v, kind) for v in value if convert_literal(v, kind) is not None]
        found = col.isin(*values) if values else F.lit(False)
        return found if op == "IN" else col.isNull() | ~found
    if op == "BETWEEN":
        return col.between(literal(value[0], kind), literal(value[1], kind))
    v = literal(value, kind)
    if op == "!=":
        return ~col.eqNullSafe(v)
    return {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}[op](col, v)


def _like(col: Column, p: str, negate: bool) -> Column:
    """Prefix, suffix and substring tests where the pattern is one, since those are pushed down; LIKE otherwise."""
    inner = p.strip("%")
    if inner and not _wild(inner) and p in (f"{inner}%", f"%{inner}", f"%{inner}%"):
        found = col.contains(inner) if p == f"%{inner}%" else col.startswith(inner) if p == f"{inner}%" else col.endswith(inner)
    else:
        found = col.like(_like_pattern(p))
    return ~found if negate else found


@functools.lru_cache(1024)
def _like_regex(p: str) -> re.Pattern:
    return re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p), re.DOTALL)


def test_value(x: Any, kind: T.DataType | None, op: str, value: Any) -> bool:
    """The Python twin of ``test_column``."""
    if op in ("IS", "IS NOT"):
        return (x is None) == (op == "IS")
    if x is None:
        return op in ("!=", "NOT IN")
    if op in ("LIKE", "NOT LIKE"):
        return bool(_like_regex(str(value)).fullmatch(str(x))) == (op == "LIKE")

    def lit(v: Any) -> Any:
        return convert_literal(v, kind) if kind else v

    if op in ("IN", "NOT IN"):
        return (x in [w for v in value for w in [lit(v)] if w is not None]) == (op == "IN")
    if op == "BETWEEN":
        low, high = map(lit, value)
        return low is not None and high is not None and low <= x <= high
    v = lit(value)
    if v is None:
        return op == "!="
    return {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}[op](x, v)
