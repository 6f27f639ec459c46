"""Expressions for updates and upserts, compiled to Catalyst columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Resolve = Callable[[str], tuple[Column, T.DataType]]


@dataclass(frozen=True)
class Expr:
    """A node: an operator and its operands. Arithmetic on Python numbers and expressions builds nodes.

    A field that is null or no number counts as 0; dividing by zero, or taking the remainder, gives 0; remainders are
    not negative; rounding is half away from zero.
    """

    op: str
    args: tuple = ()

    @staticmethod
    def of(x: Any) -> Expr:
        return x if isinstance(x, Expr) else Expr("const", (x,))

    def __add__(self, o):
        return Expr("+", (self, Expr.of(o)))

    def __radd__(self, o):
        return Expr("+", (Expr.of(o), self))

    def __sub__(self, o):
        return Expr("-", (self, Expr.of(o)))

    def __rsub__(self, o):
        return Expr("-", (Expr.of(o), self))

    def __mul__(self, o):
        return Expr("*", (self, Expr.of(o)))

    def __rmul__(self, o):
        return Expr("*", (Expr.of(o), self))

    def __truediv__(self, o):
        return Expr("/", (self, Expr.of(o)))

    def __rtruediv__(self, o):
        return Expr("/", (Expr.of(o), self))

    def __mod__(self, o):
        return Expr("%", (self, Expr.of(o)))

    def __neg__(self):
        return Expr("neg", (self,))

    def __abs__(self):
        return Expr("abs", (self,))


def field(name: str) -> Expr:
    return Expr("field", (name,))


def least(a, b) -> Expr:
    return Expr("least", (Expr.of(a), Expr.of(b)))


def greatest(a, b) -> Expr:
    return Expr("greatest", (Expr.of(a), Expr.of(b)))


def rounded(a) -> Expr:
    return Expr("round", (Expr.of(a),))


def floor(a) -> Expr:
    return Expr("floor", (Expr.of(a),))


def ceil(a) -> Expr:
    return Expr("ceil", (Expr.of(a),))


def now() -> Expr:
    return Expr("now")


def if_else(test, a, b) -> Expr:
    """``a`` if the test is not null, 0, empty or false."""
    return Expr("if", (Expr.of(test), Expr.of(a), Expr.of(b)))


def when(test, a, otherwise=None) -> Expr:
    return Expr("if", (Expr.of(test), Expr.of(a), Expr.of(otherwise)))


def is_update() -> Expr:
    return Expr("is_update")


def is_insert() -> Expr:
    return Expr("is_insert")


def compile_expr(e: Expr, resolve: Resolve, updating: Column | bool = True, at: Column | None = None) -> Column:
    """The column of an expression. ``updating`` says which branch of an upsert a row takes; new rows have no fields, so they count as 0."""
    update = F.lit(updating) if isinstance(updating, bool) else updating

    def raw(name: str) -> Column:
        return resolve(name)[0]

    def number(x: Expr) -> Column:
        if x.op == "field":
            col, kind = resolve(x.args[0])
            if isinstance(kind, T.IntegralType):
                n = F.coalesce(col.cast("long"), F.lit(0).cast("long"))
            elif isinstance(kind, T.NumericType):
                n = F.coalesce(col.cast("double"), F.lit(0.0))
            elif isinstance(kind, T.StringType):
                n = F.coalesce(F.trim(col).try_cast("double"), F.lit(0.0))
            else:
                n = F.lit(0)
            return n if updating is True else F.when(update, n).otherwise(F.lit(0))
        return walk(x)

    def truth(x: Expr) -> Column:
        if x.op in ("is_update", "is_insert"):
            return walk(x)
        if x.op == "field":
            col, kind = resolve(x.args[0])
            yes = col if isinstance(kind, T.BooleanType) else col != "" if isinstance(kind, T.StringType) else col != 0 if isinstance(kind, T.NumericType) else col.isNotNull()
            return update & F.coalesce(yes, F.lit(False))
        if x.op == "const":
            return F.lit(bool(x.args[0]))
        return F.coalesce(walk(x) != 0, F.lit(False))

    def walk(x: Expr) -> Column:
        op, a = x.op, x.args
        if op == "const":
            return F.lit(a[0])
        if op == "field":
            return number(x)
        if op == "now":
            return at if at is not None else F.current_timestamp().cast("timestamp_ntz")
        if op == "is_update":
            return update
        if op == "is_insert":
            return ~update
        if op == "if":
            value = [raw(y.args[0]) if y.op == "field" and updating is True else walk(y) for y in a[1:]]
            return F.when(truth(a[0]), value[0]).otherwise(value[1])
        n = [number(y) for y in a]
        if op in ("+", "-", "*"):
            return {"+": lambda: n[0] + n[1], "-": lambda: n[0] - n[1], "*": lambda: n[0] * n[1]}[op]()
        if op == "/":
            return F.when(n[1] == 0, F.lit(0.0)).otherwise(n[0].cast("double") / F.nullif(n[1], F.lit(0)))
        if op == "%":
            return F.when(n[1] == 0, F.lit(0)).otherwise(F.pmod(n[0], F.abs(F.nullif(n[1], F.lit(0)))))
        if op in ("least", "greatest"):
            return getattr(F, op)(*n)
        if op == "round":
            return F.round(n[0]).cast("long")
        if op in ("floor", "ceil"):
            return getattr(F, op)(n[0]).cast("long")
        return {"neg": lambda: -n[0], "abs": lambda: F.abs(n[0])}[op]()

    return walk(e)
