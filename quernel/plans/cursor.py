"""Keyset cursors: opaque tokens that hold the sort key of a row and are bound to their query."""

from __future__ import annotations

import base64
import datetime as dt
import functools
import json
import operator
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Order = tuple[str, bool]  # column, descending


class CursorError(ValueError):
    """A token that is broken or belongs to another query."""


def fnv1a(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def signature(table: str, where: dict, order: list[Order]) -> int:
    return fnv1a(json.dumps([table, where, order], sort_keys=True, default=str))


def _pack(v: Any) -> Any:
    if isinstance(v, (dt.datetime, dt.date)):
        return {"t": v.isoformat()}
    if isinstance(v, Decimal):
        return {"d": str(v)}
    return {"b": base64.b64encode(v).decode()} if isinstance(v, (bytes, bytearray)) else v


def _unpack(v: Any) -> Any:
    if not isinstance(v, dict):
        return v
    ((k, x),) = v.items()
    return dt.datetime.fromisoformat(x) if k == "t" else Decimal(x) if k == "d" else base64.b64decode(x)


def encode(table: str, sig: int, values: list[Any], backward: bool) -> str:
    raw = json.dumps({"n": table, "s": sig, "v": [_pack(v) for v in values], "b": backward}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode()


def decode(token: str, table: str, sig: int) -> tuple[list[Any], bool]:
    try:
        d = json.loads(base64.urlsafe_b64decode(token.encode()))
        values, backward = [_unpack(v) for v in d["v"]], bool(d["b"])
        bound = (d["n"], d["s"])
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("not a cursor") from e
    if bound != (table, sig):
        raise CursorError("the cursor belongs to another query")
    return values, backward


def after(order: list[Order], values: list[Any], kinds: list[T.DataType], backward: bool = False) -> Column:
    """Rows strictly behind ``values`` in ``order`` (before them if ``backward``); nulls are the smallest."""

    def lit(v: Any, kind: T.DataType) -> Column:
        return F.lit(v.isoformat()).cast(kind) if isinstance(v, (dt.datetime, dt.date)) else F.lit(v).cast(kind)

    def past(col: Column, v: Any, kind: T.DataType, up: bool) -> Column:
        if v is None:
            return col.isNotNull() if up else F.lit(False)
        return col > lit(v, kind) if up else col.isNull() | (col < lit(v, kind))

    clauses, same = [], []
    for (name, desc), v, kind in zip(order, values, kinds, strict=True):
        col = F.col(f"`{name}`")
        clauses.append(functools.reduce(operator.and_, [*same, past(col, v, kind, desc == backward)]))
        same.append(col.isNull() if v is None else col == lit(v, kind))
    return functools.reduce(operator.or_, clauses)
