"""Conversion of values to field types: as columns for stored data, in Python for literals."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.schema import Field, FieldType, Table

#: What counts as true in text.
TRUE_WORDS = ("true", "1", "yes")


def half_away(x: float) -> int:
    """Rounds half away from zero."""
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def convert_literal(value: Any, kind: T.DataType) -> Any:
    """``value`` as ``kind`` would store it; None if it cannot be converted."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.BooleanType):
            return value.strip().lower() in TRUE_WORDS if isinstance(value, str) else bool(value)
        if isinstance(kind, T.IntegralType):
            if isinstance(value, dt.datetime):
                return int(value.replace(tzinfo=value.tzinfo or dt.UTC).timestamp() * 1000)
            if isinstance(value, str):
                value = value.strip()
                return int(value) if value.lstrip("+-").isdigit() else half_away(float(value))
            return half_away(value) if isinstance(value, (float, Decimal)) else int(value)
        if isinstance(kind, T.DecimalType):
            return Decimal(str(value).strip())
        if isinstance(kind, T.FractionalType):
            return float(value)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
            if isinstance(value, dt.datetime):
                return value.replace(tzinfo=None)
            if isinstance(value, dt.date):
                return dt.datetime.combine(value, dt.time())
            return dt.datetime.fromisoformat(value.strip().replace("Z", "")).replace(tzinfo=None)
        if isinstance(kind, T.StringType):
            if isinstance(value, bool):
                return "true" if value else "false"
            return json.dumps(value) if isinstance(value, (dict, list)) else str(value).strip()
        if isinstance(kind, T.BinaryType):
            return value.encode() if isinstance(value, str) else bytes(value)
    except (ValueError, TypeError, OverflowError, InvalidOperation):
        return None
    return value


def literal(value: Any, kind: T.DataType) -> Column:
    """A typed literal. Integers that a narrow column cannot hold stay long, so that comparing them is still right."""
    v = convert_literal(value, kind)
    if isinstance(kind, T.IntegralType) and v is not None:
        return F.lit(v).cast("long") if -(2**63) <= v < 2**63 else F.lit(Decimal(v))
    if v is not None and isinstance(kind, T.TimestampNTZType):
        return F.lit(v.isoformat()).cast(kind)
    return F.lit(v) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.lit(v).cast(kind)


def convert_column(col: Column, source: T.DataType, field: Field) -> Column:
    """``col`` of type ``source`` as ``field`` stores it; what cannot be converted becomes null."""
    kind = FieldType(field.type)
    text = isinstance(source, T.StringType)
    if kind == FieldType.integer:
        if isinstance(source, (T.TimestampNTZType, T.TimestampType)):
            return F.unix_millis(col.cast("timestamp"))
        if isinstance(source, T.FractionalType) or text:
            rounded = F.round(F.trim(col).try_cast("double") if text else col).try_cast("long")
            return F.coalesce(F.trim(col).try_cast("long"), rounded) if text else rounded
        return col.cast("long")
    if kind in (FieldType.bigInt, FieldType.double):
        return (F.trim(col) if text else col).try_cast(field.spark)
    if kind == FieldType.text:
        return F.trim(F.to_json(col) if isinstance(source, (T.StructType, T.MapType, T.ArrayType)) else col.cast("string"))
    if kind == FieldType.boolean:
        return F.lower(F.trim(col)).isin(*TRUE_WORDS) if text else col.cast("boolean")
    if kind == FieldType.datetime:
        if isinstance(source, T.IntegralType):
            return F.timestamp_millis(col).cast("timestamp_ntz")
        return (F.trim(col) if text else col).try_cast("timestamp_ntz")
    if kind == FieldType.blob:
        return col.cast("binary")
    if kind in (FieldType.array, FieldType.vector) and text:
        return F.from_json(col, field.spark)
    if kind == FieldType.json:
        return col if text else F.to_json(col)
    return col.cast(field.spark)


def key_order(col: str, table: Table | None = None) -> list[Column]:
    """Sort columns of a primary key: text keys of generated kinds sort by length first, so that 2 comes before 10."""
    if table and table.key.type == FieldType.text:
        return [F.char_length(col), F.col(col)]
    return [F.col(col)]


def encode_bytes(value: bytes) -> str:
    return base64.b64encode(value).decode()
