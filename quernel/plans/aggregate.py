"""The five aggregates of the query language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Agg:
    """``count`` counts rows whatever the field holds. The others take numbers only: over other types they are null,
    but ``native`` min and max order any type (an extension)."""

    kind: str
    field: str = "*"
    alias: str | None = None
    native: bool = False

    @classmethod
    def count(cls, field: str = "*", alias: str | None = None) -> Agg:
        return cls("count", field, alias)

    @classmethod
    def count_non_null(cls, field: str, alias: str | None = None) -> Agg:
        """An extension: counts values."""
        return cls("count_non_null", field, alias)

    @classmethod
    def sum(cls, field: str, alias: str | None = None) -> Agg:
        return cls("sum", field, alias)

    @classmethod
    def avg(cls, field: str, alias: str | None = None) -> Agg:
        return cls("avg", field, alias)

    @classmethod
    def min(cls, field: str, alias: str | None = None, native: bool = False) -> Agg:
        return cls("min", field, alias, native)

    @classmethod
    def max(cls, field: str, alias: str | None = None, native: bool = False) -> Agg:
        return cls("max", field, alias, native)

    @property
    def name(self) -> str:
        """Output column: the alias, or ``kind(field)``."""
        return self.alias or f"{self.kind}({self.field})"

    def column(self, resolve: Callable[[str], tuple[Column, T.DataType]]) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)).alias(self.name)
        col, kind = resolve(self.field)
        if self.kind == "count_non_null":
            return F.count(col).alias(self.name)
        if not isinstance(kind, T.NumericType) and not self.native:
            # a path into JSON text may hold numbers; other text, dates and the like are no numbers
            col = col.try_cast("double") if "." in self.field and isinstance(kind, T.StringType) else F.lit(None).cast("double")
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.kind](col).alias(self.name)
