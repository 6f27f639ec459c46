"""Exact nearest neighbours of a query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import vectors as V


def search(frame: DataFrame, field: str, query: list[float], k: int = 10, metric: str = "cosine", key: str = "id", threshold: float | None = None) -> DataFrame:
    """(key, distance, score) of the ``k`` nearest rows, ties by key: one projection and a bounded top-k in each task.

    Null vectors and those of another width are no neighbours. With ``threshold`` farther rows are left out. No index
    is needed: the result is that of a search over all rows.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    d = V.distance(metric, F.col(field), q)
    found = frame.where(F.size(field) == len(query)).select(F.col(key), d.alias("distance"))
    if threshold is not None:
        found = found.where(F.col("distance") <= F.lit(float(threshold)))
    return found.orderBy("distance", key).limit(k).select(key, "distance", V.score(metric, F.col("distance")).alias("score"))
