"""Row lifetime and the key-value tables, with the time given explicitly."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KV_SCHEMA = "key string, value string, updated_at timestamp_ntz, expires_at timestamp_ntz"


def moment(now: dt.datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return now if isinstance(now, Column) else F.lit(now.isoformat()).cast("timestamp_ntz")


def expired(source: str, ms: int, now: dt.datetime | Column | None = None) -> Column:
    """A row is over when its time is at or before now less its lifetime; a null time never is."""
    return F.coalesce(F.col(source) <= moment(now) - F.make_dt_interval(secs=F.lit(ms / 1000)), F.lit(False))


def alive_rows(frame: DataFrame, source: str, ms: int, now=None) -> DataFrame:
    return frame.where(~expired(source, ms, now))


def expired_rows(frame: DataFrame, source: str, ms: int, now=None) -> DataFrame:
    return frame.where(expired(source, ms, now))


def live_pairs(kv: DataFrame, now=None) -> DataFrame:
    """Entries that are not over; one without an expiry never is."""
    return kv.where(F.col("expires_at").isNull() | (F.col("expires_at") > moment(now)))


def keys_with_prefix(kv: DataFrame, prefix: str | None = None, now=None) -> DataFrame:
    live = live_pairs(kv, now)
    return (live.where(F.col("key").startswith(prefix)) if prefix else live).select("key")


def put_pairs(kv: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries of ``pairs`` (same columns) replace those of equal key."""
    return kv.join(pairs.select("key"), "key", "left_anti").unionByName(pairs)


def incremented(kv: DataFrame, amounts: DataFrame, now=None) -> DataFrame:
    """Adds ``amounts`` (key, amount) to numeric values; what is absent, over or no number counts as 0."""
    at = moment(now)
    added = amounts.groupBy("key").agg(F.sum("amount").alias("amount"))
    old = live_pairs(kv, now).select(F.col("key").alias("_k"), F.col("value").alias("_v"), F.col("expires_at").alias("_e"))
    new = added.join(old, F.col("key") == F.col("_k"), "left").select(
        "key", (F.coalesce(F.trim(F.col("_v"), F.lit('"')).try_cast("double").cast("long"), F.lit(0)) + F.col("amount")).cast("long").cast("string").alias("value"), at.alias("updated_at"), F.col("_e").alias("expires_at")
    )
    return put_pairs(kv, new)
