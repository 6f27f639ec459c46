"""Key-value pairs of a space, or of all spaces: JSON values with an optional expiry."""

from __future__ import annotations

import datetime as dt
import json
import queue
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.engine import KV, Database, Result, table_of
from quernel.operators import lifetime
from quernel.operators.write import Status
from quernel.schema import FieldType, PrimaryKey


class KeyValues:
    """Point access to small values; ``now`` can be given for repeatable results. Expired entries are hidden, but ``count`` counts them."""

    def __init__(self, db: Database, now: dt.datetime | None = None):
        self.db, self.now = db, now

    def _name(self, is_global: bool) -> str:
        name = f"{KV}global" if is_global else KV
        if not self.db.table_exists(name):
            s = table_of(name, "key", {"value": "json", "updated_at": "datetime", "expires_at": "datetime"}, is_global=is_global)
            self.db.create_table(s.with_(key=PrimaryKey("key", "none", type=FieldType.text)))
        return name

    def frame(self, is_global: bool = False) -> DataFrame:
        return self.db.frame(self._name(is_global))

    def _now(self) -> dt.datetime:
        return self.now or dt.datetime.now(dt.UTC).replace(tzinfo=None)

    def _put(self, frame: DataFrame, is_global: bool, keys: list[str]) -> Result:
        self.db._set({self._name(is_global): frame}, {"op": "kv", "table": self._name(is_global), "keys": keys})
        return Result(Status.success)

    def set(self, key: str, value: Any, ttl: dt.timedelta | None = None, expires_at: dt.datetime | None = None, is_global: bool = False) -> Result:
        return self.set_many({key: value}, ttl, expires_at, is_global)

    def set_many(self, items: dict[str, Any], ttl: dt.timedelta | None = None, expires_at: dt.datetime | None = None, is_global: bool = False) -> Result:
        if ttl is not None and expires_at is not None:
            return Result(Status.validationFailed, "ttl and expires_at exclude each other")
        now = self._now()
        until = now + ttl if ttl is not None else expires_at
        kv = self.frame(is_global)
        rows = self.db.spark.createDataFrame([(k, json.dumps(v), now, until) for k, v in items.items()], lifetime.KV_SCHEMA)
        return self._put(lifetime.put_pairs(kv, rows.select(*kv.columns)), is_global, list(items))

    def get_many(self, keys: Iterable[str], is_global: bool = False) -> dict[str, Any]:
        rows = lifetime.live_pairs(self.frame(is_global), self._now()).where(F.col("key").isin(*keys)).collect()
        return {r.key: json.loads(r.value) for r in rows}

    def get(self, key: str, is_global: bool = False) -> Any:
        return self.get_many([key], is_global).get(key)

    def get_string(self, key: str, is_global: bool = False) -> str | None:
        v = self.get(key, is_global)
        return None if v is None else v if isinstance(v, str) else json.dumps(v)

    def get_int(self, key: str, is_global: bool = False) -> int | None:
        v = self.get(key, is_global)
        try:
            return None if v is None else int(float(v))
        except (TypeError, ValueError):
            return None

    def get_bool(self, key: str, is_global: bool = False) -> bool | None:
        v = self.get(key, is_global)
        return None if v is None else v.strip().lower() in ("true", "1", "yes") if isinstance(v, str) else bool(v)

    def get_map(self, key: str, is_global: bool = False) -> dict | None:
        v = self.get(key, is_global)
        return v if isinstance(v, dict) else None

    def get_list(self, key: str, is_global: bool = False) -> list | None:
        v = self.get(key, is_global)
        return v if isinstance(v, list) else None

    def get_keys(self, prefix: str | None = None, is_global: bool = False) -> list[str]:
        return [r.key for r in lifetime.keys_with_prefix(self.frame(is_global), prefix, self._now()).orderBy("key").toLocalIterator()]

    def exists(self, key: str, is_global: bool = False) -> bool:
        return not lifetime.live_pairs(self.frame(is_global), self._now()).where(F.col("key") == key).isEmpty()

    def remove(self, key: str, is_global: bool = False) -> Result:
        return self.remove_keys([key], is_global)

    def remove_keys(self, keys: Iterable[str], is_global: bool = False) -> Result:
        keys = list(keys)
        return self._put(self.frame(is_global).where(~F.col("key").isin(*keys)), is_global, keys)

    def get_ttl(self, key: str, is_global: bool = False) -> dt.timedelta | None:
        row = lifetime.live_pairs(self.frame(is_global), self._now()).where(F.col("key") == key).first()
        return row.expires_at - self._now() if row and row.expires_at else None

    def set_ttl(self, key: str, ttl: dt.timedelta | None, expires_at: dt.datetime | None = None, is_global: bool = False) -> Result:
        if not self.exists(key, is_global):
            return Result(Status.notFound, key)
        until = self._now() + ttl if ttl is not None else expires_at
        value = F.lit(until.isoformat() if until else None).cast("timestamp_ntz")
        kv = self.frame(is_global)
        return self._put(kv.withColumn("expires_at", F.when(F.col("key") == key, value).otherwise(F.col("expires_at"))), is_global, [key])

    def set_increment(self, key: str, amount: int = 1, is_global: bool = False) -> Result:
        kv = self.frame(is_global)
        one = self.db.spark.createDataFrame([(key, amount)], "key string, amount long")
        return self._put(lifetime.incremented(kv, one, self._now()).select(*kv.columns), is_global, [key])

    def clear(self, is_global: bool = False) -> Result:
        return self._put(self.frame(is_global).limit(0), is_global, [])

    def count(self, is_global: bool = False) -> int:
        return self.frame(is_global).count()

    def watch_values(self, keys: Iterable[str], is_global: bool = False, distinct: bool = True, timeout: float | None = None) -> Iterator[dict[str, Any]]:
        """The keys' values now, after each change of one of them, and when one expires; ``timeout`` ends the wait for that, in seconds."""
        keys, name, changes = list(keys), self._name(is_global), queue.SimpleQueue()

        def listen(event: dict) -> None:
            if event["table"] == name and (not event.get("keys") or set(event["keys"]) & set(keys)):
                changes.put(event)

        self.db.listeners.append(listen)
        try:
            last = None
            while True:
                found = self.get_many(keys, is_global)
                values = {k: found.get(k) for k in keys}
                if not distinct or values != last:
                    yield values
                last = values
                left = self._until_expiry(keys, is_global)
                try:
                    changes.get(timeout=min((x for x in (timeout, left) if x is not None), default=None))
                except queue.Empty:
                    if left is None or timeout is not None and timeout < left:
                        return
        finally:
            self.db.listeners.remove(listen)

    def _until_expiry(self, keys: list[str], is_global: bool) -> float | None:
        """Seconds until the first of the keys' live entries expires."""
        now = self._now()
        first = lifetime.live_pairs(self.frame(is_global), now).where(F.col("key").isin(*keys)).agg(F.min("expires_at")).first()[0]
        return None if first is None else max((first - now).total_seconds(), 0) + 0.01

    def watch(self, key: str, default: Any = None, **options) -> Iterator[Any]:
        for values in self.watch_values([key], **options):
            yield default if values[key] is None else values[key]
