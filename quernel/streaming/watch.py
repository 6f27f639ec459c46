"""Live queries: a query is run again when a change may concern it; over a growing folder, by Structured Streaming."""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def concerns(query, event: dict) -> bool:
    """Whether a change can have an effect on a query: a changed row, as it was or as it is now, meets the query's predicate.

    Queries with joins, and changes that do not tell their rows, are not looked into.
    """
    if query.joins or "report" not in event or event["table"] != query.table or "before" not in event or query.is_empty:
        return True
    db = query.database
    key = db.schema(query.table).key.name
    changed = event["report"].where("error is null").select(F.col("key").alias("_changed"))
    if event["op"] in ("insert", "upsert") and not changed.where("_changed is null").isEmpty():
        return True  # the key was made by the write
    for frame in (event["before"], db.frame(query.table)):
        if key in frame.columns:
            rows = frame.join(changed, F.col(key).cast("string") == F.col("_changed").cast("string"), "left_semi")
            if not rows.where(query.to_column(lambda n, f=frame: (F.col(f"`{n}`"), f.schema[n].dataType))).isEmpty():
                return True
    return False


def watch_query(query, timeout: float | None = None, distinct: bool = True) -> Iterator[list[Row]]:
    """The query's page now, and again after each commit that ``concerns`` it; bursts of commits give one result.

    ``timeout`` ends the wait for a change, in seconds. With ``distinct`` a result equal to the last is left out.
    """
    db, changes = query.database, queue.SimpleQueue()
    tables = {query.table, *(j.table for j in query.joins)}

    def listen(event: dict) -> None:
        if tables & {event["table"], *event.get("tables", ())}:
            changes.put(event)

    db.listeners.append(listen)
    try:
        last = None
        while True:
            rows = query.clone().page().rows
            if not distinct or rows != last:
                yield rows
            last = rows
            stirred = False
            while not stirred:
                try:
                    burst = [changes.get(timeout=timeout)]
                except queue.Empty:
                    return
                while not changes.empty():  # a burst is one change
                    burst.append(changes.get())
                stirred = any(concerns(query, e) for e in burst)
    finally:
        db.listeners.remove(listen)


def watch_folder(spark: SparkSession, path: str, schema, evaluate: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Runs ``evaluate`` over all Parquet rows of ``path`` each time new files arrive, and hands the result to ``each``.

    The stream is the change signal; the snapshot query runs over the folder, so any query can be watched.
    """
    stream = spark.readStream.schema(schema).parquet(path)

    def on_batch(batch: DataFrame, epoch: int) -> None:
        each(evaluate(batch.sparkSession.read.schema(schema).parquet(path)), epoch)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
