"""Primary-key generators as column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of base 62, and the room for a sequence number behind a time.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SEQUENCE = 10**5


def base62(n: Column, length: int = 0) -> Column:
    """Base-62 text of a non-negative long, zero-padded to ``length``; null for negative numbers."""
    text = F.aggregate(
        F.sequence(F.lit(1), F.lit(11)),  # eleven digits hold any long
        F.struct(n.cast("long").alias("n"), F.lit("").alias("s")),
        lambda a, _: F.struct(
            F.call_function("div", a["n"], F.lit(62).cast("long")).alias("n"),
            F.when((a["n"] == 0) & (a["s"] != ""), a["s"]).otherwise(F.concat(F.substring(F.lit(BASE62), (F.pmod(a["n"], F.lit(62)) + 1).cast("int"), F.lit(1)), a["s"])).alias("s"),
        ),
    )["s"]
    text = F.lpad(text, length, "0") if length > 1 else text
    return F.when(n >= 0, text)


def from_base62(text: Column) -> Column:
    """The long that base-62 text stands for."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 62 + F.instr(F.lit(BASE62), c).cast("long") - 1))


def timestamp_key(ms: Column, sequence: Column, node: int | None = None, node_digits: int = 4) -> Column:
    """Milliseconds, then the node if there are several, then the sequence number; 38 digits hold any of them."""
    t = ms.cast("decimal(20,0)")
    if node is None:
        return (t * F.lit(SEQUENCE) + sequence).cast("decimal(38,0)")
    return (t * F.lit(10**node_digits).cast("decimal(12,0)") * F.lit(SEQUENCE) + F.lit(node * SEQUENCE).cast("decimal(20,0)") + sequence).cast("decimal(38,0)")


def date_key(ts: Column, sequence: Column, node: int | None = None, node_digits: int = 4) -> Column:
    """``yyyyMMddHHmmss`` in place of the milliseconds."""
    return timestamp_key(F.date_format(ts, "yyyyMMddHHmmss").cast("decimal(20,0)"), sequence, node, node_digits)


def sequential(frame: DataFrame, order: list[str], name: str = "id", start: int = 1, step: int = 1, parts: int | None = None, persist=None) -> DataFrame:
    """``frame`` with gapless keys ``start``, ``start + step``, ... in the order of unique columns ``order``.

    No single task numbers all rows: they are dealt in ranges of all order columns, so that a hot first one is split by the next, and
    sorted within them; ranges are counted, and a row's key is its place in its range plus the rows before. ``persist`` writes the
    sorted rows down, so that both passes see the same ranges (a checkpoint by default).
    """
    parts = parts or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in order]
    if persist is None:
        from quernel.engine import _checkpoint as persist
    # the id of a row holds its partition and its place in that
    dealt = persist(frame.repartitionByRange(parts, *by).sortWithinPartitions(*by)).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in dealt.groupBy(part.alias("p")).count().collect()}  # a row a range
    ahead = list(itertools.accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=0))
    number = place + F.get(F.array(*(F.lit(n).cast("long") for n in ahead)), part.cast("int"))
    return dealt.withColumn(name, (number * step + start).cast("long")).drop("_at")
