"""Sharding by minimax contiguous partition: the smallest shard capacity that a greedy pass over ordered groups can keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.llm.base import checkpoint, fresh, others

#: Hex digits of the first ranges, and what each refinement adds to them.
FIRST, STEP = 3, 2


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Start index of each shard when units are taken in order and none goes over ``capacity``."""
    cuts, room = [0], capacity
    for i, s in enumerate(sizes):
        if s > room:
            cuts.append(i)
            room = capacity
        room -= s
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search over capacities; each is checked by the greedy pass, which uses the fewest shards possible."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _boundaries(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which shards 1, 2, ... begin. Exact, though no list of all groups is ever made.

    Units are ranges of the digest order, first the 4096 of its first three hex digits, with their byte sums. The
    best capacity over units bounds the best over groups from above, and the i-th cut of any plan within it lies
    between total - (shards - i) * bound and i * bound. Units over the lower bound, else the units that meet such
    an interval (some 16 for each cut), are split by two more digits until they are single groups or the bounds
    meet. The driver so holds some ten thousand sums at any input size.
    """

    def split(prefixes: list[str], digits: int) -> list[tuple]:
        part = groups.where(F.substring("digest", 1, len(prefixes[0])).isin(prefixes)) if prefixes else groups
        rows = part.groupBy(F.substring("digest", 1, digits).alias("p")).agg(
            F.sum("bytes").alias("bytes"), (F.min("digest") == F.max("digest")).alias("single"), F.max("bytes").alias("most")
        )
        return [(r.p, int(r.bytes), r.single, int(r.most)) for r in rows.collect()]

    units = sorted(split([], FIRST))
    while True:
        sizes = [u[1] for u in units]
        total = sum(sizes)
        least = max([-(-total // shards), *(u[3] for u in units)], default=0)
        bound = smallest_capacity(sizes, shards)
        wanted = [u[0] for u in units if not u[2] and u[1] > least]
        if not wanted and bound > least:
            at = 0
            for p, size, single, _ in units:
                if not single and any(at + size >= total - (shards - i) * bound and at <= i * bound for i in range(1, shards)):
                    wanted.append(p)
                at += size
        if not wanted:
            return [units[i][0] for i in greedy_cuts(sizes, bound)[1:]]
        finer = [x for n in {len(p) for p in wanted} for x in split([p for p in wanted if len(p) == n], n + STEP)]
        units = sorted([u for u in units if u[0] not in set(wanted)] + finer)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slot_parts: int = 1024) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: the law is ``bytes``).

    Size: UTF-8 bytes of the text plus 1 (null texts: 1). Rows of equal text are one atomic group and share a
    shard. Groups stand in the order of their SHA-256; the order is cut into ``shards`` contiguous parts so that
    the largest part is as small as it can be. A shard may stay empty where there are few groups. Null and empty
    texts are equal here. Slots count from 0 within a shard without gaps; repeated rows get slots of their own. An empty table gives no rows. A
    very long text may fill a shard by itself.

    Group sums are pre-aggregated before the shuffle, so a text that a third of all rows repeat is one partial row
    a task. Slots are dealt in ``slot_parts`` parts of each shard by a hash of id and text and offset by the parts' counts, so no
    task holds a shard and copies of one text spread out. Columns of ``docs`` named like a result column are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    taken = others(docs, made)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest, part, ids = (fresh(n, [*taken, *made]) for n in ("_digest", "_part", "_ids"))
    small = checkpoint(
        docs.select(F.sha2(text, 256).alias("digest"), (F.octet_length(text) + 1).cast("long").alias("bytes")).groupBy("digest").agg(F.sum("bytes").alias("bytes"))
    )
    cuts = _boundaries(small, shards)
    number = sum(((F.col(digest) >= c).cast("int") for c in cuts), F.lit(0))
    # nothing but the columns that slots need is read twice
    placed = docs.withColumns({digest: F.sha2(text, 256), ids: F.coalesce(F.col(id_col).cast("string"), F.lit(""))}).withColumns(
        {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text), "law": F.lit("bytes"), "shard": number, part: F.pmod(F.xxhash64(ids, digest), F.lit(slot_parts)).cast("int")}
    )
    counts = placed.groupBy("shard", part).agg(F.count(F.lit(1)).alias("_n"))  # at most shards * slot_parts rows
    ahead = F.sum("_n").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("shard").alias("_s"), F.col(part).alias("_p"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("shard", part).orderBy(ids, digest))
    out = placed.withColumn("_rank", rank).join(F.broadcast(offsets), (F.col("shard") == F.col("_s")) & (F.col(part) == F.col("_p")))
    return out.select(*taken, "size", "text_crc32", "law", "shard", (F.col("_ahead") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
