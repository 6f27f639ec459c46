"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import checkpoint, components, fresh, text_udf

BITS = 64
#: Rows of one side of a comparison block: a pair matrix of at most CHUNK * CHUNK 64-bit words is in memory at a time.
CHUNK = 1024
#: Chunks of a bucket beyond which it is dealt by two segments: about as many as each row is then listed for.
COARSE = 16


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes (uint64) of the word shingles with repeats. A-Z is lower-cased, words end at ASCII white space.

    Fewer words than a shingle: the whole sequence is the one shingle. No words: none.
    """
    parts = (text or "").encode().lower().split()  # for bytes both act on ASCII alone
    if not parts:
        return np.array([], np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles, counted with repeats. No words: zero."""
    hashes = shingle_hashes(text, words, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def segments_of(distance: int) -> int:
    """More segments than bits may differ, so that a link agrees on one; at least four, so that a segment has 16 bits at most."""
    return max(distance + 1, 4)


def widths(distance: int) -> list[int]:
    """Widths of the near-equal segments of the fingerprint."""
    m = segments_of(distance)
    return [BITS // m + (i < BITS % m) for i in range(m)]


def chain_masks(distance: int) -> list[list[tuple[int, int]]]:
    """For each start segment the (mask, budget) of chains of 1, 2, ... consecutive segments on the ring.

    Pigeonring principle: if the differences of m segments sum to at most the distance, some start exists from
    which every chain of l segments differs in at most l * distance / m bits.
    """
    w, m = widths(distance), segments_of(distance)
    at = np.cumsum([0, *w])
    own = [((1 << w[i]) - 1) << int(at[i]) for i in range(m)]
    out = []
    for i in range(m):
        mask, chain = 0, []
        for length in range(1, m + 1):
            mask |= own[(i + length - 1) % m]
            chain.append((mask, length * distance // m))
        out.append(chain)
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray | None, chain: list[tuple[int, int]], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints (uint64) within the distance whose chain from one start segment holds.

    With ``b`` None the pairs are within ``a``, the smaller index first. The short chains prune the pair matrix
    first; what survives all of them is checked in full.
    """
    xor = a[:, None] ^ (a if b is None else b)[None, :]
    near = np.bitwise_count(xor & np.uint64(chain[min(1, len(chain) - 1)][0])) <= chain[min(1, len(chain) - 1)][1]
    if b is None:
        near = np.triu(near, 1)
    left, right = np.nonzero(near)
    bits = xor[left, right]
    for mask, budget in [chain[0], *chain[2:]]:
        keep = np.bitwise_count(bits & np.uint64(mask)) <= budget
        left, right, bits = left[keep], right[keep], bits[keep]
    keep = np.bitwise_count(bits) <= distance
    return left[keep], right[keep]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_edges(distance: int):
    chains = chain_masks(distance)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; each block is compared when its last row has been read."""
        held: list[tuple] = []
        last = None

        def flush():
            if not held:
                return None
            part = [np.concatenate(x) for x in zip(*held, strict=True)]
            seg, side, fp, rep = part
            held.clear()
            if len(fp) < 2:
                return None
            if side.any():
                first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
                if not len(first) or not len(second):
                    return None
                i, j = linked_pairs(fp[first], fp[second], chains[int(seg[0])], distance)
                i, j = first[i], second[j]
            else:
                i, j = linked_pairs(fp, None, chains[int(seg[0])], distance)
            if not len(i):
                return None
            label = forest(len(fp), i, j)
            child = np.flatnonzero(label != np.arange(len(fp)))
            return rep[child], rep[label[child]]

        def made(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        found: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, pair, seg, side, fp, rep = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "pair", "seg", "side", "fp", "rep"))
            fp = fp.view(np.uint64)
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(block)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if last is not None and (block[s], pair[s]) != last and (x := flush()):
                    found.append(x)
                last = (block[s], pair[s])
                held.append((seg[s:e], side[s:e], fp[s:e], rep[s:e]))
            if sum(len(x[0]) for x in found) > 50_000:
                yield made(found)
                found = []
        if x := flush():
            found.append(x)
        if found:
            yield made(found)

    return work


def _refined(dealt: DataFrame, w: list[int], distance: int, chunk: int) -> DataFrame:
    """Rows of large buckets under finer ones: the segment's value and the next segment's but for one bit.

    A chain of two segments may differ in one bit at most, and the first agrees; so the second agrees but for some bit, and two
    fingerprints share the bucket that leaves that bit out. Each row is listed once for each bit.
    """
    m = len(w)
    at = np.cumsum([0, *w]).tolist()
    assert 2 * distance // m <= 1
    lists = F.lit(None).cast("array<int>")
    for i in range(m):
        k = (i + 1) % m
        value = F.shiftrightunsigned("fp", at[k]).bitwiseAND(F.lit((1 << w[k]) - 1)).cast("int")
        subs = F.array(*(value.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((bit + 1) << 16)) for bit in range(w[k])))
        lists = F.when(F.col("seg") == i, subs).otherwise(lists)
    finer = dealt.select("seg", "val", "fp", "rep", F.explode(lists).alias("sub"))
    counts = finer.groupBy("seg", "val", "sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = counts.select(F.col("seg").alias("_s"), F.col("val").alias("_v"), F.col("sub").alias("_u"), F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    return finer.join(counts, (F.col("seg") == F.col("_s")) & (F.col("val") == F.col("_v")) & (F.col("sub") == F.col("_u"))).select("seg", "val", "sub", "fp", "rep", "k")


def hamming_components(classes: DataFrame, distance: int = 4, chunk: int = CHUNK, coarse: int = COARSE) -> DataFrame:
    """``classes`` has distinct ``fp`` and their ``rep`` (both long). Returns (fp, component), the smallest reachable rep.

    A null rep links like any other; the component is null if no reachable fingerprint has a rep.

    Every fingerprint is listed once for each of its segments under (segment, value): links share at
    least one. A bucket of more than ``coarse`` chunks of ``chunk`` rows is dealt anew by chains of two segments, which have some
    8192 times as many values for 13 times as many rows. What is left of a bucket is cut into chunks, and each pair of chunks is a
    block of its own, so a bucket that holds most rows spreads over many tasks. A block gives back a spanning forest,
    at most one edge a row, never the pairs.
    """
    w = widths(distance)
    at = np.cumsum([0, *w]).tolist()
    segments = F.array(*(F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << w[i]) - 1)).cast("int").alias("val")) for i in range(len(w))))
    listed = classes.select("fp", F.col("fp").alias("rep"), F.explode(segments).alias("s")).select("s.seg", "s.val", "fp", "rep")
    # at most segments * 2**16 rows, whatever the input: 40,960 for distance 4
    counts = listed.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("seg").alias("_s"), F.col("val").alias("_v"), F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    counts = checkpoint(counts)
    dealt = listed.join(F.broadcast(counts), (F.col("seg") == F.col("_s")) & (F.col("val") == F.col("_v"))).select("seg", "val", F.lit(0).alias("sub"), "fp", "rep", "k")
    if not counts.where(F.col("k") > coarse).isEmpty():
        dealt = dealt.where(F.col("k") <= coarse).unionAll(_refined(dealt.where(F.col("k") > coarse), w, distance, chunk))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    i, j = F.least("c", "o").cast("long"), F.greatest("c", "o").cast("long")
    block = (F.col("seg").cast("long") * (1 << 16) + F.col("val")) * (1 << 21) + F.col("sub")
    blocks = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        block.alias("block"), (i * (1 << 31) + j).alias("pair"), "seg", F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), "fp", "rep"
    )
    blocks = blocks.repartition("block", "pair").sortWithinPartitions("block", "pair")
    edges = blocks.mapInArrow(_block_edges(distance), "a long, b long")
    found = components(edges)
    linked = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.col("component").alias("c"))
    named = linked.where("c is not null").groupBy("c").agg(F.min("rep").alias("least")).withColumnRenamed("c", "_c")
    return linked.join(named, F.col("c") == F.col("_c"), "left").select("fp", F.when(F.col("c").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(id, ``fingerprint`` as 16 hex digits, ``component_id``) for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id link and
    bridge like others; their component is null if no row with an id is in it. Repeated rows repeat in the result; ties
    need no rule, for the smallest id names a component. An empty table gives an empty result. Ids must be integers. Other columns
    are not passed on, so none can clash. A very long text is hashed whole by one task.
    """
    udf = text_udf(lambda texts: pa.array([fingerprint(x, words, seed) for x in texts], pa.int64()), "long")
    prints = checkpoint(docs.select(F.col(id_col).cast("long").alias("id"), udf(F.col(text_col)).alias("fp")))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    found = hamming_components(classes, distance)
    # both sides are dealt by fp anew, so that a fingerprint that a third of all rows share is split
    found = found.select(F.col("fp").alias("_fp"), "component")
    return prints.join(found, F.col("fp") == F.col("_fp"), "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row kept of each component: the one of the smallest id. Rows with null ids are kept as they are.

    Of rows that repeat an id one is kept. Empty tables stay empty; columns pass through whatever their names.
    """
    keep = simhash_components(docs, id_col, text_col, words, distance, seed).where(F.col(id_col) == F.col("component_id"))
    key = fresh("_keep", docs.columns)
    keep = checkpoint(keep.select(F.col(id_col).alias(key)).distinct())
    keep = keep.select(F.col(key).bitwiseXOR(F.lit(0)).alias(key))
    one = docs.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col).cast("long") == F.col(key), "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(F.col(id_col).isNull()))
