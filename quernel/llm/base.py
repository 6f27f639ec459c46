"""Helpers that the training-data operators share: checkpoints, ASCII folding, row keys, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word and line contracts define it, and the letters that are folded.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that are taken apart at a time.
SLICE = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one of its own; on a cluster that is an error, for executors would not find it.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"quernel-checkpoint-{os.getpid()}"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can reach."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept. ``lower`` is safe, and faster, where all bytes are ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two columns that are equal for two rows only if both carry the same id and text, nulls included."""
    return [
        F.struct(F.col(doc_id).isNull().alias("n"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("v")),
        F.xxhash64(F.col(text).isNull(), F.col(text)),
    ]


def fresh(base: str, taken: list[str]) -> str:
    """A column name that no column in ``taken`` has, whatever the case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def others(docs: DataFrame, made: list[str]) -> list[str]:
    """The columns of ``docs`` that an operator passes through: all but those it makes itself, whatever the case."""
    low = {c.lower() for c in made}
    return [c for c in docs.columns if c.lower() not in low]


def give_back() -> None:
    """Returns freed memory to the system: a worker is kept, and what a task held should not be the next one's burden."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_udf(work: Callable[[list[str | None]], pa.Array], kind: str, rows: int = 256):
    """An Arrow UDF over one text column. ``work`` gets some rows' texts at a time, so that few are Python strings at once."""

    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [work(texts.slice(i, rows).to_pylist()) for i in range(0, len(texts), rows)] or [work([])]
            yield pa.concat_arrays(parts)
        give_back()

    return F.arrow_udf(udf, kind)


@dataclass
class Words:
    """Words of some texts in a row: A-Z lower-cased, ended by ASCII white space."""

    words: pa.Array  # the different ones, binary
    at: np.ndarray  # for each word its place in ``words``
    starts: np.ndarray  # first word of each text
    sizes: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """``texts`` is a string array; null is an empty text."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        filled = pc.binary_length(flat).to_numpy() > 0  # a text that begins or ends with white space has an empty part there
        if not filled.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled], minlength=len(sizes))
            flat = flat.filter(pa.array(filled))
        coded = flat.dictionary_encode()
        return cls(coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes, sizes)


def slices(b: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in stretches of about ``size`` bytes of text; one text is never cut."""
    lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(lengths + 1) // size
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e > s:
            yield b.slice(s, e - s)
    give_back()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two long columns. Returns ``node`` and ``component`` (its smallest reachable node) for every
    node that has an edge to another one. Each round is a few shuffles on node ids, ends in a checkpoint and
    keeps at most one row per edge; hubs are only ever minimised over (pre-aggregated) or joined (which the
    adaptive planner splits), never gathered.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is linked to the smallest node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), F.col("m"), F.col("u"))
        e = checkpoint(
            small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
