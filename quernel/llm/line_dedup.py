"""Line dedup: drop lines whose normalised form occurs in many documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import ASCII_SPACE, ascii_lower, checkpoint, fresh, others, row_key


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, distinct_texts: bool = False) -> DataFrame:
    """``docs`` with frequent lines removed from the text, plus ``n_lines`` and ``n_dropped`` (long).

    A text is split at ``\\n``; a line's key is the line stripped of ASCII white space and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` distinct documents lose all
    their lines; the others are joined by ``\\n`` in their old order.

    Null and empty texts are one empty line and come out as the empty text. Repeated rows count as one document
    (by id); null ids count as no document but lose frequent lines like any other. An empty table gives an empty
    result. Other columns pass through, but for ``n_lines`` and ``n_dropped``, which are replaced. There are no ties: a line goes
    or stays by its count alone. A very long text is one row, and its lines are rows of their own.

    With ``distinct_texts`` a line's count is that of the different texts that hold it, so exact copies of a document do not make
    its lines frequent.

    Only 16-byte hashes of lines are shuffled, first dealt by (line, document) so that a line in a third of all
    documents is spread, then pre-aggregated by line. The text itself crosses the network once.
    """
    taken = others(docs, ["n_lines", "n_dropped"])
    lines, k1, k2 = (fresh(n, taken) for n in ("_lines", "_k1", "_k2"))
    drop = fresh("_drop", taken)
    a, b = row_key(id_col, text_col)
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)

    def keyed(x):
        key = ascii_lower(F.btrim(x, F.lit(ASCII_SPACE)))
        return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), (F.char_length(key) >= min_chars).alias("ok"))

    seen = (
        docs.select((F.xxhash64(F.col(text_col)) if distinct_texts else F.col(id_col)).alias("id"), a.alias("k1"), b.alias("k2"), F.posexplode(split).alias("pos", "line"))
        .select("id", "k1", "k2", "pos", keyed(F.col("line")).alias("k"))
        .where("k.ok")
        .select("id", "k1", "k2", "pos", "k.h1", "k.h2")
    )
    frequent = checkpoint(
        seen.where("id is not null").select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    )
    # the computed key hides the checkpoint's partitioning: both sides of the join are dealt anew, so that hot keys split
    frequent = frequent.select(F.struct("h1", "h2").alias("h"))
    drops = (
        seen.select("k1", "k2", "pos", F.struct("h1", "h2").alias("h")).join(frequent, "h")
        .groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))
        .select(F.col("k1").alias("_j1"), F.col("k2").alias("_j2"), F.col("drop").alias(drop))
    )
    base = docs.withColumns({k1: a, k2: b, lines: split})
    joined = base.join(drops, (F.col(k1) == F.col("_j1")) & (F.col(k2) == F.col("_j2")), "left")
    n = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col(drop), F.array().cast("array<int>")))
    text = F.array_join(F.transform(kept, lambda p: F.get(F.col(lines), p)), "\n")
    out = [F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in taken]
    return joined.select(*out, n.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
