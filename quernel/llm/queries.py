"""The operators over whole tables, as ``__spark_entry__`` registers them, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import chat_format, language_id, lm_scoring, secrets, sentencepiece_codec
from quernel.llm.decontaminate import contamination
from quernel.llm.embedding_dedup import cosine_components
from quernel.llm.line_dedup import line_dedup
from quernel.llm.sharding import shard
from quernel.llm.simhash import simhash_components


#: The public vocabulary that encodes the corpus, and the conversation that the formatting contract adds.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more, and their components."""
    return cosine_components(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-bilinear log10-probability of every document; a fifth of the ids is held out from learning."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    return lm_scoring.score(docs, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 13-word windows of benchmark items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = contamination(docs, _table(spark, sf_dir, "benchmark"), window=13).select("doc_id", "leak.n_words", "leak.n_hit", "leak.items")
    return leak.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose 64-bit SimHashes of 4-word shingles are linked by four bits or fewer."""
    return simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, distance=4, seed=42)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document as piece ids; ``round_trip``: decoding them gives the text back. The session's ``quernel.pieces`` can name the vocabulary."""
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model or spark.conf.get("quernel.pieces", PIECE_MODEL))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-parsing language of every document; a fifth of the ids is held out from learning."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))
    model = language_id.learn(docs.where("not held_out"))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "phrase_rate")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the base patterns, and literals assigned to sensitive names."""
    out = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", F.sha2("secrets.base", 256).alias("base_sha256"), "secrets.spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; the digest is of the text that is left."""
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(table.unionByName(probe.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema)))))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes; equal texts stay together."""
    out = shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP3_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 13) AS k,
         array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), g AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))
), h AS (
  SELECT doc_id, i, g.k AS k, item FROM g JOIN win ON g.k = win.k AND g.w = win.w
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT dw.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key AS fkey FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(fkey) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE fkey IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = fkey GROUP BY doc_id
"""


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), r(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a
), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a
"""

#: The control strings and marks of ``chat_format.Template``, longest first, and the backslash.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, '\|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>' AS marks FROM t
), s AS (
  SELECT *, length('[INST] ') + length(role) + len(regexp_extract_all(role, marks)) + length(' [/INST]') + length(text) + len(regexp_extract_all(text, marks)) + length('</s>') AS chars FROM m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites
FROM s GROUP BY conv_id
"""


def queries() -> dict:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_lm_scoring": op2_lm_scoring, "op3_decontamination": op3_decontamination, "op4_simhash": op4_simhash, "op5_sentencepiece": op5_sentencepiece, "op6_language_id": op6_language_id, "op7_secrets": op7_secrets, "op8_line_dedup": op8_line_dedup, "op9_chat_format": op9_chat_format, "op10_sharding": op10_sharding}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op8_line_dedup": OP8_SQL, "op9_chat_format": OP9_SQL}
