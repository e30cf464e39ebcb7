"""The opN queries: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import ann, chat, mixing, ngram_join, packing, rans, secrets, topk, toxicity, warc
from newsloom.llm.common import table

CAPACITY = 2048
#: Target token shares: domains are q<quality>t<toxic> of the labelled table.
MIX = {"q1t0": 0.90, "q0t0": 0.07, "q1t1": 0.02, "q0t1": 0.01}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(chat.format_conversations(rows))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_posting_list_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)


def op10_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_best_fit_packing, op3_warc_derivatives, op4_ngram_jaccard, op5_toxicity, op6_secret_scan, op7_posting_list_ann, op8_ball_tree_topk, op9_soft_mixing, op10_rans_files)}


_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
_OP1 = rf"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 0
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 0
), marked AS (
  SELECT *, {_ESCAPED} AS escaped,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '=' || replace(replace(role, '\', '\\'), ':', '\:') END AS label FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(label) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
  false AS rewrites
FROM marked GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN row_id END
"""
_OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, string_agg(s, '|' ORDER BY s) AS own FROM shingles GROUP BY doc_id),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY own) AS copy_id FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 10 * common >= 8 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node)
SELECT d.doc_id, c.class_id, k.copy_id, (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links
FROM documents d JOIN classes c ON c.node = d.doc_id JOIN copies k ON k.doc_id = d.doc_id
"""
_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.z, v.z) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1, "op4_ngram_jaccard": _OP4, "op8_ball_tree_topk": _OP8}
