"""The engine's tables made from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a line of each document; versions of a file are the documents of its source."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    return lines.select(
        F.concat("doc_id", F.lit("_"), "pos").alias("id"),
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("filename"),
        F.when(F.col("doc_id") % 11 == 0, "__admin__").when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("lang")).alias("h1"),
        F.col("source").alias("h2"),
        F.concat(F.lit("t"), F.col("doc_id") % 7).alias("h3"),
        F.col("pos").cast("bigint").alias("chunk_index"),
        "content",
        T.content_hash(F.col("content")).alias("content_hash"),
        (F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("created_at"),
    )


CHUNKS = r"""lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
doc_chunks AS (SELECT doc_id || '_' || (i - 1) AS id, doc_id AS document_id, source AS filename,
  CASE WHEN doc_id % 11 = 0 THEN '__admin__' WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS h1, source AS h2, 't' || (doc_id % 7) AS h3,
  (i - 1)::BIGINT AS chunk_index, l[i] AS content, sha1(regexp_replace(lower(l[i]), '[^\p{L}\p{N}_]', '', 'g')) AS content_hash,
  1700000000 + doc_id * 60 AS created_at
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines))"""


def qa_pairs(spark: SparkSession, sf_dir: str, context: Column | None = None) -> DataFrame:
    """Each user turn with the assistant turn after it; the context is the document ``conv_id`` modulo their number, and the
    judge's scores follow from lengths and the document's labels (a stand-in that both engines can compute).
    Where what ``context`` tells of the text does, the texts themselves are not shuffled."""
    turns = read(spark, sf_dir, "conversations")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id"), (F.col("text") if context is None else context).alias("context"), F.col("source").alias("doc"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    q = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    pairs = q.join(a, ["conv_id", "turn"]).crossJoin(F.broadcast(total)).withColumn("doc_id", F.col("conv_id") % F.col("n")).drop("n")
    rows = pairs.join(docs, "doc_id").join(labels, "doc_id", "left").fillna({"quality": 1, "toxic": 0})
    la, lq = F.length("a"), F.length("q")
    intents = F.array(*[F.lit(x) for x in ("fact", "purpose", "how", "condition", "comparison", "list")])
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", "doc_id", "doc", "q", "a", "context",
        F.element_at(intents, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int")).alias("intent"),
        ((10 - la % 4) / 10.0).alias("relevance"),
        F.when(F.col("quality") == 1, (10 - lq % 3) / 10.0).otherwise((lq % 7) / 10.0).alias("groundedness"),
        ((10 - 5 * F.col("toxic")) / 10.0).alias("context_relevance"),
        ((10 - (lq + la) % 5) / 10.0).alias("avg_quality"),
    )


QA = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
qa AS (SELECT q.conv_id * 1000 + q.turn AS qa_id, q.conv_id, d.doc_id, d.source AS doc, q.text AS q, a.text AS a, d.text AS context,
  ['fact','purpose','how','condition','comparison','list'][(q.conv_id + q.turn) % 6 + 1] AS intent,
  (10 - length(a.text) % 4) / 10e0 AS relevance,
  CASE WHEN coalesce(quality, 1) = 1 THEN (10 - length(q.text) % 3) / 10e0 ELSE (length(q.text) % 7) / 10e0 END AS groundedness,
  (10 - 5 * coalesce(toxic, 0)) / 10e0 AS context_relevance, (10 - (length(q.text) + length(a.text)) % 5) / 10e0 AS avg_quality
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant'
  JOIN documents d ON d.doc_id = q.conv_id % (SELECT count(*) FROM documents) LEFT JOIN lab ON lab.doc_id = d.doc_id),
valid AS (SELECT * FROM qa WHERE length(q) BETWEEN 5 AND 500 AND length(a) BETWEEN 2 AND 2000 AND length(context) BETWEEN 50 AND 50000),
scored AS (SELECT *, round(0.3e0 * relevance + 0.5e0 * groundedness + 0.2e0 * context_relevance, 3) AS rag,
  groundedness < 0.4e0 AS hallucination, relevance >= 0.6e0 AND groundedness < 0.6e0 AS faithfulness_error,
  NOT (groundedness >= 0.4e0 AND groundedness < 0.6e0 AND relevance >= 0.6e0) AND (relevance < 0.6e0 OR groundedness < 0.6e0) AS retrieval_miss,
  context_relevance < 0.6e0 AS poor_context, length(regexp_replace(context, '^\\s+|\\s+$', '', 'g')) < 100 AS bad_chunk FROM valid),
failed AS (SELECT *, CASE WHEN len(t) = 0 AND avg_quality < 0.7e0 THEN ['low_quality'] ELSE t END AS types FROM (SELECT *,
  list_filter([CASE WHEN hallucination THEN 'hallucination' END, CASE WHEN faithfulness_error THEN 'faithfulness_error' END,
    CASE WHEN retrieval_miss THEN 'retrieval_miss' END, CASE WHEN poor_context THEN 'poor_context' END, CASE WHEN bad_chunk THEN 'bad_chunk' END], lambda x: x IS NOT NULL) AS t FROM scored))"""


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Generation and evaluation results, one of each an order; some links are missing or dangle."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("day"))
    stamp = F.unix_date("day").cast("bigint") * 86400 + F.col("k") % 86400
    k = F.col("k")
    gen = orders.select(
        k.alias("gen_id"), stamp.alias("created_at"), F.concat(F.lit("doc"), F.col("c") % 50).alias("source_doc"), F.col("p").alias("model"), (5 + k % 20).alias("total_qa"), (k % 1000 * 10).alias("tokens_in"), (k % 700 * 3).alias("tokens_out"),
        F.when(k % 4 == 0, None).when(k % 7 == 0, k + 1_000_000_000).otherwise(k).alias("linked_evaluation_id"),
    )
    score = F.when(k % 29 == 0, None).otherwise((k * 37 % 1000) / 1000.0)
    eva = orders.filter("k % 5 != 0").select(
        k.alias("eval_id"), (stamp + 60).alias("created_at"), (10 + k % 40).alias("total_qa"), (10 + k % 40 - k % 5).alias("valid_qa"), score.alias("final_score"),
        F.when(k % 3 == 0, k).alias("generation_id"), F.when(k % 2 == 0, F.concat(F.lit("doc"), F.col("c") % 50)).otherwise("").alias("source_doc"), F.when(k % 6 == 0, None).otherwise(F.col("p")).alias("model"),
    )
    from ..operators.evaluate import grade

    return gen, eva.withColumn("final_grade", F.when(F.col("final_score").isNotNull(), grade(F.col("final_score"))))


RESULTS = """ord AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, epoch(date_trunc('day', o_orderdate))::BIGINT + o_orderkey % 86400 AS stamp FROM orders),
gen AS (SELECT k AS gen_id, stamp AS created_at, 'doc' || (c % 50) AS source_doc, p AS model, 5 + k % 20 AS total_qa, k % 1000 * 10 AS tokens_in, k % 700 * 3 AS tokens_out,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 7 = 0 THEN k + 1000000000 ELSE k END AS linked_evaluation_id FROM ord),
ev0 AS (SELECT k AS eval_id, stamp + 60 AS created_at, 10 + k % 40 AS total_qa, 10 + k % 40 - k % 5 AS valid_qa,
  CASE WHEN k % 29 = 0 THEN NULL ELSE (k * 37 % 1000) / 1000e0 END AS final_score, CASE WHEN k % 3 = 0 THEN k END AS generation_id,
  CASE WHEN k % 2 = 0 THEN 'doc' || (c % 50) ELSE '' END AS source_doc, CASE WHEN k % 6 = 0 THEN NULL ELSE p END AS model FROM ord WHERE k % 5 <> 0),
eva AS (SELECT *, CASE WHEN final_score >= 0.95e0 THEN 'A+' WHEN final_score >= 0.85e0 THEN 'A' WHEN final_score >= 0.75e0 THEN 'B+'
  WHEN final_score >= 0.65e0 THEN 'B' WHEN final_score >= 0.5e0 THEN 'C' WHEN final_score IS NOT NULL THEN 'F' END AS final_grade FROM ev0)"""
