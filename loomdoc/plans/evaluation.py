"""Queries over question-answer pairs: the layers of an evaluation and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import similarity
from .adapters import CHUNKS, QA, qa_pairs, read
from .registry import query


def scored(spark, sf_dir: str) -> DataFrame:
    """Pairs without syntax errors, with triad average, failure classes and pass."""
    rows = qa_pairs(spark, sf_dir).filter(F.size(E.syntax_errors()) == 0)
    rows = rows.withColumn("rag", E.triad_average()).withColumn("types", E.failure_types())
    return rows.withColumn("primary_failure", E.primary_failure(F.col("types"))).withColumn("pass", E.passes(F.col("types")))


@query("eval_summary", f"""WITH {QA},
flat AS (SELECT count(*) AS n, avg(rag) AS rag_avg, avg(avg_quality) AS completeness_avg, stddev_pop(groundedness) AS g_std,
  100e0 * count(*) FILTER (groundedness < 0.8e0) / count(*) AS g_low, count(*) FILTER (hallucination) AS hallucination,
  count(*) FILTER (faithfulness_error) AS faithfulness_error, count(*) FILTER (retrieval_miss) AS retrieval_miss,
  count(*) FILTER (avg_quality >= 0.7e0 AND NOT hallucination AND NOT faithfulness_error) AS passed FROM failed),
s AS (SELECT flat.*, (SELECT count(*) FROM qa) AS total FROM flat),
f AS (SELECT *, 100e0 * n / total / 100 * 0.05e0 + 0.025e0 + rag_avg * 0.65e0 + completeness_avg * 0.25e0 AS score FROM s)
SELECT total, n AS valid, round(rag_avg, 5) AS rag_avg, round(completeness_avg, 5) AS completeness_avg, round(g_std, 5) AS groundedness_std, round(g_low, 2) AS groundedness_below_pct,
  hallucination, faithfulness_error, retrieval_miss, passed, round(score, 5) AS final_score,
  CASE WHEN score >= 0.95e0 THEN 'A+' WHEN score >= 0.85e0 THEN 'A' WHEN score >= 0.75e0 THEN 'B+' WHEN score >= 0.65e0 THEN 'B' WHEN score >= 0.5e0 THEN 'C' ELSE 'F' END AS grade FROM f""")
def eval_summary(spark, sf_dir):
    """The whole evaluation in one plan: a single pass over the pairs, statistics layer at its default."""
    ok = F.size(E.syntax_errors()) == 0
    rows = qa_pairs(spark, sf_dir).withColumn("ok", ok).withColumn("rag", E.triad_average()).withColumn("types", E.failure_types())
    has = lambda t: F.count_if(F.col("ok") & F.array_contains("types", t)).alias(t)
    own = lambda c: F.when(F.col("ok"), F.col(c))
    flat = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"), F.avg(own("rag")).alias("rag_avg"), F.avg(own("avg_quality")).alias("completeness_avg"),
        F.stddev_pop(own("groundedness")).alias("g_std"), (100.0 * F.count_if(own("groundedness") < 0.8) / F.count_if("ok")).alias("g_low"),
        has("hallucination"), has("faithfulness_error"), has("retrieval_miss"), F.count_if(F.col("ok") & E.passes(F.col("types"))).alias("passed"),
    )
    score = E.final_score(100.0 * F.col("valid") / F.col("total"), F.lit(None).cast("double"), F.col("rag_avg"), F.col("completeness_avg"))
    flat = flat.withColumn("score", score)
    return flat.select(
        "total", "valid", F.round("rag_avg", 5).alias("rag_avg"), F.round("completeness_avg", 5).alias("completeness_avg"), F.round("g_std", 5).alias("groundedness_std"), F.round("g_low", 2).alias("groundedness_below_pct"),
        "hallucination", "faithfulness_error", "retrieval_miss", "passed", F.round("score", 5).alias("final_score"), E.grade(F.col("score")).alias("grade"),
    )


@query("q02_syntax", f"""WITH {QA} SELECT qa_id, array_to_string(list_filter([
  CASE WHEN length(q) < 5 THEN 'q too short' WHEN length(q) > 500 THEN 'q too long' END,
  CASE WHEN length(a) < 2 THEN 'a too short' WHEN length(a) > 2000 THEN 'a too long' END,
  CASE WHEN length(context) < 50 THEN 'context too short' WHEN length(context) > 50000 THEN 'context too long' END], lambda x: x IS NOT NULL), '; ') AS errors FROM qa""")
def q02_syntax(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("qa_id", F.array_join(E.syntax_errors(), "; ").alias("errors"))


@query("q05_failures", f"""WITH {QA} SELECT qa_id, rag, array_to_string(types, ',') AS failure_types,
  CASE WHEN list_contains(types, 'hallucination') THEN 'hallucination' WHEN list_contains(types, 'faithfulness_error') THEN 'faithfulness_error'
    WHEN list_contains(types, 'retrieval_miss') THEN 'retrieval_miss' WHEN list_contains(types, 'bad_chunk') THEN 'bad_chunk'
    WHEN list_contains(types, 'low_quality') THEN 'low_quality' ELSE types[1] END AS primary_failure,
  avg_quality >= 0.7e0 AND NOT hallucination AND NOT faithfulness_error AS passed FROM failed""")
def q05_failures(spark, sf_dir):
    return scored(spark, sf_dir).select("qa_id", "rag", F.array_join("types", ",").alias("failure_types"), "primary_failure", F.col("pass").alias("passed"))


@query("q01_status", f"""WITH {QA} SELECT qa_id, CASE WHEN avg_quality < 0.7e0 AND rag < 0.7e0 THEN 'fail'
  WHEN avg_quality < 0.7e0 OR rag < 0.7e0 OR len(types) > 0 THEN 'hold' ELSE 'success' END AS status, round((3 * rag + avg_quality) / 4, 5) AS item_score FROM failed""")
def q01_status(spark, sf_dir):
    """Status of each item, and its single score (three parts triad, one part completeness)."""
    q, r = F.coalesce(F.col("avg_quality"), F.lit(0.0)) < 0.7, F.coalesce(F.col("rag"), F.lit(0.0)) < 0.7
    status = F.when(q & r, "fail").when(~F.col("pass") | (F.size("types") > 0) | q | r, "hold").otherwise("success")
    return scored(spark, sf_dir).select("qa_id", status.alias("status"), F.round((3 * F.col("rag") + F.col("avg_quality")) / 4, 5).alias("item_score"))


@query("g07_score_summary", f"""WITH {QA}, t AS (SELECT 'relevance' AS metric, relevance AS v, 0.7e0 AS c FROM scored UNION ALL SELECT 'groundedness', groundedness, 0.8e0 FROM scored
  UNION ALL SELECT 'context_relevance', context_relevance, 0.7e0 FROM scored UNION ALL SELECT 'completeness', avg_quality, 0.7e0 FROM scored)
  SELECT metric, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std, round(100e0 * count(*) FILTER (v < c) / count(*), 1) AS below_pct FROM t GROUP BY metric""")
def g07_score_summary(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("completeness", F.col("avg_quality"))
    return E.score_summary(rows, {"relevance": 0.7, "groundedness": 0.8, "context_relevance": 0.7, "completeness": 0.7})


@query("g09_syntax_layer", f"""WITH {QA} SELECT (SELECT count(*) FROM qa) AS total, count(*) AS valid, (SELECT count(*) FROM qa) - count(*) AS invalid,
  round(100e0 * count(*) / (SELECT count(*) FROM qa), 2) AS pass_rate FROM valid""")
def g09_syntax_layer(spark, sf_dir):
    ok = F.size(E.syntax_errors()) == 0
    flat = qa_pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"))
    return flat.select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), F.round(100.0 * F.col("valid") / F.col("total"), 2).alias("pass_rate"))


@query("g11_diversity", f"""WITH {QA}, i AS (SELECT intent, count(*)::DOUBLE AS n FROM qa GROUP BY intent),
  e AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS k FROM i),
  w AS (SELECT unnest(list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '')) AS w FROM qa), v AS (SELECT count(DISTINCT w) AS u, count(*) AS n FROM w)
  SELECT round(h, 3) AS intent_entropy, u AS unique_tokens, n AS tokens, round(u / n::DOUBLE, 3) AS ttr,
  round(least(10, 0.6e0 * CASE WHEN k > 1 THEN h / log2(k) * 10 WHEN k = 1 THEN 5 ELSE 0 END + 0.4e0 * u / n::DOUBLE * 10), 2) AS diversity_score,
  (SELECT round(avg(length(q)), 1) FROM qa) AS avg_q_len, (SELECT round(avg(length(a)), 1) FROM qa) AS avg_a_len FROM e, v""")
def g11_diversity(spark, sf_dir):
    """Intent entropy and type-token ratio, in sums that are partly made before each shuffle."""
    qa = qa_pairs(spark, sf_dir)
    intents = qa.groupBy(F.coalesce("intent", F.lit("unknown")).alias("intent")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    e = intents.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"), F.count(F.lit(1)).alias("k"))
    words = qa.select(F.explode(F.filter(F.split("q", r"(?U)\s+"), lambda w: w != "")).alias("w")).groupBy("w").count()
    v = words.agg(F.count(F.lit(1)).alias("u"), F.sum("count").alias("n"))
    sizes = qa.agg(F.round(F.avg(F.length("q")), 1).alias("avg_q_len"), F.round(F.avg(F.length("a")), 1).alias("avg_a_len"))
    intent = F.when(F.col("k") > 1, F.col("h") / F.log2("k") * 10).when(F.col("k") == 1, 5.0).otherwise(0.0)
    rate = F.col("u") / F.col("n")
    # each side is one row
    one = e.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(sizes))
    return one.select(F.round("h", 3).alias("intent_entropy"), F.col("u").alias("unique_tokens"), F.col("n").alias("tokens"), F.round(rate, 3).alias("ttr"), F.round(F.least(F.lit(10.0), 0.6 * intent + 4.0 * rate), 2).alias("diversity_score"), "avg_q_len", "avg_a_len")


@query("g13_skewness", f"""WITH {QA}, c AS (SELECT doc_id, count(*)::DOUBLE AS n FROM qa GROUP BY doc_id), s AS (SELECT 100 * max(n) / sum(n) AS share, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c)
  SELECT round(share, 2) AS max_share, round(h, 3) AS doc_entropy, CASE WHEN share <= 30 THEN 10 WHEN share <= 50 THEN 8 WHEN share <= 80 THEN 5 ELSE 2 END AS skewness_score FROM s""")
def g13_skewness(spark, sf_dir):
    counts = qa_pairs(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = counts.agg((100 * F.max("n") / F.sum("n")).alias("share"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return s.select(F.round("share", 2).alias("max_share"), F.round("h", 3).alias("doc_entropy"), F.when(F.col("share") <= 30, 10).when(F.col("share") <= 50, 8).when(F.col("share") <= 80, 5).otherwise(2).alias("skewness_score"))


@query("g14_sufficiency", f"""WITH {QA}, p AS (SELECT 'q' AS field, 100e0 * count(nullif(q, '')) / count(*) AS pct FROM qa UNION ALL SELECT 'a', 100e0 * count(nullif(a, '')) / count(*) FROM qa
  UNION ALL SELECT 'context', 100e0 * count(nullif(context, '')) / count(*) FROM qa UNION ALL SELECT 'intent', 100e0 * count(nullif(intent, '')) / count(*) FROM qa
  UNION ALL SELECT 'doc', 100e0 * count(nullif(doc, '')) / count(*) FROM qa) SELECT field, round(pct, 2) AS pct FROM p""")
def g14_sufficiency(spark, sf_dir):
    fields = ["q", "a", "context", "intent", "doc"]
    one = qa_pairs(spark, sf_dir).agg(*[(100.0 * F.count(F.nullif(F.col(c), F.lit(""))) / F.count(F.lit(1))).alias(c) for c in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.round(c, 2).alias("pct")) for c in fields])).alias("x")).select("x.*")


@query("g20_intent_share", f"""WITH {QA} SELECT intent, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM qa GROUP BY intent""")
def g20_intent_share(spark, sf_dir):
    counts = qa_pairs(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("intent", "n", F.round(100.0 * F.col("n") / F.col("t"), 1).alias("pct"))


@query("g22_failing_items", f"""WITH {QA} SELECT qa_id, round((rag + avg_quality) / 2, 5) AS mean_score, array_to_string(list_sort(types), ',') AS issues FROM failed
  WHERE (rag + avg_quality) / 2 < 0.7e0 ORDER BY (rag + avg_quality) / 2, qa_id LIMIT 20""")
def g22_failing_items(spark, sf_dir):
    """The report's twenty worst items."""
    m = (F.col("rag") + F.col("avg_quality")) / 2
    return scored(spark, sf_dir).withColumn("m", m).filter("m < 0.7").orderBy("m", "qa_id").limit(20).select("qa_id", F.round("m", 5).alias("mean_score"), F.array_join(F.array_sort("types"), ",").alias("issues"))


@query("p01_flatten", """WITH t AS (SELECT conv_id, list({'turn': turn, 'q': text} ORDER BY turn) AS qs FROM conversations WHERE role = 'user' GROUP BY conv_id)
  SELECT conv_id, 'qa_' || conv_id || '_' || (i - 1) AS qa_id, qs[i].q AS q, substr(d.text, 1, 10000) AS context FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM t)
  JOIN documents d ON d.doc_id = conv_id""")
def p01_flatten(spark, sf_dir):
    """Nested results flattened to one row a question, with the context injected."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    nested = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("q")))).alias("qs"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.substring("text", 1, 10000).alias("context"))
    flat = nested.select("conv_id", F.posexplode("qs").alias("j", "x"))
    return flat.join(docs, "conv_id").select("conv_id", F.format_string("qa_%d_%d", "conv_id", "j").alias("qa_id"), F.col("x.q").alias("q"), "context")


@query("j04_export", f"""WITH {QA} SELECT qa.qa_id, substr(qa.q, 1, 300) AS q, substr(qa.a, 1, 500) AS a, f.rag, f.avg_quality, coalesce(f.avg_quality >= 0.7e0 AND NOT f.hallucination AND NOT f.faithfulness_error, false) AS passed,
  CASE WHEN f.qa_id IS NULL THEN 'syntax_error' ELSE array_to_string(f.types, ',') END AS failure_types FROM qa LEFT JOIN failed f ON f.qa_id = qa.qa_id""")
def j04_export(spark, sf_dir):
    """Every pair with its scores; pairs with syntax errors keep their place and say so."""
    rows = qa_pairs(spark, sf_dir).withColumn("ok", F.size(E.syntax_errors()) == 0).withColumn("types", E.failure_types())
    when = lambda c: F.when(F.col("ok"), c)
    return rows.select("qa_id", F.substring("q", 1, 300).alias("q"), F.substring("a", 1, 500).alias("a"), when(E.triad_average()).alias("rag"), when(F.col("avg_quality")).alias("avg_quality"), F.coalesce(when(E.passes(F.col("types"))), F.lit(False)).alias("passed"), F.when(F.col("ok"), F.array_join("types", ",")).otherwise("syntax_error").alias("failure_types"))


@query("k06_sorted_page", f"""WITH {QA} SELECT qa_id, rag FROM scored ORDER BY coalesce(rag, -1) DESC, qa_id LIMIT 5 OFFSET 5""")
def k06_sorted_page(spark, sf_dir):
    """The second page of five of the items by score."""
    return scored(spark, sf_dir).select("qa_id", "rag").orderBy(F.coalesce("rag", F.lit(-1.0)).desc(), "qa_id").offset(5).limit(5)


@query("u01_near_questions")
def u01_near_questions(spark, sf_dir):
    """Near-duplicate questions within each document, with their leaders (order-dependent; held against brute force in the tests)."""
    rows = qa_pairs(spark, sf_dir).select("doc_id", "qa_id", F.lower("q").alias("q"))
    return similarity.near_leaders(rows, "doc_id", "qa_id", "q", 0.70)


@query("u03_repeated_questions")
def u03_repeated_questions(spark, sf_dir):
    """The same across the chunks of a generation: white space removed, threshold 0.75, the newer text first."""
    rows = qa_pairs(spark, sf_dir).select("doc_id", "qa_id", F.regexp_replace(F.lower("q"), r"(?U)\s+", "").alias("q"))
    return similarity.near_leaders(rows, "doc_id", "qa_id", "q", 0.75, newer_first=True)


@query("s24_score_in_text", r"""WITH l AS (SELECT conv_id, turn, list_reverse(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '\b(10|[0-9])\b', 1)), lambda x: x <> '')) AS f FROM conversations)
  SELECT conv_id, turn, coalesce(f[1]::DOUBLE / 10, 0.5e0) AS score FROM l""")
def s24_score_in_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.score_in(F.col("text")).alias("score"))


@query("f09_untagged_share", f"""WITH {CHUNKS} SELECT document_id, round(avg(CASE WHEN coalesce(h1, '') = '' THEN 1e0 ELSE 0e0 END), 5) AS untagged, avg(CASE WHEN coalesce(h1, '') = '' THEN 1e0 ELSE 0e0 END) > 0.3e0 AS incomplete FROM doc_chunks GROUP BY document_id""")
def f09_untagged_share(spark, sf_dir):
    from .adapters import doc_chunks

    share = F.avg(F.when(F.coalesce("h1", F.lit("")) == "", 1.0).otherwise(0.0))
    return doc_chunks(spark, sf_dir).groupBy("document_id").agg(F.round(share, 5).alias("untagged"), (share > 0.3).alias("incomplete"))
