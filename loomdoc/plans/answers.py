"""Queries over answers of models, made up from numbers so that each kind of answer occurs; and pages made of spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..sources import files
from .adapters import read
from .registry import query


@query("s25_triads", """WITH e AS (SELECT event_id, event_id % 5 AS k, event_id % 14 - 2 AS r, (event_id % 90) / 8e0 AS g FROM events) SELECT event_id,
  CASE WHEN k = 4 THEN 0.65e0 ELSE least(greatest(r, 0), 10) / 10e0 END AS relevance, CASE WHEN k = 4 THEN 0.65e0 WHEN k = 3 THEN 0.6e0 ELSE least(greatest(floor(g), 0), 10) / 10e0 END AS groundedness,
  CASE WHEN k = 4 THEN 0.65e0 WHEN k >= 2 THEN 0.6e0 ELSE 0.5e0 END AS context_relevance, CASE WHEN k = 4 THEN 0.5e0 WHEN k = 3 THEN 0.5e0 ELSE least(greatest(g, 0), 10) / 10e0 END AS completeness, CASE WHEN k = 0 THEN 1.7e0 ELSE 0.5e0 END AS coverage FROM e""")
def s25_triads(spark, sf_dir):
    """Scores read from judges' answers: whole points, missing keys, fences, and answers without JSON."""
    k = F.col("event_id") % 5
    r, g = F.col("event_id") % 14 - 2, (F.col("event_id") % 90) / 8.0
    part = lambda name, value: F.concat(F.lit(f'"{name}": '), value.cast("string"))
    parts = F.array_compact(F.array(part("relevance", r), F.when(k < 3, part("groundedness", g)), F.when(k < 2, part("context_relevance", F.lit(5))), F.when(k < 3, part("completeness", g)), F.when(k == 0, part("coverage", F.lit(1.7)))))
    body = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    answer = F.when(k == 4, "I would say 8 of 10").when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return read(spark, sf_dir, "events").select("event_id", V.triad(answer).alias("t"), V.completeness(answer).alias("c")).select("event_id", "t.*", "c.*")


@query("s27_pairs", """WITH c AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations) SELECT conv_id, turn, CASE WHEN k = 4 THEN 0 WHEN k = 1 THEN 1 ELSE 2 END AS pairs, CASE WHEN k = 4 THEN NULL ELSE 'q' || turn END AS first FROM c""")
def s27_pairs(spark, sf_dir):
    """Pairs read from generators' answers: an object, a list, fenced, inside other words, or none."""
    k = F.col("conv_id") % 5
    one = F.concat(F.lit('{"q": "q'), "turn", F.lit('", "a": "yes", "intent": "fact", "more": 1}'))
    listed = F.concat(F.lit("["), one, F.when(k != 1, F.lit(', {"q": "other", "a": "no"}')).otherwise(F.lit("")), F.lit("]"))
    held = F.concat(F.lit('{"qa_list": '), listed, F.lit("}"))
    answer = F.when(k == 0, held).when(k == 1, listed).when(k == 2, F.concat(F.lit("```json\n"), held, F.lit("\n```"))).when(k == 3, F.concat(F.lit("Here they are: "), held, F.lit(" as asked."))).otherwise("none")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", V.qa_list(answer).alias("l"))
    return rows.select("conv_id", "turn", F.size("l").alias("pairs"), F.try_element_at("l", F.lit(1))["q"].alias("first"))


@query("a01_pages", """WITH s AS (SELECT l_orderkey AS d, l_linenumber % 3 + 1 AS page, l_linenumber, l_shipdate, (l_partkey % 19) * 5 AS y, l_suppkey % 7 * 60 AS x, 'w' || l_partkey AS t FROM lineitem WHERE l_orderkey % 5 = 0),
  k AS (SELECT * FROM s WHERE y >= 5 AND y + 2 <= 92 AND NOT ((x + x + 10) / 2e0 BETWEEN 0 AND 100 AND (y + y + 2) / 2e0 BETWEEN 40 AND 60)),
  g AS (SELECT *, x - lag(x + 10) OVER (PARTITION BY d, page, y ORDER BY x, t) AS gap FROM k), b AS (SELECT d, page, y, string_agg(CASE WHEN gap > 20 THEN ' | ' WHEN gap IS NOT NULL THEN ' ' ELSE '' END || t, '' ORDER BY x, t) AS line FROM g GROUP BY 1, 2, 3)
  SELECT d AS document_id, page, count(*) AS blocks, string_agg(line, chr(10) ORDER BY y) AS text FROM b GROUP BY 1, 2""")
def a01_pages(spark, sf_dir):
    """Pages put together from spans (made of line items): margins and a table's box left out, lines joined, wide gaps as bars, blocks that go on joined."""
    rows = read(spark, sf_dir, "lineitem").filter("l_orderkey % 5 = 0")
    y, x = ((F.col("l_partkey") % 19) * 5).cast("double"), (F.col("l_suppkey") % 7 * 60).cast("double")
    spans = rows.select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 3 + 1).alias("page"), F.lit(100.0).alias("height"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 2).alias("y1"), F.concat(F.lit("w"), "l_partkey").alias("text"), F.lit(10.0).alias("font_size"))
    tables = spans.select("document_id", "page").distinct().select("document_id", "page", F.lit(0.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(60.0).alias("y1"))
    pages = files.pdf_pages(spans, tables)
    return pages.select("document_id", "page", F.size("blocks").cast("bigint").alias("blocks"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))
