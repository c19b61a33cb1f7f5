"""Queries of layer summaries with gaps, containment filters, previews, sheets, fills and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verdicts as V
from ..operators import blocks, evaluate, export, sampling
from ..operators import store as S
from ..operators.cells import patched
from .adapters import CHUNKS, QA, doc_chunks, qa_pairs, read
from .evaluation import scored
from .registry import query


@query("g08_layer_summary", f"""WITH {QA}, g AS (SELECT *, CASE WHEN qa_id % 4 = 0 THEN NULL ELSE relevance END AS r, CASE WHEN qa_id % 3 = 0 THEN NULL ELSE avg_quality END AS c FROM scored)
  SELECT count(*) AS evaluated, round(avg(coalesce(r, 0.65e0)), 5) AS avg_relevance, round(avg(groundedness), 5) AS avg_groundedness, round(avg(c), 5) AS avg_completeness, count(c) AS with_completeness,
    round(100e0 * count(*) FILTER (c >= 0.7e0) / count(*), 2) AS pass_rate FROM g""")
def g08_layer_summary(spark, sf_dir):
    """Means of the layers where scores are missing: 0.65 for one of the triad; rows without completeness don't count for its mean."""
    k = F.col("qa_id")
    rows = scored(spark, sf_dir).withColumn("relevance", F.when(k % 4 != 0, F.col("relevance"))).withColumn("completeness", F.when(k % 3 != 0, F.col("avg_quality")))
    return evaluate.layer_summary(rows)


@query("f04_contained", """SELECT event_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k')::BIGINT = 3""")
def f04_contained(spark, sf_dir):
    """Rows whose JSON contains the given keys and values."""
    return sampling.containing(read(spark, sf_dir, "events"), "props", {"k": 3}).filter("event_type = 'click'").select("event_id")


@query("f08_after_sample", f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at, chunk_index, id) AS rn, greatest(count(*) OVER (PARTITION BY filename) // 20, 1) AS step FROM doc_chunks)
  SELECT id, filename FROM n WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 20 AND h1 = 'en' AND h3 IN ('t1', 't2')""")
def f08_after_sample(spark, sf_dir):
    """Twenty chunks of each file at even distances, of which those of a level stay: the filter comes after the sample."""
    chunks = doc_chunks(spark, sf_dir)
    place = F.struct("created_at", "chunk_index", "id")
    sample = sampling.stride(chunks.withColumn("place", place), "filename", "place", 20)
    return sampling.matching(sample, {"h1": "en"}, "id").filter(F.col("h3").isin("t1", "t2")).select("id", "filename")


@query("p02_preview", f"""WITH {QA} SELECT qa.qa_id, qa.intent, substr(qa.q, 1, 300) AS q, substr(qa.a, 1, 500) AS a, substr(qa.context, 1, 1000) AS context, f.rag AS triad_avg, f.avg_quality AS l2_avg,
  coalesce(f.avg_quality >= 0.7e0 AND NOT f.hallucination AND NOT f.faithfulness_error AND len(f.types) = 0, false) AS pass, CASE WHEN f.qa_id IS NULL THEN ['syntax_error'] ELSE f.types END::VARCHAR AS failures FROM qa LEFT JOIN failed f ON f.qa_id = qa.qa_id""")
def p02_preview(spark, sf_dir):
    """The wide preview of all pairs; those with syntax errors without scores."""
    rows = qa_pairs(spark, sf_dir).withColumn("ok", F.size(evaluate.syntax_errors()) == 0).withColumn("types", evaluate.failure_types())
    own = lambda c: F.when(F.col("ok"), c)
    good = F.coalesce(own(evaluate.passes(F.col("types")) & (F.size("types") == 0)), F.lit(False))
    types = F.when(F.col("ok"), F.col("types")).otherwise(F.array(F.lit("syntax_error")))
    return rows.select("qa_id", "intent", F.substring("q", 1, 300).alias("q"), F.substring("a", 1, 500).alias("a"), F.substring("context", 1, 1000).alias("context"), own(evaluate.triad_average()).alias("triad_avg"), own(F.col("avg_quality")).alias("l2_avg"), good.alias("pass"), F.concat(F.lit("["), F.array_join(types, ", "), F.lit("]")).alias("failures"))


@query("b11_sheet", f"""WITH {QA}, t AS (SELECT 'relevance' AS metric, relevance AS v FROM scored UNION ALL SELECT 'groundedness', groundedness FROM scored UNION ALL SELECT 'rag', rag FROM scored)
  SELECT metric, round(avg(v), 3) AS mean, min(v) AS lowest, max(v) AS highest FROM t GROUP BY metric""")
def b11_sheet(spark, sf_dir):
    """The statistics sheet of the export."""
    return export.statistics(scored(spark, sf_dir), ["relevance", "groundedness", "rag"])


@query("w05_filled", """WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 1 THEN event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events)
  SELECT user_id, event_id, last_value(kind IGNORE NULLS) OVER w AS kind, last_value(value IGNORE NULLS) OVER w AS value FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def w05_filled(spark, sf_dir):
    """Empty cells filled from above, column by column, within each table (here a user's events)."""
    n = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(n % 3 == 1, F.col("event_type")).alias("kind"), F.when(n % 2 == 0, F.col("value")).alias("value"))
    return blocks.filled(rows, "user_id", "event_id", ["kind", "value"])


@query("w08_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey % 3 <> 1")
def w08_numbers(spark, sf_dir):
    """Rows of a whole table numbered from 1; no task sees all of them."""
    return S.positions(read(spark, sf_dir, "orders").filter("o_orderkey % 3 != 1").select("o_orderkey"), "o_orderkey")


@query("s17_patched_cells", """WITH w AS (SELECT l_suppkey AS page, l_orderkey, l_linenumber, l_partkey % 480 AS x0, l_orderkey * 7 % 580 AS y0, 'w' || l_partkey AS word, length('w' || l_partkey) AS n FROM lineitem),
  c AS (SELECT s_suppkey AS page, r, c, c * 125 AS x0, r * 100 AS y0, c * 125 + 120 AS x1, r * 100 + 60 + s_suppkey % 40 AS y1, CASE WHEN (s_suppkey + r + c) % 3 = 0 THEN 'cell ' || r ELSE NULL END AS text
    FROM supplier, range(6) a(r), range(4) b(c)),
  f AS (SELECT c.page, r, c, string_agg(word, ' ' ORDER BY l_orderkey, l_linenumber, word) AS found FROM c JOIN w ON c.page = w.page AND c.text IS NULL AND w.x0 BETWEEN c.x0 - 2 AND c.x1 + 2 AND w.x0 + 6 * n BETWEEN c.x0 - 2 AND c.x1 + 2 AND w.y0 BETWEEN c.y0 - 2 AND c.y1 + 2 AND w.y0 + 10 BETWEEN c.y0 - 2 AND c.y1 + 2 GROUP BY ALL)
  SELECT c.page, c.r::INT AS row, c.c::INT AS col, coalesce(text, found) AS text FROM c LEFT JOIN f ON c.page = f.page AND c.r = f.r AND c.c = f.c""")
def s17_patched_cells(spark, sf_dir):
    """Cells without a text of a table on each supplier's page, filled with the words whose boxes lie in them."""
    words = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 480).alias("x0"), (F.col("l_orderkey") * 7 % 580).alias("y0"), F.concat(F.lit("w"), "l_partkey").alias("word"))
    words = words.withColumn("x1", F.col("x0") + 6 * F.length("word")).withColumn("y1", F.col("y0") + 10)
    cells = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3))))
    text = F.when((F.col("page") + F.col("row") + F.col("col")) % 3 == 0, F.concat(F.lit("cell "), "row"))
    cells = cells.select("page", "row", "col", (F.col("col") * 125).alias("x0"), (F.col("row") * 100).alias("y0"), (F.col("col") * 125 + 120).alias("x1"), (F.col("row") * 100 + 60 + F.col("page") % 40).alias("y1"), text.alias("text"))
    return patched(cells, words, "page", ["row", "col"], ["l_orderkey", "l_linenumber"]).select("page", "row", "col", "text")


@query("s17_tables", r"""WITH r AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, trim(n_name) AS a, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'x' || n_nationkey END AS b FROM nation),
  f AS (SELECT k, i, a, CASE WHEN b = '' AND i > 1 THEN coalesce(last_value(CASE WHEN i > 1 THEN nullif(b, '') END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), '') ELSE b END AS b FROM r)
  SELECT k::BIGINT AS n_regionkey, '[표]' || chr(10) || string_agg('| ' || a || ' | ' || b || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY i) AS text FROM f GROUP BY k""")
def s17_tables(spark, sf_dir):
    """Tables as Markdown, with empty cells filled from above."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("n_regionkey"), "n_nationkey", F.array(F.concat(F.lit(" "), "n_name", F.lit("  ")), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("x"), "n_nationkey"))).alias("cells"))
    tables = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "cells"))).alias("rows"))
    lines = tables.select("n_regionkey", F.transform("rows", lambda r: F.to_json(r["cells"])).alias("rows"))
    return blocks.folded(lines, "n_regionkey", "rows", blocks.table_of_json, "text string")


@query("s11_footers", r"""WITH d AS (SELECT doc_id, '17' || chr(10) || text || chr(10) || ' Page foot ' AS t FROM documents) SELECT doc_id, md5(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[0-9]{1,3}$')
  AND regexp_replace(x, '^\s+|\s+$', '', 'g') <> 'Page foot'), chr(10))) AS cleaned FROM d""")
def s11_footers(spark, sf_dir):
    """Page numbers and a repeated line taken out of texts that are given both."""
    text = F.concat(F.lit("17\n"), "text", F.lit("\n Page foot "))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_footers(text, F.array(F.lit("Page foot")))).alias("cleaned"))


@query("s36_tiers", "SELECT o_orderkey, CASE WHEN o_custkey <= 20 THEN 1 WHEN o_custkey <= 50 THEN 2 WHEN o_custkey <= 100 THEN 3 WHEN o_custkey <= 200 THEN 4 ELSE 5 END AS by_pages, CASE WHEN o_custkey <= 60 THEN 1 WHEN o_custkey <= 150 THEN 2 WHEN o_custkey <= 300 THEN 3 ELSE 4 END AS by_blocks FROM orders")
def s36_tiers(spark, sf_dir):
    n = F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.chunking_tier(n).alias("by_pages"), V.chunking_tier_of_blocks(n).alias("by_blocks"))
