"""Queries over jobs, reports and maintenance: lookups, sorts and pages, previews, links, inspections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import verdicts as V
from ..functions import vector
from ..operators import evaluate as E
from ..operators import sampling
from ..operators import store as S
from .adapters import CHUNKS, QA, RESULTS, doc_chunks, qa_pairs, read, results
from .evaluation import scored
from .registry import query


@query("a05_upload_guard", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(text) < 300 OR length(text) / len(string_split(text, chr(10)))::DOUBLE < 5 ELSE length(text) < 100 END AS rejected FROM documents""")
def a05_upload_guard(spark, sf_dir):
    """Too little text: by characters and characters a block in PDF files (here the even documents), by characters in others."""
    n, b = F.length("text"), F.size(F.split("text", "\n", -1))
    rejected = F.when(F.col("doc_id") % 2 == 0, (n < 300) | (n / b < 5)).otherwise(n < 100)
    return read(spark, sf_dir, "documents").select("doc_id", rejected.alias("rejected"))


@query("a07_lookup", f"WITH {RESULTS} SELECT gen_id, source_doc, model, total_qa FROM gen WHERE gen_id = 33")
def a07_lookup(spark, sf_dir):
    """One row by its key: a filter that reaches the scan."""
    gen, _ = results(spark, sf_dir)
    return S.by_key(gen, "gen_id", 33).select("gen_id", "source_doc", "model", "total_qa")


@query("b07_saved_evaluations", f"""WITH {RESULTS}, new AS (SELECT k AS eval_id, CASE WHEN k % 3 = 0 THEN '  ' WHEN k % 3 = 1 THEN NULL ELSE ' g' || k || ' ' END AS generation_id FROM ord WHERE k % 5 = 0)
  SELECT eval_id, generation_id::VARCHAR AS generation_id FROM eva UNION ALL SELECT eval_id, CASE WHEN trim(generation_id) = '' THEN NULL ELSE generation_id END FROM new""")
def b07_saved_evaluations(spark, sf_dir):
    """Evaluations appended; a blank link is none."""
    _, eva = results(spark, sf_dir)
    k = F.col("o_orderkey")
    new = read(spark, sf_dir, "orders").filter(k % 5 == 0).select(k.alias("eval_id"), F.when(k % 3 == 0, "  ").when(k % 3 == 2, F.concat(F.lit(" g"), k, F.lit(" "))).alias("generation_id"))
    return eva.select("eval_id", F.col("generation_id").cast("string")).unionByName(S.without_blank(new, "generation_id"))


@query("b08_linked", f"""WITH {RESULTS}, link AS (SELECT generation_id AS gen_id, max(eval_id) AS eval_id FROM eva WHERE generation_id IS NOT NULL GROUP BY 1)
  SELECT g.gen_id, coalesce(l.eval_id, g.linked_evaluation_id) AS linked_evaluation_id FROM gen g LEFT JOIN link l ON l.gen_id = g.gen_id""")
def b08_linked(spark, sf_dir):
    """Generations linked to the evaluation that names them."""
    gen, eva = results(spark, sf_dir)
    links = eva.filter("generation_id is not null").groupBy(F.col("generation_id").alias("gen_id")).agg(F.max("eval_id").alias("linked_evaluation_id"))
    return S.patch(gen.select("gen_id", "linked_evaluation_id"), links, "gen_id", ["linked_evaluation_id"])


@query("b09_without_contents", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN repeat('1.1 part ...... 7' || chr(10), 12) ELSE text END AS t FROM documents), e AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM d)
  SELECT doc_id FROM e WHERE NOT (length(t) - length(replace(t, '·', '')) > 20 OR length(t) - length(replace(t, '.', '')) > 50 OR (len(l) > 0 AND len(list_filter(l, lambda x: (length(x) - length(replace(x, '·', '')) > 5 OR length(x) - length(replace(x, '.', '')) > 5) AND regexp_matches(rtrim(x), '[0-9]$'))) > 0.5e0 * len(l)))""")
def b09_without_contents(spark, sf_dir):
    """A table rewritten without its table-of-contents rows (every fourth text is made one)."""
    text = F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("1.1 part ...... 7\n"), F.lit(12))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("t")).filter(~T.is_contents_legacy(F.col("t"))).select("doc_id")


@query("b10_cleanup_plan", f"""WITH {RESULTS}, o AS (SELECT eval_id, (row_number() OVER (ORDER BY eval_id) - 1) // 100 AS batch FROM eva WHERE NOT EXISTS (SELECT 1 FROM gen WHERE linked_evaluation_id = eval_id) AND eval_id % 7 = 0)
  SELECT batch::BIGINT AS batch, count(*) AS n, 'DELETE FROM evaluations WHERE id IN (' || string_agg(eval_id::VARCHAR, ', ' ORDER BY eval_id) || ');' AS statement FROM o GROUP BY 1""")
def b10_cleanup_plan(spark, sf_dir):
    """Statements that delete unlinked evaluations, a hundred ids each."""
    gen, eva = results(spark, sf_dir)
    rows = eva.join(gen, eva["eval_id"] == gen["linked_evaluation_id"], "left_anti").filter("eval_id % 7 = 0")
    return S.delete_statements(rows, "eval_id", "evaluations", 100)


@query("b15_indexed_vectors", """SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 + 100 AS chunk_index, round(embedding[2]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS second FROM embeddings""")
def b15_indexed_vectors(spark, sf_dir):
    """Vectors of a batch, normalised, numbered from where the batch starts."""
    rows = S.numbered(read(spark, sf_dir, "embeddings"), "label", "vec_id", 100)
    return rows.select("vec_id", "chunk_index", F.round(F.element_at(vector.normalised(F.col("embedding")), 2), 5).alias("second"))


@query("f03_document_chunks", f"WITH {CHUNKS} SELECT id, chunk_index FROM doc_chunks WHERE filename = 'src3' AND document_id = 23 ORDER BY created_at, chunk_index LIMIT 5")
def f03_document_chunks(spark, sf_dir):
    return sampling.matching(doc_chunks(spark, sf_dir), {"filename": "src3", "document_id": 23}, "id").orderBy("created_at", "chunk_index").limit(5).select("id", "chunk_index")


@query("f10_anchors", rf"""WITH {CHUNKS}, v AS (SELECT filename, arg_max(document_id, created_at * 1000000 + document_id) AS document_id FROM doc_chunks GROUP BY filename), c AS (SELECT c.* FROM doc_chunks c JOIN v USING (filename, document_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY chunk_index) AS rn, greatest(count(*) OVER (PARTITION BY filename) // 40, 1) AS step FROM c), s AS (SELECT *, length(regexp_replace(content, '^\s+|\s+$', '', 'g')) < 400 AS admin FROM n WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 40),
  k AS (SELECT *, count(*) FILTER (NOT admin) OVER (PARTITION BY filename) >= 10 AS enough FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY rn) AS r FROM k WHERE NOT enough OR NOT admin),
  g AS (SELECT *, count(*) OVER (PARTITION BY filename) AS total FROM f WHERE r <= 30) SELECT filename, id, length(substr(content, 1, greatest(400, 20000 // total)::BIGINT)) AS chars FROM g""")
def f10_anchors(spark, sf_dir):
    """Anchor chunks of the latest version of each file: forty at even distances, without notices if ten are left, the first thirty, each cut to its share."""
    chunks = doc_chunks(spark, sf_dir)
    latest = S.latest(chunks, "filename", "created_at", "document_id")
    rows = chunks.join(latest, ["filename", "document_id"], "left_semi")
    return sampling.anchors(rows, "filename", "chunk_index", T.is_admin(F.col("content"))).select("filename", "id", F.length("cut").alias("chars"))


@query("f11_first_levels", f"""WITH {CHUNKS}, f AS (SELECT filename, h3, min(document_id * 100000 + chunk_index) AS first FROM doc_chunks GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY first) AS k FROM f)
  SELECT filename, string_agg(h3, ',' ORDER BY k) AS kept FROM r WHERE k <= 5 GROUP BY 1""")
def f11_first_levels(spark, sf_dir):
    """Levels of each file in order of their first chunk, five at most."""
    place = F.col("document_id") * 100000 + F.col("chunk_index")
    firsts = doc_chunks(spark, sf_dir).groupBy("filename", "h3").agg(F.min(place).alias("first"))
    levels = firsts.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("first", "h3"))).alias("all"))
    return levels.select("filename", F.array_join(F.transform(F.slice("all", 1, 5), lambda x: x["h3"]), ",").alias("kept"))


STATUS = "CASE WHEN g.gen_id % 5 = 0 THEN 'failed' WHEN g.linked_evaluation_id IS NULL THEN 'running' ELSE 'completed' END"


def _jobs(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    linked = eva.select(F.col("eval_id").alias("linked_evaluation_id"), F.col("final_grade").alias("eval_grade"))
    status = F.when(F.col("gen_id") % 5 == 0, "failed").when(F.col("linked_evaluation_id").isNull(), "running").otherwise("completed")
    return gen.withColumn("status", status).join(linked, "linked_evaluation_id", "left")


JOBS = f"{RESULTS}, jobs AS (SELECT g.*, {STATUS} AS status, e.final_grade AS eval_grade FROM gen g LEFT JOIN eva e ON e.eval_id = g.linked_evaluation_id)"


@query("f12_jobs_of_status", f"WITH {JOBS} SELECT gen_id, created_at FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, gen_id DESC LIMIT 20")
def f12_jobs_of_status(spark, sf_dir):
    return _jobs(spark, sf_dir).filter("status = 'completed'").orderBy(F.desc("created_at"), F.desc("gen_id")).limit(20).select("gen_id", "created_at")


@query("f13_items_of_status", f"""WITH {QA} SELECT qa_id FROM failed WHERE (avg_quality < 0.7e0 OR rag < 0.7e0 OR len(types) > 0) AND NOT (avg_quality < 0.7e0 AND rag < 0.7e0)""")
def f13_items_of_status(spark, sf_dir):
    """Items on hold."""
    return scored(spark, sf_dir).filter(E.status() == "hold").select("qa_id")


@query("j07_empty_documents", f"WITH {CHUNKS} SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM doc_chunks WHERE document_id = o_orderkey)")
def j07_empty_documents(spark, sf_dir):
    """Metadata (here of every third order) without any chunk."""
    meta = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("document_id"))
    return meta.join(doc_chunks(spark, sf_dir).select("document_id"), "document_id", "left_anti")


@query("g02_health_detail", f"""WITH {CHUNKS}, u AS (SELECT id, document_id, filename FROM doc_chunks WHERE h1 IS NULL) SELECT 'untagged' AS check_item, count(*) AS n, CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END AS status,
  (SELECT string_agg(f, ', ' ORDER BY f) FROM (SELECT DISTINCT filename AS f FROM u)) AS detail FROM u
  UNION ALL SELECT 'documents', count(DISTINCT document_id), 'OK', (SELECT string_agg(f, ', ' ORDER BY f) FROM (SELECT DISTINCT filename AS f FROM doc_chunks)) FROM doc_chunks""")
def g02_health_detail(spark, sf_dir):
    """Checks with the sorted names of the files that they concern; counted by file first."""
    files = doc_chunks(spark, sf_dir).groupBy("filename", "document_id").agg(F.count_if(F.col("h1").isNull()).alias("u"))
    one = files.agg(F.sum("u").alias("untagged"), F.count_distinct("document_id").alias("documents"), F.array_sort(F.collect_set(F.when(F.col("u") > 0, F.col("filename")))).alias("bad"), F.array_sort(F.collect_set("filename")).alias("all"))
    row = lambda c, status, names: F.struct(F.lit(c).alias("check_item"), F.col(c).alias("n"), status.alias("status"), F.array_join(names, ", ").alias("detail"))
    return one.select(F.inline(F.array(row("untagged", F.when(F.col("untagged") > 0, "WARN").otherwise("OK"), "bad"), row("documents", F.lit("OK"), "all"))))


@query("g03_tree_lists", f"""WITH {CHUNKS} SELECT h1, string_agg(DISTINCT h2, ',' ORDER BY h2) AS h2_list, count(DISTINCT h2) AS h2_total, count(DISTINCT h2 || '>' || h3) AS h3_total, count(*) AS chunks FROM doc_chunks WHERE h1 IS NOT NULL AND h1 <> '__admin__'
  AND document_id IN (SELECT conv_id FROM conversations) GROUP BY h1""")
def g03_tree_lists(spark, sf_dir):
    """Sorted second levels of each first level, with the sizes of the tree, of documents that have pairs."""
    asked = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id")).distinct()
    rows = doc_chunks(spark, sf_dir).filter("h1 is not null and h1 <> '__admin__'").join(asked, "document_id", "left_semi")
    leaves = rows.groupBy("h1", "h2", "h3").agg(F.count(F.lit(1)).alias("c"))
    tree = leaves.groupBy("h1").agg(F.array_sort(F.collect_set("h2")).alias("l"), F.count(F.lit(1)).alias("h3_total"), F.sum("c").alias("chunks"))
    return tree.select("h1", F.array_join("l", ",").alias("h2_list"), F.size("l").cast("bigint").alias("h2_total"), "h3_total", "chunks")


@query("g09_first_errors", f"""WITH {QA}, e AS (SELECT qa_id, array_to_string(list_filter([CASE WHEN length(q) < 5 THEN 'q too short' WHEN length(q) > 150 THEN 'q too long' END, CASE WHEN length(a) < 2 THEN 'a too short' WHEN length(a) > 2000 THEN 'a too long' END,
  CASE WHEN length(context) < 50 THEN 'context too short' WHEN length(context) > 50000 THEN 'context too long' END], lambda x: x IS NOT NULL), '; ') AS errors FROM qa) SELECT qa_id, errors, 'syntax_error' AS failure FROM e WHERE errors <> '' ORDER BY qa_id LIMIT 5""")
def g09_first_errors(spark, sf_dir):
    """The first five pairs with syntax errors (questions up to 150 characters here, so that some have), as rows of a preview."""
    rows = qa_pairs(spark, sf_dir).withColumn("e", E.syntax_errors(E.LENGTHS | {"q": (5, 150)})).filter(F.size("e") > 0)
    return rows.orderBy("qa_id").limit(5).select("qa_id", F.array_join("e", "; ").alias("errors"), F.lit("syntax_error").alias("failure"))


@query("g16_old_chunks", f"""WITH {CHUNKS}, d AS (SELECT filename, document_id, max(created_at) AS made, string_agg(id, ',' ORDER BY chunk_index) AS ids FROM doc_chunks GROUP BY 1, 2)
  SELECT filename, document_id, ids FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY made DESC, document_id DESC) AS r FROM d) WHERE r > 1""")
def g16_old_chunks(spark, sf_dir):
    """Chunk ids of each older version of a file."""
    chunks = doc_chunks(spark, sf_dir)
    old = chunks.join(S.latest(chunks, "filename", "created_at", "document_id"), ["filename", "document_id"], "left_anti")
    ids = old.groupBy("filename", "document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))).alias("l"))
    return ids.select("filename", "document_id", F.array_join(F.transform("l", lambda x: x["id"]), ",").alias("ids"))


@query("g17_metadata_inspection", """SELECT count(*) AS documents, count(*) FILTER (lang IS NULL) AS without_lang, count(DISTINCT source) AS files, count(*) FILTER (n_chars < 100) AS short, count(text) - count(DISTINCT text) AS repeated FROM documents""")
def g17_metadata_inspection(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("lang").isNull()).alias("without_lang"), F.count_distinct("source").alias("files"), F.count_if(F.col("n_chars") < 100).alias("short"), (F.count("text") - F.count_distinct("text")).alias("repeated"))


@query("g18_overview_parts", f"""WITH {RESULTS} SELECT 'grade' AS part, coalesce(final_grade, 'none') AS name, count(*)::DOUBLE AS value FROM eva GROUP BY 2
  UNION ALL SELECT 'latest', eval_id::VARCHAR, final_score FROM (SELECT * FROM eva ORDER BY created_at DESC, eval_id DESC LIMIT 5)""")
def g18_overview_parts(spark, sf_dir):
    """Histogram of grades and the five latest scores."""
    _, eva = results(spark, sf_dir)
    grades = eva.groupBy(F.coalesce("final_grade", F.lit("none")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("part", F.lit("grade"))
    latest = eva.orderBy(F.desc("created_at"), F.desc("eval_id")).limit(5).select(F.col("eval_id").cast("string").alias("name"), F.col("final_score").alias("value"), F.lit("latest").alias("part"))
    return grades.unionByName(latest)


@query("g20_success", f"""WITH {QA}, s AS (SELECT intent, count(*) AS n, count(*) FILTER (avg_quality >= 0.7e0 AND rag >= 0.7e0 AND len(types) = 0) AS success FROM failed GROUP BY intent) SELECT intent, n, success, round(100e0 * n / (SELECT sum(n) FROM s))::BIGINT AS pct FROM s""")
def g20_success(spark, sf_dir):
    """Items and successes of each intent, with the whole percent of all."""
    counts = scored(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if(E.status() == "success").alias("success"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("intent", "n", "success", F.round(100.0 * F.col("n") / F.col("t")).cast("bigint").alias("pct"))


@query("k04_runs", f"WITH {RESULTS} SELECT eval_id, final_score, to_timestamp(created_at)::DATE::VARCHAR AS day FROM (SELECT * FROM eva WHERE final_score IS NOT NULL ORDER BY created_at DESC, eval_id DESC LIMIT 30) ORDER BY created_at, eval_id")
def k04_runs(spark, sf_dir):
    """Scores of the thirty latest runs, oldest first; a point a run."""
    _, eva = results(spark, sf_dir)
    top = eva.filter("final_score is not null").orderBy(F.desc("created_at"), F.desc("eval_id")).limit(30)
    return top.orderBy("created_at", "eval_id").select("eval_id", "final_score", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd").alias("day"))


@query("k05_preview", """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, count(*) AS n FROM u GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY conv_id) - n AS before FROM c),
  t AS (SELECT sum(n)::BIGINT AS total FROM s WHERE before < 25), r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS k FROM u) SELECT k AS position, conv_id, substr(text, 1, 200) AS q, total FROM r, t WHERE k <= 25""")
def k05_preview(spark, sf_dir):
    """The first 25 pairs over all chunks in order; the total counts the chunks up to the one where the limit is reached."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    # the limit comes first: at most 25 chunks are needed, as each has a pair
    first = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).orderBy("conv_id").limit(25)
    visited = first.withColumn("before", F.sum("n").over(Window.orderBy("conv_id")) - F.col("n")).filter("before < 25")
    total = visited.agg(F.sum("n").alias("total"))
    rows = turns.join(visited.select("conv_id"), "conv_id", "left_semi").orderBy("conv_id", "turn").limit(25)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("conv_id", "turn")).cast("bigint"))
    return rows.crossJoin(F.broadcast(total)).select("position", "conv_id", F.substring("text", 1, 200).alias("q"), "total")


def _keys() -> dict:
    text = lambda c: F.coalesce(c, F.lit(""))
    return {"id": F.col("qa_id"), "intent": text(F.col("intent")), "q": text(F.col("q")), "a": text(F.col("a")), "quality": F.coalesce("avg_quality", F.lit(-1.0)), "triad": F.coalesce("rag", F.lit(-1.0)), "status": E.status(), "failure": text(F.col("primary_failure"))}


@query("k06_sorted_by_all_keys", " UNION ALL ".join(f"SELECT * FROM (WITH {QA}, p AS (SELECT *, CASE WHEN avg_quality < 0.7e0 AND rag < 0.7e0 THEN 'fail' WHEN avg_quality < 0.7e0 OR rag < 0.7e0 OR len(types) > 0 THEN 'hold' ELSE 'success' END AS status, CASE WHEN list_contains(types, 'hallucination') THEN 'hallucination' WHEN list_contains(types, 'faithfulness_error') THEN 'faithfulness_error' WHEN list_contains(types, 'retrieval_miss') THEN 'retrieval_miss' WHEN list_contains(types, 'bad_chunk') THEN 'bad_chunk' WHEN list_contains(types, 'low_quality') THEN 'low_quality' ELSE coalesce(types[1], '') END AS pf FROM failed) SELECT '{k}' AS sort_key, qa_id FROM p ORDER BY {e} {d}, qa_id LIMIT 5)" for k, e, d in [("id", "qa_id", "DESC"), ("intent", "intent", "ASC"), ("q", "q", "ASC"), ("a", "a", "DESC"), ("quality", "coalesce(avg_quality, -1)", "DESC"), ("triad", "coalesce(rag, -1)", "ASC"), ("status", "status", "ASC"), ("failure", "pf", "DESC")]))
def k06_sorted_by_all_keys(spark, sf_dir):
    """The first page of the item table under each of its eight sort keys."""
    rows, keys = scored(spark, sf_dir), _keys()
    pages = [rows.orderBy(keys[k].desc() if down else keys[k].asc(), "qa_id").limit(5).select(F.lit(k).alias("sort_key"), "qa_id") for k, down in [("id", True), ("intent", False), ("q", False), ("a", True), ("quality", True), ("triad", False), ("status", False), ("failure", True)]]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@query("k07_pages", f"WITH {QA} SELECT intent, count(*) AS n, greatest(1, ceil(count(*) / 5e0))::BIGINT AS pages FROM failed GROUP BY intent")
def k07_pages(spark, sf_dir):
    """Pages of five items, one at least."""
    n = F.count(F.lit(1))
    return scored(spark, sf_dir).groupBy("intent").agg(n.alias("n"), F.greatest(F.lit(1), F.ceil(n / 5)).cast("bigint").alias("pages"))


@query("k08_sorted_jobs", f"""WITH {JOBS}, g AS (SELECT *, coalesce(CASE eval_grade WHEN 'A+' THEN 6 WHEN 'A' THEN 5 WHEN 'B+' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'F' THEN 1 END, 0) AS rank FROM jobs)
  SELECT * FROM (SELECT 'grade' AS sort_key, gen_id, rank FROM g ORDER BY rank DESC, gen_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'model', gen_id, rank FROM g ORDER BY lower(coalesce(model, '')), gen_id LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'total_qa', gen_id, rank FROM g ORDER BY coalesce(total_qa, 0) DESC, gen_id LIMIT 5 OFFSET 5)""")
def k08_sorted_jobs(spark, sf_dir):
    """Jobs by the rank of their grade, by model without case, and the second page by size."""
    rows = _jobs(spark, sf_dir).withColumn("rank", F.coalesce(R.lookup(F.col("eval_grade"), R.GRADE_RANKS), F.lit(0)))
    page = lambda name, *keys, skip=0: rows.orderBy(*keys, "gen_id").offset(skip).limit(5).select(F.lit(name).alias("sort_key"), "gen_id", "rank")
    return page("grade", F.desc("rank")).unionByName(page("model", F.lower(F.coalesce("model", F.lit(""))))).unionByName(page("total_qa", F.coalesce("total_qa", F.lit(0)).desc(), skip=5))


@query("k09_sorted_by_status", f"""WITH {QA}, s AS (SELECT qa_id, CASE WHEN avg_quality < 0.7e0 AND rag < 0.7e0 THEN 2 WHEN avg_quality < 0.7e0 OR rag < 0.7e0 OR len(types) > 0 THEN 1 ELSE 0 END AS o FROM failed) SELECT qa_id, o::INT AS status_order FROM s ORDER BY o DESC, qa_id LIMIT 10""")
def k09_sorted_by_status(spark, sf_dir):
    """Items of a report by state: success, hold, fail, here the last first."""
    order = R.lookup(E.status(), {"success": 0, "hold": 1, "fail": 2})
    return scored(spark, sf_dir).select("qa_id", F.coalesce(order, F.lit(9)).alias("status_order")).orderBy(F.desc("status_order"), "qa_id").limit(10)


@query("k11_renumbered", f"""WITH {CHUNKS} SELECT document_id, chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY (7 - chunk_index % 3), chunk_index) - 1 AS position FROM doc_chunks""")
def k11_renumbered(spark, sf_dir):
    """Chunks of batches that came out of order, sorted by batch and numbered anew."""
    rows = doc_chunks(spark, sf_dir).select("document_id", "chunk_index", (7 - F.col("chunk_index") % 3).alias("batch"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("batch", "chunk_index")) - 1
    return rows.select("document_id", "chunk_index", number.cast("bigint").alias("position"))


@query("k12_capped_pairs", """WITH q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM q WHERE k <= 2""")
def k12_capped_pairs(spark, sf_dir):
    """The first two questions of each chunk (the cap is what the operator is for)."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("l"))
    return turns.select("conv_id", F.explode(F.slice("l", 1, 2)).alias("turn"))


@query("k13_session_jobs", f"WITH {JOBS} SELECT gen_id, status FROM jobs WHERE model = '1-URGENT' ORDER BY created_at DESC, gen_id DESC LIMIT 50")
def k13_session_jobs(spark, sf_dir):
    """Jobs of a session (here of one model), newest first."""
    return _jobs(spark, sf_dir).filter("model = '1-URGENT'").orderBy(F.desc("created_at"), F.desc("gen_id")).limit(50).select("gen_id", "status")


@query("s30_cuts", """SELECT doc_id, md5(substr(text, 1, 800)) AS tagging, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS sample, md5(substr(text, 1, 400)) AS anchor, md5(substr(text, 1, 1500)) AS prompt, length(substr(text, 1, 10000)) AS context, md5(substr(text, 1, 1000)) AS shown FROM documents""")
def s30_cuts(spark, sf_dir):
    """The cuts of texts for prompts and previews, in characters."""
    cut = lambda n: F.substring("text", 1, n)
    sample = F.when(F.length("text") > 150, F.concat(cut(150), F.lit("..."))).otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(cut(800)).alias("tagging"), sample.alias("sample"), F.md5(cut(400)).alias("anchor"), F.md5(cut(1500)).alias("prompt"), F.length(cut(10000)).alias("context"), F.md5(cut(1000)).alias("shown"))


@query("s32_costs", f"""WITH {RESULTS}, p(model, i, o) AS (VALUES ('1-URGENT', 3.01e0, 15.07e0), ('2-HIGH', 0.37e0, 2.93e0)) SELECT gen_id, round((tokens_in * coalesce(i, 0) + tokens_out * coalesce(o, 0)) / 1e6, 4) AS cost FROM gen LEFT JOIN p USING (model)""")
def s32_costs(spark, sf_dir):
    """Costs of generations by a table of prices; unknown models cost nothing."""
    gen, _ = results(spark, sf_dir)
    prices = spark.createDataFrame([("1-URGENT", 3.01, 15.07), ("2-HIGH", 0.37, 2.93)], "model string, price_in double, price_out double")
    price = lambda c: F.coalesce(c, F.lit(0.0))
    return gen.join(F.broadcast(prices), "model", "left").select("gen_id", T.cost(F.col("tokens_in"), F.col("tokens_out"), price("price_in"), price("price_out")).alias("cost"))


@query("s33_routes", """WITH e AS (SELECT event_id, ['claude-x', 'Gemini-y', 'other-z'][event_id % 3 + 1] AS model, event_id % 700 AS blocks FROM events) SELECT event_id, CASE WHEN contains(lower(model), 'claude') THEN 'anthropic' WHEN contains(lower(model), 'gemini') THEN 'google' ELSE 'openai' END AS provider,
  CASE WHEN contains(lower(model), 'claude') THEN 2 ELSE 5 END AS generation_workers, CASE WHEN contains(lower(model), 'claude') THEN 2 WHEN contains(lower(model), 'gemini') THEN 10 ELSE 8 END AS evaluation_workers,
  CASE WHEN blocks <= 60 THEN 1 WHEN blocks <= 150 THEN 2 WHEN blocks <= 300 THEN 3 ELSE 4 END AS tier_by_blocks, CASE WHEN blocks <= 20 THEN 1 WHEN blocks <= 50 THEN 2 WHEN blocks <= 100 THEN 3 WHEN blocks <= 200 THEN 4 ELSE 5 END AS tier_by_pages FROM e""")
def s33_routes(spark, sf_dir):
    """Providers, workers and tiers by model names and sizes."""
    model = F.element_at(F.array(*[F.lit(x) for x in ("claude-x", "Gemini-y", "other-z")]), (F.col("event_id") % 3 + 1).cast("int"))
    blocks = F.col("event_id") % 700
    rows = read(spark, sf_dir, "events").withColumn("provider", V.provider(model))
    return rows.select("event_id", "provider", V.workers(F.col("provider"), "generation").alias("generation_workers"), V.workers(F.col("provider"), "evaluation").alias("evaluation_workers"), V.chunking_tier_of_blocks(blocks).alias("tier_by_blocks"), V.chunking_tier(blocks).alias("tier_by_pages"))


@query("s39_times", """WITH e AS (SELECT event_id, ts, date_diff('second', ts, (SELECT max(ts) FROM events)) AS age FROM events) SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local_time, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN (age // 60) || ' min' WHEN age < 86400 THEN (age // 3600) || ' h' ELSE (age // 86400) || ' d' END AS ago FROM e""")
def s39_times(spark, sf_dir):
    """Times in Korean local time, days, and ages against the latest event."""
    events = read(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    age = F.unix_timestamp("last") - F.unix_timestamp("ts")
    ago = F.when(age < 60, "just now").when(age < 3600, F.concat(F.floor(age / 60), F.lit(" min"))).when(age < 86400, F.concat(F.floor(age / 3600), F.lit(" h"))).otherwise(F.concat(F.floor(age / 86400), F.lit(" d")))
    local = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul"), "yyyy-MM-dd HH:mm")
    return events.crossJoin(F.broadcast(last)).select("event_id", local.alias("local_time"), F.date_format("ts", "yyyy-MM-dd").alias("day"), ago.alias("ago"))


@query("q04_error_rows", f"""WITH {QA}, j AS (SELECT *, qa_id % 7 = 0 AS broken, qa_id % 5 = 0 AS absent FROM scored) SELECT qa_id, CASE WHEN broken THEN 0.65e0 WHEN absent THEN 0.5e0 ELSE avg_quality END AS avg_quality,
  CASE WHEN broken THEN false WHEN absent THEN false ELSE avg_quality >= 0.7e0 END AS passed, CASE WHEN broken OR absent THEN 0.65e0 ELSE relevance END AS relevance FROM j""")
def q04_error_rows(spark, sf_dir):
    """Scores where the judge failed (every seventh item) or is missing (every fifth): the constants for each."""
    rows = scored(spark, sf_dir)
    return E.with_judge_errors(rows, F.col("qa_id") % 7 == 0, F.col("qa_id") % 5 == 0).select("qa_id", "avg_quality", "passed", "relevance")


@query("q10_passes", f"""WITH {QA} SELECT qa_id, coalesce(avg_quality >= 0.7e0, false) AND NOT hallucination AND NOT faithfulness_error AS export_pass, avg_quality >= 0.7e0 AND len(types) = 0 AS preview_pass, round((rag + avg_quality) / 2, 5) AS panel_score, (rag + avg_quality) / 2 >= 0.7e0 AS panel_ok FROM failed""")
def q10_passes(spark, sf_dir):
    """The two kinds of pass of an item, and the panel's score."""
    panel = (F.col("rag") + F.col("avg_quality")) / 2
    return scored(spark, sf_dir).select("qa_id", F.col("pass").alias("export_pass"), (F.col("pass") & (F.size("types") == 0)).alias("preview_pass"), F.round(panel, 5).alias("panel_score"), (panel >= 0.7).alias("panel_ok"))


@query("p08_exports", f"""WITH {QA}, s AS (SELECT *, CASE WHEN avg_quality < 0.7e0 AND rag < 0.7e0 THEN '실패' WHEN avg_quality < 0.7e0 OR rag < 0.7e0 OR len(types) > 0 THEN '보류' ELSE '성공' END AS state FROM failed)
  SELECT qa_id, 'html' AS format, state AS status, replace(replace(replace(replace(substr(q, 1, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS q, row_number() OVER (ORDER BY qa_id) AS number FROM s UNION ALL
  SELECT qa_id, 'sheet', state, substr(q, 1, 300), row_number() OVER (ORDER BY qa_id) FROM s UNION ALL SELECT qa_id, 'json', CASE state WHEN '성공' THEN 'success' WHEN '보류' THEN 'hold' ELSE 'fail' END, q, row_number() OVER (ORDER BY qa_id) FROM s""")
def p08_exports(spark, sf_dir):
    """Rows of the three exports, numbered from 1 (numbers by partition counts, not by one sorted task)."""
    rows = S.positions(scored(spark, sf_dir).withColumn("state", E.status()).select("qa_id", "q", "state"), "qa_id")
    label, q = R.label(F.col("state"), R.STATUS_LABELS), F.substring("q", 1, 300)
    kind = lambda name, status, text: F.struct(F.lit(name).alias("format"), status.alias("status"), text.alias("q"))
    return rows.select("qa_id", "number", F.inline(F.array(kind("html", label, R.escaped(q)), kind("sheet", label, q), kind("json", F.col("state"), F.col("q")))))


@query("r05_page_headers", r"""WITH l AS (SELECT DISTINCT doc_id, source, trim(u) AS line FROM (SELECT doc_id, source, unnest(string_split('Page header of ' || source || chr(10) || text, chr(10))) AS u FROM documents))
  SELECT source, line, count(*) AS pages FROM l WHERE length(line) > 5 AND NOT regexp_matches(line, '^[|\-: ]+$') GROUP BY 1, 2 HAVING count(*) >= 5""")
def r05_page_headers(spark, sf_dir):
    """Lines on five pages of a file and more, each page being given a header."""
    from ..operators import blocks

    pages = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Page header of "), "source", F.lit("\n"), "text").alias("text"))
    return blocks.repeated_lines(pages, "source", "doc_id", "text", 5)


@query("w01_latest_stride", f"""WITH {CHUNKS}, v AS (SELECT filename, arg_max(document_id, created_at * 1000000 + document_id) AS document_id FROM doc_chunks GROUP BY filename), c AS (SELECT c.* FROM doc_chunks c JOIN v USING (filename, document_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY chunk_index) AS rn, greatest(count(*) OVER (PARTITION BY filename) // 3, 1) AS step FROM c) SELECT filename, id, rn FROM n WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 3""")
def w01_latest_stride(spark, sf_dir):
    """Three chunks at even distances of the latest version of each file."""
    chunks = doc_chunks(spark, sf_dir)
    rows = chunks.join(S.latest(chunks, "filename", "created_at", "document_id"), ["filename", "document_id"], "left_semi")
    return sampling.stride(rows, "filename", "chunk_index", 3).select("filename", "id", "rn")
