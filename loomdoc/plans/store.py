"""Queries over stored results: dashboard, history, links between tables, and integrity."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import store as S
from .adapters import CHUNKS, RESULTS, doc_chunks, read, results
from .registry import query


@query("j01_eval_view", f"WITH {RESULTS} SELECT g.gen_id, e.eval_id, e.created_at, e.final_score, e.final_grade FROM eva e JOIN gen g ON g.linked_evaluation_id = e.eval_id")
def j01_eval_view(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    return gen.join(eva, gen["linked_evaluation_id"] == eva["eval_id"]).select("gen_id", "eval_id", eva["created_at"], "final_score", "final_grade")


@query("j02_recent_jobs", f"""WITH {RESULTS} SELECT g.gen_id, g.created_at, CASE WHEN g.linked_evaluation_id IS NOT NULL THEN e1.final_grade ELSE e2.final_grade END AS final_grade
  FROM (SELECT * FROM gen ORDER BY created_at DESC, gen_id DESC LIMIT 10) g LEFT JOIN eva e1 ON e1.eval_id = g.linked_evaluation_id LEFT JOIN eva e2 ON e2.generation_id = g.gen_id""")
def j02_recent_jobs(spark, sf_dir):
    """The ten latest generations with the grade of the linked evaluation; without a link, of the one that names the generation.
    A dangling link does not fall back."""
    gen, eva = results(spark, sf_dir)
    top = gen.orderBy(F.desc("created_at"), F.desc("gen_id")).limit(10).select("gen_id", "created_at", "linked_evaluation_id")
    linked = eva.select(F.col("eval_id").alias("linked_evaluation_id"), F.col("final_grade").alias("g1"))
    named = eva.filter("generation_id is not null").groupBy(F.col("generation_id").alias("gen_id")).agg(F.max_by("final_grade", "eval_id").alias("g2"))
    out = top.join(linked, "linked_evaluation_id", "left").join(named, "gen_id", "left")
    return out.select("gen_id", "created_at", F.when(F.col("linked_evaluation_id").isNotNull(), F.col("g1")).otherwise(F.col("g2")).alias("final_grade"))


@query("j03_history", f"""WITH {RESULTS}, h AS (SELECT * FROM eva ORDER BY created_at DESC, eval_id DESC LIMIT 50)
  SELECT h.eval_id, h.created_at, h.final_score, coalesce(nullif(h.source_doc, ''), g1.source_doc, g2.source_doc) AS source_doc FROM h
  LEFT JOIN gen g1 ON g1.linked_evaluation_id = h.eval_id LEFT JOIN gen g2 ON g2.gen_id = h.generation_id""")
def j03_history(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    top = eva.orderBy(F.desc("created_at"), F.desc("eval_id")).limit(50)
    g1 = gen.select(F.col("linked_evaluation_id").alias("eval_id"), F.col("source_doc").alias("s1")).filter("eval_id is not null")
    g2 = gen.select(F.col("gen_id").alias("generation_id"), F.col("source_doc").alias("s2"))
    out = top.join(g1, "eval_id", "left").join(g2, "generation_id", "left")
    return out.select("eval_id", "created_at", "final_score", F.coalesce(F.nullif("source_doc", F.lit("")), "s1", "s2").alias("source_doc"))


@query("j08_unlinked_evaluations", f"WITH {RESULTS} SELECT eval_id FROM eva WHERE NOT EXISTS (SELECT 1 FROM gen WHERE linked_evaluation_id = eval_id)")
def j08_unlinked_evaluations(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    return eva.join(gen, eva["eval_id"] == gen["linked_evaluation_id"], "left_anti").select("eval_id")


@query("j09_id_differences", f"""WITH {RESULTS} SELECT coalesce(e.eval_id, g.gen_id) AS id, CASE WHEN e.eval_id IS NULL THEN 'generation only' ELSE 'evaluation only' END AS side
  FROM eva e FULL JOIN gen g ON g.gen_id = e.eval_id WHERE e.eval_id IS NULL OR g.gen_id IS NULL""")
def j09_id_differences(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    both = eva.select("eval_id").join(gen.select("gen_id"), F.col("eval_id") == F.col("gen_id"), "full")
    return both.filter("eval_id is null or gen_id is null").select(F.coalesce("eval_id", "gen_id").alias("id"), F.when(F.col("eval_id").isNull(), "generation only").otherwise("evaluation only").alias("side"))


@query("j10_backfillable", f"WITH {RESULTS} SELECT eval_id, eval_id IN (SELECT linked_evaluation_id FROM gen WHERE linked_evaluation_id IS NOT NULL) AS backfillable FROM eva WHERE generation_id IS NULL")
def j10_backfillable(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    linked = gen.filter("linked_evaluation_id is not null").select(F.col("linked_evaluation_id").alias("eval_id")).distinct().withColumn("hit", F.lit(True))
    return eva.filter("generation_id is null").select("eval_id").join(linked, "eval_id", "left").select("eval_id", F.coalesce("hit", F.lit(False)).alias("backfillable"))


@query("g04_dashboard", f"""WITH {RESULTS} SELECT sum(total_qa)::BIGINT AS total_qa, round(avg(final_score), 3) AS avg_score, round(100e0 * count(*) FILTER (final_grade IN ('A', 'A+')) / count(*), 1) AS top_grade_pct,
  count(DISTINCT nullif(source_doc, '')) AS documents, count(*) AS runs FROM eva""")
def g04_dashboard(spark, sf_dir):
    _, eva = results(spark, sf_dir)
    return eva.agg(F.coalesce(F.sum("total_qa"), F.lit(0)).alias("total_qa"), F.coalesce(F.round(F.avg("final_score"), 3), F.lit(0.0)).alias("avg_score"), F.coalesce(F.round(F.try_divide(100.0 * F.count_if(F.col("final_grade").isin("A", "A+")), F.count(F.lit(1))), 1), F.lit(0.0)).alias("top_grade_pct"), F.count_distinct(F.nullif("source_doc", F.lit(""))).alias("documents"), F.count(F.lit(1)).alias("runs"))


@query("g05_grades", f"WITH {RESULTS} SELECT g.grade, count(e.eval_id) AS n FROM (VALUES ('A+'), ('A'), ('B+'), ('B'), ('C'), ('F')) g(grade) LEFT JOIN eva e ON e.final_grade = g.grade GROUP BY g.grade")
def g05_grades(spark, sf_dir):
    """All six grades, with zero where none was given; other grades don't count."""
    _, eva = results(spark, sf_dir)
    counts = eva.groupBy("final_grade").agg(F.count(F.lit(1)).alias("c"))
    grades = spark.createDataFrame([(g,) for g in ("A+", "A", "B+", "B", "C", "F")], "grade string")
    return grades.join(counts, grades["grade"] == counts["final_grade"], "left").select("grade", F.coalesce("c", F.lit(0)).alias("n"))


@query("g06_models", f"""WITH {RESULTS}, x AS (SELECT coalesce(e.model, g.model) AS model, e.* EXCLUDE (model) FROM eva e LEFT JOIN gen g ON g.linked_evaluation_id = e.eval_id)
  SELECT model, round(avg(final_score), 3) AS avg_score, round(100e0 * sum(valid_qa) / sum(total_qa), 1) AS valid_pct, count(*) AS runs FROM x WHERE model IS NOT NULL GROUP BY model""")
def g06_models(spark, sf_dir):
    gen, eva = results(spark, sf_dir)
    own = gen.filter("linked_evaluation_id is not null").select(F.col("linked_evaluation_id").alias("eval_id"), F.col("model").alias("gen_model"))
    rows = eva.join(own, "eval_id", "left").withColumn("model", F.coalesce("model", "gen_model")).filter("model is not null")
    return rows.groupBy("model").agg(F.round(F.avg("final_score"), 3).alias("avg_score"), F.round(100.0 * F.sum("valid_qa") / F.sum("total_qa"), 1).alias("valid_pct"), F.count(F.lit(1)).alias("runs"))


@query("k04_trend", f"WITH {RESULTS} SELECT to_timestamp(created_at)::DATE::VARCHAR AS day, count(*) AS runs, round(avg(final_score), 9) AS avg_score FROM eva WHERE final_score IS NOT NULL GROUP BY 1")
def k04_trend(spark, sf_dir):
    _, eva = results(spark, sf_dir)
    day = F.date_format(F.to_date(F.timestamp_seconds("created_at")), "yyyy-MM-dd")
    return eva.filter("final_score is not null").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("final_score"), 9).alias("avg_score"))


@query("g18_overview", f"WITH {RESULTS} SELECT round(avg(final_score), 5) AS mean, min(final_score) AS low, max(final_score) AS high, count(*) AS runs, count(final_score) AS with_score FROM eva")
def g18_overview(spark, sf_dir):
    _, eva = results(spark, sf_dir)
    return eva.agg(F.round(F.avg("final_score"), 5).alias("mean"), F.min("final_score").alias("low"), F.max("final_score").alias("high"), F.count(F.lit(1)).alias("runs"), F.count("final_score").alias("with_score"))


@query("g19_generation_cost", f"""WITH {RESULTS} SELECT source_doc, sum(total_qa)::BIGINT AS total_qa, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
  round((sum(tokens_in) * 3e0 + sum(tokens_out) * 15e0) / 1e6, 4) AS cost FROM gen GROUP BY source_doc""")
def g19_generation_cost(spark, sf_dir):
    from ..functions.text import cost

    gen, _ = results(spark, sf_dir)
    sums = gen.groupBy("source_doc").agg(*[F.sum(c).alias(c) for c in ("total_qa", "tokens_in", "tokens_out")])
    return sums.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(3.0), F.lit(15.0)))


@query("c01_violations", f"WITH {RESULTS} SELECT eval_id, CASE WHEN final_score NOT BETWEEN 0 AND 0.99e0 THEN 'score' ELSE 'grade' END AS violated FROM eva WHERE final_score NOT BETWEEN 0 AND 0.99e0 OR final_grade NOT IN ('A+', 'A', 'B+', 'B', 'C', 'F')")
def c01_violations(spark, sf_dir):
    """Rows that break a constraint of the results table (here with a score limit that some rows exceed)."""
    _, eva = results(spark, sf_dir)
    return S.violations(eva, "eval_id", {"score": ~F.col("final_score").between(0.0, 0.99), "grade": ~F.col("final_grade").isin("A+", "A", "B+", "B", "C", "F")})


METADATA = "meta AS (SELECT doc_id AS document_id, source AS filename FROM documents WHERE doc_id % 10 <> 3)"


@query("j05_orphan_chunks", f"WITH {CHUNKS}, {METADATA} SELECT document_id, count(*) AS chunks FROM doc_chunks c WHERE NOT EXISTS (SELECT 1 FROM meta m WHERE m.document_id = c.document_id) GROUP BY document_id")
def j05_orphan_chunks(spark, sf_dir):
    meta = read(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("document_id"))
    return doc_chunks(spark, sf_dir).join(meta, "document_id", "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("j06_orphan_generations", f"""WITH {CHUNKS}, g AS (SELECT conv_id AS gen_id, [conv_id || '_0', (conv_id + 100000) || '_1'] AS ids FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 = 0
  UNION ALL SELECT conv_id, [(conv_id + 100000) || '_0'] FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0)
  SELECT gen_id FROM g WHERE NOT EXISTS (SELECT 1 FROM doc_chunks WHERE list_contains(g.ids, id))""")
def j06_orphan_generations(spark, sf_dir):
    """Generations none of whose chunk ids exist: exploded and joined on equality, not by membership in an array."""
    c = F.col("conv_id")
    missing = lambda n: F.concat(c + 100000, F.lit(f"_{n}"))
    gen = read(spark, sf_dir, "conversations").select("conv_id").distinct().select(c.alias("gen_id"), F.when(c % 3 == 0, F.array(F.concat(c, F.lit("_0")), missing(1))).otherwise(F.array(missing(0))).alias("ids"))
    return S.without_any(gen, "gen_id", "ids", doc_chunks(spark, sf_dir), "id")


@query("j11_first_chunk", """WITH l AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, d.doc_id, CASE WHEN d.doc_id IS NULL THEN 'FAIL' ELSE 'OK' END AS status FROM l LEFT JOIN documents d ON d.doc_id = conv_id * 3""")
def j11_first_chunk(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    convs = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return convs.join(docs, F.col("doc_id") == F.col("conv_id") * 3, "left").select("conv_id", "doc_id", F.when(F.col("doc_id").isNull(), "FAIL").otherwise("OK").alias("status"))


@query("j15_latest_versions", f"""WITH {CHUNKS}, v AS (SELECT filename, arg_max(document_id, created_at * 1000000 + document_id) AS document_id FROM doc_chunks GROUP BY filename)
  SELECT c.id, c.filename FROM doc_chunks c WHERE document_id IN (SELECT document_id FROM v)""")
def j15_latest_versions(spark, sf_dir):
    """Chunks of the latest document of each file; the versions are reduced with partial maxima, not by a window."""
    chunks = doc_chunks(spark, sf_dir)
    latest = S.latest(chunks, "filename", "created_at", "document_id")
    return chunks.join(latest.select("document_id"), "document_id", "left_semi").select("id", "filename")


@query("g16_old_versions", f"""WITH {CHUNKS}, d AS (SELECT filename, document_id, max(created_at) AS made, count(*) AS chunks FROM doc_chunks GROUP BY 1, 2)
  SELECT filename, document_id, chunks FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY made DESC, document_id DESC) AS r FROM d) WHERE r > 1""")
def g16_old_versions(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    docs = chunks.groupBy("filename", "document_id").agg(F.max("created_at").alias("at"), F.count(F.lit(1)).alias("chunks"))
    newest = docs.groupBy("filename").agg(F.max(F.struct("at", "document_id")).alias("top")).select(F.col("top.document_id").alias("document_id"), "filename")
    return docs.join(newest, ["filename", "document_id"], "left_anti").select("filename", "document_id", "chunks")


@query("g01_coverage", f"WITH {CHUNKS} SELECT filename, document_id, h1, h2, h3, count(*) AS chunks FROM doc_chunks WHERE h1 IS NOT NULL AND h1 <> '__admin__' GROUP BY 1, 2, 3, 4, 5")
def g01_coverage(spark, sf_dir):
    return doc_chunks(spark, sf_dir).filter("h1 is not null and h1 <> '__admin__'").groupBy("filename", "document_id", "h1", "h2", "h3").agg(F.count(F.lit(1)).alias("chunks"))


@query("g03_tree", f"""WITH {CHUNKS} SELECT h1, h2, h3, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM doc_chunks WHERE h1 IS NOT NULL AND h1 <> '__admin__'
  GROUP BY GROUPING SETS ((h1, h2), (h1, h2, h3))""")
def g03_tree(spark, sf_dir):
    """Chunks and characters of the second and third level in one pass."""
    rows = doc_chunks(spark, sf_dir).filter("h1 is not null and h1 <> '__admin__'")
    return rows.groupingSets([[F.col("h1"), F.col("h2")], [F.col("h1"), F.col("h2"), F.col("h3")]], "h1", "h2", "h3").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("g02_health", f"""WITH {CHUNKS}, {METADATA} SELECT 'chunks' AS check_item, count(*) AS n, 'OK' AS status FROM doc_chunks
  UNION ALL SELECT 'untagged', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END FROM doc_chunks WHERE h1 IS NULL
  UNION ALL SELECT 'documents', count(DISTINCT document_id), 'OK' FROM doc_chunks
  UNION ALL SELECT 'orphans', count(DISTINCT document_id), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END FROM doc_chunks c WHERE NOT EXISTS (SELECT 1 FROM meta m WHERE m.document_id = c.document_id)""")
def g02_health(spark, sf_dir):
    """Four checks from one pass over the chunks: counts a document are made first, the rest is on documents."""
    meta = read(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("known"))
    docs = doc_chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("h1").isNull()).alias("u"))
    one = docs.join(meta, "document_id", "left").agg(F.sum("c").alias("chunks"), F.sum("u").alias("untagged"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("known").isNull()).alias("orphans"))
    warn = lambda c: F.when(F.col(c) > 0, "WARN").otherwise("OK")
    row = lambda c, s: F.struct(F.lit(c).alias("check_item"), F.col(c).alias("n"), s.alias("status"))
    return one.select(F.explode(F.array(row("chunks", F.lit("OK")), row("untagged", warn("untagged")), row("documents", F.lit("OK")), row("orphans", warn("orphans")))).alias("x")).select("x.*")


@query("g15_duplicate_groups", f"""WITH {CHUNKS} SELECT content_hash, document_id, count(*) AS copies, min(chunk_index) AS kept FROM doc_chunks GROUP BY 1, 2 HAVING count(*) > 1""")
def g15_duplicate_groups(spark, sf_dir):
    return doc_chunks(spark, sf_dir).groupBy("content_hash", "document_id").agg(F.count(F.lit(1)).alias("copies"), F.min("chunk_index").alias("kept")).filter("copies > 1")


@query("g17_inspection", f"""WITH {CHUNKS} SELECT count(*) AS chunks, count(*) FILTER (h1 IS NULL) AS untagged, count(DISTINCT document_id) AS documents, count(DISTINCT filename) AS files, count(content_hash) - count(DISTINCT content_hash) AS repeated_hashes FROM doc_chunks""")
def g17_inspection(spark, sf_dir):
    c = doc_chunks(spark, sf_dir)
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("h1").isNull()).alias("untagged"), F.count_distinct("document_id").alias("documents"), F.count_distinct("filename").alias("files"), (F.count("content_hash") - F.count_distinct("content_hash")).alias("repeated_hashes"))


@query("b01_dedup_insert", f"""WITH {CHUNKS}, old AS (SELECT * FROM doc_chunks WHERE document_id % 2 = 0), new AS (SELECT * FROM doc_chunks WHERE document_id % 3 = 0)
  SELECT id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.content_hash = new.content_hash AND old.document_id = new.document_id)""")
def b01_dedup_insert(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    return S.new_rows(chunks.filter("document_id % 3 = 0"), chunks.filter("document_id % 2 = 0"), ["content_hash", "document_id"]).select("id")


@query("b03_upsert", """WITH old AS (SELECT doc_id, source AS filename, lang AS profile FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, 'new_' || source AS filename, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'p' END AS profile FROM documents WHERE doc_id % 3 = 0)
  SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.filename, o.filename) AS filename, coalesce(n.profile, o.profile) AS profile FROM old o FULL JOIN new n ON n.doc_id = o.doc_id""")
def b03_upsert(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("source").alias("filename"), F.col("lang").alias("profile"))
    new = docs.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new_"), "source").alias("filename"), F.when(F.col("doc_id") % 4 != 0, "p").alias("profile"))
    return S.upsert(old, new, ["doc_id"])


@query("b04_patch_levels", f"""WITH {CHUNKS} SELECT id, CASE WHEN chunk_index % 2 = 0 THEN 'x' ELSE h1 END AS h1, CASE WHEN chunk_index % 2 = 0 THEN NULL ELSE h2 END AS h2, CASE WHEN chunk_index % 2 = 0 THEN 'z' ELSE h3 END AS h3 FROM doc_chunks""")
def b04_patch_levels(spark, sf_dir):
    """Three levels of the matched chunks are replaced, also by null."""
    chunks = doc_chunks(spark, sf_dir).select("id", "h1", "h2", "h3", "chunk_index")
    patch = chunks.filter("chunk_index % 2 = 0").select("id", F.lit("x").alias("h1"), F.lit(None).cast("string").alias("h2"), F.lit("z").alias("h3"))
    return S.patch(chunks, patch, "id", ["h1", "h2", "h3"]).select("id", "h1", "h2", "h3")


@query("b06_chunk_ids", "SELECT source, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), ',') AS doc_ids FROM documents WHERE doc_id % 5 = 0 GROUP BY source")
def b06_chunk_ids(spark, sf_dir):
    ids = read(spark, sf_dir, "documents").filter("doc_id % 5 = 0").groupBy("source").agg(F.collect_set(F.col("doc_id").cast("string")).alias("ids"))
    return ids.select("source", F.array_join(F.array_sort("ids"), ",").alias("doc_ids"))


@query("p05_json_paths", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def p05_json_paths(spark, sf_dir):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("w06_first_of_day", "SELECT min(ts)::DATE::VARCHAR AS day, arg_min(event_id, ts) AS event_id FROM events GROUP BY ts::DATE")
def w06_first_of_day(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.min_by("event_id", "ts").alias("event_id"))
