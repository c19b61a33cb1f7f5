"""Queries of JSON merges and containment, of stored tables with a key, of tagging batches and their answers, and of the detail sheet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import callable as C
from ..functions import vector
from ..functions import verdicts as V
from ..operators import export, sampling, tagging
from ..operators import json_objects as J
from ..operators.keyed_table import KeyedTable
from ..operators.stages import shared_folder
from ..sources.files import docx_file, docx_rows
from .adapters import CHUNKS, QA, doc_chunks, read
from .evaluation import scored
from .registry import query

# Old and new metadata of each event, in a form that both engines take.
OLD = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k":1,"in":{"a":' || user_id || ',"b":{"c":1,"d":[1,2]}},"t":"' || event_type || '"}' WHEN 2 THEN '[1,{"k":2}]' ELSE '{"z":null}' END"""
NEW = """CASE event_id % 3 WHEN 0 THEN '{"in":{"b":{"d":[3],"e":"' || event_type || '"}},"k":null}' WHEN 1 THEN '{"in":' || user_id || ',"y":[' || (event_id % 7) || ',null]}' ELSE '{}' END"""


@query("p06_json_merge", f"""WITH e AS (SELECT event_id, ({OLD})::JSON AS o, ({NEW})::JSON AS n FROM events), k AS (SELECT *, list_sort(list_distinct(json_keys(o) || json_keys(n))) AS ks FROM e WHERE json_type(o) = 'OBJECT')
  SELECT event_id, '{{' || array_to_string(list_transform(ks, lambda k: '"' || k || '":' || CASE WHEN list_contains(json_keys(n), k) THEN (n -> k)::VARCHAR ELSE (o -> k)::VARCHAR END), ',') || '}}' AS merged FROM k
  UNION ALL SELECT event_id, '[' || trim(o::VARCHAR, '[]') || ',' || n::VARCHAR || ']' FROM e WHERE json_type(o) = 'ARRAY'""")
def p06_json_merge(spark, sf_dir):
    """Metadata with new members in place of old ones, null too; where the old value is a list, the new one is appended."""
    rows = read(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr(OLD)).alias("o"), F.parse_json(F.expr(NEW)).alias("n"))
    return rows.select("event_id", F.to_json(J.merged(F.col("o"), F.col("n"))).alias("merged"))


@query("p06_deep_merge", f"""WITH e AS (SELECT event_id, json_merge_patch(({OLD})::JSON, ({NEW})::JSON) AS m FROM events WHERE event_id % 4 < 2 AND event_id % 3 > 0
    UNION ALL SELECT event_id, json_merge_patch(({OLD})::JSON, ('{{"in":{{"b":{{"d":[3],"e":"' || event_type || '"}}}}}}')::JSON) FROM events WHERE event_id % 4 < 2 AND event_id % 3 = 0)
  SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (m -> '$.k')::VARCHAR END AS k, (m -> '$.in.a')::VARCHAR AS a, (m -> '$.in.b.c')::VARCHAR AS c, (m -> '$.in.b.d')::VARCHAR AS d, (m -> '$.in.b.e')::VARCHAR AS e, (m -> '$.t')::VARCHAR AS t FROM e""")
def p06_deep_merge(spark, sf_dir):
    """The same with objects in objects merged in turn, by some of its paths; a member that is overwritten by null is null (so k)."""
    rows = read(spark, sf_dir, "events").filter("event_id % 4 < 2").select("event_id", J.merged_deeply(F.parse_json(F.expr(OLD)), F.parse_json(F.expr(NEW))).alias("m"))
    at = lambda name, path: F.to_json(F.variant_get("m", path, "variant")).alias(name)
    k = F.when(~F.is_variant_null(F.variant_get("m", "$.k", "variant")), F.to_json(F.variant_get("m", "$.k", "variant"))).alias("k")
    return rows.select("event_id", k, at("a", "$.in.a"), at("c", "$.in.b.c"), at("d", "$.in.b.d"), at("e", "$.in.b.e"), at("t", "$.t"))


@query("f04_nested", f"""WITH e AS (SELECT event_id, ({OLD})::JSON AS o FROM events) SELECT event_id,
  CASE WHEN json_contains(o, '{{"in":{{"b":{{"d":[2]}}}},"t":"click"}}') THEN 'nested' WHEN json_contains(o, '[{{"k":2}}]') THEN 'list' WHEN json_contains(o, '{{"z":null}}') THEN 'null' WHEN json_contains(o, '{{"k":3}}') THEN 'number' ELSE 'none' END AS found FROM e""")
def f04_nested(spark, sf_dir):
    """Which of four wanted objects each event's metadata contains, the first of them."""
    rows = read(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr(OLD)).alias("o"))
    o = F.col("o")
    found = F.when(J.contains(o, {"in": {"b": {"d": [2]}}, "t": "click"}), "nested").when(J.contains(o, [{"k": 2}]), "list").when(J.contains(o, {"z": None}), "null").when(J.contains(o, {"k": 3}), "number")
    return rows.select("event_id", found.otherwise("none").alias("found"))


def metadata_table(spark, rows) -> KeyedTable:
    table = KeyedTable(shared_folder(spark, "metadata"), ("doc_id",), 16)
    table.create(rows)
    return table


@query("b03_stored_upsert", """WITH old AS (SELECT doc_id, source AS filename, lang AS profile FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, 'new_' || source AS filename, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'p' END AS profile FROM documents WHERE doc_id % 3 = 0)
  SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.filename, o.filename) AS filename, coalesce(n.profile, o.profile) AS profile FROM old o FULL JOIN new n ON n.doc_id = o.doc_id""")
def b03_stored_upsert(spark, sf_dir):
    """The upsert against a stored table, read back from it."""
    docs = read(spark, sf_dir, "documents")
    table = metadata_table(spark, docs.filter("doc_id % 2 = 0").select("doc_id", F.col("source").alias("filename"), F.col("lang").alias("profile")))
    table.upsert(docs.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new_"), "source").alias("filename"), F.when(F.col("doc_id") % 4 != 0, "p").alias("profile")))
    return table.read(spark).select("doc_id", "filename", "profile")


@query("b04_stored_patch", """SELECT doc_id, source AS filename, CASE WHEN doc_id % 5 = 0 THEN NULLIF(lang, 'en') ELSE lang END AS profile FROM documents WHERE doc_id % 7 > 0""")
def b04_stored_patch(spark, sf_dir):
    """A column replaced, also by null, in a stored table, of which other rows are deleted."""
    docs = read(spark, sf_dir, "documents")
    table = metadata_table(spark, docs.select("doc_id", F.col("source").alias("filename"), F.col("lang").alias("profile")))
    table.patch(docs.filter("doc_id % 5 = 0").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("profile")), ["profile"])
    table.delete(docs.filter("doc_id % 7 = 0").select("doc_id"))
    return table.read(spark).select("doc_id", "filename", "profile")


TAGS = f"""{CHUNKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY document_id, chunk_index) - 1 AS place FROM doc_chunks),
  dealt AS (SELECT *, place // 5 AS batch, (place % 5)::INT AS idx, count(*) OVER (PARTITION BY filename, place // 5) AS size FROM numbered)"""
#: What a model answers to a batch, awkward answers among them.
ANSWER = """CASE batch % 6 WHEN 0 THEN '[{"idx":0,"hierarchy":{"h1":"A","h2":"B' || size || '","h3":null}},{"idx":1,"hierarchy":{"h1":"__admin__"}}]' WHEN 1 THEN 'no list ['
  WHEN 2 THEN '[{"idx":4,"hierarchy":{"h1":"C","h2":7}},{"idx":5,"hierarchy":null},{"idx":1.5},{"hierarchy":{}}]' WHEN 3 THEN '[{"idx":-1,"hierarchy":{"h1":"D","h2":"e","h3":"f"}}]'
  WHEN 4 THEN '[{"idx":0,"hierarchy":{"h1":"X"}},{"idx":0,"hierarchy":null}]' ELSE '[{"idx":0},{"idx":0,"hierarchy":{"h1":"last"}}]' END"""


def requests(rows):
    entries = tagging.entry(F.col("idx"), F.col("content"), F.lit(None).cast("string"), F.col("h3"))
    return tagging.requests(rows, "filename", entries)


def dealt(spark, sf_dir):
    return tagging.batches(doc_chunks(spark, sf_dir), "filename", ["document_id", "chunk_index"])


@query("tag_requests", f"WITH {TAGS} SELECT filename, batch, count(*)::INT AS size, sum(length(content))::BIGINT AS chars, md5(string_agg(content, '|' ORDER BY idx)) AS contents, string_agg(h3, ',' ORDER BY idx) AS titles FROM dealt GROUP BY filename, batch")
def tag_requests(spark, sf_dir):
    """Batches of five chunks of a file as they go to the model, read back from their JSON."""
    seen = F.from_json("entries", "array<struct<idx:int,content:string,chunk_type:string,char_length:int,section_title:string>>")
    rows = requests(dealt(spark, sf_dir)).withColumn("e", seen)
    chars = F.aggregate("e", F.lit(0).cast("bigint"), lambda s, x: s + x["char_length"])
    return rows.select("filename", "batch", "size", chars.alias("chars"), F.md5(F.array_join("e.content", "|")).alias("contents"), F.array_join("e.section_title", ",").alias("titles"))


@query("tag_answers", rf"""WITH {TAGS}, a AS (SELECT filename, batch, size, {ANSWER} AS answer FROM (SELECT DISTINCT filename, batch, size FROM dealt)),
  p AS (SELECT *, CASE WHEN json_valid(answer) THEN from_json(answer, '["JSON"]') END AS items FROM a), i AS (SELECT filename, batch, size, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM p),
  j AS (SELECT *, CASE WHEN json_type(x, '$.idx') IN ('UBIGINT', 'BIGINT') THEN (x ->> '$.idx')::BIGINT END AS k FROM i),
  v AS (SELECT *, bool_or(coalesce(k < size, false) AND (k < -size OR coalesce(json_type(x, '$.hierarchy') <> 'OBJECT', false))) OVER (PARTITION BY filename, batch) AS bad FROM j),
  t AS (SELECT filename, batch, CASE WHEN k < 0 THEN k + size ELSE k END AS idx, arg_max(x, pos) AS x FROM v WHERE k < size AND NOT bad GROUP BY 1, 2, 3)
  SELECT d.id, CASE WHEN t.x IS NULL THEN h1 ELSE t.x ->> '$.hierarchy.h1' END AS h1, CASE WHEN t.x IS NULL THEN h2 ELSE t.x ->> '$.hierarchy.h2' END AS h2, CASE WHEN t.x IS NULL THEN h3 ELSE t.x ->> '$.hierarchy.h3' END AS h3
  FROM dealt d LEFT JOIN t ON t.filename = d.filename AND t.batch = d.batch AND t.idx = d.idx""")
def tag_answers(spark, sf_dir):
    """All chunks with the levels that the answers to their batches give them."""
    rows = dealt(spark, sf_dir)
    sizes = rows.groupBy("filename", "batch").agg(F.count(F.lit(1)).cast("int").alias("size")).withColumn("answer", F.expr(ANSWER))
    found = tagging.answers(sizes, "size", "answer", ["filename", "batch"])
    return tagging.tagged(rows, found, "filename").select("id", "h1", "h2", "h3")


@query("s36_output_caps", "SELECT o_orderkey, CASE WHEN o_custkey % 60 <= 30 THEN 8192 WHEN o_custkey % 60 <= 40 THEN 12288 ELSE 16384 END AS cap FROM orders")
def s36_output_caps(spark, sf_dir):
    """Tokens that an answer may have, by the size of its batch."""
    return read(spark, sf_dir, "orders").select("o_orderkey", V.output_cap(F.col("o_custkey") % 60).alias("cap"))


@query("b15_paired", "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids, round(avg(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS first FROM embeddings GROUP BY label")
def b15_paired(spark, sf_dir):
    """Batches of ids with the vectors that came for them, one each, normalised."""
    batches = read(spark, sf_dir, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 32).alias("batch")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("b"))
    pairs = batches.select("label", F.explode(vector.paired(F.col("b.vec_id"), F.col("b.embedding"))).alias("p"))
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("p.item").alias("ids"), F.round(F.avg(F.element_at("p.vector", 1)), 4).alias("first"))


PRIMARY = """CASE WHEN list_contains(types, 'hallucination') THEN '환각오류' WHEN list_contains(types, 'faithfulness_error') THEN '근거오류' WHEN list_contains(types, 'retrieval_miss') THEN '검색오류'
    WHEN list_contains(types, 'bad_chunk') THEN '불량청크' WHEN list_contains(types, 'low_quality') THEN '품질미달' WHEN list_contains(types, 'poor_context') THEN '문맥부족' ELSE '-' END"""


@query("b11_detail", f"""WITH {QA} SELECT qa_id, CASE intent WHEN 'fact' THEN '사실형' WHEN 'purpose' THEN '원인형' WHEN 'how' THEN '방법형' WHEN 'condition' THEN '조건형' WHEN 'comparison' THEN '비교형' ELSE '열거형' END AS intent,
  coalesce(context, '') AS context, q AS question, coalesce(a, '') AS answer, printf('%.2f', avg_quality) AS quality, CASE WHEN avg_quality < 0.7e0 AND rag < 0.7e0 THEN '실패' WHEN avg_quality < 0.7e0 OR rag < 0.7e0 OR len(types) > 0 THEN '보류' ELSE '성공' END AS status,
  {PRIMARY} AS failure, '2024-01-01 09:00' AS evaluated FROM failed""")
def b11_detail(spark, sf_dir):
    """The detail sheet of the export (the triad's score is in other queries: two decimals of a binary tie differ between engines)."""
    return export.detail(scored(spark, sf_dir), F.lit("2024-01-01 09:00")).drop("triad")


@query("a02_word_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc_id, i, trim(t, ' ' || chr(9) || chr(13)) AS t FROM l)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS block_idx, t AS text, CASE WHEN i = 1 THEN 18e0 WHEN i % 5 = 0 THEN 14e0 ELSE 11e0 END AS font_size FROM s WHERE t <> '' AND doc_id % 50 > 0
  UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 50 = 0""")
def a02_word_blocks(spark, sf_dir):
    """Each text as a Word document (its first line a heading) and read back as blocks; every fiftieth file is damaged and gives an error."""

    def run(frames):
        for frame in frames:
            styles = lambda i: "Heading1" if i == 0 else "heading 3" if i % 5 == 4 else None
            files = [docx_file([(t, styles(i)) for i, t in enumerate((text or "").split("\n"))]) for text in frame["text"]]
            yield pd.DataFrame({"path": frame["doc_id"].astype(str), "content": [f[: len(f) // 2] if k % 50 == 0 else f for k, f in zip(frame["doc_id"], files)]})

    files = read(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "path string, content binary")
    return docx_rows(files).select(F.col("path").cast("bigint").alias("doc_id"), "block_idx", "text", "font_size")


@query("b13_json_export", f"""WITH {QA} SELECT qa_id, '{{"qa_id":' || qa_id || ',"intent":"' || intent || '","avg_quality":"' || printf('%.2f', avg_quality) || '","relevance":"' || printf('%.2f', relevance) || '"}}' AS json FROM scored""")
def b13_json_export(spark, sf_dir):
    """Items as JSON with scores of two decimals."""
    rows = scored(spark, sf_dir).select("qa_id", "intent", "avg_quality", "relevance")
    return export.json_rows(rows, ["avg_quality", "relevance"]).select(F.get_json_object("json", "$.qa_id").cast("bigint").alias("qa_id"), "json")


@query("a10_scan", f"WITH {CHUNKS} SELECT id, document_id, chunk_index FROM doc_chunks ORDER BY document_id, chunk_index LIMIT 5000")
def a10_scan(spark, sf_dir):
    """The first 5,000 chunks of a maintenance scan (the original's cap; ``cap=None`` scans all)."""
    return sampling.scan(doc_chunks(spark, sf_dir), ["id", "document_id", "chunk_index"], ["document_id", "chunk_index"], 5000)


@query("b04_sql_patch", """SELECT event_id, '{"h1":"' || event_type || '","h2":null,"h3":"t' || (event_id % 5) || '","k":' || (props ->> '$.k') || '}' AS patched, CASE WHEN event_id % 2 = 0 THEN event_type END AS first FROM events""")
def b04_sql_patch(spark, sf_dir):
    """Levels patched and paths read by the session's SQL functions."""
    C.register(spark)
    kept = F.expr("""CASE WHEN event_id % 2 = 0 THEN '{"h1":"' || event_type || '"}' ELSE '[1]' END""")
    read(spark, sf_dir, "events").withColumn("old", kept).createOrReplaceTempView("patched_events")
    return spark.sql("SELECT event_id, patch_levels(props, event_type, NULL, concat('t', event_id % 5)) AS patched, json_at(old, '$.h1') AS first FROM patched_events")
