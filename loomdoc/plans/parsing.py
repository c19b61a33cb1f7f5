"""Queries over chunks whose texts are marked so that the rules of parsing and chunk filters apply to some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import blocks
from .adapters import CHUNKS, doc_chunks, read
from .registry import query

SAME = "같은 내용의 문장이 이 글 안에서 되풀이된다. 두 번째부터는 남지 않아야 한다. 그래서 예순 글자를 넘게 적는다."
HEADER = "머리글 공통"


def marked_chunks(spark, sf_dir):
    """Chunks with a text that one of the rules applies to, by number, and the heading of their section."""
    chunks = doc_chunks(spark, sf_dir)
    m, c = (F.col("document_id") + F.col("chunk_index")) % 12, F.col("content")
    put = lambda a, b="": F.concat(F.lit(a), c, F.lit(b))
    text = (
        F.when(m == 0, put("목　차 1.1 a 1.2 b 2.1 c 2.2 d 3.1 e 3.2 "))
        .when(m == 1, put("", " ···· 12"))
        .when(m == 2, put("발행일 2024 발행처 x "))
        .when(m == 3, F.lit("□■□■□■□■□■□■□■□■□■□■"))
        .when(m == 4, put("12\n", f"\n{HEADER}\n 7 "))
        .when(m == 5, F.lit(SAME))
        .when(m == 6, put("  | a | --- | b | "))
        .when(m == 7, put("제3조(목적)\n"))
        .when(m == 8, put("", " 또한"))
        .when(m == 9, F.substring(c, 1, 50))
        .otherwise(c)
    )
    heading = F.when(m == 7, "제3조(목적)").when(m == 6, "제12조의2(정의 등) 그 밖의\n사항").otherwise(F.concat(F.lit("절  "), "filename"))
    return chunks.select("id", "document_id", "filename", "chunk_index", m.alias("m"), text.alias("content"), heading.alias("heading"))


MARKED = rf"""{CHUNKS}, marked AS (SELECT id, document_id, filename, chunk_index, m, CASE m WHEN 0 THEN '목　차 1.1 a 1.2 b 2.1 c 2.2 d 3.1 e 3.2 ' || content WHEN 1 THEN content || ' ···· 12'
  WHEN 2 THEN '발행일 2024 발행처 x ' || content WHEN 3 THEN '□■□■□■□■□■□■□■□■□■□■' WHEN 4 THEN '12' || chr(10) || content || chr(10) || '{HEADER}' || chr(10) || ' 7 ' WHEN 5 THEN '{SAME}'
  WHEN 6 THEN '  | a | --- | b | ' || content WHEN 7 THEN '제3조(목적)' || chr(10) || content WHEN 8 THEN content || ' 또한' WHEN 9 THEN substr(content, 1, 50) ELSE content END AS content,
  CASE m WHEN 7 THEN '제3조(목적)' WHEN 6 THEN '제12조의2(정의 등) 그 밖의' || chr(10) || '사항' ELSE '절  ' || filename END AS heading FROM (SELECT *, (document_id + chunk_index) % 12 AS m FROM doc_chunks))"""


def contents_sql(t: str) -> str:
    lines = f"list_filter(string_split({t}, chr(10)), lambda x: trim(x) <> '')"
    count = lambda s, piece: f"(length({s}) - length(replace({s}, '{piece}', '')))"
    led = f"len(list_filter({lines}, lambda x: ({count('x', '·')} > 3 OR {count('x', '.')} > 5) AND regexp_matches(right(x, 5), '[0-9]')))"
    numbers = rf"len(regexp_extract_all({t}, '\b[0-9]+\.[0-9]+'))"
    words = rf"greatest(len(list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')), 1)::DOUBLE"
    table = f"{count(t, '|')} >= 4"
    return rf"""CASE WHEN length({t}) < 20 THEN false ELSE (NOT {table} AND {count(t, '·')} > 10 AND {count(t, '·')} > 0.05e0 * length({t})) OR contains({t}, '····') OR (NOT {table} AND len({lines}) > 0 AND {led} >= 0.6e0 * len({lines}))
  OR (regexp_matches({t}, '목[\s\x{{3000}}\x{{A0}}]*차') AND {numbers} >= 5) OR (NOT {table} AND {numbers} >= 8 AND {numbers} / {words} >= 0.05e0 AND len(regexp_extract_all({t}, '다\.')) <= 2) END"""


def noise_sql(t: str) -> str:
    base = rf"regexp_replace({t}, '[\s|\x{{A0}}\x{{3000}}]', '', 'g')"
    colophon = " + ".join(f"contains({t}, '{k}')::INT" for k in T.COLOPHON)
    return rf"""CASE WHEN {contents_sql(t)} THEN 'contents' WHEN {colophon} >= 2 THEN 'colophon' WHEN CASE WHEN length({t}) < 10 THEN false WHEN length({base}) = 0 THEN true
  ELSE length({base}) >= 15 AND len(regexp_extract_all({base}, '[0-9A-Za-z가-힣]')) / length({base})::DOUBLE < 0.15e0 END THEN 'symbols' END"""


STRIP = r"'^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$', '', 'g'"
FOOTERS = rf"array_to_string(list_filter(string_split(t0, chr(10)), lambda x: NOT regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[0-9]{{1,3}}$') AND regexp_replace(x, '^\s+|\s+$', '', 'g') <> '{HEADER}'), chr(10))"
HASH = r"sha1(regexp_replace(lower(t), '[^\p{L}\p{N}_]', '', 'g'))"
DEDUP = f"""ranked AS (SELECT *, {HASH} AS hash, row_number() OVER (PARTITION BY document_id, {HASH}, reason IS NULL ORDER BY chunk_index) AS k FROM judged),
  done AS (SELECT *, coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' ELSE 'kept' END) AS verdict FROM ranked)"""


@query("r12_model_chain", rf"""WITH {MARKED}, a AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t0 FROM marked), b AS (SELECT *, {FOOTERS} AS t FROM a WHERE t0 <> ''),
  judged AS (SELECT *, coalesce({noise_sql('t')}, CASE WHEN length(t) < 60 THEN 'short' END) AS reason FROM b), {DEDUP}
  SELECT verdict AS reason, count(*) AS n, sum(length(t))::BIGINT AS chars FROM done GROUP BY 1""")
def r12_model_chain(spark, sf_dir):
    """The filters of chunks that a model made, in order: stripped, footers out, contents, colophon, symbols, short, repeated in the document."""
    rows = marked_chunks(spark, sf_dir).withColumn("content", T.strip(F.col("content"))).filter("content != ''")
    rows = blocks.model_chain(rows, F.array(F.lit(HEADER)))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("r13_rule_chain", rf"""WITH {MARKED}, a AS (SELECT *, CASE WHEN regexp_matches(content, '^\s*[|]') AND contains(content, '---') THEN '[표]' || chr(10) || regexp_replace(content, '^\s+', '') ELSE content END AS t0 FROM marked),
  n AS (SELECT *, {noise_sql('t0')} AS noise, {FOOTERS} AS t1, regexp_replace(heading, '^\s+|\s+$', '', 'g') AS h FROM a),
  s AS (SELECT *, regexp_replace(array_to_string(string_split(t1, chr(10))[2:], chr(10)), '^\s+|\s+$', '', 'g') AS rest FROM n),
  u AS (SELECT *, CASE WHEN NOT regexp_matches(h, '^([0-9]+[.의]|[가-힣]\.)\s') AND regexp_replace(string_split(t1, chr(10))[1], '^\s+|\s+$', '', 'g') = h AND rest <> '' THEN rest ELSE t1 END AS t FROM s),
  judged AS (SELECT *, coalesce(noise, CASE WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 60 THEN 'short' END) AS reason,
    regexp_replace(replace(replace(heading, chr(10), ' '), '  ', ' '), '^\s+|\s+$', '', 'g') AS title FROM u), {DEDUP}
  SELECT id, verdict AS reason, CASE WHEN verdict = 'kept' THEN md5('문서: ' || filename || chr(10) || '섹션: ' || coalesce(nullif(regexp_extract(title, '^(제[0-9]+조(?:의[0-9]+)?(?:\([^)]{{1,30}}\))?)', 1), ''), title)
    || chr(10) || '페이지: ' || (chunk_index // 3 + 1) || chr(10) || chr(10) || t) END AS text_md5 FROM done""")
def r13_rule_chain(spark, sf_dir):
    """The filters of chunks that rules made, in their other order, and the text of the kept ones with its prefix."""
    rows = blocks.rule_chain(marked_chunks(spark, sf_dir), F.array(F.lit(HEADER)), "heading")
    title = R.article_title(R.one_line(F.col("heading")))
    text = F.concat(R.context_prefix(F.col("filename"), title, F.floor(F.col("chunk_index") / 3) + 1), "content")
    return rows.select("id", "reason", F.when(F.col("reason") == "kept", F.md5(text)).alias("text_md5"))


@query("s15_pages", r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, substr(text, (1 + doc_id * 7 % greatest(length(text), 1))::BIGINT, 200) AS chunk FROM documents),
  o AS (SELECT doc_id, text, chunk, regexp_replace(substr(chunk, 1, 60), '^\s+|\s+$', '', 'g') AS s, list_transform(range(1, len(l) + 1), lambda i: {'off': coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0), 'page': (i - 1) // 3 + 1}) AS offs FROM d)
  SELECT doc_id, CASE WHEN strpos(text, s) = 0 THEN 99 ELSE coalesce(list_filter(offs, lambda q: q.off <= strpos(text, s) - 1)[-1].page, 99) END::BIGINT AS page FROM o WHERE s <> ''""")
def s15_pages(spark, sf_dir):
    """Page of a stretch of each text, three lines being a page."""
    docs = read(spark, sf_dir, "documents")
    offsets = F.transform(blocks.line_starts(F.col("text")), lambda e, i: F.struct(e.alias("off"), F.floor(i / 3 + 1).alias("page")))
    chunk = F.substr("text", (1 + F.col("doc_id") * 7 % F.greatest(F.length("text"), F.lit(1))).cast("int"), F.lit(200))
    rows = docs.filter(T.strip(F.substring(chunk, 1, 60)) != "")
    return rows.select("doc_id", R.resolved_page(chunk, F.col("text"), offsets, F.lit(99)).cast("bigint").alias("page"))


@query("s16_in_tables", """WITH b AS (SELECT l_orderkey, l_linenumber, (l_quantity * 10 + l_quantity * 10 + l_tax * 500) / 2 AS x, (l_discount * 4000 + l_discount * 4000 + 20) / 2 AS y FROM lineitem)
  SELECT l_linenumber, count(*) AS n, count(*) FILTER ((x BETWEEN 50 AND 200 AND y BETWEEN 90 AND 210) OR (x BETWEEN 250 AND 400 AND y BETWEEN 10 AND 130)) AS inside FROM b GROUP BY 1""")
def s16_in_tables(spark, sf_dir):
    """Boxes whose middle is inside one of two tables."""
    x0, y0 = F.col("l_quantity") * 10, F.col("l_discount") * 4000
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    inside = R.in_a_table(x0, y0, x0 + F.col("l_tax") * 500, y0 + 20, F.array(box(50, 90, 200, 210), box(250, 10, 400, 130)))
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"))


@query("s19_block_noise", rf"""WITH {CHUNKS}, b AS (SELECT id, CASE (document_id + chunk_index) % 4 WHEN 0 THEN '□■·□' || substr(content, 1, 3) WHEN 1 THEN 'Ab)' || substr(content, 1, 8) WHEN 2 THEN '요약 ' || substr(content, 1, 4) || '?66' ELSE substr(content, 1, 30) END AS t FROM doc_chunks)
  SELECT id, (length(t) <= 15 AND len(regexp_extract_all(t, '[가-힣a-zA-Z0-9]')) / greatest(length(t), 1)::DOUBLE < 0.3e0) OR (length(t) <= 12 AND regexp_matches(t, '^[A-Za-z]{{1,2}}[)（\]】]')) AS noise,
  regexp_matches(t, '[·]{{3,}}|(\.{{4,}})\s*[0-9]+\s*$|[가-힣?)\]】』][0-9]{{1,3}}\s*$') AS contents FROM b""")
def s19_block_noise(spark, sf_dir):
    """Noise of covers and lines of contents among short blocks."""
    c, m = F.col("content"), (F.col("document_id") + F.col("chunk_index")) % 4
    cut = lambda n: F.substring(c, 1, n)
    t = F.when(m == 0, F.concat(F.lit("□■·□"), cut(3))).when(m == 1, F.concat(F.lit("Ab)"), cut(8))).when(m == 2, F.concat(F.lit("요약 "), cut(4), F.lit("?66"))).otherwise(cut(30))
    return doc_chunks(spark, sf_dir).select("id", R.is_block_noise(t).alias("noise"), R.is_contents_block(t).alias("contents"))


@query("s05_glyphs", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 40) ELSE replace(substr(text, 1, 40), 'e', '가') END AS t FROM documents),
  g AS (SELECT doc_id, list_transform(range(1, length(t) + 1), lambda i: {'c': substr(t, i, 1), 'x0': i * 10 + i // 5 * 5, 'x1': i * 10 + i // 5 * 5 + 8 + i % 3}) AS g FROM d),
  m AS (SELECT *, list_avg(list_transform(g, lambda x: x.x1 - x.x0)) AS w, len(list_filter(g, lambda x: regexp_matches(x.c, '[가-힣]'))) > 0 AS korean FROM g)
  SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN korean AND i > 1 AND g[i].c <> ' ' AND g[i].x0 - g[i - 1].x1 > w * 0.4e0 THEN ' ' || g[i].c ELSE g[i].c END), '') AS spaced FROM m""")
def s05_glyphs(spark, sf_dir):
    """Spaces put back between glyphs, in texts with some Hangul and with gaps after every fifth glyph."""
    t = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.replace(F.substring("text", 1, 40), F.lit("e"), F.lit("가")))
    parts = F.filter(F.split(t, ""), lambda c: c != "")
    x0 = lambda i: (i + 1) * 10.0 + F.floor((i + 1) / 5) * 5.0
    glyphs = F.transform(parts, lambda c, i: F.struct(c.alias("c"), x0(i).alias("x0"), (x0(i) + 8 + (i + 1) % 3).alias("x1")))
    return read(spark, sf_dir, "documents").select("doc_id", R.glyph_text(glyphs).alias("spaced"))


@query("r06_continued")
def r06_continued(spark, sf_dir):
    """Blocks of a page joined with those that go on with them (held against a plain loop in the tests)."""
    docs = read(spark, sf_dir, "documents")
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 60)
    kinds = lambda w, i: F.when(i % 7 == 1, F.concat(F.lit("알고리즘개 ③"), F.lit(""))).when(i % 7 == 2, F.lit("발.")).when(i % 7 == 4, F.concat(F.lit("(A"), w, F.lit(")"))).otherwise(w)
    items = F.transform(words, lambda w, i: F.struct(kinds(w, i).alias("text"), (i * F.when(i % 14 == 2, 20.0).otherwise(12.0)).alias("y0"), (i * 12.0 + 10).alias("y1"), F.when(i % 14 == 2, 14.0).otherwise(10.0).alias("font"), (i % 21 == 4).alias("is_table")))
    return docs.select("doc_id", F.transform(R.continued(items), lambda x: x["text"]).alias("texts")).select("doc_id", F.size("texts").alias("n_blocks"), F.array_join("texts", "\n").alias("page_text"))


@query("s28_answered_chunks", """WITH b AS (SELECT doc_id, string_split(text, chr(10))[1:3] AS l FROM documents), x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM b WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 1, l FROM b WHERE doc_id % 3 <> 0 AND len(l) >= 2)
  SELECT doc_id, (i - 1)::INT AS position, CASE WHEN doc_id % 3 = 0 THEN substr(regexp_replace(l[i], '^\\s+|\\s+$', '', 'g'), 1, 30) WHEN doc_id % 3 = 1 THEN 'chunk ' || doc_id ELSE 'given' END AS section_title,
  CASE WHEN doc_id % 3 = 0 THEN (i - 1)::VARCHAR ELSE '1,0' END AS source_blocks, (CASE WHEN doc_id % 3 = 0 THEN i * 10 ELSE 20 END)::BIGINT AS page FROM x
  UNION ALL SELECT doc_id, 0, CASE WHEN doc_id % 3 = 1 THEN 'chunk ' || doc_id ELSE 'given' END, '0', 10 FROM b WHERE doc_id % 3 <> 0 AND len(l) = 1""")
def s28_answered_chunks(spark, sf_dir):
    """Chunks of a model's answers: a third of the answers is no JSON, the others name blocks that are not there."""
    docs = read(spark, sf_dir, "documents")
    lines = F.slice(F.split("text", "\n", -1), 1, 3)
    given = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("index"), ((i + 1) * 10).cast("bigint").alias("page"), x.alias("text")))
    title = F.when(F.col("doc_id") % 3 == 1, "").otherwise("given")
    body = F.format_string('[{"text": "chunk %d\\nmore", "section_title": "%s", "source_blocks": [7, 1, 0]}, {"text": "none", "source_blocks": [9]}]', F.col("doc_id"), title)
    body = F.replace(body, F.lit("\n"), F.lit("\\n"))
    answer = F.when(F.col("doc_id") % 3 == 0, "no answer").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = docs.select("doc_id", F.posexplode(R.answered_chunks(answer, given)).alias("position", "c"))
    return rows.select("doc_id", "position", "c.section_title", F.array_join(F.col("c.source_blocks").cast("array<string>"), ",").alias("source_blocks"), "c.page")


@query("s34_domains", """WITH d AS (SELECT doc_id, ['', '교통 법령 안내', '계약 규정', 'AI 가이드', '연구보고서', '사내 매뉴얼', '데이터 목록', 'other'][doc_id % 8 + 1] AS domain FROM documents)
  SELECT domain, CASE WHEN contains(domain, '법령') OR contains(domain, '규정') THEN 'purpose,condition,list' WHEN contains(domain, '계약') THEN 'condition,comparison,list' WHEN contains(domain, '매뉴얼') THEN 'how,condition,list'
  WHEN contains(domain, '가이드') THEN 'how,purpose,condition' WHEN contains(domain, '연구') THEN 'purpose,fact,comparison' WHEN contains(lower(domain), 'ai') THEN 'how,fact,condition' WHEN contains(domain, '데이터') THEN 'how,list,condition' ELSE '' END AS intents, count(*) AS n
  FROM d GROUP BY 1, 2""")
def s34_domains(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("", "교통 법령 안내", "계약 규정", "AI 가이드", "연구보고서", "사내 매뉴얼", "데이터 목록", "other")])
    rows = read(spark, sf_dir, "documents").select(F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")).alias("domain"))
    return rows.groupBy("domain", F.array_join(R.domain_intents(F.col("domain")), ",").alias("intents")).agg(F.count(F.lit(1)).alias("n"))


@query("s37_labels", """WITH e AS (SELECT event_id, user_id, ['HTTP 429 from host', 'Quota is used up', 'error 401', 'API_KEY is missing', 'Invalid request', 'timed out', 'RESOURCE_EXHAUSTED'][event_id % 7 + 1] AS message,
  ['qa_model-x_ko_2024', 'qa_a_b_en_', 'qa_KO_x', 'other_ko_'][event_id % 4 + 1] AS file, '<b a="1">' || event_type || ' & co</b>' AS markup FROM events)
  SELECT event_id, CASE WHEN contains(message, '429') OR contains(lower(message), 'quota') OR contains(lower(message), 'resource_exhausted') THEN 'quota' WHEN contains(message, '401') OR contains(lower(message), 'api_key') OR contains(lower(message), 'invalid') THEN 'auth' ELSE 'other' END AS error_class,
  substr(sha256(user_id::VARCHAR), 1, 10) AS secret_mark, regexp_extract(file, '^qa_(.+?)_[a-z]{2}_', 1) AS model,
  CASE WHEN event_id % 9 = 0 THEN '-' ELSE replace(replace(replace(replace(markup, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END AS html FROM e""")
def s37_labels(spark, sf_dir):
    """Classes of errors, marks of secrets, models of file names and escaped markup, on made-up values."""
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))
    message = pick(7, "HTTP 429 from host", "Quota is used up", "error 401", "API_KEY is missing", "Invalid request", "timed out", "RESOURCE_EXHAUSTED")
    file = pick(4, "qa_model-x_ko_2024", "qa_a_b_en_", "qa_KO_x", "other_ko_")
    markup = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit('<b a="1">'), "event_type", F.lit(" & co</b>")))
    return read(spark, sf_dir, "events").select("event_id", R.error_class(message).alias("error_class"), R.secret_mark(F.col("user_id").cast("string")).alias("secret_mark"), R.model_of_file(file).alias("model"), R.escaped(markup).alias("html"))
