"""Queries over chunks: text predicates, filters, sampling, search and block folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.callable import register
from ..operators import blocks, sampling, vector_index
from ..operators.stages import shared_folder
from .adapters import CHUNKS, doc_chunks, read
from .registry import query

NORMAL = r"regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g')"


@query("s04_content_hash", f"SELECT doc_id, sha1({NORMAL}) AS content_hash FROM documents")
def s04_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("s08_contents_flags", r"""WITH d AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, len(regexp_extract_all(text, '\b[0-9]+\.[0-9]+')) AS nums,
  length(text) - length(replace(text, '|', '')) >= 4 AS tab, length(text) - length(replace(text, '·', '')) AS dots,
  greatest(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 1) AS words FROM documents),
 e AS (SELECT *, len(list_filter(l, lambda x: (length(x) - length(replace(x, '·', '')) > 3 OR length(x) - length(replace(x, '.', '')) > 5) AND regexp_matches(right(x, 5), '[0-9]'))) AS led,
  len(list_filter(l, lambda x: (length(x) - length(replace(x, '·', '')) > 5 OR length(x) - length(replace(x, '.', '')) > 5) AND regexp_matches(rtrim(x), '[0-9]$'))) AS led2 FROM d)
 SELECT doc_id, CASE WHEN length(text) < 20 THEN false ELSE (NOT tab AND dots > 10 AND dots > 0.05e0 * length(text)) OR contains(text, '····') OR (NOT tab AND len(l) > 0 AND led >= 0.6e0 * len(l))
   OR (regexp_matches(text, '목[\s\x{3000}\x{A0}]*차') AND nums >= 5) OR (NOT tab AND nums >= 8 AND nums / words::DOUBLE >= 0.05e0 AND len(regexp_extract_all(text, '다\.')) <= 2) END AS contents,
  dots > 20 OR length(text) - length(replace(text, '.', '')) > 50 OR (len(l) > 0 AND led2 > 0.5e0 * len(l)) AS contents_legacy FROM e""")
def s08_contents_flags(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.is_contents(t).alias("contents"), T.is_contents_legacy(t).alias("contents_legacy"))


@query("s10_noise_flags", r"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '[\s|]', '', 'g') AS b FROM documents) SELECT doc_id, CASE WHEN length(text) < 10 THEN false WHEN length(b) = 0 THEN true
  ELSE length(b) >= 15 AND len(regexp_extract_all(b, '[0-9A-Za-z가-힣]')) / length(b)::DOUBLE < 0.15e0 END AS symbols,
  contains(text, '발행일')::INT + contains(text, '발행처')::INT + contains(text, '발행인')::INT + contains(text, '편집')::INT + contains(text, '인쇄')::INT + contains(text, 'ISBN')::INT >= 2 AS colophon FROM d""")
def s10_noise_flags(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.is_symbol_noise(t).alias("symbols"), T.is_colophon(t).alias("colophon"))


TYPE = """CASE WHEN length(content) < 150 AND NOT contains(content, '- ') THEN 'heading' WHEN contains(array_to_string(string_split(content, chr(10))[1:2], chr(10)), '- ') THEN 'list'
  WHEN contains(content, '|') AND contains(content, '-') THEN 'table' ELSE 'body' END"""


@query("s13_chunk_types", f"WITH {CHUNKS} SELECT {TYPE} AS chunk_type, count(*) AS n, sum(length(content))::BIGINT AS chars FROM doc_chunks GROUP BY 1")
def s13_chunk_types(spark, sf_dir):
    return doc_chunks(spark, sf_dir).groupBy(T.chunk_type(F.col("content")).alias("chunk_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("s23_clean_markup", r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '*시행 2024. 1. 1.* ' || text WHEN 1 THEN text || chr(10) || '| --- | --- |' || chr(10) || '----' || chr(10) || ':::' ELSE text END AS text FROM documents)
  SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\*[닫열변삭기시구기터이][^*]*\*', '', 'g'), '(?m)^\|[-\s|]+\|$', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),
  '\\n', chr(10)), '\n', chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS cleaned FROM d""")
def s23_clean_markup(spark, sf_dir):
    """Texts without markup; every fourth with an editor's note, every fourth with a table's rule and lines that only look like one."""
    m, text = F.col("doc_id") % 4, F.col("text")
    own = F.when(m == 0, F.concat(F.lit("*시행 2024. 1. 1.* "), text)).when(m == 1, F.concat(text, F.lit("\n| --- | --- |\n----\n:::"))).otherwise(text)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_markup(own)).alias("cleaned"))


@query("s29_paths", f"WITH {CHUNKS} SELECT coalesce(nullif(concat_ws(' > ', nullif(h1, ''), nullif(h2, ''), nullif(h3, '')), ''), 'Uncategorized') AS path, count(*) AS n FROM doc_chunks GROUP BY 1")
def s29_paths(spark, sf_dir):
    return doc_chunks(spark, sf_dir).groupBy(T.hierarchy_path(F.col("h1"), F.col("h2"), F.col("h3")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("f01_filtered", f"WITH {CHUNKS} SELECT id FROM doc_chunks WHERE filename = 'src3' AND h1 = 'en' AND document_id NOT IN (3, 23)")
def f01_filtered(spark, sf_dir):
    return sampling.matching(doc_chunks(spark, sf_dir), {"filename": "src3", "h1": "en", "h2": None}, "document_id", [3, 23]).select("id")


@query("f07_skip_reasons", f"""WITH {CHUNKS} SELECT CASE WHEN {TYPE} = 'heading' THEN 'heading' WHEN h1 = '__admin__' THEN 'admin' WHEN h1 IS NULL THEN 'untagged' ELSE 'kept' END AS reason, count(*) AS n FROM doc_chunks GROUP BY 1""")
def f07_skip_reasons(spark, sf_dir):
    c = F.col("content")
    reason = F.when(T.chunk_type(c) == "heading", "heading").when(F.col("h1") == "__admin__", "admin").when(T.is_colophon(c), "colophon").when(F.col("h1").isNull() | (F.col("h1") == ""), "untagged").otherwise("kept")
    return doc_chunks(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("r05_repeated_lines", r"""WITH l AS (SELECT DISTINCT doc_id, source, trim(u) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS u FROM documents))
  SELECT source, line, count(*) AS pages FROM l WHERE length(line) > 5 AND NOT regexp_matches(line, '^[|\-: ]+$') GROUP BY 1, 2 HAVING count(*) >= 2""")
def r05_repeated_lines(spark, sf_dir):
    """Lines that stand on several pages of a file (page headers)."""
    return blocks.repeated_lines(read(spark, sf_dir, "documents"), "source", "doc_id", "text", 2)


@query("r11_first_of_hash", f"WITH {CHUNKS} SELECT document_id, content_hash, min(chunk_index) AS chunk_index FROM doc_chunks GROUP BY 1, 2")
def r11_first_of_hash(spark, sf_dir):
    """First chunk of each text within its document, by partial minima."""
    return doc_chunks(spark, sf_dir).groupBy("document_id", "content_hash").agg(F.min("chunk_index").alias("chunk_index"))


@query("r12_short_or_repeated", rf"""WITH {CHUNKS}, c AS (SELECT *, trim(content) AS t FROM doc_chunks), r AS (SELECT *, CASE WHEN length(t) < 60 THEN 'short' END AS reason, row_number() OVER (PARTITION BY document_id, content_hash, length(t) < 60 ORDER BY chunk_index) AS k FROM c)
  SELECT coalesce(reason, CASE WHEN k > 1 THEN 'duplicate' ELSE 'kept' END) AS reason, count(*) AS n FROM r GROUP BY 1""")
def r12_short_or_repeated(spark, sf_dir):
    """Why chunks are dropped; length and repeats within the document here, the noise predicates being silent on these texts."""
    rows = blocks.short_or_repeated(doc_chunks(spark, sf_dir))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("w01_stride_sample", f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rn, count(*) OVER (PARTITION BY document_id) AS total FROM doc_chunks),
  s AS (SELECT *, greatest(total // 4, 1) AS step FROM n) SELECT id, rn FROM s WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 4""")
def w01_stride_sample(spark, sf_dir):
    """Evenly spaced chunks, four of each document, in order."""
    return sampling.stride(doc_chunks(spark, sf_dir), "document_id", "chunk_index", 4).select("id", "rn")


@query("w07_diverse_sample", f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY filename, h1 ORDER BY created_at, chunk_index) AS k FROM doc_chunks WHERE h1 IS NOT NULL AND h1 <> '__admin__')
  SELECT filename, id FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY (k = 1) DESC, created_at, chunk_index) AS r FROM r) WHERE r <= 5""")
def w07_diverse_sample(spark, sf_dir):
    """Five chunks of each file, those that open a new first level before others."""
    return sampling.diverse(doc_chunks(spark, sf_dir).filter("h1 is not null and h1 <> '__admin__'"), "filename", "h1", ["created_at", "chunk_index"], 5).select("filename", "id")


@query("k01_vector_search", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 5) AS similarity
  FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) > 0.1e0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) DESC, vec_id LIMIT 10""")
def k01_vector_search(spark, sf_dir):
    """The ten nearest vectors above a threshold, exactly: one scan, and a bounded heap in each task. Without the vector that is asked for, none."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id = 0 and embedding is not null").first()
    wanted = [float(x) for x in asked["embedding"]] if asked else []
    return sampling.nearest(rows, "embedding", wanted, "vec_id", 0.1, 10).select("vec_id", F.round("similarity", 5).alias("similarity"))


NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS s FROM v q JOIN v ON q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS k FROM p WHERE s > 0.1e0) SELECT query, id, round(s, 5) AS similarity FROM r WHERE k <= 10"""


def indexed(spark, sf_dir, probe):
    """The ten nearest of every hundredth vector, over an index made anew (a table in the shared folder) of 32 cells."""
    rows = read(spark, sf_dir, "embeddings")
    centres, path = vector_index.train(rows, "embedding", 64, 32), shared_folder(spark, "index")
    vector_index.build(rows, "vec_id", "embedding", centres, path)
    found = vector_index.search(spark, path, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", centres, 10, probe)
    return found.select("query", "id", F.round("similarity", 5).alias("similarity"))


@query("k01_match_function", """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)) AS s FROM embeddings)
  SELECT id, round(s, 5) AS similarity FROM s WHERE s > 0.1e0 ORDER BY s DESC, id LIMIT 10""")
def k01_match_function(spark, sf_dir):
    """The nearest vectors of one, by the session's table function."""
    read(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS embedding").createOrReplaceTempView("vectors")
    register(spark)
    asked = spark.table("vectors").filter("id = 0 and embedding is not null").first()
    wanted = asked["embedding"] if asked else None
    return spark.sql("SELECT id, round(similarity, 5) AS similarity FROM match_vectors(:wanted, 0.1D, 10)", args={"wanted": F.array(*map(F.lit, wanted)) if wanted else F.lit(None).cast("array<double>")})


@query("w01_stride_function", f"""WITH {CHUNKS}, v AS (SELECT arg_max(document_id, created_at * 1000000 + document_id) AS document_id FROM doc_chunks WHERE filename = 'src0'), c AS (SELECT c.* FROM doc_chunks c JOIN v USING (document_id) WHERE filename = 'src0'),
  n AS (SELECT *, row_number() OVER (ORDER BY chunk_index) AS rn, greatest(count(*) OVER () // 3, 1) AS step FROM c) SELECT id, rn FROM n WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 3""")
def w01_stride_function(spark, sf_dir):
    """Three chunks at even distances of the latest version of one file, by the session's table function."""
    doc_chunks(spark, sf_dir).createOrReplaceTempView("doc_chunks")
    register(spark)
    return spark.sql("SELECT id, rn FROM stride_sample('src0', 3)")


@query("k01_index_search")
def k01_index_search(spark, sf_dir):
    """Approximate: of each query's 20 nearest cells. These vectors hardly form groups; recall at ten against the exact query is 0.93 to 0.94."""
    return indexed(spark, sf_dir, 20)


@query("k01_index_all_cells", NEAREST)
def k01_index_all_cells(spark, sf_dir):
    """The same index with all cells asked, which is exact."""
    return indexed(spark, sf_dir, 32)


@query("s31_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def s31_norms(spark, sf_dir):
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 5).alias("norm"), F.round(F.element_at(V.normalised(v), 1), 5).alias("first"))


@query("a05_sufficiency", "SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS blocks, length(text) < 300 OR length(text) / len(string_split(text, chr(10)))::DOUBLE < 5 AS rejected FROM documents")
def a05_sufficiency(spark, sf_dir):
    n, b = F.length("text"), F.size(F.split("text", "\n", -1))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("chars"), b.alias("blocks"), ((n < 300) | (n / b < 5)).alias("rejected"))


LINES = "lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), l AS (SELECT doc_id, i - 1 AS i, l[i] AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines))"


def document_lines(spark, sf_dir):
    """Documents with their lines as an array of blocks."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n", -1).alias("lines"))


@query("r04_merged_chunks", rf"""WITH RECURSIVE {LINES}, f AS (SELECT doc_id, i, i AS first, length(t) AS n FROM l WHERE i = 0 UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN f.n < 300 AND f.n + length(l.t) <= 1200 AND NOT regexp_matches(l.t, '^\s*제\s*[0-9]+조') THEN f.first ELSE l.i END,
    CASE WHEN f.n < 300 AND f.n + length(l.t) <= 1200 AND NOT regexp_matches(l.t, '^\s*제\s*[0-9]+조') THEN f.n + 1 ELSE 0 END + length(l.t) FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
  SELECT f.doc_id AS document_id, f.first AS chunk_index, string_agg(l.t, chr(10) ORDER BY l.i) AS content FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i GROUP BY 1, 2""")
def r04_merged_chunks(spark, sf_dir):
    """Short neighbouring chunks of a document merged."""
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", lambda t: blocks.merged(t, 300, 1200), "chunk_index bigint, content string")


BATCHES = f"""{LINES}, f AS (SELECT doc_id, i, 0 AS batch, 1 AS n, length(t) AS c FROM l WHERE i = 0 UNION ALL SELECT l.doc_id, l.i, CASE WHEN f.n >= 30 OR f.c + length(l.t) > 4000 THEN f.batch + 1 ELSE f.batch END,
  CASE WHEN f.n >= 30 OR f.c + length(l.t) > 4000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 30 OR f.c + length(l.t) > 4000 THEN 0 ELSE f.c END + length(l.t) FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)"""


@query("r07_batches", f"WITH RECURSIVE {BATCHES} SELECT doc_id AS document_id, i AS chunk_index, batch FROM f")
def r07_batches(spark, sf_dir):
    """Blocks of a document batched by count and characters."""
    fold = lambda t: list(enumerate(blocks.batched([len(x) for x in t], 30, 4000)))
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", fold, "chunk_index bigint, batch int")


@query("r07_batch_contexts", f"WITH RECURSIVE {BATCHES} SELECT doc_id AS document_id, batch, greatest(min(i) - 5, 0)::INT AS context_from, min(i)::INT AS first, max(i)::INT AS last FROM f GROUP BY 1, 2")
def r07_batch_contexts(spark, sf_dir):
    """Batches with the five blocks before each as its context."""
    fold = lambda t: blocks.batch_ranges([len(x) for x in t], 30, 4000, 5)
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", fold, "batch int, context_from int, first int, last int")


@query("r10_similar_chunks")
def r10_similar_chunks(spark, sf_dir):
    """Chunks of a document kept after absorbing those that share half their words (held against brute force in the tests)."""
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", lambda t: blocks.absorbed(t, 0.5), "chunk_index bigint, content string")


@query("r10_similar_sources")
def r10_similar_sources(spark, sf_dir):
    """The same where chunks also name their source blocks: each line its own and the one before, so neighbours share a third (held against brute force)."""
    fold = lambda t: blocks.absorbed(t, 0.3, [[i - 1, i] for i in range(len(t))])
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", fold, "chunk_index bigint, content string")


@query("r03_block_chunks", rf"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id, i, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM l), k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, t FROM s WHERE t <> ''),
  f AS (SELECT doc_id, i, 0 AS c, length(t) + 1 AS n FROM k WHERE i = 1 UNION ALL SELECT k.doc_id, k.i, f.c + brk::INT, CASE WHEN brk THEN 0 ELSE f.n END + length(k.t) + 1 FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1,
    LATERAL (SELECT regexp_matches(k.t, '^제\s*[0-9]+조') OR (regexp_matches(k.t, '^[①-⑳]') AND f.n >= 150) OR f.n + length(k.t) > 900 AS brk)),
  g AS (SELECT f.doc_id, f.c, string_agg(k.t, chr(10) ORDER BY k.i) AS text, max(f.n) AS n FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i GROUP BY 1, 2),
  h AS (SELECT *, sum((c = 0 OR NOT (n <= 40 AND regexp_matches(text, '^[가-힣]{{1,6}}(한다|된다|이다|있다|없다|말한다|아니한다|합니다|됩니다)[.。]?\s*$')))::INT) OVER (PARTITION BY doc_id ORDER BY c) - 1 AS position FROM g)
  SELECT doc_id AS document_id, position::INT AS position, string_agg(text, chr(10) ORDER BY c) AS content FROM h GROUP BY 1, 2""")
def r03_block_chunks(spark, sf_dir):
    """Blocks of a document put together to chunks of up to 900 characters."""
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", lambda t: list(enumerate(blocks.chunked(t))), "position int, content string")


@query("r09_conjunctions")
def r09_conjunctions(spark, sf_dir):
    """Conjunctions at the end of a chunk moved to the next (Korean; these texts have none, see ``r09_moved``)."""
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", lambda t: list(enumerate(blocks.conjunctions_moved(t))), "position int, content string")


WORDS = "|".join(blocks.CONJUNCTIONS)


@query("r09_moved", rf"""WITH RECURSIVE {LINES}, m AS (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN t || ', 또한' WHEN 1 THEN t || ' 이를 통해 ' ELSE t END AS t, max(i) OVER (PARTITION BY doc_id) AS last FROM l),
  f AS (SELECT doc_id, i, last, CASE WHEN i < last THEN regexp_replace(regexp_replace(t, '[\s,]*(?:{WORDS})\s*$', ''), '\s+$', '') ELSE t END AS content,
      CASE WHEN i < last THEN regexp_replace(regexp_extract(t, '[\s,]*(?:{WORDS})\s*$'), '^[\s,]+|\s+$', '', 'g') ELSE '' END AS carried FROM m WHERE i = 0
    UNION ALL SELECT doc_id, i, last, CASE WHEN i < last AND regexp_matches(t, '[\s,]*(?:{WORDS})\s*$') THEN regexp_replace(regexp_replace(t, '[\s,]*(?:{WORDS})\s*$', ''), '\s+$', '') ELSE t END,
      CASE WHEN i < last THEN regexp_replace(regexp_extract(t, '[\s,]*(?:{WORDS})\s*$'), '^[\s,]+|\s+$', '', 'g') ELSE '' END
      FROM (SELECT m.doc_id, m.i, m.last, CASE WHEN f.carried <> '' THEN f.carried || ' ' || regexp_replace(m.t, '^\s+', '') ELSE m.t END AS t FROM f JOIN m ON m.doc_id = f.doc_id AND m.i = f.i + 1))
  SELECT doc_id AS document_id, i::INT AS position, content FROM f""")
def r09_moved(spark, sf_dir):
    """The same on lines that end with conjunctions (two of three)."""
    ends = F.transform("lines", lambda t, i: F.when(i % 3 == 0, F.concat(t, F.lit(", 또한"))).when(i % 3 == 1, F.concat(t, F.lit(" 이를 통해 "))).otherwise(t))
    rows = document_lines(spark, sf_dir).select("document_id", ends.alias("lines"))
    return blocks.folded(rows, "document_id", "lines", lambda t: list(enumerate(blocks.conjunctions_moved(t))), "position int, content string")


@query("r02_paired")
def r02_paired(spark, sf_dir):
    """Numbers and marks put before the block after them (every third line is made one; held against a plain loop in the tests)."""
    marks = F.array(*[F.lit(x) for x in ("12", "•", "_-", "abc")])
    lines = F.flatten(F.transform("lines", lambda t, i: F.when(i % 3 == 1, F.array(F.element_at(marks, (i % 4 + 1).cast("int")), t)).otherwise(F.array(t))))
    rows = document_lines(spark, sf_dir).select("document_id", lines.alias("lines"))
    return blocks.folded(rows, "document_id", "lines", blocks.paired, "position int, content string")


@query("r08_merged_forward")
def r08_merged_forward(spark, sf_dir):
    """Chunks under 200 characters put before the next, with the union of their source blocks, numbered anew (held against a loop in the tests)."""
    fold = lambda t: [(k, text, sources) for k, (text, sources) in enumerate(blocks.merged_forward([(x, [i // 2, i]) for i, x in enumerate(t)]))]
    return blocks.folded(document_lines(spark, sf_dir), "document_id", "lines", fold, "position int, content string, sources array<int>").select("document_id", "position", "content", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


FONT = "(CASE WHEN chunk_index % 5 = 0 THEN 14 WHEN length(content) < 40 THEN 11 ELSE 10 END)::DOUBLE"


@query("r01_sections", rf"""WITH {CHUNKS}, f AS (SELECT *, {FONT} AS font, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM doc_chunks),
  p AS (SELECT *, coalesce(lag(font) OVER (PARTITION BY document_id ORDER BY chunk_index), 10) AS before FROM f),
  h AS (SELECT *, length(t) BETWEEN 2 AND 100 AND NOT regexp_matches(t, '^([-•Ÿ∙]\s|\([가-힣a-zA-Z])') AND NOT regexp_matches(t, '[·.]{{3,}}') AND NOT regexp_matches(t, '^[0-9]+$')
    AND ((regexp_matches(t, '^[0-9]+\.[0-9]+') AND font >= 10) OR (font > before + 1.5e0 AND font > 12.5e0)) AS opens FROM p),
  s AS (SELECT *, CASE WHEN opens THEN CASE WHEN regexp_matches(t, '^[0-9]+\.[0-9]+\.[0-9]+') THEN 3 WHEN regexp_matches(t, '^[0-9]+\.[0-9]+') THEN 2 WHEN regexp_matches(t, '^\[[^\]]{{2,}}\]') THEN 1 WHEN regexp_matches(t, '^[0-9]+\s+\S') THEN 2 END END AS own,
    sum(opens::INT) OVER (PARTITION BY document_id ORDER BY chunk_index) AS section_id FROM h),
  a AS (SELECT *, last_value(CASE WHEN own IS NOT NULL THEN own * 1000000 + section_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS anchor FROM s)
  SELECT id, section_id::BIGINT AS section_id, CASE WHEN section_id = coalesce(anchor % 1000000, 0) THEN coalesce(anchor // 1000000, 0) ELSE least(coalesce(anchor // 1000000, 0) + section_id - coalesce(anchor % 1000000, 0), 4) END::INT AS level FROM a""")
def r01_sections(spark, sf_dir):
    """Sections and their levels, with fonts made up from places and lengths."""
    font = F.when(F.col("chunk_index") % 5 == 0, 14.0).when(F.length("content") < 40, 11.0).otherwise(10.0)
    return blocks.sections(doc_chunks(spark, sf_dir).withColumn("font", font), "document_id", "chunk_index", "content", "font").select("id", "section_id", "level")


WHITE = r"'^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g'"


@query("s02_joined_lines", rf"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[Ÿÿ\x{{FFFD}}]', '-', 'g'), '[□☐]', '[ ]', 'g'), '[☑✓✔]', '[v]', 'g'), '[⋮⋯⋰⋱]', '', 'g'),
    '(?m)^[ \t]*[•*l][ \t]+', '- ', 'g'), '[ \t]+', ' ', 'g') AS t FROM documents),
  l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, {WHITE})) AS l FROM n)
  SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN l[i] <> '' AND l[i - 1] <> '' AND NOT regexp_matches(l[i - 1], '[.!?。]$') AND NOT regexp_matches(l[i], '^[-•|\[#0-9]') THEN ' ' ELSE chr(10) END || l[i]), ''), {WHITE})) AS joined FROM l""")
def s02_joined_lines(spark, sf_dir):
    """Texts normalised and their lines joined."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalised(F.col("text"))).alias("joined"))


@query("s22_admin_chunks", f"""WITH {CHUNKS} SELECT length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) < 400 AS admin, count(*) AS n FROM doc_chunks GROUP BY 1""")
def s22_admin_chunks(spark, sf_dir):
    """Chunks that hold no Hangul sentence; without any Hangul in these texts, the short ones."""
    return doc_chunks(spark, sf_dir).groupBy(T.is_admin(F.col("content")).alias("admin")).agg(F.count(F.lit(1)).alias("n"))
