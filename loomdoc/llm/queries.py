"""The queries of the operators of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, balls, digest, html_extract, middle, mixing, mjpeg, ngram_join, ordinal, packing, passages, pieces, simhash
from .common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), fill=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(read(spark, sf_dir, "documents"), k=3, radius=2)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages with their class and the document of the first copy, which is not listed itself."""
    return passages.repeats(read(spark, sf_dir, "documents")).filter("not keep").drop("row", "keep")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.read_back(mjpeg.store_texts(read(spark, sf_dir, "documents")))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each whole text, and the hash of the text that they decode to."""
    decoded = pieces.decode(pieces.encode(read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_chars", "n_pieces", "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut of each whole text, the hash of its output, and the hash of the text rebuilt from the output."""
    cut = middle.fill_in_middle(read(spark, sf_dir, "documents"))
    restored = middle.restored(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def kmeans_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Rounds of assignment and means, all distances compared."""
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts += [
            f"d{r} AS (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM kept, c{r})",
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, cluster, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)",
            f"s{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY ALL)",
            f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster)",
            f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON o.cluster = m.cluster)",
        ]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a{rounds}.cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.cluster = c{rounds}.cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_repeats": op5_repeats,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_media": op8_media,
    "op9_pieces": op9_pieces,
    "op10_quality": op10_quality,
    "op11_ngram_join": op11_ngram_join,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": """
WITH counts AS (SELECT source AS s, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (SELECT s, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM counts),
terms AS (SELECT s, rate, k, exp(k * ln(rate) - rate - (SELECT coalesce(sum(ln(i)), 0) FROM range(1, k + 1) t(i))) AS p
  FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates)),
steps AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
counted AS (SELECT d.*, (SELECT count(*) FROM steps WHERE steps.s IS NOT DISTINCT FROM d.source
    AND c <= ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) AS n
  FROM documents d),
copies AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1))::INTEGER AS copy FROM counted WHERE n > 0)
SELECT *, md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS mix_key FROM copies
""",
    "op11_ngram_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON doc_id = a
""",
    "op12_ball_kmeans": kmeans_sql(),
    "op13_fill_in_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, list_transform(range(4), lambda j: ('0x' || substr(sha256('1:' || doc_id), 8 * j + 1, 8))::BIGINT) AS h FROM documents),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, i) AS prefix, substr(t, i + 1, j - i) AS middle, substr(t, j + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END::INTEGER AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END::INTEGER AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
}
