"""The callable functions of the store, as functions of a session's SQL.

They read the views ``doc_chunks(id, document_id, chunk_index, created_at, filename, ...)`` and ``vectors(id, embedding)``, which the caller registers before; a function whose view is not there is left out. A null argument gives no rows (or null)."""

from __future__ import annotations

from pyspark.sql import SparkSession

COSINE = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"

#: The view that each reads, and its statement.
FUNCTIONS = [
    (None, f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_of(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {COSINE}"),
    # chunks at even distances of the latest version of a file
    ("doc_chunks", """CREATE OR REPLACE TEMPORARY FUNCTION stride_sample(file STRING, n INT) RETURNS TABLE (id STRING, rn BIGINT) RETURN
       WITH latest AS (SELECT max_by(document_id, struct(created_at, document_id)) AS document_id FROM doc_chunks WHERE filename = stride_sample.file),
       own AS (SELECT c.id, CAST(row_number() OVER (ORDER BY chunk_index) AS BIGINT) AS rn, count(*) OVER () AS total FROM doc_chunks c JOIN latest USING (document_id) WHERE c.filename = stride_sample.file)
       SELECT id, rn FROM own WHERE (rn - 1) % greatest(total DIV stride_sample.n, 1) = 0 AND (rn - 1) DIV greatest(total DIV stride_sample.n, 1) < stride_sample.n"""),
    # nearest vectors above a threshold; the planner keeps the best n of each task
    ("vectors", """CREATE OR REPLACE TEMPORARY FUNCTION match_vectors(wanted ARRAY<DOUBLE>, threshold DOUBLE, n INT) RETURNS TABLE (id BIGINT, similarity DOUBLE) RETURN
       SELECT id, similarity FROM (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS r
         FROM (SELECT id, cosine_of(embedding, match_vectors.wanted) AS similarity FROM vectors) WHERE similarity > match_vectors.threshold) WHERE r <= match_vectors.n"""),
    # the level of a path in a hierarchy
    (None, "CREATE OR REPLACE TEMPORARY FUNCTION hierarchy_path(h1 STRING, h2 STRING, h3 STRING) RETURNS STRING RETURN coalesce(nullif(concat_ws(' > ', nullif(h1, ''), nullif(h2, ''), nullif(h3, '')), ''), 'Uncategorized')"),
    # the metadata with three levels in place of its own, null ones too; no object, no value
    (None, """CREATE OR REPLACE TEMPORARY FUNCTION patch_levels(metadata STRING, h1 STRING, h2 STRING, h3 STRING) RETURNS STRING RETURN
       to_json(to_variant_object(map_concat(map_filter(try_variant_get(try_parse_json(metadata), '$', 'map<string,variant>'), (k, v) -> k NOT IN ('h1', 'h2', 'h3')),
         map('h1', coalesce(h1::variant, parse_json('null')), 'h2', coalesce(h2::variant, parse_json('null')), 'h3', coalesce(h3::variant, parse_json('null'))))))"""),
    # what stands at a path, as text
    (None, "CREATE OR REPLACE TEMPORARY FUNCTION json_at(metadata STRING, path STRING) RETURNS STRING RETURN get_json_object(metadata, path)"),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; those that are there are replaced."""
    for view, statement in FUNCTIONS:
        if view is None or spark.catalog.tableExists(view):
            spark.sql(statement)
