"""Incremental ingestion: chunks of arriving documents are appended to a table unless it has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators.store import new_rows
from . import seen

PREFIX = 2
TABLE = "document_id bigint, chunk_index int, content string, content_hash string, batch bigint, prefix string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder in whatever store the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def chunks_of(documents: DataFrame) -> DataFrame:
    """A chunk a line, with its hash."""
    lines = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    return lines.withColumn("content_hash", content_hash(F.col("content")))


def batches_at(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches that have a folder at ``path``."""
    if not exists(spark, path):
        return set()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath().getName() for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    return {int(n.removeprefix("batch=")) for n in found if n.startswith("batch=")}


def append_new(chunks: DataFrame, path: str, batch: int) -> list[str]:
    """Appends chunks that the table at ``path`` doesn't hold; each batch is a folder of its own, overwritten when it is tried again. Returns the prefixes read.

    The table is partitioned by the first hex digits of the hashes. Filters of the earlier batches tell which chunks may be there, and only the prefixes of those are
    read and compared exactly; of a batch of new chunks that is next to nothing. Where a batch has no filter (written before there were any), all prefixes of the new one are read."""
    spark = chunks.sparkSession
    keys = ["content_hash", "document_id"]
    first = chunks.groupBy("content_hash", "document_id").agg(F.min_by(F.struct("chunk_index", "content"), "chunk_index").alias("c")).select("document_id", "c.chunk_index", "c.content", "content_hash")
    first = first.withColumn("prefix", F.substring("content_hash", 1, PREFIX))
    known = spark.createDataFrame([], "content_hash string, document_id bigint")
    wanted: list[str] = []
    if others := batches_at(spark, f"{path}/batches") - {batch}:
        filtered = others <= batches_at(spark, f"{path}/filters")
        asked = seen.possible(first.select(*keys, "prefix"), keys, f"{path}/filters", batch) if filtered else first
        # at most 16 ** PREFIX values
        wanted = sorted(r["prefix"] for r in asked.select("prefix").distinct().collect() if r["prefix"] is not None)
        table = spark.read.schema(TABLE).option("basePath", f"{path}/batches").parquet(f"{path}/batches")
        known = table.filter(F.col("prefix").isin(wanted) & (F.col("batch") != batch)).select(*keys)
    rows = new_rows(first, known, keys)
    own = f"{path}/batches/batch={batch}"
    rows.select("document_id", "chunk_index", "content", "content_hash", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(own)
    stored = spark.read.schema(TABLE).option("basePath", f"{path}/batches").parquet(own)
    seen.add(stored.select(*keys), keys, f"{path}/filters", batch)
    return wanted


def ingest(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over a stream of ``documents(doc_id, text)`` until what is there now is in the table at ``path``."""
    writer = chunks_of(documents).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, batch: append_new(rows, path, batch) and None).start()
