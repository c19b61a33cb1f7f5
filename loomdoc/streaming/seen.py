"""Bloom filters of stored keys, a table a batch: they tell which keys of a new batch may be stored, without reading the stored rows.

All probes of a key lie in one word of 64 bits, so a filter is rows of a word's number and its bits, made by one aggregation and asked by one join, both on the JVM.
A key costs some four bytes, where its stored row has fifty and more. A key that is stored is always found; of others about one in 200 is taken for stored, which the exact comparison mends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each key, and the bits that a key sets.
BITS, PROBES = 24, 4


def words_of(n: int) -> int:
    """Words of a filter of ``n`` keys: a power of four, so that filters have few sizes."""
    words = 1
    while words * 64 < n * BITS:
        words *= 4
    return words


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _mask(h: Column) -> Column:
    # the upper bits choose the probes, the lower ones the word
    places = [F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES)]
    mask = F.lit(0).cast("bigint")
    for p in places:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p))
    return mask


def add(rows: DataFrame, keys: list[str], path: str, batch: int) -> None:
    """Writes the filter of a batch's keys in place of the one it had; ``rows`` are read twice, so they are a stored table."""
    words = words_of(rows.count())
    h = _hash(keys)
    made = rows.select(h.bitwiseAND(F.lit(words - 1)).alias("word"), _mask(h).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    made.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/batch={batch}/words={words}")
    # a filter of another size may be there from a try before
    _only(rows.sparkSession, f"{path}/batch={batch}", f"words={words}")


def _only(spark: SparkSession, folder: str, name: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in store.listStatus(place):
        if s.getPath().getName().startswith("words=") and s.getPath().getName() != name:
            store.delete(s.getPath(), True)


def possible(rows: DataFrame, keys: list[str], path: str, batch: int) -> DataFrame:
    """The rows whose keys other batches than ``batch`` may hold; a null in a key is like any value."""
    spark = rows.sparkSession
    filters = spark.read.schema("word bigint, bits bigint, batch bigint, words bigint").option("basePath", path).parquet(path).filter(F.col("batch") != batch)
    # at most a size for each power of four; only folder names are read
    sizes = sorted(r["words"] for r in filters.select("words").distinct().collect())
    if not sizes:
        return rows.limit(0)
    h = _hash(keys)
    asked = rows.withColumn("_words", F.explode(F.array(*[F.lit(w).cast("bigint") for w in sizes])))
    asked = asked.withColumn("_word", h.bitwiseAND(F.col("_words") - 1)).withColumn("_mask", _mask(h))
    hit = (asked["_words"] == filters["words"]) & (asked["_word"] == filters["word"]) & (filters["bits"].bitwiseAND(asked["_mask"]) == asked["_mask"])
    return asked.join(filters, hit, "left_semi").select(*rows.columns).distinct()
