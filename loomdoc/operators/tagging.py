"""Tags of a model for the chunks of a file: batches of entries that go to it, and its answers read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import store
from .json_objects import elements, members

#: Fixed value: chunks of a batch.
BATCH = 5
LEVELS = ("h1", "h2", "h3")


def batches(chunks: DataFrame, file: str, order: list[str], size: int = BATCH) -> DataFrame:
    """``file, batch, idx`` with the columns of ``chunks``: those of a file in their order, ``size`` a batch, idx from 0 in each.

    Numbers come from ranges of the whole table and the first number of each file, so a file with a third of all rows is many tasks."""
    numbered = store.positions(chunks.withColumn("_order", F.struct(file, *order)), "_order", "_number")
    firsts = numbered.groupBy(file).agg(F.min("_number").alias("_first"))
    # null files are one file
    f = firsts.select(F.col(file).alias("_file"), "_first")
    place = F.col("_number") - F.col("_first")
    rows = numbered.join(f, F.col(file).eqNullSafe(F.col("_file")))
    return rows.select(*chunks.columns, F.floor(place / size).cast("bigint").alias("batch"), (place % size).cast("int").alias("idx"))


def entry(idx: Column, content: Column, kind: Column, title: Column) -> Column:
    """What the model sees of a chunk: idx, content, chunk_type (body if null), char_length, and section_title unless it is blank."""
    own = T.strip(title)
    return F.struct(idx.alias("idx"), content.alias("content"), F.coalesce(kind, F.lit("body")).alias("chunk_type"), F.length(content).alias("char_length"), F.when(own != "", own).alias("section_title"))


def requests(rows: DataFrame, file: str, entries: Column) -> DataFrame:
    """``file, batch, size, entries``: the entries of each batch (rows of ``batches``) as JSON, in their order; absent titles are left out."""
    listed = F.sort_array(F.collect_list(entries))
    return rows.groupBy(file, "batch").agg(F.count(F.lit(1)).cast("int").alias("size"), F.to_json(listed).alias("entries"))


def answers(rows: DataFrame, size: str, answer: str, keep: list[str]) -> DataFrame:
    """``keep, idx, h1, h2, h3`` of each item of the answers: JSON lists of ``{idx, hierarchy: {h1, h2, h3}}``.

    An item whose idx is no whole number, or not below the batch's size, is left out; one below zero counts from the end, and too far below fails its batch. An answer that is no
    JSON, or with an item that is no object, or a hierarchy that is given and is no object, fails as a whole: none of its items counts. A missing hierarchy empties all levels.
    Of items with the same idx the last counts."""
    items = elements(F.try_parse_json(answer))
    idx = lambda x: F.when(F.schema_of_variant(F.try_element_at(members(x), F.lit("idx"))) == "BIGINT", F.try_variant_get(x, "$.idx", "bigint"))
    own = lambda x: F.try_element_at(members(x), F.lit("hierarchy"))
    n = F.col(size)
    valid = lambda x: F.coalesce(idx(x) < n, F.lit(False))
    broken = lambda x: members(x).isNull() | (valid(x) & ((idx(x) < -n) | (own(x).isNotNull() & members(own(x)).isNull())))
    good = F.when(F.col("_items").isNotNull() & ~F.exists("_items", broken), F.filter("_items", valid))
    seen = rows.withColumn("_items", items).select(*keep, n.alias("_size"), F.posexplode(good).alias("_at", "_item"))
    level = lambda h: F.try_variant_get(F.try_element_at(members(own(F.col("_item"))), F.lit(h)), "$", "string").alias(h)
    flat = seen.select(*keep, F.pmod(idx(F.col("_item")), F.col("_size")).cast("int").alias("idx"), "_at", F.struct(*[level(h) for h in LEVELS]).alias("_levels"))
    last = flat.groupBy(*keep, "idx").agg(F.max_by("_levels", "_at").alias("_levels"))
    return last.select(*keep, "idx", *[F.col(f"_levels.{h}").alias(h) for h in LEVELS])


def tagged(rows: DataFrame, found: DataFrame, file: str) -> DataFrame:
    """Rows of ``batches`` with the levels of their tags in place of their own; those without a tag stay. A chunk is known by file, batch and idx."""
    tags = found.select(F.col(file).alias("_file"), F.col("batch").alias("_b"), F.col("idx").alias("_i"), F.struct(*LEVELS).alias("_tags"))
    out = rows.join(tags, F.col(file).eqNullSafe(F.col("_file")) & (F.col("batch") == F.col("_b")) & (F.col("idx") == F.col("_i")), "left")
    return out.select(*[F.when(F.col("_tags").isNotNull(), F.col(f"_tags.{c}")).otherwise(F.col(c)).alias(c) if c in LEVELS else F.col(c) for c in rows.columns])
