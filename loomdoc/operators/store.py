"""Writes and checks of stored tables, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .stages import saved


def new_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``old``; rows with a null key are always new."""
    return new.join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; of a row in both, fields absent (null) in ``new`` keep their old values."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest])
    return o.join(new, keys, "full").select(*keys, *[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in rest])


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` replaced where ``changes`` has their key, also by null."""
    c = changes.select(key, F.struct(*columns).alias("_change"))
    out = rows.join(c, key, "left")
    return out.select(*[F.when(F.col("_change").isNotNull(), F.col(f"_change.{n}")).otherwise(F.col(n)).alias(n) if n in columns else F.col(n) for n in rows.columns])


def latest(rows: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """The key with the latest time of each group, of ties the largest."""
    return rows.groupBy(group).agg(F.max(F.struct(at, key)).alias("_top")).select(group, F.col(f"_top.{key}").alias(key))


def without_any(rows: DataFrame, key: str, ids: str, other: DataFrame, id_col: str) -> DataFrame:
    """Keys of ``rows`` none of whose ``ids`` is in ``other``."""
    known = rows.select(key, F.explode(ids).alias("_id")).join(other.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    return rows.select(key).join(known.select(key), key, "left_anti")


def violations(rows: DataFrame, key: str, broken: dict[str, Column]) -> DataFrame:
    """``key, violated`` of rows that break a rule, with the first rule broken."""
    first = F.coalesce(*[F.when(c, F.lit(name)) for name, c in broken.items()])
    return rows.select(key, first.alias("violated")).filter("violated is not null")


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key: a filter, which file statistics and buckets prune."""
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def without_blank(rows: DataFrame, column: str) -> DataFrame:
    """Blank values of a column as null; others stay as they are."""
    return rows.withColumn(column, F.when(T.strip(F.col(column)) != "", F.col(column)))


def positions(rows: DataFrame, order: str, name: str = "number", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 1 by ``order`` (nulls first; equal values in any order), however dense its values are.

    Spark deals the rows into ranges (bounds from its sample) and sorts each; the written table keeps the range and the place in it. A count a range gives the offsets,
    as many rows as ranges, which are broadcast. No task sees more than a range."""
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the low 33 bits number the rows of a partition, in their order
    place = F.monotonically_increasing_id()
    dealt = saved(rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_place", place), "ranges")
    ranged = dealt.withColumn("_range", F.shiftright("_place", 33))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    # at most ``parts`` rows
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_one").orderBy("_range")) - F.col("_n")).select("_range", "_before")
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_place", "_before")


def numbered(rows: DataFrame, group: str, order: str, start: int, name: str = "chunk_index") -> DataFrame:
    """Rows of each group numbered from ``start`` on."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1 + start).cast("bigint"))


def delete_statements(rows: DataFrame, key: str, table: str, size: int) -> DataFrame:
    """``batch, n, statement``: statements that delete rows by key, ``size`` keys each."""
    batches = positions(rows.select(key), key).groupBy(F.floor((F.col("number") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(key)).alias("_keys"))
    listed = F.array_join(F.col("_keys").cast("array<string>"), ", ")
    return batches.select("batch", F.size("_keys").cast("bigint").alias("n"), F.concat(F.lit(f"DELETE FROM {table} WHERE id IN ("), listed, F.lit(");")).alias("statement"))
