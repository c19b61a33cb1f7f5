"""Exports of evaluated pairs: tidy tables for spreadsheets, and JSON with two-decimal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from . import evaluate


def two_decimals(column: str):
    return F.when(F.col(column).isNotNull(), F.format_string("%.2f", F.col(column).cast("double")))


def json_rows(items: DataFrame, scores: list[str]) -> DataFrame:
    """``json`` of each item, its scores as strings with two decimals."""
    rest = [F.col(c) for c in items.columns if c not in scores]
    return items.select(F.to_json(F.struct(*rest, *[two_decimals(c).alias(c) for c in scores])).alias("json"))


def statistics(items: DataFrame, scores: list[str]) -> DataFrame:
    """``metric, mean, lowest, highest`` of each score: the statistics sheet."""
    tall = items.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in scores])).alias("x")).select("x.*")
    return tall.groupBy("metric").agg(F.round(F.avg("v"), 3).alias("mean"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


def detail(items: DataFrame, evaluated: Column) -> DataFrame:
    """The detail sheet: a row an item with labels, scores of two decimals, its state and the label of its first failure (- if none). Missing texts are empty."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    failure = F.coalesce(R.label(evaluate.primary_failure(F.col("types")), R.FAILURE_LABELS), F.lit("-"))
    return items.select(
        "qa_id", R.label(F.col("intent"), R.INTENT_LABELS).alias("intent"), text("context"), F.col("q").alias("question"), F.coalesce("a", F.lit("")).alias("answer"),
        two_decimals("avg_quality").alias("quality"), two_decimals("rag").alias("triad"), R.label(evaluate.status(), R.STATUS_LABELS).alias("status"), failure.alias("failure"), evaluated.alias("evaluated"),
    )


def write_sheets(items: DataFrame, scores: list[str], folder: str) -> None:
    """The sheets ``stats`` and ``detail`` as CSV folders with headers."""
    statistics(items, scores).write.csv(f"{folder}/stats", header=True)
    items.write.csv(f"{folder}/detail", header=True)


def deletion_plan(ids: DataFrame, id_col: str, table: str, size: int = 100) -> DataFrame:
    """``batch, statement``: deletions of ``size`` ids or so each. Ids are dealt to batches by hash; no list of all is made."""
    total = ids.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("bigint").alias("_n"))
    dealt = ids.crossJoin(F.broadcast(total)).withColumn("batch", F.pmod(F.xxhash64(id_col), F.col("_n")))
    quoted = F.concat(F.lit("'"), F.replace(F.col(id_col).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    lists = dealt.groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list(quoted)), ", ").alias("_ids"))
    return lists.select("batch", F.concat(F.lit(f"DELETE FROM {table} WHERE {id_col} IN ("), "_ids", F.lit(");")).alias("statement"))
