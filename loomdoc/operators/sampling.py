"""Selection of chunks: filters, stride and diverse samples, exact vector search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine


def matching(rows: DataFrame, equal: dict, id_col: str, exclude: list | None = None) -> DataFrame:
    """Rows that equal every value given (None: any) and whose id is not excluded."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    if exclude:
        tests.append(~F.col(id_col).isin(exclude))
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def stride(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each group at even distances (every ``max(total div n, 1)``-th, from the first), with their number ``rn``."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("rn", F.row_number().over(w.orderBy(order)).cast("bigint")).withColumn("total", F.count(F.lit(1)).over(w))
    step = F.greatest(F.expr(f"total div {n}"), F.lit(1))
    return numbered.filter((F.col("rn") - 1) % step == 0).filter((F.col("rn") - 1) / step < n).drop("total")


def diverse(rows: DataFrame, group: str, kind: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows of each group: the first of each kind, then the others, both in order.

    Only the first ``n`` of a kind can be chosen, so others go before the rows of a group meet."""
    by_kind = rows.withColumn("k", F.row_number().over(Window.partitionBy(group, kind).orderBy(*order))).filter(F.col("k") <= n)
    return by_kind.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy((F.col("k") == 1).desc(), *order))).filter(F.col("r") <= n).drop("k", "r")


def nearest(rows: DataFrame, column: str, wanted: list[float], id_col: str, threshold: float, n: int) -> DataFrame:
    """The ``n`` rows with the highest cosine similarity above ``threshold``, ties by id."""
    if not wanted:
        return rows.withColumn("similarity", F.lit(0.0)).limit(0)
    scored = rows.withColumn("similarity", cosine(F.col(column), F.array(*[F.lit(x) for x in wanted])))
    return scored.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), id_col).limit(n)


def anchors(rows: DataFrame, group: str, order: str, admin: Column, sample: int = 40, least: int = 10, n: int = 30, text: str = "content") -> DataFrame:
    """Anchor rows of each group with ``cut``, their text cut to its share of 20,000 characters (400 at least): ``sample`` at even distances, without
    admin rows if ``least`` are left, the first ``n``. At most ``sample`` rows of a group meet in the windows that follow."""
    w = Window.partitionBy(group)
    chosen = stride(rows, group, order, sample).withColumn("_admin", admin)
    chosen = chosen.withColumn("_enough", F.count_if(~F.col("_admin")).over(w) >= least).filter(~F.col("_enough") | ~F.col("_admin"))
    chosen = chosen.withColumn("_r", F.row_number().over(w.orderBy("rn"))).filter(F.col("_r") <= n).withColumn("_n", F.count(F.lit(1)).over(w))
    share = F.greatest(F.lit(400), F.expr("cast(20000 div _n as int)"))
    return chosen.withColumn("cut", F.substr(text, F.lit(1), share)).drop("_admin", "_enough", "_r", "_n")


def containing(rows: DataFrame, column: str, wanted: dict) -> DataFrame:
    """Rows whose JSON object in ``column`` has every key of ``wanted`` with its value (text, number or truth value). Broken JSON contains nothing."""
    kinds = {str: "string", bool: "boolean", int: "bigint", float: "double"}
    parsed = F.try_parse_json(column)
    for key, value in wanted.items():
        rows = rows.filter(F.try_variant_get(parsed, f"$.{key}", kinds[type(value)]) == F.lit(value))
    return rows


def scan(rows: DataFrame, columns: list[str], order: list[str], cap: int | None) -> DataFrame:
    """Some columns of the first ``cap`` rows, or of all: each task keeps its own first ones, and only those are merged."""
    return rows.select(*columns) if cap is None else rows.orderBy(*order).limit(cap).select(*columns)
