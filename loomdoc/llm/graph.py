"""Connected components of an edge table, by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` and their node's least neighbour. The join has a key besides the node, so it is dealt apart from the sums before it, and the
    adaptive planner may split the rows of a hot node."""
    return rows.withColumn("h", F.xxhash64("u")).join(least.withColumn("h", F.xxhash64("u")), ["u", "h"])


def large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = with_least(down, least).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)`` (bigint): root is the smallest node of its component.

    Each round is a written table, so a lost executor costs a round at most. Sums of a hot node's links are made before
    the shuffle; a hot node's rows in the join are split by the adaptive planner. Self-links and repeated links do no harm; an
    empty table gives no rows."""
    now = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    if before[0]:
        for _ in range(most_rounds):
            now = written(small_star(large_star(now)), "links")
            if (after := mark(now)) == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
