"""Words put into the cells of tables by their boxes: a grid join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how far a word may stand out of its cell, in points.
MARGIN = 2.0
#: Side of the grid's squares, in points.
SIDE = 64.0


def _squares(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))


def words_in_cells(cells: DataFrame, words: DataFrame, page: str, keys: list[str], order: list[str], margin: float = MARGIN, side: float = SIDE) -> DataFrame:
    """``page``, ``keys`` and ``text`` of the ``cells(page, keys, x0, y0, x1, y1)`` that hold words: those of ``words(page, order, x0, y0, x1, y1, word)`` whose box lies in the
    cell's, but for ``margin``, in ``order`` with blanks between.

    A word stands in the square of its upper left corner, a cell in the squares that such a corner may be in, and both are joined by page and square, so a page of many words goes to many tasks.
    A word in two cells (their margins overlap) is in both. Boxes with a null or the wrong way round hold nothing."""
    own = cells.select(F.col(page).alias("_page"), *keys, *[F.col(c).cast("double").alias(f"_c{c}") for c in ("x0", "y0", "x1", "y1")])
    own = own.filter("_cx0 <= _cx1 and _cy0 <= _cy1")
    own = own.withColumn("_gx", _squares(F.col("_cx0") - margin, F.col("_cx1") + margin, side)).withColumn("_gy", _squares(F.col("_cy0") - margin, F.col("_cy1") + margin, side))
    put = words.select(F.col(page).alias("_page"), F.struct(*order).alias("_order"), "word", *[F.col(c).cast("double").alias(f"_w{c}") for c in ("x0", "y0", "x1", "y1")])
    put = put.withColumn("_gx", F.floor(F.col("_wx0") / side)).withColumn("_gy", F.floor(F.col("_wy0") / side))
    # the planner knows only the size of the cells before they are dealt to squares, and would broadcast them, so each task would hold all
    met = own.hint("merge").join(put, ["_page", "_gx", "_gy"])
    inside = (F.col("_cx0") - margin <= F.col("_wx0")) & (F.col("_wx1") <= F.col("_cx1") + margin) & (F.col("_cy0") - margin <= F.col("_wy0")) & (F.col("_wy1") <= F.col("_cy1") + margin)
    found = met.filter(inside).groupBy(F.col("_page").alias(page), *keys).agg(F.array_sort(F.collect_list(F.struct("_order", "word"))).alias("_words"))
    return found.select(page, *keys, F.array_join("_words.word", " ").alias("text"))


def patched(cells: DataFrame, words: DataFrame, page: str, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """``cells`` with a null ``text`` filled by the words that lie in the cell; cells with a text, also an empty one, keep it."""
    found = words_in_cells(cells.filter(F.col(text).isNull()), words, page, keys, order).withColumnRenamed("text", "_found")
    return cells.join(found, [page, *keys], "left").withColumn(text, F.coalesce(text, "_found")).drop("_found")
