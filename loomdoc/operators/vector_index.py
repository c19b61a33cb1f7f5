"""Approximate nearest vectors by an inverted file: vectors stored by the cell of their nearest centroid, of which a search reads a few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that the centroids are trained on at most, queries of a search at most (they are told to all tasks).
SAMPLE, QUERIES = 20_000, 10_000


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """Rows whose vector has ``dims`` components, none null or non-finite."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col(column).isNotNull() & (F.size(column) == dims) & whole)


def train(rows: DataFrame, column: str, dims: int, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors, from at most ``sample`` rows (those of lowest hash)."""
    own = usable(rows, column, dims).select(F.transform(column, lambda x: x.cast("double")).alias("v"))
    own = own.orderBy(F.xxhash64("v")).limit(sample)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = own.filter(norm > 0).select(array_to_vector(F.transform("v", lambda x: x / norm)).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(unit)
    return _unit(np.array(model.clusterCenters(), np.float64))


def build(rows: DataFrame, id_col: str, column: str, centres: np.ndarray, path: str) -> None:
    """Writes every usable vector of ``rows`` to ``path``, a folder a cell."""
    dims = centres.shape[1]
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (_unit(_matrix(b.column(1), dims)) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field(1).type), pa.array(cell, pa.int32())], schema=schema)

    own = usable(rows, column, dims).select(F.col(id_col).cast("bigint").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("v"))
    # the salt lets a large cell go to many tasks
    dealt = own.mapInArrow(run, "id bigint, v array<double>, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.partitionBy("cell").parquet(path)


def search(spark: SparkSession, path: str, queries: DataFrame, id_col: str, column: str, centres: np.ndarray, n: int = 10, probe: int = 8, threshold: float = 0.1) -> DataFrame:
    """``query, id, similarity`` of the ``n`` nearest vectors above ``threshold`` (cosine) among those of the ``probe`` nearest cells of each query; with all cells, of all.

    At most ``QUERIES`` queries, which the tasks share. A task keeps the best ``n`` of each query for a batch; these are merged by query. Cells that no query asks for are not read."""
    dims = centres.shape[1]
    asked = usable(queries, column, dims).select(F.col(id_col).cast("bigint").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("v")).limit(QUERIES + 1).toArrow()
    if asked.num_rows > QUERIES:
        raise ValueError(f"more than {QUERIES} queries: search in parts")
    out = "query bigint, id bigint, similarity double"
    if not asked.num_rows:
        return spark.createDataFrame([], out)
    ids, wanted = np.array(asked.column(0).to_pylist(), np.int64), _unit(_matrix(asked.column(1).combine_chunks(), dims))
    near = np.argsort(-(wanted @ centres.T), axis=1, kind="stable")[:, :probe]
    probed = np.zeros((len(ids), len(centres)), bool)
    np.put_along_axis(probed, near, True, axis=1)
    shared = spark.sparkContext.broadcast((ids, wanted, probed))
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, probed = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own, cells, rows = b.column(0).to_numpy(), b.column(2).to_numpy(), _unit(_matrix(b.column(1), dims))
            for cell in np.unique(cells).tolist():
                at, who = np.flatnonzero(cells == cell), np.flatnonzero(probed[:, cell])
                for start in range(0, len(who), 256):
                    part = who[start : start + 256]
                    scores = wanted[part] @ rows[at].T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :n] if len(at) > n else np.broadcast_to(np.arange(len(at)), scores.shape)
                    kept = np.take_along_axis(scores, best, axis=1)
                    fine = kept > threshold
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], best.shape[1])[fine.ravel()]), pa.array(own[at][best][fine]), pa.array(kept[fine])], schema=schema)

    found = spark.read.schema("id bigint, v array<double>, cell int").parquet(path).filter(F.col("cell").isin(np.unique(near).tolist()))
    best = found.select("id", "v", "cell").mapInArrow(run, out)
    # the planner keeps the best n of each query in each task before the shuffle, and after it
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return best.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
