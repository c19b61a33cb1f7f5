"""Exact k-means over integer vectors, with clusters as balls (Ball k-means).

A round moves the centroids and assigns each vector again. The members of a cluster that a task holds are a ball around its new centroid, whose radius is the
distance of the farthest. Only centroids less than two radii away are neighbours. A member nearer to its centroid than half the way to the nearest
neighbour is in the stable core and stays without another distance; the others lie in rings, the i-th of which compares with its i nearest neighbours.
All bounds are of whole numbers, so the result equals that of comparing all.

Each round is a written table of the vectors with their clusters, and of each task's sums by cluster; the one before is deleted. The driver sees ``k`` sums a round.

Cases: vectors that are null, of another length, or with a null, non-finite or very large component (32,768 and more, whose squared distances may pass a long) are left out; a null vec_id counts
as an empty string in the starting hash; equal hashes go by the components; with fewer than ``k`` vectors there are as many centroids; repeated rows stay apart;
empty tables give no rows. Other columns are not passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Integer components stay below this.
MOST = 2**25


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.square(rows - centre).sum(axis=1)


def assign_all(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (of ties the first), squared distance, and how many distances were made."""
    every = np.stack([squared(rows, c) for c in centres], axis=1)
    best = every.argmin(axis=1)
    return best, every[np.arange(len(rows)), best], every.size


def assign_balls(rows: np.ndarray, before: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same, given the clusters of the round before."""
    between = np.stack([squared(centres, c) for c in centres])
    best, least, made = before.copy(), np.empty(len(rows), np.int64), len(rows)
    for own in np.unique(before).tolist():
        at = np.flatnonzero(before == own)
        members = rows[at]
        mine = squared(members, centres[own])
        # twice the radius, squared: a centroid as far may be as near to the farthest member
        near = np.flatnonzero(between[own] <= 4 * mine.max())
        near = near[near != own]
        near = near[np.argsort(between[own][near], kind="stable")]
        rings = np.searchsorted(between[own][near], 4 * mine, "right")
        to, dist = np.full(len(at), own), mine.copy()
        for i, other in enumerate(near.tolist()):
            outer = np.flatnonzero(rings > i)
            if not len(outer):
                break
            made += len(outer)
            d = squared(members[outer], centres[other])
            closer = (d < dist[outer]) | ((d == dist[outer]) & (other < to[outer]))
            to[outer[closer]], dist[outer[closer]] = other, d[closer]
        best[at], least[at] = to, dist
    return best, least, made


STATE = "vec_id bigint, v array<int>, cluster int, distance bigint, n bigint, sums array<bigint>, made bigint"


def assigned(points: DataFrame, centres: np.ndarray, first: bool) -> DataFrame:
    """``points`` with cluster and distance, and a row for each task and cluster with the number ``n``, the ``sums`` of the components and (in ``distance``) of the distances."""
    k, dims = centres.shape
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    schema = pa.schema(list(zip(["vec_id", "v", "cluster", "distance", "n", "sums", "made"], kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, sums, made = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dims)
            best, least, n = assign_all(rows, centres) if first else assign_balls(rows, b.column(2).to_numpy().astype(np.int64), centres)
            made += n
            for j in np.unique(best).tolist():
                own = best == j
                count[j] += own.sum()
                far[j] += least[own].sum()
                sums[j] += rows[own].sum(axis=0)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(kinds[1]), pa.array(best, pa.int32()), pa.array(least), *(pa.nulls(m, t) for t in kinds[4:])], schema=schema)
        if used := np.flatnonzero(count).tolist():
            m = len(used)
            own = [pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), pa.array(used, kinds[2]), pa.array(far[used]), pa.array(count[used]), pa.array(sums[used].tolist(), kinds[5]), pa.array([made] + [0] * (m - 1), kinds[6])]
            yield pa.RecordBatch.from_arrays(own, schema=schema)

    return points.select("vec_id", "v", "cluster").mapInArrow(run, STATE)


def integer_vectors(embeddings: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors kept."""
    limit = MOST / scale
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    kept = embeddings.filter(F.col(column).isNotNull() & (F.size(column) == dims) & whole)
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector kept, after ``rounds`` rounds and a last assignment."""
    points = integer_vectors(embeddings, dims, scale, column).withColumn("cluster", F.lit(None).cast("int"))
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r["v"] for r in points.select(own.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return embeddings.sparkSession.createDataFrame([], out)
    centres, state = np.array(start, np.int64), None
    for r in range(rounds + 1):
        before, state = state, written(assigned(points if state is None else state.filter("n is null"), centres, state is None), "balls")
        totals = state.filter("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("far"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims)]).alias("sums"))
        found = totals.collect()
        if before is not None:
            removed(before)
        if r < rounds:
            for x in found:
                centres[x["cluster"]] = [s // x["n"] for s in x["sums"]]
    # k rows, as literals
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    far = {x["cluster"]: x["far"] for x in found}
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return state.filter("n is null").select(
        "vec_id", "cluster", "distance", of([far.get(j, 0) for j in range(len(centres))]).cast("bigint").alias("cluster_inertia"), F.lit(sum(far.values())).cast("bigint").alias("inertia"), of(marks).alias("centroid_sha256")
    )
