"""Similarity join of documents by the Jaccard similarity of their word n-grams, over prefix trees.

A set's n-grams are 62-bit hashes in one global order: common ones last, else by hash. Sets of at least the similarity share one of the first ``n - ceil(t n) + 1``
of each (the prefix), so the join meets them by those. Three steps, each whole:

1. Equal sets are one. Sets that share a MinHash band stand in shards, where a prefix tree of whole sets joins those that are similar. This
   finds nearly all links, but not for certain.
2. N-grams that are common among those of low hashes, or in sets with many such ones, come last in the order (the commonest, a bounded number, are told to all tasks; any order gives the same links).
   Each n-gram's sets (those with it in their prefix) meet in shards, unless all are joined already; a prefix tree of the prefixes alone (upper bits of their
   order keys) gives the pairs that may still be similar. Equal member lists are one. With the order fixed, this loses no pair.
3. These pairs are compared exactly, and all links make the components.

N-grams of very many prefixes are dealt: the sets apart from the n-gram's largest component meet all of its sets in blocks of bounded size.

Cases: null text counts as empty; documents without words are linked with nothing (zero n-grams, their own component); fewer words than an n-gram are one n-gram; null doc_ids are kept and
count in a component only if nothing else is there; repeated rows stay apart; empty tables give no rows. Other columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import BANDS, MIX, ROWS, WordHashes, set_hashes, shards
from .common import removed, slices, written
from .graph import components
from .prefix_tree import Member, candidates, similar
from .simhash import row_id, words_of

#: Members of a shard at about most.
MOST = 400
#: An n-gram is common from so many sets on; so many of the commonest are told to all tasks (1.6 MB).
COMMON, TOLD = 100, 200_000
#: Set in the order keys of common n-grams.
LATE = np.uint64(1 << 62)


def grams(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Distinct n-grams of a text, as rising 62-bit hashes."""
    return np.unique(set_hashes(words_of(text or ""), k, known) >> np.uint64(2))


def digest(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def prefix_length(n: int, num: int, den: int) -> int:
    return n + num * n // -den + 1 if n else 0


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64)))


def extended(n: int, num: int, den: int) -> int:
    """N-grams that a sketch keeps: the prefix, what may take the places of common ones, and the next one."""
    p = prefix_length(n, num, den)
    return p + p // 8 + 4


def band_keys(own: np.ndarray) -> np.ndarray:
    """MinHash bands of a set by one permutation: of each residue's n-grams, the three lowest (of the set's lowest 128)."""
    low = own[:128]
    of = (low % np.uint64(BANDS)).astype(np.int64)
    order, counts = np.argsort(of, kind="stable"), np.bincount(of, minlength=BANDS)
    starts, keys = np.cumsum(counts) - counts, np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        at = np.minimum(starts + np.minimum(j, np.maximum(counts, 1) - 1), len(low) - 1)
        keys = (keys ^ low[order[at]]) * MIX
        keys ^= keys >> np.uint64(32)
    return keys[counts > 0].view(np.int64)


def sketches(documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, row, n, node, bands, low``: node identifies the set (null if empty); low are its lowest n-grams (see ``extended``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            sets = [grams(t, k, known) for t in b.column(2).to_pylist()]
            bands = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            low = [s[: extended(len(s), num, den)] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), lists(bands), lists(low)], schema=schema)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, row binary, n bigint, node binary, bands array<bigint>, low array<bigint>")


def sets_of(documents: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``id, grams`` of ``nodes(id, row)``, from the texts of their rows."""
    schema = pa.schema([("id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), lists([grams(t, k, known) for t in b.column(1).to_pylist()])], schema=schema)

    docs = documents.select(row_id().alias("row"), F.col("text").cast("string").alias("text"))
    return docs.join(nodes.select("id", "row"), "row").dropDuplicates(["row"]).select("id", "text").mapInArrow(run, "id bigint, grams array<bigint>")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with one value in the first column, without it. A task holds one at a time."""
    last, members = None, []
    for b in batches:
        columns = [b.column(j) for j in range(b.num_columns)]
        rest = [c.to_pylist() if not pa.types.is_list(c.type) else [x.values.to_numpy() if x.is_valid else None for x in c] for c in columns]
        for shard, *row in zip(*rest):
            if shard != last and members:
                yield members
                members = []
            last = shard
            members.append(row)
    if members:
        yield members


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pairs_of(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], schema=PAIR)


def in_shards(members: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``others`` (by id) in each list of ``members``, list after list."""
    rows = members.select(F.xxhash64("members").alias("shard"), F.explode("members").alias("id")).join(others, "id")
    return rows.select("shard", *others.columns).repartition("shard").sortWithinPartitions("shard")


def whole_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links in shards of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shard(batches):
            yield pairs_of(similar([Member(id_, len(own), own.tolist()) for id_, own in rows], num, den))

    return in_shards(members, sets.select("id", "grams")).mapInArrow(run, "a bigint, b bigint")


def told(rows: DataFrame) -> np.ndarray:
    """The commonest n-grams of ``rows(gram)``, a bounded number."""
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON)
    found = counts.orderBy(F.desc("n"), "gram").limit(TOLD).select("gram").toArrow()
    return np.sort(found.column(0).to_numpy())


def packed(order: np.ndarray) -> bytes:
    """The upper 24 bits of order keys, byte by byte of them (rising numbers, so that the first bytes compress well)."""
    return (order >> np.uint64(39)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].T.tobytes()


def known_part(own: bytes, n: int) -> tuple[list[int], float]:
    """Numbers that stand for the n-grams of a prefix, and a limit below which they are all of the set's. Different n-grams with one number only make sets look more alike."""
    planes = np.frombuffer(own, np.uint8).reshape(3, -1)
    upper = (planes[0].astype(np.int32) << 16) | (planes[1].astype(np.int32) << 8) | planes[2]
    numbers = upper[np.flatnonzero(np.diff(upper, prepend=-1))].tolist()
    return (numbers, inf) if n <= len(upper) else (numbers[:-1], numbers[-1])


def late_marks(low: pa.ListArray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a column of lists in one row, which of them are common, and where each list starts (and the last ends)."""
    flat, starts = low.flatten().to_numpy(), low.offsets.to_numpy()
    if not len(common):
        return flat, np.zeros(len(flat), bool), starts - starts[0]
    return flat, common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] == flat, starts - starts[0]


def short_of(rows: DataFrame, common: np.ndarray, num: int, den: int) -> DataFrame:
    """``id`` of ``rows(id, n, low)`` whose low n-grams do not tell the prefix, with the common ones last."""
    shared = rows.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            _, late, starts = late_marks(b.column(2), shared.value)
            sums = np.concatenate([[0], np.cumsum(~late)])
            short = (np.diff(starts) < n) & (sums[starts[1:]] - sums[starts[:-1]] < n + num * n // -den + 2)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(short))], schema=schema)

    return rows.select("id", "n", "low").mapInArrow(run, "id bigint")


def prefixes_of(rows: DataFrame, common: np.ndarray, num: int, den: int) -> DataFrame:
    """``id, n, prefix, packed`` of ``rows(id, n, low)``, none of them short, with the common n-grams last in the order."""
    shared = rows.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, late, starts = late_marks(b.column(2), shared.value)
            order, out, own = np.where(late, flat.view(np.uint64) | LATE, flat.view(np.uint64)), [], []
            moved = np.add.reduceat(np.append(late, False), starts[:-1]) if len(starts) > 1 else []
            for n, a, z, some in zip(b.column(1).to_pylist(), starts.tolist(), starts[1:].tolist(), moved):
                p, x = prefix_length(n, num, den), order[a:z]
                if some:
                    x = np.concatenate([x[~late[a:z]], x[late[a:z]]])
                out.append(x[:p])
                own.append(packed(x[: p + 1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(out), pa.array(own, pa.binary())], schema=schema)

    return rows.select("id", "n", "low").mapInArrow(run, "id bigint, n bigint, prefix array<bigint>, packed binary")


def shared_lists(prefixes: DataFrame, most: int) -> DataFrame:
    """Member lists (at most about ``most`` ids) of the n-grams in the prefixes of sets with different roots. ``prefixes(id, root, prefix)``."""
    rows = prefixes.select(F.explode("prefix").alias("gram"), "id", "root")
    groups = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"), F.min("root").alias("low"), F.max("root").alias("high")).filter("cnt > 1 and low != high")
    groups = written(groups.select("gram", "cnt"), "mixed")
    members = written(rows.join(groups, "gram"), "members")
    small = members.filter(F.col("cnt") <= most).groupBy("gram").agg(F.sort_array(F.collect_list("id")).alias("members")).select("members")
    large = members.filter(F.col("cnt") > most)
    if large.isEmpty():
        return small.distinct()
    half = max(1, most // 2)
    sums = large.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sums.groupBy("gram").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / half).cast("int").alias("rest"))
    every = large.join(written(main, "main"), "gram").withColumn("parts", F.ceil(F.col("cnt") / half).cast("int"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c)).cast("int")
    whole = every.select("gram", block("parts", 0).alias("block"), spread("rest").alias("other"), "id")
    apart = every.filter("root != main").select("gram", spread("parts").alias("block"), block("rest", 1).alias("other"), "id")
    dealt = whole.union(apart).groupBy("gram", "block", "other").agg(F.sort_array(F.collect_set("id")).alias("members")).filter("size(members) > 1")
    return small.union(dealt.select("members")).distinct()


def comparable(rows: list[tuple], num: int, den: int) -> list[tuple]:
    """The rows ``(id, n, ...)``, by size, that have another of a size that allows the similarity: the smaller set is at least ``num / den`` of the larger."""
    rows.sort(key=lambda x: (x[1], x[0]))
    near = [den * a[1] >= num * b[1] for a, b in zip(rows, rows[1:])]
    return [x for x, before, after in zip(rows, [False, *near], [*near, False]) if before or after]


def open_pairs(members: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with different roots in a shard that may be similar, by their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_shard(batches):
            rows = comparable(rows, num, den)
            found = candidates([Member(id_, n, *known_part(own, n)) for id_, n, _, own in rows], [x[2] for x in rows], num, den)
            if found:
                yield pairs_of([(min(x), max(x)) for x in found])

    return in_shards(members, prefixes.select("id", "n", "root", "packed")).mapInArrow(run, "a bigint, b bigint")


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=PAIR).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b")
    return rows.mapInArrow(run, "a bigint, b bigint")


def link_documents(documents: DataFrame, k: int = 4, num: int = 85, den: int = 100, most: int = MOST) -> DataFrame:
    """``doc_id, n_shingles, component_id``: size of the set of ``k``-word n-grams, and the smallest doc_id that links of similarity ``num / den`` reach."""
    own = written(sketches(documents, k, num, den), "sketches")
    firsts = own.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("first"), F.min("row").alias("row"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    # numbers of the different sets; the written table fixes them
    distinct = written(firsts.withColumn("id", F.monotonically_increasing_id()), "distinct")
    docs = written(own.select("doc_id", "n", "node"), "documents")
    removed(own)

    shard_lists, _ = shards(distinct.select(F.explode(F.array_distinct("bands")).alias("key"), F.col("id").alias("node")), most)
    shard_lists = written(shard_lists, "shards")
    common = told(distinct.select(F.explode("low").alias("gram")))
    short = written(short_of(distinct, common, num, den), "short")
    wanted = shard_lists.select(F.explode("members").alias("id")).union(short).distinct()
    sets = written(sets_of(documents, distinct.join(wanted, "id", "left_semi"), k), "sets")
    found = written(components(written(whole_links(shard_lists, sets, num, den), "whole")), "components")

    common = np.union1d(common, told(sets.join(short, "id", "left_semi").select(F.explode("grams").alias("gram"))))
    short = written(short_of(distinct, common, num, den), "short")
    late = sets
    if not (more := written(short.join(sets, "id", "left_anti"), "more")).isEmpty():
        late = sets.union(written(sets_of(documents, distinct.join(more, "id", "left_semi"), k), "sets"))
    late = late.join(short, "id", "left_semi").select("id", F.size("grams").cast("bigint").alias("n"), F.col("grams").alias("low"))
    prefixes = prefixes_of(distinct.join(short, "id", "left_anti").select("id", "n", "low").union(late), common, num, den)
    roots = found.select(F.col("node").alias("id"), "root")
    prefixes = written(prefixes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    removed(sets)
    members = written(shared_lists(prefixes, most), "lists")
    pairs = written(open_pairs(members, prefixes, num, den).distinct(), "open")
    removed(prefixes)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(sets_of(documents, distinct.join(nodes, "id", "left_semi"), k), "sets")
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(compared(pairs, sets, num, den))

    found = components(links)
    rooted = distinct.select("id", "node", "first").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = written(rooted.join(least, "root").select("node", "component_id"), "labels")
    removed(sets)
    removed(distinct)
    return docs.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
