"""SimHash near-duplicates, found with BK-trees.

*Links at a Hamming radius.* Distinct fingerprints are dealt into shards whose members agree on one of ``radius + 1`` bands of
bits: two fingerprints within the radius differ in at most ``radius`` bits, so they agree on a band and meet in a shard. A
shard too large for one tree is dealt again by bands of its free bits, which keeps every link, until it is small enough
(always, as free bits run out). Each shard is a BK-tree whose search follows only edges within the radius; the trees reach
the tasks by the shuffle, not through the driver. Links become components.

*Near-duplicate documents.* For links at a Jaccard similarity of word shingles, shards are documents that share a MinHash
band; the BK-tree over their fingerprints proposes candidates, nearest first, and shingle sets verify them.

Cases: null text counts as empty; texts without words have fingerprint zero and link like any other; null doc_ids are kept (in a
component they count only if nothing else is there); repeated rows stay apart in ``link_documents`` and are one document in
``drop_near_duplicates``. Empty tables give no rows. Other columns are passed on by ``drop_near_duplicates`` under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .clusters import Joined, WordHashes, band_keys, set_hashes, shingle_hashes, similar_components
from .common import free_name, slices, written

BITS = 64


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint_documents(documents: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, fp`` (fp as signed bigint) of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = [signed(fingerprint(shingle_hashes(words_of(t or ""), k))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64())], schema=schema)

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, fp bigint")


def sub_masks(mask: int, parts: int) -> list[int]:
    """Masks that fix, besides the bits of ``mask``, one of ``parts`` bands of its free bits."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    bands = [free[len(free) * j // parts : len(free) * (j + 1) // parts] for j in range(parts)]
    return [mask | sum(1 << i for i in band) for band in bands]


def shard_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, smallest member of its component) within the radius, by a BK-tree."""
    members = sorted(members)
    tree, joined = BKTree(), Joined(len(members))
    for i, m in enumerate(members):
        m &= 2**64 - 1
        for _, j in tree.near(m, radius):
            joined.join(i, j)
        tree.add(m, i)
    return [(members[i], members[r]) for i in range(len(members)) if (r := joined.root(i)) != i]


def near_links(fingerprints: DataFrame, radius: int = 2, most: int = 512) -> DataFrame:
    """Links ``a, b`` that join all of the distinct ``fp`` within ``radius`` of each other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = [x for members in b.column(0).to_pylist() for x in shard_links(members, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], schema=schema)

    todo, masks, out = fingerprints.select("fp", F.lit(0).cast("bigint").alias("mask")), [0], []
    while True:
        below = {m: sub_masks(m, radius + 1) for m in masks}
        choice = F.create_map(*[x for m, subs in below.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(s)) for s in subs]))])
        keyed = todo.select("fp", F.explode(F.element_at(choice, F.col("mask"))).alias("mask"))
        keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        hot = written(keyed.groupBy("mask", "value").count().filter(F.col("count") > most).select("mask", "value"), "hot")
        more = not hot.isEmpty()
        cold = keyed.join(hot, ["mask", "value"], "left_anti") if more else keyed
        lists = cold.groupBy("mask", "value").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
        out.append(written(lists.select("members").mapInArrow(run, "a bigint, b bigint"), "near"))
        if not more:
            break
        # only masks with a shard to deal again go on
        masks = sorted(r["mask"] & (2**64 - 1) for r in hot.select("mask").distinct().collect())
        todo = written(keyed.join(hot, ["mask", "value"], "left_semi").select("fp", "mask").distinct(), "again")
    links = out[0]
    for x in out[1:]:
        links = links.union(x)
    return links.distinct()


def link_documents(documents: DataFrame, k: int = 3, radius: int = 2, most: int = 512) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable over links within ``radius``)."""
    marked = written(fingerprint_documents(documents, k), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = _labelled(distinct, near_links(distinct, radius, most))
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(distinct: DataFrame, links: DataFrame) -> DataFrame:
    from .graph import components

    found = components(links)
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def row_id() -> Column:
    """Tells rows apart by doc_id and text, in 128 bits; repeated rows are one."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = lambda *parts: F.lpad(F.hex(F.xxhash64(*parts)), 16, "0")
    return F.unhex(F.concat(half(doc_id, text), half(text, doc_id, F.lit(1))))


def sketches(documents: DataFrame, k: int = 5) -> DataFrame:
    """``doc_id, row, node, mark, bands``: row identifies the row (see ``row_id``), node its words; mark is the SimHash fingerprint of the distinct and
    bands are the MinHash keys of the ``k``-word shingles (none for a text without words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("node", pa.int64()), ("mark", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches):
            nodes, marks, hashes = [], [], []
            for t in b.column(2).to_pylist():
                words = words_of(t or "")
                own = set_hashes(words, k, known)
                nodes.append(signed(xxhash.xxh64_intdigest(b" ".join(words), 7)))
                marks.append(signed(fingerprint(np.unique(own))))
                hashes.append(own)
            full = [h for h in hashes if len(h)]
            keys = iter(band_keys(full).tolist()) if full else iter(())
            bands = [next(keys) if len(h) else [] for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(marks, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, row binary, node bigint, mark bigint, bands array<bigint>")


def near_duplicate_groups(documents: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 24, most: int = 400, *, own: DataFrame | None = None) -> DataFrame:
    """``node, root, doc_id, row``: for each distinct text (by its words) its group and its first document.

    Texts are told apart by 64-bit hashes. ``own`` are the sketches, where they are written already."""
    own = written(sketches(documents, k), "sketches") if own is None else own
    distinct = own.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("mark").alias("mark"), F.first("bands").alias("bands"))
    distinct = written(distinct, "distinct")
    pairs = distinct.select(F.explode("bands").alias("key"), "node")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = distinct.join(nodes, "node", "left_semi").select("node", "mark", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))
        docs = documents.select(row_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
        return docs.join(wanted, "row").dropDuplicates(["row"]).select("node", "mark", "text")

    found = similar_components(pairs, texts_of, k, similarity, radius, most)
    joined = distinct.join(found, "node", "left")
    return joined.select("node", F.coalesce("root", "node").alias("root"), "first.doc_id", "first.row")


def drop_near_duplicates(documents: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``documents``, all columns, without near-duplicates: of each group the row with the smallest doc_id stays."""
    name = free_name(documents, "_row")
    own = written(sketches(documents, k), "sketches")
    groups = near_duplicate_groups(documents, k, similarity, own=own)
    repeated = own.groupBy("row").count().filter("count > 1").select("row", F.lit(True).alias("again"))
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("kept")).select("kept.row").join(repeated, "row", "left")
    kept = written(kept.select(F.col("row").alias(name), F.col("again").isNotNull().alias("again")), "kept")
    rows = documents.withColumn(name, row_id())
    once = rows.join(kept.filter("not again").select(name), name, "left_semi")
    if kept.filter("again").isEmpty():
        return once.select(*documents.columns)
    # only rows that are repeated as a whole are dealt again to leave one of each
    again = rows.join(kept.filter("again").select(name), name, "left_semi").dropDuplicates([name])
    return once.union(again).select(*documents.columns)
