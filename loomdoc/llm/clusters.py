"""Links between similar texts that share a key: bounded shards, exact verification, no list of all pairs.

Texts that share a key (a MinHash band) form a group. A group of at most ``most`` texts is a shard. A larger one is dealt into
shards by a hash, each with the group's first text as pivot; texts that end up apart from the pivot's component are compared
with the whole group in a second round. So every pair of a group is either compared, or joined through others already.
Inside a shard a text is compared with the texts found near it (see ``link_members``) unless it is joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import BKTree
from .common import written
from .graph import components

SHARD = 400
#: Words whose hashes a task keeps.
KEPT = 250_000
BANDS, ROWS = 8, 3
#: Odd multipliers and offsets of the MinHash permutations, on the upper 32 bits of a hash.
_RANDOM = np.random.default_rng(20240607)
FACTORS = _RANDOM.integers(2**27, 2**31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _RANDOM.integers(0, 2**32, size=BANDS * ROWS, dtype=np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Word shingles, repeats included; the whole sequence where there are fewer than ``k`` words, none where there are no words."""
    if len(words) >= k:
        return [b" ".join(x) for x in zip(*[words[j:] for j in range(k)])]
    return [b" ".join(words)] if words else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    own = xxhash.xxh64_intdigest
    return np.array([own(s, 42) for s in shingles(words, k)], dtype=np.uint64)


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each (non-empty) set of shingle hashes."""
    return band_keys_of(np.concatenate(hashes), np.cumsum([0, *map(len, hashes)])[:-1])


def band_keys_of(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same of sets that stand one after another in ``flat`` and begin at ``starts``; all sets at once, permutation by permutation."""
    own = (flat >> np.uint64(32)).astype(np.uint32)
    lows, mixed = np.empty((BANDS * ROWS, len(starts)), dtype=np.uint32), np.empty_like(own)
    for j in range(BANDS * ROWS):
        np.bitwise_xor(own, OFFSETS[j], out=mixed)
        np.multiply(mixed, FACTORS[j], out=mixed)
        np.minimum.reduceat(mixed, starts, out=lows[j])
    keys = np.zeros((BANDS, len(starts)), dtype=np.uint64)
    for j in range(ROWS):
        keys = (keys ^ lows[j::ROWS]) * MIX
        keys ^= keys >> np.uint64(32)
    return np.ascontiguousarray((keys + np.arange(BANDS, dtype=np.uint64)[:, None]).T).view(np.int64)


class WordHashes(dict):
    """Hashes of words, kept for up to ``KEPT`` of them."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"), 3)
        return out


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """``x[i + by]`` at i; zero beyond the end."""
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, given their hashes."""
    out, have, power, width = None, 0, words, 1
    mixed = lambda a, b: (x := (a * MIX + b) * MIX) ^ (x >> np.uint64(32))
    while True:
        if n & width:
            out = power if out is None else mixed(out, shifted(power, have))
            have += width
        if have == n:
            return out
        power, width = mixed(power, shifted(power, width)), 2 * width


def set_hashes(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the word shingles (see ``shingles``) made of those of their words."""
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    return gram_hashes(own, n)[: len(words) - n + 1] if n else own


class Joined:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def link_members(members: list[tuple[int, int | None, str]], k: int, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links (node, first node of its component) between members ``(node, fingerprint, text)`` of a shard.

    With fingerprints, a member's candidates come from a BK-tree of those before it, nearest first; else all before it."""
    members = sorted(members)
    sets: list = [None] * len(members)
    joined, tree = Joined(len(members)), BKTree()

    def own(i: int) -> frozenset:
        if sets[i] is None:
            sets[i] = frozenset(shingles(members[i][2].encode("utf-8", "surrogatepass").lower().split(), k))
        return sets[i]

    for i, (_, mark, _) in enumerate(members):
        near = [j for _, j in sorted(tree.near(mark, radius))] if mark is not None else range(i - 1, -1, -1)
        for j in near:
            if joined.root(i) != joined.root(j):
                a, b = own(i), own(j)
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                    both = len(a & b)
                    if both >= similarity * (len(a) + len(b) - both):
                        joined.join(i, j)
        if mark is not None:
            tree.add(mark, i)
    return [(members[i][0], members[r][0]) for i in range(len(members)) if (r := joined.root(i)) != i]


def shards(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Member lists, without repeats, of at most about ``most`` nodes, and the groups ``key, cnt, pivot`` that were larger."""
    groups = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("node").alias("pivot")).filter("cnt > 1")
    groups = written(groups, "groups")
    blocks = F.ceil(F.col("cnt") / most).cast("int")
    dealt = pairs.join(groups, "key").select("key", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node")
    large = groups.filter(F.col("cnt") > most)
    pivots = large.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("pivot").alias("node"))
    lists = dealt.union(pivots).groupBy("key", "block").agg(F.sort_array(F.collect_set("node")).alias("members"))
    return lists.filter(F.size("members") > 1).select("members").distinct(), large


def verified(lists: DataFrame, texts: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Links ``a, b`` of the shards; ``texts`` has ``node, mark, text``. A task holds one shard at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], schema=schema)

        for b in batches:
            for shard, node, mark, text in zip(*(b.column(j).to_pylist() for j in range(4))):
                if shard != last and members:
                    yield out(link_members(members, k, similarity, radius))
                    members = []
                last = shard
                members.append((node, None if mark is None else mark & (2**64 - 1), text))
        if members:
            yield out(link_members(members, k, similarity, radius))

    rows = lists.select(F.xxhash64("members").alias("shard"), F.explode("members").alias("node")).join(texts.select("node", "mark", "text"), "node")
    rows = rows.select("shard", "node", "mark", "text").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "a bigint, b bigint")


def similar_components(pairs: DataFrame, texts_of, k: int = 5, similarity: float = 0.8, radius: int = 24, most: int = SHARD) -> DataFrame:
    """``node, root`` of nodes joined by links of at least ``similarity`` between nodes that share a key.

    ``pairs(key, node)`` has each pair once; ``texts_of(nodes)`` gives ``node, mark, text`` of the nodes in a one-column table."""
    lists, large = shards(pairs, most)
    lists = written(lists, "shards")
    nodes = lists.select(F.explode("members").alias("node")).distinct()
    texts = written(texts_of(nodes), "texts")
    links = written(verified(lists, texts, k, similarity, radius), "verified")
    found = components(links)
    if large.isEmpty():
        return found
    found = written(found, "components")
    # second round: members of a large group that are apart from its pivot, against all its members
    rooted = pairs.join(large, "key").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = large.join(found, large["pivot"] == found["node"], "left").select("key", F.coalesce("root", "pivot").alias("main"))
    rooted = written(rooted.join(main, "key").select("key", "node", "cnt", (F.col("root") != F.col("main")).alias("apart")), "rooted")
    half = max(1, most // 2)
    apart = rooted.filter("apart").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("rest"))
    if apart.isEmpty():
        return found
    parts = F.ceil(F.col("cnt") / half).cast("int")
    every = rooted.join(apart, "key")
    whole = every.select("key", F.pmod(F.xxhash64("node"), parts).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("other"), "node")
    rest = every.filter("apart").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest")).cast("int").alias("other"), "node")
    more = whole.union(rest).groupBy("key", "block", "other").agg(F.sort_array(F.collect_set("node")).alias("members")).filter("size(members) > 1").select("members").distinct()
    again = verified(more, texts, k, similarity, radius)
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(again))
