"""Passages that occur before with a few words changed, told by banded edit distance around equal anchors.

A *seed* is an anchor of a text (a shingle of ``SHINGLE`` words) with 16-bit hashes of the words around it, ``BEFORE`` before and ``AFTER`` behind.
Each seed meets the first seed with the same shingle (by doc_id, row, place) of another document. Seeds of a document whose first ones lie in one
document, at most ``REACH`` words on and ``GAP`` words off the same diagonal, are linked if the words from one to the next have an edit distance of at most a
tenth of them and the shingle's; so at least four words in five of a chain are equal. Both ends of a chain go on to the last equal word
with an edit distance of at most a fifth of the words. A chain of ``min_words`` words with a change is a passage; those without one are runs of equal grams, told elsewhere.

Two words are taken for equal by mistake once in 65,536; a shingle has 64 bits. Where words of a passage were changed, its seeds are fewer: one of eight equal
words at least, which is an anchor in both texts, is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Words of the shingles among whose hashes anchors are chosen.
SHINGLE = 8
#: Words that may stand more or less between two seeds of a passage.
GAP = 3
BEFORE, AFTER = 24, 32
#: Words from a seed to the next at most.
REACH = SHINGLE + AFTER
WIDTH = BEFORE + REACH
CHAINS = "doc_id bigint, row bigint, n_words int, class_id bigint, first_doc_id bigint, from_unit int, to_unit int"


def windows(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """Of each place ``at`` the hashes of the words around it as bytes; zero where the text, from its start to its end, has none."""
    places = at[:, None] + np.arange(-BEFORE, REACH)
    short = np.maximum((hashes >> np.uint64(48)).astype("<u2"), 1)
    inside = (places >= starts[:, None]) & (places < ends[:, None])
    out = np.where(inside, short[np.clip(places, 0, max(len(short) - 1, 0))], 0).astype("<u2")
    offsets = pa.array(np.arange(0, 2 * out.size + 1, 2 * WIDTH), pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offsets.buffers()[1], pa.py_buffer(out.tobytes())])


def distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two short sequences within a band of ``most``; ``most + 1`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i if i <= most else far] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        row = new
    return row[-1]


def ends(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row of ``own`` by which a passage goes on, to the last one equal to its counterpart in ``other`` with an edit distance of a fifth of
    them at most, and that distance. Zeros equal nothing. The band of distances moves over all rows at once."""
    rows, n = own.shape
    far = np.int8(100)
    # of the first i own words and the first i + s others, for s from -GAP to GAP
    now = [np.full(rows, s if s >= 0 else far, np.int8) for s in range(-GAP, GAP + 1)]
    length, changed = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(1, n + 1):
        before, now = now, []
        best = np.full(rows, far)
        for x in range(2 * GAP + 1):
            j = i + x - GAP
            cell = np.full(rows, far)
            if 0 <= j <= n:
                if x < 2 * GAP:
                    cell = np.minimum(before[x + 1] + np.int8(1), far)
                if j:
                    equal = (own[:, i - 1] == other[:, j - 1]) & (own[:, i - 1] > 0)
                    cell = np.minimum(cell, before[x] + ~equal)
                    best = np.where(equal, np.minimum(best, before[x]), best)
                if x:
                    cell = np.minimum(cell, now[x - 1] + np.int8(1))
            now.append(np.minimum(cell, far))
        good = 5 * best.astype(np.int64) <= i
        length, changed = np.where(good, i, length), np.where(good, best, changed)
    return length, changed


def chains(hits: DataFrame, min_words: int) -> DataFrame:
    """Passages of the hits ``row, doc_id, of, at, shift, gram, first_doc_id, own, other``, each a seed with the words around it and around its first one."""
    names = ["doc_id", "row", "n_words", "class_id", "first_doc_id", "from_unit", "to_unit"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        # key, class, first document, from and changes of the open chain; its last hit: place, shift, both windows, and how it would end
        chain: tuple | None = None
        last: tuple | None = None

        def close() -> None:
            key, gram, first, start, changes = chain
            end, more = last[4]
            n = last[0] + SHINGLE + end - start
            if changes + more and n >= min_words:
                found.append((key[1], key[0], n, gram, first, start, start + n - 1))

        def linked(at: int, shift: int) -> int:
            """Changes from the last hit to this place, or -1."""
            d, s = at - last[0], shift - last[1]
            if not (0 < d <= REACH and 0 < d + s <= REACH and abs(s) <= GAP):
                return -1
            most = (d + SHINGLE) // 10
            a, b = last[2][BEFORE : BEFORE + d], last[3][BEFORE : BEFORE + d + s]
            if s == 0 and (c := int((a != b).sum())) <= most:
                return c
            c = distance(a.tolist(), b.tolist(), most)
            return c if c <= most else -1

        for b in batches:
            if not b.num_rows:
                continue
            own, other = (np.frombuffer(b"".join(b.column(j).to_pylist()), "<u2").reshape(-1, WIDTH) for j in (7, 8))
            left, left_changes = ends(own[:, BEFORE - 1 :: -1], other[:, BEFORE - 1 :: -1])
            right, right_changes = ends(own[:, BEFORE + SHINGLE :], other[:, BEFORE + SHINGLE :])
            row, doc, of, at, shift, gram, first = (b.column(j).to_pylist() for j in range(7))
            for i, key in enumerate(zip(row, doc, of)):
                same = chain is not None and chain[0] == key
                if same and at[i] == last[0]:
                    continue  # of a repeated row
                c = linked(at[i], shift[i]) if same else -1
                if c >= 0:
                    chain = (*chain[:4], chain[4] + c)
                else:
                    if chain is not None:
                        close()
                    chain = (key, gram[i], first[i], at[i] - int(left[i]), int(left_changes[i]))
                last = (at[i], shift[i], own[i], other[i], (int(right[i]), int(right_changes[i])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate(types)], schema=schema)
                found = []
        if chain is not None:
            close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate(types)], schema=schema)

    rows = hits.select("row", "doc_id", "of", "at", "shift", "gram", "first_doc_id", "own", "other").repartition("row").sortWithinPartitions("row", "doc_id", "of", "at")
    return rows.mapInArrow(run, CHAINS)


def edited_passages(seeds: DataFrame, sketched: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, row, line, n_words, class_id, first_doc_id, from_unit, to_unit`` of the passages of ``seeds(gram, doc_id, row, at, around)``.

    Repeated rows are one row. Only the first copy of a seed is looked at, so work grows with the seeds, whatever the size of their groups; a document's
    passage goes only for one of an earlier document. Seeds with the same words all around on both sides lie in runs of equal grams and are left out."""
    firsts = seeds.groupBy("gram").agg(F.min(F.struct("doc_id", "row", "at", "around")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "first")
    firsts = written(firsts, "seeds")
    met = seeds.join(firsts, "gram").filter((F.struct("doc_id", "row") != F.struct("first.doc_id", "first.row")) & (F.col("around") != F.col("first.around")))
    hits = met.select("row", "doc_id", F.xxhash64("first.doc_id", "first.row").alias("of"), "at", (F.col("first.at") - F.col("at")).alias("shift"), "gram", F.col("first.doc_id").alias("first_doc_id"), F.col("around").alias("own"), F.col("first.around").alias("other"))
    found = written(chains(hits, min_words), "edited")
    removed(firsts)
    # the line in which a passage starts, from the words of each line
    docs = sketched.filter("line < 0").select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "counts")
    line = F.expr("aggregate(counts, struct(0 AS words, 0 AS line), (a, n) -> struct(a.words + n AS words, a.line + int(a.words + n <= from_unit) AS line), a -> a.line)")
    lined = found.join(docs, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "row", line.alias("line"), "n_words", "from_unit", "to_unit", F.struct("first_doc_id", "class_id").alias("of"))
    one = lined.groupBy("doc_id", "row", "line", "n_words", "from_unit", "to_unit").agg(F.min("of").alias("of"))
    return one.select("doc_id", "row", "line", "n_words", "of.class_id", "of.first_doc_id", "from_unit", "to_unit")
