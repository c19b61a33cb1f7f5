"""Repeated passages.

*Paragraphs* (lines of at least ``min_words`` words) that share a MinHash band are compared; those whose five-word shingles
have a Jaccard similarity of 0.8 or more are linked, links become components, and of a component the first paragraph (by
doc_id, then line) stays. Bands: 8 of 3 rows, so a pair at similarity 0.8 shares one with probability 0.997.

*Passages.* The words of a text are one sequence, whatever lines they stand in, and where a passage stands must not matter. So every
``min_words`` words in a row are a paragraph too (a gram), each overlapping the next. Its band is a MinHash of one row, the smallest hash of
its short shingles (its anchor): equal grams always collide, and as neighbours mostly share it, there is about one anchor in ten words.
Grams that collide are joined and verified by all of their words; a repeated one occurs elsewhere before, exactly but for case and white space.
Overlapping and adjoining repeated grams form a run, exact to the word. Runs up to ``GAP`` words apart whose first copies
lie as far apart in one document are one passage with an edit distance of ``GAP`` words at most between them.
Passages with a few words changed, which may have no equal gram at all, are told from their anchors (see ``edited``). Those and runs may overlap, but none lies in another.
The first copy of a gram (by doc_id, then place) stays; copies that lie in paragraphs that go count only if there is no other.

Cases: null text counts as empty; repeated rows are one row; null doc_ids come first; empty tables give no rows. Other columns
are passed on by ``drop_repeats``. A document of which nothing is left goes; lines without repeats stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import BANDS, WordHashes, band_keys_of, gram_hashes, shifted, similar_components
from .common import cleared, free_name, removed, slices, written
from .edited import GAP, SHINGLE, edited_passages, windows

MIN_WORDS = 25
LEAST = -(2**63)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def row_hash() -> Column:
    """With the doc_id, it tells rows apart; repeated rows are one."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["row"] == b["row"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slid(x: np.ndarray, n: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of the ``n`` values from each place on."""
    width = 1
    while 2 * width <= n:
        x, width = least(x, shifted(x, width)), 2 * width
    return least(x, shifted(x, n - width)) if n > width else x


class Words:
    """The words of a batch of texts in one row: hashes, and for each its text, line, place in the text and the end of the text."""

    def __init__(self, texts: list[str], hashes: WordHashes) -> None:
        words: list[str] = []
        counts, lines, own = [], [], []
        for t in texts:
            before, split = len(words), t.lower().split("\n")
            for line in split:
                w = line.split()
                words += w
                counts.append(len(w))
            lines.append(len(split))
            own.append(len(words) - before)
        self.n, self.words = len(words), words
        self.hashes = np.fromiter(map(hashes.__getitem__, words), np.uint64, self.n)
        self.text = np.repeat(np.arange(len(texts)), own)
        starts = np.cumsum([0, *own])[:-1]
        self.at = np.arange(self.n) - np.repeat(starts, own)
        first_lines = np.cumsum([0, *lines])[:-1]
        #: lines numbered over the batch, and in their texts
        self.line_of_batch = np.repeat(np.arange(len(counts)), counts)
        self.line = self.line_of_batch - np.repeat(first_lines, own)
        self.first_lines, self.lines, self.counts = first_lines, len(counts), np.array(counts)
        self.end = np.repeat(np.cumsum(own), own)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Short shingles, the anchor of the gram of ``n`` words from each place on (zero where none fits), and where one fits."""
        k = min(SHINGLE, n)
        short = gram_hashes(self.hashes, k) | np.uint64(1)
        fits = np.arange(self.n) + n <= self.end
        return short, np.where(fits, slid(short, n - k + 1, np.minimum), np.uint64(0)), fits

    def anchors(self, n: int) -> np.ndarray:
        """Places of the shingles that are anchors of grams of ``n`` words, and the shingles."""
        short, least, _ = self.grams(n)
        # the grams around a shingle have no larger anchors, so it is one's anchor if it is the largest of theirs
        width = n - min(SHINGLE, n)
        chosen = np.flatnonzero(slid(np.concatenate([np.zeros(width, np.uint64), least]), width + 1, np.maximum)[: self.n] == short)
        return chosen, short[chosen]

    def paragraphs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and number of words of the lines of at least ``least`` words, and hashes of their words in order."""
        chosen = self.counts >= max(least, 1)
        starts, counts = (np.cumsum(self.counts) - self.counts)[chosen], self.counts[chosen]
        if not len(starts):
            return starts, counts, np.zeros(0, np.int64)
        inside = np.repeat(chosen, self.counts)
        at, own = np.flatnonzero(inside), self.hashes[inside]
        ends = np.cumsum(counts)
        # a polynomial of the words' hashes, by their places in the line
        powers = np.multiply.accumulate(np.full(int(counts.max()), FACTOR))
        nodes = np.add.reduceat(own * powers[at - np.repeat(starts, counts)], ends - counts) * FACTOR
        return starts, counts, (nodes ^ (nodes >> np.uint64(29))).view(np.int64)

    def band_keys(self, starts: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
        """Band keys of the shingles of ``k`` words (or of all, where there are fewer) of each of these lines."""
        size = np.minimum(counts, k)
        out = np.empty((len(starts), BANDS), np.int64)
        for n in np.unique(size).tolist():
            short, own = gram_hashes(self.hashes, n), size == n
            sizes = counts[own] - n + 1
            begins = np.cumsum(sizes) - sizes
            places = np.arange(int(sizes.sum())) + np.repeat(starts[own] - begins, sizes)
            out[own] = band_keys_of(short[places], begins)
        return out


SKETCHES = "doc_id bigint, row bigint, line int, n_words int, node bigint, bands array<bigint>, anchors array<bigint>, counts array<int>, copy_of binary"


def sketches(documents: DataFrame, k: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """Of each line of at least ``min_words`` words ``doc_id, row, line, n_words, node, bands`` (node identifies its words), and of each document
    a row with line -1, its ``anchors``, place by place, the words of each line (``counts``) and a hash of the text (``copy_of``). All in one pass over the words."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("n_words", pa.int32()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("copy_of", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, 1_000_000):
            w = Words(b.column(2).to_pylist(), hashes)
            if not w.n:
                continue
            starts, counts, nodes = w.paragraphs(min_words)
            if n := len(starts):
                keys, of = w.band_keys(starts, counts, k), pa.array(w.text[starts])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                columns = [b.column(0).take(of), b.column(1).take(of), pa.array(w.line[starts], pa.int32()), pa.array(counts, pa.int32()), pa.array(nodes), bands, *(pa.nulls(n, f.type) for f in list(schema)[6:])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            chosen, anchors = w.anchors(min_words)
            if len(chosen):
                texts, sizes = np.unique(w.text[chosen], return_counts=True)
                own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(anchors.view(np.int64)))
                of, m = pa.array(texts), len(texts)
                counts = pa.ListArray.from_arrays(pa.array([*w.first_lines, w.lines], pa.int32()), pa.array(w.counts, pa.int32())).take(of)
                keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in b.column(2).take(of).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.full(m, -1), pa.int32()), *(pa.nulls(m, f.type) for f in list(schema)[3:6]), own, counts, pa.array(keys)], schema=schema)

    return _rows(documents).mapInArrow(run, SKETCHES)


def paragraph_texts(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, 1_000_000):
            w = Words(b.column(2).to_pylist(), hashes)
            starts, counts, nodes = w.paragraphs(min_words)
            if len(starts):
                own = [" ".join(w.words[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(own, pa.string())], schema=schema)

    return _rows(documents).mapInArrow(run, "node bigint, text string")


def placed_grams(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``gram, cut, doc_id, row, line, at`` of the grams of ``rows(doc_id, row, text, gone, anchors)`` that have one of the anchors, and of the
    anchors themselves, with the words ``around`` (null for grams).

    ``gone`` are lines that go; cut tells that words of the gram lie in them, and grams that lie wholly in them are left out, as are anchors that touch them."""
    schema = pa.schema([("gram", pa.int64()), ("cut", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("at", pa.int32()), ("around", pa.binary())])
    k = min(SHINGLE, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, 1_000_000):
            w = Words(b.column(2).to_pylist(), hashes)
            if not w.n:
                continue
            _, least, fits = w.grams(min_words)
            goes = np.zeros(w.lines, bool)
            for start, lines in zip(w.first_lines.tolist(), b.column(3).to_pylist()):
                if lines:
                    goes[start + np.array(lines)] = True
            before = np.concatenate([[0], np.cumsum(goes[w.line_of_batch]), np.zeros(min_words, np.int64)])
            lost = before[min_words : min_words + w.n] - before[: w.n]
            wanted = np.unique(b.column(4).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            seeds, shingles = w.anchors(min_words)
            free = np.isin(shingles, wanted) & (before[seeds + k] == before[seeds])
            seeds, shingles = seeds[free], shingles[free]
            of = pa.array(w.text[seeds])
            around = windows(w.hashes, seeds - w.at[seeds], w.end[seeds], seeds)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(np.zeros(len(seeds), bool)), b.column(0).take(of), b.column(1).take(of), pa.array(w.line[seeds], pa.int32()), pa.array(w.at[seeds], pa.int32()), around], schema=schema)
            chosen = np.flatnonzero(fits & (lost < min_words) & np.isin(least, wanted))
            of = pa.array(w.text[chosen])
            columns = [gram_hashes(w.hashes, min_words)[chosen].view(np.int64), lost[chosen] > 0, b.column(0).take(of), b.column(1).take(of), w.line[chosen], w.at[chosen], pa.nulls(len(chosen), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema)], schema=schema)

    return rows.select("doc_id", "row", "text", "gone", "anchors").mapInArrow(run, "gram bigint, cut boolean, doc_id bigint, row bigint, line int, at int, around binary")


RUNS = "doc_id bigint, row bigint, line int, n_words int, class_id bigint, first_doc_id bigint, from_unit int, to_unit int"


def joined_runs(later: DataFrame, min_words: int = MIN_WORDS, gap: int = GAP) -> DataFrame:
    """Runs of the grams ``row, at, line, gram, doc_id, first_doc_id, of, shift``, with the class and first document of their first gram.

    ``of`` and ``shift`` tell the row of the first copy, and how many words further it stands there."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("n_words", pa.int32()), ("class_id", pa.int64()), ("first_doc_id", pa.int64()), ("from_unit", pa.int32()), ("to_unit", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: list | None = None
        tail: list[np.ndarray] | None = None

        def out(runs: list[list]) -> pa.RecordBatch:
            done = [(doc_id, row, line, to + 1 - at, gram, first, at, to) for row, at, line, gram, doc_id, first, _, _, to in runs]
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], f.type) for j, f in enumerate(schema)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(j).to_numpy(zero_copy_only=False) for j in (0, 1, 6, 7)] + [b.column(4).fill_null(LEAST).to_numpy()]
            (row, at, of, shift, doc), (row0, at0, of0, shift0, doc0) = now, [np.concatenate([x[:1] if tail is None else tail[j], x[:-1]]) for j, x in enumerate(now)]
            far = at > at0 + min_words
            near = (at <= at0 + min_words + gap) & (of == of0) & (np.abs(shift - shift0) <= gap)
            opens = (row != row0) | (doc != doc0) | (far & ~near)
            opens[0] |= tail is None
            tail = [x[-1:] for x in now]
            starts = np.flatnonzero(opens)
            lasts = at[np.concatenate([starts[1:] - 1, [len(at) - 1]]).astype(int)] + min_words - 1
            if not opens[0]:
                open_run[-1] = int(at[(starts[0] if len(starts) else len(at)) - 1]) + min_words - 1
            runs = ([] if open_run is None else [open_run]) + [[*x.values(), to] for x, to in zip(b.take(pa.array(starts)).to_pylist(), lasts.tolist())]
            open_run = runs.pop()
            yield out(runs)
        if open_run is not None:
            yield out([open_run])

    rows = later.select("row", "at", "line", "gram", "doc_id", "first_doc_id", "of", "shift").repartition("row").sortWithinPartitions("row", "doc_id", "at")
    return rows.mapInArrow(run, RUNS)


def repeated_paragraphs(documents: DataFrame, sketched: DataFrame, k: int = 5, similarity: float = 0.8, min_words: int = MIN_WORDS, most: int = 400) -> DataFrame:
    """``doc_id, row, line, n_words, class_id, first_doc_id, keep`` of the paragraphs that have similar ones. ``sketched``: written ``sketches``."""
    # repeated rows are one row
    every = sketched.filter("line >= 0").select("doc_id", "row", "line", "n_words", "node", "bands")
    distinct = written(every.groupBy("node").agg(F.first("bands").alias("bands"), F.min(F.struct("doc_id", "row", "line")).alias("first"), F.max(F.struct("doc_id", "row", "line")).alias("last")), "nodes")
    pairs = distinct.select(F.explode(F.array_distinct("bands")).alias("key"), "node")

    def texts_of(nodes: DataFrame) -> DataFrame:
        # from the first row of each node: its paragraphs are cut again, and those of other nodes dropped
        wanted = distinct.join(nodes, "node", "left_semi").select("first.doc_id", "first.row").distinct()
        rows = _rows(documents)
        rows = rows.join(wanted, same_row(rows, wanted), "left_semi").select("doc_id", "text")
        return paragraph_texts(rows, min_words).join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", F.lit(None).cast("bigint").alias("mark"), "text")

    found = similar_components(pairs, texts_of, k, similarity, 0, most)
    rooted = distinct.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("class_id"), "first", "last")
    classes = rooted.groupBy("class_id").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first != last")
    members = rooted.select("node", "class_id").join(classes, "class_id").select("node", "class_id", "first")
    return every.join(members, "node").select("doc_id", "row", "line", "n_words", "class_id", F.col("first.doc_id").alias("first_doc_id"), (F.struct("doc_id", "row", "line") == F.col("first")).alias("keep")).withColumn("from_unit", F.lit(-1)).withColumn("to_unit", F.lit(-1))


def copies_of(sketched: DataFrame) -> DataFrame:
    """``doc_id, row, counts, first_doc_id`` of the documents with a text that an earlier one has."""
    docs = sketched.filter("line < 0").select("doc_id", "row", "counts", "copy_of")
    place = F.struct("doc_id", "row")
    firsts = docs.groupBy("copy_of").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("copy_of", "first")
    return docs.join(written(firsts, "texts"), "copy_of").filter(place != F.col("first")).select("doc_id", "row", "counts", F.col("first.doc_id").alias("first_doc_id")).dropDuplicates(["doc_id", "row"])


def runs_of_copy(counts: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """``line, from, to`` of the runs in a text of which everything occurs before: of its lines those of ``min_words`` words go whole, and what lies
    wholly in them is not told again."""
    n = int(counts.sum())
    before = np.concatenate([[0], np.cumsum(np.repeat(counts >= min_words, counts))])
    at = np.flatnonzero(before[min_words:] - before[: n - min_words + 1] < min_words) if n >= min_words else np.zeros(0, int)
    if not len(at):
        return []
    opens = np.concatenate([[True], at[1:] > at[:-1] + min_words])
    ends = at[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(at) - 1]])] + min_words - 1
    return list(zip(np.searchsorted(np.cumsum(counts), at[opens], "right").tolist(), at[opens].tolist(), ends.tolist()))


def copied_runs(copies: DataFrame, min_words: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("n_words", pa.int32()), ("class_id", pa.int64()), ("first_doc_id", pa.int64()), ("from_unit", pa.int32()), ("to_unit", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc_id, row, counts, first in zip(*(b.column(j).to_pylist() for j in range(4))):
                found += [(doc_id, row, line, z + 1 - a, row, first, a, z) for line, a, z in runs_of_copy(np.array(counts, np.int64), min_words)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], f.type) for j, f in enumerate(schema)], schema=schema)

    return copies.select("doc_id", "row", "counts", "first_doc_id").mapInArrow(run, RUNS)


def repeated_passages(documents: DataFrame, sketched: DataFrame, whole: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, row, line, n_words, class_id, first_doc_id, keep, from_unit, to_unit``: runs of words that occur before, where ``whole`` has
    the repeated paragraphs. Units are the words of the text, numbered from 0; line is the one in which the run starts.

    Of texts that are equal as a whole, the first is compared with others; all of a copy is repeated."""
    copies = written(copies_of(sketched), "copies")
    docs = sketched.filter("line < 0").select("doc_id", "row", "anchors")
    docs = docs.join(copies, same_row(docs, copies), "left_anti")
    every = docs.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    again = written(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "again")
    # a table of its own, so that the rows of a hot anchor may be split in the join; so with the grams
    todo = every.join(again, "anchor").groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("anchors"))
    gone = whole.filter("not keep").groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone"))
    texts = _rows(documents)
    chosen = texts.join(todo, same_row(texts, todo)).select(texts["doc_id"], texts["row"], "text", "anchors")
    chosen = chosen.join(gone, same_row(chosen, gone), "left").select(chosen["doc_id"], chosen["row"], "text", "anchors", "gone")
    placed = written(placed_grams(chosen, min_words), "placed")
    removed(again)
    edited = edited_passages(placed.filter("around is not null").drop("cut", "line"), sketched, min_words)
    placed = placed.filter("around is null").drop("around")
    place = F.struct("cut", "doc_id", "row", "at")
    first = placed.groupBy("gram").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "first")
    later = placed.join(written(first, "first"), "gram").filter(place != F.col("first"))
    later = later.select("doc_id", "row", "line", "at", "gram", F.col("first.doc_id").alias("first_doc_id"), F.xxhash64("first.doc_id", "first.row").alias("of"), (F.col("first.at") - F.col("at")).alias("shift"))
    # runs and edited passages that lie in another one of their row are not told again; of equal ones the run is
    told = joined_runs(later, min_words).withColumn("edited", F.lit(False)).unionByName(edited.withColumn("edited", F.lit(True)))
    before = Window.partitionBy("row", "doc_id").orderBy("from_unit", F.col("to_unit").desc(), "edited").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("so_far", F.max("to_unit").over(before)).filter("so_far IS NULL OR to_unit > so_far").drop("edited", "so_far")
    found = told.union(copied_runs(copies, min_words)).withColumn("keep", F.lit(False))
    return found.select("doc_id", "row", "line", "n_words", "class_id", "first_doc_id", "keep", "from_unit", "to_unit")


def repeats(documents: DataFrame, k: int = 5, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """Members of repeated-paragraph classes (``from_unit`` -1) and repeated passages inside paragraphs, with their class, the
    document where it is first, and whether this copy stays. Passages that lie in paragraphs that go are not told again."""
    sketched = written(sketches(documents, k, min_words), "sketches")
    with cleared() as made:
        whole = written(repeated_paragraphs(documents, sketched, k, similarity, min_words), "repeated")
        made.pop()
    return whole.unionByName(repeated_passages(documents, sketched, whole, min_words))


def drop_repeats(documents: DataFrame, k: int = 5, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` without repeated paragraphs and passages but their first copies; ``n_chars`` follows, where it is there."""
    name, spans, own = free_name(documents, "_row"), free_name(documents, "_gone"), free_name(documents, "_doc")
    gone = repeats(documents, k, similarity, min_words).filter("not keep").groupBy("row", "doc_id").agg(F.collect_list(F.struct("line", "from_unit", "to_unit")).alias(spans))
    gone = gone.select(F.col("row").alias("_r"), F.col("doc_id").alias("_d"), spans)
    rows = documents.withColumn(name, row_hash()).withColumn(own, F.col("doc_id").cast("bigint"))
    rows = rows.join(gone, (rows[name] == gone["_r"]) & rows[own].eqNullSafe(gone["_d"]), "left").select(*[rows[c] for c in documents.columns], gone[spans])
    clean = rows.filter(F.col(spans).isNull()).select(*documents.columns)
    cut = rows.filter(F.col(spans).isNotNull())
    at, last = documents.columns.index("text"), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without(t or "", gone) for t, gone in zip(b.column(at).to_pylist(), b.column(last).to_pylist())]
            columns = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([b.schema.field(i) for i in range(last)]))

    changed = cut.mapInArrow(run, documents.schema).filter("text != ''")
    if "n_chars" in documents.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return clean.unionByName(changed)


def without(text: str, gone: list[dict]) -> str:
    """``text`` without whole lines (from_unit -1) and runs of words; lines of which nothing is left go."""
    whole = {g["line"] for g in gone if g["from_unit"] < 0}
    runs = sorted((g["from_unit"], g["to_unit"]) for g in gone if g["from_unit"] >= 0)
    out, at, r = [], 0, 0
    for i, line in enumerate(text.split("\n")):
        words = line.split()
        end = at + len(words)
        while r < len(runs) and runs[r][1] < at:
            r += 1
        if i not in whole:
            cuts, j = [], r
            while j < len(runs) and runs[j][0] < end:
                cuts.append(runs[j])
                j += 1
            if cuts:
                left = [w for p, w in enumerate(words, at) if not any(a <= p <= b for a, b in cuts)]
                if left:
                    out.append(" ".join(left))
            else:
                out.append(line)
        at = end
    return "\n".join(out)
