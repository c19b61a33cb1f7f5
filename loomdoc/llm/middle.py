"""Fill-in-middle transformation over groups of identical texts.

Documents are dealt by a hash of their text, so identical texts stand together; inside a group they are told apart by their bytes, not by the hash.
The boundaries of the code points of a text are an Elias-Fano list of byte offsets, made once for a text and asked for the two cuts of each document
that has it. Texts that very many documents have are dealt into shares, and the list is made once a share.

Cases: null text counts as empty (form plain, zero code points, cut counts null); a null doc_id counts as an empty string in the seeds; repeated rows give repeated rows with equal
results; empty tables give no rows; other columns are passed on, and new columns whose names clash get an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices

#: Marks of the three parts in the output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Documents of one text in a share at about most, and how many texts (the commonest) are looked at for it; any other has a smaller part of the rows than one over this number.
SHARE, COMMON = 2_000, 10_000


class EliasFano:
    """A rising list of offsets: low bits packed, high bits in unary, one select for an offset."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, top = len(values), int(values[-1]) + 1
        self.width = max(0, (top // self.n).bit_length() - 1)
        low = (values[:, None] >> np.arange(self.width)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()
        bits = np.zeros(-(-(self.n + (top >> self.width) + 1) // 64) * 64, np.uint8)
        bits[(values >> self.width) + np.arange(self.n)] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        #: ones before each word
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)]).astype(np.uint32)

    def __getitem__(self, i: int) -> int:
        at = int(np.searchsorted(self.before, i, "right")) - 1
        word, left = int(self.words[at]), i - int(self.before[at])
        for _ in range(left):
            word &= word - 1
        high = 64 * at + (word & -word).bit_length() - 1 - i
        low = 0
        for j in range(self.width):
            p = i * self.width + j
            low |= (self.low[p >> 3] >> (p & 7) & 1) << j
        return high << self.width | low


def boundaries(text: bytes) -> EliasFano:
    """Byte offsets of the code points of ``text``, and its end."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return EliasFano(np.append(starts, len(text)).astype(np.int64))


def seeds(doc_id: int | None, seed: int) -> list[int]:
    own = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(own[8 * j : 8 * j + 8], 16) for j in range(4)]


def cut(text: bytes, index: EliasFano, marked: bool, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and output."""
    n = index.n - 1
    h1, h2, h3, h4 = seeds(doc_id, seed)
    if not n or marked or h3 % 100 >= rate:
        return "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index[i], index[j]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return "spm", i, j - i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", i, j - i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(documents: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, text: str = "text") -> DataFrame:
    """``documents`` with ``n`` (code points), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` of a hundred documents are cut, ``spm`` of a hundred of them with the suffix first. One shuffle of the texts."""
    names = [free_name(documents, name) for name in ("n", "form", "prefix_chars", "middle_chars", "output")]
    bytes_, key, share, own, hot, shares = (free_name(documents, x) for x in ("_bytes", "_key", "_share", "_doc", "_hot", "_shares"))
    rows = documents.withColumn(key, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    # a bounded table: its size does not grow with the documents
    common = rows.groupBy(F.col(key).alias(hot)).count().filter(F.col("count") > SHARE).orderBy(F.desc("count")).limit(COMMON)
    common = common.select(hot, F.ceil(F.col("count") / SHARE).cast("bigint").alias(shares))
    rows = rows.withColumn(bytes_, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).withColumn(own, F.col("doc_id").cast("bigint")).withColumn(share, F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(common), F.col(key) == F.col(hot), "left").withColumn(share, F.pmod(share, F.coalesce(shares, F.lit(1).cast("bigint")))).drop(hot, shares, text)
    rows = rows.repartition(key, share).sortWithinPartitions(key, share)
    columns, place = documents.columns, {c: j for j, c in enumerate(rows.columns)}
    kinds = ["bigint", "string", "int", "int", "string"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, {}
        for b in slices(batches, name=bytes_):
            found, texts = [], b.column(place[bytes_]).to_pylist()
            for k, t, doc_id in zip(b.column(place[key]).to_pylist(), texts, b.column(place[own]).to_pylist()):
                if k != last:
                    last, known = k, {}
                have = known.get(t)
                if have is None:
                    have = known[t] = boundaries(t), PREFIX in t or SUFFIX in t or MIDDLE in t
                found.append((have[0].n - 1, *cut(t, *have, doc_id, seed, rate, spm)))
            old = [b.column(place[bytes_]).cast(pa.string()) if c == text else b.column(place[c]) for c in columns]
            outs = [pa.array([x[j] if j < 4 else x[j].decode() for x in found], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(old + outs, names=[*columns, *names])

    return rows.mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The exact text again, from form and output."""
    part = lambda i: F.element_at(F.split(output, "<[PSM]>"), i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))
