"""Token ids packed into rows of a fixed length, written as binary.

Texts are tokenised whole, with an end token each; a document longer than a row is split losslessly into row-long segments and a rest.
Segments are packed by best-fit decreasing: each goes into the open row with the least free space that holds it, found by a
segment tree over the capacities. Packed rows are little-endian ids, on demand filled up with end tokens to the rows of a matrix, with cumulative segment lengths and the
places where positions start again.

A task packs a window of bounded size at a time, and no text is shuffled. Which documents share a row follows the order of
the input; every document's tokens are in some row whatever the order.

Cases: null text counts as empty and gives an end token alone; repeated rows stay apart; empty tables give no rows. Other
columns are not used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import slices

ROW = 2048
#: Tokens that a task packs at a time.
WINDOW = 1 << 21
KEPT = 300_000


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Odd(Exception):
    """White space beside a blank, or at an end, of a text."""


class Parts(dict):
    """Ids, as bytes, of parts of texts that follow a blank."""

    def __init__(self, ids) -> None:
        super().__init__()
        self.ids = ids

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise Odd
        if len(self) >= KEPT:
            self.clear()
        found = self[part] = self.ids(" " + part)
        return found


class Tokens:
    """Byte-pair tokens of whole texts. No token spans the place before a blank that follows a character other than white space,
    so texts are cut there and the ids of frequent parts are kept."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.kind = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.kept = Parts(self.whole)

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), self.kind).tobytes()

    def ids(self, text: str, tail: bytes = b"") -> np.ndarray:
        """Ids of the text, and those of ``tail``."""
        first, *parts = text.split(" ")
        try:
            # in a text without blanks nothing is cut, whatever white space it has
            if parts and (not first or first[0].isspace() or first[-1].isspace()):
                raise Odd
            found = self.whole(first) + b"".join(map(self.kept.__getitem__, parts))
        except Odd:
            found = self.whole(text)
        return np.frombuffer(found + tail, self.kind)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()


class Capacities:
    """Segment tree over free spaces 0..size: how many open rows have each, and the least space of at least n that some row has."""

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        at = self.width + space
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, space: int) -> int:
        """A row with exactly this space, which must exist."""
        at = self.width + space
        while at:
            self.tree[at] -= 1
            at >>= 1
        return self.rows[space].pop()

    def least(self, need: int) -> int | None:
        """The least space of at least ``need`` that some row has."""
        at = self.width + need
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:  # a left child whose sibling has rows
                at += 1
                while at < self.width:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Members of each row: best-fit decreasing, equal lengths in their order."""
    spaces, rows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        space = spaces.least(lengths[i])
        if space is None:
            row, space = len(rows), size
            rows.append([])
        else:
            row = spaces.take(space)
        rows[row].append(i)
        if space > lengths[i]:
            spaces.add(space - lengths[i], row)
    return rows


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = ROW, window: int = WINDOW, ranks: str | None = None, fill: bool = False) -> DataFrame:
    """Packed rows: ``ids`` (little-endian uint16, or uint32 for larger vocabularies; with ``fill`` always ``size`` of them), ``n_tokens`` (without
    the filling), ``cu_lengths`` (cumulative segment lengths from 0), ``position_resets`` (where positions start again: at each segment, and the
    filling), and of each segment ``doc_ids`` and ``starts`` (its place in the document's tokens)."""
    ranks = ranks or default_ranks()
    fields = [("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_lengths", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(ranks)
        kind = tokens.kind
        end = np.array([tokens.end], kind).tobytes()
        held, total = [], 0

        def packed() -> pa.RecordBatch:
            rows = []
            for members in best_fit([len(x[2]) for x in held], size):
                ends = np.cumsum([0, *(len(held[i][2]) for i in members)])
                n = int(ends[-1])
                ids = np.full(size if fill else n, tokens.end, kind)
                np.concatenate([held[i][2] for i in members], out=ids[:n])
                rows.append((ids.tobytes(), n, ends.tolist(), ends[: -1 if n == len(ids) else None].tolist(), [held[i][0] for i in members], [held[i][1] for i in members]))
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f[1]) for j, f in enumerate(fields)], schema=schema)

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = tokens.ids(text or "", end)
                for start in range(0, len(ids), size):
                    held.append((doc_id, start, ids[start : start + size]))
                total += len(ids)
                if total >= window:
                    yield packed()
                    held, total = [], 0
        if held:
            yield packed()

    return documents.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "ids binary, n_tokens int, cu_lengths array<int>, position_resets array<int>, doc_ids array<bigint>, starts array<bigint>")


def unpack(rows: DataFrame, wide: bool = False) -> DataFrame:
    """``doc_id, start, ids`` of each segment of packed rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, ends, owners, starts in zip(*(b.column(j).to_pylist() for j in range(4))):
                flat = np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(starts, pa.int64()), pa.array([flat[a:z] for a, z in zip(ends[:-1], ends[1:])], pa.list_(pa.int32()))], schema=schema)

    return rows.select("ids", "cu_lengths", "doc_ids", "starts").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")
