"""Quartile bucket digests of documents, and their likeness.

Byte triplets of a sliding five-byte window (six choices of three of its bytes) are hashed into 128 buckets. The digest holds
the length on a logarithmic scale, how the bucket quartiles relate, and two bits a bucket for its quartile. Two digests
are compared with a bounded difference: likeness 1 for equal digests, down to 0.

Cases: null text counts as empty; texts of under five bytes have no triplets and get a digest of their length and bytes.
Equal texts have equal digests. Repeated ids are ordered by text; null ids come first. Empty tables give no rows. Other
columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 128
WINDOW = 5
#: Offsets in the window of each triplet; every triplet holds the first byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))


def _tables() -> list[np.ndarray]:
    """For each place in the window a table byte -> bits; the exclusive or of a triplet's bits is its bucket."""
    byte = np.arange(256, dtype=np.uint64) + np.uint64(1)
    return [(byte * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % 2**64) >> np.uint64(40)).astype(np.uint8) & np.uint8(BUCKETS - 1) for k in range(WINDOW)]


TABLES = _tables()
BLOCK = 1 << 16


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    a = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(a) - WINDOW + 1, BLOCK):
        part = a[start : start + BLOCK + WINDOW - 1]
        n = len(part) - WINDOW + 1
        bits = [t[part[k : k + n]] for k, t in enumerate(TABLES)]
        buckets = np.empty((len(TRIPLETS), n), dtype=np.uint8)
        for row, (i, j, k) in zip(buckets, TRIPLETS):
            np.bitwise_xor(bits[i], bits[j], out=row)
            np.bitwise_xor(row, bits[k], out=row)
        counts += np.bincount(buckets.ravel(), minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Length in steps of a fifth, in one byte."""
    return min(255, round(math.log(n + 1) / math.log(1.2)))


def digest(text: str) -> str:
    """Length code, two quartile ratios, then two bits a bucket; in hex."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) < WINDOW:
        return f"{length_code(len(data)):02x}0000" + hashlib.sha256(data).hexdigest()
    counts = bucket_counts(data)
    order = np.sort(counts)
    q1, q2, q3 = (int(order[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    ratios = (255 * q1 // max(1, q3), 255 * q2 // max(1, q3))
    return f"{length_code(len(data)):02x}{min(255, ratios[0]):02x}{min(255, ratios[1]):02x}{packed.tobytes().hex()}"


#: Difference of two quartile codes; opposite ends weigh twice their distance.
STEP = np.array([0, 1, 2, 6])
#: At this difference or more the likeness is 0.
FAR = 256.0


def difference(a: str, b: str) -> float:
    if a == b:
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    length = abs(int(x[0] - y[0]))
    total = float(length if length <= 1 else 4 * length)
    total += np.abs(x[1:3] - y[1:3]).sum() / 32.0
    for shift in (0, 2, 4, 6):
        total += STEP[np.abs((x[3:] >> shift & 3) - (y[3:] >> shift & 3))].sum()
    return total


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for a difference of ``FAR`` or more."""
    return max(0.0, 1.0 - difference(a, b) / FAR)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many code points of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows ``bucket, ghost, doc_id, text``: documents dealt by ranges of doc_id, and in each range last, as ghost, the document
    that follows it. The bounds are ids that exist, so the first row of a range is known without looking at other ranges."""
    spark = documents.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    found = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / buckets for i in range(buckets)], 100 * buckets), F.min("k")).first()
    bounds = sorted({*(found[0] or []), *([found[1]] if found[1] is not None else [])})
    n = max(1, len(bounds))
    at = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    # number of bounds up to the id, by halving steps
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    upto = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.try_element_at(at, p + s) <= key), p + s).otherwise(p))
    place = upto - 1
    own = F.struct(place.alias("bucket"), F.lit(0).alias("ghost"))
    head = F.struct(F.pmod(place - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("ghost"))
    dealt = docs.select(F.explode(F.when(F.try_element_at(at, upto) == key, F.array(own, head)).otherwise(F.array(own))).alias("b"), "doc_id", "text")
    dealt = dealt.select("b.bucket", "b.ghost", "doc_id", "text")
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Digest of each text and of its edited text (see ``edited``), with their likeness and that to the next document's digest.

    One shuffle, of the texts by ranges of doc_id; a task goes through its range holding two documents at a time."""
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, doc_id, text, digest
        for b in slices(batches):
            out: list[tuple] = []
            for bucket, ghost, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if ghost and (last is None or last[0] != bucket):
                    continue
                own = digest(text)
                if last is not None and last[0] == bucket:
                    other = edited(last[2], text)
                    mark = digest(other)
                    out.append((last[1], len(last[2]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), last[3], mark, likeness(last[3], mark), likeness(last[3], own)))
                last = None if ghost else (bucket, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*out), fields)], schema=schema)

    return with_next(documents, buckets).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
