import hashlib
import os
import zlib

import numpy as np

from loomdoc.llm import digest, mjpeg


def test_digests(spark):
    rows = [(3, "c" * 40), (1, "alpha beta gamma delta " * 20), (2, None), (5, ""), (4, "é" * 7), (9, "alpha beta gamma delta " * 20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fingerprint string").repartition(3)
    order = sorted((i, t or "") for i, t in rows)
    for buckets in (1, 2, 4, 50):
        got = {r["doc_id"]: r for r in digest.fingerprints(docs, buckets).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r["fingerprint"] == digest.digest(t) and r["edited_fingerprint"] == digest.digest(edited)
            assert r["near_next"] == digest.likeness(digest.digest(t), digest.digest(after)) and 0 <= r["near_edited"] <= 1
    assert got[1]["fingerprint"] == got[9]["fingerprint"]
    assert digest.fingerprints(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (1, "a")], "doc_id bigint, text string")
    assert digest.fingerprints(twice, 3).count() == 4


def test_bucket_counts_are_those_of_a_loop():
    data = os.urandom(300) + "text text".encode()
    want = np.zeros(digest.BUCKETS, dtype=int)
    for i in range(len(data) - 4):
        for t in digest.TRIPLETS:
            h = 0
            for j in t:
                h ^= int(digest.TABLES[j][data[i + j]])
            want[h] += 1
    assert (digest.bucket_counts(data) == want).all()


def test_edited_texts_are_nearer_than_others(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if len(r["text"]) > 200]
    near = [digest.likeness(digest.digest(a), digest.digest(digest.edited(a, b))) for a, b in zip(texts, texts[1:]) if a != b]
    far = [digest.likeness(digest.digest(a), digest.digest(b)) for a, b in zip(texts, texts[1:]) if a != b]
    assert np.mean(np.array(near) > np.array(far)) > 0.97


PAYLOADS = [b"", b"a", b"\xff" * 500, os.urandom(9000), b"x" * 64, b"\xff\xd0" * 40, "é".encode() * 3000]


def decoded(files):
    return mjpeg._decoded(files)


def test_payloads_come_back():
    files = mjpeg.payload_files(PAYLOADS)
    for data, f, (head, frames, tables, error, values) in zip(PAYLOADS, files, decoded(files)):
        own, size = map(int, head["comment"].split()[1:])
        got = mjpeg.stored_bytes(values, size)
        assert error is None and own == len(data) and got == data + bytes(size - own) and size % 64 == 0 and size > 0
        assert len(frames) == len(tables) and np.allclose(tables.sum(axis=1), 1)


def test_damaged_files_are_told():
    good = mjpeg.payload_files([b"abc" * 50])[0]
    for bad in (b"", None, b"RIFF", good[:-200], good.replace(b"\xff\xda", b"\xff\xdb", 1)):
        assert decoded([bad, good])[0][3] and decoded([bad, good])[1][3] is None


def jpeg_of_grey(levels):
    """A frame of flat blocks with ordinary tables: DC differences, end-of-block codes, no restarts."""
    dc = bytes([0, 0, 0, 12] + [0] * 12 + list(range(12)))
    ac = bytes([0, 1] + [0] * 14 + [0])
    bits, before = "", 0
    for v in levels:
        d, before = v - before, v
        n = abs(d).bit_length()
        bits += f"{n:04b}" + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "00"
    bits += "1" * (-len(bits) % 8)
    coded = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    s = mjpeg.segment
    head = b"\xff\xd8" + s(0xDB, bytes([0]) + bytes([8] * 64)) + s(0xC0, b"\x08\x00\x08" + bytes([0, 8 * len(levels)]) + b"\x01\x01\x11\x00") + s(0xC4, b"\x00" + dc[:0] + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    return head + s(0xC4, b"\x10" + ac[:16] + b"\x00") + s(0xDA, b"\x01\x01\x00\x00\x3f\x00") + coded + b"\xff\xd9"


def test_ordinary_frames_and_shots(spark):
    dark, light = jpeg_of_grey([-100, -90, -100, 3]), jpeg_of_grey([100, 110, 90, 100])
    frame = mjpeg.parse_jpeg(dark)
    values = mjpeg.decode_frames([frame])[0][0]
    assert values[:, 0].tolist() == [-100, -90, -100, 3] and not values[:, 1:].any()
    film = mjpeg.avi_file([dark] * 10 + [light] * 15, 32, 8)
    rows = mjpeg.clips(spark.createDataFrame([(7, bytearray(film)), (8, bytearray(b"no film")), (9, None)], "doc_id bigint, media binary")).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["start_ms"], r["end_ms"], r["frames"]) for r in rows if not r["error"]] == [(7, 0.0, 400.0, 10), (7, 400.0, 1000.0, 15)]
    assert [r["doc_id"] for r in rows if r["error"]] == [8, 9]
    without_index = film[: film.index(b"idx1")]
    without_index = without_index[:4] + (len(without_index) - 8).to_bytes(4, "little") + without_index[8:]
    assert mjpeg.parse_avi(without_index)["frames"] == mjpeg.parse_avi(film)["frames"]


def test_texts_as_media(spark):
    rows = [(1, "hello"), (2, None), (3, "é" * 5000), (4, "hello")]
    got = {r["doc_id"]: r for r in mjpeg.read_back(mjpeg.store_texts(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[1]["media_sha256"] == got[4]["media_sha256"] and got[1]["feature"] == got[4]["feature"]
    assert mjpeg.store_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_zigzag():
    rows = [int(x) for x in mjpeg.ZIGZAG]
    assert sorted(rows) == list(range(64))
    for k in range(1, 64):
        a, b = divmod(rows[k - 1], 8), divmod(rows[k], 8)
        assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1
