import base64
import hashlib
import io
import zipfile

import pytest

from loomdoc.llm import archive


@pytest.mark.parametrize("wide", [False, True])
def test_zip_is_read_by_the_standard_library_and_back(wide):
    out = io.BytesIO()
    z = archive.ZipWriter(out)
    z.member("a", [b"one", b"two"], force64=wide)
    z.member("b/ü", [b""])
    z.close(force64=wide)
    with zipfile.ZipFile(out) as own:
        assert {n: own.read(n) for n in own.namelist()} == {"a": b"onetwo", "b/ü": b""} and own.testzip() is None
    found = archive.zip_members(out, len(out.getvalue()))
    assert {n: archive.read_range(out, s, k) for n, (s, k, _) in found.items()} == {"a": b"onetwo", "b/ü": b""}


def test_archives_of_the_standard_library_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("x", "w", force_zip64=True) as f:
            f.write(b"data")
        z.comment = b"PK note"
    start, size, method = archive.zip_members(out, len(out.getvalue()))["x"]
    assert archive.read_range(out, start, size) == b"data" and method == 0
    with pytest.raises(archive.ArchiveError):
        archive.zip_members(io.BytesIO(b"no archive" * 10), 100)


def expected(rows, least):
    last = {}
    for page_id, html in rows:
        last[html or ""] = max(last.get(html or "", page_id), page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and page_id != last[html or ""]
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least, monkeypatch):
    rows = [(1, "<p>a</p>"), (2, None), (3, ""), (4, "<p>a</p>"), (5, "é\r\n\r\nx"), (5, "é\r\n\r\nx"), (6, "long" * 50_000)] + [(k, "copy") for k in range(10, 60)]
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", h, 1) for i, h in rows], "page_id bigint, url string, html string, payload int").repartition(3)
    found = archive.archive_round_trip(pages, least)
    got = sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == expected(rows, least)
    assert archive.archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, None, "y\r\n\r\nz"), (None, "v", "x")], "page_id bigint, url string, html string")
    folder = archive.shared_dir(spark, "test")
    rows = archive.read_records(archive.write_archives(pages, folder), with_payload=True).collect()
    assert {(r["page_id"], r["record_type"], bytes(r["payload"]), r["refers_to"]) for r in rows} == {(1, "response", b"x", None), (2, "response", b"y\r\n\r\nz", None), (None, "revisit", b"", 1)}


def test_no_sum_between_shuffle_and_join_of_equal_pages(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None)], "page_id bigint, url string, html string")
    found = archive.linked(pages)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("page_id", "refers_to", "revisit").collect())) == [(1, 2, True), (2, None, False), (3, None, False), (4, None, False)]
