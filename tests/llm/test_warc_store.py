import hashlib

import pytest

from graphloom.llm import runtime, warc_store

PAGES = [(3, "u3", "p" * 200, "x"), (1, "u1", "p" * 200, "x"), (2, None, "p" * 200, "x"), (1, "u1", "p" * 200, "x"), (9, "a\r\nb", "short", "x"), (8, "u", "short", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (None, "u", "p" * 200, "x"), (None, "u", "only here " * 20, "x"), (7, "é", "é" * 60, "x"), (10, "é", "é" * 60, "x")]


@pytest.fixture(scope="module")
def archive(spark):
    folder = runtime.fresh_path(spark, "warc-test")
    warc_store.write(spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string"), folder)
    return folder


def test_read(spark, archive):
    got = sorted(map(tuple, warc_store.read(spark, archive).collect()), key=repr)
    want = []
    for page, _, html, _ in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and page is not None and page != min(same)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(want, key=repr)


def test_payloads_are_stored_once(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads").collect()
    assert len(stored) == len({r.digest for r in stored}) == len({(h or "") for _, _, h, _ in PAGES})


def test_reconstruct(spark, archive):
    """Records to the byte: the WARC length is that of the HTTP header and the record's own payload, which a revisit does not have."""
    rows = warc_store.reconstruct(spark, archive).collect()
    assert sorted(bytes(r.resolved).decode() for r in rows) == sorted(h or "" for _, _, h, _ in PAGES)
    assert sum("WARC-Type: revisit" in bytes(r.header).decode() for r in rows) > 0
    for r in rows:
        head = bytes(r.header).decode()
        assert head.startswith("WARC/1.1\r\nWARC-Type: re") and head.endswith("\r\n\r\n") and hashlib.sha256(bytes(r.resolved)).hexdigest() in head
        fields, http, _ = head.split("\r\n\r\n")
        assert bytes(r.payload) == (b"" if "WARC-Type: revisit" in fields else bytes(r.resolved))
        assert f"\r\nContent-Length: {len(http) + 4 + len(r.payload)}" in fields and f"Content-Length: {len(r.resolved)}" in http
        assert fields.count("\r\nWARC-Record-ID: <urn:") == 1


def test_damage_is_found(spark):
    folder = runtime.fresh_path(spark, "warc-damaged")
    warc_store.write(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string, digest string"), folder)
    bad = spark.createDataFrame([(hashlib.sha256(b"p" * 200).hexdigest(), b"other")], "digest string, payload binary")
    bad.write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read(spark, folder).collect()


def test_empty(spark):
    folder = runtime.fresh_path(spark, "warc-empty")
    warc_store.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc_store.read(spark, folder).collect() == []
