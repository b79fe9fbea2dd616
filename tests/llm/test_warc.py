"""WARC archives and their capture index."""

import hashlib

import pytest

from tallyframe.llm import warc

SCHEMA = "page_id long, url string, html string, key string, shard string, start string, digest string"


def rows_of(spark, pages):
    return spark.createDataFrame([(*p, "clash", "clash", "clash", "clash") for p in pages], SCHEMA).repartition(3)


def test_keys_sort_by_reversed_host():
    assert warc.reversed_host("https://Blog.Example.com:8080/a/b?q=1#x") == "com,example,blog)/a/b?q=1"
    assert warc.reversed_host("http://a.b") == "b,a)/" and warc.reversed_host(None) == "" and warc.reversed_host("no host") == "no host"
    assert warc.reversed_host("http://[bad") == "http://[bad"
    assert warc.capture_key("http://a.b/", -5) < warc.capture_key("http://a.b/", 3) < warc.capture_key("http://a.b/", 20)


@pytest.mark.parametrize(("url", "payload"), [("http://a.b/\r\nX: y%0A", b"x" * 200), (None, b""), ("http://a/é", "é\r\n\r\nWARC/1.1".encode())])
def test_records_read_back(url, payload):
    assert warc.parsed(warc.record(7, url, payload, None, None)) == (7, len(payload), hashlib.sha256(payload).hexdigest(), "response", None, url, payload)
    assert warc.parsed(warc.record(None, url, payload, 3, "http://c/")) == (None, len(payload), hashlib.sha256(payload).hexdigest(), "revisit", 3, url, None)


@pytest.mark.parametrize("block", [512, 2])
def test_round_trip(spark, block, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "FILE", 2000)
    same, short = "<p>" + "same " * 50, "short"
    pages = [(k, f"http://h{k % 3}.example.org/{k % 7}?x={k}", f"<p>{k}</p>" * (k % 40)) for k in range(60)]
    pages += [(100 + k, "http://hot.example.org/", same) for k in range(40)]
    pages += [(200, None, None), (201, "", ""), (202, "http://a.b/\n\t", short), (203, "x", short), (None, "http://n/", same), (None, "http://n/", same), (204, "http://é.b/日本", "é" * 100)]
    pages += [(100, "http://hot.example.org/", same)]  # a repeated row
    got = warc.round_trip(rows_of(spark, pages)).collect()
    want = []
    for p, u, h in pages:
        raw = (h or "").encode()
        revisit = h == same and p != 100
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 100 if revisit else None, u, None if revisit else raw))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)


def test_lookups_read_single_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    pages = rows_of(spark, [(k, f"http://h{k}.org/", f"page {k}") for k in range(50)])
    folder = f"{warc.shared_dir(spark)}/lookups"
    fs, path = warc._place(folder)
    fs.create_dir(path, recursive=True)
    shards = warc.indexed(warc.archived(pages, folder), folder)
    wanted = spark.createDataFrame([(7, "http://h7.org/"), (7, "http://h8.org/"), (99, "http://h9.org/"), (49, "http://h49.org/")], "page_id long, url string")
    assert sorted(r.page_id for r in warc.looked_up(wanted, shards, folder).collect()) == [7, 49]


def test_a_broken_record_is_refused():
    import gzip

    raw = gzip.decompress(warc.record(1, "http://a/", b"payload", None, None))
    with pytest.raises(ValueError, match="broken record"):
        warc.parsed(gzip.compress(raw.replace(b"payload\r\n", b"Payload\r\n")))


def test_empty_and_null_tables(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    got = warc.round_trip(spark.createDataFrame([(None,) * 7] * 2, SCHEMA)).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(None, 0, "response", None)] * 2


def test_very_long_payload(spark):
    got = warc.round_trip(rows_of(spark, [(1, "http://a/", "é" * 3_000_000), (2, "http://b/", "é" * 3_000_000)])).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, 6_000_000, "response"), (2, 6_000_000, "revisit")]
