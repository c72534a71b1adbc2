"""WARC round trips against plain digests; range reads; odd URLs."""

import base64
import gzip
import hashlib

import pytest
from callboard.llm import warc, workspace

ROWS = [(1, "http://a b/\r\nWARC-Type: x", "<p>x</p>"), (2, None, "<p>x</p>"), (None, "u", "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "é", "é" * 200000),
        (2, "z", "<p>x</p>"), (6, "http://a/?q=1&b=%20'", "\r\n\r\nHTTP/1.1"), (None, "n", "alone")]


def frame(spark, rows):
    full = [(*r, "f", 1, "s") for r in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, file string, offset int, first string")


def wanted(rows, least=0):
    best = {}
    for key, _, html in rows:
        if key is not None:
            best[html or ""] = max(best.get(html or "", key), key)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        first = best.get(html or "", key) if len(data) >= least else key
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((key, len(data), digest, "response" if first == key else "revisit", None if first == key else first))
    return sorted(map(str, out))


def back(records):
    return sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in records)


def test_round_trip(spark):
    index = warc.write(frame(spark, ROWS), workspace.folder(spark, "warc"))
    records = warc.read(index).collect()
    assert back(records) == wanted(ROWS)
    payload = {r["page_id"]: bytes(r["payload"]).decode() for r in records if r["record_type"] == "response" and r["page_id"]}
    assert payload == {2: "<p>x</p>", 4: "", 5: "é" * 200000, 6: "\r\n\r\nHTTP/1.1"}
    assert all(r["payload"] is None for r in records if r["record_type"] == "revisit")
    url = {r["page_id"]: r["url"] for r in records}
    assert url[1] == "http://a%20b/%0D%0AWARC-Type:%20x" and url[6] == "http://a/?q=1&b=%20'"
    assert back(warc.read(index, payloads=False).collect()) == wanted(ROWS)


def test_small_payloads_are_responses_and_archives_are_gzip_members(spark):
    index = warc.write(frame(spark, ROWS), workspace.folder(spark, "warc"), least=3)
    assert back(warc.read(index).collect()) == wanted(ROWS, 3)
    rows = index.collect()
    for name in {r["file"] for r in rows}:
        text = gzip.open(name.removeprefix("file:"), "rb").read()
        assert text.count(b"WARC/1.1\r\n") == sum(r["file"] == name for r in rows)


def test_selected_records_only(spark):
    index = warc.write(frame(spark, ROWS), workspace.folder(spark, "warc"))
    some = warc.read(index.where("url = 'u' AND page_id = 3")).collect()
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in some] == [(3, "revisit", 4)]
    empty = warc.write(frame(spark, []), workspace.folder(spark, "warc"))
    assert empty.count() == 0 and warc.read(empty).count() == 0


def test_ranges_are_coalesced_within_a_gap_and_a_size(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    rows = [("a", 0, 20), ("a", 25, 20), ("a", 60, 10), ("a", 60, 10), ("a", 75, 90), ("b", 75, 500)]
    got = [(f, s, e, len(c)) for f, s, e, c in warc._ranges(rows)]
    assert got == [("a", 0, 45, 2), ("a", 60, 70, 2), ("a", 75, 165, 1), ("b", 75, 575, 1)]


def test_addresses_of_object_stores_go_by_the_names_that_arrow_knows():
    shown = {"s3a://b/x": "s3://b/x", "s3n://b/x": "s3://b/x", "file:/tmp/x": "file:/tmp/x", "abfss://c@a/x": "abfss://c@a/x", "hdfs://n:1/x": "hdfs://n:1/x"}
    assert {a: workspace.arrow_uri(a) for a in shown} == shown
    for bad in ("viewfs://store/x", "/tmp/x"):
        with pytest.raises(ValueError):
            workspace.arrow_uri(bad)
