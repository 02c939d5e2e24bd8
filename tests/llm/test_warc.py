from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import random

import pytest

from tablecare.llm import queries as q
from tablecare.llm import warc as w

SCHEMA = "page_id long, url string, html string"


def plain_rows(pages):
    """What reads back, by looking at all pages at once."""
    out, groups = [], {}
    for page, url, html in pages:
        groups.setdefault(html or "", []).append((page is None, page or 0, url is None, url or "", page))
    for html, rows in groups.items():
        data = html.encode()
        for i, r in enumerate(sorted(rows)):
            again = i > 0 and len(data) >= 100
            out.append((r[4], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", sorted(rows)[0][4] if again else None))
    return sorted(out, key=repr)


def odd_pages():
    rng = random.Random(1)
    big, edge, less = "<p>" + "é" * 200, "x" * 100, "x" * 99
    pages = [(i, f"http://a/{i}", rng.choice([big, edge, less, f"<p>page {i} " + "y" * i])) for i in range(150)]
    pages += [(None, None, big), (None, "http://n", edge), (200, None, None), (201, "u", ""), (202, "a\r\nWARC-Type: x\r\n\r\n", big)]
    pages += [(0, "http://first", big), (300, "u", "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n" * 9), (301, "u", "é\x00\x1f\x8b" * 200_000)]
    return pages + [(7, "http://seven", edge)] * 3 + [(-5, "http://least", big)] * 6 + [(9, "u", "small")] * 5


def test_query_reads_back_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "COPIES", 2)
    pages = odd_pages()
    spark.createDataFrame([(*p, "x") for p in pages], SCHEMA + ", digest string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = q.op13_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rows(pages)


def test_every_record_is_a_member_at_its_place_in_the_index(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>page {i}</p>" * (i % 40 + 1)) for i in range(200)]
    rows = w.page_rows(spark.createDataFrame(pages, SCHEMA).repartition(3))
    whole = w.write_archives(rows, f"{tmp_path}/whole", file_bytes=20_000)
    listed = whole.collect()
    assert sum(r["records"] for r in listed) == 200 and len(listed) > 3
    for r in listed:
        data = open(r["path"], "rb").read()
        assert len(data.split(b"\x1f\x8b\x08")) == 2  # one gzip member
    members = w.normalise(whole, f"{tmp_path}/members")
    for r in members.collect():
        data, end = open(r["path"], "rb").read(), 0
        for line in open(r["index"]):
            entry = json.loads(line)
            assert entry["offset"] == end
            end += entry["length"]
            record = gzip.decompress(data[entry["offset"] : end])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n")
            assert entry["record_id"].encode() in record
        assert end == len(data)
        assert gzip.decompress(data) == gzip.open(r["source"]).read()
    # Normalised files are archives as well.
    again = w.normalise(members.select("path"), f"{tmp_path}/again")
    back = w.read_records(w.index_entries(again))
    assert sorted((int(r["page"]), r["uri"], r["payload"].decode()) for r in back.collect()) == pages
    assert len(os.listdir(f"{tmp_path}/again")) == 2 * again.count()


RECORD = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nX-Folded: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("data", [gzip.compress(RECORD * 3), gzip.compress(RECORD) * 3, gzip.compress(RECORD[:40]) + gzip.compress(RECORD[40:] + RECORD * 2)])
def test_any_members(data):
    out = io.BytesIO()
    entries = list(w.normalise_stream(io.BytesIO(data), out, "f"))
    assert [e["type"] for e in entries] == ["resource"] * 3 and entries[0]["record_id"] == "<urn:x:1>"
    for e in entries:
        assert gzip.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]]) == RECORD
    assert [b"".join(w.payload_pieces(r)) + r.get("x-folded").encode() for r in w.records(io.BytesIO(data), "f")] == [b"helloa b"] * 3


def test_long_records_stay_in_pieces(monkeypatch):
    monkeypatch.setattr(w, "PIECE", 1000)
    body = os.urandom(200_000)
    data = gzip.compress(RECORD + b"WARC/1.1\r\nContent-Length: 200000\r\n\r\n" + body + b"\r\n\r\n" + RECORD)
    found = []
    for record in w.records(io.BytesIO(data), "f"):
        pieces = list(record.block())
        assert max(map(len, pieces)) <= 1000
        found.append(b"".join(pieces))
    assert found == [b"hello", body, b"hello"]


@pytest.mark.parametrize("data", [
    gzip.compress(RECORD[:-12]), gzip.compress(RECORD)[:-20], gzip.compress(b"WARC/1.0\r\nX: y\r\n\r\n"), gzip.compress(b"no record"), b"plain",
    gzip.compress(RECORD[:60]), gzip.compress(RECORD)[:-4],
])
def test_broken_archives_are_refused(data):
    with pytest.raises(ValueError, match="file-name"):
        for record in w.records(io.BytesIO(data), "file-name"):
            list(record.block())


def test_empty_archives_and_tables(spark, tmp_path):
    assert list(w.normalise_stream(io.BytesIO(b""), io.BytesIO(), "f")) == []
    assert list(w.normalise_stream(io.BytesIO(gzip.compress(b"")), io.BytesIO(), "f")) == []
    whole = w.write_archives(w.page_rows(spark.createDataFrame([], SCHEMA)), f"{tmp_path}/none")
    assert whole.count() == 0
    assert w.read_records(w.index_entries(w.normalise(whole, f"{tmp_path}/none"))).count() == 0
