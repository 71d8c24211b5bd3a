"""Archives: round trips, ranges of any size, false candidates, records of others."""

import hashlib
import io
import random

import pyarrow as pa
import pytest

from panelforge.llm import warc

TEXT = "<p>" + "a page of some length, equal in several rows " * 4 + "</p>"
ROWS = [(5, "http://a/5", TEXT), (3, "http://a/3 x\r\ny", TEXT), (3, None, TEXT), (None, "u", TEXT), (9, "u", "short"), (8, "u", "short"), (7, "u", None), (6, "u", ""), (2, "ü", "é" * 49 + "x"), (1, "ü", "é" * 49 + "x"), (11, "u", "é" * 50), (10, "u", "é" * 50), (None, "v", "z" * 300), (None, "w", "z" * 300)]


def expected(rows):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append((page is None, page or 0))
    out = []
    for payload, members in groups.items():
        for i, (none, page) in enumerate(sorted(members)):
            again = len(payload) >= 100 and i > 0
            first = min(members)
            out.append((None if none else page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[1] if again and not first[0] else None))
    return sorted(out, key=str)


def digest(files, **how):
    rows = warc.read_archives(files, **how).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "other") for r in ROWS], "page_id long, url string, html string, _file string").repartition(3)
    files = warc.write_archives(pages, file_bytes=900)
    assert files.count() > 3
    for size in (64, 1000, 1 << 20):
        assert digest(files, range_bytes=size) == expected(ROWS)
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_archives(files).filter("record_type = 'response'").collect()}
    assert texts == {(r[0], (r[2] or "")) for r in ROWS if r[2] not in (TEXT, "é" * 50, "z" * 300)} | {(3, TEXT), (10, "é" * 50), (None, "z" * 300)}
    urls = {r["url"] for r in warc.read_archives(files).collect()}
    assert "http://a/3%20x%0D%0Ay" in urls and None in urls


def test_empty_and_lone(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0
    long = spark.createDataFrame([(1, "u", "word " * 400_000)], "page_id long, url string, html string")
    assert digest(warc.write_archives(long), range_bytes=512) == expected([(1, "u", "word " * 400_000)])


def archive(payloads):
    data, places = warc.member([("WARC-Type", "warcinfo")], b""), []
    for i, p in enumerate(payloads):
        places.append(len(data))
        data += warc.page_record(i, i, "u", p, hashlib.sha256(p).hexdigest(), None, "2000-01-01T00:00:00Z")
    return data, places


@pytest.mark.parametrize("step", [1, 7, 100, 4096, 1 << 22])
def test_every_record_has_one_owner(step):
    noise = random.Random(4)
    odd = [noise.randbytes(n) for n in (0, 3, 700, 5000)] + [b"\x1f\x8b\x08" * 500, noise.randbytes(900) + b"\x1f\x8b\x08\x00" + noise.randbytes(900), b"plain " * 30_000]
    data, places = archive(odd if step > 1 else odd[:3])
    if step > 7:
        data = b"leading junk" + data + b"\x1f\x8b"
        places = [p + 12 for p in places]
    seen = []
    for start in range(0, len(data), step):
        for place, content in warc.members(pa.PythonFile(io.BytesIO(data), "r"), start, min(start + step, len(data))):
            for fields, block in warc.parsed(content):
                if fields["warc-type"] == "response":
                    seen.append((place, block.split(b"\r\n\r\n", 1)[1]))
    assert [p for p, _ in seen] == places and [b for _, b in seen] == odd[: len(places)]


def test_records_of_others(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\n<html>"
    data = warc.member([("WARC-Type", "request")], b"GET /") + warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://b")], body)
    (tmp_path / "o.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/o.warc.gz", len(data))], "path string, n_bytes long")
    got = warc.read_archives(files).collect()
    assert [(r["page_id"], r["url"], bytes(r["payload"]), r["payload_digest"]) for r in got] == [(None, "http://b", b"<html>", hashlib.sha256(b"<html>").hexdigest())]
    wrong = warc.page_record(1, 1, "u", b"x" * 200, hashlib.sha256(b"y").hexdigest(), None, "d")
    (tmp_path / "w.warc.gz").write_bytes(wrong)
    with pytest.raises(Exception, match="not that of its digest"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/w.warc.gz", len(wrong))], "path string, n_bytes long")).collect()
