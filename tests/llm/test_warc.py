import gzip
import hashlib
import io
import random

from geomatch.llm import warc
from geomatch.llm.common import file_system, new_folder

COLUMNS = "page_id long, url string, html string, digest string, payload string"


def plain(pages):
    firsts: dict = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100:
            firsts[b] = min(firsts.get(b, i), i, key=lambda x: (x is None, x))
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = firsts.get(b, i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def cases():
    rng = random.Random(1)
    bodies = [None, "", "short", "é" * 49, "é" * 50, "x" * 99, "x" * 100, "\r\n\r\nWARC/1.1\r\n" * 20, "y" * 300_000]
    rows = [(i, rng.choice([None, f"http://a.example/{i}", "http://b.example/ü x?q=1\r\nX: y", "no url"]), rng.choice(bodies)) for i in range(60)]
    return rows + [(None, "u", "z" * 200), (None, "u", "q" * 200), (70, "u", "q" * 200)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "p") for r in rows], COLUMNS)


def test_round_trip(spark):
    rows = cases()
    assert sorted((tuple(r) for r in warc.archive_pages(spark, table(spark, rows)).collect()), key=str) == plain(rows)


def test_payloads_come_back_whole_and_nested(spark):
    rows = cases()
    folder = new_folder(spark, "archives")
    paths = warc.write_archives(table(spark, rows), folder, file_bytes=2000)
    assert paths.count() > 3
    nested = warc.captures(warc.read_records(paths)).collect()
    assert len(nested) == len(rows) and all(r.request and r.metadata for r in nested)
    kept = sorted(bytes(r.response.payload) for r in nested if r.response.kind == "response")
    assert len(kept) == sum(p[3] == "response" for p in plain(rows))
    assert {hashlib.sha256(b).hexdigest() for b in kept} == {p[2] for p in plain(rows)}


def test_records_are_well_formed(spark):
    folder = new_folder(spark, "archives")
    paths = [r.path for r in warc.write_archives(table(spark, cases()), folder).collect()]
    ids = []
    for path in paths:
        files, at = file_system(path)
        with files.open_input_stream(at, compression=None) as raw:
            data = raw.read()
        for headers, block in warc.parse(io.BytesIO(gzip.decompress(data))):
            assert int(headers["content-length"]) == len(block) and headers["warc-target-uri"].isascii()
            assert headers["warc-type"] in ("request", "response", "revisit", "metadata")
            assert ("warc-refers-to" in headers) == (headers["warc-type"] == "revisit")
            ids.append(headers["warc-record-id"])
    assert len(ids) == len(set(ids)) == 3 * len(cases())


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "u", "a" * 200), (1, "u", "a" * 200), (2, "u", "a" * 200), (3, "u", "b"), (3, "u", "b")]
    assert sorted((tuple(r) for r in warc.archive_pages(spark, table(spark, rows)).collect()), key=str) == plain(rows)
    assert warc.archive_pages(spark, table(spark, rows).filter("false")).count() == 0


def test_many_payloads_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    rows = cases()
    assert sorted((tuple(r) for r in warc.archive_pages(spark, table(spark, rows)).collect()), key=str) == plain(rows)


def test_a_cut_archive_is_an_error():
    import pytest

    whole = warc._record("metadata", "<x>", {}, "text/plain", b"block")
    assert list(warc.parse(io.BytesIO(whole)))[0][1] == b"block"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(whole[:-7])))
