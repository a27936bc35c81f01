import base64
import hashlib
import random

import pytest

from tiffinlake.llm import warc


def expected(rows):
    last = {}
    for page, _, html in rows:
        key = html or ""
        if page is not None:
            last[key] = max(last.get(key, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = last.get(html or "")
        kind = "response" if page == first else "revisit"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, kind, None if page == first else first))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert result(warc.round_trip(pages)) == expected(rows)
    assert result(warc.round_trip(pages, segment_bytes=100, file_records=30)) == expected(rows)


def odd_pages(spark):
    rows = [
        (1, "http://a/%20\r\nWARC-Type: x", "<p>é日\U0001f600</p>" * 5000, 1),
        (2, None, None, 1),
        (3, "", "", 1),
        (4, "u", "same", 1),
        (9, "u", "same", 1),
        (9, "u", "same", 1),
        (None, "u", "same", 1),
        (None, "u", "alone", 1),
        (5, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n0\r\n\r\n", 1),
        (-6, "u", "\x00\x01 \r\n" * 9000, 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), [r[:3] for r in rows]


def test_odd_rows(spark):
    pages, rows = odd_pages(spark)
    assert result(warc.round_trip(pages)) == expected(rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_payloads_and_addresses_come_back(spark, tmp_path):
    pages, rows = odd_pages(spark)
    path = str(tmp_path / "archive")
    warc.write(pages.repartition(3), path, segment_bytes=50, file_records=7)
    back = warc.read(spark, path).where("record_type = 'response'").collect()
    assert sorted((r.page_id, r.payload.decode()) for r in back if r.page_id == 1 or r.page_id == -6) == [
        (-6, rows[9][2]),
        (1, rows[0][2]),
    ]
    assert {r.url for r in back if r.page_id == 1} == {rows[0][1]}


def test_chunks_round_trip():
    pick = random.Random(1)
    for size in (0, 1, 9, 10, 11, 500):
        payload = pick.randbytes(size)
        for chunk in (1, 10, 4096):
            assert warc.dechunked(warc.chunked(payload, chunk)) == payload
    for broken in (b"", b"5\r\nabc", b"zz\r\n", b"2\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(warc.BrokenArchive):
            warc.dechunked(broken)


def test_a_missing_segment_is_an_error(spark, tmp_path):
    records = warc.records_of("00000000-0000-0000-0000-000000000001", 1, "u", b"x" * 500, None, 100)
    assert len(records) > 4
    path = tmp_path / "archive"
    path.mkdir()
    import gzip

    for name, kept in (("all", records), ("some", records[:2] + records[3:])):
        (path / name).mkdir()
        pick = random.Random(2)
        mixed = list(kept)
        pick.shuffle(mixed)
        for i, part in enumerate((mixed[:2], mixed[2:])):
            (path / name / f"{i}.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in part)))
    (row,) = warc.read(spark, str(path / "all")).collect()
    assert row.payload == b"x" * 500
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, str(path / "some")).collect()
