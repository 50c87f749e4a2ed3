import gzip
import hashlib
import random

import duckdb
import pytest
from corpus_curator.llm import oracle, warc

BIG = "x" * 1200 + "é"
TRICKY = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20
PAGES = [
    (1, "http://a.example/x", BIG), (5, "http://a.example/x", BIG), (3, None, BIG),
    (None, "https://B.example:443/Y#f", BIG), (5, "http://a.example/x", BIG),
    (7, "http://c.example/", "short"), (8, "http://c.example/", "short"),
    (9, "http://d.example/\r\nEvil: 1", None), (10, "", ""), (11, "http://e.example", TRICKY),
    (12, "http://e.example", TRICKY), (-4, "http://a.example/x", "y" * 999 + "z"),
    (2**62, "http://a.example/x", "y" * 999 + "z"), (13, "http://z.example/ä", "\r\n\r\n" * 300),
    (None, None, "q" * 1500), (None, None, "q" * 1500),
]


def expected(pages):
    kept = {}
    for i, (page, _, html) in enumerate(pages):
        h = (html or "").encode()
        if len(h) >= warc.MIN_REVISIT:
            kept.setdefault(h, []).append((page is not None, page or 0, i))
    out = []
    for i, (page, _, html) in enumerate(pages):
        h = (html or "").encode()
        top = max(kept[h]) if h in kept else None
        again = top is not None and top[2] != i
        out.append((page, len(h), hashlib.sha1(h).hexdigest(),
                    "revisit" if again else "response", top[1] if again and top[0] else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr(
        "*", "1 AS row", "'x' AS sha1", "'y' AS row_number")


@pytest.mark.parametrize("archive", [1, 5000, 1 << 24])
def test_archives_read_back(spark, archive):
    found = warc.archived(frame(spark, PAGES).repartition(3), archive=archive).cache()
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=str) == expected(PAGES)
    assert found.filter("not intact").count() == 0
    rows = found.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(PAGES)))
    keys = [(r.url_key.encode(), r.captured, r.row) for r in rows]
    assert keys == sorted(keys)


def test_sql_agrees(spark):
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    got = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle.OP13})").fetchall()
    assert sorted(got, key=str) == expected(PAGES)


def test_histories_over_several_ranges_count_captures(spark):
    rng = random.Random(4)
    pages = [(i, "http://hot.example/" if i % 3 else f"http://h{rng.randrange(40)}.example/p",
              f"page {i}") for i in range(600)]
    path = warc.scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark, pages).repartition(5), path, archive=2000)
    rows = warc.histories(warc.read_archives(spark, path), range_rows=50, sample=300).collect()
    rows.sort(key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(600))
    keys = [(r.url_key.encode(), r.captured, r.row) for r in rows]
    assert keys == sorted(keys)
    seen = {}
    for r in rows:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture == seen[r.url_key]
    r = rows[77]  # offset and length find the record in its archive
    name = "/" + r.archive.removeprefix("file:").lstrip("/")
    (_, _, fields, block), = warc.walk(gzip.open(name).read()[r.offset:r.offset + r.length])
    assert warc._payload(fields, block)[0].decode() == f"page {r.page_id}"


def test_no_pages(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(9))) for _ in range(k)]
        merged = list(warc.LoserTree([[(x, (x, i)) for x in r] for i, r in enumerate(runs)]))
        assert merged == sorted((x, i) for i, r in enumerate(runs) for x in r)


def test_url_key():
    assert warc.url_key("https://User@WWW.Example.org:443/A?b#c") == "org,example,www)/a?b"
    assert warc.url_key("http://a.b") == "b,a)/"
    assert warc.url_key(None) == ")/"


def test_cut_record_is_an_error():
    data = warc.format_record("u", "t", "<urn:page:1:1>", b"abc", 3, b"\0" * 20, None)
    assert len(list(warc.walk(data + data))) == 2
    with pytest.raises(ValueError):
        list(warc.walk(data[:-6]))
