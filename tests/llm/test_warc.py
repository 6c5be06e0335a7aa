import base64
import gzip
import hashlib
import random

from cladeloom.llm.warc import LoserTree, archive_pages, merge_runs, url_key

PAGES = "page_id bigint, url string, html string, record string, digest string, archive string"


def check(spark, pages, found):
    first = {}
    for i, html in sorted((i, h or "") for i, _, h in pages if i is not None):
        first.setdefault(html, i)
    expected = []
    for i, _, html in pages:
        if i is not None:
            raw = (html or "").encode()
            original = first[html or ""]
            expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == original else "revisit", None if i == original else original))
    rows = found.collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key) == sorted(expected, key=key)
    order = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert order == sorted(order)


def test_round_trip_of_unusual_pages(spark, tmp_path):
    pages = [
        (3, "http://www.Example.org/b?x=1#top", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"), (1, None, None), (2, "", ""), (9, "http://a.b/\r\nX: y", "tail\r\n\r\n"),
        (5, "http://www.Example.org/b?x=1#top", "same"), (4, "https://example.org:8443", "same"), (4, "https://example.org:8443", "same"), (None, "u", "same"), (7, "not a url", "x" * 200_000), (8, "http://[bad", "\n"),
    ]
    table = spark.createDataFrame([(*p, "r", "d", "a") for p in pages], PAGES)
    check(spark, pages, archive_pages(table, folder=str(tmp_path / "archives")))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archives").glob("*.gz"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    assert archive_pages(table.limit(0), folder=str(tmp_path / "none")).count() == 0


def test_tables_of_the_driver(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    check(spark, [tuple(r) for r in table.collect()], archive_pages(table))


def test_loser_tree_merges_any_runs():
    draw = random.Random(2)
    for count in (1, 2, 3, 7, 16):
        runs = [sorted(draw.randrange(20) for _ in range(draw.randrange(6))) for _ in range(count)]
        merged = [(runs[r][p], r, p) for r, p in merge_runs(runs)]
        assert merged == sorted((v, r, p) for r, run in enumerate(runs) for p, v in enumerate(run))
    assert list(merge_runs([])) == [] and LoserTree([4]).winner == 0


def test_url_keys():
    assert url_key("http://www.Example.org:80/b?x=1#top") == "org,example)/b?x=1"
    assert url_key("https://a.b.c") == "c,b,a)/" and url_key("") == "" and url_key("https://a.b:81/x") == "b,a:81)/x"
