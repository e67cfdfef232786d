import base64
import gzip
import hashlib
import os

from quayline.llm import warc
from quayline.llm.common import shared_path
from tests.llm.data import duck, oracle_rows, rows_of

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
SCHEMA = "page_id long, url string, html string, key string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, "http://a/x", "<html>one</html>"), (2, "http://b/ y\r\nz", "<html>one</html>"), (3, None, ""), (4, "http://c/", None),
    (5, "http://d/", "two\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "http://é/", "ü日本" * 5000),
    (7, "http://e/", "<html>one</html>"), (9, "http://e/", "ü日本" * 5000), (8, "http://f/", "x" * 400_000),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archive(spark, rows, **more):
    path = shared_path(spark, "test-warc")
    got = warc.archive(warc.captures(pages(spark, rows), "page_id", "url", "html"), path, **more)
    return got.withColumnRenamed("key", "page_id"), path


def test_archive_reads_back_as_brute_force_says(spark):
    got, path = archive(spark, ROWS)
    first = {}
    for i, _, html in sorted(ROWS):
        first.setdefault(digest(html), i)
    want = [(i, len((h or "").encode()), digest(h), "response" if first[digest(h)] == i else "revisit",
             None if first[digest(h)] == i else first[digest(h)]) for i, _, h in ROWS]
    assert rows_of(got, *COLUMNS) == sorted(want, key=repr)
    held = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz"))
    assert held.count(b"<html>one</html>") == 1  # the payload is stored once


def test_archive_matches_sql(spark):
    got, _ = archive(spark, ROWS)
    con = duck(pages=pages(spark, ROWS).select("page_id", "url", "html"))
    assert rows_of(got, *COLUMNS) == oracle_rows(con, warc.oracle_sql(), *COLUMNS)


def test_short_payloads_stay_responses(spark):
    got, _ = archive(spark, ROWS, min_bytes=100)
    assert {r["page_id"] for r in got.filter("record_type = 'revisit'").collect()} == {9}


def test_null_and_repeated_keys(spark):
    rows = [(None, "http://a/", "same"), (5, "http://b/", "same"), (5, "http://b/", "same"), (7, "http://c/", "same")]
    got, _ = archive(spark, rows)
    want = [(None, "response", None), (5, "response", None), (5, "response", None), (7, "revisit", 5)]
    assert rows_of(got, "page_id", "record_type", "refers_to") == sorted(want, key=repr)


def test_empty_table(spark):
    got, _ = archive(spark, [])
    assert got.count() == 0


def test_deduplicate_rewrites_archives(spark):
    source, target = shared_path(spark, "a"), shared_path(spark, "b")
    rows = warc.captures(pages(spark, ROWS), "page_id", "url", "html")
    none = warc.revisits(rows).limit(0)
    warc.write_archives(rows, none, source, 1 << 20)  # every page a response
    assert warc.read_records(spark, source).filter("record_type = 'response'").count() == len(ROWS)
    warc.deduplicate(spark, source, target)
    got = warc.resolved(warc.read_records(spark, target)).withColumnRenamed("key", "page_id")
    want, _ = archive(spark, ROWS)
    assert rows_of(got, *COLUMNS) == rows_of(want, *COLUMNS)
    again = shared_path(spark, "c")
    warc.deduplicate(spark, target, again)  # revisits of the source stay revisits
    got = warc.resolved(warc.read_records(spark, again)).withColumnRenamed("key", "page_id")
    assert rows_of(got, *COLUMNS) == rows_of(want, *COLUMNS)
    texts = {r["key"]: r["payload"] for r in warc.read_records(spark, again, True).filter("record_type = 'response'").collect()}
    assert texts[5] == ROWS[4][2] and texts[6] == ROWS[5][2]
