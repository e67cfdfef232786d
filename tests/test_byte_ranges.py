"""The feed reader cut into byte ranges, and zip members read through their directory."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quayline.sources import byte_ranges, gtfs_feed

TRICKY = ('stop_id,stop_name,stop_desc\r\n"S1","Al ""q"" pha\nNorth, East",x\nS2,5" pipe,"a\n\n\nb"\n\nS3,one\nS4,a,b,c,d\n'
          '"S5"tail,"",\'\n"S6","multi\r\nline",é☃\nS7,,"last, ""with"" quote"')


def read(spark, path, ranges):
    rows = gtfs_feed.read_records(spark, str(path), ranges=ranges).select("archive", "member", "record_no", "fields").collect()
    return sorted((r.archive.rsplit("/", 1)[-1], r.member, r.record_no, tuple(r.fields)) for r in rows)


def expected(name, member, text):
    return [(name, member, n, tuple(f)) for n, f in enumerate(csv.reader(io.StringIO(text, newline="")), start=1)]


def test_line_state_agrees_with_a_csv_reader():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice('a",\n') for _ in range(rng.randint(1, 14)))
        lines, inside, records = text.split("\n"), False, 0
        for line in lines:
            inside = byte_ranges.inside_after(line.encode(), inside)
            records += not inside
        records += inside - (lines[-1] == "" and not inside)
        assert records == len(list(csv.reader(io.StringIO(text, newline="")))), text


@pytest.mark.parametrize("ranges", [1, 8, 60])
def test_ranges_give_the_records_of_one_pass(spark, tmp_path, ranges):
    (tmp_path / "stops.txt").write_bytes(b"\xef\xbb\xbf" + TRICKY.encode())
    assert read(spark, tmp_path, ranges) == expected("stops.txt", "stops", TRICKY)


def test_a_field_longer_than_many_ranges(spark, tmp_path):
    text = 'a,b\n1,"' + "x,y\n" * 500 + '"\n2,"' + 'z""\n' * 300 + '"\n3,c\n'
    (tmp_path / "trips.txt").write_text(text, newline="")
    assert read(spark, tmp_path, 40) == expected("trips.txt", "trips", text)
    stage = str(tmp_path / "stage")
    gtfs_feed.stage_lines(spark, str(tmp_path / "trips.txt"), stage, ranges=40)
    starts = spark.read.parquet(f"{stage}/starts")
    assert starts.count() > 20 and starts.filter("inside").count() > 10  # most ranges begin inside a field


def test_an_unclosed_quote_reaches_to_the_end(spark, tmp_path):
    text = 'a,b\n1,"open, and\nnever ""closed\n2,x'
    (tmp_path / "trips.txt").write_text(text)
    assert read(spark, tmp_path, 5) == expected("trips.txt", "trips", text)


def test_random_files_in_random_ranges(spark, tmp_path):
    rng = random.Random(11)
    want = []
    for i in range(6):
        text = "h\n" + "".join(rng.choice(['a', 'b,c', '"', '""', ',', '\n', '\n', '"x\ny"', ',"q""r",']) for _ in range(150))
        (tmp_path / f"m{i}.txt").write_text(text, newline="")
        want += expected(f"m{i}.txt", f"m{i}", text)
    assert read(spark, tmp_path, 45) == sorted(want)


def test_zip_members_are_read_through_the_directory(spark, tmp_path, monkeypatch):
    big = "id,name\n" + "".join(f'{i},"name {i * i % 977}\nnext"\n' for i in range(30_000))
    raw = bytes(random.Random(2).randrange(256) for _ in range(400_000))
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("folder/trips.txt", big, zipfile.ZIP_DEFLATED)
        z.writestr("noise.bin", raw, zipfile.ZIP_STORED)  # not a member; full of line feeds and signatures
        z.writestr("stops.txt", TRICKY, zipfile.ZIP_STORED)
        z.writestr("empty.txt", "")
        z.comment = b"a comment\n at the end"
    want = expected("f.zip", "trips", big) + expected("f.zip", "stops", TRICKY)
    assert read(spark, tmp_path, 9) == sorted(want)
    stage = str(tmp_path / "stage")
    gtfs_feed.stage_lines(spark, str(tmp_path / "f.zip"), stage, ranges=9)
    pieces = spark.read.parquet(f"{stage}/_pieces")
    assert pieces.count() > 2 and pieces.agg(F.max(F.octet_length("data"))).first()[0] < 2 * byte_ranges.PIECE_BYTES
    tasks = byte_ranges.zip_lines(spark, [str(tmp_path / "f.zip")], stage).select("entry", F.spark_partition_id().alias("p")).distinct()
    assert tasks.select("p").distinct().count() == tasks.count() == 2  # a task for each member


def test_zip64_and_damaged_archives(spark, tmp_path):
    (tmp_path / "wide").mkdir()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        with z.open("stops.txt", "w", force_zip64=True) as f:
            f.write(TRICKY.encode())
    (tmp_path / "wide" / "w.zip").write_bytes(buf.getvalue())
    assert read(spark, tmp_path / "wide", 3) == expected("w.zip", "stops", TRICKY)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.zip").write_bytes(buf.getvalue()[:-30])
    with pytest.raises(Exception, match="no end of a zip archive"):
        read(spark, tmp_path / "cut", 3)


def test_zip64_directory_fields():
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 7_000_000_000, 5_000_000_000, 6_000_000_000)
    entry = struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 8, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 5, len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    assert list(byte_ranges.directory_entries(entry + b"a.txt" + extra)) == [("a.txt", 8, 5_000_000_000, 6_000_000_000)]
    record = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, 81, 9_000_000_000)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, 9_000_000_081, 1)
    end = struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert byte_ranges.directory_place("x", b"abc" + record + locator + end, 9_000_000_078) == (9_000_000_000, 81)


def test_mismatches_and_numbers_do_not_depend_on_the_ranges(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes(TRICKY.encode())
    got = []
    for ranges in (1, 8):
        recs = gtfs_feed.read_records(spark, str(tmp_path), ranges=ranges)
        df = gtfs_feed.staged_member(recs, gtfs_feed.member_listing(recs), "stops")
        got.append(sorted((r.src_line_no, r.stop_id, r.stop_desc, r._shape_mismatch) for r in df.collect()))
    assert got[0] == got[1] and [r[0] for r in got[0]] == [2, 3, 4, 5, 6, 7, 8, 9]
    assert [r[0] for r in got[0] if r[3]] == [4, 5, 6]  # an empty record, one with too few and one with too many fields
