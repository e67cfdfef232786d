"""The core on demand: a query builds the tables it reads, and no more; rows of its own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayline import pipeline, session
from quayline.operators import clean as cleaning
from quayline.plans import registry
from quayline.storage import list_folders


def write_tables(spark, root, orders=12, lines=4):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")

    day = dt.datetime(2024, 1, 1, 8, 10)
    put("region", [(0, "R0")], "r_regionkey long, r_name string")
    put("nation", [(i, f"NATION_{i}", 0) for i in range(3)], "n_nationkey long, n_name string, n_regionkey long")
    put("customer", [(i, f"C{i}", i % 3) for i in range(30)], "c_custkey long, c_name string, c_nationkey long")
    put("supplier", [(i, f"S{i}", i % 3) for i in range(1, 9)], "s_suppkey long, s_name string, s_nationkey long")
    put("part", [(i, f"Brand#{i}") for i in range(26)], "p_partkey long, p_brand string")
    put("orders", [(i, i % 20, "1-URGENT") for i in range(1, orders + 1)], "o_orderkey long, o_custkey long, o_orderpriority string")
    put("lineitem", [(o, 10 + o, 1 + (o + n) % 8, 1 + n % 3, 1.0 + n, 9.5, 0.1, 0.0, "N", "O", day)
                     for o in range(1, orders + 1) for n in range(lines)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    kinds = ["click", "view", "purchase", "error", "signup"]
    put("events", [(i, day + dt.timedelta(hours=5 * i), i % 2, kinds[i % 5], 1.5, f'{{"k": {i % 9}}}') for i in range(60)],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    write_tables(spark, root)
    return root


def written(core):
    return set(list_folders(core._spark, core._root))


@pytest.mark.parametrize("label,tables", [
    ("p33_platforms_with_code", {"station", "platform"}),
    ("v04_service_frequency", {"stg_calendar_dates", "service", "service_date", "v_service_frequency"}),
    ("s11_s15_alert_shred", {"rt_alert"}),
    ("s07_feed_roundtrip", {"stg_stop_times", "stg_calendar_dates"}),
])
def test_a_query_builds_only_what_it_reads(spark, source, label, tables):
    core = pipeline.Core(spark, source, reuse=False)
    rows = registry.QUERIES[label](core).collect()
    assert rows and written(core) == tables


def test_on_demand_tables_equal_the_whole_build(spark, source):
    whole = pipeline.lazy_core(spark, source)
    core = pipeline.Core(spark, source, reuse=False).build()
    for name in whole:
        a, b = whole[name], core[name].drop("run_id")
        assert sorted(a.columns) == sorted(b.columns), name
        assert a.select(b.columns).exceptAll(b).count() == 0 == b.exceptAll(a.select(b.columns)).count(), name
    runs = core["ingestion_run"].collect()
    assert [r.status for r in runs].count("success") >= 1
    assert {r.run_id for r in core["rejected_row"].select("run_id").distinct().collect()} <= {r.run_id for r in runs}


def test_a_written_table_is_read_by_the_next_core(spark, source):
    first = pipeline.Core(spark, source)
    n = first["rejected_row"].count()
    second = pipeline.Core(spark, source)
    assert second["rejected_row"].count() == n > 0
    assert "rejected_row" not in written(second)
    log = second["ingestion_run"].filter("status = 'success'").select("run_id")
    assert second["rejected_row"].select("run_id").join(log, "run_id", "left_anti").count() == 0
    with pytest.raises(KeyError):
        second["no_such_table"]


def test_a_failed_table_is_logged_once_and_not_published(spark, source):
    core = pipeline.Core(spark, source)
    core._written["v_trip_amenity"] = lambda: core["trip"].select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    core._reuse = False
    before = [r.status for r in spark.read.parquet(f"{core._base}/ingestion_run").collect()] if pipeline.exists(
        spark, f"{core._base}/ingestion_run") else []
    with pytest.raises(Exception, match="broken"):
        core["v_trip_amenity"]
    after = [r.status for r in spark.read.parquet(f"{core._base}/ingestion_run").collect()]
    assert after.count("failed") == before.count("failed") + 1


def test_shuffles_begin_with_partitions_by_input(spark):
    first, joined = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [spark.conf.get(k, None) for k in (first, joined)]
    with pipeline._partitions(spark, 1000):
        assert spark.conf.get(first) == "1000" and spark.conf.get(joined) == f"{16 << 20}b"
    with session.settings(spark, {joined: "16k"}), pipeline._partitions(spark, 1):  # a smaller one stays
        assert spark.conf.get(joined) == "16384b" and spark.conf.get(first) == spark.conf.get("spark.sql.shuffle.partitions")
    assert [spark.conf.get(k, None) for k in (first, joined)] == before


def test_lines_are_written_without_a_sort(spark, tmp_path):
    from quayline.sources import gtfs_feed

    (tmp_path / "feed").mkdir()
    for m in ("stops", "trips"):
        (tmp_path / "feed" / f"{m}.txt").write_text("id,name\n" + "".join(f"{k},x\n" for k in range(2000)))
    writers, real = [], gtfs_feed.byte_ranges.plain_lines

    def seen(*args):
        writers.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return real(*args)

    gtfs_feed.byte_ranges.plain_lines = seen
    try:
        records = gtfs_feed.read_records(spark, str(tmp_path / "feed"), str(tmp_path / "lines"))
    finally:
        gtfs_feed.byte_ranges.plain_lines = real
    assert writers == ["16"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert {r["member"]: r["count"] for r in records.groupBy("member").count().collect()} == {"stops": 2001, "trips": 2001}


def calls(spark, rows):
    rows = [(trip, "08:00:00", "08:00:00", "P", seq, None, "0", "0", line) for trip, seq, line in rows]
    return spark.createDataFrame(rows, "trip_id string, arrival_time string, departure_time string, stop_id string, "
                                       "stop_sequence string, stop_headsign string, pickup_type string, drop_off_type string, src_line_no long")


def test_only_repeated_calls_meet_their_first_line(spark):
    kept = {}

    def put(name, df):
        kept[name] = df.localCheckpoint()
        return kept[name]

    staged = calls(spark, [("T", "1", 5), ("T", "1", 3), ("T", "2", 9), (None, "1", 4), (None, "1", 2), ("T", "x", 8), ("T", "y", 7),
                           ("U", "1", None), ("U", "1", None), ("U", "2", None), ("U", "2", 6)])
    trips = spark.createDataFrame([("T",), ("U",)], "trip_id string")
    platforms = spark.createDataFrame([("P",)], "stop_id string")
    out = cleaning.screen_stop_times(staged, trips, platforms, put=put)
    assert kept["stop_time_repeated"].count() == 5  # not a row for every call
    got = {(r.trip_id, r.stop_sequence, r.src_line_no, r._first_line, r.is_first_copy) for r in out.collect()}
    assert got == {("T", 1, 5, 3, False), ("T", 1, 3, 3, True), ("T", 2, 9, 9, True), (None, 1, 4, 2, False), (None, 1, 2, 2, True),
                   ("T", None, 8, 7, False), ("T", None, 7, 7, True), ("U", 1, None, None, True), ("U", 2, None, 6, False), ("U", 2, 6, 6, True)}
    assert out.count() == 11


def test_headers_are_not_read_by_one_task(spark, tmp_path, monkeypatch):
    from quayline.sources import gtfs_feed

    (tmp_path / "feed" / "stops.txt").mkdir(parents=True)
    for i in range(6):
        (tmp_path / "feed" / "stops.txt" / f"part-{i}.csv").write_text("stop_id,stop_name\n" + f"S{i},x\n" * 500)
    coalesced = []
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda df, n: coalesced.append(n) or df)
    gtfs_feed.stage_lines(spark, str(tmp_path / "feed"), str(tmp_path / "lines"), ranges=24)
    headers = spark.read.parquet(str(tmp_path / "lines" / "headers"))
    assert headers.count() == 6 and len(headers.inputFiles()) == 1
    assert coalesced == []  # it would put the scan of all lines into one task


def test_staged_calls_are_shuffled_once(spark):
    staged = calls(spark, [("T", "1", 5), ("T", "1", 3), ("T", "2", 9), (None, "1", 4)])
    trips = spark.createDataFrame([("T",)], "trip_id string").localCheckpoint()
    platforms = spark.createDataFrame([("P",)], "stop_id string").localCheckpoint()
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    with session.settings(spark, small), pipeline._partitions(spark, 1):
        out = cleaning.screen_stop_times(staged.localCheckpoint(), trips, platforms, put=lambda name, df: df.localCheckpoint())
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 4
    # the calls, the trips and the repeated keys by trip; calls and platforms once more where platforms are many
    assert plan.count("Exchange hashpartitioning(_trip") + plan.count("Exchange hashpartitioning(trip_id") == 3
    assert plan.count("Exchange hashpartitioning(") == 5


def test_core_tables_are_compressed_with_zstd(spark, source):
    core = pipeline.Core(spark, source, reuse=False)
    assert all(".zstd." in f for f in core["service"].inputFiles())
