"""The mini feed end to end: reader, every cleaning rule, views."""

import pytest
from pyspark.sql import functions as F

from quayline.sources import gtfs_feed


def count(df):
    return df.count()


def rules(t, table):
    rows = t["rejected_row"].filter(F.col("source_table") == f"stg_{table}").groupBy("rule_code").count().collect()
    return {r["rule_code"]: r["count"] for r in rows}


def test_core_totals(feed_tables):
    t = feed_tables
    assert count(t["station"]) == 2
    assert count(t["platform"]) == 5
    assert count(t["route"]) == 2
    assert count(t["service"]) == 3
    assert count(t["service_date"]) == 8
    assert count(t["trip"]) == 4
    assert count(t["stop_time"]) == 6
    assert count(t["transfer"]) == 1


def test_accounting_identity_for_calls(feed_tables):
    t = feed_tables
    staged = count(t["stg_stop_times"])
    assert staged == 12
    assert count(t["stop_time"]) + sum(rules(t, "stop_times").values()) == staged


def test_one_reject_per_call_rule(feed_tables):
    assert rules(feed_tables, "stop_times") == {
        "DQ-05-DUPLICATE-CALL": 1,
        "DQ-08-BAD-STOP-SEQUENCE": 1,
        "DQ-03-IMPLAUSIBLE-DEPARTURE": 1,
        "DQ-04-ORPHAN-STOP-TIME-TRIP": 1,
        "DQ-04-ORPHAN-STOP-TIME-PLATFORM": 1,
        "DQ-08-NO-TIME": 1,
    }


def test_other_member_rules(feed_tables):
    t = feed_tables
    assert rules(t, "stops") == {"DQ-04-ORPHAN-PLATFORM": 1, "DQ-08-UNSUPPORTED-LOCATION-TYPE-QL": 1}
    # the duplicate-date rule has a summary row per date and a row for each line it displaced
    assert rules(t, "calendar_dates") == {
        "DQ-04-ORPHAN-SERVICE-DATE": 1, "DQ-05-DUPLICATE-SERVICE-DATE": 1, "QL-SURPLUS-SERVICE-DATE": 1}
    assert rules(t, "trips") == {"DQ-09-ORPHAN-TRIP": 1}
    assert rules(t, "transfers") == {"DQ-04-ORPHAN-TRANSFER-QL": 1}
    assert rules(t, "translations") == {"DQ-07-TRANSLATION-FILTERED-QL": 1}


def test_reader_goes_by_header_name(feed_tables):
    st = {r["station_id"]: r for r in feed_tables["station"].collect()}
    assert st["S1"]["station_name"] == "Alpha" and st["S1"]["wheelchair_boarding"] == 1
    assert st["S2"]["wheelchair_boarding"] == 0  # blank -> no information, not "no"
    agency = feed_tables["agency"].first()
    assert agency["agency_id"] == "AGX"  # BOM stripped from the first header name
    assert agency["agency_timezone"] == "Europe/Brussels"


def test_unknown_columns_reported(feed_tables):
    cols = {(r["member"], r["column"]) for r in feed_tables["unknown_columns"].collect()}
    assert ("agency", "agency_fare_url") in cols
    assert ("feed_info", "default_lang") in cols


def test_one_codeless_platform_per_station(feed_tables):
    rows = feed_tables["platform"].filter(F.col("platform_code").isNull()).collect()
    assert sorted(r["station_id"] for r in rows) == ["S1", "S2"]
    assert all(r["has_platform_code"] == 0 for r in rows)


def test_feed_dates_with_leading_space(feed_tables):
    f = feed_tables["feed_info"].first()
    assert str(f["feed_start_date"]) == "2025-01-01"
    assert str(f["feed_end_date"]) == "2025-01-31"


def test_call_after_midnight(feed_tables):
    r = feed_tables["stop_time"].filter(F.col("trip_id") == "T2").filter(F.col("stop_sequence") == 1).first()
    assert r["departure_time"] == "24:10:00"
    assert r["departure_secs"] == 87000 and r["departure_hour"] == 0 and r["day_offset"] == 1


def test_duplicate_keeps_first_line(feed_tables):
    r = feed_tables["stop_time"].filter((F.col("trip_id") == "T1") & (F.col("stop_sequence") == 2)).collect()
    assert len(r) == 1 and r[0]["departure_time"] == "08:30:00"


def test_rejected_payload_keeps_text(feed_tables):
    r = feed_tables["rejected_row"].filter(F.col("rule_code") == "DQ-03-IMPLAUSIBLE-DEPARTURE").first()
    assert '"departure_time":"87:39:00"' in r["payload"]
    assert r["src_line_no"] == 9  # header is record 1


def test_bad_sequence_never_becomes_zero(feed_tables):
    assert feed_tables["stop_time"].filter(F.col("stop_sequence") == 0).count() == 0
    origin = feed_tables["v_trip_origin"].filter(F.col("trip_id") == "T3").first()
    assert origin["stop_sequence"] == 2


def test_departures_exclude_pass_through(feed_tables):
    dep = feed_tables["v_departure"]
    assert dep.count() == 5
    assert dep.filter((F.col("trip_id") == "T2") & (F.col("stop_sequence") == 2)).count() == 0


def test_frequency_classes_and_week_boundary(feed_tables):
    f = {r["service_id"]: r for r in feed_tables["v_service_frequency"].collect()}
    assert f["WK"]["frequency_class"] == "High Frequency" and f["WK"]["operating_days"] == 5
    assert f["WE"]["frequency_class"] == "Medium Frequency" and f["WE"]["active_weeks"] == 1
    assert f["ONE"]["frequency_class"] == "Low Frequency/Special"


def test_amenity_unknown_is_not_no(feed_tables):
    a = {r["trip_id"]: r for r in feed_tables["v_trip_amenity"].collect()}
    assert a["T1"]["guarantees_bikes"] == 1 and a["T1"]["wheelchair_is_unknown"] == 1
    assert a["T3"]["bikes_is_unknown"] == 1 and a["T3"]["guarantees_any_amenity"] == 0
    assert a["T4"]["wheelchair_accessible"] == 2 and a["T4"]["wheelchair_is_unknown"] == 0


def test_trip_days_equal_two_ways(feed_tables):
    """Trip-days by frequency class equal the sum of V02 (an identity the reference states)."""
    t = feed_tables
    v02 = t["v_trip_service_days"].agg(F.sum("operating_days")).first()[0]
    via = t["v_service_frequency"].join(t["trip"], "service_id").agg(F.sum("operating_days")).first()[0]
    assert v02 == via == 5 + 2 + 1 + 5


def test_missing_required_member(spark, tmp_path):
    from tests.conftest import MINI_FEED, write_feed

    members = {k: v for k, v in MINI_FEED.items() if k != "trips.txt"}
    write_feed(tmp_path / "broken.zip", members)
    with pytest.raises(gtfs_feed.MissingMemberError):
        gtfs_feed.staged_members(spark, str(tmp_path))


def test_missing_optional_member_is_empty(spark, tmp_path):
    from tests.conftest import MINI_FEED, write_feed

    members = {k: v for k, v in MINI_FEED.items() if k != "transfers.txt"}
    write_feed(tmp_path / "no_transfers.zip", members)
    staged, report, listing = gtfs_feed.staged_members(spark, str(tmp_path))
    assert staged["transfers"].count() == 0
    assert "transfers" not in listing["present"]


def test_quoted_newline_counts_records(spark, tmp_path):
    (tmp_path / "stops.txt").write_text(
        'stop_id,stop_name,location_type\nS1,"Alpha\nNorth",1\nS2,Beta,1\nS3,Gamma,1,extra\n', encoding="utf-8")
    recs = gtfs_feed.read_records(spark, str(tmp_path))
    headers = gtfs_feed.member_listing(recs)
    df = gtfs_feed.staged_member(recs, headers, "stops")
    rows = {r["stop_id"]: r for r in df.collect()}
    assert rows["S2"]["src_line_no"] == 3  # records, not physical lines
    assert rows["S1"]["stop_name"] == "Alpha\nNorth"
    assert df.filter("_shape_mismatch").count() == 1


def test_constraint_catalogue_holds(feed_tables):
    from quayline.operators import constraints

    rep = constraints.constraint_report(feed_tables)
    assert rep.count() > 40
    assert rep.filter(F.col("violations") > 0).count() == 0
    constraints.enforce(feed_tables)


def test_constraint_violation_is_reported(spark, feed_tables):
    from quayline.operators import constraints

    t = dict(feed_tables)
    t["trip"] = t["trip"].unionByName(t["trip"].limit(1))  # a duplicated primary key
    bad = constraints.constraint_report(t).filter(F.col("violations") > 0).collect()
    assert [(r.table_name, r.constraint_name, r.violations) for r in bad] == [("trip", "unique (trip_id)", 1)]
    with pytest.raises(ValueError):
        constraints.enforce(t)


def test_result_csv_sink(spark, feed_tables, tmp_path):
    from quayline.plans import peak, publish

    counts = publish.publish_all({"a02": peak.a02_naive_timetable_rows_by_hour}, feed_tables, str(tmp_path))
    back = spark.read.option("header", "true").csv(str(tmp_path / "a02"))
    assert back.count() == counts["a02"] and "pct_of_rows" in back.columns
    assert len([p for p in (tmp_path / "a02").iterdir() if p.name.endswith(".csv")]) == 1


def test_junk_codes_and_coordinates_of_stops_are_quarantined(spark):
    from quayline.operators import clean as cleaning

    rows = [(1, "S1", "A", "50.1", "4.1", "1", "", "1"), (2, "S2", "B", "north", "4.2", "1", "", "1"), (3, "S3", "C", " ", "", "1", "", "yes"),
            (4, "P1", "A1", "50.1", "4.1", "0", "S1", "junk"), (5, "P2", "A2", "50.1", "east", "0", "S1", ""),
            (6, "P3", "B1", "50.1", "4.1", "0", "S2", ""), (7, "X", "X", "x", "x", "3", "", "")]
    stg = spark.createDataFrame(rows, "src_line_no long, stop_id string, stop_name string, stop_lat string, stop_lon string, "
                                      "location_type string, parent_station string, wheelchair_boarding string").selectExpr(
        "*", "'' AS platform_code", "'' AS stop_desc")
    station = cleaning.stations(stg)
    platform, rejected = cleaning.platforms(stg, station)
    assert [r.station_id for r in station.collect()] == ["S1"] and [r.stop_id for r in platform.collect()] == ["P1"]
    assert sorted((r.src_line_no, r.rule_code, r.reason is not None) for r in rejected.collect()) == [
        (2, "DQ-08-BAD-CODE-QL", True), (3, "DQ-08-BAD-CODE-QL", True), (5, "DQ-08-BAD-CODE-QL", True),
        (6, "DQ-04-ORPHAN-PLATFORM", True), (7, "DQ-08-UNSUPPORTED-LOCATION-TYPE-QL", True)]


def _variant_feed(spark, tmp_path, **options):
    from quayline import pipeline
    from quayline.operators import clean as cleaning
    from tests.conftest import MINI_FEED, write_feed

    members = dict(MINI_FEED)
    # first copy of (T4, 2) is itself rejected (no time), the second copy is good
    members["stop_times.txt"] = MINI_FEED["stop_times.txt"] + ",,0,0,,,P2a,9,T4\n10:00:00,10:00:00,0,0,,,P2a,9,T4\n"
    members["calendar.txt"] = MINI_FEED["calendar.txt"].replace(
        "20250112,0,0,0,WK,20250106,0,0,0,0", "20250119,1,1,0,WK,20250106,0,1,1,1")
    members["calendar_dates.txt"] = MINI_FEED["calendar_dates.txt"] + "20250115,2,WK\n20250118,1,WK\n"
    tmp_path.mkdir(parents=True, exist_ok=True)
    write_feed(tmp_path / "variant.zip", members)
    staged, _, _ = __import__("quayline.sources.gtfs_feed", fromlist=["x"]).staged_members(spark, str(tmp_path))
    out = cleaning.clean(staged, **options)
    return pipeline.add_views(dict(out.tables, rejected_row=out.rejected))


def test_duplicate_rank_strict_vs_after_screening(spark, tmp_path):
    strict = _variant_feed(spark, tmp_path / "a")
    key = (F.col("trip_id") == "T4") & (F.col("stop_sequence") == 9)
    assert strict["stop_time"].filter(key).count() == 0  # both copies lost, as the reference does
    relaxed = _variant_feed(spark, tmp_path / "b", rank_after_screening=True)
    rows = relaxed["stop_time"].filter(key).collect()
    assert len(rows) == 1 and rows[0]["departure_time"] == "10:00:00"


def test_expand_calendar_option(spark, tmp_path):
    base = _variant_feed(spark, tmp_path / "c")
    wk = base["service_date"].filter((F.col("service_id") == "WK") & (F.col("exception_type") == 1))
    assert wk.count() == 6  # calendar_dates only: 5 Mon-Fri + the added Saturday 18th; the weekly pattern is ignored
    expanded = _variant_feed(spark, tmp_path / "d", expand_calendar=True)
    dates = sorted(str(r["service_date"]) for r in expanded["service_date"].filter(F.col("service_id") == "WK")
                   .collect())
    # Mon-Fri 6-10 Jan and 13-17 Jan from the pattern, minus removed 15th, plus added Saturday 18th
    assert dates == ["2025-01-06", "2025-01-07", "2025-01-08", "2025-01-09", "2025-01-10",
                     "2025-01-13", "2025-01-14", "2025-01-16", "2025-01-17", "2025-01-18"]


def test_exported_feed_comes_back_as_it_was(spark, tmp_path):
    rows = [("S1", " Alpha "), ("S2", 'a "q" b\\'), ("S3", "x\ny,\x1fz"), ("S4", None), ("S5", "")]
    stops = spark.createDataFrame([(i, n, "1") for i, n in rows], "stop_id string, stop_name string, location_type string")
    gtfs_feed.export_feed({"stops": stops}, str(tmp_path / "f"))
    recs = gtfs_feed.read_records(spark, str(tmp_path / "f"))
    back = gtfs_feed.staged_member(recs, gtfs_feed.member_listing(recs), "stops")
    assert {(r.stop_id, r.stop_name) for r in back.collect()} == {(i, n or "") for i, n in rows}


def test_line_numbers_are_unique_over_archives(spark, tmp_path):
    from quayline.operators import clean as cleaning
    from tests.conftest import MINI_FEED, write_feed

    write_feed(tmp_path / "a.zip", MINI_FEED)
    write_feed(tmp_path / "b.zip", MINI_FEED)
    staged, _, _ = gtfs_feed.staged_members(spark, str(tmp_path))
    lines = staged["stop_times"].select("src_line_no")
    assert lines.distinct().count() == lines.count()
    for name in ("agency", "stops", "trips", "routes", "calendar"):  # the dimensions of one archive
        staged[name] = staged[name].filter(F.col("src_line_no") < gtfs_feed.FILE_LINES)
    out = cleaning.clean(staged)
    calls = out.tables["stop_time"]
    assert calls.groupBy("trip_id", "stop_sequence").count().filter("count > 1").count() == 0
    assert calls.count() > 0


def test_each_archive_needs_the_required_members(spark, tmp_path):
    from tests.conftest import MINI_FEED, write_feed

    write_feed(tmp_path / "whole.zip", MINI_FEED)
    write_feed(tmp_path / "part.zip", {k: v for k, v in MINI_FEED.items() if k != "trips.txt"})
    with pytest.raises(gtfs_feed.MissingMemberError):
        gtfs_feed.staged_members(spark, str(tmp_path))


def test_bytes_that_are_not_text_are_counted(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes(b"stop_id,stop_name\nS1,caf\xe9\nS2,caf\xc3\xa9\n")
    recs = gtfs_feed.read_records(spark, str(tmp_path))
    got = {r.stop_id: (r.stop_name, r._damaged) for r in
           gtfs_feed.staged_member(recs, gtfs_feed.member_listing(recs), "stops").collect()}
    assert got == {"S1": ("caf�", True), "S2": ("café", False)}


def test_feed_is_written_and_read_back(spark, tmp_path):
    from quayline import pipeline
    from tests.conftest import MINI_FEED, write_feed

    (tmp_path / "in").mkdir()
    write_feed(tmp_path / "in" / "feed.zip", MINI_FEED)
    t = pipeline.build_feed(spark, str(tmp_path / "in"), str(tmp_path / "out"), fail_on_error=True)
    for name in ("station", "trip", "rejected_row", "v_departure"):
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() == t[name].count() > 0
    assert t["ingestion_run"].filter("status = 'success'").count() == 1


def test_a_failed_build_leaves_the_published_one(spark, tmp_path):
    from quayline import pipeline
    from tests.conftest import MINI_FEED, write_feed

    (tmp_path / "in").mkdir()
    root = str(tmp_path / "out")
    write_feed(tmp_path / "in" / "feed.zip", MINI_FEED)
    first = pipeline.publish_feed(spark, str(tmp_path / "in"), root, fail_on_error=True)
    calls, lost = first["stop_time"].count(), first["rejected_row"].count()
    broken = {k: v for k, v in MINI_FEED.items() if k != "calendar_dates.txt"}
    broken["routes.txt"] = MINI_FEED["routes.txt"] + "AGX,,,R1,twice,IC,,2,\n"  # breaks a key, after tables were written
    write_feed(tmp_path / "in" / "feed.zip", broken)
    with pytest.raises(ValueError, match="constraint"):
        pipeline.publish_feed(spark, str(tmp_path / "in"), root, fail_on_error=True)
    now = pipeline.read_published(spark, root)
    assert now["stop_time"].count() == calls and now["service_date"].count() == 8 and now["rejected_row"].count() == lost
    less = dict(MINI_FEED, **{"stop_times.txt": "\n".join(MINI_FEED["stop_times.txt"].split("\n")[:-2]) + "\n"})
    write_feed(tmp_path / "in" / "feed.zip", less)
    second = pipeline.publish_feed(spark, str(tmp_path / "in"), root)
    runs = second["rejected_row"].groupBy("run_id").count().collect()
    assert sorted(r["count"] for r in runs) == [lost - 1, lost]  # both runs' rows, side by side
    assert sorted(r.status for r in second["ingestion_run"].collect()) == ["failed", "success", "success"]
    assert pipeline.read_published(spark, root, version=1)["stop_time_screened"].count() == 12
    assert second["stop_time_screened"].count() == 11


def test_junk_dates_flags_and_numbers_are_rejected(spark, tmp_path):
    from quayline.operators import clean as cleaning

    days = "0,0,0,0,0,0,0".split(",")
    names = ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"]
    rows = [("A", *days, "20250101", "20250131", 2), ("B", *days, "20251345", "20250131", 3), ("C", "x", *days[1:], "20250101", "20250131", 4)]
    stg = spark.createDataFrame(rows, [*names, "src_line_no"])
    core, rejected = cleaning.services(stg)
    assert [r.service_id for r in core.collect()] == ["A"]
    assert {(r.src_line_no, r.rule_code) for r in rejected.collect()} == {(3, "DQ-06-BAD-SERVICE-DATE-QL"), (4, "DQ-08-BAD-CODE-QL")}
    calls = spark.createDataFrame(
        [("T", "08:00:00", "08:00:00", "P", "12345678901", None, "0", "0", 2)],
        "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string, "
        "stop_headsign string, pickup_type string, drop_off_type string, src_line_no long")
    screened = cleaning.screen_stop_times(
        calls, spark.createDataFrame([("T",)], "trip_id string"), spark.createDataFrame([("P",)], "stop_id string"))
    assert screened.first()["reject_rule"] == "DQ-08-BAD-STOP-SEQUENCE"
