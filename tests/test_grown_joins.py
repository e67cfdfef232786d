"""Sides that grow with the input are never broadcast, however small their files are."""

import re

from pyspark.sql import functions as F

from quayline.operators import checks, clean, views

CODES = "bikes_allowed int, wheelchair_accessible int"


def joins(df, key, kind=r"\w+"):
    """How the planner, before anything ran, makes the joins (of a kind) whose left side is matched by a column."""
    return re.findall(rf"(\w+Join) \[{key}#[^\]]*\], \[[^\]]*\], {kind}\b", df._jdf.queryExecution().sparkPlan().toString())


def written(df, path):
    df.write.option("compression", "zstd").parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def trip_table(spark, path, n=300):
    rows = spark.range(n).select(
        F.concat(F.lit("T"), "id").alias("trip_id"), F.lit("R1").alias("route_id"), F.lit("U1").alias("service_id"),
        F.lit("Alpha").alias("trip_headsign"), F.lit(1).alias("bikes_allowed"), F.lit(1).alias("wheelchair_accessible"))
    return written(rows, path)


def realtime(spark, path, trips):
    tu = spark.createDataFrame([(2 * i, f"e{i}", trip, "2025-01-06") for i, trip in enumerate(trips)],
                               "snapshot_id long, rt_entity_id string, trip_id string, start_date string")
    stu = spark.createDataFrame([(2 * i, f"e{i}", 1, "P1", 30, 30, 0) for i in range(len(trips))],
                                "snapshot_id long, rt_entity_id string, stop_sequence int, stop_id string, departure_delay_s int, "
                                "arrival_delay_s int, schedule_relationship int")
    snap = spark.createDataFrame([(2 * i, 1800 * i, "2025-01-06T00:00:00Z") for i in range(len(trips))],
                                 "snapshot_id long, feed_timestamp_epoch long, fetched_at_utc string")
    return {"rt_trip_update": written(tu, path / "tu"), "rt_stop_time_update": written(stu, path / "stu"), "rt_snapshot": snap}


def test_observations_and_trips_are_merge_joined(spark, tmp_path):
    rt = realtime(spark, tmp_path, ["T1", "T2", "T9999", None])
    seen = views.observations(rt)
    assert joins(seen, "snapshot_id")[-1] == "SortMergeJoin"  # the innermost: updates with their trips
    assert sorted(r.trip_id for r in seen.collect()) == ["T1", "T2", "T9999"]


def test_look_ups_of_the_build_are_merge_joined(spark, tmp_path, feed_tables):
    trip = trip_table(spark, tmp_path / "trip")
    calls = clean.screen_stop_times(feed_tables["stg_stop_times"], trip, feed_tables["platform"])
    assert joins(calls, "_trip")[-1] == "SortMergeJoin"
    made, _ = clean.trips(feed_tables["stg_trips"], feed_tables["route"], feed_tables["service"])
    assert set(joins(made, "_sid")) == {"SortMergeJoin"}
    linked, _ = clean.transfers(feed_tables["stg_transfers"], feed_tables["platform"], trip)
    assert joins(linked, "_ftrip") == joins(linked, "_ttrip") == ["SortMergeJoin"]


def check_rows(feed_tables, rt, **other):
    t = dict(feed_tables) | rt | other
    return checks.check_values(t)


def test_checks_merge_their_anti_joins_and_count_updates_by_trip(spark, tmp_path, feed_tables):
    trip = trip_table(spark, tmp_path / "trip")
    rt = realtime(spark, tmp_path, ["T1"] * 6 + ["T2", "T9999", None, None])
    values = check_rows(feed_tables, rt, trip=trip, v_trip_amenity=trip.filter("trip_id <> 'T7'"))
    assert joins(values, "trip_id", "LeftAnti") == joins(values, "trip_id", "LeftOuter") == ["SortMergeJoin"]
    assert joins(values, "service_id", "LeftAnti") == ["SortMergeJoin"]
    got = {r.check_id: r.value for r in values.collect()}
    assert got["X14"] == 1 and got["X21"] == 70.0  # seven of ten updates; those without a trip count as not matched
    # a trip that the timetable has twice counts its updates twice, as a join of all updates would
    twice = check_rows(feed_tables, rt, trip=trip.unionByName(trip.filter("trip_id = 'T1'")), v_trip_amenity=trip)
    assert {r.check_id: r.value for r in twice.collect()}["X21"] == 100.0 * 13 / 16
    none = check_rows(feed_tables, {k: v.limit(0) for k, v in rt.items()}, trip=trip, v_trip_amenity=trip)
    assert {r.check_id: r.value for r in none.collect()}["X21"] is None
