"""Semantic views V01-V07 as functions DataFrame -> DataFrame.

Two ideas carry through: a timetable row is not a departure (each call is
weighted by the days its service runs), and "no information" is neither yes
nor no (amenity codes go through the code list, not a boolean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions import frequency_class
from quayline.schemas import ref_accessibility, ref_route_type, ref_stop_schedule_relationship
from quayline.session import grown

MONDAY_EPOCH = "1970-01-05"  # week buckets start on Mondays, counted from this date


def departures(t: dict[str, DataFrame]) -> DataFrame:
    """One row per boardable call with a departure time."""
    spark = t["stop_time"].sparkSession
    st = t["stop_time"].filter((F.col("is_boardable") == 1) & F.col("departure_secs").isNotNull())
    # Dimensions meet the fact one at a time, each a plain scan with exact size
    # statistics, so Spark's size check picks the dimension (not the fact) to broadcast.
    # Trips come first: they shuffle the fact once they are many, without the places' columns.
    platform = t["platform"].select("stop_id", "station_id", "platform_code", "has_platform_code")
    station = t["station"].select("station_id", "station_name")
    line = (
        t["trip"].select("trip_id", "route_id", "service_id", "trip_headsign", "trip_short_name",
                         "bikes_allowed", "wheelchair_accessible")
        .join(t["route"].select("route_id", "route_short_name", "route_long_name", "route_type"), "route_id")
        .join(ref_route_type(spark).withColumnRenamed("label", "route_type_label"), "route_type")
    )
    return st.join(line, "trip_id").join(platform, "stop_id").join(station, "station_id").select(
        "trip_id", "stop_sequence", "stop_id", "station_id", "station_name", "platform_code", "has_platform_code",
        "departure_time", "departure_secs", "departure_hour", "day_offset", "pickup_type", "drop_off_type",
        "route_id", "service_id", "trip_headsign", "trip_short_name", "bikes_allowed", "wheelchair_accessible",
        "route_short_name", "route_long_name", "route_type", "route_type_label",
    )


def service_days(t: dict[str, DataFrame]) -> DataFrame:
    """Operating days per service (added dates only)."""
    return (
        t["service_date"].filter(F.col("exception_type") == 1)
        .groupBy("service_id")
        .agg(
            F.count(F.lit(1)).alias("operating_days"),
            F.min("service_date").alias("first_operating_day"),
            F.max("service_date").alias("last_operating_day"),
        )
    )


def trip_service_days(t: dict[str, DataFrame]) -> DataFrame:
    """Per trip count/min/max of added dates; trips without dates vanish.

    Aggregated per *service* first and then joined to trips: the same answer as
    joining every trip to every date, with a join of (trips x 1) rows.
    """
    return t["trip"].select("trip_id", "service_id").join(service_days(t), "service_id").select(
        "trip_id", "operating_days", "first_operating_day", "last_operating_day"
    )


ORIGIN_COLUMNS = [
    "stop_sequence", "stop_id", "station_id", "station_name", "platform_code", "departure_time", "departure_secs",
    "departure_hour", "day_offset", "route_id", "service_id", "trip_headsign", "trip_short_name",
    "route_short_name", "route_long_name", "route_type",
]


def trip_origin(dep: DataFrame) -> DataFrame:
    """The first boardable call of each trip by stop_sequence.

    ``min(struct(stop_sequence, ...))`` is an aggregate, so each task keeps one
    candidate per trip before the shuffle (partial aggregation) instead of
    shuffling every call into a window sort.
    """
    first = dep.groupBy("trip_id").agg(F.min(F.struct(*ORIGIN_COLUMNS)).alias("o"))
    return first.select("trip_id", *[F.col(f"o.{c}").alias(c) for c in ORIGIN_COLUMNS])


def service_frequency(t: dict[str, DataFrame]) -> DataFrame:
    """Totals, weekday spread, Monday-based weeks, modal week shape, class."""
    active = t["service_date"].filter(F.col("exception_type") == 1)
    week = F.floor(F.datediff(F.col("service_date"), F.lit(MONDAY_EPOCH).cast("date")) / 7).cast("long")
    totals = active.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("operating_days"),
        F.count_distinct("day_of_week").alias("distinct_weekdays"),
        F.min("service_date").alias("first_operating_day"),
        F.max("service_date").alias("last_operating_day"),
    )
    per_week = active.groupBy("service_id", week.alias("week_index")).agg(F.count(F.lit(1)).alias("days_in_week"))
    shapes = per_week.groupBy("service_id", "days_in_week").agg(F.count(F.lit(1)).alias("weeks_with_shape"))
    # Mode: most weeks; ties go to the busier shape (larger days_in_week).
    modal = shapes.groupBy("service_id").agg(
        F.max(F.struct("weeks_with_shape", "days_in_week")).getField("days_in_week").alias("typical_days_per_week"),
        F.sum("weeks_with_shape").alias("active_weeks"),
        F.max("days_in_week").alias("max_days_per_week"),
    )
    return totals.join(modal, "service_id").select(
        "service_id", "operating_days", "distinct_weekdays", "typical_days_per_week", "max_days_per_week",
        "active_weeks", "first_operating_day", "last_operating_day",
        frequency_class("typical_days_per_week").alias("frequency_class"),
    )


def trip_amenity(t: dict[str, DataFrame]) -> DataFrame:
    """Amenity labels per trip; unknown (0) is kept apart from refused (2)."""
    spark = t["trip"].sparkSession
    acc = ref_accessibility(spark)
    ab = acc.select(F.col("code").alias("bikes_allowed"), F.col("label").alias("bikes_allowed_label"),
                    F.col("is_guaranteed").alias("guarantees_bikes"))
    aw = acc.select(F.col("code").alias("wheelchair_accessible"), F.col("label").alias("wheelchair_label"),
                    F.col("is_guaranteed").alias("guarantees_wheelchair"))
    df = (
        t["trip"].select("trip_id", "route_id", "service_id", "trip_headsign", "bikes_allowed",
                         "wheelchair_accessible")
        .join(t["route"].select("route_id", "route_short_name", "route_long_name", "route_type"), "route_id")
        .join(ab, "bikes_allowed")
        .join(aw, "wheelchair_accessible")
    )
    gb, gw = F.col("guarantees_bikes") == 1, F.col("guarantees_wheelchair") == 1
    return df.select(
        "trip_id", "route_id", "service_id", "trip_headsign", "route_short_name", "route_long_name", "route_type",
        "bikes_allowed", "bikes_allowed_label", "guarantees_bikes",
        F.when(F.col("bikes_allowed") == 0, 1).otherwise(0).alias("bikes_is_unknown"),
        "wheelchair_accessible", "wheelchair_label", "guarantees_wheelchair",
        F.when(F.col("wheelchair_accessible") == 0, 1).otherwise(0).alias("wheelchair_is_unknown"),
        F.when(gb | gw, 1).otherwise(0).alias("guarantees_any_amenity"),
        F.when(gb & gw, 1).otherwise(0).alias("guarantees_both_amenities"),
    )


def station_daily_departures(t: dict[str, DataFrame], dep: DataFrame, tsd: DataFrame) -> DataFrame:
    """Per station, idle ones included.

    Departures are aggregated per station *before* meeting the station list, so
    the left joins touch one row per station instead of one per call.
    """
    platforms = t["platform"].groupBy("station_id").agg(
        F.count_distinct(F.when(F.col("has_platform_code") == 1, F.col("stop_id"))).alias("numbered_platforms")
    )
    calls = (
        dep.select("station_id", "trip_id", "route_id", "trip_headsign")
        .join(tsd.select("trip_id", "operating_days"), "trip_id", "left")
        .groupBy("station_id")
        .agg(
            F.count("trip_id").alias("timetabled_departures"),
            F.count_distinct("route_id").alias("routes_served"),
            F.count_distinct("trip_headsign").alias("distinct_destinations"),
            F.sum("operating_days").alias("annual_departures"),
        )
    )
    return (
        t["station"].select("station_id", "station_name", "latitude", "longitude")
        .join(platforms, "station_id", "left")
        .join(calls, "station_id", "left")
        .select(
            "station_id", "station_name", "latitude", "longitude",
            F.coalesce("numbered_platforms", F.lit(0)).cast("long").alias("numbered_platforms"),
            F.coalesce("timetabled_departures", F.lit(0)).cast("long").alias("timetabled_departures"),
            F.coalesce("routes_served", F.lit(0)).cast("long").alias("routes_served"),
            F.coalesce("distinct_destinations", F.lit(0)).cast("long").alias("distinct_destinations"),
            F.coalesce("annual_departures", F.lit(0)).cast("long").alias("annual_departures"),
        )
    )


def rt_departure_performance(t: dict[str, DataFrame], rt: dict[str, DataFrame]) -> DataFrame:
    """Latest observation per (trip, start date, sequence) joined to the timetable.

    "Latest" is ordered by the snapshot's feed timestamp, then fetch time, then
    entity id: the reference's insertion order made explicit and replay-proof.
    Trips unknown to the timetable drop out (inner join); places are optional.
    """
    return performance_of(t, newest_of(observations(rt)))


OBSERVED_CALL = ["trip_id", "start_date", "stop_sequence"]
OBSERVATION_ORDER = ["feed_timestamp_epoch", "fetched_at_utc", "rt_entity_id"]
OBSERVATION_PAYLOAD = ["stop_id", "departure_delay_s", "arrival_delay_s", "schedule_relationship"]


def observations(rt: dict[str, DataFrame]) -> DataFrame:
    """Every observation of a call in the log: the call, what orders its observations, and what was observed."""
    joined = (
        rt["rt_stop_time_update"].select("snapshot_id", "rt_entity_id", "stop_sequence", *OBSERVATION_PAYLOAD)
        .join(grown(rt["rt_trip_update"].select("snapshot_id", "rt_entity_id", "trip_id", "start_date")),
              ["snapshot_id", "rt_entity_id"])
        .join(rt["rt_snapshot"].select("snapshot_id", "feed_timestamp_epoch", "fetched_at_utc"), "snapshot_id")
    )
    return joined.filter(F.col("trip_id").isNotNull()).select(*OBSERVED_CALL, *OBSERVATION_ORDER, *OBSERVATION_PAYLOAD)


def newest_of(observed: DataFrame) -> DataFrame:
    """The newest observation of each call: the maximum of (feed time, fetch, entity, payload) as an
    aggregate, so repeated observations of a hot call collapse map-side."""
    fields = [*OBSERVATION_ORDER, *OBSERVATION_PAYLOAD]
    newest = observed.groupBy(*OBSERVED_CALL).agg(F.max(F.struct(*fields)).alias("_l"))
    return newest.select(*OBSERVED_CALL, *[F.col(f"_l.{c}").alias(c) for c in fields])


def performance_of(t: dict[str, DataFrame], newest: DataFrame) -> DataFrame:
    """Newest observations joined to the timetable."""
    spark = t["trip"].sparkSession
    o = newest.drop("feed_timestamp_epoch", "rt_entity_id")
    ssr = ref_stop_schedule_relationship(spark).select(
        F.col("code").alias("schedule_relationship"), F.col("label").alias("stop_status"), "is_cancellation"
    )
    sched = t["stop_time"].select(
        "trip_id", "stop_sequence", F.col("departure_time").alias("scheduled_departure_time"),
        F.col("departure_hour").alias("scheduled_departure_hour"),
    )
    places = t["platform"].select("stop_id", "station_id", "platform_code").join(
        t["station"].select("station_id", "station_name"), "station_id", "left"
    )
    df = (
        o.join(grown(t["trip"].select("trip_id", "route_id", "trip_headsign")), "trip_id")
        .join(t["route"].select("route_id", "route_short_name"), "route_id")
        .join(places, "stop_id", "left")
        .join(grown(sched), ["trip_id", "stop_sequence"], "left")
        .join(ssr, "schedule_relationship", "left")
    )
    skipped = F.coalesce(F.col("is_cancellation"), F.lit(0)).cast("int")
    delay = F.col("departure_delay_s")
    return df.select(
        "trip_id", "start_date", "stop_sequence", "stop_id", "station_id", "station_name", "platform_code",
        "route_id", "route_short_name", "trip_headsign", "scheduled_departure_time", "scheduled_departure_hour",
        "departure_delay_s", "arrival_delay_s", "schedule_relationship", "fetched_at_utc", "stop_status",
        skipped.alias("is_skipped"),
        F.when(F.col("schedule_relationship") == 2, 1).otherwise(0).alias("has_no_data"),
        F.when(skipped == 1, F.lit(None)).when(delay.isNull(), F.lit(None)).when(delay < 120, 1).otherwise(0)
        .cast("int").alias("is_on_time"),
    )
