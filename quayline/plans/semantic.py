"""V01-V07 and the quarantine as labelled results (the semantic layer itself)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.operators.views import ORIGIN_COLUMNS
from quayline.plans.common import long


def _dates(df, *cols):
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


def v01_departures(t):
    """All 23 columns of the view."""
    return t["v_departure"].select(
        "trip_id", "stop_sequence", "stop_id", "station_id", "station_name", "platform_code", "has_platform_code",
        "departure_time", "departure_secs", "departure_hour", "day_offset", "pickup_type", "drop_off_type",
        "route_id", "service_id", "trip_headsign", "trip_short_name", "bikes_allowed", "wheelchair_accessible",
        "route_short_name", "route_long_name", "route_type", "route_type_label",
    )


def v02_trip_service_days(t):
    return _dates(t["v_trip_service_days"].select(
        "trip_id", long("operating_days").alias("operating_days"), "first_operating_day", "last_operating_day"
    ), "first_operating_day", "last_operating_day")


def v03_trip_origin(t):
    """All 17 columns of the view."""
    return t["v_trip_origin"].select("trip_id", *ORIGIN_COLUMNS)


def v04_service_frequency(t):
    f = t["v_service_frequency"]
    return _dates(f.select(
        "service_id", long("operating_days").alias("operating_days"),
        long("distinct_weekdays").alias("distinct_weekdays"),
        long("typical_days_per_week").alias("typical_days_per_week"),
        long("max_days_per_week").alias("max_days_per_week"), long("active_weeks").alias("active_weeks"),
        "first_operating_day", "last_operating_day", "frequency_class",
    ), "first_operating_day", "last_operating_day")


def v05_trip_amenity(t):
    """All 17 columns of the view."""
    return t["v_trip_amenity"].select(
        "trip_id", "route_id", "service_id", "trip_headsign", "route_short_name", "route_long_name", "route_type",
        "bikes_allowed", "bikes_allowed_label", long("guarantees_bikes").alias("guarantees_bikes"), "bikes_is_unknown",
        "wheelchair_accessible", "wheelchair_label", long("guarantees_wheelchair").alias("guarantees_wheelchair"),
        "wheelchair_is_unknown", "guarantees_any_amenity", "guarantees_both_amenities",
    )


def v06_station_daily_departures(t):
    return t["v_station_daily_departures"]


PERFORMANCE_COLUMNS = [
    "trip_id", "start_date", "stop_sequence", "stop_id", "station_id", "station_name", "platform_code", "route_id",
    "route_short_name", "trip_headsign", "scheduled_departure_time", "scheduled_departure_hour", "departure_delay_s",
    "arrival_delay_s", "schedule_relationship", "fetched_at_utc", "stop_status", "is_skipped", "has_no_data", "is_on_time",
]


def v07_rt_departure_performance(t):
    """All 20 columns of the view."""
    return t["v_rt_departure_performance"].select(*PERFORMANCE_COLUMNS)


def t21_reject_counts(t):
    """Quarantine volume per member and rule (the cascade and every other rule)."""
    return t["rejected_row"].groupBy("source_table", "rule_code").agg(
        F.count(F.lit(1)).cast("long").alias("rows_rejected")
    )
