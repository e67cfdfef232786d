"""Code lists and target schemas of the core model.

The code lists below are fixed values of the schedule / realtime standards and
must equal the reference's seed data for results to match. They are small
literal DataFrames, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (GTFS Schedule / GTFS Realtime code lists), natural order.
# ---------------------------------------------------------------------------
LOCATION_TYPES = [
    (0, "Stop/Platform"),
    (1, "Station"),
    (2, "Entrance/Exit"),
    (3, "Generic Node"),
    (4, "Boarding Area"),
]
ROUTE_TYPES = [
    (0, "Tram"),
    (1, "Metro"),
    (2, "Rail"),
    (3, "Bus"),
    (4, "Ferry"),
    (5, "Cable Tram"),
    (6, "Aerial Lift"),
    (7, "Funicular"),
    (11, "Trolleybus"),
    (12, "Monorail"),
]
PICKUP_DROP = [
    (0, "Regularly scheduled"),
    (1, "Not available"),
    (2, "Phone agency"),
    (3, "Coordinate with driver"),
]
# (code, label, is_guaranteed): "no information" is neither yes nor no.
ACCESSIBILITY = [
    (0, "No information", 0),
    (1, "Yes", 1),
    (2, "No", 0),
]
EXCEPTION_TYPES = [(1, "Added"), (2, "Removed")]
TRANSFER_TYPES = [
    (0, "Recommended"),
    (1, "Timed"),
    (2, "Minimum time required"),
    (3, "Not possible"),
]
# Trip-level and stop-level schedule relationships share integers but not
# meaning; never share one lookup between the two levels.
TRIP_SCHEDULE_RELATIONSHIP = [
    (0, "SCHEDULED"),
    (1, "ADDED"),
    (2, "UNSCHEDULED"),
    (3, "CANCELED"),
    (5, "REPLACEMENT"),
    (6, "DUPLICATED"),
    (7, "DELETED"),
]
# (code, label, is_cancellation)
STOP_SCHEDULE_RELATIONSHIP = [
    (0, "SCHEDULED", 0),
    (1, "SKIPPED", 1),
    (2, "NO_DATA", 0),
    (3, "UNSCHEDULED", 0),
]
ALERT_CAUSES = [
    (1, "UNKNOWN_CAUSE"),
    (2, "OTHER_CAUSE"),
    (3, "TECHNICAL_PROBLEM"),
    (4, "STRIKE"),
    (5, "DEMONSTRATION"),
    (6, "ACCIDENT"),
    (7, "HOLIDAY"),
    (8, "WEATHER"),
    (9, "MAINTENANCE"),
    (10, "CONSTRUCTION"),
    (11, "POLICE_ACTIVITY"),
    (12, "MEDICAL_EMERGENCY"),
]
ALERT_EFFECTS = [
    (1, "NO_SERVICE"),
    (2, "REDUCED_SERVICE"),
    (3, "SIGNIFICANT_DELAYS"),
    (4, "DETOUR"),
    (5, "ADDITIONAL_SERVICE"),
    (6, "MODIFIED_SERVICE"),
    (7, "OTHER_EFFECT"),
    (8, "UNKNOWN_EFFECT"),
    (9, "STOP_MOVED"),
    (10, "NO_EFFECT"),
    (11, "ACCESSIBILITY_ISSUE"),
]
TRANSLATION_LANGUAGES = ["nl", "de", "en", "fr"]
TRANSLATION_TABLES = ["stops", "trips"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# day_of_week 0 = Sunday, as strftime('%w').
WEEKDAY_NAMES = [
    (0, "Sunday"),
    (1, "Monday"),
    (2, "Tuesday"),
    (3, "Wednesday"),
    (4, "Thursday"),
    (5, "Friday"),
    (6, "Saturday"),
]

# Reject rule codes and reasons of the stop-time cascade (first match wins).
STOP_TIME_RULES = [
    ("DQ-04-ORPHAN-STOP-TIME-TRIP", "the call's trip was not loaded"),
    ("DQ-04-ORPHAN-STOP-TIME-PLATFORM", "the call's stop is not a loaded platform"),
    ("DQ-08-BAD-STOP-SEQUENCE", "the place in the trip is not a whole number"),
    ("DQ-08-BAD-CODE", "a boarding code is not a number"),
    ("DQ-08-NO-TIME", "the call has no usable time"),
    ("DQ-03-IMPLAUSIBLE-DEPARTURE", "the call lies two days or more after its service day"),
    ("DQ-05-DUPLICATE-CALL", "another line has this place in the trip; the first line counts"),
]


# Why a row of a staged table is in quarantine, by rule.
REJECT_REASONS = {
    "agency": {"DQ-08-BLANK-AGENCY-ID-QL": "agency without an id"},
    "stops": {
        "DQ-04-ORPHAN-PLATFORM": "platform whose parent is not one of the stations read",
        "DQ-08-UNSUPPORTED-LOCATION-TYPE-QL": "neither a station nor a platform",
        "DQ-08-BAD-CODE-QL": "boarding code or coordinate that is no number",
    },
    "routes": {
        "DQ-04-ORPHAN-ROUTE-QL": "route of an agency that was not loaded",
        "DQ-08-BAD-CODE-QL": "the route type is not a number",
    },
    "calendar": {
        "DQ-06-BAD-SERVICE-DATE-QL": "first or last day is missing or no day of the calendar",
        "DQ-08-BAD-CODE-QL": "a weekday flag is not a number",
    },
    "calendar_dates": {
        "DQ-04-ORPHAN-SERVICE-DATE": "date of a service that was not loaded, or not eight characters long",
        "DQ-06-INVALID-DATE-QL": "no day of the calendar, or its type is not a number",
        "DQ-05-DUPLICATE-SERVICE-DATE": "a service has this date more than once; the first line counts",
        "QL-SURPLUS-SERVICE-DATE": "a further line of a date that the service has already",
    },
    "trips": {
        "DQ-09-ORPHAN-TRIP": "trip of a route or service that was not loaded",
        "DQ-08-BAD-CODE-QL": "a direction or amenity code is not a number",
    },
    "stop_times": dict(STOP_TIME_RULES),
    "transfers": {
        "DQ-04-ORPHAN-TRANSFER-QL": "transfer end is not a loaded platform",
        "DQ-08-BAD-CODE-QL": "transfer type or waiting time is not a number",
    },
    "translations": {
        "DQ-07-TRANSLATION-FILTERED-QL": "value or text is blank, or language or table is not one we keep",
        "DQ-05-DUPLICATE-TRANSLATION-QL": "this value has another text in this language; the first line counts",
    },
}


def code_list(spark: SparkSession, rows, names: list[str]) -> DataFrame:
    """A literal code list; always tiny, so it carries a broadcast hint."""
    return F.broadcast(spark.createDataFrame(rows, names))


def ref_route_type(spark):
    return code_list(spark, ROUTE_TYPES, ["route_type", "label"])


def ref_accessibility(spark):
    return code_list(spark, ACCESSIBILITY, ["code", "label", "is_guaranteed"])


def ref_stop_schedule_relationship(spark):
    return code_list(spark, STOP_SCHEDULE_RELATIONSHIP, ["code", "label", "is_cancellation"])


def ref_alert_cause(spark):
    return code_list(spark, ALERT_CAUSES, ["code", "label"])


def ref_alert_effect(spark):
    return code_list(spark, ALERT_EFFECTS, ["code", "label"])


# Staged member columns (all text), as declared by the schedule standard.
MEMBER_COLUMNS = {
    "agency": ["agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone"],
    "feed_info": [
        "feed_id", "feed_publisher_name", "feed_publisher_url", "feed_lang",
        "feed_start_date", "feed_end_date", "feed_version",
    ],
    "stops": [
        "stop_id", "stop_code", "stop_name", "stop_desc", "stop_lat", "stop_lon", "zone_id",
        "stop_url", "location_type", "parent_station", "platform_code", "wheelchair_boarding",
    ],
    "routes": [
        "route_id", "agency_id", "route_short_name", "route_long_name", "route_desc",
        "route_type", "route_url", "route_color", "route_text_color",
    ],
    "calendar": ["service_id", *WEEKDAYS, "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "trips": [
        "route_id", "service_id", "trip_id", "trip_headsign", "trip_short_name",
        "direction_id", "block_id", "shape_id", "wheelchair_accessible", "bikes_allowed",
    ],
    "stop_times": [
        "trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence",
        "stop_headsign", "pickup_type", "drop_off_type", "shape_dist_traveled",
    ],
    "transfers": ["from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time", "from_trip_id", "to_trip_id"],
    "translations": ["table_name", "field_name", "language", "translation", "record_id", "record_sub_id", "field_value"],
}
REQUIRED_MEMBERS = ["agency", "stops", "routes", "trips", "stop_times", "calendar"]
