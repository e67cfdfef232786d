"""The constraint catalogue of the core model as data.

Each constraint is a row-level predicate that must hold (NOT NULL, 0/1 flags,
ranges, enumerations, date order) or a key that must be unique. Row-level
constraints of a table are evaluated in ONE pass (a single ``agg`` of
``sum(when(violated))`` per table); each key is one ``groupBy ... count > 1``.
``fail_on_error`` turns any violation into an exception, as a database would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x):
    return F.col(x)


def _flag(c):
    return _c(c).isin(0, 1)


# table -> [(constraint name, predicate that must be TRUE)]
ROW_RULES: dict[str, list[tuple[str, Column]]] = {}


def _rules() -> dict[str, list[tuple[str, Column]]]:
    nn = lambda c: (f"{c} not null", _c(c).isNotNull())
    return {
        "station": [nn("station_id"), nn("station_name"), nn("wheelchair_boarding"),
                    ("latitude in [-90, 90]", F.coalesce(_c("latitude").between(-90, 90), F.lit(True))),
                    ("longitude in [-180, 180]", F.coalesce(_c("longitude").between(-180, 180), F.lit(True)))],
        "platform": [nn("stop_id"), nn("station_id"), ("has_platform_code is 0/1", _flag("has_platform_code")),
                     ("has_platform_code agrees with platform_code",
                      (_c("has_platform_code") == 1) == _c("platform_code").isNotNull())],
        "route": [nn("route_id"), nn("agency_id"), nn("route_type")],
        "service": [nn("service_id"), nn("start_date"), nn("end_date"),
                    ("end_date >= start_date", _c("end_date") >= _c("start_date")),
                    *[(f"{d} is 0/1", _flag(d)) for d in
                      ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")],
                    ("has_weekday_pattern is 0/1", _flag("has_weekday_pattern"))],
        "service_date": [nn("service_id"), nn("service_date"), ("exception_type in (1, 2)", _c("exception_type").isin(1, 2)),
                         ("day_of_week in 0..6", _c("day_of_week").between(0, 6))],
        "trip": [nn("trip_id"), nn("route_id"), nn("service_id"), nn("bikes_allowed"), nn("wheelchair_accessible"),
                 ("direction_id is 0/1 or NULL", F.coalesce(_flag("direction_id"), F.lit(True)))],
        "stop_time": [nn("trip_id"), nn("stop_sequence"), nn("stop_id"), nn("day_offset"),
                      ("departure_hour in 0..23", F.coalesce(_c("departure_hour").between(0, 23), F.lit(True))),
                      ("arrival_hour in 0..23", F.coalesce(_c("arrival_hour").between(0, 23), F.lit(True))),
                      ("is_boardable is 0/1", _flag("is_boardable")), ("is_alightable is 0/1", _flag("is_alightable")),
                      ("a time is present", _c("departure_secs").isNotNull() | _c("arrival_secs").isNotNull())],
        "transfer": [nn("from_stop_id"), nn("to_stop_id"),
                     ("min_transfer_time >= 0", F.coalesce(_c("min_transfer_time") >= 0, F.lit(True)))],
        "text_translation": [("table_name in (stops, trips)", _c("table_name").isin("stops", "trips")),
                             ("language in (nl, de, en, fr)", _c("language").isin("nl", "de", "en", "fr"))],
        "agency": [nn("agency_id"), nn("agency_name"), nn("agency_timezone")],
        "feed_info": [nn("feed_publisher_name"),
                      ("feed_end_date >= feed_start_date", F.coalesce(_c("feed_end_date") >= _c("feed_start_date"), F.lit(True)))],
        "rt_snapshot": [nn("snapshot_id"), nn("fetched_at_utc"), nn("feed_timestamp_epoch"),
                        ("feed in (trip-update, alert)", _c("feed").isin("trip-update", "alert")), ("entity_count >= 0", _c("entity_count") >= 0)],
        "rt_trip_update": [nn("snapshot_id"), nn("rt_entity_id")],
        "rt_stop_time_update": [nn("snapshot_id"), nn("rt_entity_id"), nn("stop_sequence")],
        "rt_alert": [nn("snapshot_id"), nn("rt_entity_id")],
        "rt_alert_text": [nn("snapshot_id"), nn("rt_entity_id"), nn("language"), nn("text"),
                          ("field_name in (header, description)", _c("field_name").isin("header", "description"))],
        "rt_alert_informed_entity": [nn("snapshot_id"), nn("rt_entity_id"), ("seq >= 0", _c("seq") >= 0)],
        "rt_alert_active_period": [nn("snapshot_id"), nn("rt_entity_id"), ("seq >= 0", _c("seq") >= 0),
                                   ("end_epoch >= start_epoch", F.coalesce(_c("end_epoch") >= _c("start_epoch"), F.lit(True)))],
    }


_ENTITY = ["snapshot_id", "rt_entity_id"]
KEYS = {
    "agency": ["agency_id"], "rt_snapshot": ["snapshot_id"], "rt_trip_update": _ENTITY,
    "rt_stop_time_update": [*_ENTITY, "stop_sequence"], "rt_alert": _ENTITY, "rt_alert_text": [*_ENTITY, "field_name", "language"],
    "rt_alert_informed_entity": [*_ENTITY, "seq"], "rt_alert_active_period": [*_ENTITY, "seq"],
    "station": ["station_id"], "platform": ["stop_id"], "route": ["route_id"], "service": ["service_id"],
    "service_date": ["service_id", "service_date"], "trip": ["trip_id"], "stop_time": ["trip_id", "stop_sequence"],
    "text_translation": ["table_name", "field_name", "field_value", "language"],
}
UNIQUE = {"platform": [["station_id", "platform_code"]], "rt_snapshot": [["feed", "feed_timestamp_epoch"]]}  # NULL codes are exempt, as in SQL UNIQUE


def constraint_report(t: dict[str, DataFrame]) -> DataFrame:
    parts = []
    # a table that was not built (a feed without realtime) has a row that says so, with no count
    absent = [table for table in _rules() if table not in t]
    if absent:
        spark = next(iter(t.values())).sparkSession
        parts.append(spark.createDataFrame([(x, "table is built", None) for x in absent],
                                           "table_name string, constraint_name string, violations long"))
    for table, rules in _rules().items():
        if table in absent:
            continue
        agg = t[table].agg(*[F.sum(F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1)).alias(f"c{i}")
                             for i, (_, p) in enumerate(rules)])
        stacked = agg.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("constraint_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long")
                     .alias("violations")) for i, (name, _) in enumerate(rules)])).alias("x"))
        parts.append(stacked.select(F.lit(table).alias("table_name"), "x.constraint_name", "x.violations"))
    for table, keys in [*[(k, v) for k, v in KEYS.items()], *[(k, u) for k, us in UNIQUE.items() for u in us]]:
        if table in absent:
            continue
        dup = (t[table].filter(reduce(lambda a, b: a & b, [_c(k).isNotNull() for k in keys]))
               .groupBy(*keys).count().filter(F.col("count") > 1))
        parts.append(dup.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(f"unique ({', '.join(keys)})").alias("constraint_name"),
            "violations"))
    return reduce(DataFrame.unionByName, parts)


def enforce(t: dict[str, DataFrame]) -> None:
    """``fail_on_error``: raise if any constraint is violated (collects one small report)."""
    bad = [r for r in constraint_report(t).filter(F.col("violations") > 0).collect()]
    if bad:
        raise ValueError(f"constraint violations: {[(r.table_name, r.constraint_name, r.violations) for r in bad]}")
