"""How often does a service run? Modal week shape, three definitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import frequency_class, pct, ratio
from quayline.functions.columns import frequency_class_order
from quayline.plans.common import everything, long
from quayline.schemas import WEEKDAY_NAMES, WEEKDAYS


def a17_calendar_flags(t):
    flags = sum(F.col(d) for d in WEEKDAYS)
    return (
        t["service"].groupBy(flags.alias("weekday_flags_set"))
        .agg(F.count(F.lit(1)).alias("services"), F.sum("has_weekday_pattern").alias("usable"))
        .select(
            F.col("weekday_flags_set").cast("int").alias("weekday_flags_set"),
            long("services").alias("services"),
            long("usable").alias("services_with_usable_pattern"),
        )
        .orderBy("weekday_flags_set")
    )


def a18_frequency_classification(t):
    f = t["v_service_frequency"]
    agg = f.groupBy("frequency_class").agg(
        F.count(F.lit(1)).alias("services"),
        F.sum("operating_days").alias("days"),
        F.min("typical_days_per_week").alias("min_days_per_week"),
        F.max("typical_days_per_week").alias("max_days_per_week"),
    )
    return agg.select(
        "frequency_class",
        long("services").alias("services"),
        pct("services", F.sum("services").over(everything()), 2).alias("pct_of_services"),
        long("days").alias("total_operating_days"),
        pct("days", F.sum("days").over(everything()), 2).alias("pct_of_operating_days"),
        long("min_days_per_week").alias("min_days_per_week"),
        long("max_days_per_week").alias("max_days_per_week"),
        ratio("days", "services", 1).alias("avg_operating_days"),
    ).orderBy(frequency_class_order("frequency_class"))


def a19_days_per_week_distribution(t):
    f = t["v_service_frequency"]
    agg = f.groupBy("typical_days_per_week").agg(
        F.count(F.lit(1)).alias("services"),
        F.sum("operating_days").alias("days"),
        F.sum("active_weeks").alias("weeks"),
    )
    return agg.select(
        long("typical_days_per_week").alias("typical_days_per_week"),
        frequency_class("typical_days_per_week").alias("frequency_class"),
        long("services").alias("services"),
        pct("services", F.sum("services").over(everything()), 2).alias("pct_of_services"),
        ratio("days", "services", 1).alias("avg_operating_days"),
        ratio("weeks", "services", 1).alias("avg_active_weeks"),
    ).orderBy("typical_days_per_week")


def a20_active_service_only(t):
    used = t["v_service_frequency"].join(t["trip"].select("service_id"), "service_id", "left_semi")
    agg = used.groupBy("frequency_class").agg(F.count(F.lit(1)).alias("services"))
    return agg.select(
        "frequency_class",
        long("services").alias("services"),
        pct("services", F.sum("services").over(everything()), 2).alias("pct_of_services"),
    ).orderBy(frequency_class_order("frequency_class"))


def a21_trip_weighted(t):
    # Trips per service first: the join then meets one row per service, not per trip.
    per_service = t["trip"].groupBy("service_id").agg(F.count(F.lit(1)).alias("trips"))
    j = t["v_service_frequency"].join(per_service, "service_id")
    agg = j.groupBy("frequency_class").agg(
        F.count(F.lit(1)).alias("services"),
        F.sum("trips").alias("trips"),
        F.sum(F.col("operating_days") * F.col("trips")).alias("trip_days"),
    )
    return agg.select(
        "frequency_class",
        long("services").alias("services"),
        long("trips").alias("trips"),
        pct("trips", F.sum("trips").over(everything()), 2).alias("pct_of_trips"),
        long("trip_days").alias("trip_operating_days"),
        pct("trip_days", F.sum("trip_days").over(everything()), 2).alias("pct_of_annual_service"),
    ).orderBy(F.col("pct_of_annual_service").desc(), "frequency_class")


def a22_weekday_coverage(t):
    names = F.create_map(*[x for code, name in WEEKDAY_NAMES for x in (F.lit(code), F.lit(name))])
    agg = (
        t["service_date"].filter(F.col("exception_type") == 1)
        .groupBy("day_of_week")
        .agg(F.count(F.lit(1)).alias("days"), F.count_distinct("service_id").alias("services"))
    )
    return agg.select(
        names[F.col("day_of_week")].alias("weekday"),
        F.col("day_of_week").cast("int").alias("day_of_week"),
        long("days").alias("service_days"),
        long("services").alias("distinct_services"),
        pct("days", F.sum("days").over(everything()), 2).alias("pct_of_all_service_days"),
    ).orderBy(F.when(F.col("day_of_week") == 0, 7).otherwise(F.col("day_of_week")))


DEFINITIONS = [
    ("A. modal days per active week (used)", "typical_days_per_week"),
    ("B. distinct weekdays ever touched", "distinct_weekdays"),
    ("C. busiest single week", "max_days_per_week"),
]


def a23_definition_sensitivity(t):
    f = t["v_service_frequency"]
    each = f.select(
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("definition"), frequency_class(col).alias("frequency_class"))
            for name, col in DEFINITIONS
        ])).alias("d")
    ).select("d.definition", "d.frequency_class")
    agg = each.groupBy("definition", "frequency_class").agg(F.count(F.lit(1)).alias("services"))
    return agg.select(
        "definition", "frequency_class", long("services").alias("services"),
        pct("services", F.sum("services").over(Window.partitionBy("definition")), 2).alias("pct_of_services"),
    ).orderBy("definition", frequency_class_order("frequency_class"))
