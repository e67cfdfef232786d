"""When does the network run? Weighted vs naive hour profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import hour_band, pct, ratio
from quayline.plans.common import everything, long, rank_desc, weighted


def _hourly_weighted(t):
    return (
        weighted(t["v_departure"], t)
        .groupBy("departure_hour")
        .agg(
            F.sum("operating_days").alias("annual_departures"),
            F.count(F.lit(1)).alias("timetabled_calls"),
            F.count_distinct("station_id").alias("stations_active"),
            F.count_distinct("route_id").alias("routes_active"),
        )
    )


def a01_annualised_departures_by_hour(t):
    h = _hourly_weighted(t)
    return h.select(
        hour_band("departure_hour", wide=True).alias("hour_band"),
        F.col("departure_hour").cast("int").alias("departure_hour"),
        long("annual_departures").alias("annual_departures"),
        pct("annual_departures", F.sum("annual_departures").over(everything()), 2).alias("pct_of_network_day"),
        long("timetabled_calls").alias("timetabled_calls"),
        long("stations_active").alias("stations_active"),
        long("routes_active").alias("routes_active"),
        rank_desc("annual_departures").alias("rank_by_volume"),
    ).orderBy(F.col("annual_departures").desc(), "departure_hour")


def a02_naive_timetable_rows_by_hour(t):
    h = t["v_departure"].groupBy("departure_hour").agg(F.count(F.lit(1)).alias("timetabled_calls"))
    return h.select(
        hour_band("departure_hour", wide=True).alias("hour_band"),
        F.col("departure_hour").cast("int").alias("departure_hour"),
        long("timetabled_calls").alias("timetabled_calls"),
        pct("timetabled_calls", F.sum("timetabled_calls").over(everything()), 2).alias("pct_of_rows"),
        rank_desc("timetabled_calls").alias("rank_by_rows"),
    ).orderBy(F.col("timetabled_calls").desc(), "departure_hour")


def a03_rank_divergence(t):
    h = _hourly_weighted(t)
    ra, rn = rank_desc("annual_departures"), rank_desc("timetabled_calls")
    return h.select(
        hour_band("departure_hour").alias("hour_band"),
        ra.alias("rank_annualised"),
        rn.alias("rank_naive"),
        (rn - ra).alias("rank_improvement"),
        long("annual_departures").alias("annual_departures"),
        long("timetabled_calls").alias("timetabled_calls"),
        ratio("annual_departures", "timetabled_calls", 1).alias("avg_days_per_call"),
    ).orderBy("rank_annualised", "hour_band")


def a04_peak_by_daytype(t):
    sd = t["service_date"].filter(F.col("exception_type") == 1)
    per_service = sd.groupBy("service_id").agg(
        F.sum(F.when(F.col("day_of_week").isin(0, 6), 1).otherwise(0)).alias("weekend_days"),
        F.sum(F.when(F.col("day_of_week").between(1, 5), 1).otherwise(0)).alias("weekday_days"),
    )
    hourly = (
        t["v_departure"].join(per_service, "service_id")
        .groupBy("departure_hour")
        .agg(F.sum("weekday_days").alias("Weekday"), F.sum("weekend_days").alias("Weekend"))
    )
    long_form = hourly.unpivot("departure_hour", ["Weekday", "Weekend"], "day_type", "departures")
    by_type = Window.partitionBy("day_type")
    return long_form.select(
        "day_type",
        hour_band("departure_hour").alias("hour_band"),
        long("departures").alias("departures"),
        pct("departures", F.sum("departures").over(by_type), 2).alias("pct_of_day_type"),
        F.rank().over(by_type.orderBy(F.col("departures").desc())).cast("long").alias("rank_in_day_type"),
    ).orderBy("day_type", F.col("departures").desc(), "hour_band")


def a05_peak_hour_headline(t):
    h = (
        weighted(t["v_departure"], t)
        .groupBy("departure_hour")
        .agg(F.sum("operating_days").alias("annual_departures"))
    )
    return (
        h.select(
            hour_band("departure_hour", wide=True).alias("peak_hour"),
            long("annual_departures").alias("annual_departures"),
            pct("annual_departures", F.sum("annual_departures").over(everything()), 2).alias("pct_of_all_departures"),
            "departure_hour",
        )
        .orderBy(F.col("annual_departures").desc(), "departure_hour")
        .limit(1)
        .drop("departure_hour")
    )
