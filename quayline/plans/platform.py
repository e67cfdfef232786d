"""Platform pressure at one station and across the hubs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import half_up, hour_band, pct, ratio
from quayline.plans.common import FOCUS_STATION, HUBS, beside, everything, long, rank_desc, weighted


def _station_numbered(t, station):
    dep = t["v_departure"]
    return dep.filter((F.col("station_name") == station) & (F.col("has_platform_code") == 1))


def a06_platform_ranking(t, station: str = FOCUS_STATION):
    load = (
        weighted(_station_numbered(t, station), t)
        .groupBy("platform_code")
        .agg(
            F.count(F.lit(1)).alias("timetabled_calls"),
            F.sum("operating_days").alias("annual_departures"),
            F.count_distinct("route_id").alias("routes_served"),
            F.count_distinct("trip_headsign").alias("distinct_destinations"),
            F.min("departure_time").alias("first_departure"),
            F.max("departure_time").alias("last_departure"),
        )
    )
    return load.select(
        rank_desc("annual_departures").alias("rank_annualised"),
        rank_desc("timetabled_calls").alias("rank_timetabled"),
        F.concat(F.lit("Platform "), F.col("platform_code")).alias("platform"),
        long("annual_departures").alias("annual_departures"),
        pct("annual_departures", F.sum("annual_departures").over(everything()), 1).alias("pct_of_station"),
        long("timetabled_calls").alias("timetabled_calls"),
        long("routes_served").alias("routes_served"),
        long("distinct_destinations").alias("distinct_destinations"),
        "first_departure",
        "last_departure",
    ).orderBy(F.col("annual_departures").desc(), "platform")


def a07_platform_top3(t, station: str = FOCUS_STATION):
    load = weighted(_station_numbered(t, station), t).groupBy("platform_code").agg(
        F.sum("operating_days").alias("annual_departures")
    )
    pos = F.row_number().over(Window.orderBy(F.col("annual_departures").desc(), F.col("platform_code")))
    return (
        load.select(
            pos.cast("long").alias("position"),
            F.concat(F.lit("Platform "), F.col("platform_code")).alias("busiest_platform"),
            long("annual_departures").alias("annual_departures"),
        )
        .filter(F.col("position") <= 3)
        .orderBy("position")
    )


def a08_unallocated_platform_calls(t, station: str = FOCUS_STATION):
    dep = t["v_departure"].filter(F.col("station_name") == station)
    agg = dep.groupBy("station_name").agg(
        F.sum(F.when(F.col("has_platform_code") == 0, 1).otherwise(0)).alias("without"),
        F.count(F.lit(1)).alias("all_calls"),
    )
    return agg.filter(F.col("without") > 0).select(
        "station_name",
        long("without").alias("calls_without_platform"),
        long("all_calls").alias("all_station_calls"),
        pct("without", "all_calls", 2).alias("pct_unallocated"),
    )


def a09_platform_hourly_congestion(t, station: str = FOCUS_STATION):
    hourly = _station_numbered(t, station).groupBy("platform_code", "departure_hour").agg(
        F.count(F.lit(1)).alias("calls")
    )
    per_platform = Window.partitionBy("platform_code")
    return hourly.select(
        F.concat(F.lit("Platform "), F.col("platform_code")).alias("platform"),
        hour_band("departure_hour").alias("hour_band"),
        long("calls").alias("calls"),
        pct("calls", F.sum("calls").over(per_platform), 1).alias("pct_of_platform_day"),
        F.rank().over(per_platform.orderBy(F.col("calls").desc())).cast("long").alias("busiest_hour_rank"),
    ).orderBy("platform", "hour_band")


def feed_dates(t):
    return (
        t["service_date"].filter(F.col("exception_type") == 1)
        .agg(F.count_distinct("service_date").alias("dates_in_feed"))
    )


def a10_platform_peak_pressure(t, station: str = FOCUS_STATION):
    hourly = weighted(_station_numbered(t, station), t).groupBy("platform_code", "departure_hour").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("operating_days").alias("annual")
    )
    per_platform = Window.partitionBy("platform_code")
    ranked = hourly.select(
        "*",
        F.sum("annual").over(per_platform).alias("platform_total"),
        F.row_number().over(per_platform.orderBy(F.col("annual").desc(), F.col("departure_hour"))).alias("rk"),
    ).filter(F.col("rk") == 1)
    per_day = F.col("annual").cast("double") / F.nullif(F.col("dates_in_feed"), F.lit(0)).cast("double")
    return (
        beside(ranked, feed_dates(t))
        .select(
            F.concat(F.lit("Platform "), F.col("platform_code")).alias("platform"),
            hour_band("departure_hour").alias("busiest_hour"),
            long("annual").alias("annual_departures_in_busiest_hour"),
            pct("annual", "platform_total", 1).alias("pct_of_platform_day"),
            long("calls").alias("timetabled_calls_in_busiest_hour"),
            half_up(per_day, 1).alias("trains_per_day_in_peak_hour"),
            half_up(F.lit(60.0) / F.nullif(per_day, F.lit(0.0)), 1).alias("avg_minutes_between_trains_in_peak"),
        )
        .orderBy(F.col("annual_departures_in_busiest_hour").desc(), "platform")
    )


def a11_hub_comparison(t, hubs=HUBS):
    dep = t["v_departure"].filter((F.col("has_platform_code") == 1) & F.col("station_name").isin(*hubs))
    agg = weighted(dep, t).groupBy("station_name").agg(
        F.count_distinct("platform_code").alias("numbered_platforms"),
        F.count(F.lit(1)).alias("timetabled_calls"),
        F.sum("operating_days").alias("annual_departures"),
    )
    per_platform = F.col("timetabled_calls").cast("double") / F.col("numbered_platforms").cast("double")
    return agg.select(
        "station_name",
        long("numbered_platforms").alias("numbered_platforms"),
        long("timetabled_calls").alias("timetabled_calls"),
        long("annual_departures").alias("annual_departures"),
        ratio("timetabled_calls", "numbered_platforms", 0).alias("calls_per_platform"),
        F.rank().over(Window.orderBy(per_platform.desc())).cast("long").alias("pressure_rank"),
    ).orderBy(F.col("calls_per_platform").desc(), "station_name")

