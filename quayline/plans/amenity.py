"""What does the feed really promise about bikes and wheelchairs?"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import pct
from quayline.plans.common import beside, long, weighted
from quayline.schemas import ref_accessibility, ref_route_type

WORST_ROUTES = 30
MIN_ROUTE_TRIPS = 25
EXPOSURE_ROUTES = 15
MIN_CATEGORY_TRIPS = 100


def _ratio_text(num, den):
    return F.format_string("%d / %d", num, den)


def a24_network_amenity_coverage(t):
    a = t["v_trip_amenity"]
    one = a.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("guarantees_bikes").alias("gb"),
        F.sum(F.when(F.col("bikes_allowed") == 2, 1).otherwise(0)).alias("rb"),
        F.sum("bikes_is_unknown").alias("ub"),
        F.sum("guarantees_wheelchair").alias("gw"),
        F.sum(F.when(F.col("wheelchair_accessible") == 2, 1).otherwise(0)).alias("rw"),
        F.sum("wheelchair_is_unknown").alias("uw"),
        F.sum("guarantees_any_amenity").alias("ga"),
        F.sum(F.when(F.col("guarantees_any_amenity") == 0, 1).otherwise(0)).alias("ua"),
    )
    rows = F.explode(F.array(
        F.struct(F.lit("Bicycle storage (bikes_allowed)").alias("amenity"), F.col("gb").alias("g"),
                 F.col("rb").alias("r"), F.col("ub").alias("u")),
        F.struct(F.lit("Wheelchair accessibility (wheelchair_accessible)").alias("amenity"), F.col("gw").alias("g"),
                 F.col("rw").alias("r"), F.col("uw").alias("u")),
        F.struct(F.lit("Either amenity guaranteed").alias("amenity"), F.col("ga").alias("g"),
                 F.lit(None).cast("long").alias("r"), F.col("ua").alias("u")),
    ))
    return one.select("n", rows.alias("x")).select(
        F.col("x.amenity").alias("amenity"),
        long("n").alias("scheduled_trips"),
        long("x.g").alias("trips_explicitly_guaranteed"),
        long("x.r").alias("trips_explicitly_refused"),
        long("x.u").alias("trips_no_information"),
        _ratio_text(F.col("x.g"), F.col("n")).alias("ratio"),
        pct("x.g", "n", 2).alias("pct_guaranteed"),
    )


def _with_mode(t):
    spark = t["trip"].sparkSession
    return t["v_trip_amenity"].join(ref_route_type(spark).withColumnRenamed("label", "mode"), "route_type")


def a25_amenity_by_mode(t):
    agg = _with_mode(t).groupBy("route_type", "mode").agg(
        F.count_distinct("route_id").alias("routes"),
        F.count(F.lit(1)).alias("n"),
        F.sum("guarantees_bikes").alias("gb"),
        F.sum("guarantees_wheelchair").alias("gw"),
    )
    return agg.select(
        F.col("route_type").cast("int").alias("route_type"), "mode", long("routes").alias("routes"),
        long("n").alias("scheduled_trips"), long("gb").alias("trips_with_bikes_guaranteed"),
        _ratio_text(F.col("gb"), F.col("n")).alias("bikes_ratio"), pct("gb", "n", 2).alias("pct_bikes"),
        long("gw").alias("trips_with_wheelchair_guaranteed"), pct("gw", "n", 2).alias("pct_wheelchair"),
    ).orderBy(F.col("scheduled_trips").desc(), "route_type")


def a26_route_amenity_ratios(t, min_trips: int = MIN_ROUTE_TRIPS, top: int = WORST_ROUTES):
    agg = _with_mode(t).groupBy("route_id", "route_short_name", "route_long_name", "mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("guarantees_bikes").alias("gb"),
        F.sum("guarantees_wheelchair").alias("gw"),
        F.sum("guarantees_any_amenity").alias("ga"),
    ).filter(F.col("n") >= min_trips)
    share = F.col("ga").cast("double") / F.col("n").cast("double")
    return (
        agg.select(
            "route_id", "route_short_name", "route_long_name", "mode",
            long("n").alias("scheduled_trips"), long("gb").alias("bikes_guaranteed"),
            _ratio_text(F.col("gb"), F.col("n")).alias("bikes_ratio"), pct("gb", "n", 2).alias("pct_bikes"),
            long("gw").alias("wheelchair_guaranteed"), pct("gw", "n", 2).alias("pct_wheelchair"),
            pct("ga", "n", 2).alias("pct_any_amenity"),
            F.rank().over(Window.orderBy(share.asc(), F.col("n").desc())).cast("long").alias("worst_rank"),
        )
        .orderBy("pct_any_amenity", F.col("scheduled_trips").desc(), "route_id")
        .limit(top)
    )


def _route_scores(t):
    return t["v_trip_amenity"].groupBy("route_id", "route_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("guarantees_any_amenity").alias("ga")
    )


def a27_worst_routes_all_sizes(t):
    zero = _route_scores(t).filter(F.col("ga") == 0)
    return zero.agg(
        F.count(F.lit(1)).alias("routes_scoring_zero"),
        F.sum("n").alias("trips_affected"),
        F.sum(F.when(F.col("route_type") == 3, 1).otherwise(0)).alias("of_which_replacement_bus"),
        F.sum(F.when(F.col("route_type") == 2, 1).otherwise(0)).alias("of_which_rail"),
        F.min("n").alias("smallest_route_trips"),
        F.max("n").alias("largest_route_trips"),
    ).select(*[long(c).alias(c) for c in [
        "routes_scoring_zero", "trips_affected", "of_which_replacement_bus", "of_which_rail",
        "smallest_route_trips", "largest_route_trips"]])


def a28_worst_routes_by_exposure(t, top: int = EXPOSURE_ROUTES):
    # Days arrive per service (a trip runs on its service's days): a small build side.
    j = weighted(t["v_trip_amenity"], t)
    agg = j.groupBy("route_id", "route_short_name", "route_long_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("operating_days").alias("annual"),
        F.sum("guarantees_any_amenity").alias("ga"),
    ).filter(F.col("ga") == 0)
    return (
        agg.select(
            F.rank().over(Window.orderBy(F.col("annual").desc())).cast("long").alias("priority"),
            "route_short_name", "route_long_name", long("n").alias("scheduled_trips"),
            long("annual").alias("annual_trips"), _ratio_text(F.col("ga"), F.col("n")).alias("amenity_ratio"),
            pct("ga", "n", 2).alias("pct_any_amenity"), "route_id",
        )
        .orderBy(F.col("annual_trips").desc(), "route_id")
        .limit(top)
        .drop("route_id")
    )


def a29_amenity_by_route_category(t, min_trips: int = MIN_CATEGORY_TRIPS):
    agg = _with_mode(t).groupBy("route_short_name", "mode").agg(
        F.count_distinct("route_id").alias("routes"), F.count(F.lit(1)).alias("n"),
        F.sum("guarantees_bikes").alias("gb"), F.sum("guarantees_wheelchair").alias("gw"),
    ).filter(F.col("n") >= min_trips)
    return agg.select(
        F.coalesce(F.col("route_short_name"), F.lit("(unnamed)")).alias("route_category"), "mode",
        long("routes").alias("routes"), long("n").alias("scheduled_trips"),
        _ratio_text(F.col("gb"), F.col("n")).alias("bikes_ratio"), pct("gb", "n", 2).alias("pct_bikes"),
        pct("gw", "n", 2).alias("pct_wheelchair"),
    ).orderBy("pct_bikes", F.col("scheduled_trips").desc(), "route_category")


def a30_station_accessibility_gap(t):
    spark = t["station"].sparkSession
    acc = ref_accessibility(spark).select(F.col("code").alias("wheelchair_boarding"), "label")
    agg = t["station"].join(acc, "wheelchair_boarding").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = t["station"].agg(F.count(F.lit(1)).alias("total"))
    return beside(agg, total).select(
        F.col("label").alias("wheelchair_boarding"), long("n").alias("stations"),
        pct("n", "total", 2).alias("pct_of_stations"),
    ).orderBy(F.col("stations").desc(), "wheelchair_boarding")

