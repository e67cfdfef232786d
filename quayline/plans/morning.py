"""Where do morning trains go? Origins, not every call."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import hour_band, pct, ratio
from quayline.plans.common import MORNING_SECS, everything, long, morning_origins, rank_desc, weighted

TOP_DESTINATIONS = 25
TOP_SPLIT = 20
SPLIT_MIN_TRIPS = 5000
TOP_TRANSLATED = 10


def _by_destination(t):
    return morning_origins(t).groupBy("trip_headsign").agg(
        F.count(F.lit(1)).alias("morning_trips"), F.sum("operating_days").alias("annual")
    )


def a12_morning_destinations_ranked(t, top: int = TOP_DESTINATIONS):
    d = _by_destination(t)
    return (
        d.select(
            rank_desc("annual").alias("rank_annualised"),
            rank_desc("morning_trips").alias("rank_raw"),
            F.col("trip_headsign").alias("terminal_destination"),
            long("annual").alias("annual_morning_trips"),
            pct("annual", F.sum("annual").over(everything()), 2).alias("pct_of_morning_network"),
            long("morning_trips").alias("morning_trips"),
            ratio("annual", "morning_trips", 1).alias("avg_days_per_trip"),
        )
        .orderBy(F.col("annual_morning_trips").desc(), "terminal_destination")
        .limit(top)
    )


def a13_top3_destinations(t):
    d = _by_destination(t)
    pos = F.row_number().over(Window.orderBy(F.col("annual").desc(), F.col("trip_headsign")))
    return (
        d.select(
            pos.cast("long").alias("position"),
            F.col("trip_headsign").alias("terminal_destination"),
            long("annual").alias("annual_morning_trips"),
            long("morning_trips").alias("distinct_morning_services"),
        )
        .filter(F.col("position") <= 3)
        .orderBy("position")
    )


def a14_morning_vs_afternoon(t, min_trips: int = SPLIT_MIN_TRIPS, top: int = TOP_SPLIT):
    o = weighted(t["v_trip_origin"], t).filter((F.col("day_offset") == 0) & F.col("trip_headsign").isNotNull())
    morning = F.when(F.col("departure_secs") < MORNING_SECS, 1).otherwise(0)
    agg = o.groupBy("trip_headsign").agg(
        F.sum(F.col("operating_days") * morning).alias("am"),
        F.sum(F.col("operating_days") * (1 - morning)).alias("pm"),
        F.sum("operating_days").alias("all_day"),
    )
    return (
        agg.filter(F.col("all_day") >= min_trips)
        .select(
            F.col("trip_headsign").alias("terminal_destination"),
            long("am").alias("annual_morning_trips"),
            long("pm").alias("annual_afternoon_evening_trips"),
            long("all_day").alias("annual_trips_all_day"),
            pct("am", "all_day", 1).alias("morning_share_pct"),
        )
        .orderBy(F.col("morning_share_pct").desc(), F.col("annual_morning_trips").desc(), "terminal_destination")
        .limit(top)
    )


def a15_morning_departure_profile(t):
    agg = morning_origins(t, headsign_required=False).groupBy("departure_hour").agg(
        F.count(F.lit(1)).alias("services"),
        F.sum("operating_days").alias("annual"),
        F.count_distinct("trip_headsign").alias("destinations"),
    )
    return agg.select(
        hour_band("departure_hour").alias("origin_hour"),
        long("services").alias("distinct_services"),
        long("annual").alias("annual_trips"),
        long("destinations").alias("distinct_destinations"),
        pct("annual", F.sum("annual").over(everything()), 1).alias("pct_of_morning"),
    ).orderBy("origin_hour")


def a16_morning_destinations_multilingual(t, top: int = TOP_TRANSLATED):
    top_dest = (
        _by_destination(t).select("trip_headsign", "annual")
        .orderBy(F.col("annual").desc(), "trip_headsign")
        .limit(top)
    )
    tr = t["text_translation"].filter(F.col("field_name").isin("trip_headsign", "stop_name")).select(
        F.col("field_value").alias("trip_headsign"), "language", "translation"
    )
    joined = top_dest.join(tr, "trip_headsign", "left")

    def lang(code):
        return F.max(F.when(F.col("language") == code, F.col("translation"))).alias(f"destination_{code}")

    return (
        joined.groupBy("trip_headsign", "annual")
        .agg(lang("nl"), lang("de"), lang("en"))
        .select(
            F.col("trip_headsign").alias("destination_fr"), "destination_nl", "destination_de", "destination_en",
            long("annual").alias("annual_morning_trips"),
        )
        .orderBy(F.col("annual_morning_trips").desc(), "destination_fr")
    )
