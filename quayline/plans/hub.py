"""Hub leaderboard, composite score and realtime punctuality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import half_up, hour_band, pct, ratio
from quayline.plans.common import HUBS, beside, everything, long, weighted
from quayline.schemas import ref_alert_cause, ref_alert_effect

TOP_STATIONS = 25
MIN_SCORED = 10


def a31_hub_structural_leaderboard(t, hubs=HUBS):
    hub = t["v_departure"].filter(F.col("station_name").isin(*hubs))
    per_hour = hub.groupBy("station_name", "departure_hour").agg(F.count(F.lit(1)).alias("calls"))
    peak = per_hour.groupBy("station_name").agg(F.max("calls").alias("peak"), F.sum("calls").alias("total"))
    totals = weighted(hub.filter(F.col("platform_code").isNotNull()), t).groupBy("station_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("operating_days").alias("annual"),
        F.count_distinct("platform_code").alias("platforms"),
        F.count_distinct("route_id").alias("routes"),
        F.count_distinct("trip_headsign").alias("destinations"),
    )
    cpp = F.col("calls").cast("double") / F.col("platforms").cast("double")
    return totals.join(peak, "station_name").select(
        F.rank().over(Window.orderBy(F.col("annual").desc())).cast("long").alias("rank_by_volume"),
        "station_name",
        long("annual").alias("annual_departures"),
        long("calls").alias("timetabled_calls"),
        long("platforms").alias("numbered_platforms"),
        ratio("calls", "platforms", 0).alias("calls_per_platform"),
        long("routes").alias("routes_served"),
        long("destinations").alias("distinct_destinations"),
        pct("peak", "total", 1).alias("peak_concentration_pct"),
        F.rank().over(Window.orderBy(cpp.desc())).cast("long").alias("rank_by_pressure"),
    ).orderBy(F.col("annual_departures").desc(), "station_name")


def a32_hub_hourly_shape(t, hubs=HUBS):
    hh = t["v_departure"].filter(F.col("station_name").isin(*hubs)).groupBy("station_name", "departure_hour").agg(
        F.count(F.lit(1)).alias("calls")
    )
    per_hub = Window.partitionBy("station_name")
    return hh.select(
        "station_name",
        hour_band("departure_hour").alias("hour_band"),
        long("calls").alias("calls"),
        pct("calls", F.sum("calls").over(per_hub), 2).alias("pct_of_hub_day"),
        F.rank().over(per_hub.orderBy(F.col("calls").desc())).cast("long").alias("hour_rank"),
    ).orderBy("station_name", "hour_band")


def _minmax(col, invert: bool):
    """100 * (x - min) / (max - min), or (max - x) for "less is better"."""
    x = F.col(col)
    lo, hi = F.min(x).over(everything()), F.max(x).over(everything())
    num = (hi - x) if invert else (x - lo)
    return (F.lit(100.0) * num) / F.nullif(hi - lo, F.lit(0))


def a33_hub_composite_score(t, hubs=HUBS):
    dep = t["v_departure"].filter(F.col("station_name").isin(*hubs) & (F.col("has_platform_code") == 1))
    base = dep.groupBy("station_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("platform_code").alias("platforms"),
        F.count_distinct("trip_headsign").alias("destinations"),
    )
    peaks = (
        dep.groupBy("station_name", "departure_hour").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("station_name")
        .agg((F.max("c").cast("double") * F.lit(1.0) / F.sum("c").cast("double")).alias("peak_share"))
    )
    m = base.join(peaks, "station_name").select(
        "station_name", "destinations",
        (F.col("calls").cast("double") / F.col("platforms").cast("double")).alias("cpp"),
        "peak_share",
    )
    scored = m.select(
        "station_name", "destinations", "cpp", "peak_share",
        _minmax("destinations", False).alias("conn"),
        _minmax("cpp", True).alias("head"),
        _minmax("peak_share", True).alias("smooth"),
    )
    comp = (F.col("conn") + F.col("head") + F.col("smooth")) / F.lit(3.0)
    return scored.select(
        F.rank().over(Window.orderBy(comp.desc_nulls_last())).cast("long").alias("leaderboard_position"),
        "station_name",
        half_up(comp, 1).alias("composite_score"),
        half_up("conn", 1).alias("connectivity_score"),
        half_up("head", 1).alias("headroom_score"),
        half_up("smooth", 1).alias("smoothness_score"),
        long("destinations").alias("destinations"),
        half_up("cpp", 0).alias("calls_per_platform"),
        half_up(F.lit(100.0) * F.col("peak_share"), 1).alias("peak_concentration_pct"),
    ).orderBy(F.col("composite_score").desc_nulls_last(), "station_name")


def a34_realtime_coverage(t):
    snaps = t["rt_snapshot"].agg(
        F.sum(F.when(F.col("feed") == "trip-update", 1).otherwise(0)).alias("trip_update_snapshots"),
        F.sum(F.when(F.col("feed") == "alert", 1).otherwise(0)).alias("alert_snapshots"),
        F.min("fetched_at_utc").alias("first_observation_utc"),
        F.max("fetched_at_utc").alias("last_observation_utc"),
    )
    raw = t["rt_stop_time_update"].agg(F.count(F.lit(1)).alias("raw_stop_time_updates"))
    perf = t["v_rt_departure_performance"].agg(
        F.count(F.lit(1)).alias("distinct_observed_calls"),
        F.count("is_on_time").alias("calls_with_a_delay_reading"),
    )
    tu = t["rt_trip_update"]
    seen = tu.agg(F.count_distinct("trip_id").alias("distinct_trips_seen"), F.count(F.lit(1)).alias("tu_rows"))
    matched = tu.join(t["trip"].select("trip_id"), "trip_id").agg(F.count(F.lit(1)).alias("matched"))
    # five one-row aggregates side by side
    return beside(snaps, raw, perf, seen, matched).select(
        long("trip_update_snapshots").alias("trip_update_snapshots"),
        long("alert_snapshots").alias("alert_snapshots"),
        "first_observation_utc", "last_observation_utc",
        long("raw_stop_time_updates").alias("raw_stop_time_updates"),
        long("distinct_observed_calls").alias("distinct_observed_calls"),
        long("calls_with_a_delay_reading").alias("calls_with_a_delay_reading"),
        long("distinct_trips_seen").alias("distinct_trips_seen"),
        pct("matched", "tu_rows", 1).alias("pct_realtime_trips_matching_static"),
    )


def _punctuality_aggs():
    scored = F.when(F.col("is_on_time").isNotNull(), 1).otherwise(0)
    delay_ok = F.when(F.col("is_skipped") == 0, F.col("departure_delay_s"))
    return [
        F.sum(scored).alias("scored"),
        F.sum(F.coalesce("is_on_time", F.lit(0))).alias("on_time"),
        F.sum("is_skipped").alias("skipped"),
        F.sum("has_no_data").alias("no_data"),
        F.count(F.lit(1)).alias("observed"),
        F.sum(delay_ok).alias("delay_sum"),
        F.count(delay_ok).alias("delay_n"),
        F.max("departure_delay_s").alias("worst"),
    ]


def a35_hub_punctuality(t, hubs=HUBS):
    p = t["v_rt_departure_performance"].filter(F.col("station_name").isin(*hubs))
    agg = p.groupBy("station_name").agg(*_punctuality_aggs()).filter(F.col("scored") > 0)
    share = F.col("on_time").cast("double") / F.nullif(F.col("scored"), F.lit(0)).cast("double")
    return agg.select(
        F.rank().over(Window.orderBy(share.desc())).cast("long").alias("punctuality_rank"),
        "station_name",
        long("scored").alias("scored_departures"),
        long("on_time").alias("on_time_departures"),
        pct("on_time", "scored", 1).alias("on_time_pct"),
        long("skipped").alias("cancelled_calls"),
        long("no_data").alias("calls_without_prediction"),
        long("observed").alias("calls_observed_total"),
        ratio("delay_sum", "delay_n", 0).alias("avg_delay_seconds"),
        F.col("worst").cast("long").alias("worst_delay_seconds"),
    ).orderBy(F.col("on_time_pct").desc(), "station_name")


def a36_punctuality_all_stations(t, min_scored: int = MIN_SCORED, top: int = TOP_STATIONS):
    p = t["v_rt_departure_performance"].filter(F.col("station_name").isNotNull())
    agg = p.groupBy("station_name").agg(*_punctuality_aggs()).filter(F.col("scored") >= min_scored)
    return (
        agg.select(
            "station_name",
            long("scored").alias("observed_departures"),
            pct("on_time", "scored", 1).alias("on_time_pct"),
            ratio("delay_sum", "delay_n", 0).alias("avg_delay_seconds"),
            long("skipped").alias("cancelled_calls"),
            long("no_data").alias("calls_without_prediction"),
        )
        .orderBy("on_time_pct", F.col("observed_departures").desc(), "station_name")
        .limit(top)
    )


DELAY_BANDS = [
    (0, 120, "On time (< 2 min)"),
    (120, 300, "Slight delay (2-5 min)"),
    (300, 900, "Delayed (5-15 min)"),
    (900, 1800, "Badly delayed (15-30 min)"),
]


def delay_band(c):
    d = F.col(c)
    e = F.when(d.isNull(), F.lit("(no reading)")).when(d < 0, F.lit("Early"))
    for _lo, hi, label in DELAY_BANDS:
        e = e.when(d < hi, F.lit(label))
    return e.otherwise(F.lit("Severely delayed (30 min+)"))


def a37_delay_distribution(t):
    p = t["v_rt_departure_performance"].filter(F.col("is_skipped") == 0)
    agg = p.groupBy(delay_band("departure_delay_s").alias("delay_band")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.min(F.coalesce("departure_delay_s", F.lit(-999999))).alias("lowest"),
    )
    return agg.select(
        "delay_band", long("calls").alias("calls"),
        pct("calls", F.sum("calls").over(everything()), 2).alias("pct_of_observations"),
        "lowest",
    ).orderBy("lowest").drop("lowest")


def a38_active_service_alerts(t):
    spark = t["rt_alert"].sparkSession
    latest = (
        t["rt_snapshot"].filter(F.col("feed") == "alert")
        .agg(F.max_by("snapshot_id", F.struct("feed_timestamp_epoch", "snapshot_id")).alias("snapshot_id"))
    )
    fr = t["rt_alert_text"].filter((F.col("field_name") == "header") & (F.col("language") == "fr")).select(
        "snapshot_id", "rt_entity_id", F.col("text").alias("alert_fr")
    )
    a = (
        t["rt_alert"].join(latest, "snapshot_id", "left_semi")
        .join(ref_alert_cause(spark).select(F.col("code").alias("cause"), F.col("label").alias("cause_label")),
              "cause", "left")
        .join(ref_alert_effect(spark).select(F.col("code").alias("effect"), F.col("label").alias("effect_label")),
              "effect", "left")
        .join(fr, ["snapshot_id", "rt_entity_id"], "left")
    )
    return a.select(
        F.col("cause_label").alias("cause"), F.col("effect_label").alias("effect"), "alert_fr"
    ).orderBy("effect", "alert_fr")
