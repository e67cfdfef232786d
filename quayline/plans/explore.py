"""B01-B06 (fact-table lookups) and D01-D13 (station explorer, quality page)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions import hour_band, pct
from quayline.operators import references
from quayline.plans import platform as platform_plans
from quayline.plans.common import FOCUS_STATION, HUBS, MORNING_SECS, beside, long, spark_of, weighted
from quayline.schemas import MEMBER_COLUMNS

EXPLORER_STATION = HUBS[2]
LOOKUP_STOP = "P1"

CORE_TABLES = ["station", "platform", "route", "service", "service_date", "trip", "stop_time"]


def _one_row(t: dict[str, DataFrame], counts: dict[str, tuple[str, F.Column | None]]) -> DataFrame:
    """Several scalar counts side by side: one-row aggregates cross-joined."""
    parts = []
    for alias, (table, cond) in counts.items():
        df = t[table] if cond is None else t[table].filter(cond)
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias(alias)))
    return beside(parts[0], *parts[1:])


# ----------------------------------------------------------------------------- B
def b01_boardable_calls_by_hour(t):
    """Stored hour vs hour recomputed from the clock text; agree below 24:00."""
    st = t["stop_time"].filter((F.col("is_boardable") == 1) & F.col("departure_hour").isNotNull())
    text_hour = F.substring("departure_time", 1, 2).try_cast("int")
    return st.groupBy("departure_hour").agg(
        F.count(F.lit(1)).alias("boardable_calls"),
        F.sum(F.when(text_hour == F.col("departure_hour"), 1).otherwise(0)).alias("same_day_calls_from_text"),
    ).select(
        F.col("departure_hour").cast("int").alias("departure_hour"),
        long("boardable_calls").alias("boardable_calls"),
        long("same_day_calls_from_text").alias("same_day_calls_from_text"),
    ).orderBy("departure_hour")


def b02_boardable_calls_at_stop(t, stop_id: str = LOOKUP_STOP):
    """Equality lookup on the fact (pushed down to the scan) and its prefix twin."""
    st = t["stop_time"].filter(F.col("is_boardable") == 1)
    exact = st.filter(F.col("stop_id") == stop_id).agg(F.count(F.lit(1)).alias("n"))
    prefix = st.filter(F.col("stop_id").startswith(stop_id)).agg(F.count(F.lit(1)).alias("p"))
    return beside(exact, prefix).select(
        F.lit(stop_id).alias("stop_id"), long("n").alias("boardable_calls"),
        long("p").alias("boardable_calls_prefix_match"),
    )


def b03_service_days_by_weekday(t):
    sd = t["service_date"]
    recomputed = (F.dayofweek("service_date") - 1).cast("int")
    return sd.groupBy("day_of_week").agg(
        F.count(F.lit(1)).alias("service_days"),
        F.sum(F.when(recomputed == F.col("day_of_week"), 1).otherwise(0)).alias("recomputed_agrees"),
    ).select(
        F.col("day_of_week").cast("int").alias("day_of_week"), long("service_days").alias("service_days"),
        long("recomputed_agrees").alias("recomputed_agrees"),
    ).orderBy("day_of_week")


def b04_annualised_by_hour_base_tables(t):
    """A01's weights on the bare fact: days per service, then calls x days."""
    days = t["service_date"].filter(F.col("exception_type") == 1).groupBy("service_id").agg(
        F.count(F.lit(1)).alias("days")
    )
    st = t["stop_time"].filter((F.col("is_boardable") == 1) & F.col("departure_secs").isNotNull())
    per_trip_hour = st.groupBy("trip_id", "departure_hour").agg(F.count(F.lit(1)).alias("calls"))
    j = per_trip_hour.join(t["trip"].select("trip_id", "service_id"), "trip_id").join(days, "service_id")
    return j.groupBy("departure_hour").agg(F.sum(F.col("calls") * F.col("days")).alias("annual")).select(
        F.col("departure_hour").cast("int").alias("departure_hour"), long("annual").alias("annual_departures")
    ).orderBy("departure_hour")


def b05_station_platform_calls(t, station: str = FOCUS_STATION):
    """Calls per numbered platform of a named station (semi join on the platform list)."""
    plats = (
        t["platform"].join(t["station"].filter(F.col("station_name") == station), "station_id", "left_semi")
        .filter(F.col("has_platform_code") == 1)
        .select("stop_id", "platform_code")
    )
    calls = t["stop_time"].join(plats.select("stop_id"), "stop_id", "left_semi").groupBy("stop_id").agg(
        F.count(F.lit(1)).alias("calls")
    )
    return plats.join(calls, "stop_id", "left").select(
        "platform_code", F.coalesce(long("calls"), F.lit(0).cast("long")).alias("calls")
    ).orderBy("platform_code")


def b06_table_sizes(t):
    parts = [t[n].agg(F.count(F.lit(1)).cast("long").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n in CORE_TABLES]
    return reduce(DataFrame.unionByName, parts)


def s07_feed_roundtrip(t):
    """S01-S07 on volume: export the staged members as a feed, read it back with the
    feed reader (by header name, record numbers, shape check), compare the
    contents of every member, row for row as a hash, with what was exported, and
    check that the records of every file are numbered without a gap."""
    import uuid

    from quayline import pipeline
    from quayline.sources import gtfs_feed

    spark = spark_of(t)
    members = {m: t[f"stg_{m}"] for m in MEMBER_COLUMNS}
    root = f"{pipeline.checkpoint_root(spark)}/quayline-feed-export/{uuid.uuid4().hex}"
    gtfs_feed.export_feed(members, f"{root}/feed")
    records = gtfs_feed.read_records(spark, f"{root}/feed", f"{root}/lines")
    headers = gtfs_feed.member_listing(gtfs_feed.staged_headers(spark, f"{root}/lines"))
    gtfs_feed.check_members(headers)
    back = gtfs_feed.aligned_records(records, headers)
    out = gtfs_feed.member_digests(members).withColumnsRenamed({"n": "n_out", "h": "h_out"})
    both = out.join(gtfs_feed.content_digests(back), "member", "left")
    same = both.select("member", (F.col("n").eqNullSafe(F.col("n_out")) & F.col("h").eqNullSafe(F.col("h_out"))).alias("same_contents"))
    return gtfs_feed.member_report(back).join(same, "member").join(gtfs_feed.numbers_without_gaps(back), "member").select(
        "member", "staged_rows", "shape_mismatches", "damaged_records", "same_contents", "numbers_without_gaps")


RAGGED_HEADER = ["shape_dist_traveled", "trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence",
                 "stop_headsign", "pickup_type", "drop_off_type"]


def ragged_calls(staged: DataFrame) -> DataFrame:
    """The staged calls as lines of a CSV file, in the order of their staged number, each file with its header.

    Every 7th record has a field too many, every other 11th two too few; every 5th has
    a headsign with quotes, a comma and a line break. The first field is the staged number."""
    k = F.col("src_line_no")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    headsign = F.when(k % 5 == 0, F.concat(F.lit('"to ""'), text("stop_id"), F.lit('"",\nvia"'))).otherwise(F.lit(""))
    body = F.concat_ws(",", k.cast("string"), *[text(c) for c in RAGGED_HEADER[1:6]], headsign)
    codes = F.concat(F.lit(","), text("pickup_type"), F.lit(","), text("drop_off_type"))
    line = F.when(k % 7 == 0, F.concat(body, codes, F.lit(",surplus"))).when(k % 11 == 0, body).otherwise(F.concat(body, codes))
    rows = staged.repartitionByRange("src_line_no").sortWithinPartitions("src_line_no")
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    return rows.select(F.when(first, F.concat(F.lit(",".join(RAGGED_HEADER) + "\n"), line)).otherwise(line).alias("value"))


def s03_s04_ragged_records(t):
    """S03, S04 on volume: ragged records with quoted line breaks, read in many byte ranges of each file."""
    import uuid

    from quayline import pipeline
    from quayline.sources import gtfs_feed

    spark = spark_of(t)
    root = f"{pipeline.checkpoint_root(spark)}/quayline-ragged/{uuid.uuid4().hex}"
    ragged_calls(t["stg_stop_times"]).write.option("lineSep", "\n").text(f"{root}/feed/stop_times.txt")
    records = gtfs_feed.read_records(spark, f"{root}/feed", f"{root}/lines", ranges=4 * spark.sparkContext.defaultParallelism)
    headers = gtfs_feed.member_listing(gtfs_feed.staged_headers(spark, f"{root}/lines"))
    back = gtfs_feed.staged_member(records, headers, "stop_times").withColumns({
        "key": F.col("shape_dist_traveled").cast("long"), "file": F.floor(F.col("src_line_no") / gtfs_feed.FILE_LINES)})
    # a file is a stretch of the staged order: its records' places follow their keys
    place = F.row_number().over(Window.partitionBy("file").orderBy("key")) + 1
    back = back.withColumn("place", place)
    hits = lambda c: F.count(F.when(c, 1)).cast("long")
    spread = F.concat(F.lit('to "'), F.col("stop_id"), F.lit('",\nvia'))
    return back.agg(
        F.count(F.lit(1)).cast("long").alias("records"), hits(F.col("_surplus_fields") > 0).alias("too_many_fields"),
        hits(F.col("_surplus_fields") < 0).alias("too_few_fields"), hits(F.col("_shape_mismatch")).alias("shape_mismatches"),
        hits(F.contains(F.col("stop_headsign"), F.lit("\n"))).alias("records_over_lines"),
        hits(F.col("stop_headsign") == F.when(F.col("key") % 5 == 0, spread).otherwise(F.lit(""))).alias("headsigns_intact"),
        hits(F.col("place") == F.col("src_line_no") % gtfs_feed.FILE_LINES).alias("numbers_in_order"),
        F.sum(F.coalesce(F.col("pickup_type").try_cast("long"), F.lit(0))).cast("long").alias("pickup_codes"))


def s08_s19_shred_roundtrip(t):
    """S08-S19 on volume: one trip-update document per entity of the realtime log
    (derived from events) is written as JSON Lines, read back, registered (S19)
    and shredded (S08-S10, S16-S18); the counts show every quirk was handled."""
    import uuid

    from quayline import pipeline
    from quayline.sources import driver_tables
    from quayline.sources import realtime_json as rj

    spark = spark_of(t)
    path = f"{pipeline.checkpoint_root(spark)}/quayline-rt-export/{uuid.uuid4().hex}"
    rj.export_documents(driver_tables.trip_update_documents(t["rt_trip_update"], t["rt_stop_time_update"]), path)
    snaps = rj.register_snapshots(rj.parse_documents(rj.read_documents(spark, path, lines=True), "trip-update"), None)
    out = rj.shred(snaps, "trip-update")
    tu, stu = out["rt_trip_update"], out["rt_stop_time_update"]
    expected = F.lit(driver_tables.DOC_EPOCH) + F.regexp_extract("rt_entity_id", r"(\d+)$", 1).cast("long")
    parts = [
        out["rt_snapshot"].agg(F.count(F.lit(1)).alias("snapshots")),
        tu.agg(F.count(F.lit(1)).alias("trip_updates"),
               F.sum(F.when(F.col("timestamp_epoch") == expected, 1).otherwise(0)).alias("decoded_timestamps")),
        stu.agg(F.count(F.lit(1)).alias("stop_time_updates"),
                F.sum(F.when(F.col("stop_sequence") < 0, 1).otherwise(0)).alias("synthetic_sequences"),
                F.sum(F.when(F.col("schedule_relationship") == 2, 1).otherwise(0)).alias("no_data_updates")),
    ]
    one = beside(parts[0], *parts[1:])
    return one.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in [
        "snapshots", "trip_updates", "decoded_timestamps", "stop_time_updates", "synthetic_sequences",
        "no_data_updates"]])


# ----------------------------------------------------------------------------- D
def d01_feed_provenance(t):
    first_agency = t["agency"].agg(F.min_by(F.struct("agency_name", "agency_timezone"), "agency_id").alias("a"))
    return beside(t["feed_info"], first_agency).select(
        "feed_publisher_name", "feed_publisher_url", "feed_lang",
        F.col("feed_start_date").cast("string").alias("feed_start_date"),
        F.col("feed_end_date").cast("string").alias("feed_end_date"),
        "feed_version",
        F.datediff("feed_end_date", "feed_start_date").cast("long").alias("feed_window_days"),
        F.col("a.agency_name").alias("agency_name"), F.col("a.agency_timezone").alias("agency_timezone"),
    )


def d02_ingestion_runs(t):
    """Run log, newest first (our own log; no oracle can see it)."""
    return t["ingestion_run"].orderBy(F.col("started_at_utc").desc(), F.col("run_id").desc())


def d03_headline_counts(t):
    counts = _one_row(t, {
        "stations": ("station", None), "platforms": ("platform", None),
        "numbered_platforms": ("platform", F.col("has_platform_code") == 1), "routes": ("route", None),
        "trips": ("trip", None), "services": ("service", None), "service_dates": ("service_date", None),
        "stop_times": ("stop_time", None), "boardable_calls": ("v_departure", None),
    })
    annual = weighted(t["v_departure"], t).agg(F.sum("operating_days").cast("long").alias("annual_departures"))
    return beside(counts, annual)


def d04_method_comparison(t):
    h = weighted(t["v_departure"], t).groupBy("departure_hour").agg(
        F.sum("operating_days").alias("Annualised departures"), F.count(F.lit(1)).alias("Naive timetable rows")
    )
    lf = h.unpivot("departure_hour", ["Annualised departures", "Naive timetable rows"], "method", "departures")
    return lf.select(
        hour_band("departure_hour").alias("hour_band"), F.col("departure_hour").cast("int").alias("departure_hour"),
        "method", long("departures").alias("departures"),
        pct("departures", F.sum("departures").over(Window.partitionBy("method")), 3).alias("pct_of_method_total"),
    ).orderBy("departure_hour", "method")


def d05_morning_trip_span(t):
    span = t["v_departure"].groupBy("trip_id").agg(
        F.min("departure_secs").alias("origin_secs"), F.max("departure_secs").alias("last_secs")
    ).filter(F.col("origin_secs") < MORNING_SECS)
    late = F.when(F.col("last_secs") >= MORNING_SECS, 1).otherwise(0)
    agg = span.agg(F.count(F.lit(1)).alias("n"), F.sum(late).alias("late"), F.max("last_secs").alias("mx"))
    return agg.select(
        long("n").alias("morning_trips"), long("late").alias("still_calling_after_noon"),
        pct("late", "n", 1).alias("pct_still_calling_after_noon"),
        F.format_string("%02d:%02d", (F.col("mx") / 3600).cast("int"), ((F.col("mx") % 3600) / 60).cast("int"))
        .alias("latest_call_by_a_morning_trip"),
    )


def d06_station_picker(t):
    numbered = t["platform"].filter(F.col("has_platform_code") == 1).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    j = t["station"].join(numbered, "station_id", "left").select(
        "station_name", F.coalesce(long("n"), F.lit(0).cast("long")).alias("numbered_platforms")
    )
    return j.select(
        "station_name", "numbered_platforms",
        F.concat(F.col("station_name"), F.lit(" - "), F.col("numbered_platforms").cast("string"),
                 F.lit(" numbered platforms")).alias("picker_label"),
    ).orderBy(F.col("numbered_platforms").desc(), "station_name")


def d07_station_platform_ranking(t, station: str = EXPLORER_STATION):
    return platform_plans.a06_platform_ranking(t, station)


def d08_station_hour_platform(t, station: str = EXPLORER_STATION):
    d = t["v_departure"].filter((F.col("station_name") == station) & (F.col("has_platform_code") == 1))
    h = d.groupBy("platform_code", "departure_hour").agg(F.count(F.lit(1)).alias("calls"))
    numeric_first = F.when(F.col("platform_code").rlike("^[0-9]"), 0).otherwise(1)
    return h.select(
        "platform_code", F.col("departure_hour").cast("int").alias("departure_hour"),
        hour_band("departure_hour").alias("hour_band"), long("calls").alias("calls"),
        pct("calls", F.sum("calls").over(Window.partitionBy("platform_code")), 1).alias("pct_of_platform_day"),
    ).orderBy(numeric_first, F.col("platform_code").try_cast("long"), "platform_code", "departure_hour")


def d09_station_coverage(t, station: str = EXPLORER_STATION):
    d = t["v_departure"].filter(F.col("station_name") == station)
    numbered = F.when(F.col("has_platform_code") == 1, 1).otherwise(0)
    agg = d.agg(
        F.count(F.lit(1)).alias("n"), F.sum(numbered).alias("w"), F.sum(1 - numbered).alias("wo"),
        F.count_distinct("route_id").alias("routes"), F.count_distinct("trip_headsign").alias("dests"),
    )
    return agg.select(
        F.lit(station).alias("station_name"), long("n").alias("all_boardable_calls"),
        long("w").alias("calls_with_platform"), long("wo").alias("calls_without_platform"),
        pct("wo", "n", 2).alias("pct_unallocated"), long("routes").alias("routes_served"),
        long("dests").alias("distinct_destinations"),
    )


# rule, finding, what the build does about it; counts follow in d10_dq_evidence
DQ_FINDINGS = [
    ("DQ-01", "services without a weekly pattern in calendar.txt", "days are counted from calendar_dates"),
    ("DQ-02", "trips whose amenity code is 0 (no information)", "kept; shown as unknown, never as a refusal"),
    ("DQ-03", "calls 48 h or more into their service day", "quarantined"),
    ("DQ-04", "rows referencing a parent that does not exist", "quarantined"),
    ("DQ-05", "duplicate keys", "the first line is loaded, the others are quarantined"),
    ("DQ-06", "feed dates parsed to ISO", "stored as dates; a date that does not parse is empty"),
    ("DQ-07", "translations kept (keyed by value)", "looked up by the translated value, not by record"),
    ("DQ-08", "blank platform codes normalised to NULL", "loaded without a platform number"),
    ("DQ-09", "trips referencing an unknown route or service", "quarantined"),
]


def d10_dq_evidence(t):
    """One aggregate per table gives all its counts; the one-row results stand side by side."""
    count = lambda cond=None: F.count(F.lit(1) if cond is None else F.when(cond, 1)).cast("long")
    rule = lambda code: count(F.col("rule_code").startswith(code))
    no_info = (F.col("bikes_allowed") == 0) | (F.col("wheelchair_accessible") == 0)
    one = beside(
        t["rejected_row"].agg(
            rule("DQ-03").alias("r3"), rule("DQ-04").alias("r4"), rule("DQ-05").alias("r5"), rule("DQ-09").alias("r9"),
            count(F.col("source_table") == "stg_stop_times").alias("lost_calls")),
        t["service"].agg(count(F.col("has_weekday_pattern") == 0).alias("patternless"), count().alias("services")),
        t["trip"].agg(count(no_info).alias("no_info"), count().alias("trips")),
        t["stop_time"].agg(count().alias("calls")),
        t["feed_info"].agg(count(F.col("feed_start_date").isNotNull()).alias("dated"), count().alias("feeds")),
        t["text_translation"].agg(count().alias("names")),
        t["platform"].agg(count(F.col("platform_code").isNull()).alias("codeless"), count().alias("platforms")),
    )
    calls, lost = F.col("calls"), F.col("lost_calls")
    pairs = {
        "DQ-01": ("patternless", F.col("services")), "DQ-02": ("no_info", F.col("trips")), "DQ-03": ("r3", calls + lost),
        "DQ-04": ("r4", calls), "DQ-05": ("r5", calls), "DQ-06": ("dated", F.col("feeds")),
        "DQ-07": ("names", F.col("names")), "DQ-08": ("codeless", F.col("platforms")), "DQ-09": ("r9", F.col("trips")),
    }
    rows = [F.struct(F.lit(code).alias("rule"), F.lit(finding).alias("finding"), F.col(pairs[code][0]).alias("rows_affected"),
                     pairs[code][1].alias("rows_examined"), F.lit(handling).alias("handling"))
            for code, finding, handling in DQ_FINDINGS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# what each characteristic means for the analyses
FEED_EFFECTS = [
    ("Technical pass-throughs (no boarding, no alighting)", "through", "not a departure; left out of every view of departures"),
    ("Calls published at 24:00:00 or later", "after_midnight", "belongs to the service day before; its hour is taken modulo 24"),
    ("Boardable calls with a published departure", "departures", "the calls that count as departures"),
]


def d11_feed_characteristics(t):
    """One pass over the fact; the departure view is the same fact filtered and joined."""
    hit = lambda cond: F.count(F.when(cond, 1)).cast("long")
    one = beside(
        t["stop_time"].agg(
            hit((F.col("is_boardable") == 0) & (F.col("is_alightable") == 0)).alias("through"),
            hit(F.col("day_offset") > 0).alias("after_midnight"), F.count(F.lit(1)).cast("long").alias("total")),
        t["v_departure"].agg(F.count(F.lit(1)).cast("long").alias("departures")))
    rows = [F.struct(F.lit(label).alias("characteristic"), F.col(c).alias("calls"), F.col("total").alias("of_total_calls"),
                     F.lit(effect).alias("effect")) for label, c, effect in FEED_EFFECTS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def d12_rejected_rows(t):
    return t["rejected_row"].groupBy("rule_code", "source_table", "reason").agg(
        F.count(F.lit(1)).cast("long").alias("rows_rejected"),
        F.min("src_line_no").cast("long").alias("first_source_line"),
        F.max("src_line_no").cast("long").alias("last_source_line"),
    ).orderBy(F.col("rows_rejected").desc(), "rule_code", "source_table")


def d13_fk_violations(t):
    """One row per violating child row, for every reference."""
    return references.violations(t)


def d13_reference_report(t):
    """One row per reference, whether it is violated or not."""
    return references.report(t)
