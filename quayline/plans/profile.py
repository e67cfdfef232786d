"""Profiling and audit queries from the docs and CLI."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions import frequency_class, ratio
from quayline.plans.common import FOCUS_STATION, beside, long
from quayline.plans.explore import LOOKUP_STOP
from quayline.schemas import MEMBER_COLUMNS, TRANSLATION_LANGUAGES, WEEKDAYS

# member -> core tables its rows load into
MEMBER_TARGETS = {
    "agency": ["agency"], "stops": ["station", "platform"], "routes": ["route"], "calendar": ["service"],
    "calendar_dates": ["service_date"], "trips": ["trip"], "stop_times": ["stop_time"],
    "transfers": ["transfer"], "translations": ["text_translation"], "feed_info": ["feed_info"],
}


def _n(df, alias="n"):
    return df.agg(F.count(F.lit(1)).cast("long").alias(alias))


def p01_member_accounting(t):
    # the duplicate-date rule has a summary row per date beside a row for every line it displaced
    summary = F.col("rule_code") == "DQ-05-DUPLICATE-SERVICE-DATE"
    rej = t["rejected_row"].groupBy("source_table").agg(
        F.count(F.lit(1)).cast("long").alias("rejected"), F.count(F.when(~summary, 1)).cast("long").alias("lines"))
    rows = []
    for member, targets in MEMBER_TARGETS.items():
        loaded = reduce(lambda a, b: beside(a, b).select((F.col("n") + F.col("m")).alias("n")),
                        [_n(t[x]) if i == 0 else _n(t[x], "m") for i, x in enumerate(targets)])
        rows.append(beside(_n(t[f"stg_{member}"], "staged"), loaded.withColumnRenamed("n", "loaded")).select(
            F.lit(f"stg_{member}").alias("source_table"), "staged", "loaded"))
    acc = reduce(DataFrame.unionByName, rows).join(rej, "source_table", "left")
    zero = F.lit(0).cast("long")
    return acc.select("source_table", "staged", "loaded", F.coalesce("rejected", zero).alias("rejected"),
                      (F.col("staged") - F.col("loaded") - F.coalesce("lines", zero)).cast("long").alias("unaccounted"))


def p02_stops_by_location_type(t):
    lt = F.nullif(F.trim("location_type"), F.lit(""))
    return t["stg_stops"].groupBy(lt.alias("location_type")).agg(F.count(F.lit(1)).cast("long").alias("stops"))


def p03_weekday_flag_totals(t):
    return t["service"].agg(*[F.sum(d).cast("long").alias(d) for d in WEEKDAYS],
                            F.count(F.lit(1)).cast("long").alias("services"))


def p04_naive_class_from_flags(t):
    flags = sum(F.col(d) for d in WEEKDAYS)
    return t["service"].groupBy(frequency_class(flags).alias("naive_class")).agg(
        F.count(F.lit(1)).cast("long").alias("services"))


def p05_service_dates_by_exception(t):
    return t["service_date"].groupBy("exception_type").agg(F.count(F.lit(1)).cast("long").alias("service_dates"))


def p06_declared_vs_real_window(t):
    real = t["service_days"].select("service_id", "first_operating_day", "last_operating_day")
    j = t["service"].join(real, "service_id")
    return j.agg(
        F.sum(F.when(F.col("start_date") == F.col("first_operating_day"), 1).otherwise(0)).cast("long")
        .alias("start_matches_first_date"),
        F.sum(F.when(F.col("end_date") == F.col("last_operating_day"), 1).otherwise(0)).cast("long")
        .alias("end_matches_last_date"),
        F.sum(F.when((F.col("start_date") > F.col("first_operating_day"))
                     | (F.col("end_date") < F.col("last_operating_day")), 1).otherwise(0)).cast("long")
        .alias("dates_outside_declared_window"),
    )


def p07_mean_vs_mode_class(t):
    f = t["v_service_frequency"]
    mean = F.col("operating_days").cast("double") / F.col("active_weeks").cast("double")
    return f.groupBy(
        F.col("frequency_class").alias("modal_class"), frequency_class(mean).alias("mean_class")
    ).agg(F.count(F.lit(1)).cast("long").alias("services"))


def p08_modal_days_distribution(t):
    return t["v_service_frequency"].groupBy(long("typical_days_per_week").alias("typical_days_per_week")).agg(
        F.count(F.lit(1)).cast("long").alias("services"))


def p09_empty_wheelchair_values(t):
    stg = t["stg_stops"].filter(F.nullif(F.trim("location_type"), F.lit("")) == "1")
    blank = stg.agg(F.sum(F.when(F.coalesce(F.trim("wheelchair_boarding"), F.lit("")) == "", 1).otherwise(0))
                    .cast("long").alias("staged_blank"))
    core = t["station"].agg(F.sum(F.when(F.col("wheelchair_boarding") == 0, 1).otherwise(0)).cast("long")
                            .alias("core_no_information"))
    return beside(blank, core)


def p10_bikes_by_mode_base(t):
    j = t["trip"].join(t["route"].select("route_id", "route_type"), "route_id")
    return j.groupBy(F.col("route_type").cast("int").alias("route_type")).agg(
        F.count(F.lit(1)).cast("long").alias("trips"),
        F.sum(F.when(F.col("bikes_allowed") == 1, 1).otherwise(0)).cast("long").alias("bikes_guaranteed"))


def p11_pickup_dropoff_crosstab(t):
    return t["stop_time"].groupBy(F.col("pickup_type").cast("int").alias("pickup_type"),
                                  F.col("drop_off_type").cast("int").alias("drop_off_type")).agg(
        F.count(F.lit(1)).cast("long").alias("calls"))


def p12_calls_vs_boardable_per_station(t):
    st = t["stop_time"].join(t["platform"].select("stop_id", "station_id"), "stop_id")
    agg = st.groupBy("station_id").agg(F.count(F.lit(1)).cast("long").alias("calls"),
                                       F.sum("is_boardable").cast("long").alias("boardable_calls"))
    return t["station"].select("station_id", "station_name").join(agg, "station_id").drop("station_id")


def p13_calls_by_day_offset(t):
    staged_late = t["stg_stop_times"].filter(F.trim("departure_time") >= "24:00:00").agg(
        F.count(F.lit(1)).cast("long").alias("staged_calls_at_or_after_24h"))
    by_offset = t["stop_time"].groupBy(F.col("day_offset").cast("int").alias("day_offset")).agg(
        F.count(F.lit(1)).cast("long").alias("calls"))
    return beside(by_offset, staged_late)


def p14_calls_by_calendar_date(t):
    """Calendar date of a call = service date + day offset, weighted without exploding calls x dates."""
    st = t["v_departure"].groupBy("service_id", "day_offset").agg(F.count(F.lit(1)).alias("calls"))
    sd = t["service_date"].filter(F.col("exception_type") == 1).select("service_id", "service_date")
    j = st.join(sd, "service_id")
    return j.groupBy(F.date_add("service_date", F.col("day_offset")).cast("string").alias("calendar_date")).agg(
        F.sum("calls").cast("long").alias("departures"))


def _payload(col):
    return F.get_json_object(F.col("payload"), f"$.{col}")


def p15_rejected_payload_profile(t):
    r = t["rejected_row"].filter(F.col("rule_code") == "DQ-03-IMPLAUSIBLE-DEPARTURE")
    return r.agg(
        F.count(F.lit(1)).cast("long").alias("rejected_calls"),
        F.count_distinct(_payload("trip_id")).cast("long").alias("distinct_trips"),
        F.min(_payload("departure_time")).alias("earliest_time"),
        F.max(_payload("departure_time")).alias("latest_time"),
    )


def p16_trips_partly_rejected(t):
    lost = t["rejected_row"].filter(F.col("source_table") == "stg_stop_times").select(
        _payload("trip_id").alias("trip_id")).distinct()
    kept = t["stop_time"].select("trip_id").distinct()
    return _n(lost.join(kept, "trip_id", "left_semi"), "trips_with_some_calls_lost")


def p17_amenity_code_distribution(t):
    tr = t["trip"]
    return tr.groupBy(F.lit("bikes_allowed").alias("field"), F.col("bikes_allowed").cast("int").alias("code")).agg(
        F.count(F.lit(1)).cast("long").alias("trips")
    ).unionByName(tr.groupBy(F.lit("wheelchair_accessible").alias("field"),
                             F.col("wheelchair_accessible").cast("int").alias("code")).agg(
        F.count(F.lit(1)).cast("long").alias("trips")))


def p18_translation_completeness(t):
    per_value = t["text_translation"].groupBy("table_name", "field_name", "field_value").agg(
        F.count_distinct("language").alias("languages"))
    return per_value.groupBy(long("languages").alias("languages")).agg(F.count(F.lit(1)).cast("long").alias("values"))


def p19_translations_by_language(t):
    return t["text_translation"].groupBy("table_name", "field_name", "language").agg(
        F.count(F.lit(1)).cast("long").alias("translations"))


def p20_stale_and_missing_translations(t):
    """Values translated for no station, and (station, language) pairs without a
    translation: languages present per station subtracted from the four expected."""
    names = t["station"].select(F.col("station_name").alias("field_value")).distinct()
    tr = t["text_translation"].filter(F.col("field_name") == "stop_name")
    stale = tr.select("field_value").distinct().join(names, "field_value", "left_anti")
    present = tr.filter(F.col("language").isin(*TRANSLATION_LANGUAGES)).groupBy("field_value").agg(
        F.count_distinct("language").alias("n"))
    missing = names.join(present, "field_value", "left").agg(
        F.sum(F.lit(len(TRANSLATION_LANGUAGES)) - F.coalesce(F.col("n"), F.lit(0))).cast("long")
        .alias("missing_station_languages"))
    return beside(_n(stale, "stale_values"), missing)


def p21_rejected_joined_to_staged(t):
    r = t["rejected_row"].filter(F.col("source_table") == "stg_stop_times").select("rule_code", "src_line_no")
    s = t["stg_stop_times"].select("src_line_no", "trip_id")
    return r.join(s, "src_line_no", "left").groupBy("rule_code").agg(
        F.count(F.lit(1)).cast("long").alias("rejected"),
        F.count("trip_id").cast("long").alias("matched_to_staged_line"))


def p22_rejected_by_rule(t):
    return t["rejected_row"].groupBy("rule_code").agg(F.count(F.lit(1)).cast("long").alias("rows_rejected"))


def p23_snapshots_per_feed(t):
    return t["rt_snapshot"].groupBy("feed").agg(F.count(F.lit(1)).cast("long").alias("snapshots"),
                                                F.min("fetched_at_utc").alias("first_fetch"),
                                                F.max("fetched_at_utc").alias("last_fetch"))


def p24_feed_summary(t):
    f = t["feed_info"].select("feed_version", F.col("feed_start_date").cast("string").alias("feed_start_date"),
                              F.col("feed_end_date").cast("string").alias("feed_end_date"))
    return beside(f, _n(t["stop_time"], "stop_times"), _n(t["trip"], "trips"))


def p25_last_day_per_trip_grouped(t):
    """Grouped join, aggregated at the service grain first: a trip's last day is its
    service's, so trips x dates pairs are never formed."""
    last = t["service_date"].groupBy("service_id").agg(F.max("service_date").alias("last_day"))
    return t["trip"].select("trip_id", "service_id").join(last, "service_id").select(
        "trip_id", F.col("last_day").cast("string").alias("last_day"))


def p26_last_day_per_trip_correlated(t):
    """Correlated scalar subquery in SQL; Catalyst rewrites it into an aggregate + join."""
    spark = t["trip"].sparkSession
    t["trip"].createOrReplaceTempView("ql_trip")
    t["service_date"].createOrReplaceTempView("ql_service_date")
    return spark.sql("""
        SELECT tr.trip_id,
               CAST((SELECT max(sd.service_date) FROM ql_service_date sd WHERE sd.service_id = tr.service_id) AS STRING)
                   AS last_day
        FROM ql_trip tr
        WHERE EXISTS (SELECT 1 FROM ql_service_date sd2 WHERE sd2.service_id = tr.service_id)
    """)


def p27_last_day_per_trip_window(t):
    """The window form: every service-date row learns its service's last day; the
    distinct (service, last day) rows then meet the trips (no trips x dates rows)."""
    w = Window.partitionBy("service_id")
    per_service = t["service_date"].select("service_id", F.max("service_date").over(w).alias("last_day")).distinct()
    return t["trip"].select("trip_id", "service_id").join(per_service, "service_id").select(
        "trip_id", F.col("last_day").cast("string").alias("last_day"))


def p28_latest_row_per_service(t):
    sd = t["service_date"]
    return sd.groupBy("service_id").agg(
        F.max_by(F.struct("service_date", "exception_type", "day_of_week"), "service_date").alias("r")
    ).select("service_id", F.col("r.service_date").cast("string").alias("service_date"),
             F.col("r.exception_type").alias("exception_type"), F.col("r.day_of_week").alias("day_of_week"))


def p29_origin_by_min_agrees(t):
    first = t["v_departure"].groupBy("trip_id").agg(F.min("stop_sequence").alias("stop_sequence"))
    agree = first.join(t["v_trip_origin"].select("trip_id", "stop_sequence"), ["trip_id", "stop_sequence"])
    return beside(_n(first, "trips"), _n(agree, "agreeing_with_origin_view"))


def p30_service_days_in_year(t, year: int = 2024):
    sd = t["service_date"]
    ranged = sd.filter((F.col("service_date") >= F.lit(f"{year}-01-01").cast("date"))
                       & (F.col("service_date") < F.lit(f"{year + 1}-01-01").cast("date")))
    by_fn = sd.filter(F.year("service_date") == year)
    return beside(_n(ranged, "half_open_range"), _n(by_fn, "year_function"))


def p31_column_emptiness(t):
    """Every declared column of every member, one pass per member: a column that is NULL on every row is not in
    the header (the reader fills absent columns with NULL and blank fields with empty text)."""
    parts = []
    for member, cols in MEMBER_COLUMNS.items():
        stg = t[f"stg_{member}"]
        agg = stg.agg(F.count(F.lit(1)).alias("_rows"), *[x for c in cols for x in (
            F.count(F.when(F.coalesce(F.trim(c), F.lit("")) == "", 1)).alias(f"b_{c}"), F.count(c).alias(f"n_{c}"))])
        stacked = agg.select("_rows", F.explode(F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.col(f"b_{c}").alias("blank"), F.col(f"n_{c}").alias("given")) for c in cols])).alias("x"))
        parts.append(stacked.select(F.lit(member).alias("member"), "x.*", F.col("_rows").alias("rows")))
    status = (F.when(F.col("rows") == 0, "no rows").when(F.col("given") == 0, "absent from the header")
              .when(F.col("blank") == F.col("rows"), "blank on every row").when(F.col("blank") == 0, "populated").otherwise("partly blank"))
    return reduce(DataFrame.unionByName, parts).select(
        "member", "column_name", F.col("blank").alias("blank_rows"), "rows", status.alias("status"))


def p32_child_name_matches_parent(t):
    stg = t["stg_stops"]
    child = stg.filter(F.trim("location_type") == "0").select(F.trim("parent_station").alias("pid"),
                                                             F.col("stop_name").alias("child_name"))
    parent = stg.filter(F.trim("location_type") == "1").select(F.trim("stop_id").alias("pid"),
                                                              F.col("stop_name").alias("parent_name"))
    j = child.join(parent, "pid")
    return j.agg(F.count(F.lit(1)).cast("long").alias("children"),
                 F.sum(F.when(F.col("child_name") != F.col("parent_name"), 1).otherwise(0)).cast("long")
                 .alias("name_differs_from_parent"))


def p33_platforms_with_code(t):
    return t["platform"].groupBy(F.col("has_platform_code").cast("int").alias("has_platform_code")).agg(
        F.count(F.lit(1)).cast("long").alias("platforms"))


def p34_codeless_platforms_per_station(t):
    per_station = t["platform"].groupBy("station_id").agg(
        F.sum(F.when(F.col("has_platform_code") == 0, 1).otherwise(0)).alias("codeless"))
    return per_station.agg(F.min("codeless").cast("long").alias("fewest_codeless"),
                           F.max("codeless").cast("long").alias("most_codeless"))


def p35_calls_at_named_station(t, station: str = FOCUS_STATION):
    st = t["stop_time"].join(t["platform"].select("stop_id", "station_id"), "stop_id").join(
        t["station"].filter(F.col("station_name") == station).select("station_id"), "station_id")
    return _n(st, "calls").select(F.lit(station).alias("station_name"), "calls")


def p36_transfer_profile(t):
    tr = t["transfer"]
    return tr.agg(
        F.count(F.lit(1)).cast("long").alias("transfers"),
        F.sum(F.when(F.col("from_trip_id").isNotNull() | F.col("to_trip_id").isNotNull(), 1).otherwise(0))
        .cast("long").alias("trip_scoped"),
        F.sum(F.when(F.col("from_stop_id") == F.col("to_stop_id"), 1).otherwise(0)).cast("long").alias("self_transfers"),
        F.min("min_transfer_time").cast("long").alias("min_transfer_time_min"),
        F.max("min_transfer_time").cast("long").alias("min_transfer_time_max"),
    )


def p36_transfer_types(t):
    """Transfers by type and minimum time, how many of them bound to trips."""
    return t["transfer"].groupBy("transfer_type", "min_transfer_time").agg(
        F.count(F.lit(1)).alias("transfers"),
        F.count(F.when(F.col("from_trip_id").isNotNull() | F.col("to_trip_id").isNotNull(), 1)).alias("trip_scoped"))


def p36_pairs_both_ways(t):
    """Unordered pairs of stops with a transfer, within and across stations: one aggregate by (least, greatest)
    and a mask of the directions that occur, no self-join."""
    at = lambda end: t["platform"].select(F.col("stop_id").alias(f"{end}_stop_id"), F.col("station_id").alias(f"{end}_station"))
    ends = t["transfer"].select("from_stop_id", "to_stop_id").filter(F.col("from_stop_id") != F.col("to_stop_id"))
    forward = F.col("from_stop_id") < F.col("to_stop_id")
    pairs = ends.join(at("from"), "from_stop_id").join(at("to"), "to_stop_id").groupBy(
        F.least("from_stop_id", "to_stop_id"), F.greatest("from_stop_id", "to_stop_id"),
        (F.col("from_station") != F.col("to_station")).alias("crosses_stations")).agg(
        F.bit_or(F.when(forward, 1).otherwise(2)).alias("directions"))
    return pairs.groupBy("crosses_stations").agg(
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("directions") == 3, 1)).alias("stored_both_ways"),
        F.count(F.when(F.col("directions") != 3, 1)).alias("stored_one_way"))


def p37_transfers_at_stop(t, stop_id: str = LOOKUP_STOP):
    tr = t["transfer"]
    return beside(_n(tr.filter(F.col("to_stop_id") == stop_id), "transfers_in"),
                  _n(tr.filter(F.col("from_stop_id") == stop_id), "transfers_out"))


def p38_distinct_service_dates(t):
    return t["service_date"].agg(F.count_distinct("service_date").cast("long").alias("distinct_service_dates"))


def p39_stop_status_distribution(t):
    """Stop-level status: updates, those that carry no time at all, and the range of delays."""
    u = t["rt_stop_time_update"]
    times = [c for c in ("arrival_time_epoch", "arrival_delay_s", "departure_time_epoch", "departure_delay_s") if c in u.columns]
    return u.groupBy(F.col("schedule_relationship").cast("int").alias("schedule_relationship")).agg(
        F.count(F.lit(1)).cast("long").alias("updates"),
        F.sum(F.when(F.col("departure_delay_s").isNull(), 1).otherwise(0)).cast("long").alias("without_delay"),
        F.count(F.when(F.coalesce(*times).isNull(), 1)).alias("without_any_time"),
        F.min("departure_delay_s").cast("long").alias("min_delay_s"),
        F.max("departure_delay_s").cast("long").alias("max_delay_s"),
    )


def p40_payload_profile(t):
    """Per snapshot: entities, updates, alerts, languages per text block, alerts without an active period.

    The tables' rows are counted under their snapshot in one aggregate; a text's language counts once,
    and an alert meets its periods by (snapshot, entity) before."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    names = ["entities", "updates", "alerts", "alerts_without_period"]

    def counted(df, **values):
        return df.select("snapshot_id", *[values.get(n, none).alias(n) for n in names],
                         values.get("header", F.lit(None).cast("string")).alias("header"),
                         values.get("description", F.lit(None).cast("string")).alias("description"))

    periods = t["rt_alert_active_period"].select("snapshot_id", "rt_entity_id", F.lit(1).alias("_has")).distinct()
    alerts = t["rt_alert"].join(periods, ["snapshot_id", "rt_entity_id"], "left")
    text = lambda field: F.when(F.col("field_name") == field, F.col("language"))
    rows = reduce(DataFrame.unionByName, [
        counted(t["rt_trip_update"], entities=one), counted(t["rt_stop_time_update"], updates=one),
        counted(alerts, alerts=one, alerts_without_period=F.when(F.col("_has").isNull(), one).otherwise(none)),
        counted(t["rt_alert_text"].select("snapshot_id", "field_name", "language").distinct(), header=text("header"),
                description=text("description"))])
    per = rows.groupBy("snapshot_id").agg(
        *[F.sum(n).alias(n) for n in names], F.count("header").alias("header_languages"),
        F.count("description").alias("description_languages"))
    return t["rt_snapshot"].select("snapshot_id", "feed").join(per, "snapshot_id", "left").select(
        "snapshot_id", "feed", *[F.coalesce(c, none).alias(c) for c in (
            "entities", "updates", "alerts", "header_languages", "description_languages", "alerts_without_period")])


def p41_column_profile(t, table: str = "stop_time"):
    """Numeric columns of a table from one shuffle: rows are turned into (column, value) and counted
    map-side, so the figures of a column come from its distinct values."""
    df = t[table]
    num = [c for c, dt in df.dtypes if dt in ("int", "bigint", "double")]
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in num])).alias("x"))
    counts = cells.groupBy("x.column_name", "x.v").agg(F.count(F.lit(1)).alias("n"))
    held = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    agg = counts.groupBy("column_name").agg(
        F.sum(held).alias("populated"), F.count("v").alias("distinct_values"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.sum(F.col("v") * F.col("n")).alias("s"))
    return agg.select(
        "column_name", long("populated").alias("populated"), long("distinct_values").alias("distinct_values"),
        "min_value", "max_value", ratio("s", "populated", 4).alias("mean_value"),
    )


CORE_TABLES = ["feed_info", "agency", "station", "platform", "route", "service", "service_date", "trip", "stop_time",
               "transfer", "text_translation"]
KINDS = {"string": "text", "date": "date", "int": "integer", "bigint": "integer", "double": "real"}


def p41_typed_profile(t):
    """Every column of every core table, texts, dates and numbers in one shuffle of distinct values.

    A cell holds its value as a number or as text (dates in ISO form, which sorts by time), so columns of all kinds are
    counted map-side under (table, column, value). A column of an empty table has its row too. Means are of whole
    numbers, whose sums are exact."""
    none, parts = F.lit(None), []
    for name in CORE_TABLES:
        typed = [(c, KINDS[kind]) for c, kind in t[name].dtypes]
        cells = lambda value: F.explode(F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("kind"),
            (value(c) if kind in ("text", "date") else none).cast("string").alias("words"),
            (value(c) if kind in ("integer", "real") else none).cast("double").alias("number")) for c, kind in typed]))
        held = t[name].select(cells(F.col).alias("x"), F.lit(1).alias("one"))
        listed = t[name].sparkSession.range(1).select(cells(lambda c: none).alias("x"), F.lit(0).alias("one"))
        parts.append(held.unionByName(listed).select(F.lit(name).alias("table_name"), "x.*", "one"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("table_name", "column_name", "kind", "words", "number").agg(
        F.sum("one").alias("n"))
    given = F.col("words").isNotNull() | F.col("number").isNotNull()
    agg = counts.groupBy("table_name", "column_name", "kind").agg(
        F.sum("n").alias("rows"), F.sum(F.when(given, F.col("n")).otherwise(0)).alias("populated"),
        F.sum(F.when(F.trim("words") == "", F.col("n")).otherwise(0)).alias("blank"),
        (F.count("words") + F.count("number")).alias("distinct_values"),
        F.min("words").alias("min_text"), F.max("words").alias("max_text"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"),
        F.sum(F.when(F.col("kind") == "integer", F.col("number") * F.col("n"))).alias("s"))
    return agg.select(
        "table_name", "column_name", "kind", "rows", "populated", "blank", "distinct_values", "min_text", "max_text",
        "min_number", "max_number", ratio("s", "populated", 4).alias("mean_value"))
