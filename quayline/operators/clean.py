"""Cleaning rules DQ-01..DQ-09: staged text members -> typed core + quarantine.

Nothing is dropped silently: every staged row either loads or lands in the
quarantine with a rule code, a reason and a JSON payload (loaded + quarantined
= staged, per member). Rule codes the reference lacks are marked ``-QL``.

Joins to places and lines are plain equi-joins: Spark broadcasts a side when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks
at runtime). The estimate is the size of the files, far below that of the rows,
so trips and the services they look up are merge-joined (``session.grown``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions import blank_to_null, clock_secs, code_or_default, gtfs_date, is_digits
from quayline.schemas import REJECT_REASONS, STOP_TIME_RULES, TRANSLATION_LANGUAGES, TRANSLATION_TABLES, WEEKDAYS
from quayline.session import grown

REJECT_COLUMNS = ["source_table", "src_line_no", "rule_code", "reason", "payload"]


def _payload(**cols) -> F.Column:
    """JSON object of the offending values; NULL fields are kept as ``null``."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]), {"ignoreNullFields": "false"})


def _reject(df: DataFrame, table: str, rule, payload: F.Column) -> DataFrame:
    rule_c = rule if isinstance(rule, F.Column) else F.lit(rule)
    known = F.create_map(*[F.lit(x) for pair in REJECT_REASONS[table].items() for x in pair])
    reason_c = known[rule_c]
    return df.select(
        F.lit(f"stg_{table}").alias("source_table"),
        F.col("src_line_no").cast("long").alias("src_line_no"),
        rule_c.alias("rule_code"),
        reason_c.alias("reason"),
        payload.alias("payload"),
    )


def _t(c: str) -> F.Column:
    return F.trim(F.col(c))


@dataclass
class Cleaned:
    tables: dict[str, DataFrame]
    rejected: DataFrame


# --------------------------------------------------------------------------- T03
def feed_info(stg: DataFrame) -> DataFrame:
    return stg.select(
        _t("feed_id").alias("feed_id"),
        _t("feed_publisher_name").alias("feed_publisher_name"),
        blank_to_null("feed_publisher_url").alias("feed_publisher_url"),
        blank_to_null("feed_lang").alias("feed_lang"),
        gtfs_date("feed_start_date").alias("feed_start_date"),
        gtfs_date("feed_end_date").alias("feed_end_date"),
        blank_to_null("feed_version").alias("feed_version"),
    )


# --------------------------------------------------------------------------- T04
def agency(stg: DataFrame):
    ok = F.coalesce(_t("agency_id"), F.lit("")) != ""
    core = stg.filter(ok).select(
        _t("agency_id").alias("agency_id"),
        _t("agency_name").alias("agency_name"),
        blank_to_null("agency_url").alias("agency_url"),
        _t("agency_timezone").alias("agency_timezone"),
        blank_to_null("agency_lang").alias("agency_lang"),
        blank_to_null("agency_phone").alias("agency_phone"),
    )
    rej = _reject(stg.filter(~ok), "agency", "DQ-08-BLANK-AGENCY-ID-QL",
                  _payload(agency_name=F.col("agency_name")))
    return core, rej


# --------------------------------------------------------------------------- T05-T07
def _location_type() -> F.Column:
    return blank_to_null("location_type").try_cast("int")


def _junk_stop() -> F.Column:
    """A coordinate, or the boarding code of a station, that is given but no number."""
    def junk(c, kind):
        given = blank_to_null(c)
        return given.isNotNull() & given.try_cast(kind).isNull()

    return junk("stop_lat", "double") | junk("stop_lon", "double") | (
        (_location_type() == 1) & junk("wheelchair_boarding", "int"))


def stations(stg: DataFrame) -> DataFrame:
    return stg.filter((_location_type() == 1) & ~_junk_stop()).select(
        _t("stop_id").alias("station_id"),
        _t("stop_name").alias("station_name"),
        blank_to_null("stop_lat").try_cast("double").alias("latitude"),
        blank_to_null("stop_lon").try_cast("double").alias("longitude"),
        code_or_default("wheelchair_boarding").alias("wheelchair_boarding"),
    )


def platforms(stg: DataFrame, station: DataFrame):
    candidates = stg.filter(_location_type() == 0).withColumn("_parent", _t("parent_station"))
    parents = station.select(F.col("station_id").alias("_parent"), F.lit(1).alias("_has_parent"))
    screened = candidates.join(parents, "_parent", "left")
    platform = screened.filter((F.col("_has_parent") == 1) & ~_junk_stop()).select(
        _t("stop_id").alias("stop_id"),
        F.col("_parent").alias("station_id"),
        blank_to_null("platform_code").alias("platform_code"),
        blank_to_null("stop_lat").try_cast("double").alias("latitude"),
        blank_to_null("stop_lon").try_cast("double").alias("longitude"),
        blank_to_null("stop_desc").alias("stop_desc"),
        F.when(F.coalesce(_t("platform_code"), F.lit("")) != "", 1).otherwise(0).alias("has_platform_code"),
    )
    orphan = _reject(
        screened.filter(F.col("_has_parent").isNull()), "stops", "DQ-04-ORPHAN-PLATFORM",
        _payload(stop_id=F.col("stop_id"), parent_station=F.col("parent_station"), stop_name=F.col("stop_name")),
    )
    loc = _location_type()
    other = _reject(
        stg.filter(loc.isNull() | ~loc.isin(0, 1)), "stops",
        "DQ-08-UNSUPPORTED-LOCATION-TYPE-QL",
        _payload(stop_id=F.col("stop_id"), location_type=F.col("location_type")),
    )
    # a station with junk, or a platform of a station read: every line has one rule
    kept_place = ["src_line_no", "stop_id", "stop_lat", "stop_lon", "wheelchair_boarding"]
    junk = _reject(
        stg.filter((loc == 1) & _junk_stop()).select(kept_place).unionByName(
            screened.filter((F.col("_has_parent") == 1) & _junk_stop()).select(kept_place)),
        "stops", "DQ-08-BAD-CODE-QL",
        _payload(stop_id=F.col("stop_id"), stop_lat=F.col("stop_lat"), stop_lon=F.col("stop_lon"),
                 wheelchair_boarding=F.col("wheelchair_boarding")),
    )
    return platform, orphan.unionByName(other).unionByName(junk)


# --------------------------------------------------------------------------- T08
def routes(stg: DataFrame, agency_df: DataFrame):
    keys = agency_df.select(F.col("agency_id").alias("_agency"), F.lit(1).alias("_ok"))
    rtype = _t("route_type").try_cast("int")
    s = stg.withColumn("_agency", _t("agency_id")).join(keys, "_agency", "left").withColumn("_rtype", rtype)
    good = (F.col("_ok") == 1) & F.col("_rtype").isNotNull()
    core = s.filter(good).select(
        _t("route_id").alias("route_id"),
        F.col("_agency").alias("agency_id"),
        blank_to_null("route_short_name").alias("route_short_name"),
        blank_to_null("route_long_name").alias("route_long_name"),
        F.col("_rtype").alias("route_type"),
        blank_to_null("route_color").alias("route_color"),
        blank_to_null("route_text_color").alias("route_text_color"),
    )
    rej = _reject(
        s.filter(~good), "routes",
        F.when(F.col("_ok").isNull(), F.lit("DQ-04-ORPHAN-ROUTE-QL")).otherwise(F.lit("DQ-08-BAD-CODE-QL")),
        _payload(route_id=F.col("route_id"), agency_id=F.col("agency_id"), route_type=F.col("route_type")),
    )
    return core, rej


# --------------------------------------------------------------------------- T09
def services(stg: DataFrame):
    flags = {d: code_or_default(d) for d in WEEKDAYS}
    dated = gtfs_date("start_date").isNotNull() & gtfs_date("end_date").isNotNull()
    flagged = F.lit(True)
    for d in WEEKDAYS:
        flagged = flagged & F.col(f"_{d}").isNotNull()
    s = stg.select("*", *[c.alias(f"_{d}") for d, c in flags.items()])
    core = s.filter(dated & flagged).select(
        _t("service_id").alias("service_id"),
        gtfs_date("start_date").alias("start_date"),
        gtfs_date("end_date").alias("end_date"),
        *[F.col(f"_{d}").alias(d) for d in WEEKDAYS],
        F.when(sum(F.col(f"_{d}") for d in WEEKDAYS) > 0, 1).otherwise(0).alias(
            "has_weekday_pattern"
        ),
    )
    rej = _reject(
        s.filter(~(dated & flagged)), "calendar",
        F.when(dated, F.lit("DQ-08-BAD-CODE-QL")).otherwise(F.lit("DQ-06-BAD-SERVICE-DATE-QL")),
        _payload(service_id=F.col("service_id"), start_date=F.col("start_date"), end_date=F.col("end_date")),
    )
    return core, rej


# --------------------------------------------------------------------------- T10-T12
def service_dates(stg: DataFrame, service_df: DataFrame):
    keys = service_df.select(F.col("service_id").alias("_sid"), F.lit(1).alias("_ok"))
    d = stg.withColumn("_sid", _t("service_id")).withColumn("_date", gtfs_date("date"))
    s = d.join(keys, "_sid", "left")
    exc = _t("exception_type").try_cast("int")
    good = (F.col("_ok") == 1) & F.col("_date").isNotNull() & exc.isNotNull()
    # First wins per (service, date) as an aggregate: copies of a hot key collapse
    # map-side (partial aggregation) instead of meeting in one window task.
    firsts = s.filter(good).groupBy("_sid", "_date").agg(
        F.min(F.struct("src_line_no", exc.alias("exception_type"))).alias("_first"))
    kept = (
        firsts.select(
            F.col("_sid").alias("service_id"),
            F.col("_date").alias("service_date"),
            F.col("_first.exception_type").alias("exception_type"),
            (F.dayofweek("_date") - 1).alias("day_of_week"),
        )
    )
    orphan = _reject(
        s.filter(F.col("_ok").isNull() | (F.length(_t("date")) != 8) | _t("date").isNull()),
        "calendar_dates", "DQ-04-ORPHAN-SERVICE-DATE",
        _payload(service_id=F.col("service_id"), date=F.col("date")),
    )
    invalid = _reject(
        s.filter((F.col("_ok") == 1) & (F.length(_t("date")) == 8) & (F.col("_date").isNull() | exc.isNull())),
        "calendar_dates", "DQ-06-INVALID-DATE-QL",
        _payload(service_id=F.col("service_id"), date=F.col("date"), exception_type=F.col("exception_type")),
    )
    # One summary row per duplicated key, counted over every staged line (orphans too).
    dups = (
        d.groupBy(_t("service_id").alias("_s"), _t("date").alias("_d"))
        .agg(F.min("src_line_no").alias("src_line_no"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
    )
    dup = _reject(
        dups, "calendar_dates", "DQ-05-DUPLICATE-SERVICE-DATE",
        _payload(service_id=F.col("_s"), date=F.col("_d"), occurrences=F.col("_n")),
    )
    # and one row per line that the first one displaced, so that every staged line is accounted for
    again = s.filter(good).join(
        firsts.select(F.col("_sid").alias("_s"), F.col("_date").alias("_d"), F.col("_first.src_line_no").alias("_line")),
        (F.col("_sid") == F.col("_s")) & (F.col("_date") == F.col("_d")) & (F.col("src_line_no") != F.col("_line")))
    surplus = _reject(again, "calendar_dates", "QL-SURPLUS-SERVICE-DATE",
                      _payload(service_id=F.col("service_id"), date=F.col("date"), first_line=F.col("_line")))
    return kept, orphan.unionByName(invalid).unionByName(dup).unionByName(surplus)


def expand_weekly_patterns(service_df: DataFrame, service_date_df: DataFrame) -> DataFrame:
    """Option for §2.13 #18: dates from the weekly pattern, minus removed, plus added.

    Each service's [start_date, end_date] is exploded with ``sequence`` (one row
    per calendar day of that service, bounded by its own date range) and kept
    where the weekday flag is set. Explicit exceptions then win: exception 2
    removes a date, exception 1 adds one. Result rows all carry exception 1.
    """
    flags = F.array(*[F.col(d) for d in WEEKDAYS])  # Monday first
    days = service_df.filter(F.col("has_weekday_pattern") == 1).select(
        "service_id", F.explode(F.sequence("start_date", "end_date")).alias("service_date"), flags.alias("_flags")
    )
    # dayofweek: 1 = Sunday ... 7 = Saturday -> Monday-first index 1..7
    monday_first = F.pmod(F.dayofweek("service_date") + 5, F.lit(7)) + 1
    weekly = days.filter(F.element_at("_flags", monday_first.cast("int")) == 1).select("service_id", "service_date")
    removed = service_date_df.filter(F.col("exception_type") == 2).select("service_id", "service_date")
    added = service_date_df.filter(F.col("exception_type") == 1).select("service_id", "service_date")
    dates = weekly.join(removed, ["service_id", "service_date"], "left_anti").unionByName(added).distinct()
    return dates.select("service_id", "service_date", F.lit(1).alias("exception_type"),
                        (F.dayofweek("service_date") - 1).alias("day_of_week"))


# --------------------------------------------------------------------------- T13-T14
def trips(stg: DataFrame, route_df: DataFrame, service_df: DataFrame):
    r = route_df.select(F.col("route_id").alias("_rid"), F.lit(1).alias("_rok"))
    sv = service_df.select(F.col("service_id").alias("_sid"), F.lit(1).alias("_sok"))
    s = (
        stg.withColumn("_rid", _t("route_id"))
        .withColumn("_sid", _t("service_id"))
        .join(r, "_rid", "left")
        .join(grown(sv), "_sid", "left")
    )
    bikes, chair = code_or_default("bikes_allowed"), code_or_default("wheelchair_accessible")
    direction = blank_to_null("direction_id").try_cast("int")
    linked = (F.col("_rok") == 1) & (F.col("_sok") == 1)
    codes_ok = (bikes.isNotNull() & chair.isNotNull()
                & (blank_to_null("direction_id").isNull() | direction.isNotNull()))
    core = s.filter(linked & codes_ok).select(
        _t("trip_id").alias("trip_id"),
        F.col("_rid").alias("route_id"),
        F.col("_sid").alias("service_id"),
        blank_to_null("trip_headsign").alias("trip_headsign"),
        blank_to_null("trip_short_name").alias("trip_short_name"),
        blank_to_null("block_id").alias("block_id"),
        direction.alias("direction_id"),
        bikes.alias("bikes_allowed"),
        chair.alias("wheelchair_accessible"),
    )
    rej = _reject(
        s.filter(~linked | linked.isNull() | ~codes_ok), "trips",
        F.when(linked, F.lit("DQ-08-BAD-CODE-QL")).otherwise(F.lit("DQ-09-ORPHAN-TRIP")),
        _payload(trip_id=F.col("trip_id"), route_id=F.col("route_id"), service_id=F.col("service_id")),
    )
    return core, rej


# --------------------------------------------------------------------------- T15-T21
def screen_stop_times(stg: DataFrame, trip_df: DataFrame, platform_df: DataFrame,
                      rank_after_screening: bool = False, put=None) -> DataFrame:
    """Parse, look up and rank every staged call; ``reject_rule`` NULL = accepted.

    The existence look-ups are left joins on key projections. "Duplicate" means
    "not the first staged line of its (trip_id, stop_sequence)" and is decided
    before the other rules, as the reference does (a rejected first copy still
    outranks a good second copy). ``rank_after_screening`` instead looks for the
    first line only among copies that pass every other rule, so a bad first copy
    no longer takes a good second copy down with it.
    """
    parsed = stg.select(
        "src_line_no",
        _t("trip_id").alias("trip_id"),
        _t("stop_id").alias("stop_id"),
        _t("stop_sequence").try_cast("int").alias("stop_sequence"),
        # digits alone are not enough: eleven of them are no integer
        (is_digits("stop_sequence") == 1).alias("_digits"),
        blank_to_null("arrival_time").alias("arrival_time"),
        blank_to_null("departure_time").alias("departure_time"),
        clock_secs("arrival_time").alias("arrival_secs"),
        clock_secs("departure_time").alias("departure_secs"),
        code_or_default("pickup_type").alias("pickup_type"),
        code_or_default("drop_off_type").alias("drop_off_type"),
        blank_to_null("stop_headsign").alias("stop_headsign"),
    ).withColumn("is_numbered", F.col("_digits") & F.col("stop_sequence").isNotNull()).drop("_digits")
    put = put or _keep
    trips_k = grown(trip_df.select("trip_id", F.lit(True).alias("trip_known")))
    plats_k = platform_df.select("stop_id", F.lit(True).alias("platform_known"))
    if rank_after_screening:
        # the other rules must be known before the first line can be chosen
        looked_up = parsed.join(trips_k, "trip_id", "left").join(plats_k, "stop_id", "left")
        firsts = (looked_up.filter(_other_rules(with_duplicate=False).isNull())
                  .groupBy("trip_id", "stop_sequence").agg(F.min("src_line_no").alias("_first_line")))
        keyed = _join_firsts(looked_up, firsts, extra=[])
    else:
        # Strict (reference order): every staged copy competes. Only keys that repeat need
        # their first line (an aggregate: copies collapse map-side), so they are put: few
        # of them are broadcast. The wide staged rows are shuffled once, by trip, for both
        # look-ups and for the fact's layout.
        repeated = put("stop_time_repeated", parsed.groupBy("trip_id", "stop_sequence").agg(
            F.min("src_line_no").alias("_first_line"), F.count(F.lit(1)).alias("_lines")).filter("_lines > 1").drop("_lines"))
        keyed = _join_first_by_trip(parsed, trips_k, repeated).withColumn(
            "_first_line", F.coalesce("_first_line", "src_line_no")).join(plats_k, "stop_id", "left")
    screened = keyed.withColumn("is_first_copy", F.col("src_line_no").eqNullSafe(F.col("_first_line")))
    return screened.withColumn("reject_rule", _other_rules(with_duplicate=True))


def _trip_key(rows: DataFrame) -> DataFrame:
    """``_trip`` and ``_no_trip`` stand for a trip that may be NULL; rows without one are spread by their sequence."""
    return rows.withColumns({"_trip": F.coalesce("trip_id", F.col("stop_sequence").cast("string"), F.lit("")),
                             "_no_trip": F.col("trip_id").isNull()})


def _join_first_by_trip(parsed: DataFrame, trips_k: DataFrame, repeated: DataFrame) -> DataFrame:
    """The calls with ``trip_known`` and the first line of their key, both met in the calls' shuffle by trip.

    Spark takes the shuffle by trip for the second join too where
    ``spark.sql.requireAllClusterKeysForCoPartition`` is off, as in the core's build."""
    p, t, f = _trip_key(parsed).repartition("_trip").alias("p"), trips_k.alias("t"), _trip_key(repeated).alias("f")
    known = p.join(t, (F.col("p._trip") == F.col("t.trip_id")) & ~F.col("p._no_trip"), "left").select("p.*", "t.trip_known").alias("p")
    same = ((F.col("p._trip") == F.col("f._trip")) & (F.col("p._no_trip") == F.col("f._no_trip"))
            & F.col("p.stop_sequence").eqNullSafe(F.col("f.stop_sequence")))
    columns = ["trip_id", *[c for c in parsed.columns if c != "trip_id"], "trip_known"]
    return known.join(f, same, "left").select(*[f"p.{c}" for c in columns], "f._first_line")


def _join_firsts(rows: DataFrame, firsts: DataFrame, extra: list[str]) -> DataFrame:
    f = firsts.alias("f")
    p = rows.alias("p")
    cond = F.col("p.trip_id").eqNullSafe(F.col("f.trip_id")) & F.col("p.stop_sequence").eqNullSafe(
        F.col("f.stop_sequence"))
    return p.join(f, cond, "left").select("p.*", "f._first_line", *[f"f.{c}" for c in extra])


def _other_rules(with_duplicate: bool) -> F.Column:
    """The first-match cascade; without the duplicate rule when ranking after screening."""
    conds = [
        F.col("trip_known").isNull(),
        F.col("platform_known").isNull(),
        ~F.col("is_numbered"),
        F.col("pickup_type").isNull() | F.col("drop_off_type").isNull(),
        F.col("departure_secs").isNull() & F.col("arrival_secs").isNull(),
        F.coalesce("departure_secs", "arrival_secs") >= 172800,
        ~F.col("is_first_copy"),
    ]
    rule = None
    pairs = list(zip(conds, STOP_TIME_RULES))
    if not with_duplicate:
        pairs = pairs[:-1]
    for cond, (code, _) in pairs:
        rule = F.when(cond, F.lit(code)) if rule is None else rule.when(cond, F.lit(code))
    return rule


STOP_TIME_COLUMNS = [
    "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time", "arrival_secs", "departure_secs",
    "departure_hour", "arrival_hour", "day_offset", "pickup_type", "drop_off_type", "stop_headsign",
    "is_boardable", "is_alightable",
]


def with_fact_columns(screened: DataFrame) -> DataFrame:
    """The screened calls with the fact's derived columns and a ``load_status``.

    Written once, partitioned by ``load_status``: the fact is the pruned read of
    the ``loaded`` partition (filters on its stored columns still reach the scan)
    and the quarantine reads the ``rejected`` one, so the largest table is never
    written twice."""
    dep, arr = F.col("departure_secs"), F.col("arrival_secs")
    return screened.select(
        "*",
        F.when(dep.isNotNull(), (dep / 3600).cast("int") % 24).alias("departure_hour"),
        F.when(arr.isNotNull(), (arr / 3600).cast("int") % 24).alias("arrival_hour"),
        (F.coalesce(dep, arr) / 86400).cast("int").alias("day_offset"),
        F.when(F.col("pickup_type") == 1, 0).otherwise(1).alias("is_boardable"),
        F.when(F.col("drop_off_type") == 1, 0).otherwise(1).alias("is_alightable"),
        F.when(F.col("reject_rule").isNull(), F.lit("loaded")).otherwise(F.lit("rejected")).alias("load_status"),
    )


def accepted_stop_times(screened: DataFrame) -> DataFrame:
    if "load_status" not in screened.columns:
        screened = with_fact_columns(screened)
    return screened.filter(F.col("load_status") == "loaded").select(*STOP_TIME_COLUMNS)


def rejected_stop_times(screened: DataFrame) -> DataFrame:
    rejected = (screened.filter(F.col("load_status") == "rejected") if "load_status" in screened.columns
                else screened.filter(F.col("reject_rule").isNotNull()))
    return _reject(
        rejected, "stop_times", F.col("reject_rule"),
        _payload(trip_id=F.col("trip_id"), stop_sequence=F.col("stop_sequence"), stop_id=F.col("stop_id"),
                 arrival_time=F.col("arrival_time"), departure_time=F.col("departure_time")),
    )


# --------------------------------------------------------------------------- T22
def transfers(stg: DataFrame, platform_df: DataFrame, trip_df: DataFrame):
    pf = platform_df.select(F.col("stop_id").alias("_from"), F.lit(1).alias("_fok"))
    pt = platform_df.select(F.col("stop_id").alias("_to"), F.lit(1).alias("_tok"))
    ft = trip_df.select(F.col("trip_id").alias("_ftrip"), F.col("trip_id").alias("_from_trip"))
    tt = trip_df.select(F.col("trip_id").alias("_ttrip"), F.col("trip_id").alias("_to_trip"))
    s = (
        stg.withColumn("_from", _t("from_stop_id")).withColumn("_to", _t("to_stop_id"))
        .withColumn("_ftrip", blank_to_null("from_trip_id")).withColumn("_ttrip", blank_to_null("to_trip_id"))
        .join(pf, "_from", "left").join(pt, "_to", "left")
    )
    linked = (F.col("_fok") == 1) & (F.col("_tok") == 1)
    wait = blank_to_null("min_transfer_time")
    coded = code_or_default("transfer_type").isNotNull() & (wait.isNull() | wait.try_cast("int").isNotNull())
    good = linked & coded
    core = (
        s.filter(good).join(grown(ft), "_ftrip", "left").join(grown(tt), "_ttrip", "left")
        .select(
            F.col("src_line_no").alias("transfer_id"),
            F.col("_from").alias("from_stop_id"),
            F.col("_to").alias("to_stop_id"),
            code_or_default("transfer_type").alias("transfer_type"),
            blank_to_null("min_transfer_time").try_cast("int").alias("min_transfer_time"),
            F.col("_from_trip").alias("from_trip_id"), F.col("_to_trip").alias("to_trip_id"),
        )
    )
    rej = _reject(
        s.filter(~good | good.isNull()), "transfers",
        F.when(linked, F.lit("DQ-08-BAD-CODE-QL")).otherwise(F.lit("DQ-04-ORPHAN-TRANSFER-QL")),
        _payload(from_stop_id=F.col("from_stop_id"), to_stop_id=F.col("to_stop_id")),
    )
    return core, rej


# --------------------------------------------------------------------------- T23
def translations(stg: DataFrame):
    val, tr = F.coalesce(_t("field_value"), F.lit("")), F.coalesce(_t("translation"), F.lit(""))
    good = (val != "") & (tr != "") & _t("language").isin(*TRANSLATION_LANGUAGES) & _t("table_name").isin(
        *TRANSLATION_TABLES
    )
    good = F.coalesce(good, F.lit(False))
    key = ["table_name", "field_name", "field_value", "language"]
    typed = stg.select("src_line_no", *[_t(c).alias(c) for c in [*key, "translation"]], good.alias("_good"))
    firsts = typed.filter("_good").groupBy(*key).agg(
        F.min(F.struct("src_line_no", "translation")).alias("_first")
    )
    core = firsts.select(*key, F.col("_first.translation").alias("translation"))
    ranked = typed.filter("_good").join(
        firsts.select(*key, F.col("_first.src_line_no").alias("_first_line")), key
    ).withColumn("_rn", F.when(F.col("src_line_no") == F.col("_first_line"), 1).otherwise(2))
    rej = _reject(
        typed.filter(~F.col("_good")), "translations", "DQ-07-TRANSLATION-FILTERED-QL",
        _payload(table_name=F.col("table_name"), language=F.col("language"), field_value=F.col("field_value")),
    ).unionByName(
        _reject(ranked.filter(F.col("_rn") > 1), "translations", "DQ-05-DUPLICATE-TRANSLATION-QL",
                _payload(table_name=F.col("table_name"), language=F.col("language"),
                         field_value=F.col("field_value")))
    )
    return core, rej


# --------------------------------------------------------------------------- all
def _keep(name: str, df: DataFrame) -> DataFrame:
    return df


def rules(members, t, put=_keep, rank_after_screening: bool = False, expand_calendar: bool = False) -> dict:
    """Table -> (its rows, its member's quarantine or None), each as a function that builds the plan.

    ``members`` gives staged members and ``t`` the tables they rest on, in the order of
    this dictionary; both are asked only for what a table needs."""
    def dates():
        return service_dates(members["calendar_dates"], t["service"])

    return {
        "agency": (lambda: agency(members["agency"])[0], lambda: agency(members["agency"])[1]),
        "station": (lambda: stations(members["stops"]), None),
        "platform": (lambda: platforms(members["stops"], t["station"])[0], lambda: platforms(members["stops"], t["station"])[1]),
        "route": (lambda: routes(members["routes"], t["agency"])[0], lambda: routes(members["routes"], t["agency"])[1]),
        "service": (lambda: services(members["calendar"])[0], lambda: services(members["calendar"])[1]),
        "service_date": (
            lambda: expand_weekly_patterns(t["service"], dates()[0]) if expand_calendar else dates()[0], lambda: dates()[1]),
        "trip": (lambda: trips(members["trips"], t["route"], t["service"])[0],
                 lambda: trips(members["trips"], t["route"], t["service"])[1]),
        "stop_time_screened": (
            lambda: with_fact_columns(screen_stop_times(members["stop_times"], t["trip"], t["platform"], rank_after_screening, put)),
            lambda: rejected_stop_times(t["stop_time_screened"])),
        "transfer": (lambda: transfers(members["transfers"], t["platform"], t["trip"])[0],
                     lambda: transfers(members["transfers"], t["platform"], t["trip"])[1]),
        "text_translation": (lambda: translations(members["translations"])[0], lambda: translations(members["translations"])[1]),
        "feed_info": (lambda: feed_info(members["feed_info"]), None),
    }


def quarantine(found: dict) -> DataFrame:
    """The quarantine of all members from their ``rules``."""
    parts = [rejected() for _, rejected in found.values() if rejected]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def clean(members: dict[str, DataFrame], put=_keep, rank_after_screening: bool = False,
          expand_calendar: bool = False) -> Cleaned:
    """Run every rule in dependency order.

    ``put(name, df)`` may write a table and return it read back; later rules
    then join against the written dimension instead of re-running its plan.
    The screened calls (every staged call with its reject rule) are put once
    and split into the fact and its quarantine.
    """
    tables: dict[str, DataFrame] = {}
    found = rules(members, tables, put, rank_after_screening, expand_calendar)
    for name, (rows, _) in found.items():
        tables[name] = put(name, rows())
    tables["stop_time"] = accepted_stop_times(tables["stop_time_screened"])
    return Cleaned(tables, put("rejected_row", quarantine(found)))
