"""Staged schedule members derived from the driver's TPC-H-shaped tables.

The pipeline is generic over staged members (all text + ``src_line_no``). This
module projects the given parquet tables into that shape with deterministic
expressions, so every downstream job grows with the input tables:

* agency          <- region        one agency per region
* stops (type 1)  <- nation        one station per nation
* stops (type 0)  <- supplier      one platform per supplier, parent = its nation;
                                   every 10th supplier points at a missing parent
* routes          <- part          one route per brand (``GROUP BY p_brand``)
* calendar        <- events        one service per (user_id, event_type)
* calendar_dates  <- events        one staged line per event (duplicates on purpose)
* trips           <- orders        service = (o_custkey div 10, priority digit)
* stop_times      <- lineitem      trip = order, sequence = line number, stop = supplier
* transfers       <- supplier      platform -> platform with the next key
* translations    <- nation x language
* feed_info       <- events        one row, first/last event date
* realtime        <- events        30-minute snapshots (see ``realtime_from_events``)

``src_line_no`` imitates a file's record number; first-wins rules need only a
total order inside each key, so it is derived per key, never by a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.functions import clock_text
from quayline.schemas import MEMBER_COLUMNS
from quayline.session import grown

# Priority digit of o_orderpriority -> event type of the service it runs on.
PRIORITY_EVENT_TYPE = [("1", "click"), ("2", "view"), ("3", "purchase"), ("4", "error"), ("5", "signup")]
EVENT_TYPE_ORDINAL = {"click": 1, "view": 2, "purchase": 3, "error": 4, "signup": 5}
ROUTE_SHORT_NAMES = ["", "IC", "L", "S"]  # by brand number % 4; '' = unnamed
LANGUAGES_STAGED = ["nl", "de", "en", "fr", "xx"]  # 'xx' is outside the whitelist


_READS: dict[tuple[str, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One DataFrame per input table and session (listing and footer read once)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _READS:
        _READS[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _READS[key]


def _text(c) -> F.Column:
    return c.cast("string")


def _member(df: DataFrame, member: str) -> DataFrame:
    """Project to the member's declared columns (absent ones NULL) + src_line_no."""
    cols = [
        (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
        for c in MEMBER_COLUMNS[member]
    ]
    return df.select(*cols, F.col("src_line_no").cast("long"))


def _service_id(user_col, type_col) -> F.Column:
    return F.concat(F.lit("U"), _text(user_col), F.lit("-"), type_col)


def _date_text(ts_col) -> F.Column:
    return F.date_format(ts_col, "yyyyMMdd")


def staged_agency(spark, sf_dir):
    r = read_table(spark, sf_dir, "region")
    return _member(
        r.select(
            F.concat(F.lit("AG"), _text(F.col("r_regionkey"))).alias("agency_id"),
            F.col("r_name").alias("agency_name"),
            F.lit("Europe/Brussels").alias("agency_timezone"),
            F.lit("fr").alias("agency_lang"),
            (F.col("r_regionkey") + 2).alias("src_line_no"),
        ),
        "agency",
    )


def staged_stops(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("n_nationkey")
    stations = n.select(
        F.concat(F.lit("S"), _text(k)).alias("stop_id"),
        F.col("n_name").alias("stop_name"),
        F.lit("1").alias("location_type"),
        F.lit("").alias("parent_station"),
        F.lit("").alias("platform_code"),
        F.when(k % 4 == 0, F.lit("")).otherwise(_text(k % 3)).alias("wheelchair_boarding"),
        F.concat(F.lit("50."), F.lpad(_text(k), 2, "0")).alias("stop_lat"),
        F.concat(F.lit("4."), F.lpad(_text(k), 2, "0")).alias("stop_lon"),
        (k + 2).alias("src_line_no"),
    )
    sk = F.col("s_suppkey")
    platforms = s.select(
        F.concat(F.lit("P"), _text(sk)).alias("stop_id"),
        F.col("s_name").alias("stop_name"),
        # every 13th supplier is an entrance: not a platform, quarantined as such
        F.when(sk % 13 == 12, F.lit("2")).otherwise(F.lit("0")).alias("location_type"),
        F.concat(F.when(sk % 10 == 9, F.lit("X")).otherwise(F.lit("S")), _text(F.col("s_nationkey"))).alias(
            "parent_station"
        ),
        F.when(sk % 7 == 0, F.lit("")).otherwise(_text(sk)).alias("platform_code"),
        F.lit("").alias("wheelchair_boarding"),
        (sk + 1000).alias("src_line_no"),
    )
    return _member(stations, "stops").unionByName(_member(platforms, "stops"))


def staged_routes(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    brands = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    num = F.regexp_extract(F.col("p_brand"), r"(\d+)$", 1).try_cast("int")
    short = F.element_at(F.array(*[F.lit(x) for x in ROUTE_SHORT_NAMES]), (num % 4 + 1).cast("int"))
    return _member(
        brands.select(
            F.col("p_brand").alias("route_id"),
            F.concat(F.lit("AG"), _text(num % 5)).alias("agency_id"),
            short.alias("route_short_name"),
            F.concat(F.lit("Line "), _text(num)).alias("route_long_name"),
            F.when(num % 10 == 5, F.lit("3")).otherwise(F.lit("2")).alias("route_type"),
            (num + 1).alias("src_line_no"),
        ),
        "routes",
    )


def _event_type_ordinal(col):
    expr = None
    for name, o in EVENT_TYPE_ORDINAL.items():
        expr = (F.when(col == name, F.lit(o)) if expr is None else expr.when(col == name, F.lit(o)))
    return expr.otherwise(F.lit(9))


def staged_calendar(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    svc = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    u = F.col("user_id")
    flags = {
        day: F.when(u % 3 == 0, _text(F.shiftright(u, i) % 2)).otherwise(F.lit("0")) for i, day in enumerate(
            ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
        )
    }
    pad = F.when(u % 5 == 0, F.lit(" ")).otherwise(F.lit(""))
    start = F.when(u % 37 == 36, F.lit("")).otherwise(F.concat(pad, _date_text(F.col("first_ts"))))
    return _member(
        svc.select(
            _service_id(u, F.col("event_type")).alias("service_id"),
            *[c.alias(d) for d, c in flags.items()],
            start.alias("start_date"),
            _date_text(F.col("last_ts")).alias("end_date"),
            (u * 10 + _event_type_ordinal(F.col("event_type"))).alias("src_line_no"),
        ),
        "calendar",
    )


def staged_calendar_dates(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return _member(
        e.select(
            _service_id(F.col("user_id"), F.col("event_type")).alias("service_id"),
            _date_text(F.col("ts")).alias("date"),
            F.when(F.col("event_id") % 41 == 40, F.lit("2")).otherwise(F.lit("1")).alias("exception_type"),
            (F.col("event_id") + 2).alias("src_line_no"),
        ),
        "calendar_dates",
    )


def staged_trips(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ok = F.col("o_orderkey")
    digit = F.substring(F.col("o_orderpriority"), 1, 1)
    etype = None
    for d, t in PRIORITY_EVENT_TYPE:
        etype = F.when(digit == d, F.lit(t)) if etype is None else etype.when(digit == d, F.lit(t))
    etype = etype.otherwise(F.lit("unknown"))
    # nation is a fixed 25-row dimension: broadcast is bounded.
    joined = o.join(F.broadcast(n), (F.col("o_custkey") % 25) == F.col("n_nationkey"), "left")
    return _member(
        joined.select(
            F.concat(F.lit("T"), _text(ok)).alias("trip_id"),
            F.concat(F.lit("Brand#"), _text(ok % 26)).alias("route_id"),
            _service_id((F.col("o_custkey") / 10).cast("long"), etype).alias("service_id"),
            F.when(ok % 19 == 0, F.lit("")).otherwise(F.col("n_name")).alias("trip_headsign"),
            _text(ok).alias("trip_short_name"),
            _text(ok % 2).alias("direction_id"),
            # brands 7, 14 and 21 promise nothing: bikes refused, wheelchair unknown
            F.when(ok % 26 % 7 == 0, F.lit("2")).when(ok % 7 == 0, F.lit("")).otherwise(_text(ok % 3))
            .alias("bikes_allowed"),
            F.when((ok % 26 % 7 == 0) | (ok % 11 == 0), F.lit("")).otherwise(_text((ok / 3).cast("long") % 3))
            .alias("wheelchair_accessible"),
            (ok + 2).alias("src_line_no"),
        ),
        "trips",
    )


def lineitem_clock_key():
    """Deterministic pseudo-clock key of a lineitem row."""
    return F.col("l_partkey") * 7919 + F.col("l_linenumber") * 10139 + F.col("l_orderkey") * 613


def lineitem_clock_secs(k):
    """~1 % of calls at >= 48 h, ~9 % after midnight (24-48 h), the rest in the day."""
    return (
        F.when(k % 97 == 0, F.lit(172800) + k % 86400)
        .when(k % 11 == 0, F.lit(86400) + (k / 11).cast("long") % 86400)
        .otherwise((k / 7).cast("long") % 86400)
    )


LINEITEM_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def staged_stop_times(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    k = lineitem_clock_key()
    secs = lineitem_clock_secs(k)
    no_time = k % 89 == 0
    arr = F.greatest(secs - (k % 3) * 60, F.lit(0))
    line_in_order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINEITEM_ORDER))
    return _member(
        li.select(
            F.concat(F.lit("T"), _text(F.col("l_orderkey"))).alias("trip_id"),
            F.when(no_time, F.lit("")).otherwise(clock_text(arr)).alias("arrival_time"),
            F.when(no_time, F.lit("")).otherwise(clock_text(secs)).alias("departure_time"),
            F.concat(F.when(k % 13 == 0, F.lit(" P")).otherwise(F.lit("P")), _text(F.col("l_suppkey"))).alias(
                "stop_id"
            ),
            F.when(k % 101 == 0, F.concat(F.lit("x"), _text(F.col("l_linenumber"))))
            .otherwise(_text(F.col("l_linenumber")))
            .alias("stop_sequence"),
            F.when(F.col("l_returnflag") == "R", F.lit("1")).otherwise(F.lit("0")).alias("pickup_type"),
            F.when(F.col("l_linestatus") == "F", F.lit("1")).otherwise(F.lit("0")).alias("drop_off_type"),
            (F.col("l_orderkey") * 100 + line_in_order).alias("src_line_no"),
        ),
        "stop_times",
    )


def staged_translations(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    langs = F.explode(F.array(*[F.struct(F.lit(i).alias("lang_no"), F.lit(x).alias("language"))
                                for i, x in enumerate(LANGUAGES_STAGED)]))
    rows = n.select("n_nationkey", "n_name", langs.alias("l")).select(
        F.lit("stops").alias("table_name"),
        F.lit("stop_name").alias("field_name"),
        F.col("l.language").alias("language"),
        F.when((k % 6 == 5) & (F.col("l.language") == "de"), F.lit(""))
        .otherwise(F.concat(F.upper(F.col("l.language")), F.lit(" "), F.col("n_name")))
        .alias("translation"),
        F.col("n_name").alias("field_value"),
        (k * 10 + F.col("l.lang_no") + 2).alias("src_line_no"),
    )
    return _member(rows, "translations")


def staged_feed_info(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return _member(
        e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
            F.lit("quayline-driver").alias("feed_id"),
            F.lit("driver tables").alias("feed_publisher_name"),
            F.lit("fr").alias("feed_lang"),
            F.concat(F.lit(" "), _date_text(F.col("a"))).alias("feed_start_date"),
            _date_text(F.col("b")).alias("feed_end_date"),
            F.lit("1").alias("feed_version"),
            F.lit(2).alias("src_line_no"),
        ),
        "feed_info",
    )


def staged_transfers(spark, sf_dir):
    """Each platform to the platform with the next key: one row per supplier, no
    grouping at all. Every 11th is a self-transfer, every 6th is trip-scoped, every
    17th (and the last key) points at a platform that does not exist."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    sk = F.col("s_suppkey")
    to_key = F.when(sk % 11 == 0, sk).when(sk % 17 == 0, sk + 1000000).otherwise(sk + 1)
    ttype = sk % 4
    return _member(
        s.select(
            F.concat(F.lit("P"), _text(sk)).alias("from_stop_id"),
            F.concat(F.lit("P"), _text(to_key)).alias("to_stop_id"),
            _text(ttype).alias("transfer_type"),
            F.when(ttype == 2, _text((sk % 5 + 1) * 60)).otherwise(F.lit("")).alias("min_transfer_time"),
            F.when(sk % 6 == 0, F.concat(F.lit("T"), _text(sk))).otherwise(F.lit("")).alias("from_trip_id"),
            F.lit("").alias("to_trip_id"),
            (sk + 2).alias("src_line_no"),
        ),
        "transfers",
    )


def staged_members(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "agency": staged_agency(spark, sf_dir),
        "feed_info": staged_feed_info(spark, sf_dir),
        "stops": staged_stops(spark, sf_dir),
        "routes": staged_routes(spark, sf_dir),
        "calendar": staged_calendar(spark, sf_dir),
        "calendar_dates": staged_calendar_dates(spark, sf_dir),
        "trips": staged_trips(spark, sf_dir),
        "stop_times": staged_stop_times(spark, sf_dir),
        "transfers": staged_transfers(spark, sf_dir),
        "translations": staged_translations(spark, sf_dir),
    }


# ---------------------------------------------------------------------------
# Realtime snapshot log derived from events
# ---------------------------------------------------------------------------
# Each event is one stop-time observation. Snapshots are 30-minute buckets:
# trip-update snapshot id = 2*bucket, alert snapshot id = 2*bucket + 1.
# Stop-level status by event type: error -> 1 SKIPPED, signup -> 2 NO_DATA.

def _bucket(ts):
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 48 + F.hour(ts) * 2 + (F.minute(ts) / 30).cast("int")


def _bucket_text(ts):
    mins = (F.minute(ts) / 30).cast("int") * 30
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.lpad(_text(F.hour(ts)), 2, "0"), F.lit(":"),
        F.lpad(_text(mins), 2, "0"), F.lit(":00Z"),
    )


def realtime_from_events(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    k = F.get_json_object(F.col("props"), "$.k").try_cast("long")
    rel = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0)
    delay = F.when(rel == 2, F.lit(None)).otherwise(F.floor(F.col("value") * 10).cast("int") - 300)
    obs = e.select(
        (_bucket(F.col("ts")) * 2).alias("snapshot_id"),
        (_bucket(F.col("ts")) * 1800).alias("feed_timestamp_epoch"),
        _bucket_text(F.col("ts")).alias("fetched_at_utc"),
        _text(eid).alias("rt_entity_id"),
        F.concat(F.lit("T"), _text(k)).alias("trip_id"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("start_date"),
        (eid % 7 + 1).cast("int").alias("stop_sequence"),
        F.concat(F.lit("P"), _text(F.col("user_id") % 100)).alias("stop_id"),
        rel.cast("int").alias("schedule_relationship"),
        delay.cast("int").alias("departure_delay_s"),
        delay.cast("int").alias("arrival_delay_s"),
        F.col("event_type"),
        eid,
    )
    trip_snapshots = obs.groupBy("snapshot_id", "feed_timestamp_epoch", "fetched_at_utc").agg(
        F.count(F.lit(1)).alias("entity_count")
    ).select(
        "snapshot_id", F.lit("trip-update").alias("feed"), "fetched_at_utc", "feed_timestamp_epoch",
        F.col("fetched_at_utc").alias("feed_timestamp_utc"), "entity_count",
    )
    alerts_src = obs.filter(F.col("event_type") == "error")
    alert_rows = alerts_src.select(
        (F.col("snapshot_id") + 1).alias("snapshot_id"), "feed_timestamp_epoch", "fetched_at_utc", "rt_entity_id",
        (eid % 12 + 1).cast("int").alias("cause"),
        ((eid / 12).cast("long") % 11 + 1).cast("int").alias("effect"),
        F.col("trip_id"), eid,
    )
    alert_snapshots = alert_rows.groupBy("snapshot_id", "feed_timestamp_epoch", "fetched_at_utc").agg(
        F.count(F.lit(1)).alias("entity_count")
    ).select(
        "snapshot_id", F.lit("alert").alias("feed"), "fetched_at_utc", "feed_timestamp_epoch",
        F.col("fetched_at_utc").alias("feed_timestamp_utc"), "entity_count",
    )
    texts = alert_rows.select(
        "snapshot_id", "rt_entity_id",
        F.explode(F.array(
            F.struct(F.lit("header").alias("field_name"), F.lit("fr").alias("language"),
                     F.concat(F.lit("Perturbation sur "), F.col("trip_id")).alias("text")),
            F.struct(F.lit("header").alias("field_name"), F.lit("nl").alias("language"),
                     F.concat(F.lit("Storing op "), F.col("trip_id")).alias("text")),
            F.struct(F.lit("description").alias("field_name"), F.lit("fr").alias("language"),
                     F.concat(F.lit("Cause "), _text(F.col("cause"))).alias("text")),
        )).alias("t"),
    ).select("snapshot_id", "rt_entity_id", "t.field_name", "t.language", "t.text")
    return {
        "rt_snapshot": trip_snapshots.unionByName(alert_snapshots),
        # one entity per event, so (snapshot_id, rt_entity_id) is already unique
        "rt_trip_update": obs.select(
            "snapshot_id", "rt_entity_id", "trip_id", "start_date",
            # every 23rd trip is cancelled, every 29th carries a code that no list has
            F.when(eid % 29 == 28, 4).when(eid % 23 == 22, 3).otherwise(0).cast("int").alias("schedule_relationship")),
        "rt_stop_time_update": obs.select(
            "snapshot_id", "rt_entity_id", "stop_sequence", "stop_id", "departure_delay_s", "arrival_delay_s",
            "schedule_relationship",
        ),
        "rt_alert": alert_rows.select("snapshot_id", "rt_entity_id", "cause", "effect"),
        "rt_alert_text": texts,
        "rt_alert_informed_entity": _alert_parts(alert_rows, [
            (F.col("event_id") % 7 != 0, F.struct(F.concat(F.lit("P"), _text(F.col("event_id") % 10)).alias("stop_id"),
                                                  F.lit(None).cast("string").alias("trip_id"))),
            ((F.col("event_id") % 7 != 0) & (F.col("event_id") % 2 == 0), F.struct(
                F.lit(None).cast("string").alias("stop_id"), F.col("trip_id").alias("trip_id"))),
        ]),
        "rt_alert_active_period": _alert_parts(alert_rows, [
            (F.col("event_id") % 5 != 0, F.struct(F.col("feed_timestamp_epoch").alias("start_epoch"),
                                                  (F.col("feed_timestamp_epoch") + 3600).alias("end_epoch"))),
            ((F.col("event_id") % 5 != 0) & (F.col("event_id") % 3 == 0), F.struct(
                F.col("feed_timestamp_epoch").alias("start_epoch"), F.lit(None).cast("long").alias("end_epoch"))),
        ]),
    }


def _alert_parts(alerts: DataFrame, parts: list) -> DataFrame:
    """Child rows of alerts: (condition, fields) in order; the place among an alert's own rows is ``seq``."""
    rows = F.filter(F.array(*[F.when(cond, fields) for cond, fields in parts]), lambda x: x.isNotNull())
    out = alerts.select("snapshot_id", "rt_entity_id", F.posexplode(rows).alias("seq", "x"))
    return out.select("snapshot_id", "rt_entity_id", F.col("seq").cast("int").alias("seq"), "x.*")


# ---------------------------------------------------------------------------
# Realtime documents derived from events (for the shredder on volume)
# ---------------------------------------------------------------------------
def snapshot_documents(tu: DataFrame, stu: DataFrame, keep_id: bool = False) -> DataFrame:
    """One document per snapshot of the log with all its entities, as JSON text in column ``doc``.

    A document holds one poll of the feed, so what is gathered is as large as one poll:
    the text of its entities (``realtime_json.export_documents`` gathers one after the other)."""
    j = stu.join(grown(tu.select("snapshot_id", "rt_entity_id", "trip_id", "start_date")), ["snapshot_id", "rt_entity_id"])
    delay = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("delay")))
    update = F.struct(F.col("stop_id").alias("stopId"), F.col("stop_sequence").alias("stopSequence"),
                      F.col("schedule_relationship").alias("scheduleRelationship"),
                      delay("arrival_delay_s").alias("arrival"), delay("departure_delay_s").alias("departure"))
    trip = F.struct(F.col("trip_id").alias("tripId"), F.regexp_replace("start_date", "-", "").alias("startDate"))
    entity = F.struct(F.col("rt_entity_id").alias("id"),
                      F.struct(trip.alias("trip"), F.array(update).alias("stopTimeUpdate")).alias("tripUpdate"))
    # the log's ids are half-hours; a document carries the half-hour's beginning
    header = F.to_json(F.struct((F.col("snapshot_id") * 900).alias("timestamp")))
    docs = j.groupBy("snapshot_id").agg(F.concat_ws(",", F.collect_list(F.to_json(entity))).alias("entities")).select(
        "snapshot_id", F.concat(F.lit('{"header":'), header, F.lit(',"entity":['), "entities", F.lit("]}")).alias("doc"))
    return docs if keep_id else docs.select("doc")


def alert_documents(alert: DataFrame) -> DataFrame:
    """One alert document per alert of the log, as JSON text in column ``doc``.

    Quirks on purpose: a language said twice, a text without a language, a blank text,
    the URL as an object, as bare text or absent, no informed entity, no active
    period, a period without an end."""
    eid, text = F.col("rt_entity_id").try_cast("long"), F.col("rt_entity_id")
    some = lambda cond, s: F.when(cond, s).otherwise(F.lit(""))
    header = F.concat(
        F.lit('"headerText":{"translation":[{"language":"fr","text":"Perturbation '), text, F.lit('"},{"language":"nl","text":"Storing '),
        text, F.lit('"}'), some(eid % 3 == 0, F.lit(',{"language":"fr","text":"autre"}')),
        some(eid % 4 == 0, F.lit(',{"text":"no language"}')), some(eid % 5 == 0, F.lit(',{"language":"en","text":" "}')), F.lit("]}"))
    about = some(eid % 2 == 0, F.concat(F.lit(',"descriptionText":{"translation":[{"language":"fr","text":"Cause '),
                                        _text(F.col("cause")), F.lit('"}]}')))
    url = F.when(eid % 3 == 0, F.lit(',"url":{"translation":[{"language":"fr","text":"http://u.example"}]}')).when(
        eid % 3 == 1, F.lit(',"url":"http://bare.example"')).otherwise(F.lit(""))
    informed = some(eid % 7 != 0, F.concat(
        F.lit(',"informedEntity":[{"stopId":"P'), _text(eid % 10), F.lit('"}'),
        some(eid % 2 == 0, F.concat(F.lit(',{"trip":{"tripId":"T'), text, F.lit('"}}'))), F.lit("]")))
    start = _text(F.lit(DOC_EPOCH) + eid)
    periods = some(eid % 5 != 0, F.concat(
        F.lit(',"activePeriod":[{"start":'), start, F.lit(',"end":'), _text(F.lit(DOC_EPOCH + 3600) + eid), F.lit("}"),
        some(eid % 3 == 0, F.concat(F.lit(',{"start":'), start, F.lit("}"))), F.lit("]")))
    return alert.select(F.concat(
        F.lit('{"header":{"timestamp":'), start, F.lit('},"entity":[{"id":"'), text, F.lit('","alert":{"cause":'), _text(F.col("cause")),
        F.lit(',"effect":'), _text(F.col("effect")), F.lit(","), header, about, url, informed, periods, F.lit("}}]}")).alias("doc"))


DOC_EPOCH = 1700000000  # header timestamp = DOC_EPOCH + event_id: one snapshot per event


def trip_update_documents(tu: DataFrame, stu: DataFrame) -> DataFrame:
    """One trip-update document per realtime entity of the log derived from events,
    as JSON text in column ``doc``.

    Quirks on purpose: the entity timestamp is a protobuf Long object on even
    ids and a plain number on odd ids; every 7th update has no stopSequence;
    every 5th entity repeats its sequence in a second update; no-data updates
    carry no departure."""
    j = stu.join(tu.select("snapshot_id", "rt_entity_id", "trip_id", "start_date"), ["snapshot_id", "rt_entity_id"])
    eid = F.col("rt_entity_id").try_cast("long")
    ts = F.lit(DOC_EPOCH) + eid
    rel = F.col("schedule_relationship")
    seq_part = F.when(eid % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',"stopSequence":'), _text(F.col("stop_sequence"))))
    dep_part = F.when(F.col("departure_delay_s").isNull(), F.lit("")).otherwise(
        F.concat(F.lit(',"departure":{"delay":'), _text(F.col("departure_delay_s")), F.lit("}")))
    first = F.concat(F.lit('{"stopId":"'), F.col("stop_id"), F.lit('"'), seq_part, dep_part,
                     F.lit(',"scheduleRelationship":'), _text(rel), F.lit("}"))
    second = F.when(eid % 5 == 0, F.concat(F.lit(',{"stopId":"P0"'), seq_part,
                                           F.lit(',"departure":{"delay":0},"scheduleRelationship":0}')))
    long_obj = F.concat(F.lit('{"low":'), _text(ts % 4294967296), F.lit(',"high":'),
                        _text((ts / 4294967296).cast("long")), F.lit(',"unsigned":true}'))
    stamp = F.when(eid % 2 == 0, long_obj).otherwise(_text(ts))
    doc = F.concat(
        F.lit('{"header":{"gtfsRealtimeVersion":"2.0","timestamp":'), _text(ts), F.lit('},"entity":[{"id":"'),
        F.col("rt_entity_id"), F.lit('","tripUpdate":{"trip":{"tripId":"'), F.coalesce(F.col("trip_id"), F.lit("")),
        F.lit('","startDate":"'), F.regexp_replace(F.col("start_date"), "-", ""), F.lit('"},"timestamp":'), stamp,
        F.lit(',"stopTimeUpdate":['), first, F.coalesce(second, F.lit("")), F.lit("]}}]}"),
    )
    return j.select(doc.alias("doc"))
