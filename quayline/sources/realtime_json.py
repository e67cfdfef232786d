"""Shred realtime JSON snapshots (trip updates, alerts) into log tables.

Each file is one snapshot document. Fields whose JSON type varies between
producers (``timestamp`` as a number or a ``{low, high, unsigned}`` object,
``url`` as a translated string, a bare string or absent, numbers as text) are
declared ``string``: Spark then keeps their raw JSON text and the total helpers
below decode them without ever raising.

Rules that look at other elements of the same entity (a repeated
``stopSequence``, the first text per language) are evaluated on the entity's
own array with higher-order functions, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.session import grown, settings

TRANSLATED = "struct<translation: array<struct<language: string, text: string>>>"
STOP_TIME_UPDATE = ("struct<stopId: string, stopSequence: string, scheduleRelationship: string, "
                    "arrival: struct<time: string, delay: string>, departure: struct<time: string, delay: string>>")
ENTITY = (
    "struct<id: string, "
    "tripUpdate: struct<trip: struct<tripId: string, routeId: string, startTime: string, startDate: string, "
    "scheduleRelationship: string>, vehicle: struct<id: string>, "
    f"stopTimeUpdate: array<{STOP_TIME_UPDATE}>, timestamp: string>, "
    "alert: struct<cause: string, effect: string, "
    "informedEntity: array<struct<agencyId: string, routeId: string, stopId: string, trip: struct<tripId: string>>>, "
    "activePeriod: array<struct<start: string, `end`: string>>, headerText: string, descriptionText: string, "
    "url: string>>"
)
DOCUMENT = f"struct<header: struct<gtfsRealtimeVersion: string, incrementality: string, timestamp: string>, " \
           f"entity: array<{ENTITY}>>"
MAX_EPOCH = 253402300800  # 10000-01-01T00:00:00Z


# ----------------------------------------------------------------- total helpers
def to_long(x: Column) -> Column:
    """S18 + quirk 9: integer text, or a protobuf Long object -> bigint; else NULL."""
    low = F.get_json_object(x, "$.low").try_cast("long")
    high = F.get_json_object(x, "$.high").try_cast("long")
    as_object = F.when(low.isNotNull() & high.isNotNull(), high * F.lit(4294967296) + F.pmod(low, F.lit(4294967296)))
    return F.coalesce(F.trim(x).try_cast("long"), as_object)


def epoch_to_iso(x: Column) -> Column:
    """Epoch seconds -> 'YYYY-MM-DDTHH:MM:SSZ' (UTC, independent of session time zone)."""
    ok = x.isNotNull() & (x >= 0) & (x < MAX_EPOCH)
    day = F.date_from_unix_date(F.floor(x / 86400).cast("int"))
    sec = F.pmod(x, F.lit(86400))
    hms = F.format_string("%02d:%02d:%02d", (sec / 3600).cast("int"), ((sec % 3600) / 60).cast("int"),
                          (sec % 60).cast("int"))
    return F.when(ok, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), hms, F.lit("Z")))


def gtfs_date_text(x: Column) -> Column:
    """S17: 'YYYYMMDD' -> 'YYYY-MM-DD'; other text passes through; blank -> NULL."""
    t = F.nullif(F.trim(x), F.lit(""))
    return F.when(t.rlike("^[0-9]{8}$"),
                  F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(t)


def first_text(x: Column) -> Column:
    """First translation's text; a bare string is itself; null, {} and [] give NULL."""
    t = F.trim(x)
    is_json = t.startswith("{") | t.startswith("[")
    bare = F.when(t.startswith('"') & t.endswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"))
    return F.coalesce(F.get_json_object(x, "$.translation[0].text"),
                      F.when(~is_json, F.coalesce(bare, F.nullif(t, F.lit("")))))


# ----------------------------------------------------------------- documents
def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per snapshot document: raw text + file metadata.

    By default each file is one document; ``lines=True`` reads JSON Lines (one
    document per line), which splits large files across tasks."""
    return spark.read.option("wholetext", "false" if lines else "true").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("source_url"),
        F.unix_seconds(F.col("_metadata.file_modification_time")).alias("fetched_epoch"),
        F.col("_metadata.file_size").alias("bytes_downloaded"),
    )


def export_documents(docs: DataFrame, path: str) -> None:
    """Write one JSON document per row (column ``doc``) as JSON Lines."""
    with one_document_at_a_time(docs.sparkSession):
        docs.select(F.col("doc").alias("value")).write.mode("overwrite").text(path)


def one_document_at_a_time(spark: SparkSession):
    """Lists are gathered by sorted aggregates: a task holds one document, where a hash aggregate holds up to 128."""
    return settings(spark, {"spark.sql.execution.useObjectHashAggregateExec": "false"})


def parse_documents(docs: DataFrame, feed: str) -> DataFrame:
    """S19 input: parsed snapshot rows with a deterministic ``snapshot_id``."""
    d = docs.select("*", F.from_json("value", DOCUMENT).alias("doc"))
    ts = to_long(F.col("doc.header.timestamp"))
    feed_bit = 1 if feed == "alert" else 0
    return d.select(
        (ts * 2 + feed_bit).alias("snapshot_id"),
        F.lit(feed).alias("feed"),
        F.coalesce(epoch_to_iso(F.col("fetched_epoch")), epoch_to_iso(ts)).alias("fetched_at_utc"),
        ts.alias("feed_timestamp_epoch"),
        epoch_to_iso(ts).alias("feed_timestamp_utc"),
        F.coalesce(F.size("doc.entity"), F.lit(0)).alias("entity_count"),
        "bytes_downloaded", "source_url",
        F.col("doc.entity").alias("entity"),
    )


def register_snapshots(parsed: DataFrame, log: DataFrame | None) -> DataFrame:
    """Refuse NULL header timestamps, keep one row per (feed, ts), skip logged ones."""
    parsed = parsed.filter(F.col("feed_timestamp_epoch").isNotNull())
    if log is not None:
        parsed = parsed.join(log.select("feed", "feed_timestamp_epoch"), ["feed", "feed_timestamp_epoch"], "left_anti")
    # of several documents of one snapshot the first fetched counts, by its source and
    # contents where that is equal: the choice is the same whenever it is made again
    place = F.struct("fetched_at_utc", "source_url", F.xxhash64("entity").alias("contents"))
    first = parsed.groupBy("feed", "feed_timestamp_epoch").agg(F.min(place).alias("_first"))
    chosen = parsed.withColumn("_place", place).join(first, ["feed", "feed_timestamp_epoch"])
    same = chosen.filter(F.col("_place").eqNullSafe(F.col("_first"))).select(*parsed.columns)
    return same.dropDuplicates(["feed", "feed_timestamp_epoch"])  # equal documents


def entity_rows(parsed: DataFrame) -> DataFrame:
    """A row per entity of every parsed document, and one for a document without any.

    A poll of a large network has tens of thousands of entities: written as one row, a reader's
    batch or a writer's buffer of such rows does not fit a task. ``doc_no`` is the document,
    ``contents`` the hash of all its entities; both are fixed once the rows are written."""
    snapshot = [c for c in parsed.columns if c != "entity"]
    numbered = parsed.select(F.monotonically_increasing_id().alias("doc_no"), *snapshot, F.xxhash64("entity").alias("contents"), "entity")
    return numbered.select("doc_no", *snapshot, "contents", F.posexplode_outer("entity").alias("entity_pos", "e"))


def choose_documents(rows: DataFrame, log: DataFrame | None) -> DataFrame:
    """``register_snapshots`` over ``entity_rows``: the chosen documents by ``doc_no``, without their entities."""
    key = ["feed", "feed_timestamp_epoch"]
    docs = rows.filter((F.coalesce("entity_pos", F.lit(0)) == 0) & F.col("feed_timestamp_epoch").isNotNull()).drop("entity_pos", "e")
    if log is not None:
        docs = docs.join(grown(log.select(*key)), key, "left_anti")
    order = ["fetched_at_utc", "source_url", "contents", "doc_no"]
    order += [c for c in docs.columns if c not in (*key, *order)]
    first = docs.groupBy(*key).agg(F.min(F.struct(*order)).alias("r"))
    return first.select("r.doc_no", *[c if c in key else f"r.{c}" for c in SNAPSHOT_COLUMNS])


SNAPSHOT_COLUMNS = ["snapshot_id", "feed", "fetched_at_utc", "feed_timestamp_epoch", "feed_timestamp_utc",
                    "entity_count", "bytes_downloaded", "source_url"]


def _entities(snaps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = snaps if "e" in snaps.columns else snaps.select("snapshot_id", *carry, F.posexplode("entity").alias("entity_pos", "e"))
    return rows.select(
        "snapshot_id", *carry, "entity_pos",
        F.coalesce(F.col("e.id"), F.concat(F.lit("#"), F.col("entity_pos").cast("string"))).alias("rt_entity_id"), "e")


def shred_trip_updates(snaps: DataFrame, carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Entities with a tripUpdate -> trip rows and stop-time-update rows.

    ``carry`` names snapshot columns copied onto every output row (a stream can
    keep its event time this way instead of joining back to itself)."""
    ent = _entities(snaps, carry).filter(F.col("e.tripUpdate").isNotNull())
    trip = ent.select(
        "snapshot_id", "rt_entity_id",
        F.col("e.tripUpdate.trip.tripId").alias("trip_id"),
        F.col("e.tripUpdate.trip.routeId").alias("route_id"),
        F.col("e.tripUpdate.trip.startTime").alias("start_time"),
        gtfs_date_text(F.col("e.tripUpdate.trip.startDate")).alias("start_date"),
        to_long(F.col("e.tripUpdate.trip.scheduleRelationship")).cast("int").alias("schedule_relationship"),
        F.col("e.tripUpdate.vehicle.id").alias("vehicle_id"),
        to_long(F.col("e.tripUpdate.timestamp")).alias("timestamp_epoch"),
    )
    # A missing or repeated stopSequence becomes -(position + 1); "repeated"
    # is decided inside the entity's own array (earlier element, same number).
    seqs = F.transform(F.col("e.tripUpdate.stopTimeUpdate"), lambda u: to_long(u["stopSequence"]))
    fixed = F.transform(
        F.col("e.tripUpdate.stopTimeUpdate"),
        lambda u, i: F.struct(
            u.alias("u"),
            i.alias("pos"),
            F.when(
                to_long(u["stopSequence"]).isNull()
                | F.exists(F.slice(seqs, 1, i), lambda s: s == to_long(u["stopSequence"])),
                -(i + 1),
            ).otherwise(to_long(u["stopSequence"])).cast("int").alias("seq"),
        ),
    )
    stu = ent.select("snapshot_id", *carry, "rt_entity_id", F.explode(fixed).alias("x")).select(
        "snapshot_id", *carry, "rt_entity_id",
        F.col("x.seq").alias("stop_sequence"),
        F.col("x.pos").alias("update_position"),
        F.col("x.u.stopId").alias("stop_id"),
        to_long(F.col("x.u.arrival.time")).alias("arrival_time_epoch"),
        to_long(F.col("x.u.arrival.delay")).cast("int").alias("arrival_delay_s"),
        to_long(F.col("x.u.departure.time")).alias("departure_time_epoch"),
        to_long(F.col("x.u.departure.delay")).cast("int").alias("departure_delay_s"),
        # absent stays NULL: "not said" and "scheduled" are told apart
        to_long(F.col("x.u.scheduleRelationship")).cast("int").alias("schedule_relationship"),
    )
    return {"rt_trip_update": trip, "rt_stop_time_update": stu}


def _texts(ent: DataFrame, field: str, json_col: str) -> DataFrame:
    """One row per language; blank texts and texts without a language are skipped; first occurrence wins."""
    tr = F.from_json(F.col(json_col), TRANSLATED)["translation"]
    keep = F.filter(
        F.transform(tr, lambda x, i: F.struct(x["language"].alias("language"), x["text"].alias("text"), i.alias("i"))),
        lambda x: (F.coalesce(F.trim(x["text"]), F.lit("")) != "") & (F.coalesce(F.trim(x["language"]), F.lit("")) != ""),
    )
    first = F.filter(keep, lambda x: ~F.exists(keep, lambda y: (y["i"] < x["i"])
                                               & y["language"].eqNullSafe(x["language"])))
    return ent.select("snapshot_id", "rt_entity_id", F.explode(first).alias("t")).select(
        "snapshot_id", "rt_entity_id", F.lit(field).alias("field_name"),
        F.col("t.language").alias("language"), F.col("t.text").alias("text"),
    )


def shred_alerts(snaps: DataFrame) -> dict[str, DataFrame]:
    """Alerts, their texts, informed entities and active periods."""
    ent = _entities(snaps).filter(F.col("e.alert").isNotNull())
    alert = ent.select(
        "snapshot_id", "rt_entity_id",
        to_long(F.col("e.alert.cause")).cast("int").alias("cause"),
        to_long(F.col("e.alert.effect")).cast("int").alias("effect"),
        first_text(F.col("e.alert.url")).alias("url"),
    )
    texts = _texts(ent, "header", "e.alert.headerText").unionByName(
        _texts(ent, "description", "e.alert.descriptionText"))
    informed = ent.select("snapshot_id", "rt_entity_id",
                          F.posexplode("e.alert.informedEntity").alias("seq", "x")).select(
        "snapshot_id", "rt_entity_id", F.col("seq").cast("int").alias("seq"),
        F.col("x.agencyId").alias("agency_id"), F.col("x.routeId").alias("route_id"),
        F.col("x.stopId").alias("stop_id"), F.col("x.trip.tripId").alias("trip_id"),
    )
    periods = ent.select("snapshot_id", "rt_entity_id", F.posexplode("e.alert.activePeriod").alias("seq", "x")).select(
        "snapshot_id", "rt_entity_id", F.col("seq").cast("int").alias("seq"),
        to_long(F.col("x.start")).alias("start_epoch"), to_long(F.col("x.end")).alias("end_epoch"),
    )
    return {"rt_alert": alert, "rt_alert_text": texts, "rt_alert_informed_entity": informed,
            "rt_alert_active_period": periods}


def shred_entities(snaps: DataFrame, feed: str) -> dict[str, DataFrame]:
    """The child tables of parsed snapshots, or of their ``entity_rows``."""
    return shred_trip_updates(snaps) if feed == "trip-update" else shred_alerts(snaps)


def shred(snaps: DataFrame, feed: str) -> dict[str, DataFrame]:
    return {"rt_snapshot": snaps.select(*SNAPSHOT_COLUMNS)} | shred_entities(snaps, feed)
