"""Realtime snapshots with Structured Streaming.

* R01 a directory of snapshot files is a file-source stream; ``availableNow``
  processes what has arrived and stops (the cron poll of the reference);
* R02 idempotent on (feed, header timestamp): inside ``foreachBatch`` the batch is
  anti-joined with the snapshot log, of several documents of a snapshot one is
  chosen and written down, its child rows are appended under a batch id of their
  own, and the log rows, which name that batch, are appended *last*. Readers take
  only rows whose (snapshot, batch) the log names: a batch that failed half-way is
  never read, its retry writes a new one, and a replayed file is skipped. Late
  snapshots are history and are kept (no ``dropDuplicatesWithinWatermark``: the log
  itself is the dedupe state);
* R03 latest observation per call: ``views.rt_departure_performance`` over the log, or
  kept up to date by the stream itself (``streaming.latest``);
* R04, S20 soft link to the timetable and rows written: trip updates are left-joined to
  the trip keys, and what is observed while the child tables are written goes to a
  ledger, one row per table and batch (drift is measured, not enforced);
* R05 delay history: tumbling 30-minute event-time windows with a watermark
  (``streaming.lateness`` keeps and counts what the watermark shuts out).

Child tables are partitioned by day and batch. ``compact`` rewrites what past days
hold as one batch and appends log rows of a higher version that name it, so the
change takes effect in one commit, whenever a snapshot arrived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayline.session import grown
from quayline.sources import realtime_json as rj
from quayline.storage import delete, exists

CHILDREN = {
    "trip-update": ["rt_trip_update", "rt_stop_time_update"],
    "alert": ["rt_alert", "rt_alert_text", "rt_alert_informed_entity", "rt_alert_active_period"],
}


LOG_SCHEMA = ("snapshot_id long, fetched_at_utc string, feed_timestamp_epoch long, feed_timestamp_utc string, "
              "entity_count int, bytes_downloaded long, source_url string, batch string, version int, feed string")


def read_log(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per snapshot: its row of the highest version, which names the batch that holds it."""
    path = f"{root}/rt_snapshot"
    if not exists(spark, path):
        return None
    # an empty first batch leaves a folder without files: the schema is ours, not inferred
    rows = spark.read.schema(LOG_SCHEMA).parquet(path)
    names = [c for c in rows.columns if c not in ("feed", "snapshot_id")]
    last = rows.groupBy("feed", "snapshot_id").agg(F.max(F.struct("version", *names[:-1])).alias("r"))
    return last.select("snapshot_id", *[F.col(f"r.{c}").alias(c) for c in names], "feed")


def _day(snapshot_id: str):
    return F.date_from_unix_date(F.floor(F.col(snapshot_id) / 2 / 86400).cast("int"))


def _append(df: DataFrame, batch: str, path: str) -> None:
    df.withColumns({"day": _day("snapshot_id"), "batch": F.lit(batch)}).write.mode("append").partitionBy(
        "day", "batch").parquet(path)


def _commit(log: DataFrame, batch: str, version: int, root: str) -> None:
    log.withColumns({"batch": F.lit(batch), "version": F.lit(version)}).write.mode("append").partitionBy(
        "feed").parquet(f"{root}/rt_snapshot")


LEDGER_SCHEMA = ("feed string, table_name string, documents long, refused long, already_held long, rows_written long, "
                 "rows_matched long")


DOCUMENTS_AT_ONCE = 1 << 18  # their numbers take about 12 MB as a broadcast relation


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_snapshots(docs: DataFrame, feed: str, root: str, trips: DataFrame | None = None) -> dict:
    """Register and shred one batch of snapshot documents into the log under ``root``.

    The ledger gets a row per child table: documents in the batch, those refused for
    want of a header timestamp, those the log held already (or the batch held twice),
    rows written and, for trip updates, rows whose trip the timetable knows (R04; the
    others are kept: drift is measured, not enforced). Counts are observed while the
    rows are written. A batch without a new snapshot writes nothing, so a replay
    leaves log and ledger as they are.

    Documents are taken apart as they are parsed: what is written, chosen and shredded
    are rows of one entity, and the choice among documents sees a row for each.
    """
    spark = docs.sparkSession
    batch = uuid.uuid4().hex
    seen = Observation(f"documents_{batch}")
    parsed = rj.parse_documents(docs, feed).observe(
        seen, F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("feed_timestamp_epoch").isNull(), 1)).alias("refused"))
    rows = _staged(rj.entity_rows(parsed), f"{root}/_parsed/{batch}")  # parsed once, read for the choice and for what is chosen
    fresh = _staged(rj.choose_documents(rows, read_log(spark, root)), f"{root}/_chosen/{batch}")
    new = fresh.count()
    metrics, ledger = {}, []
    if new:
        known = fresh.select("doc_no")
        known = F.broadcast(known) if new <= DOCUMENTS_AT_ONCE else grown(known)
        # chosen once, read by every child table
        chosen = _staged(rows.join(known, "doc_no", "left_semi"), f"{root}/_incoming/{batch}")
        delete(spark, f"{root}/_parsed/{batch}")
        said = seen.get
        counts = [said["documents"], said["refused"], said["documents"] - said["refused"] - new]
        tables = rj.shred_entities(chosen, feed)
        for name in CHILDREN[feed]:
            df, matched = tables[name], None
            obs = Observation(f"{name}_{batch}")
            known = F.lit(None).cast("int")
            if name == "rt_trip_update" and trips is not None:
                df = df.join(grown(trips.select("trip_id", F.lit(1).alias("_known"))), "trip_id", "left")
                known = F.col("_known")
            df = df.observe(obs, F.count(F.lit(1)).alias("rows"), F.count(known).alias("matched")).drop("_known")
            _append(df, batch, f"{root}/{name}")
            if name == "rt_trip_update" and trips is not None:
                matched = obs.get["matched"]
                metrics = {"trip_updates": obs.get["rows"], "matched": matched}
            ledger.append((feed, name, *counts, obs.get["rows"], matched))
        spark.createDataFrame(ledger, LEDGER_SCHEMA).withColumn("batch", F.lit(batch)).coalesce(1).write.mode(
            "append").parquet(f"{root}/_ledger")
        _commit(fresh.select(*rj.SNAPSHOT_COLUMNS), batch, 0, root)
    for folder in ("_parsed", "_chosen", "_incoming"):  # read by this batch only
        delete(spark, f"{root}/{folder}/{batch}")
    return metrics


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The ledger rows of the batches that were committed (a failed batch has rows, but no log names it)."""
    schema = f"{LEDGER_SCHEMA}, batch string"
    if not exists(spark, f"{root}/_ledger"):
        return spark.createDataFrame([], schema)
    committed = spark.read.schema(LOG_SCHEMA).parquet(f"{root}/rt_snapshot").filter("version = 0").select("batch").distinct()
    return spark.read.schema(schema).parquet(f"{root}/_ledger").join(committed, "batch", "left_semi")


def snapshot_stream(spark: SparkSession, source_dir: str, lines: bool = False) -> DataFrame:
    """Each new file under ``source_dir`` is one snapshot document, or holds one per line."""
    return (
        spark.readStream.format("text").option("wholetext", "false" if lines else "true")
        .option("recursiveFileLookup", "true").load(source_dir)
        .select("value", F.col("_metadata.file_path").alias("source_url"),
                F.unix_seconds(F.col("_metadata.file_modification_time")).alias("fetched_epoch"),
                F.col("_metadata.file_size").alias("bytes_downloaded"))
    )


def run_ingest(spark: SparkSession, source_dir: str, feed: str, root: str, checkpoint: str,
               trips: DataFrame | None = None, lines: bool = False):
    """Process every file that has arrived (``availableNow``) and stop; returns the finished query."""
    def batch(df: DataFrame, batch_id: int) -> None:
        append_snapshots(df, feed, root, trips)

    q = (snapshot_stream(spark, source_dir, lines).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _child_schema(spark: SparkSession, name: str) -> StructType:
    """A child table's columns as the shredder makes them; a folder without rows has none to infer."""
    feed = next(f for f, names in CHILDREN.items() if name in names)
    none = spark.createDataFrame([], "value string, source_url string, fetched_epoch long, bytes_downloaded long")
    made = rj.shred(rj.parse_documents(none, feed), feed)[name].schema
    return StructType(made.fields).add("day", "date").add("batch", "string")


def _held(spark: SparkSession, root: str, name: str, log: DataFrame) -> DataFrame:
    """The rows of a child table that the log names."""
    rows = spark.read.schema(_child_schema(spark, name)).parquet(f"{root}/{name}")
    return rows.join(log.select("snapshot_id", "batch"), ["snapshot_id", "batch"], "left_semi")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The log tables written so far (missing ones are skipped); every snapshot is read once."""
    log = read_log(spark, root)
    if log is None:
        return {}
    out = {"rt_snapshot": log.drop("batch", "version")}
    for name in [*CHILDREN["trip-update"], *CHILDREN["alert"]]:
        if exists(spark, f"{root}/{name}"):
            out[name] = _held(spark, root, name, log).drop("day", "batch")
    return out


def compact(spark: SparkSession, root: str, through_day: str) -> int:
    """Rewrite the snapshots up to and including ``through_day`` (UTC) that no compaction holds as one batch.

    The log rows that name the new batch are appended last, in one commit: a failed
    run is never read and a repeated one finds nothing to do. A late snapshot joins
    its day with the next compaction. Folders of batches that the log no longer
    names can be dropped by retention. Returns how many snapshots were rewritten."""
    log = read_log(spark, root)
    if log is None:
        return 0
    batch = uuid.uuid4().hex
    todo = log.filter((F.col("version") == 0) & (_day("snapshot_id") <= F.lit(through_day).cast("date")))
    todo.write.parquet(f"{root}/_compacting/{batch}")  # the list is fixed before anything is rewritten
    todo = spark.read.schema(todo.schema).parquet(f"{root}/_compacting/{batch}")
    n = todo.count()
    if n:
        for name in read_tables(spark, root):
            if name != "rt_snapshot":
                # range by snapshot: AQE sizes the files; a busy day spreads over several tasks
                rows = _held(spark, root, name, todo).drop("day", "batch").repartitionByRange("snapshot_id")
                _append(rows, batch, f"{root}/{name}")
        _commit(todo.drop("batch", "version"), batch, 1, root)
    delete(spark, f"{root}/_compacting/{batch}")
    return n


# ----------------------------------------------------------------- R05 delay history
def on_time_by_window(obs: DataFrame, ts_col: str = "feed_ts", width: str = "30 minutes") -> DataFrame:
    """Tumbling event-time windows: observations, scored readings, on-time readings."""
    scored = F.col("departure_delay_s").isNotNull() & (F.coalesce("schedule_relationship", F.lit(0)) != 1)
    return obs.groupBy(F.window(ts_col, width).alias("w")).agg(
        F.count(F.lit(1)).cast("long").alias("observations"),
        F.sum(F.when(scored, 1).otherwise(0)).cast("long").alias("scored"),
        F.sum(F.when(scored & (F.col("departure_delay_s") < 120), 1).otherwise(0)).cast("long").alias("on_time"),
    )


def delay_history_stream(spark: SparkSession, source_dir: str, watermark: str = "2 hours", lines: bool = False) -> DataFrame:
    """Streaming R05 over trip-update snapshot files, for output mode append.

    A snapshot that arrives again within the watermark counts once; a window is
    given out when the watermark has passed it. The log keeps every snapshot."""
    docs = snapshot_stream(spark, source_dir, lines)
    snaps = (rj.parse_documents(docs, "trip-update").filter(F.col("feed_timestamp_epoch").isNotNull())
             .withColumn("feed_ts", F.timestamp_seconds("feed_timestamp_epoch"))
             .withWatermark("feed_ts", watermark).dropDuplicatesWithinWatermark(["feed_timestamp_epoch"]))
    stu = rj.shred_trip_updates(snaps, carry=("feed_ts",))["rt_stop_time_update"]
    return on_time_by_window(stu)


def delay_history(t: dict[str, DataFrame]) -> DataFrame:
    """R05 in batch form over the snapshot log: on-time rate per 30-minute window."""
    stu = t["rt_stop_time_update"].join(
        t["rt_snapshot"].filter(F.col("feed") == "trip-update")
        .select("snapshot_id", F.timestamp_seconds("feed_timestamp_epoch").alias("feed_ts")), "snapshot_id")
    w = on_time_by_window(stu)
    return w.select(
        rj.epoch_to_iso(F.unix_seconds(F.col("w.start"))).alias("window_start_utc"),
        "observations", "scored", "on_time",
    )
