"""Ingestion on volume: alert shredding (S11-S15) and the snapshot stream.

The documents are derived from the driver's events (``driver_tables``) and written to
the shared folder; what the ingestion makes of them is counted and compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions import pct
from quayline.operators import views
from quayline.plans import semantic
from quayline.plans.common import beside, spark_of
from quayline.sources import driver_tables
from quayline.sources import realtime_json as rj
from quayline.streaming import lateness, latest, snapshots

EVERY_DAY = "9999-12-31"


def _folder(t, tag: str) -> str:
    from quayline import pipeline

    return f"{pipeline.checkpoint_root(spark_of(t))}/quayline-{tag}/{uuid.uuid4().hex}"


def _n(cond=None) -> F.Column:
    return F.count(F.lit(1) if cond is None else F.when(cond, 1)).cast("long")


def s11_s15_alert_shred(t) -> DataFrame:
    """One alert document per alert of the log, with every quirk, written as JSON Lines, read back and shredded."""
    spark = spark_of(t)
    path = _folder(t, "alert-export")
    rj.export_documents(driver_tables.alert_documents(t["rt_alert"]), path)
    snaps = rj.register_snapshots(rj.parse_documents(rj.read_documents(spark, path, lines=True), "alert"), None)
    out = rj.shred(snaps, "alert")
    texts, periods = out["rt_alert_text"], out["rt_alert_active_period"]
    return beside(
        out["rt_snapshot"].agg(_n().alias("snapshots")),
        out["rt_alert"].agg(_n().alias("alerts"), _n(F.col("url").isNotNull()).alias("alerts_with_url")),
        texts.agg(_n(F.col("field_name") == "header").alias("header_texts"),
                  _n(F.col("field_name") == "description").alias("description_texts"),
                  _n(F.col("text") == "autre").alias("second_texts_of_a_language")),
        out["rt_alert_informed_entity"].agg(_n().alias("informed_entities"), _n(F.col("trip_id").isNotNull()).alias("informed_trips")),
        periods.agg(_n().alias("active_periods"), _n(F.col("end_epoch").isNull()).alias("open_periods")),
    )


def _ingest(t, path: str, docs: DataFrame, name: str) -> None:
    """Deliver documents as a new file set and process what has arrived."""
    rj.export_documents(docs, f"{path}/in/{name}")
    snapshots.run_ingest(spark_of(t), f"{path}/in", "trip-update", f"{path}/log", f"{path}/checkpoint", lines=True)


def _held(t, path: str) -> list[DataFrame]:
    got = snapshots.read_tables(spark_of(t), f"{path}/log")
    return [got["rt_snapshot"].agg(_n().alias("snapshots")), got["rt_trip_update"].agg(_n().alias("trip_updates")),
            got["rt_stop_time_update"].agg(_n().alias("stop_time_updates"),
                                           F.sum("departure_delay_s").cast("long").alias("delay_seconds"))]


def r02_replay(t) -> DataFrame:
    """The whole log as snapshot documents through the stream, then all of them once more."""
    path = _folder(t, "replay")
    docs = driver_tables.snapshot_documents(t["rt_trip_update"], t["rt_stop_time_update"])
    _ingest(t, path, docs, "first")
    _ingest(t, path, docs, "again")
    return beside(*_held(t, path))


def r02_late_after_compaction(t) -> DataFrame:
    """Every seventh snapshot arrives after its day was compacted; a second compaction takes it in."""
    spark = spark_of(t)
    path = _folder(t, "late")
    late = F.pmod(F.floor(F.col("snapshot_id") / 2), F.lit(7)) == 0
    docs = driver_tables.snapshot_documents(t["rt_trip_update"], t["rt_stop_time_update"], keep_id=True)
    _ingest(t, path, docs.filter(~late), "in_time")
    first = snapshots.compact(spark, f"{path}/log", EVERY_DAY)
    _ingest(t, path, docs.filter(late), "late")
    second = snapshots.compact(spark, f"{path}/log", EVERY_DAY)
    return beside(*_held(t, path)).withColumns({
        "compacted_first": F.lit(first).cast("long"), "compacted_late": F.lit(second).cast("long")})


def r05_stream(t) -> DataFrame:
    """R05 as a stream in append mode: each snapshot is delivered twice and counts once."""
    spark = spark_of(t)
    path = _folder(t, "delays")
    docs = driver_tables.snapshot_documents(t["rt_trip_update"], t["rt_stop_time_update"])
    end = t["rt_snapshot"].agg(F.max("feed_timestamp_epoch") + 10 * 86400)
    closing = end.toDF("ts").select(F.concat(F.lit('{"header":{"timestamp":'), F.col("ts").cast("string"),
                                             F.lit('},"entity":[]}')).alias("doc"))
    rj.export_documents(docs, f"{path}/in/first")
    rj.export_documents(docs, f"{path}/in/again")
    rj.export_documents(closing, f"{path}/in/closing")
    query = (snapshots.delay_history_stream(spark, f"{path}/in", watermark="2 days", lines=True).writeStream.format("parquet")
             .option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(rj.epoch_to_iso(F.unix_seconds(F.col("w.start"))).alias("window_start_utc"),
                      "observations", "scored", "on_time")


def r03_latest_stream(t) -> DataFrame:
    """V07 from the table that the stream keeps, after snapshots out of order and a repeat of all of them."""
    spark = spark_of(t)
    path = _folder(t, "latest")
    docs = driver_tables.snapshot_documents(t["rt_trip_update"], t["rt_stop_time_update"], keep_id=True)
    half = F.floor(F.col("snapshot_id") / 2)
    for name, part in (("newer", docs.filter(half % 3 != 0)), ("older", docs.filter(half % 3 == 0)), ("again", docs)):
        rj.export_documents(part, f"{path}/in/{name}")
        latest.run_latest(spark, f"{path}/in", f"{path}/table", f"{path}/checkpoint", lines=True)
    latest.remove_replaced(spark, f"{path}/table")
    perf = views.performance_of(t, latest.read_latest(spark, f"{path}/table"))
    return perf.select(*[c for c in semantic.PERFORMANCE_COLUMNS if c != "fetched_at_utc"])  # fetched now, not then


_LEDGERS: dict = {}


def _ledger(t) -> DataFrame:
    """Both feeds ingested in two deliveries and once more as a whole, with the ledger of it; once per session and build."""
    spark = spark_of(t)
    key = (spark.sparkContext.applicationId, id(t["trip"]))
    if key not in _LEDGERS:
        path = _folder(t, "ledger")
        first = F.pmod(F.floor(F.col("snapshot_id") / 2), F.lit(5)) != 0
        docs = driver_tables.snapshot_documents(t["rt_trip_update"], t["rt_stop_time_update"], keep_id=True)
        alerts = driver_tables.alert_documents(t["rt_alert"])
        bad = spark.createDataFrame([('{"header":{},"entity":[]}',), ("no document",)], "doc string")
        for name, part in (("first", docs.filter(first).select("doc").unionAll(bad)), ("rest", docs.filter(~first)), ("again", docs)):
            rj.export_documents(part, f"{path}/tu/{name}")
            snapshots.run_ingest(spark, f"{path}/tu", "trip-update", f"{path}/log", f"{path}/c1", trips=t["trip"], lines=True)
        for name in ("first", "again"):
            rj.export_documents(alerts, f"{path}/al/{name}")
            snapshots.run_ingest(spark, f"{path}/al", "alert", f"{path}/log", f"{path}/c2", lines=True)
        _LEDGERS[key] = (t["trip"], snapshots.read_ledger(spark, f"{path}/log"))
    return _LEDGERS[key][1]


def s20_rows_written(t) -> DataFrame:
    """Per table, batches, documents taken in and refused, and rows written."""
    return _ledger(t).groupBy("feed", "table_name").agg(
        F.count(F.lit(1)).cast("long").alias("batches"), F.sum("documents").alias("documents"), F.sum("refused").alias("refused"),
        F.sum("already_held").alias("already_held"), F.sum("rows_written").alias("rows_written"))


def r04_match_rate(t) -> DataFrame:
    """How many trip updates name a trip of the timetable, from the ledger."""
    one = _ledger(t).filter(F.col("table_name") == "rt_trip_update").agg(
        F.sum("rows_written").alias("trip_updates"), F.sum("rows_matched").alias("matched"))
    return one.select("trip_updates", "matched", pct("matched", "trip_updates", 2).alias("match_rate_pct"))


HISTORY_DELAY = 86400


def r05_late_rows(t) -> DataFrame:
    """Every eleventh snapshot arrives last, most of them after their window was closed."""
    spark = spark_of(t)
    path = _folder(t, "lateness")
    docs = driver_tables.snapshot_documents(t["rt_trip_update"], t["rt_stop_time_update"], keep_id=True)
    held_back = F.pmod(F.floor(F.col("snapshot_id") / 2), F.lit(11)) == 0
    for name, part in (("in_time", docs.filter(~held_back)), ("late", docs.filter(held_back)), ("again", docs)):
        rj.export_documents(part, f"{path}/in/{name}")
        lateness.run_history(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", HISTORY_DELAY, lines=True)
    return lateness.history(spark, f"{path}/out", HISTORY_DELAY)


def t21_rejected_rows(t) -> DataFrame:
    """Every quarantined row: table, line, rule, reason."""
    return t["rejected_row"].select("source_table", "src_line_no", "rule_code", "reason")
