"""The newest observation of every call, kept by the stream as a keyed table.

The table is the state: one row per (trip, day, sequence), stored in parts by day and
hash of the trip. A micro-batch is reduced to the newest observation per call and
merged with the parts it touches; "newest" is a maximum over (feed time, fetch time,
entity), so snapshots may come in any order and any number of times. Merged parts are
written beside the old ones, and a manifest row per part, appended last in one
commit, makes them current: a batch that failed half-way is never seen, a repeated one
merges to the same rows. Parts that two later manifests no longer name are removed by
``remove_replaced``, so a reader that began before a commit still finds its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.operators import views
from quayline.sources import realtime_json as rj
from quayline.storage import delete, exists, list_folders
from quayline.streaming.snapshots import snapshot_stream

BUCKETS = 4  # parts of one day
ROW_SCHEMA = ("trip_id string, start_date string, stop_sequence int, feed_timestamp_epoch long, fetched_at_utc string, "
              "rt_entity_id string, stop_id string, departure_delay_s int, arrival_delay_s int, schedule_relationship int")
MANIFEST_SCHEMA = "part string, batch string, version long"


def _part() -> F.Column:
    day = F.regexp_replace(F.coalesce("start_date", F.lit("none")), "[^0-9A-Za-z-]", "_")
    return F.concat_ws("_", day, F.pmod(F.xxhash64("trip_id"), F.lit(BUCKETS)).cast("string"))


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The current batch of every part: (part, batch, version)."""
    if not exists(spark, f"{root}/_manifest"):
        return None
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/_manifest")
    return rows.groupBy("part").agg(F.max(F.struct("version", "batch")).alias("r")).select("part", "r.batch", "r.version")


def _current(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The rows of the parts that ``manifest`` names; only the folders of its batches are listed."""
    batches = [r["batch"] for r in manifest.select("batch").distinct().collect()]  # names of folders, never data
    if not batches:
        return spark.createDataFrame([], f"{ROW_SCHEMA}, part string")
    reader = spark.read.schema(f"{ROW_SCHEMA}, batch string, part string").option("basePath", f"{root}/data")
    stored = reader.parquet(*[f"{root}/data/batch={b}" for b in batches])
    return stored.join(manifest.select("part", "batch"), ["part", "batch"], "left_semi").drop("batch")


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest observation of every call."""
    manifest = _manifest(spark, root)
    if manifest is None:
        return spark.createDataFrame([], ROW_SCHEMA)
    return _current(spark, root, manifest).drop("part")


def upsert(observed: DataFrame, root: str) -> None:
    """Merge observations (``views.observations``) into the table under ``root``."""
    spark = observed.sparkSession
    batch = uuid.uuid4().hex
    cols = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
    changes = views.newest_of(observed).select(*cols).withColumn("part", _part())
    changes.write.parquet(f"{root}/_changes/{batch}")
    changes = spark.read.schema(f"{ROW_SCHEMA}, part string").parquet(f"{root}/_changes/{batch}")
    touched = changes.select("part").distinct()
    manifest = _manifest(spark, root)
    merged = changes
    versions = touched.withColumn("version", F.lit(0).cast("long"))
    if manifest is not None:
        held = manifest.join(touched, "part")  # only the parts that change are read
        merged = changes.unionByName(_current(spark, root, held))
        versions = touched.join(held.select("part", "version"), "part", "left").select(
            "part", F.coalesce(F.col("version") + 1, F.lit(0)).cast("long").alias("version"))
    rows = views.newest_of(merged).withColumns({"part": _part(), "batch": F.lit(batch)})
    rows.repartition("part").write.mode("append").partitionBy("batch", "part").parquet(f"{root}/data")  # a file for each part
    versions.withColumn("batch", F.lit(batch)).select("part", "batch", "version").coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    delete(spark, f"{root}/_changes/{batch}")


def run_latest(spark: SparkSession, source_dir: str, root: str, checkpoint: str, lines: bool = False):
    """Merge every snapshot file that has arrived and stop; returns the finished query."""
    def batch(docs: DataFrame, batch_id: int) -> None:
        snaps = rj.parse_documents(docs, "trip-update").filter(F.col("feed_timestamp_epoch").isNotNull())
        made = rj.shred_trip_updates(snaps, carry=("feed_timestamp_epoch", "fetched_at_utc"))
        trips = made["rt_trip_update"].select("snapshot_id", "rt_entity_id", "trip_id", "start_date").dropDuplicates(
            ["snapshot_id", "rt_entity_id"])
        observed = made["rt_stop_time_update"].join(trips, ["snapshot_id", "rt_entity_id"]).filter(F.col("trip_id").isNotNull())
        upsert(observed, root)

    q = (snapshot_stream(spark, source_dir, lines).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def remove_replaced(spark: SparkSession, root: str) -> int:
    """Delete the batches that neither the current nor the previous version of any part names.

    A reader that began before the last commit holds versions that are still there.
    Returns how many batch folders were removed."""
    if not exists(spark, f"{root}/_manifest"):
        return 0
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/_manifest")
    newest = rows.groupBy("part").agg(F.max("version").alias("newest"))
    kept = rows.join(newest, "part").filter(F.col("version") >= F.col("newest") - 1).select("batch").distinct()
    named = {r["batch"] for r in rows.select("batch").distinct().collect()}  # names of folders, never data
    stale = named - {r["batch"] for r in kept.collect()}
    folders = {f"batch={b}" for b in stale} & set(list_folders(spark, f"{root}/data"))
    for folder in folders:
        delete(spark, f"{root}/data/{folder}")
    return len(folders)
