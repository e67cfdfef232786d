"""R05 with its late rows: every observation is on time or late, none is lost.

A watermark lets a windowed aggregation forget windows, and Spark drops the rows that
come after. Here the stream splits each micro-batch before the windows: the horizon of
a batch is the newest feed time of the batches before it less the allowed delay, and
an observation whose feed time lies before the horizon is written to the late side. A
batch writes under its own id, and the horizon is read from batches before it, so a
batch that is run again after a failure makes the same split. Windows that end at or
before the newest horizon are closed: what comes for them later is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.sources import realtime_json as rj
from quayline.storage import exists
from quayline.streaming.snapshots import on_time_by_window, snapshot_stream

OBSERVED = ("snapshot_id long, feed_timestamp_epoch long, rt_entity_id string, stop_sequence int, departure_delay_s int, "
            "schedule_relationship int, batch long, late boolean")
WINDOW = 1800


def _batches(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """(batch, newest) of the batches run so far: the newest feed time of each."""
    if not exists(spark, f"{root}/batches"):
        return None
    rows = spark.read.schema("newest long, batch long").parquet(f"{root}/batches")
    return rows if before is None else rows.filter(F.col("batch") < before)


def horizon(spark: SparkSession, root: str, delay: int, before: int | None = None) -> int | None:
    """Feed time (epoch seconds) before which an observation is late, for batch ``before`` or from now on."""
    rows = _batches(spark, root, before)
    newest = rows.agg(F.max("newest")).first()[0] if rows is not None else None
    return None if newest is None else newest - delay


def split_batch(docs: DataFrame, batch_id: int, root: str, delay: int) -> None:
    """Write the observations of one micro-batch, each with whether it came too late."""
    spark = docs.sparkSession
    snaps = rj.register_snapshots(rj.parse_documents(docs, "trip-update"), None)
    if exists(spark, f"{root}/observations"):  # a snapshot that an earlier batch brought counts once
        known = spark.read.schema(OBSERVED).parquet(f"{root}/observations").filter(F.col("batch") < batch_id)
        snaps = snaps.join(known.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    limit = horizon(spark, root, delay, before=batch_id)
    late = F.lit(False) if limit is None else F.col("feed_timestamp_epoch") < limit
    stu = rj.shred_trip_updates(snaps, carry=("feed_timestamp_epoch",))["rt_stop_time_update"]
    rows = stu.select("snapshot_id", "feed_timestamp_epoch", "rt_entity_id", "stop_sequence", "departure_delay_s",
                      "schedule_relationship", late.alias("late"))
    path = f"{root}/observations/batch={batch_id}"
    rows.write.mode("overwrite").partitionBy("late").parquet(path)
    newest = spark.read.schema("feed_timestamp_epoch long").parquet(path).agg(F.max("feed_timestamp_epoch").alias("newest"))
    newest.filter(F.col("newest").isNotNull()).write.mode("overwrite").parquet(f"{root}/batches/batch={batch_id}")


def run_history(spark: SparkSession, source_dir: str, root: str, checkpoint: str, delay: int, lines: bool = False):
    """Split every snapshot file that has arrived and stop; returns the finished query."""
    q = (snapshot_stream(spark, source_dir, lines).writeStream
         .foreachBatch(lambda docs, batch_id: split_batch(docs, batch_id, root, delay))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def history(spark: SparkSession, root: str, delay: int) -> DataFrame:
    """Per window: on-time observations with their figures, late observations, and whether it is closed."""
    rows = spark.read.schema(OBSERVED).parquet(f"{root}/observations").withColumn(
        "feed_ts", F.timestamp_seconds("feed_timestamp_epoch"))
    kept = on_time_by_window(rows.filter(~F.col("late")))
    late = rows.filter("late").groupBy(F.window("feed_ts", f"{WINDOW} seconds").alias("w")).agg(
        F.count(F.lit(1)).cast("long").alias("late_observations"))
    limit = horizon(spark, root, delay)
    both = kept.join(late, "w", "full")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    end = F.unix_seconds(F.col("w.end"))
    return both.select(rj.epoch_to_iso(F.unix_seconds(F.col("w.start"))).alias("window_start_utc"), count("observations"),
                       count("scored"), count("on_time"), count("late_observations"),
                       (F.lit(False) if limit is None else end <= limit).alias("closed"))
