"""Session defaults for local runs and tests (a cluster passes its own), and settings for a few jobs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quayline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def grown(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is never sent whole to the driver and every executor.

    Spark judges a Parquet table by its files, and ids in zstd take about a byte a row there: nine million
    trip ids in under 10 MB pass for a small table and are 1.1 GB as a broadcast relation."""
    return side.hint("merge")


@contextmanager
def settings(spark: SparkSession, values: dict):
    """SQL settings for the jobs run inside; what held before holds again after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
