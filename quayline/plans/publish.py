"""Result and table sinks.

* S21 CSV (with header) per labelled result, each query run once. The caller names the
  layout: a result is a folder of as many files as Spark's writers make, or one file for
  the labels in ``single`` (``True``: all), for results known to be a few rows.
* S22 core tables are replaced per build (overwrite), logs are appended
  partitioned by run (see ``pipeline.Core`` and ``streaming.snapshots``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, single: bool = False) -> int:
    """Write one result; returns its rows, counted while they are written."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out = out.repartition(1) if single else out  # a shuffle, so that the query itself keeps its tasks
    out.write.mode("overwrite").option("header", "true").csv(path)
    return seen.get["rows"]


def publish_all(queries: dict, t: dict[str, DataFrame], root: str, single: bool | set[str] = True) -> dict[str, int]:
    """Write every labelled result under ``root/<label>``; returns rows per label."""
    return {label: write_result(fn(t), f"{root}/{label}", single is True or (single is not False and label in single))
            for label, fn in queries.items()}
