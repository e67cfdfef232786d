"""Places of rows within their group, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import written


def ranked(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``pos``: the place from 0 of a row in its ``group`` by ``order`` (nulls first).

    The rows are range-partitioned by group and order, so a hot group lies in many
    partitions, sorted and written. A place is the offset in the row's stretch (the
    part of a group that one partition holds) plus the sizes of the stretches before
    it; only stretches, one row per group and partition, meet in a window.
    """
    by = [group, *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()  # partition number in the upper bits, row number below
    kept = written(sorted_rows.withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33).cast("int")), tag)
    stretches = kept.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(
        F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__p")) - F.col("__n")
    stretches = stretches.withColumn("__before", before).drop("__n")
    joined = kept.join(stretches, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"))
