"""Connected components of an edge table.

By alternating large and small stars; an edge table of at most ``ONE_TASK`` edges
(some megabytes) goes through a union-find in one task instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import prepare, written

ONE_TASK = 1 << 19


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "c")
    return both.join(least, F.col("u") == F.col("c")).filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    joined = down.join(least, F.col("u") == F.col("c"))
    return joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _union_find(batches):
    """(node, root) of all edges of the task; a root is the least node of its component."""
    import pyarrow as pa

    root: dict[int, int] = {}
    for batch in batches:
        for edge in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ends = []
            for x in edge:
                while (up := root.setdefault(x, x)) != x:
                    root[x] = x = root[up]
                ends.append(x)
            root[max(ends)] = min(ends)
    for x in sorted(root):  # a parent is smaller than its children: its own root is known by then
        root[x] = root[root[x]]
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())],
                                     names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the least node it reaches.

    Hubs are minima per key before they meet their rows again in an equi-join, and
    each round is a written table.
    """
    edges = written(edges.filter(F.col("u") != F.col("v")).select("u", "v"), "edges")
    if edges.count() <= ONE_TASK:
        prepare(edges.sparkSession)
        return edges.coalesce(1).mapInArrow(_union_find, "node long, root long")
    edges = edges.distinct()
    state = _state(edges)
    while state[0]:
        edges = written(_small(_large(edges)).filter(F.col("u") != F.col("v")).distinct(), "edges")
        was, state = state, _state(edges)
        if state == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
