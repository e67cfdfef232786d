"""Exact top-k inner-product search by three phases of a uniform threshold.

A vector's score is a sum over ``LISTS`` slices of its components, so every slice
is a list of local scores. For one block of queries:

1. every task gathers, per query and list, its k best local scores; the exact
   scores of these rows are real scores, so the k-th best of all tasks is a safe
   cutoff t that no result lies below;
2. the cutoff goes to all tasks. A row that reaches t has t / LISTS or more in
   some list, so only entries from there on are collected;
3. the collected rows' remaining lists are resolved to exact scores, and rows
   below t leave. What is left is a little more than k rows per query.

Vectors stay in their partitions: queries come in blocks of ``QUERY_BLOCK`` rows
(a proven bound for the broadcast), cutoffs are one number per query, and each
block reads the vectors twice.

Scores are integers: products below 2^53 go through doubles, below 2^63 through
64-bit integers, larger ones through integers of any size. Defined results: vectors
that are null or hold a null or non-finite component take no part; vectors of
different lengths are compared as if the shorter ended in zeros; rows that repeat a
vec_id are queries and candidates of their own, for each other too, equal rows
included; rows with a null vec_id take no part; ties go to the smaller vec_id; a
quantised component or a score beyond 64 bits counts as the nearest 64-bit number;
an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import prepare, shared_path, written

SCALE = 64
K = 20
LISTS = 2
QUERY_BLOCK = 2048
ROWS = 2048  # rows of vectors looked at together
EVERY = 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): the vectors that take part, as arrays of floor(64 x), each row with a number of its own
    that holds once the rows are written."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: F.coalesce((F.abs(e) < F.lit(float("inf"))) & ~F.isnan(e), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    v = F.transform("x", lambda e: F.floor(e * SCALE).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list array as a matrix of ``width`` columns, short rows ending in zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    ends = np.asarray(column.offsets, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.int64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1], sizes)] = flat
    return out


def products(queries: np.ndarray, rows: np.ndarray, parts: int = 1) -> np.ndarray:
    """Exact inner products of all queries (rows) with all rows (columns), in a type that holds sums of ``parts`` of them."""
    q, r = queries.astype(np.float64), rows.astype(np.float64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, queries.shape[1]) * parts
    if most < 2**53:
        return q @ r.T
    if most < 2**62:
        return queries @ rows.T
    return queries.astype(object) @ rows.T.astype(object)


def saturated(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers, the nearest ones where they lie beyond."""
    if scores.dtype == object:
        return np.array([min(max(int(x), LOWEST), HIGHEST) for x in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def slices(width: int, lists: int) -> list[slice]:
    cut = np.linspace(0, width, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]


class Block:
    """A block of queries (row numbers, ids, vectors) with, after the first phase, their cutoffs (LOWEST: none)."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, lists: int, k: int):
        self.numbers, self.ids, self.vectors, self.lists, self.k = numbers, ids, vectors, lists, k
        self.cutoffs: np.ndarray | None = None


def _parts(batches, width: int):
    """(row numbers, ids, vectors) of a task's rows, some thousand at a time."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width)))
        n += batch.num_rows
        if n >= ROWS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _gather(batches, block: Block):
    """Phase 1, per task: of each query the k best exact scores among the heads of its local lists."""
    import pyarrow as pa

    width, q = block.vectors.shape[1], len(block.ids)
    best = [np.zeros(0, np.int64)] * q
    for numbers, _, rows in _parts(batches, width):
        take = min(block.k + 1, len(numbers))  # the query itself may be among them
        local = [products(block.vectors[:, s], rows[:, s], block.lists) for s in slices(width, block.lists)]
        heads = np.concatenate([np.argpartition(-x, take - 1, axis=1)[:, :take] for x in local], axis=1)
        heads.sort(axis=1)
        score = saturated(sum(np.take_along_axis(x, heads, axis=1) for x in local))
        fresh = np.ones(heads.shape, bool)
        fresh[:, 1:] = heads[:, 1:] != heads[:, :-1]
        fresh &= numbers[heads] != block.numbers[:, None]
        for i in range(q):
            both = np.concatenate((best[i], score[i][fresh[i]]))
            best[i] = np.sort(both)[::-1][: block.k]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(q)), pa.array(best, pa.list_(pa.int64()))], names=["query", "best"])


def _collect(batches, block: Block):
    """Phases 2 and 3, per task: entries from cutoff / lists on, resolved to exact scores."""
    import pyarrow as pa

    width = block.vectors.shape[1]
    share = (block.cutoffs // block.lists)[:, None]
    for numbers, ids, rows in _parts(batches, width):
        local = [products(block.vectors[:, s], rows[:, s], block.lists) for s in slices(width, block.lists)]
        entry = np.logical_or.reduce([(x >= share).astype(bool) for x in local])
        entry |= (block.cutoffs == LOWEST)[:, None]
        entry &= numbers[None, :] != block.numbers[:, None]
        who, row = np.nonzero(entry)
        score = saturated(sum(x[who, row] for x in local))
        keep = score >= block.cutoffs[who]
        who, row = who[keep], row[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.numbers[who]), pa.array(block.ids[who]), pa.array(ids[row]), pa.array(score[keep])],
            names=["query", "query_id", "vec_id", "score"])


def query_blocks(rows: DataFrame, every: int = EVERY, size: int = QUERY_BLOCK):
    """Yield (row numbers, ids, vectors) of the queries, one block of bounded size at a time in the driver."""
    queries = rows.filter(F.col("vec_id") % every == 0)
    n = queries.count()
    blocks = -(-n // size)
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        if part.num_rows:
            yield part.column("row").to_numpy(), part.column("vec_id").to_numpy(), part.column("v").combine_chunks()


def search(vectors: DataFrame, every: int = EVERY, k: int = K, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(quantised(vectors), "topk-vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    kind, path = "query long, query_id long, vec_id long, score long", shared_path(spark, "topk-entries")
    spark.createDataFrame([], kind).write.parquet(path)
    for numbers, ids, queries in query_blocks(rows, every):
        block = Block(numbers, ids, matrix(queries, width), max(1, min(lists, width)), k)
        first = spark.sparkContext.broadcast(block)
        heads = rows.mapInArrow(lambda it, s=first: _gather(it, s.value), "query long, best array<long>")
        # every task sends k numbers per query; their k-th best is the cutoff (all rows, where fewer)
        best = Window.partitionBy("query").orderBy(F.col("score").desc())
        cut = heads.select("query", F.explode("best").alias("score")).withColumn("nth", F.row_number().over(best)).filter(
            F.col("nth") == k).select("query", "score").toPandas()
        block.cutoffs = np.full(len(ids), LOWEST, np.int64)
        block.cutoffs[cut["query"].to_numpy(np.int64)] = cut["score"].to_numpy(np.int64)
        second = spark.sparkContext.broadcast(block)
        rows.mapInArrow(lambda it, s=second: _collect(it, s.value), kind).write.mode("append").parquet(path)
        first.unpersist()
        second.unpersist()
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return spark.read.schema(kind).parquet(path).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = K, every: int = EVERY) -> str:
    return f"""
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % {every} = 0 AND c.n <> q.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
