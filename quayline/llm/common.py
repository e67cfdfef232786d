"""Helpers the operators share: tables, the shared folder, text as bytes, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.shipping import ship_package
from quayline.storage import delete

# Rows in one Arrow batch: long texts make rows large, so batches hold few of them.
ROWS_PER_BATCH = 128


def prepare(spark: SparkSession) -> None:
    """Put this package on the Python workers and bound what one Arrow batch holds."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a session whose tasks run
    inside the driver (``local[...]``) gets a folder of its own when that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quayline-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once what is read from them is itself written."""
    for df in tables:
        delete(df.sparkSession, df.written_path)


class Scratch:
    """Tables that the steps of one operator write, deleted when their last reader is itself written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(written(df, tag))
        return self.tables[-1]

    def discard(self, *tables: DataFrame) -> None:
        discard(*tables)
        self.tables = [t for t in self.tables if not any(t is x for x in tables)]

    def close(self, *kept: DataFrame) -> None:
        """Delete what is left but for the tables that are handed on."""
        discard(*[t for t in self.tables if not any(t is x for x in kept)])
        self.tables = []


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its offsets (null: empty), without copies per row."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def texts(column) -> list[bytes]:
    """Each text of an Arrow string array as UTF-8 bytes (null: empty)."""
    raw, ends = as_bytes(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams in order; fewer than n words count as one gram."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)


def held_out(doc_id, modulus: int, remainder: int):
    """True for rows whose crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


BLOOM_BITS = 1 << 24
NO_ID = -(1 << 63)  # stands for a null id where rows are looked up by id


def row_id(column):
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def bloom_places(column, bits: int = BLOOM_BITS) -> list:
    """The places of a long column's values in a Bloom filter."""
    return [F.pmod(F.xxhash64(F.lit(i), column), F.lit(bits)) for i in range(2)]


def bloom_table(ids: DataFrame, bits: int = BLOOM_BITS):
    """A broadcast Bloom filter of ``ids`` (one long column).

    It has a fixed number of bits whatever the number of ids; ids that pass by
    mistake leave in the exact join that follows.
    """
    spark = ids.sparkSession
    prepare(spark)
    places = ids.toDF("id").select(F.explode(F.array(*bloom_places(F.col("id"), bits))).alias("p"))
    words = places.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("b"))
    got = words.toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return spark.sparkContext.broadcast(out)


def bloom_hits(table_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((table_[a >> 6] >> (a & 63)) & (table_[b >> 6] >> (b & 63)) & 1) == 1


def bloom_filter(ids: DataFrame, bits: int = BLOOM_BITS):
    """A test of a long column by a Bloom filter of ``ids``."""
    shared = bloom_table(ids, bits)

    @F.pandas_udf("boolean")
    def hit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(bloom_hits(shared.value, a.to_numpy(), b.to_numpy()))

    return lambda column: hit(*bloom_places(column, bits))
