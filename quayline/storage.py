"""Files and folders through the Hadoop file system, whatever the store."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, modification time) of every file at any depth.

    A table may be a folder of parts; stores do not change a folder's own time with its files."""
    p, fs = _fs(spark, path)
    out = []
    files = fs.listFiles(p, True)
    while files.hasNext():
        st = files.next()
        out.append((st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())))
    return sorted(out)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders directly under ``path``."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    Only where tasks run inside the driver (``local[...]``: tests) an unset folder
    is replaced by a private one; on a cluster executors could not see it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="quayline-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d.rstrip("/")
