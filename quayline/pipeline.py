"""Build the core model once and serve it to every query.

``build_core`` runs staging -> cleaning -> views lazily; ``core`` gives the tables
by name. A table is built, with those it rests on, when a query first asks for it
and written as Parquet under the session's checkpoint directory (a shared, durable
folder on a cluster), so the analyses read a written semantic layer instead of
re-running the cleaning jobs, and lineage is cut at that point.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Mapping
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayline.operators import clean as cleaning
from quayline.operators import views
from quayline.sources import driver_tables
from quayline.session import settings
from quayline.storage import checkpoint_root, exists, list_files

# name -> columns the written file is sorted by inside each task (min/max pruning)
LAYOUT = {
    "stop_time_screened": ["trip_id", "stop_sequence"],
    "v_departure": ["station_name", "departure_hour"],
    "service_date": ["service_id", "service_date"],
}
# name -> directory partition columns (few distinct values, read with pruning)
PARTITION_BY = {
    "stop_time_screened": ["load_status"],
}
# the large members, read by several rules: staged once, one scan and one shuffle of the source
STAGED_ONCE = ("stop_times", "calendar_dates")
# input tables that the core is built from, and how much of them (compressed) a shuffle partition is to hold
INPUTS = ("customer", "supplier", "part", "orders", "lineitem", "events")
PARTITION_INPUT = 4 << 20
TASK_SHUFFLE = 16 << 20  # compressed; several times that as rows to sort

_CACHE: dict[tuple, Mapping[str, DataFrame]] = {}


def build_core(spark: SparkSession, sf_dir: str, put=None) -> dict[str, DataFrame]:
    """Core tables, quarantine, realtime log; written through ``put`` when given."""
    put = put or (lambda name, df: df)
    members = driver_tables.staged_members(spark, sf_dir)
    for big in STAGED_ONCE:
        members[big] = put(f"stg_{big}", members[big])
    out = cleaning.clean(members, put)
    t = dict(out.tables)
    t["rejected_row"] = out.rejected
    for name, df in members.items():
        t[f"stg_{name}"] = df
    for name, df in driver_tables.realtime_from_events(spark, sf_dir).items():
        t[name] = put(name, df)
    return t


def feed_core(spark: SparkSession, path: str, put=None, stage_dir: str | None = None,
              fail_on_error: bool = False) -> dict[str, DataFrame]:
    """Core model from a schedule feed on storage (zip archives or extracted members).

    ``put`` writes each table (see ``build_feed``); ``fail_on_error`` raises if a
    table that was built breaks a constraint."""
    from quayline.operators import constraints
    from quayline.sources import gtfs_feed

    put = put or (lambda name, df: df)
    members, report, listing = gtfs_feed.staged_members(spark, path, stage_dir)
    out = cleaning.clean(members, put)
    t = dict(out.tables)
    if fail_on_error:
        constraints.enforce(t)
    t["rejected_row"] = out.rejected
    t["member_report"] = report
    t["unknown_columns"] = listing["unknown_columns"]
    for name, df in members.items():
        t[f"stg_{name}"] = df
    return t


def add_views(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    t = dict(t)
    t.setdefault("v_departure", views.departures(t))
    t.setdefault("v_trip_service_days", views.trip_service_days(t))
    t.setdefault("service_days", views.service_days(t))
    t.setdefault("v_trip_origin", views.trip_origin(t["v_departure"]))
    t.setdefault("v_service_frequency", views.service_frequency(t))
    t.setdefault("v_trip_amenity", views.trip_amenity(t))
    t.setdefault(
        "v_station_daily_departures",
        views.station_daily_departures(t, t["v_departure"], t["v_trip_service_days"]),
    )
    if "rt_stop_time_update" in t:
        t.setdefault("v_rt_departure_performance", views.rt_departure_performance(t, t))
    return t


def build_feed(spark: SparkSession, path: str, root: str, fail_on_error: bool = False, run_id: str | None = None,
               log: str | None = None) -> dict[str, DataFrame]:
    """Read the feed under ``path`` and write the core, quarantine and timetable views under ``root``.

    Returns DataFrames that read the written tables; the run is logged beside them, or in ``log``."""
    run_id, started, log = run_id or uuid.uuid4().hex, _now(), log or f"{root}/ingestion_run"
    put = _writer(spark, root, run_id)
    try:
        t = feed_core(spark, path, put, f"{root}/_lines", fail_on_error)
        _write_timetable_views(t, put)
    except Exception:
        log_run(spark, None, log, run_id, path, started, "failed")
        raise
    t["ingestion_run"] = log_run(spark, t, log, run_id, path, started)
    return t


POINTER_SCHEMA = "version long, run_id string, root string, tables array<string>, schemas array<string>"


def publish_feed(spark: SparkSession, path: str, root: str, fail_on_error: bool = False) -> dict[str, DataFrame]:
    """Build a feed beside the builds that exist and make it the current one in one step.

    Every run writes a folder of its own. Its quarantine rows go to ``<root>/quarantine`` under the
    run, beside those of earlier runs, and a pointer row of the next version, written last, names
    the build: until then, and if the run fails or breaks a constraint, readers keep the one before."""
    run_id = uuid.uuid4().hex
    t = build_feed(spark, path, f"{root}/builds/{run_id}", fail_on_error, run_id, f"{root}/ingestion_run")
    t["rejected_row"].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(
        f"{root}/quarantine")
    names = sorted(n for n in t if exists(spark, f"{root}/builds/{run_id}/{n}/_SUCCESS"))
    before = _pointer(spark, root)
    row = ((before["version"] if before else 0) + 1, run_id, f"{root}/builds/{run_id}", names, [t[n].schema.json() for n in names])
    spark.createDataFrame([row], POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/_published")
    return read_published(spark, root)


def _pointer(spark: SparkSession, root: str):
    if not exists(spark, f"{root}/_published"):
        return None
    return spark.read.schema(POINTER_SCHEMA).json(f"{root}/_published").orderBy(F.col("version").desc()).first()


def read_published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the current build (or of an earlier ``version``), the quarantine of every run, and the run log."""
    if version is None:
        p = _pointer(spark, root)
    else:
        p = spark.read.schema(POINTER_SCHEMA).json(f"{root}/_published").filter(F.col("version") == version).first()
    if p is None:
        raise ValueError(f"nothing is published under {root}")
    t = {n: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{p['root']}/{n}") for n, s in zip(p["tables"], p["schemas"])}
    t["stop_time"] = cleaning.accepted_stop_times(t["stop_time_screened"])
    t["rejected_row"] = spark.read.parquet(f"{root}/quarantine")
    t["ingestion_run"] = spark.read.parquet(f"{root}/ingestion_run")
    return t


class Core(Mapping):
    """The tables of one source by name; a table is built and written when it is first asked for.

    A written table is published by a pointer of its own, so other sessions read it. Quarantine
    rows are stamped with the run; asking for ``ingestion_run`` builds what is missing and logs the run."""

    def __init__(self, spark: SparkSession, sf_dir: str, reuse: bool = True):
        self._spark, self._sf_dir, self._reuse = spark, sf_dir, reuse
        self._base = f"{checkpoint_root(spark)}/quayline-core"
        self._pointers = f"{self._base}/_published/{fingerprint(spark, sf_dir)}"
        self._run_id, self._started = uuid.uuid4().hex, _now()
        self._root = f"{self._base}/{uuid.uuid4().hex}"
        self._writer = _writer(spark, self._root, self._run_id)
        self._partitions = _input_partitions(spark, sf_dir)
        self._known: dict[str, DataFrame] = {}
        self._depth = 0
        staged, found = driver_tables.staged_members(spark, sf_dir), cleaning.rules(_Members(self), self, self._put)
        self._plain = {f"stg_{m}": lambda df=df: df for m, df in staged.items() if m not in STAGED_ONCE} | {
            "stop_time": lambda: cleaning.accepted_stop_times(self["stop_time_screened"]),
            "v_station_daily_departures": lambda: views.station_daily_departures(
                self, self["v_departure"], self["v_trip_service_days"]),
            "ingestion_run": self._logged,
        }
        self._written = {f"stg_{m}": lambda df=staged[m]: df for m in STAGED_ONCE} | {
            name: rows for name, (rows, _) in found.items()} | {"rejected_row": lambda: cleaning.quarantine(found)} | {
            name: lambda df=df: df for name, df in driver_tables.realtime_from_events(spark, sf_dir).items()} | {
            name: lambda view=view: view(self) for name, view in VIEWS.items()} | {
            "v_rt_departure_performance": lambda: views.rt_departure_performance(self, self)}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name not in self:
                raise KeyError(name)
            self._known[name] = self._plain[name]() if name in self._plain else self._built(name)
        return self._known[name]

    def __contains__(self, name) -> bool:
        return name in self._plain or name in self._written

    def __iter__(self):
        return iter([*self._plain, *self._written])

    def __len__(self) -> int:
        return len(self._plain) + len(self._written)

    def build(self) -> Core:
        """Build every table that is missing and log the run."""
        for name in self:
            self[name]
        return self

    def _built(self, name: str) -> DataFrame:
        self._depth += 1
        try:
            there = self._published(name)
            return self._put(name, self._written[name]()) if there is None else there
        except Exception:
            if self._depth == 1:
                log_run(self._spark, None, f"{self._base}/ingestion_run", self._run_id, self._sf_dir, self._started, "failed")
            raise
        finally:
            self._depth -= 1

    def _published(self, name: str) -> DataFrame | None:
        return _published(self._spark, self._pointers, name) if self._reuse else None

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        with _partitions(self._spark, self._partitions):
            out = self._writer(name, df)
        if self._reuse:
            _publish(self._spark, self._pointers, name, out, f"{self._root}/{name}")
        return out

    def _logged(self) -> DataFrame:
        log = f"{self._base}/ingestion_run"
        if self._published("ingestion_run") is None:
            for name in self._written:
                self[name]
            # rows that an earlier session quarantined carry its run
            first = self["rejected_row"].select("run_id").first()
            run = log_run(self._spark, self, log, first["run_id"] if first else self._run_id, self._sf_dir, self._started)
            if self._reuse:
                _publish(self._spark, self._pointers, "ingestion_run", run, log)
        return self._spark.read.parquet(log)


class _Members(Mapping):
    """The staged members of a ``Core`` by member name."""

    def __init__(self, core: Core):
        self._core = core

    def __getitem__(self, member: str) -> DataFrame:
        return self._core[f"stg_{member}"]

    def __iter__(self):
        return (name[4:] for name in self._core if name.startswith("stg_"))

    def __len__(self) -> int:
        return sum(1 for _ in self)


def _input_partitions(spark: SparkSession, sf_dir: str) -> int:
    size = sum(n for path, n, _ in list_files(spark, sf_dir) if any(f"/{t}.parquet" in path for t in INPUTS))
    return -(-size // PARTITION_INPUT)


@contextmanager
def _partitions(spark: SparkSession, least: int):
    """Shuffles begin with at least so many partitions and AQE joins small ones only up to ``TASK_SHUFFLE``:
    a task's sort then fits its memory at any size. Rows shuffled by some of a join's keys are not shuffled again."""
    first, joined = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    with settings(spark, {
        first: max(least, int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions"))),
        joined: f"{min(TASK_SHUFFLE, as_bytes(spark.conf.get(joined)))}b",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }):
        yield


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


# the semantic layer over the timetable: small views that many analyses read, in the order they are built
VIEWS = {
    "v_departure": views.departures,
    "v_trip_service_days": views.trip_service_days,
    "service_days": views.service_days,
    "v_trip_origin": lambda t: views.trip_origin(t["v_departure"]),
    "v_service_frequency": views.service_frequency,
    "v_trip_amenity": views.trip_amenity,
}


def _write_timetable_views(t: dict[str, DataFrame], put) -> None:
    """Write the semantic layer over the timetable."""
    for name, view in VIEWS.items():
        t[name] = put(name, view(t))


def _writer(spark: SparkSession, root: str, run_id: str):
    """A function that writes a table under ``root`` and returns a DataFrame reading it back."""

    def put(name: str, df: DataFrame) -> DataFrame:
        path = f"{root}/{name}"
        if name == "rejected_row":
            df = df.withColumn("run_id", F.lit(run_id))
        w = df
        if name in LAYOUT:
            w = w.sortWithinPartitions(*LAYOUT[name])
        writer = w.write.mode("overwrite").option("compression", "zstd")
        if name in PARTITION_BY:
            writer = writer.partitionBy(*PARTITION_BY[name])
        writer.parquet(path)
        # we know what we wrote: an explicit schema skips footer inference on read-back
        schema = w.schema
        if name in PARTITION_BY:  # partition columns come back last
            keep = [f for f in schema.fields if f.name not in PARTITION_BY[name]]
            schema = StructType(keep + [f for f in schema.fields if f.name in PARTITION_BY[name]])
        return spark.read.schema(schema).parquet(path)

    return put


def log_run(spark, t, path, run_id, source, started, status: str = "success") -> DataFrame:
    """Append one run-log row (a handful of scalar counts read from Parquet footers)."""
    loaded = rejected = None
    if t is not None:
        loaded = sum(t[n].count() for n in ("station", "platform", "route", "service", "service_date", "trip",
                                              "stop_time", "transfer", "text_translation", "agency", "feed_info"))
        rejected = t["rejected_row"].count()
    finished = _now()
    row = [(run_id, source, started, finished, status, loaded, rejected)]
    schema = ("run_id string, source string, started_at_utc string, finished_at_utc string, status string, "
              "rows_loaded long, rows_rejected long")
    spark.createDataFrame(row, schema).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _code_version() -> str:
    h = hashlib.sha1()
    pkg = os.path.dirname(os.path.abspath(__file__))
    for dirpath, _, files in sorted(os.walk(pkg)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode())
                    h.update(fh.read())
    return h.hexdigest()


def _canonical(path: str) -> str:
    """Local paths made absolute; URIs (``s3://``, ``hdfs://`` ...) kept as given."""
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha1(_canonical(sf_dir).encode())
    h.update(repr(list_files(spark, sf_dir)).encode())
    h.update(_code_version().encode())
    return h.hexdigest()[:24]


def _published(spark: SparkSession, pointers: str, name: str) -> DataFrame | None:
    if not exists(spark, f"{pointers}/{name}/_SUCCESS"):  # no finished pointer yet
        return None
    row = spark.read.json(f"{pointers}/{name}").first()
    # a table whose folder was removed (retention) is rebuilt rather than half-read
    if not row or not exists(spark, f"{row['path']}/_SUCCESS"):
        return None
    return spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(row["path"])


def _publish(spark: SparkSession, pointers: str, name: str, df: DataFrame, path: str) -> None:
    """Point at a finished table (written only after it is); the pointer carries its schema, so a reader skips inference."""
    spark.createDataFrame([(path, df.schema.json())], "path string, schema string").coalesce(1).write.mode(
        "overwrite").json(f"{pointers}/{name}")


def core(spark: SparkSession, sf_dir: str, reuse: bool = True) -> Mapping[str, DataFrame]:
    """Core + views for ``sf_dir``, each table built when a query first asks for it.

    A table is keyed by a fingerprint of the input files and of this package's
    code; it is written into a fresh folder and then published by a small
    pointer, so a later session (or process) reads the finished table instead
    of rebuilding, and a half-written one is never read.
    ``reuse=False`` always builds, and all of it (the benchmark does).
    """
    key = (spark.sparkContext.applicationId, _canonical(sf_dir), reuse)
    if key not in _CACHE:
        t = Core(spark, sf_dir, reuse)
        _CACHE[key] = t if reuse else t.build()
    return _CACHE[key]


def lazy_core(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Unmaterialised plans (for plan inspection and small tests)."""
    return add_views(build_core(spark, sf_dir))
