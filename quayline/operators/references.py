"""Every reference of the model checked in one shuffle.

A parent's keys and the keys that refer to it are tagged with the parent (a *domain*)
and meet by (domain, key). Rows of a child collapse before the shuffle: of a key that
a third of all rows hold, each task sends one row with a count per reference. A group
without a parent is a violation of the references that have a count in it. Fixed code
lists are domains too: their codes are the parents. NULLs refer to nothing.

A reference whose child or parent table was not built is reported as such; it never
reads as "no violation".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.schemas import (
    ACCESSIBILITY,
    ALERT_CAUSES,
    ALERT_EFFECTS,
    EXCEPTION_TYPES,
    PICKUP_DROP,
    ROUTE_TYPES,
    STOP_SCHEDULE_RELATIONSHIP,
    TRANSFER_TYPES,
    TRIP_SCHEDULE_RELATIONSHIP,
)

# (child, its columns, parent, the parent's key) of every reference between tables.
FOREIGN_KEYS = [
    ("platform", ("station_id",), "station", ("station_id",)),
    ("route", ("agency_id",), "agency", ("agency_id",)),
    ("trip", ("route_id",), "route", ("route_id",)),
    ("trip", ("service_id",), "service", ("service_id",)),
    ("service_date", ("service_id",), "service", ("service_id",)),
    ("stop_time", ("trip_id",), "trip", ("trip_id",)),
    ("stop_time", ("stop_id",), "platform", ("stop_id",)),
    ("transfer", ("from_stop_id",), "platform", ("stop_id",)),
    ("transfer", ("to_stop_id",), "platform", ("stop_id",)),
    ("transfer", ("from_trip_id",), "trip", ("trip_id",)),
    ("transfer", ("to_trip_id",), "trip", ("trip_id",)),
    ("rejected_row", ("run_id",), "ingestion_run", ("run_id",)),
    ("rt_trip_update", ("snapshot_id",), "rt_snapshot", ("snapshot_id",)),
    ("rt_stop_time_update", ("snapshot_id", "rt_entity_id"), "rt_trip_update", ("snapshot_id", "rt_entity_id")),
    ("rt_alert", ("snapshot_id",), "rt_snapshot", ("snapshot_id",)),
    ("rt_alert_text", ("snapshot_id", "rt_entity_id"), "rt_alert", ("snapshot_id", "rt_entity_id")),
    ("rt_alert_informed_entity", ("snapshot_id", "rt_entity_id"), "rt_alert", ("snapshot_id", "rt_entity_id")),
    ("rt_alert_active_period", ("snapshot_id", "rt_entity_id"), "rt_alert", ("snapshot_id", "rt_entity_id")),
]
CODE_LISTS = {
    "ref_accessibility": [c for c, *_ in ACCESSIBILITY],
    "ref_route_type": [c for c, _ in ROUTE_TYPES],
    "ref_exception_type": [c for c, _ in EXCEPTION_TYPES],
    "ref_pickup_drop": [c for c, _ in PICKUP_DROP],
    "ref_transfer_type": [c for c, _ in TRANSFER_TYPES],
    "ref_trip_schedule_relationship": [c for c, _ in TRIP_SCHEDULE_RELATIONSHIP],
    "ref_stop_schedule_relationship": [c for c, *_ in STOP_SCHEDULE_RELATIONSHIP],
    "ref_alert_cause": [c for c, _ in ALERT_CAUSES],
    "ref_alert_effect": [c for c, _ in ALERT_EFFECTS],
}
# (child, its column, code list)
CODE_REFERENCES = [
    ("station", "wheelchair_boarding", "ref_accessibility"),
    ("trip", "bikes_allowed", "ref_accessibility"),
    ("trip", "wheelchair_accessible", "ref_accessibility"),
    ("route", "route_type", "ref_route_type"),
    ("service_date", "exception_type", "ref_exception_type"),
    ("stop_time", "pickup_type", "ref_pickup_drop"),
    ("stop_time", "drop_off_type", "ref_pickup_drop"),
    ("transfer", "transfer_type", "ref_transfer_type"),
    ("rt_trip_update", "schedule_relationship", "ref_trip_schedule_relationship"),
    ("rt_stop_time_update", "schedule_relationship", "ref_stop_schedule_relationship"),
    ("rt_alert", "cause", "ref_alert_cause"),
    ("rt_alert", "effect", "ref_alert_effect"),
]
# (child, columns, domain, parent key or None) of every reference, in a fixed order
REFERENCES = [(c, cols, p, pk) for c, cols, p, pk in FOREIGN_KEYS] + [(c, (col,), ref, None) for c, col, ref in CODE_REFERENCES]
DOMAINS = list(dict.fromkeys(domain for *_, domain, _ in REFERENCES))
# a reference's place among those of its domain: the counter it is counted in
SLOT = {i: sum(r[2] == REFERENCES[i][2] for r in REFERENCES[:i]) for i in range(len(REFERENCES))}
SLOTS = max(SLOT.values()) + 1
PARENT = -1
CHUNK = 1 << 16


def _key(columns) -> str:
    """A key as text (SQL); only the last part of a compound key can hold a slash."""
    return "concat_ws('/', " + ", ".join(f"cast({c} AS string)" for c in columns) + ")"


def _built(t: dict[str, DataFrame], i: int) -> bool:
    child, cols, domain, parent_key = REFERENCES[i]
    here = child in t and set(cols) <= set(t[child].columns)
    return here and (parent_key is None or (domain in t and set(parent_key) <= set(t[domain].columns)))


def _tagged(t: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(domain, key, slot) of every parent key and every value that refers to one: one scan of each table."""
    built = [i for i in range(len(REFERENCES)) if _built(t, i)]
    wanted: dict[str, dict] = {}  # table -> its tags, each once
    for i in built:
        child, cols, domain, parent_key = REFERENCES[i]
        there = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        wanted.setdefault(child, {})[DOMAINS.index(domain), SLOT[i]] = (there, _key(cols))
        if parent_key:
            wanted.setdefault(domain, {})[DOMAINS.index(domain), PARENT] = ("true", _key(parent_key))
    parts = []
    for table, tags in wanted.items():
        rows = ", ".join(f"if({cond}, named_struct('domain', {d}, 'key', {k}, 'slot', {s}), null)" for (d, s), (cond, k) in tags.items())
        parts.append(t[table].selectExpr(f"inline(array_compact(array({rows})))"))
    codes = [(DOMAINS.index(ref), str(c), PARENT) for ref, known in CODE_LISTS.items() for c in known]
    parts.append(spark.createDataFrame(codes, "domain int, key string, slot int"))
    return reduce(DataFrame.unionByName, parts)


def missing_keys(t: dict[str, DataFrame]) -> DataFrame:
    """(reference, value, rows): the values that refer to no parent, with how many rows hold them."""
    spark = next(iter(t.values())).sparkSession
    slot = F.col("slot")
    groups = _tagged(t, spark).groupBy("domain", "key").agg(
        F.max(slot == PARENT).alias("known"), *[F.count(F.when(slot == s, 1)).alias(f"n{s}") for s in range(SLOTS)])
    number = F.create_map(*[F.lit(x) for i in SLOT for x in (DOMAINS.index(REFERENCES[i][2]) * SLOTS + SLOT[i], i)])
    counts = F.array(*[F.struct((F.col("domain") * SLOTS + s).alias("place"), F.col(f"n{s}").alias("rows")) for s in range(SLOTS)])
    return groups.filter(~F.col("known")).select("key", F.explode(F.filter(counts, lambda x: x["rows"] > 0)).alias("x")).select(
        number[F.col("x.place")].alias("reference"), F.col("key").alias("value"), F.col("x.rows").alias("rows"))


def _named(reference) -> list:
    said = lambda texts: F.element_at(F.array(*map(F.lit, texts)), reference + 1)
    return [said([r[0] for r in REFERENCES]).alias("child_table"), said([",".join(r[1]) for r in REFERENCES]).alias("fk_column"),
            said([r[2] for r in REFERENCES]).alias("parent_table")]


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """One row per violating child row: child_table, fk_column, parent_table, value."""
    lost = missing_keys(t)
    # a value may be missing for any number of rows: given out in chunks, so no array grows with them
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK)))
    lost = lost.withColumn("chunk", chunk)
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK), F.col("rows") - F.col("chunk") * CHUNK)))
    return lost.select(*_named(F.col("reference")), "value", one.alias("_")).drop("_")


def report(t: dict[str, DataFrame]) -> DataFrame:
    """One row per reference, violated or not: how many rows and how many different values have no parent."""
    spark = next(iter(t.values())).sparkSession
    per = missing_keys(t).groupBy("reference").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("values"))
    every = spark.createDataFrame([(i, _built(t, i)) for i in range(len(REFERENCES))], "reference int, built boolean")
    joined = F.broadcast(every).join(per, "reference", "left")  # the list of references
    status = F.when(~F.col("built"), "not built").when(F.col("rows") > 0, "violated").otherwise("holds")
    count = lambda c: F.when(F.col("built"), F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return joined.select(*_named(F.col("reference")), status.alias("status"), count("rows").alias("violating_rows"),
                         count("values").alias("missing_values"))
