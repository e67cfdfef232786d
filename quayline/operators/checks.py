"""X01-X21 integrity checks as one DataFrame: (check_id, check_name, value, passed, severity).

Every check is a count or a share and a predicate on it. The counts of a table come
from one aggregate over it and are turned into rows; the rows are unioned, so the
whole report is one Spark job graph and nothing loops over data on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions import clock_secs
from quayline.operators import references
from quayline.schemas import ACCESSIBILITY, ROUTE_TYPES
from quayline.session import grown

MATCH_WARNING_PCT = 80.0


# id: (name, what the value must be, severity)
CHECKS = {
    "X01": ("no foreign-key violations", "= 0", "error"),
    "X02": ("every platform has a station", "= 0", "error"),
    "X03": ("every call has a trip and a platform", "= 0", "error"),
    "X04": ("every trip has a service", "= 0", "error"),
    "X05": ("loaded + rejected = staged (calls)", "= 0", "warning"),
    "X06": ("departure_hour agrees with seconds", "= 0", "error"),
    "X07": ("seconds agree with the clock text", "= 0", "error"),
    "X08": ("is_boardable agrees with pickup_type", "= 0", "error"),
    "X09": ("day_of_week agrees with the date", "= 0", "error"),
    "X10": ("no call at 48 h or later survives", "= 0", "error"),
    "X11": ("departure view is not empty", "> 0", "error"),
    "X12": ("origin view is not empty", "> 0", "error"),
    "X13": ("frequency view covers every operating service", "= 0", "error"),
    "X14": ("amenity view covers every trip", "= 0", "error"),
    "X15": ("one origin per trip", "= 0", "error"),
    "X16": ("accessibility codes are defined", "= 0", "error"),
    "X17": ("route types are defined", "= 0", "error"),
    "X19": ("feed info is loaded", "> 0", "error"),
    "X21": ("realtime trips matching the timetable (%)", f">= {MATCH_WARNING_PCT}", "warning"),
}


def _values(one: DataFrame, **checks) -> DataFrame:
    """(check_id, value) rows from a one-row result: one column for each check."""
    rows = [F.struct(F.lit(i).alias("check_id"), F.coalesce(c.cast("double"), F.lit(0.0) if i != "X21" else F.lit(None))
                     .alias("value")) for i, c in checks.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _hits(cond=None) -> F.Column:
    return F.count(F.lit(1) if cond is None else F.when(cond, 1))


def check_values(t: dict[str, DataFrame]) -> DataFrame:
    """(check_id, value) of all checks: every table is read once, but for the references."""
    from quayline.plans.common import beside

    codes = [c for c, *_ in ACCESSIBILITY]
    dep, arr, col = F.col("departure_secs"), F.col("arrival_secs"), F.col
    lost = lambda child, *cols: F.sum(F.when((col("child_table") == child) & col("fk_column").isin(*cols), col("violating_rows")))
    refs = references.report(t).agg(
        F.sum("violating_rows").alias("all"), lost("platform", "station_id").alias("platform"),
        lost("stop_time", "trip_id", "stop_id").alias("call"), lost("trip", "service_id").alias("trip"))
    calls = beside(
        t["stop_time"].agg(
            _hits().alias("loaded"), _hits(dep.isNotNull() & (col("departure_hour") != (dep / 3600).cast("int") % 24)).alias("x06"),
            _hits(col("departure_time").isNotNull() & ~dep.eqNullSafe(clock_secs("departure_time"))).alias("x07"),
            _hits(col("is_boardable") != F.when(col("pickup_type") == 1, 0).otherwise(1)).alias("x08"),
            _hits(F.coalesce(dep, arr) >= 172800).alias("x10")),
        t["stg_stop_times"].agg(_hits().alias("staged")),
        t["rejected_row"].agg(_hits(col("source_table") == "stg_stop_times").alias("rejected")))
    uncovered = lambda child, view, key: child.select(key).distinct().join(
        grown(t[view].select(key)), key, "left_anti").agg(_hits().alias("n"))
    # updates of a trip are one row before they meet the timetable: a hot trip is no hot task
    updates = t["rt_trip_update"].groupBy("trip_id").agg(_hits().alias("updates"))
    matched = updates.join(grown(t["trip"].select(col("trip_id").alias("_k"), F.lit(1).alias("_known"))), col("trip_id") == col("_k"), "left").agg(
        F.coalesce(F.sum(F.when(col("_known") == 1, col("updates"))), F.lit(0)).alias("m"), F.sum("updates").alias("n"))
    active = t["service_date"].filter(col("exception_type") == 1)
    parts = [
        _values(refs, X01=col("all"), X02=col("platform"), X03=col("call"), X04=col("trip")),
        _values(calls, X05=col("staged") - col("loaded") - col("rejected"), X06=col("x06"), X07=col("x07"), X08=col("x08"),
                X10=col("x10")),
        _values(t["service_date"].agg(_hits(col("day_of_week") != F.dayofweek("service_date") - 1).alias("n")), X09=col("n")),
        _values(t["v_departure"].agg(_hits().alias("n")), X11=col("n")),
        _values(t["v_trip_origin"].agg(_hits().alias("n"), F.count_distinct("trip_id").alias("d")),
                X12=col("n"), X15=col("n") - col("d")),
        _values(uncovered(active, "v_service_frequency", "service_id"), X13=col("n")),
        _values(uncovered(t["trip"], "v_trip_amenity", "trip_id"), X14=col("n")),
        _values(beside(
            t["trip"].agg(_hits(~col("bikes_allowed").isin(*codes) | ~col("wheelchair_accessible").isin(*codes)).alias("a")),
            t["station"].agg(_hits(~col("wheelchair_boarding").isin(*codes)).alias("b"))), X16=col("a") + col("b")),
        _values(t["route"].agg(_hits(~col("route_type").isin(*[c for c, _ in ROUTE_TYPES])).alias("n")), X17=col("n")),
        _values(t["feed_info"].agg(_hits().alias("n")), X19=col("n")),
        _values(matched, X21=F.lit(100.0) * col("m").cast("double") / F.nullif(col("n"), F.lit(0)).cast("double")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _passed(pred: str) -> F.Column:
    op, num = pred.split()
    v, n = F.col("value"), float(num)
    return {"=": v == n, ">": v > n, ">=": v >= n}[op]


def check_table(t: dict[str, DataFrame]) -> DataFrame:
    said = lambda k: F.create_map(*[x for i, c in CHECKS.items() for x in (F.lit(i), F.lit(c[k]))])[F.col("check_id")]
    passed = reduce(lambda x, i: x.when(F.col("check_id") == i, _passed(CHECKS[i][1])), CHECKS, F)
    return check_values(t).select(
        "check_id", said(0).alias("check_name"), "value", F.coalesce(passed, F.lit(False)).alias("passed"),
        said(2).alias("severity"))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("value"))


def run_log_checks(t: dict[str, DataFrame]) -> DataFrame:
    """X18 and X20 over the run log written by the build (no oracle: the log is ours)."""
    runs = t["ingestion_run"]
    ok = runs.filter(F.col("status") == "success").agg(F.count(F.lit(1)).cast("double").alias("value"))
    orphan = t["rejected_row"].select("run_id").join(runs.select("run_id"), "run_id", "left_anti")
    return ok.select(
        F.lit("X18").alias("check_id"), F.lit("a successful run exists").alias("check_name"), "value",
        (F.col("value") > 0).alias("passed"), F.lit("error").alias("severity"),
    ).unionByName(_count(orphan).select(
        F.lit("X20").alias("check_id"), F.lit("every rejected row has a run").alias("check_name"), "value",
        (F.col("value") == 0).alias("passed"), F.lit("error").alias("severity"),
    ))
