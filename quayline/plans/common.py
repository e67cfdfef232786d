"""Shared pieces of the analyses: weights, hub parameters, window helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.operators import views

# Parameters of the station questions. The reference names Belgian stations;
# over the driver tables the stations are nations, so the defaults are five of them.
FOCUS_STATION = "NATION_1"
HUBS = ("NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4")
MORNING_SECS = 12 * 3600


def spark_of(t) -> SparkSession:
    """The session of the tables, without asking for one that must be built (``Core`` names the others first)."""
    return t[next(iter(t))].sparkSession


def everything():
    """Unpartitioned window: only ever applied to already-aggregated rows."""
    return Window.partitionBy()


def weighted(dep: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Rows (departures, origins, trips) carrying ``operating_days`` of their service.

    Inner join: a trip whose service has no added date has no row, as in V02.

    Joining on the service grain is the same as joining on the trip grain (a trip
    inherits its service's days) but the build side has one row per service.
    """
    days = t["service_days"] if "service_days" in t else views.service_days(t)
    return dep.join(days.select("service_id", "operating_days"), "service_id")


def morning_origins(t: dict[str, DataFrame], headsign_required: bool = True) -> DataFrame:
    o = weighted(t["v_trip_origin"], t)
    cond = (F.col("departure_secs") < MORNING_SECS) & (F.col("day_offset") == 0)
    if headsign_required:
        cond = cond & F.col("trip_headsign").isNotNull()
    return o.filter(cond)


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def rank_desc(*cols) -> F.Column:
    return F.rank().over(Window.orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in cols])).cast("long")


def beside(df: DataFrame, *scalars: DataFrame) -> DataFrame:
    """Attach one-row results (global aggregates: exactly one row each) to ``df``.

    This is SQL's uncorrelated scalar subquery. The one-row sides are broadcast,
    so ``df`` is neither shuffled nor multiplied.
    """
    for one in scalars:
        df = df.join(F.broadcast(one), how="cross")
    return df
