"""Print the physical-plan facts of the central operators (for PLANS.md).

Usage: python tools/plans.py [sf_dir]   (default /root/testdata/sf0.1)
For each plan: exchanges (shuffles), join strategies, aggregates and the
filters/columns that reach the Parquet scans.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from quayline import pipeline  # noqa: E402
from quayline.operators import views  # noqa: E402
from quayline.plans import registry  # noqa: E402
from quayline.session import local_session  # noqa: E402

KEEP = re.compile(r"(Exchange|Join|Aggregate|Window|Expand|Scan parquet|PushedFilters|ReadSchema|TakeOrdered)")


def facts(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if KEEP.search(line):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r", \[plan_id=\d+\]", "", line)
            out.append(line[:190])
            if "FileScan" in line:
                pad = " " * (len(line) - len(line.lstrip()) + 6)
                for key in ("PartitionFilters", "PushedFilters", "ReadSchema"):
                    m = re.search(key + r": (\[[^\]]*\]|struct<[^ ]*)", line)
                    if m:
                        out.append(f"{pad}{key}: {m.group(1)[:150]}")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    spark.sparkContext.setLogLevel("ERROR")
    t = pipeline.core(spark, sf)
    from quayline.operators import clean

    items = [
        ("build: call screening (T15-T21) over the staged calls",
         clean.screen_stop_times(t["stg_stop_times"], t["trip"], t["platform"])),
        ("build: V01 departures", views.departures(t)),
        ("build: V03 trip origin", views.trip_origin(t["v_departure"])),
        ("build: V07 latest observation per call", views.rt_departure_performance(t, t)),
    ] + [(f"query: {q}", registry.QUERIES[q](t)) for q in [
        "a01_annualised_departures_by_hour", "a06_platform_ranking", "a12_morning_destinations_ranked",
        "a21_trip_weighted", "a35_hub_punctuality", "p14_calls_by_calendar_date", "d13_fk_violations",
    ]]
    for title, df in items:
        print(f"### {title}\n\n```")
        print("\n".join(facts(df)))
        print("```\n")


if __name__ == "__main__":
    main()
