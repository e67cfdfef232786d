"""Ship this package to the executors' Python workers (once per SparkContext).

Only the schedule-feed expander runs Python inside tasks; its workers import
``quayline`` by name, so the package is zipped on the driver and distributed
with ``addPyFile`` (the standard way to put driver-side code on every executor).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quayline-pkg-"), "quayline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.join("quayline", os.path.relpath(full, pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
