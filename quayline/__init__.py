"""quayline: timetable and punctuality analytics on Spark.

Layers (each a set of functions over DataFrames, no data held in objects):

* ``sources``    staged members (schedule feed CSV, driver tables, realtime JSON)
* ``operators``  cleaning rules with quarantine, semantic views, integrity checks
* ``functions``  column expressions shared by every layer (clock parse, rounding)
* ``plans``      the labelled analyses, explorer and profiling queries
* ``streaming``  Structured Streaming ingestion of realtime snapshots
"""

__version__ = "0.1.0"
