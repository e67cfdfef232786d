"""Snapshots of any size: no row that is written, shuffled or read back holds a whole document."""

import copy
import json
import os

import pytest
from pyspark.sql import functions as F

from quayline.sources import driver_tables
from quayline.sources import realtime_json as rj
from quayline.streaming import snapshots
from tests.test_grown_joins import joins, realtime, trip_table
from tests.test_realtime import ALERT_DOC, TRIP_DOC, docs, write


def delivered(spark, path):
    """Five documents of three snapshots (two equal, one other of the same time), one refused, one without entities."""
    other = copy.deepcopy(TRIP_DOC)
    other["entity"] = other["entity"][:1]
    later = copy.deepcopy(TRIP_DOC)
    later["header"]["timestamp"] += 1800
    made = [TRIP_DOC, TRIP_DOC, other, later, {"header": {}, "entity": TRIP_DOC["entity"]}, {"header": {"timestamp": 1736160000}}]
    for n, doc in enumerate(made):
        write(path, f"d{n}.json", doc)
    return docs(spark, str(path))


def held(spark, root):
    return {name: sorted((tuple(r) for r in df.drop("fetched_at_utc").collect()), key=repr)
            for name, df in snapshots.read_tables(spark, root).items()}


def test_what_a_batch_stages_is_a_row_per_entity(spark, tmp_path, monkeypatch):
    given, root = delivered(spark, tmp_path / "in"), str(tmp_path / "log")
    monkeypatch.setattr(snapshots, "delete", lambda *_: None)
    snapshots.append_snapshots(given, "trip-update", root)
    for folder, rows, entities in (("_parsed", 14, 13), ("_incoming", 7, 6)):
        staged = spark.read.parquet(*[f"{root}/{folder}/{b}" for b in os.listdir(f"{root}/{folder}")])
        assert staged.count() == rows and staged.filter(F.col("e").isNotNull()).count() == entities
        assert not [f.name for f in staged.schema if f.dataType.typeName() == "array"]


@pytest.mark.parametrize("at_once", [1 << 18, 0])
def test_the_choice_is_that_of_whole_documents(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(snapshots, "DOCUMENTS_AT_ONCE", at_once)
    given, root = delivered(spark, tmp_path / "in"), str(tmp_path / "log")
    want = rj.shred(rj.register_snapshots(rj.parse_documents(given, "trip-update"), None), "trip-update")
    snapshots.append_snapshots(given, "trip-update", root)
    got = held(spark, root)
    assert {k: len(v) for k, v in got.items()} == {"rt_snapshot": 3, "rt_trip_update": 4, "rt_stop_time_update": 10}
    assert got == {name: sorted((tuple(r) for r in df.select(*snapshots.read_tables(spark, root)[name].columns).drop(
        "fetched_at_utc").collect()), key=repr) for name, df in want.items()}
    ledger = {r.table_name: (r.documents, r.refused, r.already_held, r.rows_written) for r in snapshots.read_ledger(spark, root).collect()}
    assert ledger == {"rt_trip_update": (6, 1, 2, 4), "rt_stop_time_update": (6, 1, 2, 10)}
    snapshots.append_snapshots(given, "trip-update", root)  # all of them again
    assert held(spark, root) == got


def test_alerts_without_entities_are_snapshots_too(spark, tmp_path):
    write(tmp_path / "al", "a.json", ALERT_DOC)
    write(tmp_path / "al", "b.json", {"header": {"timestamp": 1736150600}, "entity": []})
    root = str(tmp_path / "log")
    snapshots.append_snapshots(docs(spark, str(tmp_path / "al")), "alert", root)
    got = held(spark, root)
    assert len(got["rt_snapshot"]) == 2 and len(got["rt_alert"]) == 2 and len(got["rt_alert_text"]) == 2


def test_trips_are_merge_joined_with_their_updates(spark, tmp_path, monkeypatch):
    kinds, append = [], snapshots._append
    monkeypatch.setattr(snapshots, "_append", lambda df, *a: (kinds.extend(joins(df, "trip_id")), append(df, *a)))
    metrics = snapshots.append_snapshots(delivered(spark, tmp_path / "in"), "trip-update", str(tmp_path / "log"),
                                         trips=trip_table(spark, tmp_path / "trip"))
    assert kinds == ["SortMergeJoin"] and metrics == {"trip_updates": 4, "matched": 2}


def test_documents_are_gathered_one_after_the_other(spark, tmp_path):
    rt = realtime(spark, tmp_path, ["T1", None])
    made = driver_tables.snapshot_documents(rt["rt_trip_update"], rt["rt_stop_time_update"], keep_id=True)
    assert joins(made, "snapshot_id") == ["SortMergeJoin"]
    with rj.one_document_at_a_time(spark):
        plan = made.select("doc")._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
    update = {"stopId": "P1", "stopSequence": 1, "scheduleRelationship": 0, "arrival": {"delay": 30}, "departure": {"delay": 30}}
    got = {r.snapshot_id: json.loads(r.doc) for r in made.collect()}
    assert got == {i: {"header": {"timestamp": 900 * i}, "entity": [{"id": f"e{i // 2}", "tripUpdate": {
        "trip": {"startDate": "20250106"} | ({} if i else {"tripId": "T1"}), "stopTimeUpdate": [update]}}]} for i in (0, 2)}
