"""The keyed table of newest observations, the ledger, and late rows."""

import copy
import json
import os

from pyspark.sql import functions as F

from quayline.operators import views
from quayline.sources import realtime_json as rj
from quayline.streaming import lateness, latest, snapshots
from tests.test_realtime import ALERT_DOC, TRIP_DOC, docs, write


def at(epoch, delay, doc=TRIP_DOC):
    out = copy.deepcopy(doc)
    out["header"]["timestamp"] = epoch
    out["entity"][0]["tripUpdate"]["stopTimeUpdate"][0]["departure"]["delay"] = delay
    return out


def rows(df):
    return sorted((tuple(r) for r in df.drop("fetched_at_utc").collect()), key=repr)


def test_the_table_equals_the_log_in_any_order(spark, tmp_path):
    src, root, log = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "log")
    epochs = [1736150400 + 600 * i for i in (3, 0, 4, 1, 2)]
    for n, epoch in enumerate(epochs):  # the newest snapshot is neither first nor last
        write(src, f"s{n}.json", at(epoch, epoch % 97))
        latest.run_latest(spark, src, root, str(tmp_path / "ck"))
    snapshots.run_ingest(spark, src, "trip-update", log, str(tmp_path / "ck2"))
    want = rows(views.newest_of(views.observations(snapshots.read_tables(spark, log))))
    assert rows(latest.read_latest(spark, root)) == want and len(want) == 5
    first = [r for r in latest.read_latest(spark, root).collect() if r.trip_id == "T1" and r.stop_sequence == 1]
    assert [r.departure_delay_s for r in first] == [max(epochs) % 97]
    # everything once more, by a stream that forgot its progress
    latest.run_latest(spark, src, root, str(tmp_path / "ck3"))
    assert rows(latest.read_latest(spark, root)) == want


def test_a_reader_in_progress_survives_the_removal(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "t")
    for i in range(4):
        write(src, f"s{i}.json", at(1736150400 + 600 * i, i))
        if i == 3:
            reading = latest.read_latest(spark, root)  # planned before the last commit
            before = rows(reading)
        latest.run_latest(spark, src, root, str(tmp_path / "ck"))
    assert len([d for d in os.listdir(f"{root}/data") if d.startswith("batch=")]) == 4
    assert latest.remove_replaced(spark, root) == 2 and latest.remove_replaced(spark, root) == 0
    assert rows(reading) == before  # its files are still there
    assert len(rows(latest.read_latest(spark, root))) == 5


def test_a_failed_merge_is_never_read(spark, tmp_path, monkeypatch):
    src, root = str(tmp_path / "in"), str(tmp_path / "t")
    write(src, "s0.json", at(1736150400, 1))
    latest.run_latest(spark, src, root, str(tmp_path / "ck"))
    before = rows(latest.read_latest(spark, root))
    snaps = rj.parse_documents(docs(spark, src), "trip-update")
    made = rj.shred_trip_updates(snaps, carry=("feed_timestamp_epoch", "fetched_at_utc"))
    observed = made["rt_stop_time_update"].join(made["rt_trip_update"].select("rt_entity_id", "trip_id", "start_date"), "rt_entity_id")
    observed = observed.withColumn("feed_timestamp_epoch", F.col("feed_timestamp_epoch") + 900).withColumn("departure_delay_s", F.lit(7))
    with monkeypatch.context() as m:
        real = latest.views.newest_of
        calls = []

        def broken(df):
            calls.append(1)
            out = real(df)
            return out if len(calls) < 2 else out.withColumn("stop_sequence", F.raise_error(F.lit("lost")).cast("int"))

        m.setattr(latest.views, "newest_of", broken)
        try:
            latest.upsert(observed, root)
        except Exception:  # the merged parts could not be written
            pass
    assert rows(latest.read_latest(spark, root)) == before
    latest.upsert(observed, root)
    assert {r.departure_delay_s for r in latest.read_latest(spark, root).collect()} == {7}


def test_the_ledger_counts_each_batch_once(spark, tmp_path, feed_tables):
    src, root = str(tmp_path / "in"), str(tmp_path / "log")
    write(src, "a.json", TRIP_DOC)
    write(src, "a_again.json", TRIP_DOC)
    write(src, "bad.json", {"header": {}, "entity": []})
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck"), trips=feed_tables["trip"])
    write(tmp_path / "al", "x.json", ALERT_DOC)
    snapshots.run_ingest(spark, str(tmp_path / "al"), "alert", root, str(tmp_path / "ck_al"))
    ledger = lambda: sorted(tuple(r) for r in snapshots.read_ledger(spark, root).drop("batch").collect())
    want = ledger()
    got = {r[1]: r for r in want}
    assert got["rt_trip_update"] == ("trip-update", "rt_trip_update", 3, 1, 1, 2, 1)
    assert got["rt_stop_time_update"][2:6] == (3, 1, 1, 5) and got["rt_alert_text"][5] == 2
    tables = snapshots.read_tables(spark, root)
    assert all(tables[name].count() == r[5] for name, r in got.items())
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck2"), trips=feed_tables["trip"])  # replay
    snapshots.compact(spark, root, "9999-12-31")
    assert ledger() == want
    assert [d for d in os.listdir(root) if d in ("_incoming", "_parsed") and os.listdir(f"{root}/{d}")] == []


def test_a_failed_batch_is_not_in_the_ledger(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    write(tmp_path / "f", "s1.json", TRIP_DOC)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            snapshots.append_snapshots(docs(spark, str(tmp_path / "f")), "trip-update", root)
        except RuntimeError:
            pass
    snapshots.append_snapshots(docs(spark, str(tmp_path / "f")), "trip-update", root)
    assert sorted(r.rows_written for r in snapshots.read_ledger(spark, root).collect()) == [2, 5]


def test_on_time_and_late_rows_make_up_the_batch_figure(spark, tmp_path):
    src, root, check, delay = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 3600
    base = 1736150400
    order = [0, 1800, 9000, 3600, 5400, 1800 + 60, 9000]  # 3600 is late (limit 5400), 5400 is not, 1860 is; 9000 repeats
    for n, offset in enumerate(order):
        write(src, f"s{n}.json", at(base + offset, n))
        lateness.run_history(spark, src, root, check, delay)
    got = {r.window_start_utc[11:16]: (r.observations, r.late_observations, r.closed) for r in lateness.history(spark, root, delay).collect()}
    assert got == {"08:00": (5, 0, True), "08:30": (5, 5, True), "09:00": (0, 5, True), "09:30": (5, 0, False), "10:30": (5, 0, False)}
    # a batch that runs again after a failure makes the same split
    lateness.split_batch(docs(spark, os.path.join(src, "s3.json")), 3, root, delay)
    again = {r.window_start_utc[11:16]: (r.observations, r.late_observations, r.closed) for r in lateness.history(spark, root, delay).collect()}
    assert again == got


def test_references_report_every_reference(spark, feed_tables):
    from quayline.operators import references

    t = dict(feed_tables)
    rep = {(r.child_table, r.fk_column): r for r in references.report(t).collect()}
    assert len(rep) == len(references.REFERENCES) == 30
    assert rep["stop_time", "trip_id"].status == "holds" and rep["rt_alert", "cause"].status == "not built"
    assert rep["rt_alert", "cause"].violating_rows is None
    hot = spark.range(3000).select(F.lit("GHOST").alias("trip_id"))
    calls = t["stop_time"].drop("trip_id").limit(1).crossJoin(hot).select(t["stop_time"].columns)
    t["stop_time"] = t["stop_time"].unionByName(calls)
    t["trip"] = t["trip"].withColumn("bikes_allowed", F.lit(9))
    rep = {(r.child_table, r.fk_column): (r.status, r.violating_rows, r.missing_values) for r in references.report(t).collect()}
    assert rep["stop_time", "trip_id"] == ("violated", 3000, 1) and rep["trip", "bikes_allowed"] == ("violated", 4, 1)
    assert rep["transfer", "from_stop_id"] == ("holds", 0, 0)
    lost = references.violations(t)
    assert lost.filter("value = 'GHOST'").count() == 3000 and lost.count() == 3004
    assert json.dumps(sorted({r.parent_table for r in lost.collect()})) == '["ref_accessibility", "trip"]'
