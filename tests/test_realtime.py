"""Realtime shredding, total helpers, and replay-safe streaming ingestion."""

import json
import os

from pyspark.sql import functions as F

from quayline.sources import realtime_json as rj
from quayline.streaming import snapshots

TRIP_DOC = {
    "header": {"gtfsRealtimeVersion": "2.0", "timestamp": 1736150400},
    "entity": [
        {"id": "e1", "tripUpdate": {
            "trip": {"tripId": "T1", "startDate": "20250106", "scheduleRelationship": 0},
            "timestamp": {"low": 1736150400, "high": 0, "unsigned": True},
            "stopTimeUpdate": [
                {"stopId": "P1a", "stopSequence": 1, "departure": {"delay": 0}},
                {"stopId": "P2a", "stopSequence": 2, "departure": {"delay": 119}},
                {"stopId": "P2a", "stopSequence": 2, "departure": {"delay": 120}},
                {"stopId": "P2b", "scheduleRelationship": 2},
            ]}},
        {"id": "e2", "tripUpdate": {"trip": {"tripId": "UNKNOWN", "startDate": "20250106"},
                                    "stopTimeUpdate": [{"stopSequence": 1, "scheduleRelationship": 1, "stopId": "P1a"}]}},
        {"id": "e3"},
    ],
}
ALERT_DOC = {
    "header": {"timestamp": "1736150500"},
    "entity": [
        {"id": "a1", "alert": {"cause": 9, "effect": 3, "url": "http://bare.example",
                               "headerText": {"translation": [
                                   {"language": "fr", "text": "Travaux"}, {"language": "nl", "text": "Werken"},
                                   {"language": "fr", "text": "Autre"}, {"language": "en", "text": ""}]},
                               "activePeriod": [{"start": 1736150000, "end": 1736160000}],
                               "informedEntity": [{"stopId": "P1a"}, {"trip": {"tripId": "T1"}}]}},
        {"id": "a2", "alert": {"cause": 1, "effect": 1, "headerText": {"translation": []},
                               "url": {"translation": [{"language": "fr", "text": "http://u.example"}]}}},
    ],
}


def write(dirpath, name, doc):
    os.makedirs(dirpath, exist_ok=True)
    with open(os.path.join(dirpath, name), "w") as f:
        f.write(json.dumps(doc))


def docs(spark, path):
    return rj.read_documents(spark, path)


def test_helpers_are_total(spark):
    row = spark.createDataFrame(
        [("12", '{"low": -1, "high": 0}', "20250106", " ", '{"translation": [{"text": "x"}]}', '"bare"', "{}")],
        "a string, b string, c string, d string, e string, f string, g string",
    ).select(
        rj.to_long(F.col("a")).alias("a"), rj.to_long(F.col("b")).alias("b"), rj.gtfs_date_text(F.col("c")).alias("c"),
        rj.gtfs_date_text(F.col("d")).alias("d"), rj.first_text(F.col("e")).alias("e"),
        rj.first_text(F.col("f")).alias("f"), rj.first_text(F.col("g")).alias("g"),
        rj.epoch_to_iso(F.lit(1736150400)).alias("iso"), rj.epoch_to_iso(F.lit(-5)).alias("bad"),
        rj.to_long(F.lit("junk")).alias("junk"),
    ).first()
    assert row["a"] == 12 and row["b"] == 4294967295  # unsigned low word
    assert row["c"] == "2025-01-06" and row["d"] is None
    assert row["e"] == "x" and row["f"] == "bare" and row["g"] is None
    assert row["iso"] == "2025-01-06T08:00:00Z" and row["bad"] is None and row["junk"] is None


def test_trip_update_shredding(spark, tmp_path):
    write(tmp_path / "tu", "s1.json", TRIP_DOC)
    snaps = rj.register_snapshots(rj.parse_documents(docs(spark, str(tmp_path / "tu")), "trip-update"), None)
    out = rj.shred(snaps, "trip-update")
    snap = out["rt_snapshot"].first()
    assert snap["feed_timestamp_epoch"] == 1736150400 and snap["entity_count"] == 3
    trips = {r["rt_entity_id"]: r for r in out["rt_trip_update"].collect()}
    assert set(trips) == {"e1", "e2"}  # entity without tripUpdate skipped
    assert trips["e1"]["timestamp_epoch"] == 1736150400  # {low, high} decoded
    assert trips["e1"]["start_date"] == "2025-01-06"
    seqs = sorted((r["rt_entity_id"], r["stop_sequence"]) for r in out["rt_stop_time_update"].collect())
    assert seqs == [("e1", -4), ("e1", -3), ("e1", 1), ("e1", 2), ("e2", 1)]


def test_alert_shredding(spark, tmp_path):
    write(tmp_path / "al", "a1.json", ALERT_DOC)
    snaps = rj.register_snapshots(rj.parse_documents(docs(spark, str(tmp_path / "al")), "alert"), None)
    out = rj.shred(snaps, "alert")
    urls = {r["rt_entity_id"]: r["url"] for r in out["rt_alert"].collect()}
    assert urls == {"a1": "http://bare.example", "a2": "http://u.example"}
    texts = sorted((r["language"], r["text"]) for r in out["rt_alert_text"].collect())
    assert texts == [("fr", "Travaux"), ("nl", "Werken")]  # first fr wins, blank en skipped
    assert out["rt_alert_informed_entity"].count() == 2
    assert out["rt_alert_active_period"].first()["end_epoch"] == 1736160000


def test_stream_ingest_is_replay_safe(spark, tmp_path):
    src = str(tmp_path / "incoming")
    root = str(tmp_path / "log")
    write(src, "s1.json", TRIP_DOC)
    write(src, "s1_again.json", TRIP_DOC)  # same header timestamp: one snapshot
    no_ts = {"header": {}, "entity": TRIP_DOC["entity"]}
    write(src, "no_ts.json", no_ts)  # refused
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck1"))
    first = snapshots.read_tables(spark, root)
    n_snap, n_upd = first["rt_snapshot"].count(), first["rt_stop_time_update"].count()
    assert n_snap == 1 and n_upd == 5
    # replay everything from scratch (new checkpoint = the stream forgot its progress)
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck2"))
    again = snapshots.read_tables(spark, root)
    assert again["rt_snapshot"].count() == 1 and again["rt_stop_time_update"].count() == 5
    # a late, older snapshot is history and is kept
    older = dict(TRIP_DOC, header={"timestamp": 1736140000})
    write(src, "older.json", older)
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck1"))
    assert snapshots.read_tables(spark, root)["rt_snapshot"].count() == 2


def test_latest_observation_wins(spark, tmp_path, feed_tables):
    src = str(tmp_path / "in")
    root = str(tmp_path / "log")
    write(src, "old.json", TRIP_DOC)
    newer = json.loads(json.dumps(TRIP_DOC))
    newer["header"]["timestamp"] = 1736150700
    newer["entity"][0]["tripUpdate"]["stopTimeUpdate"][0]["departure"]["delay"] = 300
    write(src, "new.json", newer)
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck"))
    from quayline.operators import views

    t = dict(feed_tables)
    t.update(snapshots.read_tables(spark, root))
    perf = views.rt_departure_performance(t, t)
    r = perf.filter((F.col("trip_id") == "T1") & (F.col("stop_sequence") == 1)).first()
    assert r["departure_delay_s"] == 300 and r["is_on_time"] == 0
    assert perf.filter(F.col("trip_id") == "UNKNOWN").count() == 0  # drift dropped by the inner join
    r2 = perf.filter((F.col("trip_id") == "T1") & (F.col("stop_sequence") == 2)).first()
    assert r2["departure_delay_s"] == 119 and r2["is_on_time"] == 1  # 119 s is on time
    r3 = perf.filter((F.col("trip_id") == "T1") & (F.col("stop_sequence") == -4)).first()
    assert r3["has_no_data"] == 1 and r3["is_on_time"] is None and r3["is_skipped"] == 0


def test_delay_history_stream(spark, tmp_path):
    src = str(tmp_path / "hist")
    write(src, "s1.json", TRIP_DOC)
    write(src, "s1_again.json", TRIP_DOC)  # the same snapshot, fetched twice
    later = json.loads(json.dumps(TRIP_DOC))
    later["header"]["timestamp"] = 1736150400 + 5 * 86400  # closes the first window
    write(src, "s2.json", later)
    q = (snapshots.delay_history_stream(spark, src).writeStream.format("memory").queryName("ql_delay_hist")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ckh"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM ql_delay_hist").collect()
    assert len(rows) == 1
    assert sum(r["observations"] for r in rows) == 5
    assert sum(r["on_time"] for r in rows) == 2  # delays 0 and 119; 120 is late, e2 is skipped


def test_match_rate_is_observed_not_enforced(spark, tmp_path, feed_tables):
    write(tmp_path / "m", "s1.json", TRIP_DOC)
    metrics = snapshots.append_snapshots(docs(spark, str(tmp_path / "m")), "trip-update", str(tmp_path / "log"),
                                         trips=feed_tables["trip"])
    assert metrics["trip_updates"] == 2 and metrics["matched"] == 1  # UNKNOWN is kept in the log
    assert snapshots.read_tables(spark, str(tmp_path / "log"))["rt_trip_update"].count() == 2


def test_compaction_keeps_every_snapshot_once(spark, tmp_path):
    src = str(tmp_path / "c_in")
    root = str(tmp_path / "c_log")
    write(src, "day1.json", TRIP_DOC)  # 2025-01-06
    day2 = json.loads(json.dumps(TRIP_DOC))
    day2["header"]["timestamp"] = 1736150400 + 86400  # 2025-01-07
    write(src, "day2.json", day2)
    snapshots.run_ingest(spark, src, "trip-update", root, str(tmp_path / "ck"))
    before = {k: v.count() for k, v in snapshots.read_tables(spark, root).items()}
    snapshots.compact(spark, root, "2025-01-06")
    snapshots.compact(spark, root, "2025-01-06")  # idempotent
    after = snapshots.read_tables(spark, root)
    assert {k: v.count() for k, v in after.items()} == before
    log = snapshots.read_log(spark, root)
    assert {(r["feed_timestamp_epoch"], r["version"]) for r in log.collect()} == {(1736150400, 1), (1736150400 + 86400, 0)}


def test_late_snapshot_survives_compaction(spark, tmp_path):
    src, root, check = str(tmp_path / "l_in"), str(tmp_path / "l_log"), str(tmp_path / "l_ck")
    write(src, "day1.json", TRIP_DOC)
    snapshots.run_ingest(spark, src, "trip-update", root, check)
    snapshots.compact(spark, root, "2025-01-06")
    late = json.loads(json.dumps(TRIP_DOC))
    late["header"]["timestamp"] = 1736150400 + 600  # the same day, after its compaction
    write(src, "late.json", late)
    snapshots.run_ingest(spark, src, "trip-update", root, check)
    counts = lambda: {k: v.count() for k, v in snapshots.read_tables(spark, root).items()}
    want = counts()
    assert want["rt_snapshot"] == 2 and want["rt_trip_update"] == 4
    snapshots.compact(spark, root, "2025-01-06")
    assert counts() == want
    assert snapshots.compact(spark, root, "2025-01-06") == 0
    assert {r["version"] for r in snapshots.read_log(spark, root).collect()} == {1}


def test_failed_batch_is_never_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "f_log")
    write(tmp_path / "f", "s1.json", TRIP_DOC)

    def broken(*_):
        raise RuntimeError("lost before the log was written")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", broken)
        try:
            snapshots.append_snapshots(docs(spark, str(tmp_path / "f")), "trip-update", root)
        except RuntimeError:
            pass
    snapshots.append_snapshots(docs(spark, str(tmp_path / "f")), "trip-update", root)
    got = snapshots.read_tables(spark, root)
    assert got["rt_trip_update"].count() == 2 and got["rt_stop_time_update"].count() == 5


def test_first_batch_without_snapshots(spark, tmp_path):
    src, root, check = str(tmp_path / "e_in"), str(tmp_path / "e_log"), str(tmp_path / "e_ck")
    write(src, "bad.json", {"header": {}, "entity": []})  # no header timestamp: refused
    snapshots.run_ingest(spark, src, "trip-update", root, check)
    write(src, "good.json", TRIP_DOC)
    snapshots.run_ingest(spark, src, "trip-update", root, check)
    assert snapshots.read_tables(spark, root)["rt_snapshot"].count() == 1


def test_same_snapshot_twice_picks_one_document_for_all_tables(spark, tmp_path):
    other = json.loads(json.dumps(TRIP_DOC))
    other["entity"] = other["entity"][:1]
    write(tmp_path / "w", "b.json", other)
    write(tmp_path / "w", "a.json", TRIP_DOC)
    parsed = rj.parse_documents(docs(spark, str(tmp_path / "w")), "trip-update")
    picks = {rj.register_snapshots(parsed.repartition(n), None).first()["entity_count"] for n in (1, 2, 5)}
    assert len(picks) == 1


def test_texts_without_language_are_skipped(spark, tmp_path):
    texts = {"translation": [{"text": "no language"}, {"language": "", "text": "blank"}, {"language": "fr", "text": "oui"}]}
    doc = {"header": {"timestamp": 1736150400}, "entity": [{"id": "a", "alert": {"headerText": texts}}]}
    write(tmp_path / "t", "a.json", doc)
    snaps = rj.register_snapshots(rj.parse_documents(docs(spark, str(tmp_path / "t")), "alert"), None)
    got = rj.shred(snaps, "alert")["rt_alert_text"].collect()
    assert [(r["language"], r["text"]) for r in got] == [("fr", "oui")]
