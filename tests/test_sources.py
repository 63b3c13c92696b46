"""Files, configuration, tables and streams of events."""

import json
import os

import pytest
from pyspark.sql import functions as F

from zonewatch.functions.clock import iso_millis_us
from zonewatch.operators import alerts as A
from zonewatch.operators import motion as M
from zonewatch.plans.flow import detect_frames
from zonewatch.sources import config as C
from zonewatch.sources import messages as MSG
from zonewatch.sources import tables as TS
from zonewatch.streaming import sinks as K
from zonewatch.streaming import stateful as ST

from .test_operators import EVENT, event
from .test_timeline import model_tracks

S = 1_000_000


def run(stream, tmp_path, name, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(240)


def files(spark, df, order, parts, folder):
    """Split rows into Parquet files that a stream reads one by one, in time order."""
    rows = [r.asDict() for r in df.orderBy(order).collect()]
    steps = sorted({r[order] for r in rows})
    size = -(-len(steps) // parts)
    for i in range(parts):
        mine = set(steps[i * size:(i + 1) * size])
        spark.createDataFrame([r for r in rows if r[order] in mine], df.schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i:02d}"))
        for f in (folder / f"p{i:02d}").iterdir():
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_refresh_keeps_the_last_good(spark):
    now, calls = [0.0], []

    def load():
        calls.append(now[0])
        if len(calls) == 2:
            raise OSError("gone")
        return spark.range(len(calls))

    get = C.refreshing_dimension(load, 10, clock=lambda: now[0])
    assert get().count() == 1
    now[0] = 9.9
    get()
    assert len(calls) == 1
    now[0] = 10.0
    assert get().count() == 1 and len(calls) == 2
    assert get().count() == 3


def test_camera_catalog_and_labels(spark, tmp_path):
    (tmp_path / "cams.json").write_text("\n".join(json.dumps(c) for c in [
        {"camera_id": "a", "location_id": "l", "name": "A", "source_url": "u", "source_type": "file"},
        {"camera_id": "b", "location_id": "l", "name": "B", "source_url": "u", "enabled": False}]))
    rows = C.read_camera_catalog(spark, str(tmp_path / "cams.json")).collect()
    assert [(r.camera_id, r.source_type, r.target_fps, r.frame_w, r.encoding) for r in rows] == [("a", "FILE", 10.0, 1280, "JPEG")]
    (tmp_path / "truth.csv").write_text("video,zone,event_type,start_s,end_s,note\nv.mp4,Kho,loitering,4,26,x y\nw.mp4,Kho,none,0,0,\n")
    truth = MSG.read_ground_truth(spark, str(tmp_path / "truth.csv")).collect()
    assert (truth[0].start_s, truth[0].end_s, truth[1].event_type) == (4.0, 26.0, "none")


def test_table_snapshots(spark, tmp_path):
    root = str(tmp_path)
    TS.write_table(spark.range(5), root, "t")
    old = TS.read_table(spark, root, "t")
    TS.write_table(old.where("id > 2"), root, "t")
    assert sorted(r.id for r in TS.read_table(spark, root, "t", "id < 9").collect()) == [3, 4]
    assert old.count() == 5  # a reader of the old snapshot is not disturbed


def test_media_stay_below_the_root(spark, tmp_path):
    (tmp_path / "media" / "c").mkdir(parents=True)
    (tmp_path / "media" / "c" / "x.jpg").write_bytes(b"abc")
    (tmp_path / "secret.jpg").write_bytes(b"no")
    ev = spark.createDataFrame([("1", "c/x.jpg"), ("2", "../secret.jpg"), ("3", "/etc/hosts"), ("4", None)], "id string, storage_key string")
    got = TS.evidence_media(spark, str(tmp_path / "media"), ev).collect()
    assert [(r.id, bytes(r.content)) for r in got] == [("1", b"abc")]
    assert TS.evidence_media(spark, str(tmp_path / "none"), ev).count() == 0
    assert TS.evidence_media(spark, str(tmp_path / "media"), ev.limit(0)).columns == ["id", "storage_key", "content", "bytes"]


def test_media_by_key(spark, tmp_path, monkeypatch):
    """Ties, missing and empty files, folders, clashing names and keys with blanks; batches smaller than a file."""
    root = tmp_path / "a store"
    stored = [(f"c{i % 3}/d %20/{i}.jpg", bytes([i]) * (i * 1000)) for i in range(40)] + [(None, b"x"), ("../y", b"x"), ("null", None)]
    n = TS.write_media(spark, str(root), spark.createDataFrame(stored, "storage_key string, content binary"))
    assert n == 40 and not (tmp_path / "y").exists()
    asked = [(k, k, 7) for k, _ in stored[:30]] + [("again", stored[3][0], 7)] * 5 + [("gone", "c0/none.jpg", 7), ("folder", "c0", 7)]
    rows = spark.createDataFrame(asked, "id string, storage_key string, bytes int")
    monkeypatch.setattr(TS, "MEDIA_BYTES", 5000)
    got = sorted((r.id, r.bytes, bytes(r.content)) for r in TS.evidence_media(spark, str(root), rows, tasks=3).collect())
    held = dict(stored)
    want = sorted((i, len(held[k]), held[k]) for i, k, _ in asked if k in held)
    assert got == want and len(got) == 35


def test_detector_hook(spark):
    def factory():
        return lambda image: [
            {"class_id": 0, "class_name": "person", "confidence": len(image) / 10, "bbox_xyxy": [0, 0, 10, 20]},
            {"class_id": 9, "class_name": "dog", "confidence": 0.9, "bbox_xyxy": [0, 0, 1, 1]}]

    frames = spark.createDataFrame([("c", 1, b"12345"), ("c", 2, b"1")], "camera_id string, seq bigint, image binary")
    got = {r.seq: r.detections for r in detect_frames(frames, factory).collect()}
    assert [d.class_name for d in got[1]] == ["person"] and got[1][0].confidence == 0.5 and got[2] == []


def test_split_late(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 4)], "camera_id string, us bigint")
    on_time, late = K.split_late(batch, 3)
    assert (on_time.count(), late.count()) == (2, 3)


def test_dedup_and_delivery(spark, tmp_path):
    rows = spark.createDataFrame([(i % 4, 10 * i * S) for i in range(8)], "id bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    src = tmp_path / "in"
    src.mkdir()
    run(K.dedup_stream(files(spark, rows, "us", 2, src), "id"), tmp_path, "dedup")
    assert sorted(r.id for r in spark.table("dedup").collect()) == [0, 1, 2, 3]
    calls, got = [], []

    def sink(df, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise OSError("try again")
        got.extend(r.us for r in df.collect())

    q = K.publish_events(files(spark, rows, "us", 2, tmp_path / "in2"), sink, str(tmp_path / "ck"), str(tmp_path / "log"), wait_s=0)
    q.awaitTermination(120)
    assert len(got) == 8
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert sorted((r.batch_id, r.ok, r.attempts, r.events) for r in log) == [(0, True, 2, 4), (1, True, 1, 4)]


def test_stream_tracks(spark, tmp_path):
    import random

    r = random.Random(5)
    data = []
    for cam in ("a", "b"):
        for seq in range(60):
            for i in range(r.randrange(0, 4)):
                x = float(r.randrange(0, 100))
                data.append((cam, seq, i, r.choice(["person", "car"]), r.randrange(10) / 10, (x, 0.0, x + 40, 100.0)))
    df = spark.createDataFrame([(*d, d[1] * S) for d in data],
                               "camera_id string, seq bigint, det_index int, class_name string, confidence double, "
                               "bbox struct<x1:double,y1:double,x2:double,y2:double>, us bigint")
    (tmp_path / "in").mkdir()
    run(ST.stream_track(files(spark, df, "seq", 3, tmp_path / "in").where("seq IS NOT NULL"), 0.3, 5), tmp_path, "tracks")
    got = {(x.camera_id, x.seq, x.det_index): x.track_id for x in spark.table("tracks").collect()}
    want = model_tracks(data, 0.3, 5)
    assert got == want


def test_stream_motion_equals_batch(spark, tmp_path):
    data = [("c", "person-1", i, 1000 * S + i * S // 5, 7, (20.0 * i, 0.0, 20.0 * i + 40, 100.0 + i * i), 640) for i in range(40)]
    df = spark.createDataFrame(data, "camera_id string, track_key string, seq bigint, us bigint, track_id bigint, "
                                     "bbox struct<x1:double,y1:double,x2:double,y2:double>, frame_w int")
    (tmp_path / "in").mkdir()
    run(ST.stream_motion(files(spark, df, "us", 4, tmp_path / "in")), tmp_path, "moves")
    got = {r.seq: (r.direction, r.dx, r.dy) for r in spark.table("moves").collect()}
    want = {r.seq: (r.motion.direction, r.motion.dx, r.motion.dy) for r in M.estimate_motion(df).collect()}
    assert got == want


def test_stream_alerts_equal_batch(spark, tmp_path):
    data = [event("a", 0), event("b", 10), event("b", 11), event("b", 12), event("b", 60), event("c", 65), event("end", 500, camera="x")]
    df = spark.createDataFrame(data, EVENT).withColumn("us", F.col("us") + 1000 * S)  # a watermark starts at 1970
    alerts = A.alert_sessions(df.drop("alert_id"), sweeps=False).where("camera_id = 'c'").collect()
    want = {r.alert_us: (r.active_source_count, r.last_seen_us, r.ended_us) for r in alerts}
    for parts in (2, 6):  # the end is the same however batches are cut
        folder = tmp_path / f"in{parts}"
        folder.mkdir()
        run(ST.stream_alerts(files(spark, df, "us", parts, folder)), tmp_path, f"changes{parts}")
        rows = [r for r in spark.table(f"changes{parts}").collect() if r.dedup_key.startswith("c|")]
        ends = {r.alert_us: (r.active_source_count, r.last_seen_us, r.at_us) for r in rows if r.change == "RESOLVED"}
        assert ends == want
        assert sorted(r.alert_us // S - 1000 for r in rows if r.change == "CREATED") == [0, 60]


def test_late_rows_change_nothing(spark, tmp_path):
    """Rows of a later file that are older than what their key has processed."""
    data = [event("a", 0), event("a", 20), event("b", 5), event("b", 25), event("end", 500, camera="x")]
    df = spark.createDataFrame(data, EVENT).withColumn("us", F.col("us") + 1000 * S).withColumn("turn", F.expr("array(1, 2, 3, 4, 5)[int(element_at(map(0, 0, 20, 1, 5, 2, 25, 3, 500, 4), int(us div 1000000 - 1000)))]"))
    (tmp_path / "in").mkdir()
    stream = files(spark, df, "turn", 5, tmp_path / "in")
    run(ST.stream_alerts(stream.drop("turn")), tmp_path, "late_alerts")
    rows = [r for r in spark.table("late_alerts").collect() if r.dedup_key.startswith("c|")]
    assert sorted(r.at_us // S - 1000 for r in rows if r.change in ("CREATED", "UPDATED")) == [0, 20, 25]
    run(ST.late_rows(stream, ["camera_id"]), tmp_path, "late")
    assert [(r.source_event_id, r.us // S - 1000) for r in spark.table("late").collect()] == [("b", 5)]


def test_restarts_and_late_frames(spark, tmp_path):
    """A sequence that begins anew, a clock that falls back, a long silence; and frames that are only late."""
    import pandas as pd

    step = ST.OrderProcessor(100.0)

    class Held:
        row = None
        exists = lambda self: self.row is not None
        get = lambda self: self.row

        def update(self, row):
            self.row = row

    step.state = Held()

    def feed(*frames):
        batch = pd.DataFrame([(us * S, seq) for us, seq in frames], columns=["us", "seq"])
        out = pd.concat(step.handleInputRows(("c",), iter([batch.iloc[::-1]]), None))
        return {(r.us // S, r.seq): (r.epoch, None if pd.isna(r.prev_us) else r.prev_us // S, r.late) for r in out.itertuples()}

    assert feed((1000, 1), (1001, 2), (1002, 3)) == {(1000, 1): (0, None, False), (1001, 2): (0, 1000, False), (1002, 3): (0, 1001, False)}
    # A late frame, frames that go on, and the sequence's new beginning in one batch.
    assert feed((1001, 2), (1003, 4), (1004, 1), (1005, 2)) == {
        (1001, 2): (0, None, True), (1003, 4): (0, 1002, False), (1004, 1): (1, None, False), (1005, 2): (1, 1004, False)}
    assert feed((1004, 1))[1004, 1][2]
    # The clock falls back while the sequence goes on; what is watched goes on.
    got = feed((1006, 3), (990, 4), (991, 5))
    assert [got[k][0] for k in ((1006, 3), (990, 4), (991, 5))] == [1, 2, 2] and got[990, 4][1] is None
    assert step.state.row[4] > 16 * S
    # Silence beyond the horizon, and both behind by more than it.
    assert feed((1200, 6))[1200, 6] == (3, None, False) and feed((1050, 2))[1050, 2] == (4, None, False)
    assert feed((1049, 1))[1049, 1] == (4, None, True)


def test_silent_camera_leaves_no_state(spark, tmp_path):
    """Stays are cleared by a timer once the watermark is the horizon past a camera's last frame."""
    def frame(camera, us, seq):
        return (camera, us * S, seq, "z", "r", "dwell", "k", "person", None, 0.9, None, 0.0, 0.0, 1.0, 1.0, 10.0)

    names = [c.split(" ")[0] for c in ST.HIT_SCHEMA.split(", ")]
    rows = [dict(zip(["camera_id", "us", "seq", "zone_id", "rule_id", "rule_type", "track_key", "class_name", "rule_object_type", "confidence",
                      "people_threshold", "det_index", "duration_threshold", "fx", "fy", "area"], frame(c, u, q))) for c, u, q in
            (("a", 1000, 1), ("b", 1000, 1), ("b", 3000, 2), ("b", 3001, 3))]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ST.HIT_SCHEMA)
    (tmp_path / "in").mkdir()
    stream = files(spark, df, "us", 4, tmp_path / "in")
    settings = ST.RuleSettings(reattach=None, restart=ST.Restart(100.0), watermark="1 second")
    run(ST._events_of(stream, settings), tmp_path, "silent")
    events = sorted((r.camera_id, r.us // S, r.epoch) for r in spark.table("silent").collect())
    assert events == [("a", 1000, 0), ("b", 1000, 0), ("b", 3000, 1), ("b", 3001, 1)]
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "stays").load(str(tmp_path / "ck-silent"))
    assert {r.key.camera_id for r in state.collect()} == {"b"}


def test_stream_risk_equals_batch(spark, tmp_path):
    from zonewatch.operators import risk as R

    t0 = 1000 * 86400 + 18 * 3600 - 60  # a minute before working hours end
    spans = [("r", "AI", 10, 200), ("r", "DOOR", 20, 150), ("r", "BEAM", 170, 180), ("s", "AI", 30, 90), ("s", "DOOR", 30, 90), ("p", "AI", 0, 10), ("p", "DOOR", 5, 8), ("p", "AI", 30, 40), ("p", "AI", 100, 110), ("p", "AI", 105, 120), ("q", "BEAM", 0, 50)]
    df = spark.createDataFrame([(l, s, (t0 + a) * S, (t0 + b) * S) for l, s, a, b in spans],
                               "location_id string, source string, from_us bigint, to_us bigint")
    want = sorted(map(tuple, R.risk_alert_changes(R.risk_levels(df, 480, 1080), 30.0).collect()))
    steps = df.select("location_id", "source", F.col("from_us").alias("us"), F.lit(1).alias("delta")).unionByName(
        df.select("location_id", "source", F.col("to_us").alias("us"), F.lit(-1).alias("delta")))
    end = spark.createDataFrame([("end", "AI", (t0 + 900) * S, 1)], "location_id string, source string, us bigint, delta int")
    (tmp_path / "in").mkdir()
    run(ST.stream_risk_alerts(files(spark, steps.unionByName(end), "us", 3, tmp_path / "in"), 30.0, 480, 1080), tmp_path, "risks")
    got = sorted((r.location_id, r.alert_from_us, r.at_us, r.change, r.level) for r in spark.table("risks").collect() if r.location_id != "end")
    assert got == want


def test_event_store_replay_changes_nothing(spark, tmp_path):
    store = K.EventStore(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([event("a", 0), event("a", 5), event("b", 130)], EVENT).withColumns(
        {"track_key": F.lit("t"), "confidence": F.lit(0.9)})
    state = lambda: (sorted(map(str, store.events().collect())), sorted(map(str, store.evidence().collect())))
    store.ingest(batch, 0)
    first = state()
    assert len(first[0]) == 2 and len(first[1]) == 2
    store.ingest(batch, 0)
    assert state() == first
    store.ingest(spark.createDataFrame([event("a", 200, first=0)], EVENT).withColumns({"track_key": F.lit("t"), "confidence": F.lit(0.5)}), 1)
    a = store.events().where("source_event_id = 'a'").first()
    assert (a.last_seen_us, a.started_us, a.confidence) == (200 * S, 0, 0.5)
    assert store.evidence().count() == 3


def test_event_store_goes_on_through_batches(spark, tmp_path):
    """Two sources of one key 5 s apart: one alert and one picture, in one batch, in two, and in the wrong order."""
    rows = [event("a", 1000, first=1000), event("b", 1005, first=1005), event("b", 1010, first=1005), event("c", 1100, first=1100)]
    df = spark.createDataFrame(rows, EVENT).withColumns({"track_key": F.lit("t"), "confidence": F.lit(0.9)})
    us = lambda *s: df.where(F.col("us").isin([x * S for x in s]))
    seen = []
    for k, cuts in enumerate([[(1000, 1005, 1010, 1100)], [(1000,), (1005, 1010), (1100,)], [(1000, 1010), (1005, 1100)]]):
        store = K.EventStore(spark, str(tmp_path / f"s{k}"))
        for n, c in enumerate(cuts):
            store.ingest(us(*c), n)
            store.ingest(us(*c), n)
        seen.append(sorted((r.alert_us // S, r.last_seen_us // S, r.events, r.active_source_count, r.ended_us) for r in store.alerts().where("alert_id is not null").collect()))
        assert store.evidence().where("alert_id LIKE '%@1000000000'").count() == 1
    assert seen[0] == [(1000, 1010, 3, 2, 1100 * S), (1100, 1100, 1, 1, None)]
    assert seen[1] == seen[0] and seen[2] == seen[0]


def test_sensor_topics(spark):
    rows = spark.createDataFrame([("x/v1/devices/d1/readings", '{"value": true, "recordedAt": "2026-08-25T09:15:22Z"}'),
                                  ("x/other", '{"device_id": "d2", "value": "OPEN", "timestamp": "2026-08-25T09:15:22Z"}')], "topic string, value string")
    got = MSG.parse_sensor_messages(rows).select("device_id", "positive", iso_millis_us(F.col("us")).alias("at")).collect()
    assert [tuple(r) for r in got] == [("d1", True, "2026-08-25T09:15:22.000Z"), ("d2", True, "2026-08-25T09:15:22.000Z")]


def test_unknown_kind_is_refused(spark):
    from zonewatch.operators import access as X

    with pytest.raises(ValueError):
        X.scope_via(spark.range(1), "tenant", None, spark.range(1))
