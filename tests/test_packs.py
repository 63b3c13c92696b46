"""Streams whose rows go from step to step as packs."""

import random
from math import atan2, degrees, hypot

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from zonewatch.functions.rules import DIRECTIONS
from zonewatch.streaming import packs as P
from zonewatch.streaming import stateful as ST

S = 1_000_000


def test_rows_are_split_by_key_in_their_order(monkeypatch):
    monkeypatch.setattr(P, "PACK_ROWS", 7)
    r = random.Random(1)
    rows = [{"a": r.choice(["x", "y", None]), "b": r.choice([1, 2, None]), "n": n} for n in range(200)]
    table = pa.Table.from_pylist(rows, schema=pa.schema([("a", pa.string()), ("b", pa.int64()), ("n", pa.int64())]))
    found = [(key, P.load([P.dump(t)])) for key, t in P.split(table, ["a", "b"])]
    assert max(t.num_rows for _, t in found) == 7 and sum(t.num_rows for _, t in found) == 200
    for a in ("x", "y", None):
        for b in (1, 2, None):
            got = [n for key, t in found if key == (a, b) for n in t.column("n").to_pylist()]
            assert got == [w["n"] for w in rows if (w["a"], w["b"]) == (a, b)]
    assert list(P.split(table.slice(0, 0), ["a"])) == []


def test_packs_hold_all_rows_and_aren_t_shuffled(spark):
    df = spark.range(120_000).select((F.col("id") % 3).cast("string").alias("k"), "id", F.array("id").alias("list"), F.struct("id").alias("s"))
    packs = P.packed(df, ["k"])
    assert "Exchange" not in packs._jdf.queryExecution().executedPlan().toString() and 3 <= packs.count() < 60
    back = P.unpacked(packs, df.schema)
    assert back.schema == df.schema and back.exceptAll(df).count() == 0 and back.count() == 120_000


def test_stateful_steps_of_frames_are_given_packs(spark, tmp_path):
    schema = "camera_id string, track_key string, us bigint, seq bigint, det_index int, class_name string, confidence double, frame_w int, bbox struct<x1:double,y1:double,x2:double,y2:double>"
    hits = spark.readStream.schema(ST.HIT_SCHEMA).parquet(str(tmp_path))
    boxes = spark.readStream.schema(schema).parquet(str(tmp_path))
    for df in (ST.stream_motion(boxes), ST.stream_track(boxes), ST._events_of(hits, ST.RuleSettings())):
        text = df._jdf.queryExecution().analyzed().toString()
        below = [line for line in text.splitlines() if "TransformWithState" in line]
        assert len(below) == 2 and "MapInArrow" in text and all("body#" in line for line in below)


class Held:
    row = None
    exists = lambda self: self.row is not None
    get = lambda self: self.row

    def update(self, row):
        self.row = row


def test_frames_that_follow_each_other_are_known_at_once_as_one_by_one():
    r = random.Random(3)
    whole, single = ST.OrderProcessor(5.0), ST.OrderProcessor(5.0)
    whole.state, single.state = Held(), Held()
    us = seq = 0
    for n in range(200):
        frames = []
        for _ in range(r.randrange(1, 6)):
            us += r.choice([S, S, 4 * S, 6 * S if n % 9 == 0 else S, 0 if n % 7 == 0 else S])
            seq += r.choice([1, 2])
            frames.append((us, seq))
        rows = [f for f in frames for _ in range(r.randrange(1, 3))]
        r.shuffle(rows)
        got = whole._known(*[np.array(c) for c in zip(*rows)])
        want = {}
        for f in frames:
            want[f] = single._known(np.array([f[0]]), np.array([f[1]])).iloc[0].tolist()
        assert [[None if pd.isna(v) else v for v in row] for row in got.values.tolist()] == [[None if pd.isna(v) else v for v in want[f]] for f in rows]
        assert whole.state.row == single.state.row
    assert whole.state.row[0] > 3


def test_motion_of_many_tracks_is_that_of_a_plain_loop():
    r = random.Random(4)

    class Points(Held):
        def put(self, rows):
            self.row = rows

    class Handle:
        listTimers = lambda self: []
        registerTimer = lambda self, t: None

    step = ST.MotionProcessor(1.0, 0.5, 0.02, 5.0)
    step.handle, step.points = Handle(), Points()
    known, checked = {}, 0
    for part in range(4):
        rows = [("t" + str(k) if k else None, (part * 50 + i) * 200_000 + 10**15, part * 50 + i, r.choice([640.0, 0.0]), float(r.randrange(60)) / 20, float(r.randrange(30)))
                for k in range(6) for i in range(50) if r.random() < 0.7]
        r.shuffle(rows)
        names = ["track_key", "us", "seq", "frame_w", "fx", "fy"]
        table = pa.Table.from_pandas(pd.DataFrame(rows, columns=names).assign(clock_us=lambda d: d["us"]), preserve_index=False)
        out = P.load(b for p in step.handleInputRows(("c", 2, 0), iter([P.bodies(table)]), None) for b in p["body"]).to_pylist()
        got = {(o["track_key"], o["seq"]): o for o in out}
        assert len(out) == len(rows)
        for key, us, seq, width, x, y in sorted(rows, key=lambda w: w[2]):
            points = known[key] = [p for p in known.get(key, []) if us - p[0] <= S] + [(us, x, y)]
            (t0, x0, y0), o = points[0], got[key, seq]
            if us - t0 < S // 2:
                want = ("unknown", None, None, None, None, None)
            else:
                span, dx, dy = (us - t0) / S, x - x0, y - y0
                speed, angle = hypot(dx, dy) / span, degrees(atan2(-dy, dx)) % 360.0
                name = "stationary" if speed < 0.02 * (width or 640) else DIRECTIONS[int((angle + 22.5) // 45) % 8]
                want = (name, round(angle, 1), round(speed, 1), round(dx, 1), round(dy, 1), round(span, 2))
                checked += 1
            assert tuple(o[c] for c in ("direction", "angle_deg", "speed_px_s", "dx", "dy", "window_s")) == want
            assert (o["camera_id"], o["epoch"], o["us"]) == ("c", 2, us)
    assert checked > 300


def test_a_batch_of_hits_is_never_cut(spark, tmp_path):
    """It has as many files as ``stream_hits`` takes at once, however many tasks made it."""
    schema = "camera_id string, location_id string, seq bigint, us bigint, frame_w int, frame_h int, detections array<struct<class_id:int,class_name:string,confidence:double,bbox_xyxy:array<double>,track_id:bigint>>"
    (tmp_path / "in").mkdir()
    for k in range(2):
        frame = spark.createDataFrame([("c", "l", k + 1, (1000 + k) * S, 640, 360, [(None, "person", 0.9, [0.0, 0.0, 2.0, 2.0], 1)])], schema)
        frame.unionByName(frame.where("seq > 1")).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    points = [{"x": float(x), "y": float(y)} for x, y in ((-9, -9), (9, -9), (9, 9), (-9, 9))]
    zones = spark.createDataFrame([("z", "c", "t", "Z", "a", points, 640, 360, True)], "id string, camera_id string, tenant_id string, name string, zone_type string, points array<struct<x:double,y:double>>, frame_width int, frame_height int, enabled boolean")
    rules = spark.createDataFrame([("r", "z", "t", "loitering", True, "person", 0, None, None, False, None, None)], "id string, zone_id string, tenant_id string, rule_type string, enabled boolean, object_type string, duration_threshold int, people_threshold int, confidence_threshold double, use_active_time boolean, active_start_time string, active_end_time string")
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    ST.write_hits(frames, lambda: zones, lambda: rules, str(tmp_path / "hits"), str(tmp_path / "ck")).awaitTermination(120)
    counts = [len(list(b.glob("*.parquet"))) for b in sorted((tmp_path / "hits").glob("batch=*"))]
    assert len(counts) >= 2 and set(counts) == {ST.HIT_FILES}
    assert spark.read.schema(ST.HIT_SCHEMA).parquet(str(tmp_path / "hits")).where("rule_id IS NOT NULL").count() >= 2


def test_an_alert_asks_for_a_source_once_a_batch():
    asked, kept = [], {}

    class Sources:
        def containsKey(self, key):
            asked.append(key)
            return key in kept

        def updateValue(self, key, row):
            kept[key] = row[0]

    class Handle:
        listTimers = lambda self: []
        registerTimer = lambda self, t: None

    step = ST.AlertProcessor(120.0, 30.0, 86400.0)
    step.handle, step.store, step.sources = Handle(), Held(), Sources()
    counts = []
    for part in range(2):
        rows = pd.DataFrame([("ab"[k % 2] if part == 0 else "bc"[k % 2], (part * 10 + k) * S, k) for k in range(10)], columns=["source_event_id", "us", "last_seq"])
        counts += [r.active_source_count for p in step.handleInputRows(("c",), iter([rows]), None) for r in p.itertuples() if r.change == "UPDATED"]
    assert sorted(asked) == [("a",), ("b",), ("b",), ("c",)]
    assert counts[0] == counts[8] == 2 and counts[-1] == 3 and kept[("c",)] == 19 * S and kept[("a",)] == 8 * S
