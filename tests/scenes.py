"""Hand-written scenes: one camera each, with the rule it is watched by."""

from __future__ import annotations

import json

BASE = 1_793_329_200_000_000  # 2026-10-30T03:00:00Z, 10:00 at UTC+7
SQUARE = [(100, 100), (300, 100), (300, 300), (100, 300)]


def obj(track, x=200, y=250, cls="person", conf=0.9, w=40, h=100):
    return {"class_id": 0, "class_name": cls, "confidence": conf, "bbox_xyxy": [x - w / 2, y - h, x + w / 2, y], "track_id": track}


def rule(**kw):
    r = dict(rule_type="person_intrusion", enabled=True, object_type="person", duration_threshold=5, people_threshold=None,
             confidence_threshold=0.6, use_active_time=False, active_start_time=None, active_end_time=None)
    return {**r, **kw}


def standing(seconds, fps=1, **kw):
    return [(i / fps, [obj(1, **kw)]) for i in range(int(seconds * fps) + 1)]


CROWD = dict(rule_type="crowd_limit", people_threshold=3, duration_threshold=4)


def people(n):
    return [obj(i, x=150 + 30 * i) for i in range(n)]


# name: (rule, frames, zone changes)
SCENES = {
    "stays": (rule(), standing(5), {}),
    "foot_outside": (rule(duration_threshold=0), [(i, [obj(1, y=350)]) for i in range(4)], {}),
    "beats": (rule(duration_threshold=2), standing(25), {}),
    "fast": (rule(duration_threshold=0), standing(4.9, 10), {}),
    "new_id": (rule(), [(0, [obj(1)]), (1, [obj(1)]), (2, [obj(9, x=210)]), (3, [obj(9)]), (4, [obj(9)]), (5, [obj(9)])], {}),
    "new_id_far": (rule(), [(0, [obj(1, x=110)]), (1, [obj(1, x=110)]), *[(i, [obj(9, x=270)]) for i in range(2, 6)]], {}),
    "gone": (rule(), [(0, [obj(1)]), (1, [obj(1)]), (6.5, []), (7, [obj(1)]), (8, [obj(1)]), (11, [obj(1)])], {}),
    "gap_no_frames": (rule(), [(0, [obj(1)]), (20, [obj(1)])], {}),
    "unsure": (rule(duration_threshold=0), standing(2, conf=0.4), {}),
    "car": (rule(duration_threshold=0), standing(2, cls="car"), {}),
    "vehicle": (rule(duration_threshold=0, object_type="vehicle"), [(0, [obj(1, cls="motorcycle"), obj(2, cls="car"), obj(3, cls="bicycle")])], {}),
    "night": (rule(duration_threshold=0, use_active_time=True, active_start_time="23:00", active_end_time="06:00"), standing(2), {}),
    "night_on": (rule(duration_threshold=0, use_active_time=True, active_start_time="23:00", active_end_time="06:00"),
                 [(52_200 + i, [obj(1)]) for i in range(2)], {}),
    "half_size": (rule(duration_threshold=0), standing(0), {"points": [(p / 2, q / 2) for p, q in SQUARE], "frame_width": 320, "frame_height": 180}),
    "crowd": (rule(**CROWD), [(i, people(3)) for i in range(6)], {}),
    "crowd_broken": (rule(**CROWD), [(0, people(3)), (1, people(3)), (2, people(2)), *[(i, people(3)) for i in range(3, 7)]], {}),
    "crowd_empty": (rule(**CROWD), [(0, people(3)), (2, people(3)), (3, []), *[(i, people(3)) for i in range(4, 8)]], {}),
    "no_seconds": (rule(duration_threshold=None), standing(9), {}),
    "disabled": (rule(duration_threshold=0, enabled=False), standing(2), {}),
    "later_in_frame": (rule(duration_threshold=2), [(0, [obj(1)]), (1, [obj(2, x=205), obj(1, x=200)]), (2, [obj(2, x=205), obj(1)])], {}),
}

# name: times (s) at which an event is published
EXPECTED = {
    "stays": [5], "foot_outside": [], "beats": [2 + i for i in range(24)], "fast": [0, 1, 2, 3, 4], "new_id": [5], "new_id_far": [],
    "gone": [], "gap_no_frames": [20], "unsure": [], "car": [], "vehicle": [0, 0], "night": [], "night_on": [52_200, 52_201],
    "half_size": [0], "crowd": [4, 5], "crowd_broken": [], "crowd_empty": [], "no_seconds": [], "disabled": [], "later_in_frame": [2],
}


def tables(spark):
    """Frame rows (JSON-like dicts), zones and rules of all scenes."""
    frames, zones, rules = [], [], []
    for name, (r, shots, changes) in SCENES.items():
        z = {"id": f"{name}-z", "camera_id": name, "name": "Z", "zone_type": "restricted_area",
             "points": SQUARE, "frame_width": 640, "frame_height": 360, "enabled": True, **changes}
        z["points"] = [{"x": float(x), "y": float(y)} for x, y in z["points"]]
        zones.append(z)
        seconds = r["duration_threshold"]
        rules.append({"id": f"{name}-r", "zone_id": f"{name}-z", **r,
                      "duration_threshold": None if seconds is None else float(seconds)})
        for i, (t, objects) in enumerate(shots):
            frames.append({"camera_id": name, "location_id": "l", "frame_id": f"{name}-{i}", "sequence_number": i,
                           "us": BASE + round(t * 1_000_000), "frame_width": 640, "frame_height": 360, "detections": objects})
    zone_df = spark.createDataFrame(
        zones, "id string, camera_id string, name string, zone_type string, points array<struct<x:double,y:double>>, "
               "frame_width int, frame_height int, enabled boolean")
    rule_df = spark.createDataFrame(
        rules, "id string, zone_id string, rule_type string, enabled boolean, object_type string, duration_threshold double, "
               "people_threshold int, confidence_threshold double, use_active_time boolean, active_start_time string, active_end_time string")
    return frames, zone_df, rule_df


def write_lines(frames, path, iso):
    with open(path, "w") as out:
        for f in frames:
            row = {k: v for k, v in f.items() if k != "us"}
            out.write(json.dumps({**row, "captured_at": iso(f["us"])}) + "\n")
