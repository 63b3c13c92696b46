"""Small cases with known outcomes."""

import pytest
from pyspark.sql import functions as F

from zonewatch.functions import geometry, keys, labels, rules
from zonewatch.operators import access as X
from zonewatch.operators import alerts as A
from zonewatch.operators import evidence as E
from zonewatch.operators import listings as L
from zonewatch.operators import motion as M
from zonewatch.operators import risk as R
from zonewatch.operators import sensors as N
from zonewatch.operators import tables as T

S = 1_000_000


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_directions(spark):
    want = {0: "right", 22: "right", 23: "up-right", 44: "up-right", 90: "up", 135: "up-left", 180: "left", 225: "down-left",
            270: "down", 315: "down-right", 359: "right"}
    df = spark.createDataFrame([(float(a),) for a in want], "a double")
    got = {int(r.a): r.d for r in df.select("a", rules.direction_from_angle(F.col("a")).alias("d")).collect()}
    assert got == want


def test_labels_and_keys(spark):
    r = one(
        spark, labels.track_label(F.lit("person-12")), labels.track_label(F.lit("5 objects")), labels.humanize(F.lit("a_big_dog")),
        labels.format_duration(F.lit(59.6)), labels.format_duration(F.lit(125)), keys.safe_path_part(F.lit("cam/1:ä")),
        keys.tenant_uuid(F.lit("6BA7B810-9DAD-11D1-80B4-00C04FD430C8")), keys.tenant_uuid(F.lit("demo")),
        geometry.iou(geometry.box(*[F.lit(x) for x in (0, 0, 2, 2)]), geometry.box(*[F.lit(x) for x in (1, 1, 3, 3)])),
    )
    import uuid

    assert list(r) == ["#12", "5 objects", "A big dog", "1 phút", "2 phút 5 giây", "cam_1_ä", "6ba7b810-9dad-11d1-80b4-00c04fd430c8",
                       str(uuid.uuid5(uuid.NAMESPACE_DNS, "tenant:demo")), 1 / 7]


def test_polygon_borders(spark):
    square = F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ((100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0))])
    points = [(100, 200, True), (300, 200, False), (200, 100, True), (200, 300, False), (200, 200, True), (50, 200, False)]
    df = spark.createDataFrame([(float(x), float(y), w) for x, y, w in points], "x double, y double, want boolean")
    p = geometry.point(F.col("x"), F.col("y"))
    for bound in (4, 9, None):
        assert df.where(geometry.point_in_polygon(p, square, bound) != F.col("want")).count() == 0


def walk(name, points):
    return [(name, f"person-{name}", i, round(t * S), (x - 20.0, y - 100.0, x + 20.0, y), 640) for i, (t, x, y) in enumerate(points)]


@pytest.mark.parametrize("rewinds", [True])
def test_motion(spark, rewinds):
    data = (
        walk("left", [(10 + i / 5, 500.0 - 50 * i, 200.0) for i in range(6)])
        + walk("still", [(10 + i / 5, 500.0 + 2 * (i % 2), 200.0) for i in range(6)])
        + walk("short", [(10, 0.0, 0.0), (10.2, 90.0, 0.0)])
        + walk("back", [(10 + i / 5, 50.0 * i, 200.0) for i in range(6)] + [(3, 0.0, 200.0)])
        + walk("cut", [(3599.5 + i / 5, 50.0 * i, 200.0) for i in range(6)])
    )
    df = spark.createDataFrame(data, "camera_id string, track_key string, seq bigint, us bigint, bbox struct<x1:double,y1:double,x2:double,y2:double>, frame_w int")
    rows = M.estimate_motion(df, clock_rewinds=rewinds).collect()
    last = {c: max((r for r in rows if r.camera_id == c), key=lambda r: r.seq).motion for c in {r.camera_id for r in rows}}
    assert (last["left"].direction, last["left"].speed_px_s, last["left"].angle_deg) == ("left", 250.0, 180.0)
    assert last["still"].direction == "stationary" and last["still"].speed_px_s is not None
    assert last["short"].direction == "unknown" and last["short"].speed_px_s is None
    assert last["back"].direction == "unknown"
    assert (last["cut"].direction, last["cut"].dx) == ("right", 250.0)


def event(source, t, first=None, camera="c", kind="person_intrusion", seq=0, alert=None):
    return (source, source, camera, "z", "r", kind, "person", t * S, (t if first is None else first) * S, seq, seq, alert, f"f{t}")


EVENT = ("source_event_id string, event_id string, camera_id string, zone_id string, rule_config_id string, event_type string, "
         "object_type string, us bigint, started_us bigint, first_seq bigint, last_seq bigint, alert_id string, frame_id string")


def test_alerts(spark):
    data = [
        event("a", 0), event("b", 10), event("b", 11), event("b", 12, seq=60),  # one alert, two sources
        event("b", 50), event("x", 95, camera="d"),  # b again after more than 30 s: a new alert by a known source
    ]
    df = spark.createDataFrame(data, EVENT).drop("alert_id")
    got = {r.alert_us // S: r for r in A.alert_sessions(df).where("camera_id = 'c'").collect()}
    assert set(got) == {0, 50}
    assert (got[0].active_source_count, got[0].last_seq, got[0].risk_level) == (2, 60, "high")
    assert (got[0].lifecycle_status, got[0].ended_us) == ("resolved", 50 * S)
    assert (got[50].active_source_count, got[50].ended_us) == (1, 95 * S)
    merged = A.alert_sessions(df, grace_s=None).where("camera_id = 'c'").collect()
    assert len(merged) == 1 and merged[0].active_source_count == 2
    fresh = merged[0].last_seen_us
    stale = A.resolve_stale(A.alert_sessions(df, grace_s=None), fresh + 31 * S).where("camera_id = 'c'").first()
    assert (stale.lifecycle_status, stale.ended_us) == ("resolved", fresh + 31 * S)
    assert A.resolve_stale(A.alert_sessions(df, grace_s=None), fresh + 30 * S).where("camera_id = 'c'").first().lifecycle_status == "active"


def test_snapshots(spark):
    taken = spark.createDataFrame([("e0", "A", "f0", 0)], "ai_event_id string, alert_id string, frame_id string, captured_us bigint")
    df = spark.createDataFrame([event("e1", 60, alert="A"), event("e1", 121, alert="A"), event("e1", 200, alert="A"),
                                event("lone", 5), event("lone", 6), event("lone", 130), event("e0", 0, alert="A")], EVENT)
    got = sorted((r.event_id, r.us // S) for r in E.plan_snapshots(df, taken).collect())
    assert got == [("e1", 121), ("lone", 5), ("lone", 130)]


def test_clips(spark):
    shots = [("c", i, i * S, f"f{i}") for i in range(8)]
    frames = spark.createDataFrame(shots, "camera_id string, seq bigint, us bigint, frame_id string")
    snaps = spark.createDataFrame([("mid", "c", 3 * S), ("late", "c", 7 * S), ("none", "d", 3 * S)], "event_id string, camera_id string, us bigint")
    got = {r.event_id: r for r in E.plan_clips(snaps, frames, 3, 3, 0.5).collect()}
    assert set(got) == {"mid", "late"}
    assert (got["mid"].status, got["mid"].frame_ids) == ("completed", ["f0", "f2", "f4", "f6"])
    assert (got["late"].status, got["late"].frame_ids) == ("partial", ["f4", "f6", "f7"])


def test_upsert_keeps_a_linked_alert(spark):
    kind = "source_event_id string, id string, event_type string, last_seq bigint, alert_id string"
    base = spark.createDataFrame([("s", "1", "loitering", 10, "A")], kind)
    changes = spark.createDataFrame([("s", "9", "other", 20, None, 2), ("s", "8", "other", 15, None, 1), ("n", "5", "x", 1, None, 1), ("n", "6", "y", 2, "B", 2)],
                                    kind + ", us bigint")
    got = {r.source_event_id: tuple(r)[1:] for r in T.upsert_ai_events(base, changes).collect()}
    assert got == {"s": ("1", "loitering", 20, "A"), "n": ("5", "x", 2, "B")}


def test_keep_last_restarts(spark):
    df = spark.createDataFrame([("c", s, i) for i, s in enumerate([1, 2, 3, 4, 1, 2])], "camera_id string, seq bigint, arrived bigint")
    assert sorted(r.seq for r in L.keep_last(df, ["camera_id"], "seq", 3, arrival="arrived").collect()) == [1, 2]
    assert sorted(r.seq for r in L.keep_last(df, ["camera_id"], "seq", 2).collect()) == [3, 4]


def test_access(spark):
    users = spark.createDataFrame([(u, f"{u}@x", u, "disabled" if u == "off" else "active") for u in ("own", "op", "view", "off")],
                                  "id string, email string, full_name string, status string")
    tenants = spark.createDataFrame([("t1", "one"), ("t2", "two")], "id string, code string")
    members = spark.createDataFrame([("m" + u, u, "t1", r, "active") for u, r in (("own", "owner"), ("op", "operator"), ("view", "viewer"), ("off", "admin"))],
                                    "id string, user_id string, tenant_id string, role string, status string")
    places = spark.createDataFrame([("l1", "t1", "B", "b"), ("l2", "t1", "A", "a"), ("l3", "t2", "C", "c")], "id string, tenant_id string, name string, code string")
    given = spark.createDataFrame([("mop", "l1", "operator"), ("mview", "l2", "viewer"), ("mop", "l3", "admin")], "tenant_member_id string, location_id string, permission_level string")
    cameras = spark.createDataFrame([("c1", "l1", "t1"), ("c2", "l2", "t1"), ("c3", "l3", "t2")], "id string, location_id string, tenant_id string")
    claims = spark.createDataFrame([("own@x", "one"), ("op", "t1"), ("view", "one"), ("off", "t1"), ("own", "two")], "subject string, tenant string")
    access = X.effective_access(X.active_member(users, members, tenants, claims), places, given)
    seen = {(r.member_id, r.camera_id) for r in X.allowed_cameras(access, cameras).collect()}
    assert seen == {("mown", "c1"), ("mown", "c2"), ("mop", "c1"), ("mview", "c2")}
    asks = spark.createDataFrame([("mview", "t1", "c2", "viewer"), ("mview", "t1", "c2", "operator"), ("mview", "t1", "c1", "viewer"), ("mop", "t1", "c3", "viewer"), ("mop", "t1", "zz", "viewer")],
                                 "member_id string, tenant_id string, camera_id string, min_level string")
    got = {(r.camera_id, r.min_level, r.member_id): r.status for r in X.access_decisions(asks, access, cameras).collect()}
    assert got == {("c2", "viewer", "mview"): 200, ("c2", "operator", "mview"): 403, ("c1", "viewer", "mview"): 404, ("c3", "viewer", "mop"): 404, ("zz", "viewer", "mop"): 404}
    data = spark.createDataFrame([("c1",), ("c2",)], "camera_id string")
    assert X.scope(data, None, cameras).count() == 2
    assert X.scope(data, access.limit(0), cameras).count() == 0


def test_grants_say_what_their_rows_written_out_say(spark):
    """Members, roles, locations and cameras at random, some cameras without a location or at another tenant's."""
    import random

    r = random.Random(5)
    places = spark.createDataFrame([(f"l{i}", f"t{i % 3}", f"n{i}", f"c{i}") for i in range(9)], "id string, tenant_id string, name string, code string")
    people = [(f"m{i}", f"u{i}", f"t{r.randrange(4)}", r.choice(["owner", "admin", "operator", "viewer"])) for i in range(24)]
    members = spark.createDataFrame(people, "member_id string, user_id string, tenant_id string, role string")
    pairs = {(f"m{r.randrange(24)}", f"l{r.randrange(10)}") for _ in range(60)}
    given = spark.createDataFrame([(*p, r.choice(["viewer", "operator", "admin"])) for p in sorted(pairs)], "tenant_member_id string, location_id string, permission_level string")
    where = [(f"c{i}", r.choice([None, "l99"] + [f"l{k}" for k in range(9)]), f"t{r.randrange(3)}") for i in range(60)]
    cameras = spark.createDataFrame(where, "id string, location_id string, tenant_id string")
    short, full = X.grants(members, places, given), X.effective_access(members, places, given)
    assert short.where("location_id IS NULL").count() == sum(p[3] in X.TENANT_WIDE for p in people)
    rows = lambda df: sorted(map(tuple, df.collect()))
    asks = members.select("member_id", "tenant_id").crossJoin(cameras.select(F.col("id").alias("camera_id"))).crossJoin(
        spark.createDataFrame([("viewer",), ("operator",), ("admin",)], "min_level string"))
    assert rows(X.access_decisions(asks, short, cameras, places)) == rows(X.access_decisions(asks, full, cameras))
    assert rows(X.my_locations(short, places)) == rows(X.my_locations(full, places))
    data = cameras.select(F.col("id").alias("camera_id"))
    for level in ("viewer", "operator", "admin"):
        assert rows(X.allowed_cameras(short, cameras, level, places)) == rows(X.allowed_cameras(full, cameras, level))
        assert rows(X.scope(data, short, cameras, level, places)) == rows(X.scope(data, full, cameras, level))


NOON, NIGHT = 12 * 3600, 22 * 3600


def levels(spark, spans):
    df = spark.createDataFrame([(l, s, a * S, b * S) for l, s, a, b in spans], "location_id string, source string, from_us bigint, to_us bigint")
    return R.risk_levels(df, 8 * 60, 18 * 60)


def test_risk(spark):
    out = levels(spark, [
        ("alone", "AI", NOON, NOON + 10), ("both", "AI", NOON, NOON + 10), ("both", "DOOR", NOON + 5, NOON + 10),
        ("night", "AI", NIGHT, NIGHT + 10), ("night", "BEAM", NIGHT, NIGHT + 10), ("same", "AI", NOON, NOON + 10), ("same", "AI", NOON + 5, NOON + 20),
        ("three", "AI", NOON, NOON + 9), ("three", "DOOR", NOON, NOON + 9), ("three", "PIR_MOTION", NOON, NOON + 9),
        ("short", "AI", NOON, NOON + 5), ("short", "AI", NOON + 20, NOON + 25), ("long", "AI", NOON, NOON + 5), ("long", "AI", NOON + 50, NOON + 55),
    ])
    alerts = R.risk_alerts(out, 30.0).collect()
    top = {}
    for a in alerts:
        top.setdefault(a.location_id, []).append(a.highest_level)
    assert top["alone"] == ["MEDIUM"] and top["both"] == ["HIGH"] and top["night"] == ["CRITICAL"] and top["three"] == ["CRITICAL"]
    assert top["same"] == ["MEDIUM"] and len(top["short"]) == 1 and len(top["long"]) == 2
    told = [(r.change, r.level, (r.at_us // S) - NOON) for r in R.risk_alert_changes(out, 30.0).where("location_id = 'both'").orderBy("at_us").collect()]
    assert told == [("CREATED", "MEDIUM", 0), ("LEVEL_CHANGED", "HIGH", 5), ("CLOSED", "HIGH", 40)]


def test_sensor_noise_and_silence(spark):
    values = [True, False, True, True, True, False]
    df = spark.createDataFrame([("s", i * S, v) for i, v in enumerate(values)], "sensor_id string, us bigint, positive boolean")
    assert [r.is_active for r in N.sensor_active(df).orderBy("us").collect()] == [False, False, False, False, True, False]
    beats = spark.createDataFrame([("d", t * S) for t in (0, 5, 35, 36)], "device string, us bigint")
    got = [(r.status, r.at_us // S, r.downtime_s) for r in N.liveness(beats, "device", 15, 60 * S).orderBy("at_us").collect()]
    assert got == [("OFFLINE", 20, None), ("ONLINE", 35, 30.0), ("OFFLINE", 51, None)]


def test_correlation_is_inclusive(spark):
    ai = spark.createDataFrame([(1, "l", "z", 100 * S, "FORBIDDEN_ZONE_INTRUSION")], "event_id bigint, location_id string, zone_id string, us bigint, event_type string")
    doors = spark.createDataFrame([(1, "l", "q", 110 * S, "DOOR_OPENED"), (2, "l", "z", 111 * S, "DOOR_OPENED"), (3, "m", "z", 90 * S, "DOOR_OPENED"), (4, "l", "z", 95 * S, "DOOR_CLOSED")],
                                  "event_id bigint, location_id string, zone_id string, us bigint, event_type string")
    # Both ends count, by location or by zone; of readings as near as each other the lowest id is told.
    told = lambda *ids: [r.sensor_event_id for r in A.correlate(ai, doors.where(F.col("event_id").isin(*ids))).collect()]
    assert told(1, 2, 3, 4) == [1] and told(1) == [1] and told(3) == [3] and told(2, 4) == []


def test_labels_and_predictions_are_paired_one_to_one(spark):
    """Two labels that overlap and two predictions inside both: two hits, however they are ordered."""
    from zonewatch.operators.metrics import match_ground_truth

    key = ("v", "z", "loitering")
    truth = spark.createDataFrame([("L1", *key, 0, 100 * S), ("L2", *key, 10 * S, 50 * S), ("L3", *key, 500 * S, 600 * S), ("L4", "w", "z", "none", 0, 9 * S)],
                                  "truth_id string, video string, zone string, event_type string, from_us bigint, to_us bigint")
    pred = spark.createDataFrame([("P1", *key, 20 * S), ("P2", *key, 30 * S), ("P3", *key, 300 * S), ("P4", "w", "z", "loitering", 5 * S)],
                                 "pred_id string, video string, zone string, event_type string, start_us bigint")
    rows = {(r.outcome, r.pred_id, r.truth_id) for r in match_ground_truth(pred, truth).collect()}
    assert rows == {("tp", "P1", "L2"), ("tp", "P2", "L1"), ("fp", "P3", None), ("fp", "P4", None), ("fn", None, "L3")}


def test_small_table_joins_agree(spark, monkeypatch):
    """Zones by broadcast and by salted shuffle give the same hits, few edges or many."""
    import math

    from zonewatch.functions import geometry
    from zonewatch.operators import zones as Z

    circle = [{"x": 100 + 80 * math.cos(k / 5), "y": 100 + 80 * math.sin(k / 5)} for k in range(31)]
    square = [{"x": float(x), "y": float(y)} for x, y in ((50, 50), (150, 50), (150, 150), (50, 150))]
    zones = spark.createDataFrame([(n, "c", n, "t", p, 640, 360, True) for n, p in (("circle", circle), ("square", square))],
                                  "id string, camera_id string, name string, zone_type string, points array<struct<x:double,y:double>>, frame_width int, frame_height int, enabled boolean")
    det = spark.range(400).selectExpr("'c' AS camera_id", "id AS seq", "named_struct('x1', id % 20 * 10D - 1, 'y1', 0D, 'x2', id % 20 * 10D + 1, 'y2', id div 20 * 10D) AS bbox", "640 AS frame_w", "360 AS frame_h")
    hits = lambda: sorted((r.seq, r.zone_id) for r in Z.match_zones(det, zones).collect())
    want = hits()
    assert len(want) > 100
    monkeypatch.setattr(Z, "BROADCAST_BYTES", 0)
    assert hits() == want
    monkeypatch.setattr(geometry, "MAX_UNROLLED_EDGES", 0)
    assert hits() == want


@pytest.mark.parametrize("sort", ["at", "-at"])
def test_pages_reach_ties_and_nulls(spark, sort):
    values = [3, None, 1, 3, None, 2, 3, None, 1, None, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, at int")
    sign = -1 if sort.startswith("-") else 1
    want = sorted(range(len(values)), key=lambda k: (values[k] is None, sign * (values[k] or 0), k))
    for size in (1, 2, 3, 20):
        seen, after = [], None
        while rows := L.page_after(df, sort, after, size).collect():
            seen += [r.id for r in rows]
            after = rows[-1]["at"], rows[-1].id
        assert seen == want
