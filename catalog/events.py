"""Events, alerts and evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonewatch.functions import keys, payload
from zonewatch.operators import alerts as A
from zonewatch.operators import evidence as E
from zonewatch.operators import listings as L
from zonewatch.operators import tables as T
from zonewatch.session import checkpoint_dir
from zonewatch.sources import frames as FR
from zonewatch.sources import tables as TS

from . import query
from .sqlviews import add, sql
from .views import BASE_US

add("srcfirst", """(
  SELECT source_event_id, arg_min(alert_id, us) AS alert_id, min(us) AS us FROM linked GROUP BY source_event_id)""", ["linked"])
add("alert", """(
  SELECT l.alert_id, l.dedup_key, l.camera_id, l.zone_id, l.rule_type, l.object_type, l.started_us, l.first_seq, l.opened,
         l.last_seq, l.last_seen_us, l.events,
         1 + coalesce(f.fresh, 0) - CASE WHEN o.us = l.opened THEN 1 ELSE 0 END AS active_source_count,
         (SELECT min(us) FROM linked s WHERE s.us > l.last_seen_us + 30000000) AS ended_us
  FROM (SELECT alert_id, dedup_key, camera_id, zone_id, rule_type, object_type, arg_min(first_us, (us, seq, source_event_id)) AS started_us,
               arg_min(first_seq, (us, seq, source_event_id)) AS first_seq, min(us) AS opened,
               arg_min(source_event_id, (us, seq, source_event_id)) AS opener,
               arg_max(seq, (us, seq, source_event_id)) AS last_seq, max(us) AS last_seen_us, count(*) AS events
        FROM linked GROUP BY ALL) l
  LEFT JOIN (SELECT alert_id, count(*) AS fresh FROM srcfirst GROUP BY alert_id) f ON f.alert_id = l.alert_id
  LEFT JOIN srcfirst o ON o.source_event_id = l.opener AND o.alert_id = l.alert_id)""", ["linked", "srcfirst"])


def alert_rows(v):
    return v.staged("alerts", lambda: A.alert_sessions(v.linked.drop("dedup_key", "alert_us", "alert_id")))


@query("alert_sessions", sql("alert", """
SELECT alert_id, started_us, first_seq, last_seq, last_seen_us, events, active_source_count, ended_us,
       CASE WHEN ended_us IS NULL THEN 'active' ELSE 'resolved' END AS lifecycle_status FROM alert"""))
def _(v):
    return A.alert_sessions(v.linked.drop("dedup_key", "alert_us", "alert_id")).select(
        "alert_id", "started_us", "first_seq", "last_seq", "last_seen_us", "events", "active_source_count", "ended_us",
        "lifecycle_status",
    )


@query("alert_of_event", sql("linked", "SELECT source_event_id, us, alert_id FROM linked"))
def _(v):
    return A.with_alert(v.linked.drop("dedup_key", "alert_us", "alert_id")).select("source_event_id", "us", "alert_id")


NOW = BASE_US + 400_000_000


@query("resolve_stale", sql("alert", f"""
SELECT alert_id, CASE WHEN {NOW} - last_seen_us > 30000000 THEN 'resolved' ELSE 'active' END AS lifecycle_status,
       CASE WHEN {NOW} - last_seen_us > 30000000 THEN {NOW} END AS ended_us FROM alert"""))
def _(v):
    fresh = alert_rows(v).withColumns({"ended_us": F.lit(None).cast("bigint"), "lifecycle_status": F.lit("active")})
    return A.resolve_stale(fresh, NOW).select("alert_id", "lifecycle_status", "ended_us")


@query("list_alerts", sql("alert", "SELECT alert_id, last_seen_us FROM alert ORDER BY last_seen_us DESC, opened DESC, alert_id LIMIT 50"))
def _(v):
    return L.list_alerts(alert_rows(v), limit=50).select("alert_id", "last_seen_us")


@query("search_alerts", sql("alert", f"""
SELECT alert_id FROM alert WHERE ended_us IS NOT NULL AND rule_type IN ('person_intrusion', 'vehicle_intrusion')
  AND last_seen_us BETWEEN {BASE_US} AND {NOW}"""))
def _(v):
    return A.search_alerts(alert_rows(v), "resolved", "high", BASE_US, NOW).select("alert_id")


def iso(us: str) -> str:
    """An instant as text with milliseconds, in SQL."""
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST({us} % 1000000 // 1000 AS VARCHAR), 3, '0') || 'Z'"


NONE = "CAST(NULL AS VARCHAR)"


@query("present_alerts", sql("alert", f"""
SELECT alert_id AS id, dedup_key, camera_id, zone_id, rule_config_id, rule_type, object_type,
  CASE WHEN rule_type IN ('person_intrusion', 'vehicle_intrusion') THEN 'high' WHEN rule_type = 'crowd_limit' THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN ended_us IS NULL THEN 'active' ELSE 'resolved' END AS lifecycle_status, active_source_count, first_seq AS first_sequence_number,
  last_seq AS last_sequence_number, {iso("started_us")} AS started_at, {iso("last_seen_us")} AS last_seen_at, {iso("ended_us")} AS ended_at,
  {NONE} AS payload, {iso("opened")} AS created_at, {iso("last_seen_us")} AS updated_at
FROM alert JOIN (SELECT alert_id AS k, arg_min(rule_id, (us, seq, source_event_id)) AS rule_config_id FROM linked GROUP BY alert_id) ON k = alert_id"""))
def _(v):
    rows = alert_rows(v).withColumns({"created_us": F.col("alert_us"), "updated_us": F.col("last_seen_us")})
    return TS.present_alert(rows)


@query("present_events", sql("aievent", f"""
SELECT id, alert_id, id AS source_event_id, camera_id, zone_id, rule_config_id, event_type, object_type, track_id, confidence, 'active' AS lifecycle_status,
  first_seq AS first_sequence_number, last_seq AS last_sequence_number, {iso("started_us")} AS started_at, {iso("last_seen_us")} AS last_seen_at,
  {NONE} AS ended_at, {NONE} AS payload, {iso("started_us")} AS created_at, {iso("last_seen_us")} AS updated_at FROM aievent"""))
def _(v):
    return TS.present_event(v.ai_events.withColumn("updated_us", F.col("last_seen_us")))


@query("present_evidence", sql("evidence", f"""
SELECT id, alert_id, ai_event_id, camera_id, evidence_type, id || '.jpg' AS storage_key, 'image/jpeg' AS mime_type, CAST(NULL AS BIGINT) AS file_size, frame_id,
  CAST(NULL AS BIGINT) AS sequence_number, {iso("captured_us")} AS captured_at, {NONE} AS started_at, {NONE} AS ended_at, 10e0 AS duration_seconds,
  {NONE} AS codec, 2e0 AS fps, 640 AS frame_width, 360 AS frame_height, status, {iso("created_us")} AS created_at,
  '/api/evidence/' || id || '/media' AS media_url FROM evidence"""))
def _(v):
    e = v.evidence.withColumns({
        "storage_key": F.concat("id", F.lit(".jpg")), "mime_type": F.lit("image/jpeg"), "duration_seconds": F.lit(10.0), "fps": F.lit(2.0),
        "frame_width": F.lit(640), "frame_height": F.lit(360)})
    return TS.present_evidence(e)


@query("present_reference_frames", sql("frame", f"""
SELECT frame_id AS id, camera_id, frame_id || '.jpg' AS storage_key, 'image/jpeg' AS mime_type, 640 AS frame_width, 360 AS frame_height,
  {iso("us")} AS captured_at, {iso("us")} AS created_at, '/frames/' || frame_id || '.jpg' AS image_url FROM frame WHERE seq = 1"""))
def _(v):
    """The first frame of each camera."""
    first = v.frames.groupBy("camera_id").agg(F.min_by(F.struct("frame_id", "us", "frame_w", "frame_h"), F.col("seq")).alias("f")).select(
        F.col("f.frame_id").alias("id"), "camera_id", F.concat("f.frame_id", F.lit(".jpg")).alias("storage_key"), F.lit("image/jpeg").alias("mime_type"),
        F.col("f.frame_w").alias("frame_width"), F.col("f.frame_h").alias("frame_height"), F.col("f.us").alias("captured_us"), F.col("f.us").alias("created_us"))
    return TS.present_reference_frame(first, F.concat(F.lit("/frames/"), "storage_key"))


@query("event_payload", sql("hb", """
SELECT source_event_id, heartbeat_index, rule_type || '_v1' AS rule_name, CAST(round_even((us - first_us) / 1000000e0, 0) AS INTEGER) AS elapsed,
  CASE rule_type WHEN 'person_intrusion' THEN 'FORBIDDEN_ZONE_INTRUSION' WHEN 'vehicle_intrusion' THEN 'FORBIDDEN_ZONE_INTRUSION'
    WHEN 'loitering' THEN 'RESTRICTED_ZONE_LOITERING' ELSE 'RESTRICTED_ZONE_VEHICLE_STOPPING' END AS contract_type,
  upper(object_type) AS object_type
FROM hb WHERE who <> 'crowd'"""))
def _(v):
    none = F.lit(None)
    seconds = payload.seconds_between(F.col("first_us"), F.col("us"))
    obj = payload.object_summary(F.col("track_key"), F.col("track_id"), F.col("class_name"), F.col("confidence"), F.col("bbox"),
                                 seconds, none.cast("string"), none.cast("double"))
    from zonewatch.operators.sessions import heartbeat_events

    e = heartbeat_events(v.pictured_violations).withColumns({
        "location_id": none.cast("string"), "frame_id": keys.frame_id(F.col("camera_id"), F.col("seq")),
        "objects": F.array(obj), "object_count": F.lit(1), "reattached_from": none.cast("string"),
        "detection": F.struct("class_name", "confidence"),
    })
    text = F.to_json(payload.event_payload())
    got = lambda path: F.get_json_object("payload", path)
    return e.select("source_event_id", "heartbeat_index", text.alias("payload")).select(
        "source_event_id", F.col("heartbeat_index").cast("bigint").alias("heartbeat_index"),
        got("$.contract.metadata.rule_name").alias("rule_name"), got("$.elapsed_seconds").cast("int").alias("elapsed"),
        got("$.contract.event_type").alias("contract_type"), got("$.contract.objects[0].object_type").alias("object_type"),
    )


@query("violation_summary", sql("viol", """
SELECT camera_id || '|' || zone_id || '|' || rule_id || '|' || who AS key, seq AS sequence_number, track_key AS track_id FROM viol"""))
def _(v):
    none = F.lit(None).cast("string")
    cols = ["camera_id", "zone_id", "rule_id", "rule_type", "track_key", "first_us", "us", "seq", "object_type"]
    rows = v.violations.withColumn("object_type", F.col("class_name")).select(*cols).unionByName(
        v.crowds.where("is_violation").select(*cols))
    rows = rows.withColumns({"source_event_id": none, "zone_name": none, "object_count": F.lit(1), "direction": none})
    s = payload.violation_summary()
    return rows.select(s["key"].alias("key"), s["sequence_number"].alias("sequence_number"), s["track_id"].alias("track_id"))


@query("backend_event", sql("linked", """
SELECT source_event_id AS ai_event_id, us, object_type, location_id AS area_id
FROM linked JOIN camera ON camera.id = camera_id"""))
def _(v):
    e = L.with_location(v.linked, v.cameras).withColumnsRenamed({"location_id": "area_id"}).withColumns(
        {"last_seen_us": F.col("us"), "id": F.col("source_event_id")})
    b = payload.backend_event()
    return e.select(b["aiEventId"].alias("ai_event_id"), "us", b["objectType"].alias("object_type"), b["areaId"].alias("area_id"))


@query("upsert_ai_events", sql("aievent", """
SELECT id AS source_event_id, event_type, started_us, last_seen_us, last_seq, confidence, coalesce(alert_id, 'old') AS alert_id
FROM aievent"""))
def _(v):
    first = v.linked.where("heartbeat_index = 1")
    cols = {"id": F.col("source_event_id"), "last_seen_us": F.col("us")}
    base = first.withColumns(cols).withColumn("alert_id", F.lit("old")).select(
        "source_event_id", "id", "event_type", "started_us", "last_seen_us", "last_seq", "confidence", "alert_id")
    linked_later = F.when(F.col("heartbeat_index") > 1, F.col("alert_id"))
    changes = v.linked.withColumns(cols).withColumn("alert_id", linked_later).select(
        "source_event_id", "id", "event_type", "started_us", "last_seen_us", "last_seq", "confidence", "alert_id", "us")
    return T.upsert_ai_events(base, changes).drop("id")


@query("mirror_alerts", sql("alert", """
SELECT alert_id AS id, CASE WHEN mirrored THEN 'backend:' || alert_id ELSE dedup_key END AS dedup_key,
       CASE WHEN mirrored THEN last_seen_us ELSE 0 END AS last_seen_us FROM (
  SELECT *, rule_type = 'loitering' OR rule_type LIKE '%intrusion' AS mirrored FROM alert)"""))
def _(v):
    a = alert_rows(v).withColumn("id", F.col("alert_id"))
    kept = ["id", "dedup_key", "last_seen_us", "lifecycle_status", "ended_us", "last_seq", "risk_level", "active_source_count"]
    theirs = F.col("event_type") == "loitering"
    base = a.where(~F.col("event_type").contains("intrusion")).withColumn(
        "dedup_key", F.when(theirs, F.concat(F.lit("backend:"), "id")).otherwise(F.col("dedup_key"))
    ).withColumn("last_seen_us", F.lit(0).cast("bigint")).select(*kept)
    changes = a.select("id", "last_seq", F.col("last_seen_us").alias("us"))
    return T.mirror_alerts(base, changes).select("id", "dedup_key", "last_seen_us")


@query("plan_snapshots", sql("shot", "SELECT source_event_id, alert_id, us FROM shot"))
def _(v):
    return E.plan_snapshots(v.pictured(v.linked), every_s=5.0).select(F.col("event_id").alias("source_event_id"), "alert_id", "us")


HALF = BASE_US + 250_000_000


@query("plan_snapshots_continued", sql("shot", f"SELECT source_event_id, alert_id, us FROM shot WHERE us > {HALF}"))
def _(v):
    """Planning goes on from the evidence there is: what came before is limited by it and isn't planned again."""
    taken = v.snapshots.where(F.col("us") <= HALF).select(
        F.col("source_event_id").alias("ai_event_id"), "alert_id", "frame_id", F.col("us").alias("captured_us"))
    later = v.pictured(v.linked.where(F.col("us") > HALF))
    return E.plan_snapshots(later, taken, every_s=5.0).select(F.col("event_id").alias("source_event_id"), "alert_id", "us")


@query("frames_around", sql("around", "SELECT clip_id, count(*) AS frames, min(us) AS first_us, max(us) AS last_us FROM around GROUP BY ALL"))
def _(v):
    pairs = E.frames_around(v.clip_spans, v.results)
    return pairs.groupBy(F.col("event_id").alias("clip_id")).agg(
        F.count("*").alias("frames"), F.min("frame_us").alias("first_us"), F.max("frame_us").alias("last_us"))


@query("sample_clip", sql("cliprow", "SELECT clip_id, us FROM cliprow"))
def _(v):
    shots = v.staged("shots", lambda: E.frames_around(v.clip_spans, v.results))
    return E.sample_clip(shots, "event_id", 2.0).select(F.col("event_id").alias("clip_id"), F.col("frame_us").alias("us"))


@query("plan_clips", sql("clip", "SELECT clip_id, frames, status FROM clip"))
def _(v):
    return E.plan_clips(v.clip_spans, v.results, fps=2.0).select(F.col("event_id").alias("clip_id"), "frames", "status")


@query("frame_for_event", sql("visit frame", f"""
SELECT v.event_id, f.frame_id AS shot_frame_id FROM visit v
ASOF JOIN frame f ON f.camera_id = v.camera_id AND f.us <= {BASE_US} + v.t0"""))
def _(v):
    seq = F.expr("t0 div 200000L + 1")
    own = F.when(F.col("event_id") % 2 == 0, keys.frame_id(F.col("camera_id"), seq)).otherwise("gone")
    e = v.visits.select("event_id", "camera_id", (F.lit(BASE_US) + F.col("t0")).alias("us"), own.alias("frame_id"))
    return E.frame_for_event(e, v.frames).select("event_id", "shot_frame_id")


@query("next_after", sql("visit result", """
SELECT v.event_id, r.seq, r.frame_id FROM visit v ASOF JOIN result r ON r.camera_id = v.camera_id AND r.seq > v.t0 // 200000 + 40"""))
def _(v):
    cursors = v.visits.select("event_id", "camera_id", F.expr("t0 div 200000L + 40").alias("after_seq"))
    return E.next_after(cursors, v.results).select("event_id", "seq", "frame_id")


@query("pair_frames_results", sql("frame result", """
SELECT f.camera_id, f.frame_id, f.us AS frame_us, r.objects FROM frame f JOIN result r ON r.camera_id = f.camera_id AND r.frame_id = f.frame_id"""))
def _(v):
    f = v.frames.select("camera_id", "frame_id", F.col("us").alias("frame_us"))
    return E.pair_frames_results(f, v.results.select("camera_id", "frame_id", "objects"))


@query("evidence_with_event", sql("evidence aievent", """
SELECT e.id, a.event_type, a.zone_id, a.object_type FROM evidence e LEFT JOIN aievent a ON a.id = e.ai_event_id"""))
def _(v):
    return E.evidence_with_event(v.evidence, v.ai_events).select("id", "event_type", "zone_id", "object_type")


@query("search_evidence", sql("evidence aievent", f"""
SELECT e.id, e.captured_us FROM evidence e LEFT JOIN aievent a ON a.id = e.ai_event_id
WHERE e.evidence_type = 'snapshot' AND e.status = 'completed' AND e.captured_us BETWEEN {BASE_US} AND {NOW}
  AND a.event_type = 'person_intrusion' AND a.object_type = 'person'
ORDER BY captured_us DESC, created_us DESC, e.id LIMIT 100"""))
def _(v):
    return E.search_evidence(
        v.evidence, v.ai_events, evidence_type="snapshot", status="completed", from_us=BASE_US, to_us=NOW,
        event_type="person_intrusion", object_type="person",
    ).select("id", "captured_us")


@query("related_evidence", sql("evidence aievent", """
SELECT DISTINCT a.id AS asked_id, e.id FROM aievent a JOIN evidence e ON e.ai_event_id = a.id OR e.alert_id = a.alert_id"""))
def _(v):
    ids = v.ai_events.select("id")
    return E.related_evidence(ids, v.ai_events, v.evidence).select("asked_id", "id")


@query("evidence_media", sql("evidence", """
SELECT id, strlen(id || ' ' || camera_id || ' ' || captured_us) AS bytes, md5(id || ' ' || camera_id || ' ' || captured_us) AS content_md5
FROM evidence WHERE evidence_type = 'snapshot'"""))
def _(v):
    """Pictures are stored, clips aren't yet; every row is asked for once by its key and once by one that leads out of the store."""
    root = f"{checkpoint_dir(v.spark)}/media-{uuid.uuid4().hex}"
    e = v.evidence.withColumn("storage_key", F.concat_ws("/", "camera_id", F.concat("id", F.lit(".jpg"))))
    content = F.concat_ws(" ", "id", "camera_id", F.col("captured_us").cast("string")).cast("binary")
    TS.write_media(v.spark, root, e.where("evidence_type = 'snapshot'").withColumn("content", content))
    outside = e.withColumn("storage_key", F.concat(F.lit("x/../../"), "storage_key"))
    return TS.evidence_media(v.spark, root, e.unionByName(outside)).select("id", "bytes", F.md5("content").alias("content_md5"))


@query("table_snapshots", sql("aievent", f"""
SELECT id, camera_id, started_us FROM aievent WHERE started_us >= {BASE_US + 60_000_000}"""))
def _(v):
    """A table written twice: the second snapshot holds, read by a predicate, with a folder a camera."""
    root = f"{checkpoint_dir(v.spark)}/tables-{uuid.uuid4().hex}"
    rows = v.ai_events.select("id", "camera_id", "started_us")
    TS.write_table(rows.where(F.col("camera_id") < "cam-2"), root, "ai_event")
    TS.write_table(rows, root, "ai_event", partition_by=["camera_id"])
    return TS.read_table(v.spark, root, "ai_event", f"started_us >= {BASE_US + 60_000_000}").select("id", "camera_id", "started_us")


@query("attach_alert", sql("evidence aievent", """
SELECT e.id, coalesce(e.alert_id, a.alert_id) AS alert_id FROM evidence e LEFT JOIN aievent a ON a.id = e.ai_event_id"""))
def _(v):
    links = v.ai_events.select(F.col("id").alias("ai_event_id"), "alert_id").where("alert_id IS NOT NULL")
    return E.attach_alert(v.evidence, links).select("id", "alert_id")


@query("list_evidence", sql("evidence", "SELECT id FROM evidence ORDER BY captured_us DESC, created_us DESC, id LIMIT 500"))
def _(v):
    return E.list_evidence(v.evidence, 9999).select("id")


@query("latest_evidence", sql("evidence", "SELECT ai_event_id, max(captured_us) AS captured_us FROM evidence GROUP BY ai_event_id"))
def _(v):
    return L.latest(v.evidence, ["ai_event_id"], ["captured_us", "created_us", "id"]).select("ai_event_id", "captured_us")


@query("list_events", sql("aievent", "SELECT id, started_us FROM aievent WHERE camera_id = 'cam-3' ORDER BY started_us DESC, id LIMIT 100"))
def _(v):
    return L.list_events(v.ai_events, "cam-3").select("id", "started_us")


@query("filter_events", sql("aievent", f"""
SELECT id FROM aievent WHERE event_type = 'person_intrusion' AND alert_id IS NOT NULL AND started_us BETWEEN {BASE_US} AND {NOW}"""))
def _(v):
    return L.filter_events(v.ai_events, "person_intrusion", True, BASE_US, NOW).select("id")


@query("page_of_events", sql("aievent", """
SELECT id, started_us, 2 AS page, 20 AS page_size, (SELECT count(*) FROM aievent) AS total_items,
       ((SELECT count(*) FROM aievent) + 19) // 20 AS total_pages
FROM (SELECT * FROM aievent ORDER BY started_us DESC, id LIMIT 20 OFFSET 20)"""))
def _(v):
    rows, totals = L.page(v.ai_events, "-started_us", 2)
    return rows.select("id", "started_us", *[totals.select(c).scalar().alias(c) for c in totals.columns])


@query("page_after", sql("aievent", "SELECT id, started_us FROM aievent ORDER BY started_us DESC, id LIMIT 20 OFFSET 20"))
def _(v):
    last = L.page_after(v.ai_events, "-started_us").select("started_us", "id").collect()[-1]
    return L.page_after(v.ai_events, "-started_us", (last.started_us, last.id)).select("id", "started_us")


@query("events_without_alert", sql("aievent", "SELECT id FROM aievent WHERE alert_id IS NULL"))
def _(v):
    return L.filter_events(v.ai_events, has_alert=False).select("id")


@query("validate_events", """
SELECT event_id, concat_ws(',', CASE WHEN user_id % 10 = 0 THEN 'source_event_id' END,
  CASE WHEN event_type NOT IN ('view', 'click') THEN 'event_type' END, CASE WHEN user_id % 3 = 0 THEN 'zone_id' END,
  CASE WHEN value > 50 THEN 'confidence' END) AS reasons
FROM events WHERE user_id % 10 = 0 OR event_type NOT IN ('view', 'click') OR user_id % 3 = 0 OR value > 50""")
def _(v):
    c = F.col
    df = v.source.select(
        "event_id", F.when(c("user_id") % 10 != 0, c("event_id").cast("string")).otherwise("").alias("source_event_id"),
        F.lit("cam").alias("camera_id"),
        F.when(c("event_type") == "view", "loitering").when(c("event_type") == "click", "FORBIDDEN_ZONE_INTRUSION")
        .otherwise(c("event_type")).alias("event_type"),
        F.when(c("user_id") % 3 != 0, "z").alias("zone_id"), F.lit("person").alias("object_type"),
        (c("value") / 50).alias("confidence"), c("us").alias("started_us"),
    )
    _, bad = FR.validate_events(df)
    return bad.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("handling_status", sql("linked", """
SELECT alert_id, arg_max(['NEW', 'ACKNOWLEDGED', 'IN_PROGRESS', 'RESOLVED'][1 + CAST(seq % 4 AS INTEGER)], (us, seq, source_event_id)) AS status,
       max(us) AS changed_us, count(*) AS changes FROM linked GROUP BY alert_id"""))
def _(v):
    names = F.array(*[F.lit(s) for s in ("NEW", "ACKNOWLEDGED", "IN_PROGRESS", "RESOLVED")])
    log = v.linked.select("alert_id", F.get(names, (F.col("last_seq") % 4).cast("int")).alias("status"), "us",
                          F.struct("last_seq", "source_event_id").alias("seq"))
    return A.handling_status(log)


@query("contract_alerts", sql("stay crowdrun", """
SELECT camera_id, us, who, CASE WHEN rule_type LIKE '%_intrusion' THEN 'UNAUTHORIZED_ENTRY' WHEN rule_type = 'loitering' THEN 'LOITERING' ELSE 'CROWDING' END AS alert_type,
  CASE WHEN rule_type = 'loitering' THEN 'MEDIUM' ELSE 'HIGH' END AS alert_level
FROM (SELECT camera_id, us, track_key AS who, rule_type, us - first_us AS t, 1 AS people FROM stay
      UNION ALL SELECT camera_id, us, 'crowd', 'crowd_limit', us - first_us, people FROM crowdrun)
WHERE rule_type LIKE '%_intrusion' OR (rule_type = 'loitering' AND t >= 10000000) OR (rule_type = 'crowd_limit' AND people >= 3 AND t >= 5000000)"""))
def _(v):
    from zonewatch.functions.rules import contract_event_type

    zero = F.lit(0).cast("bigint")
    stays = v.stays.select("camera_id", "us", F.col("track_key").alias("who"), "rule_type", "zone_type",
                           F.col("elapsed_s").alias("dwell_s"), zero.alias("people"), F.lit(0.0).alias("held_s"))
    crowds = v.crowds.select("camera_id", "us", F.lit("crowd").alias("who"), "rule_type", F.lit("controlled_area").alias("zone_type"),
                             F.lit(0.0).alias("dwell_s"), "people", F.col("elapsed_s").alias("held_s"))
    e = stays.unionByName(crowds).withColumn("event_type", contract_event_type(F.col("rule_type")))
    return A.contract_alerts(e).select("camera_id", "us", "who", "alert_type", "alert_level")


def _ingested(v, batches: int):
    """All publications through the event store, cut into batches along time."""
    import uuid

    from zonewatch.session import checkpoint_dir
    from zonewatch.streaming.sinks import EventStore

    def build():
        store = EventStore(v.spark, f"{checkpoint_dir(v.spark)}/stores/{uuid.uuid4().hex}", every_s=5.0)
        rows = v.linked.drop("dedup_key", "alert_us", "alert_id").withColumn("frame_id", keys.frame_id(F.col("camera_id"), F.col("last_seq")))
        lo, hi = rows.agg(F.min("us"), F.max("us")).first()
        step = (hi - lo) // batches + 1
        for k in range(batches):
            store.ingest(rows.where(F.col("us").between(lo + k * step, lo + (k + 1) * step - 1)), k)
        return store

    name = f"store-{batches}"
    key = (v.spark.sparkContext.applicationId, v.folder, name)
    if key not in _STORES:
        _STORES[key] = build()
    return _STORES[key]


_STORES: dict = {}
INGESTED = """
SELECT alert_id, started_us, first_seq, last_seq, last_seen_us, events, active_source_count, ended_us,
       CASE WHEN ended_us IS NULL THEN 'active' ELSE 'resolved' END AS lifecycle_status FROM alert"""


def _alerts_of(store):
    return store.alerts().where("alert_id IS NOT NULL").select(
        "alert_id", "started_us", "first_seq", "last_seq", "last_seen_us", "events", "active_source_count", "ended_us", "lifecycle_status")


@query("ingest_at_once", sql("alert", INGESTED))
def _(v):
    return _alerts_of(_ingested(v, 1))


@query("ingest_in_batches", sql("alert", INGESTED))
def _(v):
    return _alerts_of(_ingested(v, 7))


@query("ingested_events", sql("linked", """
SELECT source_event_id, min(rule_type) AS event_type, min(first_us) AS started_us, max(us) AS last_seen_us, max(seq) AS last_seq,
       arg_max(confidence, us) AS confidence, arg_max(alert_id, us) AS alert_id FROM linked GROUP BY source_event_id"""))
def _(v):
    return _ingested(v, 7).events().where("source_event_id IS NOT NULL").select(
        "source_event_id", "event_type", "started_us", "last_seen_us", "last_seq", "confidence", "alert_id")


@query("ingested_evidence", sql("shot", "SELECT source_event_id AS ai_event_id, alert_id, us AS captured_us FROM shot"))
def _(v):
    return _ingested(v, 7).evidence().select("ai_event_id", "alert_id", "captured_us")
