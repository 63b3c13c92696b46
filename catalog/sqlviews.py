"""The same views in SQL, as WITH clauses to put in front of a query."""

from __future__ import annotations

from .views import BASE_US, CLASS_OF, RULES, TENANT, ZONES, polygon_text


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"{v}e0"
    return f"'{v}'" if isinstance(v, str) else str(v)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


def crossings(points, x: str, y: str) -> str:
    """Number of polygon borders to the right of a point."""
    terms = []
    for i, (x1, y1) in enumerate(points):
        x2, y2 = points[i - 1]
        if y1 != y2:
            terms.append(
                f"(CASE WHEN ({y1}e0 > {y}) <> ({y2}e0 > {y}) AND {x} < {x2 - x1}e0 * ({y} - {y1}e0) / {y2 - y1}e0 + {x1}e0 "
                "THEN 1 ELSE 0 END)"
            )
    return "(" + " + ".join(terms) + ")"


CLASS_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_OF.items()) + " END"

BASE = "base AS (SELECT greatest(60, (count(*) * 6) // 100) AS fold FROM events)"
VISIT = f"""visit AS (
  SELECT event_id, 'cam-' || (user_id % 25) AS camera_id, (event_id * 2654435761) % 4294967296 AS h,
         epoch_us(ts) % (fold * 1000000) AS t0, event_type, user_id
  FROM events, base)"""
DET = f"""det AS (
  SELECT camera_id, event_id, {CLASS_CASE} AS class_name, t0 // 200000 + i + 1 AS seq,
         {BASE_US} + (t0 // 200000 + i) * 200000 AS us, (40 + (h + i) % 60) / 100.0e0 AS confidence,
         CAST((h // 100) % 640 + ((h // 7) % 9 - 4) * i AS DOUBLE) AS fx,
         CAST(60 + (h // 64000) % 300 + ((h // 63) % 5 - 2) * i AS DOUBLE) AS fy,
         {CLASS_CASE} || '-' || event_id AS track_key
  FROM (SELECT *, unnest(range(5 + h % 100)) AS i FROM visit))"""
CAMERA = f"""camera AS (
  SELECT 'cam-' || n_nationkey AS id, '{TENANT}' AS tenant_id, 'loc-' || n_regionkey AS location_id, n_name AS name,
         'RTSP' AS source_type, 'rtsp://host/' || n_nationkey AS source_url, 'active' AS status FROM nation)"""
LOCATION = f"""location AS (
  SELECT 'loc-' || r_regionkey AS id, '{TENANT}' AS tenant_id, r_name AS name, lower(r_name) AS code FROM region)"""
FRAME = f"""frame AS (
  SELECT camera_id, location_id, seq, {BASE_US} + (seq - 1) * 200000 AS us,
         camera_id || '-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS frame_id
  FROM (SELECT id AS camera_id, location_id, unnest(range(1, fold * 5 + 106)) AS seq FROM camera, base))"""
ZONE = f"""zone AS (
  SELECT id || ':' || k AS id, id AS camera_id, k AS name, zone_type, polygon, fw, fh, enabled, n
  FROM camera, (VALUES {values([(k, t, polygon_text(p), s[0], s[1], e, len(p)) for k, t, p, s, e in ZONES])})
       v(k, zone_type, polygon, fw, fh, enabled, n))"""
RULE = f"""rule AS (
  SELECT id || ':' || k || ':' || rule_type AS id, id || ':' || k AS zone_id, id AS camera_id, rule_type, enabled,
         object_type, duration_threshold, people_threshold, confidence_threshold, timed,
         nullif(a, '') AS a, nullif(b, '') AS b
  FROM camera, (VALUES {values(RULES)})
       v(k, rule_type, enabled, object_type, duration_threshold, people_threshold, confidence_threshold, timed, a, b))"""

ARROW = ZONES[1][2]
ZHIT = f"""zhit AS (
  SELECT *, camera_id || ':' || k AS zone_id FROM (
    SELECT *, 'rect' AS k FROM det WHERE fx >= 200 AND fx < 440 AND fy >= 120 AND fy < 300
    UNION ALL SELECT *, 'arrow' FROM det WHERE {crossings(ARROW, 'fx', 'fy')} % 2 = 1
    UNION ALL SELECT *, 'half' FROM det
      WHERE fx * 320 / 640e0 >= 230 AND fx * 320 / 640e0 < 310 AND fy * 180 / 360e0 >= 60 AND fy * 180 / 360e0 < 170))"""
RHIT = """rhit AS (
  SELECT h.*, r.id AS rule_id, r.rule_type, r.duration_threshold, r.people_threshold,
         r.object_type AS rule_object_type
  FROM zhit h JOIN (SELECT *, CAST(split_part(a, ':', 1) AS BIGINT) * 60 + CAST(split_part(a, ':', 2) AS BIGINT) AS am,
                           CAST(split_part(b, ':', 1) AS BIGINT) * 60 + CAST(split_part(b, ':', 2) AS BIGINT) AS bm
                    FROM rule WHERE enabled) r ON r.zone_id = h.zone_id
  WHERE (r.object_type IS NULL OR r.object_type = h.class_name
         OR (r.object_type = 'vehicle' AND h.class_name IN ('car', 'motorcycle', 'bus', 'truck')))
    AND (r.confidence_threshold IS NULL OR h.confidence >= r.confidence_threshold)
    AND (NOT r.timed OR CASE WHEN am <= bm THEN (us // 60000000 + 420) % 1440 BETWEEN am AND bm
                             ELSE (us // 60000000 + 420) % 1440 >= am OR (us // 60000000 + 420) % 1440 <= bm END))"""
PREV = "prevf AS (SELECT camera_id, us, lag(us) OVER (PARTITION BY camera_id ORDER BY us) AS prev_us FROM frame)"
STAY = """stay AS (
  SELECT *, max(CASE WHEN opens THEN us END) OVER (PARTITION BY rule_id, track_key ORDER BY us) AS first_us FROM (
    SELECT *, coalesce(prev_us - lag(us) OVER w > 5000000, lag(us) OVER w IS NULL) AS opens
    FROM rhit JOIN prevf USING (camera_id, us)
    WHERE rule_type <> 'crowd_limit' AND duration_threshold IS NOT NULL
    WINDOW w AS (PARTITION BY rule_id, track_key ORDER BY us)))"""
CROWD = """crowd AS (
  SELECT camera_id, seq, us, zone_id, rule_id, count(DISTINCT track_key) AS people, min(confidence) AS min_confidence,
         min(duration_threshold) AS duration_threshold, min(people_threshold) AS people_threshold
  FROM rhit WHERE rule_type = 'crowd_limit' GROUP BY ALL)"""
CROWDRUN = """crowdrun AS (
  SELECT *, max(CASE WHEN opens THEN us END) OVER (PARTITION BY rule_id ORDER BY us) AS first_us FROM (
    SELECT *, lag(us) OVER w IS NULL OR lag(us) OVER w < prev_us AS opens
    FROM crowd JOIN prevf USING (camera_id, us) WHERE people >= people_threshold
    WINDOW w AS (PARTITION BY rule_id ORDER BY us)))"""

VIOL = """viol AS (
  SELECT rule_id || '|' || track_key || '|' || first_us AS sid, camera_id, zone_id, rule_id, rule_type, track_key,
         class_name AS object_type, confidence, us, seq, first_us, track_key AS who,
         row_number() OVER (PARTITION BY rule_id, track_key, first_us ORDER BY us) AS rn
  FROM stay WHERE us - first_us >= duration_threshold * 1000000
  UNION ALL
  SELECT rule_id || '|' || first_us, camera_id, zone_id, rule_id, 'crowd_limit', people || ' objects', 'person',
         min_confidence, us, seq, first_us, 'crowd', row_number() OVER (PARTITION BY rule_id, first_us ORDER BY us)
  FROM crowdrun WHERE us - first_us >= duration_threshold * 1000000)"""
VIOLNEXT = """violnext AS (
  SELECT a.sid, a.rn, b.rn AS nxt FROM viol a ASOF JOIN viol b ON a.sid = b.sid AND b.us >= a.us + 1000000)"""
BEAT = """beat AS /*recursive*/ (
  SELECT sid, rn, CAST(1 AS BIGINT) AS heartbeat_index FROM viol WHERE rn = 1
  UNION ALL SELECT b.sid, n.nxt, b.heartbeat_index + 1 FROM beat b JOIN violnext n ON n.sid = b.sid AND n.rn = b.rn)"""
HB = """hb AS (
  SELECT v.*, b.heartbeat_index, (first_us - 1704067200000000) // 200000 + 1 AS first_seq,
         camera_id || '|' || zone_id || '|' || rule_id || '|' || who || '|' || ((first_us - 1704067200000000) // 200000 + 1)
           AS source_event_id
  FROM beat b JOIN viol v ON v.sid = b.sid AND v.rn = b.rn)"""
LINKED = """linked AS (
  SELECT *, dedup_key || '@' || alert_us AS alert_id FROM (
    SELECT *, max(CASE WHEN opens THEN us END) OVER (PARTITION BY dedup_key ORDER BY us) AS alert_us FROM (
      SELECT *, coalesce(us - lag(us) OVER w > 30000000, lag(us) OVER w IS NULL) AS opens FROM (
        SELECT *, camera_id || '|' || zone_id || '|' || rule_type || '|' || object_type AS dedup_key FROM hb)
      WINDOW w AS (PARTITION BY dedup_key ORDER BY us))))"""
AIEVENT = """aievent AS (
  SELECT source_event_id AS id, min(camera_id) AS camera_id, min(zone_id) AS zone_id, min(rule_id) AS rule_config_id,
         min(rule_type) AS event_type, min(object_type) AS object_type, min(first_us) AS started_us,
         min(first_seq) AS first_seq, max(us) AS last_seen_us, max(seq) AS last_seq,
         arg_max(confidence, us) AS confidence, arg_min(track_key, us) AS track_id,
         CASE WHEN max(heartbeat_index) > 1 THEN arg_max(alert_id, us) END AS alert_id
  FROM linked GROUP BY source_event_id)"""
ORDER = [
    ("base", BASE), ("visit", VISIT), ("det", DET), ("camera", CAMERA), ("location", LOCATION), ("frame", FRAME),
    ("zone", ZONE), ("rule", RULE), ("zhit", ZHIT), ("rhit", RHIT), ("prevf", PREV), ("stay", STAY),
    ("crowd", CROWD), ("crowdrun", CROWDRUN), ("viol", VIOL), ("violnext", VIOLNEXT), ("beat", BEAT), ("hb", HB),
    ("linked", LINKED), ("aievent", AIEVENT),
]
NEEDS = {
    "base": [], "visit": ["base"], "det": ["visit"], "camera": [], "location": [], "frame": ["camera", "base"],
    "zone": ["camera"], "rule": ["camera"], "zhit": ["det"], "rhit": ["zhit", "rule"], "prevf": ["frame"],
    "stay": ["rhit", "prevf"], "crowd": ["rhit"], "crowdrun": ["crowd", "prevf"],
    "viol": ["stay", "crowdrun"], "violnext": ["viol"], "beat": ["viol", "violnext"], "hb": ["beat"],
    "linked": ["hb"], "aievent": ["linked"],
}


def add(name: str, text: str, needs: list[str]) -> None:
    """A further view, after those it needs."""
    ORDER.append((name, f"{name} AS {text}"))
    NEEDS[name] = needs


def sql(views: str, body: str) -> str:
    """``body`` behind the WITH clauses of the named views and all they need."""
    wanted: set[str] = set()
    todo = views.split()
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += NEEDS[name]
    clauses = [
        text if "/*recursive*/" in text else text.replace(" AS (", " AS MATERIALIZED (", 1)
        for name, text in ORDER if name in wanted
    ]
    recursive = "RECURSIVE " if any("/*recursive*/" in c for c in clauses) or "/*recursive*/" in body else ""
    body = body.strip()
    if body.upper().startswith("WITH "):
        raise ValueError("put further views in with add()")
    return (f"WITH {recursive}" + ",\n".join(clauses) + "\n" if clauses else "") + body


add("result", """(
  SELECT camera_id, seq, us, count(*) AS objects, camera_id || '-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS frame_id,
         10000 + seq * 7919 % 20000 AS inference_us, 30000 + seq * 104729 % 50000 AS latency_us
  FROM det GROUP BY camera_id, seq, us)""", ["det"])
add("reading", f"""(
  SELECT event_id AS reading_id, 's-' || s AS sensor_id, (['DOOR', 'PIR_MOTION', 'BEAM'])[1 + s % 3] AS sensor_type,
         'loc-' || s % 5 AS location_id, 'z-' || s % 7 AS zone_id, {BASE_US} + epoch_us(ts) % (fold * 1000000) AS us,
         value >= 30 AS positive
  FROM (SELECT *, user_id % 60 AS s FROM events), base)""", ["base"])
add("signal", f"""(
  SELECT event_id, 'cam-' || user_id % 25 AS camera_id, location_id, 'z-' || user_id % 7 AS zone_id,
         CASE event_type WHEN 'view' THEN 'FORBIDDEN_ZONE_INTRUSION' WHEN 'click' THEN 'RESTRICTED_ZONE_CROWDING'
              ELSE 'RESTRICTED_ZONE_LOITERING' END AS event_type, user_id % 11 AS track_id,
         {BASE_US} + epoch_us(ts) % (fold * 1000000) AS us, least(1e0, value / 50) AS confidence
  FROM events JOIN camera ON camera.id = 'cam-' || user_id % 25, base)""", ["base", "camera"])

add("snapk", "(SELECT alert_id, us, min(source_event_id) AS source_event_id FROM linked GROUP BY alert_id, us)", ["linked"])
add("snapn", "(SELECT a.alert_id, a.us, b.us AS nxt FROM snapk a ASOF JOIN snapk b ON a.alert_id = b.alert_id AND b.us >= a.us + 5000000)", ["snapk"])
add("snap", """/*recursive*/ (
  SELECT alert_id, min(us) AS us FROM snapk GROUP BY alert_id
  UNION ALL SELECT s.alert_id, n.nxt FROM snap s JOIN snapn n ON n.alert_id = s.alert_id AND n.us = s.us)""", ["snapk", "snapn"])
add("shot", """(
  SELECT l.source_event_id || '@' || l.us AS clip_id, l.source_event_id, l.alert_id, l.us, l.camera_id, l.seq, l.heartbeat_index
  FROM snap JOIN snapk k ON k.alert_id = snap.alert_id AND k.us = snap.us JOIN linked l ON l.source_event_id = k.source_event_id AND l.us = k.us)""", ["snap", "snapk", "linked"])
add("around", """(
  SELECT l.clip_id, l.us AS event_us, f.us, f.seq, l.camera_id
  FROM shot l JOIN result f ON f.camera_id = l.camera_id AND f.us BETWEEN l.us - 5000000 AND l.us + 5000000)""", ["shot", "result"])
add("arn", "(SELECT a.clip_id, a.us, b.us AS nxt FROM around a ASOF JOIN around b ON a.clip_id = b.clip_id AND b.us >= a.us + 500000)", ["around"])
add("ark", """/*recursive*/ (
  SELECT clip_id, min(us) AS us FROM around GROUP BY clip_id
  UNION ALL SELECT k.clip_id, n.nxt FROM ark k JOIN arn n ON n.clip_id = k.clip_id AND n.us = k.us)""", ["around", "arn"])
add("cliprow", "(SELECT * FROM ark UNION SELECT clip_id, max(us) FROM around GROUP BY clip_id)", ["ark", "around"])
add("clip", """(
  SELECT c.clip_id, count(*) AS frames,
         CASE WHEN min(c.us) > any_value(s.us) - 5000000 OR max(c.us) < any_value(s.us) + 5000000 THEN 'partial' ELSE 'completed' END AS status
  FROM cliprow c JOIN shot s USING (clip_id) GROUP BY c.clip_id)""", ["cliprow", "shot"])
add("evidence", """(
  SELECT 'ev-' || clip_id || '-' || kind AS id, source_event_id AS ai_event_id, CASE WHEN heartbeat_index > 1 THEN alert_id END AS alert_id,
         camera_id, kind AS evidence_type, status, us AS captured_us, us AS created_us,
         camera_id || '-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS frame_id
  FROM (SELECT *, 'snapshot' AS kind, 'completed' AS status FROM shot
        UNION ALL SELECT s.*, 'video_clip', c.status FROM shot s JOIN clip c USING (clip_id)))""", ["shot", "clip"])
