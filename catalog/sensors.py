"""Sensors, correlation, risk and liveness."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.operators import alerts as A
from zonewatch.operators import risk as R
from zonewatch.operators import sensors as N
from zonewatch.sources import messages as M

from . import query
from .sqlviews import add, sql
from .views import BASE_US

add("sact", """(
  SELECT *, count(*) OVER w = 3 AND min(CAST(positive AS INTEGER)) OVER w = 1 AS is_active,
         lead(us) OVER (PARTITION BY sensor_id ORDER BY us, reading_id) AS next_us
  FROM reading WINDOW w AS (PARTITION BY sensor_id ORDER BY us, reading_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""", ["reading"])


@query("sensor_active", sql("sact", "SELECT reading_id, sensor_id, is_active FROM sact"))
def _(v):
    return N.sensor_active(v.readings).select("reading_id", "sensor_id", "is_active")


@query("sensor_events", sql("reading", """
SELECT reading_id, CASE WHEN sensor_type = 'DOOR' THEN CASE WHEN positive THEN 'DOOR_OPENED' ELSE 'DOOR_CLOSED' END ELSE 'MOTION_DETECTED' END AS event_type
FROM reading WHERE sensor_type = 'DOOR' OR positive"""))
def _(v):
    return N.sensor_events(v.readings).select("reading_id", "event_type")


@query("normalise_events", sql("signal reading", """
SELECT 'ai:' || event_id AS event_id, 'AI' AS source, event_type, location_id, us, confidence FROM signal
UNION ALL SELECT 'iot:' || reading_id, 'IOT', CASE sensor_type WHEN 'DOOR' THEN 'DOOR_OPENED' ELSE 'MOTION_DETECTED' END, location_id, us, NULL
FROM reading WHERE positive"""))
def _(v):
    return N.normalise_events(v.signals, v.readings).drop("raw_reference_id")


@query("ai_active", sql("signal reading", """
SELECT r.reading_id, coalesce(r.us - s.us <= 3000000, FALSE) AS is_active, s.us AS last_event_us
FROM reading r ASOF LEFT JOIN (SELECT location_id, us FROM signal WHERE confidence >= 0.6e0) s
  ON s.location_id = r.location_id AND s.us <= r.us"""))
def _(v):
    points = v.readings.select("reading_id", "location_id", F.col("us").alias("asof_us"))
    return N.ai_active(v.signals, points).select("reading_id", "is_active", "last_event_us")


@query("correlate", sql("signal reading", """
SELECT s.event_id, arg_min(r.reading_id, (abs(s.us - r.us), r.reading_id)) AS sensor_event_id, min(abs(s.us - r.us)) AS apart_us, 'CRITICAL' AS alert_level
FROM signal s JOIN reading r ON (r.location_id = s.location_id OR r.zone_id = s.zone_id) AND abs(s.us - r.us) <= 10000000
WHERE s.event_type = 'FORBIDDEN_ZONE_INTRUSION' AND r.sensor_type = 'DOOR' AND r.positive GROUP BY s.event_id"""))
def _(v):
    doors = N.sensor_events(v.readings).withColumn("event_id", F.col("reading_id"))
    return A.correlate(v.signals, doors).select("event_id", "sensor_event_id", "apart_us", "alert_level")


add("dkey", """(
  SELECT *, event_type || '|' || camera_id || '|' || zone_id || '|' || CASE WHEN event_type = 'RESTRICTED_ZONE_CROWDING' THEN '' ELSE CAST(track_id AS VARCHAR) END AS k
  FROM signal)""", ["signal"])
add("dnext", "(SELECT a.k, a.us, b.us AS nxt FROM dkey a ASOF JOIN dkey b ON a.k = b.k AND b.us >= a.us + 60000000)", ["dkey"])
add("dkept", """/*recursive*/ (
  SELECT k, min(us) AS us FROM dkey GROUP BY k
  UNION ALL SELECT d.k, n.nxt FROM dkept d JOIN dnext n ON n.k = d.k AND n.us = d.us)""", ["dkey", "dnext"])


@query("dedup_events", sql("dkept dkey", "SELECT e.event_id, e.us FROM dkept d JOIN dkey e ON e.k = d.k AND e.us = d.us"))
def _(v):
    return N.dedup_events(v.signals).select("event_id", "us")


add("gaps", """(
  SELECT camera_id, us, lag(us) OVER (PARTITION BY camera_id ORDER BY us) AS last_us FROM result)""", ["result"])


@query("liveness", sql("gaps", """
SELECT camera_id, 'OFFLINE' AS status, last_us + 1000000 AS at_us, last_us, CAST(NULL AS DOUBLE) AS downtime_s FROM gaps WHERE us - last_us > 1000000
UNION ALL SELECT camera_id, 'ONLINE', us, last_us, (us - last_us) / 1000000e0 FROM gaps WHERE us - last_us > 1000000
UNION ALL SELECT camera_id, 'OFFLINE', max(us) + 1000000, max(us), NULL FROM gaps GROUP BY camera_id
  HAVING (SELECT max(us) FROM gaps) - max(us) > 1000000"""))
def _(v):
    now = v.results.agg(F.max("us")).scalar()
    return N.liveness(v.results, "camera_id", 1.0, now)


# Gaps of a camera, and of them those that come at least 30 s after the last one told.
add("offl", "(SELECT camera_id, last_us + 1000000 AS at_us FROM gaps WHERE us - last_us > 1000000)", ["gaps"])
add("offnext", "(SELECT a.camera_id, a.at_us, b.at_us AS nxt FROM offl a ASOF JOIN offl b ON a.camera_id = b.camera_id AND b.at_us >= a.at_us + 30000000)", ["offl"])
add("offkept", """/*recursive*/ (
  SELECT camera_id, min(at_us) AS at_us FROM offl GROUP BY camera_id
  UNION ALL SELECT k.camera_id, n.nxt FROM offkept k JOIN offnext n ON n.camera_id = k.camera_id AND n.at_us = k.at_us)""", ["offl", "offnext"])


@query("dedup_offline", sql("offkept", "SELECT camera_id, at_us FROM offkept"))
def _(v):
    """Offline notices of a camera at least 30 s apart."""
    return N.dedup_offline(N.liveness(v.results, "camera_id", 1.0), "camera_id", 30.0).select("camera_id", "at_us")


@query("device_status", sql("reading", f"""
SELECT sensor_id, max(us) AS last_us, CASE WHEN (SELECT max(us) FROM reading) - max(us) <= 10000000 THEN 'ONLINE' ELSE 'OFFLINE' END AS status
FROM reading GROUP BY sensor_id"""))
def _(v):
    now = v.readings.agg(F.max("us")).scalar()
    return N.device_status(v.readings, "sensor_id", 10.0, now)


add("ival", """(
  SELECT location_id, 'AI' AS source, us AS from_us, us + 3000000 AS to_us FROM signal WHERE confidence >= 0.6e0
  UNION ALL SELECT location_id, sensor_type, us, least(coalesce(next_us, us + 300000000), us + 300000000) FROM sact WHERE is_active)""", ["signal", "sact"])
add("pts", """(
  SELECT location_id, source, us, CAST(sum(d) AS BIGINT) AS d FROM (
    SELECT location_id, source, from_us AS us, 1 AS d FROM ival WHERE to_us > from_us
    UNION ALL SELECT location_id, source, to_us, -1 FROM ival WHERE to_us > from_us)
  GROUP BY location_id, source, us)""", ["ival"])
add("turns", """(
  SELECT location_id, us, CAST(sum(t) AS BIGINT) AS t FROM (
    SELECT location_id, us, CAST(o > 0 AS INTEGER) - CAST(o - d > 0 AS INTEGER) AS t FROM (
      SELECT *, sum(d) OVER (PARTITION BY location_id, source ORDER BY us) AS o FROM pts))
  GROUP BY location_id, us HAVING sum(t) <> 0)""", ["pts"])
add("steps", """(
  SELECT location_id, us AS from_us, lead(us) OVER (PARTITION BY location_id ORDER BY us) AS to_us,
         CAST(sum(t) OVER (PARTITION BY location_id ORDER BY us) AS BIGINT) AS n_sources FROM turns)""", ["turns"])
add("hsteps", f"""(
  SELECT location_id, p AS from_us, coalesce(lead(p) OVER (PARTITION BY location_id, from_us ORDER BY p), to_us) AS to_us, n_sources FROM (
    SELECT *, from_us AS p FROM steps
    UNION ALL SELECT s.*, b FROM steps s, (SELECT unnest([{BASE_US} + 300000000, {BASE_US} + 86400000000]) AS b)
      WHERE n_sources = 2 AND b > from_us AND b < coalesce(to_us, (SELECT max(from_us) + 1 FROM steps))))""", ["steps"])
add("levels", """(
  SELECT *, CASE WHEN n_sources >= 2 AND NOT ((from_us // 60000000) % 1440 >= 0 AND (from_us // 60000000) % 1440 < 5) THEN 'CRITICAL'
    WHEN n_sources <= 0 THEN 'LOW' WHEN n_sources = 1 THEN 'MEDIUM' WHEN n_sources = 2 THEN 'HIGH' ELSE 'CRITICAL' END AS level
  FROM hsteps)""", ["hsteps"])


def levels(v):
    def build():
        active = v.staged("active", lambda: N.sensor_active(v.readings))
        spans = R.ai_intervals(v.signals).unionByName(R.sensor_intervals(active))
        return R.risk_levels(spans, 0, 5)

    return v.staged("levels", build)


@query("risk_levels", sql("levels", "SELECT * FROM levels"))
def _(v):
    return levels(v)


add("ralert", """(
  SELECT *, max(CASE WHEN opens THEN from_us END) OVER (PARTITION BY location_id ORDER BY from_us) AS alert_from_us FROM (
    SELECT *, coalesce(from_us - lag(to_us) OVER w > 2000000, lag(to_us) OVER w IS NULL) AS opens
    FROM levels WHERE n_sources > 0 WINDOW w AS (PARTITION BY location_id ORDER BY from_us)))""", ["levels"])


@query("risk_alerts", sql("ralert", """
SELECT location_id, alert_from_us, arg_min(level, from_us) AS first_level, arg_max(level, from_us) AS last_level,
       (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[max(CASE level WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 1 END)] AS highest_level,
       CASE WHEN count(*) = count(to_us) THEN max(to_us) + 2000000 END AS closed_us
FROM ralert GROUP BY location_id, alert_from_us"""))
def _(v):
    return R.risk_alerts(levels(v), 2.0)


@query("risk_alert_changes", sql("ralert", """
SELECT location_id, alert_from_us, from_us AS at_us, CASE WHEN opens THEN 'CREATED' ELSE 'LEVEL_CHANGED' END AS change, level FROM (
  SELECT *, lag(level) OVER (PARTITION BY location_id ORDER BY from_us) AS before FROM ralert) WHERE opens OR level <> before
UNION ALL SELECT location_id, alert_from_us, max(to_us) + 2000000, 'CLOSED', arg_max(level, from_us) FROM ralert
  GROUP BY location_id, alert_from_us HAVING count(*) = count(to_us)"""))
def _(v):
    return R.risk_alert_changes(levels(v), 2.0)


@query("envelope_round_trip", sql("signal", """
SELECT CAST(event_id AS VARCHAR) AS message_id, event_id, event_type, us // 1000 AS sent_ms FROM signal"""))
def _(v):
    data = v.signals.select("event_id", "event_type", "us")
    wrapped = M.wrap_envelope(data, "AI_EVENT_CREATED", "ai-service", "event_id", "us")
    other = M.wrap_envelope(data, "READING", "iot", "event_id", "us").unionByName(
        M.wrap_envelope(data, "AI_EVENT_CREATED", "ai-service", "event_id", "us", version="2.0"))
    back = M.unwrap_envelope(wrapped.unionByName(other), "AI_EVENT_CREATED", "event_id bigint, event_type string")
    return back.select("message_id", "event_id", "event_type", F.expr("sent_us div 1000L").alias("sent_ms"))


@query("sensor_messages", sql("reading", """
SELECT 'dev-' || sensor_id AS device_id, CAST(reading_id AS VARCHAR) AS reading_id, positive, us // 1000 AS ms FROM reading"""))
def _(v):
    from zonewatch.functions.clock import iso_millis_us

    body = F.to_json(F.struct(F.col("reading_id").cast("string").alias("reading_id"), "sensor_id", "sensor_type", "value",
                              iso_millis_us(F.col("us")).alias("recordedAt")))
    topic = F.concat(F.lit("site/v1/devices/dev-"), "sensor_id", F.lit("/readings"))
    out = M.parse_sensor_messages(v.readings.select(topic.alias("topic"), body.alias("value")))
    return out.select("device_id", "reading_id", "positive", F.expr("us div 1000L").alias("ms"))
