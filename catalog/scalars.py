"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.functions import clock, geometry, keys, labels, payload, rules
from zonewatch.functions.geometry import point

from . import query
from .sqlviews import ARROW, crossings, sql



@query("foot_point", sql("det", "SELECT seq, track_key, fx AS x, fy AS y FROM det"))
def _(v):
    p = geometry.foot_point(F.col("bbox"))
    return v.keyed.select("seq", "track_key", p["x"].alias("x"), p["y"].alias("y"))


@query("bbox_area", sql("det", "SELECT seq, track_key, 40e0 * 100e0 AS area, fx AS cx, fy - 50 AS cy, 40e0 AS w, 100e0 AS h FROM det"))
def _(v):
    c = geometry.bbox_center_wh(F.col("bbox"))
    return v.keyed.select("seq", "track_key", geometry.bbox_area(F.col("bbox")).alias("area"), *[c[n].alias(n) for n in ("cx", "cy", "w", "h")])


@query("scale_point", sql("det", "SELECT seq, track_key, fx * 320 / 640e0 AS x, fy * 180 / 360e0 AS y, fx AS same_x, fx AS unknown_x FROM det"))
def _(v):
    p = geometry.foot_point(F.col("bbox"))
    w, h, zero = F.col("frame_w"), F.col("frame_h"), F.lit(0)
    q = geometry.scale_point(p, w, h, F.lit(320), F.lit(180))
    return v.keyed.select(
        "seq", "track_key", q["x"].alias("x"), q["y"].alias("y"),
        geometry.scale_point(p, w, h, w, h)["x"].alias("same_x"),
        geometry.scale_point(p, zero, zero, w, h)["x"].alias("unknown_x"),
    )


@query("point_in_polygon", sql("det", f"""
SELECT seq, track_key, {crossings(ARROW, 'fx', 'fy')} % 2 = 1 AS inside, {crossings(ARROW, 'fx', 'fy')} % 2 = 1 AS inside_walked,
       FALSE AS inside_line FROM det"""))
def _(v):
    def shape(points):
        return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    p = geometry.foot_point(F.col("bbox"))
    return v.keyed.select(
        "seq", "track_key", geometry.point_in_polygon(p, shape(ARROW), len(ARROW)).alias("inside"),
        geometry.point_in_polygon(p, shape(ARROW)).alias("inside_walked"),
        geometry.point_in_polygon(p, shape(ARROW[:2]), 2).alias("inside_line"),
    )


@query("distance", sql("det", "SELECT seq, track_key, CAST(round(sqrt((fx - 320) * (fx - 320) + (fy - 180) * (fy - 180)) * 1000) AS BIGINT) AS mpx FROM det"))
def _(v):
    d = geometry.distance(geometry.foot_point(F.col("bbox")), point(F.lit(320.0), F.lit(180.0)))
    return v.keyed.select("seq", "track_key", F.round(d * 1000).cast("bigint").alias("mpx"))


@query("iou", sql("det", """
SELECT seq, track_key, CASE WHEN w > 0 AND h > 0 THEN w * h / (4000e0 + 20000e0 - w * h) ELSE 0e0 END AS score FROM (
  SELECT *, least(fx + 20, 400e0) - greatest(fx - 20, 200e0) AS w, least(fy, 200e0) - greatest(fy - 100, 100e0) AS h FROM det)"""))
def _(v):
    other = geometry.box(F.lit(200), F.lit(100), F.lit(400), F.lit(200))
    return v.keyed.select("seq", "track_key", geometry.iou(F.col("bbox"), other).alias("score"))


@query("fit_viewport", sql("det", """
SELECT seq, track_key, 0e0 + (fx / 640e0) * 500e0 AS x, (500e0 - 360 * (500 / 640e0)) / 2e0 + (fy / 360e0) * (360 * (500 / 640e0)) AS y FROM det"""))
def _(v):
    w, h = F.col("frame_w"), F.col("frame_h")
    view = geometry.fit_viewport(F.lit(500), F.lit(500), w, h)
    p = geometry.to_viewport(geometry.foot_point(F.col("bbox")), w, h, view)
    return v.keyed.select("seq", "track_key", p["x"].alias("x"), p["y"].alias("y"))


@query("active_window", """
SELECT event_id, m AS minute, s AS start_time, m BETWEEN 510 AND 1020 AS day,
       m >= 1380 OR m <= 360 AS night, TRUE AS always, FALSE AS never,
       CAST(split_part(s, ':', 1) AS INTEGER) * 60 + CAST(split_part(s, ':', 2) AS INTEGER) AS start_minutes
FROM (SELECT event_id, CAST((epoch_us(ts) // 60000000 + 420) % 1440 AS INTEGER) AS m, strftime(ts, '%H:%M:%S') AS s FROM events)""")
def _(v):
    m = clock.local_minutes(F.col("us"))
    hit = lambda a, b: clock.in_active_window(F.lit(a), F.lit(b), m)
    text = clock.iso_millis_us(F.col("us")).substr(12, 8)
    return v.source.select(
        "event_id", m.alias("minute"), text.alias("start_time"), hit("08:30", "17:00:59").alias("day"),
        hit("23:00", "06:00").alias("night"), hit("05:00", "05:00").alias("always"), hit("", "06:00").alias("never"),
        clock.time_to_minutes(text).alias("start_minutes"),
    )


@query("matches_object", """
SELECT event_id, event_type IN ('click', 'purchase', 'error') AS vehicle, TRUE AS any_object, event_type IN ('view', 'signup') AS person
FROM events""")
def _(v):
    from .views import CLASS_OF

    cls = rules.lookup(CLASS_OF, F.col("event_type"))
    return v.source.select(
        "event_id", rules.matches_object(F.lit("Vehicle"), cls).alias("vehicle"),
        rules.matches_object(F.lit(None).cast("string"), cls).alias("any_object"),
        rules.matches_object(F.lit("PERSON"), F.upper(cls)).alias("person"),
    )


RULE_CASE = "CASE event_id % 6 WHEN 0 THEN 'person_intrusion' WHEN 1 THEN 'vehicle_intrusion' WHEN 2 THEN 'loitering' WHEN 3 THEN 'crowd_limit' WHEN 4 THEN 'vehicle_stopping' ELSE 'other_rule' END"


@query("rule_names", f"""
SELECT event_id, rule_type,
  CASE rule_type WHEN 'person_intrusion' THEN 'FORBIDDEN_ZONE_INTRUSION' WHEN 'vehicle_intrusion' THEN 'FORBIDDEN_ZONE_INTRUSION'
    WHEN 'loitering' THEN 'RESTRICTED_ZONE_LOITERING' WHEN 'crowd_limit' THEN 'RESTRICTED_ZONE_CROWDING'
    WHEN 'vehicle_stopping' THEN 'RESTRICTED_ZONE_VEHICLE_STOPPING' ELSE upper(rule_type) END AS contract_type,
  CASE WHEN rule_type IN ('person_intrusion', 'vehicle_intrusion') THEN 'high' WHEN rule_type = 'crowd_limit' THEN 'medium' ELSE 'low' END AS risk,
  upper(rule_type[1:1]) || replace(rule_type[2:], '_', ' ') AS plain
FROM (SELECT event_id, {RULE_CASE} AS rule_type FROM events)""")
def _(v):
    names = F.array(*[F.lit(n) for n in ("person_intrusion", "vehicle_intrusion", "loitering", "crowd_limit", "vehicle_stopping", "other_rule")])
    r = v.source.select("event_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("rule_type"))
    c = F.col("rule_type")
    return r.select("event_id", "rule_type", rules.contract_event_type(c).alias("contract_type"), rules.risk_level(c).alias("risk"), labels.humanize(c).alias("plain"))


@query("identifiers", sql("det", """
SELECT seq, track_key, camera_id || '-' || lpad(CAST(seq AS VARCHAR), 12, '0') AS frame_id,
  class_name || '-' || seq || '-' || event_id AS loose_key,
  camera_id || '|z|r|' || track_key || '|' || seq AS source_event_id, camera_id || '|z|r|crowd|unknown' AS crowd_event_id,
  camera_id || '|||' || class_name AS dedup_key,
  'LOITERING:' || camera_id || ':z1:' || track_key || ':' || strftime(make_timestamp(us), '%Y%m%d%H%M') AS contract_key,
  '#' || event_id AS track_label, 'loc-' || right(camera_id || '-0123456789', 12) AS location_code
FROM det"""))
def _(v):
    c, none = F.col, F.lit(None)
    return v.keyed.select(
        "seq", "track_key", keys.frame_id(c("camera_id"), c("seq")).alias("frame_id"),
        keys.track_key(c("class_name"), none, c("seq"), c("det_index")).alias("loose_key"),
        keys.source_event_id(c("camera_id"), F.lit("z"), F.lit("r"), c("track_key"), c("seq")).alias("source_event_id"),
        keys.source_event_id(c("camera_id"), F.lit("z"), F.lit("r"), None, none).alias("crowd_event_id"),
        keys.alert_dedup_key(c("camera_id"), none.cast("string"), none.cast("string"), c("class_name")).alias("dedup_key"),
        keys.contract_alert_dedup_key(F.lit("LOITERING"), c("camera_id"), F.lit("z1"), c("track_key"), F.timestamp_micros("us")).alias("contract_key"),
        labels.track_label(c("track_key")).alias("track_label"),
        keys.location_code(F.concat("camera_id", F.lit("-0123456789"))).alias("location_code"),
    )


@query("instants", """
SELECT event_id, epoch_us(ts) AS plain_us, epoch_us(ts) AS zulu_us, epoch_us(ts) - 25200000000 AS offset_us, CAST(NULL AS BIGINT) AS bad_us,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') || 'Z' AS shown
FROM events""")
def _(v):
    us = F.col("us")
    text = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = clock.instant_micros
    return v.source.select(
        "event_id", at(text).alias("plain_us"), at(F.concat(text, F.lit("Z"))).alias("zulu_us"),
        at(F.concat(text, F.lit("+07:00"))).alias("offset_us"), at(F.concat(F.lit("x"), text)).alias("bad_us"),
        clock.iso_millis_us(us).alias("shown"),
    )


@query("direction_from_angle", """
SELECT event_id, a AS angle, (['right', 'up-right', 'up', 'up-left', 'left', 'down-left', 'down', 'down-right'])[1 + CAST(floor((a + 22.5) / 45) AS INTEGER) % 8] AS direction,
  (['→', '↗', '↑', '↖', '←', '↙', '↓', '↘'])[1 + CAST(floor((a + 22.5) / 45) AS INTEGER) % 8] AS arrow
FROM (SELECT event_id, CAST(epoch_us(ts) % 3600 AS DOUBLE) / 10 AS a FROM events)""")
def _(v):
    a = (F.col("us") % 3600).cast("double") / 10
    d = rules.direction_from_angle(a)
    return v.source.select("event_id", a.alias("angle"), d.alias("direction"), labels.motion_arrow(d).alias("arrow"))


@query("class_filter", """
SELECT event_id, text, CASE event_id % 3 WHEN 0 THEN '0,2' WHEN 1 THEN '3' ELSE '7,1' END AS ids, CASE event_id % 3 WHEN 1 THEN 'tree' ELSE '' END AS unknown
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Person, 2,car,,0' WHEN 1 THEN 'tree,motorcycle' ELSE ' truck ,1,bicycle' END AS text FROM events)""")
def _(v):
    text = F.get(F.array(F.lit("Person, 2,car,,0"), F.lit("tree,motorcycle"), F.lit(" truck ,1,bicycle")), (F.col("event_id") % 3).cast("int"))
    p = rules.parse_class_filter(text)
    ids = F.array_join(F.transform(p["class_ids"], lambda i: i.cast("string")), ",")
    return v.source.select("event_id", text.alias("text"), ids.alias("ids"), F.array_join(p["unknown"], ",").alias("unknown"))


@query("shown_texts", """
SELECT event_id,
  CASE WHEN n < 60 THEN n || ' giây' WHEN n % 60 = 0 THEN n // 60 || ' phút' ELSE n // 60 || ' phút ' || n % 60 || ' giây' END AS lasted,
  CASE WHEN age < 5 THEN 'vừa xong' WHEN age < 60 THEN age || ' giây trước' WHEN age < 3600 THEN CAST(floor(age / 60e0 + 0.5e0) AS BIGINT) || ' phút trước'
    WHEN age < 86400 THEN CAST(floor(age / 3600e0 + 0.5e0) AS BIGINT) || ' giờ trước' ELSE strftime(ts, '%d/%m %H:%M:%S') END AS ago
FROM (SELECT event_id, ts, event_id % 500 AS n, CAST(floor((1706400000000000 - epoch_us(ts)) / 1000000e0 + 0.5e0) AS BIGINT) AS age FROM events)""")
def _(v):
    return v.source.select(
        "event_id", labels.format_duration(F.col("event_id") % 500).alias("lasted"),
        labels.format_ago(F.col("us"), F.lit(1706400000000000)).alias("ago"),
    )


@query("label_lookups", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Vùng cấm' WHEN 1 THEN 'Vùng hạn chế' ELSE 'Vùng' END AS zone_label,
  CASE c_custkey % 3 WHEN 0 THEN '#f0533a' WHEN 1 THEN '#f2b134' ELSE '#8c9aad' END AS color,
  CASE c_custkey % 2 WHEN 0 THEN 'Ô tô' ELSE 'Big dog' END AS object_label, 'Tụ tập đông người' AS rule_label
FROM customer""")
def _(v):
    k = F.col("c_custkey")
    zone = F.when(k % 3 == 0, "restricted_area").when(k % 3 == 1, "controlled_area").otherwise("")
    obj = F.when(k % 2 == 0, "car").otherwise("big_dog")
    return v.table("customer").select(
        "c_custkey", labels.zone_label(zone).alias("zone_label"), labels.zone_color(zone).alias("color"),
        labels.object_label(obj).alias("object_label"), labels.rule_label(F.lit("crowd_limit")).alias("rule_label"),
    )


@query("storage_keys", """
SELECT c_custkey, 'cam/' || regexp_replace(c_name, '[^0-9A-Za-z_-]', '_', 'g') || '/f_1.jpg' AS snapshot,
  'evidence/default/cam_1/2024/01/01/' || regexp_replace(c_name, '[^0-9A-Za-z_-]', '_', 'g') || '/clip.mp4' AS clip
FROM customer""")
def _(v):
    none = F.lit(None).cast("string")
    return v.table("customer").select(
        "c_custkey", keys.snapshot_key(F.lit("cam"), F.col("c_name"), F.lit("f/1")).alias("snapshot"),
        keys.clip_key_from_text(none, F.lit("cam.1"), F.lit("2024-01-01T23:00:00Z"), F.col("c_name")).alias("clip"),
    )


@query("tenant_uuid", """
SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
  ['8', '9', 'a', 'b'][1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS id
FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(encode('tenant:' || c_name) AS BLOB)) AS h FROM customer)""")
def _(v):
    return v.table("customer").select("c_custkey", keys.tenant_uuid(F.col("c_name")).alias("id"))


@query("sensor_values", """
SELECT event_id, value >= 30 AS positive, CASE event_id % 4 WHEN 0 THEN CASE WHEN value >= 30 THEN 'DOOR_OPENED' ELSE 'DOOR_CLOSED' END
  WHEN 1 THEN CASE WHEN value >= 30 THEN 'MOTION_DETECTED' END WHEN 2 THEN CASE WHEN value >= 30 THEN 'SMOKE_DETECTED' END
  ELSE CASE WHEN value > 50 THEN 'TEMPERATURE_THRESHOLD_EXCEEDED' END END AS event_type
FROM events""")
def _(v):
    k = F.col("event_id") % 4
    kind = F.get(F.array(*[F.lit(s) for s in ("DOOR", "PIR_MOTION", "SMOKE", "TEMPERATURE")]), k.cast("int"))
    on = F.when(F.col("value") >= 30, "OPEN").otherwise("closed")
    text = F.when(k == 3, F.col("value").cast("string")).otherwise(on)
    return v.source.select(
        "event_id", rules.sensor_value_to_bool(on).alias("positive"), rules.sensor_event_type(kind, text).alias("event_type")
    )


@query("event_confidence", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN value + 1 WHEN event_id % 4 = 2 THEN least(value, 5) ELSE 1 END AS confidence
FROM events""")
def _(v):
    k, value, none = F.col("event_id") % 4, F.col("value"), F.lit(None).cast("double")
    objects = F.when(k == 2, F.array(F.struct(value.alias("confidence")), F.struct(F.lit(5.0).alias("confidence")), F.struct(none.alias("confidence"))))
    return v.source.select(
        "event_id", payload.event_confidence(F.when(k == 0, value), F.when(k == 1, value + 1), objects).alias("confidence")
    )
