"""Zone membership, rules and counts on detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.operators import metrics, sessions
from zonewatch.operators import zones as Z

from . import query
from .sqlviews import sql


@query("zone_hits", sql("zhit", """
SELECT camera_id, seq, us, track_key, zone_id FROM zhit"""))
def _(v):
    return v.zone_hits.select("camera_id", "seq", "us", "track_key", "zone_id")


@query("rule_hits", sql("rhit", """
SELECT camera_id, seq, us, track_key, rule_id, rule_type FROM rhit"""))
def _(v):
    return v.rule_hits.select("camera_id", "seq", "us", "track_key", "rule_id", "rule_type")


@query("zone_ids_per_detection", sql("det zhit", """
SELECT d.camera_id, d.seq, d.track_key, round(d.fx, 1) AS foot_x, round(d.fy, 1) AS foot_y,
       coalesce(z.zone_ids, '') AS zone_ids
FROM det d LEFT JOIN (SELECT seq, track_key, string_agg(zone_id, ',' ORDER BY zone_id) AS zone_ids FROM zhit GROUP BY ALL) z
  USING (seq, track_key)"""))
def _(v):
    return Z.annotate_zones(v.keyed, v.zones).select(
        "camera_id", "seq", "track_key", F.col("foot_point.x").alias("foot_x"), F.col("foot_point.y").alias("foot_y"),
        F.array_join("zone_ids", ",").alias("zone_ids"),
    )


@query("explode_detections", sql("det", """
SELECT camera_id, seq, CAST(row_number() OVER (PARTITION BY camera_id, seq ORDER BY event_id) - 1 AS INTEGER) AS place,
       class_name, confidence, fx, fy FROM det"""))
def _(v):
    from zonewatch.sources.frames import explode_detections

    out = explode_detections(v.packed_frames)
    foot = F.col("bbox")
    return out.select(
        "camera_id", "seq", F.col("det_index").alias("place"), "class_name", "confidence",
        ((foot["x1"] + foot["x2"]) / 2).alias("fx"), foot["y2"].alias("fy"),
    )


@query("filter_detections", sql("det", """
SELECT seq, track_key FROM det WHERE class_name IN ('person', 'car', 'motorcycle') AND confidence >= 0.45e0"""))
def _(v):
    return Z.filter_detections(v.keyed, min_confidence=0.45).select("seq", "track_key")


@query("rule_applies", sql("rhit", "SELECT seq, track_key, rule_id FROM rhit"))
def _(v):
    from zonewatch.sources.config import clean_rules

    r = clean_rules(v.raw_rules).select(
        F.col("id").alias("rule_id"), "zone_id", F.col("enabled").alias("rule_enabled"),
        F.col("object_type").alias("rule_object_type"), "confidence_threshold", "use_active_time",
        "active_start_time", "active_end_time",
    )
    return Z.rule_applies(v.zone_hits.join(F.broadcast(r), "zone_id")).select("seq", "track_key", "rule_id")


@query("eligible_zones", sql("zone", "SELECT id FROM zone WHERE enabled AND n >= 3"))
def _(v):
    from zonewatch.sources.config import parse_zones

    return Z.eligible_zones(parse_zones(v.raw_zones)).select("id")


@query("zone_rules", sql("zone rule", """
SELECT z.id, z.n AS points, count(r.id) AS rules, coalesce(string_agg(r.rule_type || '/' || coalesce(r.object_type, '-') || '/' || coalesce(r.a, '-'), ',' ORDER BY r.id), '') AS text
FROM zone z LEFT JOIN rule r ON r.zone_id = z.id WHERE z.enabled GROUP BY z.id, z.n"""))
def _(v):
    from zonewatch.sources.config import read_zone_rules

    z = read_zone_rules(v.raw_zones, v.raw_rules)
    dash = F.lit("-")
    one = lambda r: F.concat_ws("/", r["rule_type"], F.coalesce(r["object_type"], dash), F.coalesce(r["active_start_time"], dash))
    return z.select("id", F.size("points").alias("points"), F.size("rules").cast("bigint").alias("rules"),
                    F.array_join(F.transform("rules", one), ",").alias("text"))


@query("class_counts", sql("det", "SELECT camera_id, seq, class_name, count(*) AS objects FROM det GROUP BY ALL"))
def _(v):
    return metrics.class_counts(v.detections)


@query("class_summary", sql("det", """
SELECT camera_id, seq, string_agg(class_name || ' ' || n, ' ' ORDER BY class_name) AS summary, CAST(sum(n) AS BIGINT) AS objects
FROM (SELECT camera_id, seq, class_name, count(*) AS n FROM det GROUP BY ALL) GROUP BY ALL"""))
def _(v):
    return metrics.class_summary(v.detections)


@query("object_summary", sql("rhit", """
SELECT seq, track_key, rule_id, round(fx, 1) AS foot_x, upper(class_name) AS object_type, fx - 20 AS x1, fy AS y2 FROM rhit"""))
def _(v):
    from zonewatch.functions import payload

    none = F.lit(None)
    o = payload.object_summary(F.col("track_key"), F.col("track_id"), F.col("class_name"), F.col("confidence"), F.col("bbox"),
                               none.cast("double"), none.cast("string"), none.cast("double"))
    c = payload.contract_object(o)
    return v.hits.select("seq", "track_key", "rule_id", o["foot_point"]["x"].alias("foot_x"), c["object_type"].alias("object_type"),
                         c["bbox"]["x1"].alias("x1"), c["bbox"]["y2"].alias("y2"))
