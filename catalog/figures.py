"""Counts, rates, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonewatch.functions import keys
from zonewatch.operators import listings as L
from zonewatch.operators import metrics as G
from zonewatch.operators import sessions as S

from . import query
from .sqlviews import add, sql
from .views import BASE_US

# Frames on a grid of 0.2 s, thinned to one in 0.7 s at least: every fourth is taken.
add("decided", "(SELECT *, (seq - 1) % 4 = 0 AS admitted FROM frame)", ["frame"])


def decisions(v):
    """All frames, and whether the rate limit lets them through."""
    taken = G.sample_rate(v.frames.select("camera_id", "seq", "us"), 1 / 0.7).select("camera_id", "seq", F.lit(True).alias("admitted"))
    return v.frames.join(taken, ["camera_id", "seq"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


@query("admission_stats", sql("decided", """
SELECT camera_id, count(*) AS received_frames, count(*) FILTER (admitted) AS consumed_frames, count(*) FILTER (NOT admitted) AS dropped_frames,
       arg_max(frame_id, seq) AS latest_frame_id, max(seq) FILTER (admitted) AS last_consumed_sequence_number FROM decided GROUP BY camera_id"""))
def _(v):
    return G.admission_stats(decisions(v)).select(
        "camera_id", "received_frames", "consumed_frames", "dropped_frames", "latest_frame_id", "last_consumed_sequence_number")


@query("sample_rate", sql("frame", """
SELECT camera_id, seq FROM frame WHERE (seq - 1) % 4 = 0"""))
def _(v):
    return G.sample_rate(v.frames, 1 / 0.7).select("camera_id", "seq")


@query("performance", sql("result", """
SELECT camera_id, n AS results, (n - 1) / greatest(1e0, (last_us - first_us) / 1000000e0) AS results_per_s, inf / c AS mean_inference_us, lat / c AS mean_latency_us
FROM (SELECT camera_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, sum(inference_us) FILTER (i <= 30) AS inf,
             sum(latency_us) FILTER (i <= 30) AS lat, count(*) FILTER (i <= 30) AS c
      FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY us DESC, seq DESC) AS i FROM result) GROUP BY camera_id)"""))
def _(v):
    return G.performance(v.results).select("camera_id", "results", "results_per_s", "mean_inference_us", "mean_latency_us")


@query("camera_summary", sql("frame", """
SELECT camera_id, arg_max(frame_id, us) AS last_frame_id, max(us) AS last_us, count(*) AS frame_count FROM frame GROUP BY camera_id"""))
def _(v):
    return G.camera_summary(v.frames).select("camera_id", "last_frame_id", "last_us", "frame_count")


@query("camera_overview", sql("visit result camera", """
SELECT coalesce(s.camera_id, r.camera_id) AS camera_id, s.n AS signups, r.seq AS result_seq
FROM (SELECT camera_id, count(*) AS n FROM visit WHERE event_type = 'signup' GROUP BY ALL) s
FULL JOIN (SELECT camera_id, max(seq) AS seq FROM result WHERE objects >= 5 GROUP BY ALL) r ON r.camera_id = s.camera_id"""))
def _(v):
    stats = v.visits.where("event_type = 'signup'").groupBy("camera_id").agg(F.count("*").alias("signups"))
    return G.camera_overview(stats, v.results.where("objects >= 5")).select("camera_id", "signups", "result_seq")


@query("engine_stats", sql("frame hb stay", """
SELECT f.camera_id, f.frames, coalesce(p.n, 0) AS events_published, coalesce(a.n, 0) AS active_states
FROM (SELECT camera_id, count(*) AS frames, max(us) AS now FROM frame GROUP BY camera_id) f
LEFT JOIN (SELECT camera_id, count(*) AS n FROM hb GROUP BY camera_id) p USING (camera_id)
LEFT JOIN (SELECT camera_id, count(*) AS n FROM (SELECT camera_id, rule_id, track_key, max(us) AS us FROM stay GROUP BY ALL)
           JOIN (SELECT camera_id, max(us) AS now FROM frame GROUP BY camera_id) USING (camera_id) WHERE now - us <= 5000000 GROUP BY camera_id) a USING (camera_id)"""))
def _(v):
    # Stays without what hits show of their objects: nothing of it is counted.
    rows = v.hits.select("camera_id", "zone_id", "rule_id", "track_key", "us", "seq", "rule_type", "duration_threshold")
    return G.engine_stats(v.frames, v.beats, S.dwell_sessions(rows, v.timed_frames))


@query("delivery_stats", """
SELECT client, count(*) AS sent, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND k % 2 = 0) AS alerts_returned,
       count(*) FILTER (NOT ok) AS failed,
       (SELECT coalesce(string_agg(c || '=' || n, ' ' ORDER BY c || '=' || n), '') FROM (
          SELECT client AS cl, CASE WHEN k % 3 = 0 THEN 'TIMEOUT' ELSE 'HTTP_' || CASE WHEN k % 3 = 1 THEN '503' ELSE 'ERROR' END END AS c, count(*) AS n
          FROM (SELECT 'c' || event_id % 7 AS client, user_id AS k, value < 30 AS ok FROM events) WHERE NOT ok GROUP BY ALL) x WHERE x.cl = d.client) AS error_codes
FROM (SELECT 'c' || event_id % 7 AS client, user_id AS k, value < 30 AS ok FROM events) d GROUP BY client""")
def _(v):
    k = F.col("user_id")
    log = v.source.select(
        F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("client"), (F.col("value") < 30).alias("ok"),
        F.when(k % 2 == 0, "a").alias("alert_id"), F.when(k % 3 == 0, "TIMEOUT").alias("error_code"),
        F.when(k % 3 == 1, 503).alias("status_code"))
    return G.delivery_stats(log)


@query("config_counts", sql("zone rule", """
SELECT z.camera_id, count(*) AS zones, CAST(sum(r.n) AS BIGINT) AS rules, CAST(sum(r.e) AS BIGINT) AS enabled_rules
FROM zone z LEFT JOIN (SELECT zone_id, count(*) AS n, count(*) FILTER (enabled) AS e FROM rule GROUP BY zone_id) r ON r.zone_id = z.id GROUP BY z.camera_id"""))
def _(v):
    return G.config_counts(v.raw_zones, v.raw_rules)


@query("event_rollup", sql("aievent", """
SELECT camera_id, event_type, object_type, count(*) AS events, CAST(grouping(camera_id, event_type, object_type) AS INTEGER) AS level
FROM aievent GROUP BY ROLLUP (camera_id, event_type, object_type)"""))
def _(v):
    return G.event_rollup(v.ai_events, ["camera_id", "event_type", "object_type"])


@query("event_cube", sql("aievent", """
SELECT event_type, object_type, count(*) AS events, CAST(grouping(event_type, object_type) AS INTEGER) AS level
FROM aievent GROUP BY CUBE (event_type, object_type)"""))
def _(v):
    return G.event_rollup(v.ai_events, ["event_type", "object_type"], "cube")


@query("camera_metrics", sql("frame result hb", """
SELECT f.camera_id, f.w AS window_us, f.n AS read_frames, coalesce(r.n, 0) AS processed_frames, coalesce(h.n, 0) AS events,
       f.n / 60e0 AS read_fps, f.n - coalesce(r.n, 0) AS skipped_frames, r.o / r.n AS detections_per_frame, r.i / r.n AS mean_inference_us
FROM (SELECT camera_id, us // 60000000 * 60000000 AS w, count(*) AS n FROM frame GROUP BY ALL) f
LEFT JOIN (SELECT camera_id, us // 60000000 * 60000000 AS w, count(*) AS n, sum(objects) AS o, sum(inference_us) AS i FROM result GROUP BY ALL) r USING (camera_id, w)
LEFT JOIN (SELECT camera_id, us // 60000000 * 60000000 AS w, count(*) AS n FROM hb GROUP BY ALL) h USING (camera_id, w)"""))
def _(v):
    return G.camera_metrics(v.frames, v.results, v.beats).select(
        "camera_id", "window_us", "read_frames", "processed_frames", "events", "read_fps", "skipped_frames", "detections_per_frame", "mean_inference_us")


@query("tumbling_counts", """
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL""")
def _(v):
    e = v.source.withColumn("ts", F.col("ts").cast("timestamp"))
    return G.windowed_counts(e, ["event_type"], width="1 hour").select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query("sliding_counts", """
SELECT event_type, s AS start_us, count(*) AS n FROM (
  SELECT event_type, unnest([us // 1800000000 * 1800000000, us // 1800000000 * 1800000000 - 1800000000]) AS s FROM (SELECT event_type, epoch_us(ts) AS us FROM events)) GROUP BY ALL""")
def _(v):
    e = v.source.withColumn("ts", F.col("ts").cast("timestamp"))
    return G.windowed_counts(e, ["event_type"], width="1 hour", slide="30 minutes").select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query("session_counts", """
SELECT user_id, min(us) AS start_us, count(*) AS n FROM (
  SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (
    SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS o FROM events))
GROUP BY user_id, s""")
def _(v):
    e = v.source.withColumn("ts", F.col("ts").cast("timestamp"))
    return G.windowed_counts(e, ["user_id"], session_gap="1 hour").select("user_id", F.unix_micros("start").alias("start_us"), "n")


# Labels: spans of all stays, those of every third track 40 s late; predictions: the stays that were reported.
add("truth", """(
  SELECT truth_id, video, zone, event_type, from_us + late AS from_us, to_us + late AS to_us FROM (
    SELECT rule_id || '|' || track_key || '|' || first_us AS truth_id, camera_id AS video, zone_id AS zone, rule_type AS event_type, first_us AS from_us,
           max(us) AS to_us, CASE WHEN CAST(regexp_extract(any_value(track_key), '(\\d+)$', 1) AS BIGINT) % 3 = 1 THEN 40000000 ELSE 0 END AS late
    FROM stay GROUP BY rule_id, track_key, first_us, camera_id, zone_id, rule_type))""", ["stay"])
add("predicted", """(
  SELECT *, row_number() OVER (PARTITION BY video, zone, event_type ORDER BY start_us, pred_id) AS n FROM (
    SELECT source_event_id AS pred_id, camera_id AS video, zone_id AS zone, rule_type AS event_type, us AS start_us
    FROM hb WHERE heartbeat_index = 1 AND who <> 'crowd'))""", ["hb"])
# What each prediction could take, first the label that ends first; then one prediction of each key after the other.
add("choice", """(
  SELECT p.video, p.zone, p.event_type, p.n, p.pred_id, coalesce(list(t.truth_id ORDER BY t.to_us, t.truth_id) FILTER (t.truth_id IS NOT NULL), []) AS fits
  FROM predicted p LEFT JOIN truth t ON t.video = p.video AND t.zone = p.zone AND t.event_type = p.event_type AND p.start_us BETWEEN t.from_us AND t.to_us
  GROUP BY ALL)""", ["predicted", "truth"])
add("picked", """/*recursive*/ (
  SELECT video, zone, event_type, n, pred_id, fits[1] AS truth_id, CASE WHEN len(fits) > 0 THEN [fits[1]] ELSE [] END AS used FROM choice WHERE n = 1
  UNION ALL
  SELECT video, zone, event_type, n, pred_id, truth_id, CASE WHEN truth_id IS NULL THEN used ELSE list_append(used, truth_id) END FROM (
    SELECT c.video, c.zone, c.event_type, c.n, c.pred_id, p.used, list_filter(c.fits, lambda x: NOT list_contains(p.used, x))[1] AS truth_id
    FROM picked p JOIN choice c ON c.video = p.video AND c.zone = p.zone AND c.event_type = p.event_type AND c.n = p.n + 1))""", ["choice"])
add("outcome", """(
  SELECT k.event_type, CASE WHEN k.truth_id IS NULL THEN 'fp' ELSE 'tp' END AS outcome, k.pred_id, k.truth_id, (p.start_us - t.from_us) / 1000000e0 AS delay_s
  FROM picked k JOIN predicted p USING (pred_id) LEFT JOIN truth t ON t.truth_id = k.truth_id
  UNION ALL SELECT event_type, 'fn', NULL, truth_id, NULL FROM truth WHERE truth_id NOT IN (SELECT truth_id FROM picked WHERE truth_id IS NOT NULL))""", ["picked", "truth", "predicted"])


def labels(v):
    """One row a stay, staged as it is read three times; made of narrow hits, as all of their rows are shuffled."""
    third = F.regexp_extract("track_key", r"(\d+)$", 1).cast("bigint") % 3 == 1
    late = F.when(third, 40_000_000).otherwise(0)
    hits = v.hits.select("camera_id", "zone_id", "rule_id", "track_key", "rule_type", "duration_threshold", "us", "seq")
    return v.staged("labels", lambda: S.dwell_sessions(hits, v.timed_frames).groupBy("rule_id", "track_key", "first_us").agg(
        F.min("camera_id").alias("video"), F.min("zone_id").alias("zone"), F.min("rule_type").alias("event_type"), F.max("us").alias("to_us")
    ).select(F.concat_ws("|", "rule_id", "track_key", "first_us").alias("truth_id"), "video", "zone", "event_type",
             (F.col("first_us") + late).alias("from_us"), (F.col("to_us") + late).alias("to_us")))


def matches(v):
    crowd = F.col("rule_type") == "crowd_limit"
    pred = v.beats.where((F.col("heartbeat_index") == 1) & ~crowd).select(
        F.col("source_event_id").alias("pred_id"), F.col("camera_id").alias("video"), F.col("zone_id").alias("zone"),
        F.col("rule_type").alias("event_type"), F.col("us").alias("start_us"))
    return G.match_ground_truth(pred, labels(v))


@query("match_ground_truth", sql("outcome", "SELECT * FROM outcome"))
def _(v):
    return matches(v)


@query("detection_quality", sql("outcome", """
SELECT event_type, tp, fp, fn, mean_delay_ms, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (
  SELECT event_type, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
         CAST(round(avg(delay_s) * 1000) AS BIGINT) AS mean_delay_ms
  FROM outcome GROUP BY event_type)"""))
def _(v):
    delay = F.round(F.col("mean_delay_s") * 1000).cast("bigint").alias("mean_delay_ms")
    return G.detection_quality(matches(v)).select("event_type", "tp", "fp", "fn", delay, "precision", "recall", "f1")


@query("count_error", sql("det", """
SELECT video, count(*) AS frames, CAST(sum(abs(p - t)) AS BIGINT) AS total_error, sum(abs(p - t)) / count(*) AS mean_abs_error FROM (
  SELECT camera_id AS video, seq, count(*) FILTER (confidence >= 0.6e0) AS p, count(*) AS t FROM det WHERE class_name = 'person' GROUP BY ALL) GROUP BY video"""))
def _(v):
    people = v.detections.where("class_name = 'person'").withColumnRenamed("camera_id", "video")
    count = lambda d: d.groupBy("video", "seq").agg(F.count("*").alias("people"))
    return G.count_error(count(people.where("confidence >= 0.6")), count(people))


@query("keep_last", sql("result", """
SELECT camera_id, seq FROM result QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY seq DESC) <= 120"""))
def _(v):
    return L.keep_last(v.results, ["camera_id"], "seq", 120).select("camera_id", "seq")


@query("latest_result", sql("result", "SELECT camera_id, max(seq) AS seq, arg_max(frame_id, seq) AS frame_id FROM result GROUP BY camera_id"))
def _(v):
    return L.latest(v.results, ["camera_id"], ["seq"]).select("camera_id", "seq", "frame_id")


@query("clock_epochs", """
SELECT user_id, event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS epoch FROM (
  SELECT user_id, event_id, CASE WHEN us < lag(us) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b
  FROM (SELECT user_id, event_id, epoch_us(ts) % 86400000000 AS us FROM events))""")
def _(v):
    from zonewatch.operators.timeline import epochs

    e = v.source.select("user_id", "event_id", (F.col("us") % 86_400_000_000).alias("us"))
    return epochs(e, ["user_id"], "event_id", "us", width=1000).select("user_id", "event_id", "epoch")


@query("validate_frames", """
SELECT event_id, concat_ws(',', CASE WHEN user_id % 5 = 0 THEN 'frame_id' END, CASE WHEN event_id % 4 = 3 THEN 'timestamp' END,
  CASE WHEN value < 2 THEN 'sequence_number' END, CASE WHEN user_id % 7 = 0 THEN 'frame_width' END, CASE WHEN event_id % 6 = 0 THEN 'fps' END) AS reasons, upper(event_type) AS encoding
FROM events WHERE user_id % 5 = 0 OR event_id % 4 = 3 OR value < 2 OR user_id % 7 = 0 OR event_id % 6 = 0""")
def _(v):
    from zonewatch.functions.clock import iso_millis_us
    from zonewatch.sources.frames import validate_frames

    c = F.col
    df = v.source.select(
        "event_id", F.when(c("user_id") % 5 == 0, "").otherwise(keys.frame_id(F.lit("c"), c("event_id"))).alias("frame_id"),
        F.lit("c").alias("camera_id"), F.lit("l").alias("location_id"), F.lit("rtsp").alias("source_type"), F.lit("u").alias("source_url"),
        F.when(c("event_id") % 4 != 3, iso_millis_us(c("us"))).otherwise("soon").alias("timestamp"),
        F.when(c("value") < 2, -1).otherwise(c("event_id")).alias("sequence_number"),
        F.when(c("user_id") % 7 != 0, 640).alias("frame_width"), F.lit(360).alias("frame_height"),
        F.when(c("event_id") % 6 == 0, 0.0).alias("fps"), c("event_type").alias("encoding"))
    _, bad = validate_frames(df)
    return bad.select("event_id", F.array_join("reasons", ",").alias("reasons"), "encoding")


def written(v, df, form: str, **options) -> str:
    """``df`` as files below the shared folder; the path."""
    import uuid

    from zonewatch.session import checkpoint_dir

    where = f"{checkpoint_dir(v.spark)}/sources/{uuid.uuid4().hex}"
    df.write.options(**options).format(form).save(where)
    return where


@query("read_frame_results", sql("frame det", """
SELECT f.camera_id, f.frame_id, f.us, coalesce(d.n, 0) AS objects, d.sure
FROM frame f LEFT JOIN (SELECT camera_id, us, count(*) AS n, max(confidence) AS sure FROM det GROUP BY ALL) d ON d.camera_id = f.camera_id AND d.us = f.us"""))
def _(v):
    """All frames as JSON lines, read as a result source gives them."""
    from zonewatch.functions.clock import iso_millis_us
    from zonewatch.sources.frames import read_frame_results

    lines = v.packed_frames.select(
        "camera_id", "location_id", keys.frame_id(F.col("camera_id"), F.col("seq")).alias("frame_id"), F.col("seq").alias("sequence_number"),
        iso_millis_us(F.col("us")).alias("captured_at"), F.col("frame_w").alias("frame_width"), F.col("frame_h").alias("frame_height"), "detections")
    # Names and figures repeat from line to line, so compressed lines take a small share of the disk.
    got = read_frame_results(v.spark, written(v, lines, "json", compression="gzip"))
    return got.select("camera_id", "frame_id", "us", F.size("detections").cast("bigint").alias("objects"),
                      F.array_max(F.transform("detections", lambda d: d["confidence"])).alias("sure"))


@query("read_ground_truth", sql("truth", f"""
SELECT truth_id AS note, video, zone, event_type, (from_us - {BASE_US}) / 1000000e0 AS start_s, (to_us - {BASE_US}) / 1000000e0 AS end_s FROM truth"""))
def _(v):
    """The labels as CSV, read as they are kept."""
    from zonewatch.sources.messages import read_ground_truth

    seconds = lambda c: ((F.col(c) - BASE_US) / F.lit(1e6))
    rows = labels(v).select("video", "zone", "event_type", seconds("from_us").alias("start_s"), seconds("to_us").alias("end_s"), F.col("truth_id").alias("note"))
    return read_ground_truth(v.spark, written(v, rows, "csv", header="true"))
