"""Streaming forms next to the SQL of their batch forms: the given tables are played as files along time."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.operators import metrics as G
from zonewatch.operators import risk as R
from zonewatch.operators import sensors as N
from zonewatch.session import ROCKSDB, checkpoint_dir, filled_up
from zonewatch.sources import config
from zonewatch.sources.config import refreshing_dimension
from zonewatch.streaming import sinks as K
from zonewatch.streaming import stateful as ST

from . import query
from .sqlviews import ORDER, add, sql
from .views import BASE_US

PARTS = 6
#: Files of streams that are played at once.
FILES = 4
#: A time after all data, to move the watermark past everything that is open.
FAR = BASE_US + 86_000_000_000


def folder(v) -> str:
    return f"{checkpoint_dir(v.spark)}/streams/{uuid.uuid4().hex}"


def played(v, df: DataFrame, order: str, end: DataFrame | None = None) -> DataFrame:
    """``df`` as a stream of ``PARTS`` batches cut along ``order``; then ``end``, in a batch of its own.

    The tasks that make the rows write them, once, a file for each part. The source takes files by their time, which is set by part.
    """
    where, spark = folder(v), v.spark
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // PARTS + 1
    # So many files are open at once in a task that its rows needn't be sorted by part.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, "0")
    spark.conf.set(writers, str(PARTS + 1))
    try:
        parts = df.where(F.col(order).between(low, high)).withColumn("__part", F.expr(f"(`{order}` - {low}L) div {step}L"))
        parts.write.partitionBy("__part").parquet(where)
    finally:
        spark.conf.set(writers, before)
    if end is not None:
        end.select(*df.columns).write.parquet(f"{where}/__part={PARTS}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{where}/__part={k}" for k in range(PARTS + (end is not None))]
    width, now = max(len(filled_up(spark, f, df.schema, 0)) for f in folders), int(time.time() * 1000)
    for k, part in enumerate(folders):
        for p in filled_up(spark, part, df.schema, width):
            fs.setTimes(p, now - (len(folders) - k) * 60_000, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).option("recursiveFileLookup", True).parquet(where)


played_in_place = played


def played_all(v, df: DataFrame, order: str, end: DataFrame) -> DataFrame:
    """``df`` in one batch and ``end`` in the next: for two streams that are joined, whose parts needn't lie alike in time."""
    where = folder(v)
    df.withColumn("f", F.pmod(F.monotonically_increasing_id(), F.lit(FILES))).repartition(FILES, "f").write.partitionBy("f").parquet(f"{where}/0")
    end.select(*df.columns).write.parquet(f"{where}/1")
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", True).parquet(where)


def finished(v, name: str, stream) -> DataFrame:
    """What a stream writes until it has read all files."""
    def build():
        where = folder(v)
        v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        df = stream()
        q = df.writeStream.format("parquet").option("path", where + "/out").option(
            "checkpointLocation", where + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return v.spark.read.schema(df.schema).parquet(where + "/out")

    return v.kept(name, build)


def closing(v, df: DataFrame, **values) -> DataFrame:
    """One row like those of ``df``, with the given values and nulls."""
    return v.spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


@query("stream_alerts", sql("alert", """
SELECT dedup_key, opened AS alert_us, last_seen_us + 30000000 AS at_us, active_source_count, last_seen_us FROM alert"""))
def _(v):
    rows = v.linked.select("camera_id", "zone_id", "event_type", "object_type", "source_event_id", "us", "last_seq")
    end = closing(v, rows, camera_id="end", source_event_id="end", us=FAR, last_seq=0)
    done = finished(v, "stream_alerts", lambda: ST.stream_alerts(played(v, rows, "us", end)))
    return done.where("change = 'RESOLVED' AND at_us < " + str(FAR)).drop("change")


@query("stream_risk", sql("ralert", """
SELECT location_id, alert_from_us, from_us AS at_us, CASE WHEN opens THEN 'CREATED' ELSE 'LEVEL_CHANGED' END AS change, level FROM (
  SELECT *, lag(level) OVER (PARTITION BY location_id ORDER BY from_us) AS before FROM ralert) WHERE opens OR level <> before
UNION ALL SELECT location_id, alert_from_us, max(to_us) + 2000000, 'CLOSED', arg_max(level, from_us) FROM ralert
  GROUP BY location_id, alert_from_us HAVING count(*) = count(to_us)"""))
def _(v):
    active = v.staged("active", lambda: N.sensor_active(v.readings))
    spans = R.ai_intervals(v.signals).unionByName(R.sensor_intervals(active)).where("to_us > from_us")
    step = lambda at, d: spans.select("location_id", "source", F.col(at).alias("us"), F.lit(d).alias("delta"))
    steps = v.staged("risk-steps", lambda: step("from_us", 1).unionByName(step("to_us", -1)))
    end = closing(v, steps, location_id="end", source="AI", us=FAR, delta=1)
    done = finished(v, "stream_risk", lambda: ST.stream_risk_alerts(played(v, steps, "us", end), 2.0, 0, 5))
    return done.where("location_id <> 'end'")


@query("stream_track", sql("twalk tbox tnamed", """
SELECT camera_id, seq, CAST(event_id AS INTEGER) AS det_index, class_name, track_id FROM twalk JOIN tbox USING (grp, rn) JOIN tnamed USING (grp, n)"""))
def _(v):
    rows = v.detections.select("camera_id", "seq", "us", "det_index", "class_name", "confidence", "bbox")
    done = finished(v, "stream_track", lambda: ST.stream_track(played(v, rows, "us")))
    return done.select("camera_id", "seq", "det_index", "class_name", "track_id")


@query("stream_motion", sql("det", """
SELECT camera_id, seq, track_key, CASE WHEN t1 - t0 >= 500000 THEN dx END AS dx, CASE WHEN t1 - t0 >= 500000 THEN dy END AS dy,
       CASE WHEN t1 - t0 >= 500000 THEN (t1 - t0) // 1000 END AS span_ms
FROM (SELECT camera_id, seq, track_key, us AS t1, first_value(us) OVER w AS t0, fx - first_value(fx) OVER w AS dx, fy - first_value(fy) OVER w AS dy
      FROM det WINDOW w AS (PARTITION BY camera_id, track_key ORDER BY us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW))"""))
def _(v):
    rows = v.keyed.select("camera_id", "track_key", "us", "seq", "frame_w", "bbox")
    done = finished(v, "stream_motion", lambda: ST.stream_motion(played(v, rows, "us")))
    return done.select("camera_id", "seq", "track_key", "dx", "dy", F.round(F.col("window_s") * 1000).cast("bigint").alias("span_ms"))


@query("dedup_stream", "SELECT event_id FROM events")
def _(v):
    """Every event is delivered twice."""
    rows = v.source.select("event_id", "us")
    twice = rows.unionByName(rows)
    done = finished(v, "dedup_stream", lambda: K.dedup_stream(played(v, twice, "us").withColumn("ts", F.timestamp_micros("us")), "event_id"))
    return done.select("event_id")


@query("publish_events", sql("hb", "SELECT source_event_id, us FROM hb"))
def _(v):
    """Each batch goes to the sink; the sink keeps it under the batch's number, so a repeated batch replaces itself."""
    def build():
        where = folder(v)
        stream = played(v, v.beats.select("source_event_id", "us"), "us")
        sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{where}/out/batch={batch}")
        K.publish_events(stream, sink, f"{where}/state", f"{where}/log").awaitTermination()
        return v.spark.read.parquet(f"{where}/out").drop("batch")

    return v.staged("publish_events", build)


@query("pair_streams", sql("frame result", """
SELECT f.camera_id, f.frame_id, f.us, r.objects FROM frame f JOIN result r ON r.camera_id = f.camera_id AND r.frame_id = f.frame_id"""))
def _(v):
    frames, results = v.frames.select("camera_id", "frame_id", "us"), v.results.select("camera_id", "frame_id", "us", "objects")
    return finished(v, "pair_streams", lambda: K.pair_streams(played(v, frames, "us"), played(v, results, "us")))


@query("stream_hits", sql("hb", "SELECT camera_id, rule_id, track_key, us, heartbeat_index, source_event_id FROM hb"))
def _(v):
    """Hits batch by batch with the configuration asked for anew, then their events."""
    def stream():
        where = folder(v)
        zones = refreshing_dimension(lambda: config.parse_zones(v.raw_zones))
        rules = refreshing_dimension(lambda: config.clean_rules(v.raw_rules))
        ST.write_hits(played(v, v.packed_frames, "us"), zones, rules, f"{where}/hits", f"{where}/state").awaitTermination()
        return ST.stream_hits(v.spark, f"{where}/hits", ST.RuleSettings(reattach=None))

    return finished(v, "stream_hits", stream).select("camera_id", "rule_id", "track_key", "us", "heartbeat_index", "source_event_id")


# Cameras that restart after a third and two thirds of the time: first the sequence begins anew and the clock runs on, then the
# sequence runs on and the clock falls back by half the time, as when a video begins again.
add("rbase", "(SELECT fold * 5 // 3 AS q, fold * 500000 AS fall FROM base)", ["base"])
add("rdet", """(
  SELECT d.* REPLACE (seq - least(e, 1) * q AS seq, us - CASE WHEN e = 2 THEN fall ELSE 0 END AS us), e AS epoch, us AS plain_us
  FROM (SELECT *, CASE WHEN seq > 2 * q THEN 2 WHEN seq > q THEN 1 ELSE 0 END AS e FROM det, rbase) d)""", ["det", "rbase"])


def restarted(v, df: DataFrame) -> DataFrame:
    """``df`` with the sequences and clocks of cameras that restart twice; ``plain_us`` tells when rows come."""
    fold = max(60, v.source.count() * 6 // 100)
    q, fall = fold * 5 // 3, fold * 500_000
    epoch = F.when(F.col("seq") > 2 * q, 2).when(F.col("seq") > q, 1).otherwise(0)
    return df.withColumns({"plain_us": F.col("us"), "us": F.col("us") - F.when(epoch == 2, fall).otherwise(0), "seq": F.col("seq") - F.when(epoch > 0, q).otherwise(0)})


def rewritten(names: str, text: str) -> str:
    """A view's text with views renamed to those of restarted cameras."""
    return re.sub(rf"(?<!')\b({names})\b(?!')", r"r\1", text)


add("rtbox", rewritten("det", dict(ORDER)["tbox"].split(" AS ", 1)[1]).replace(
    "camera_id || '|' || class_name AS grp", "camera_id || '|' || epoch || '|' || class_name AS grp").replace(
    "PARTITION BY camera_id, class_name", "PARTITION BY camera_id, epoch, class_name"), ["rdet"])
add("rtwalk", rewritten("tbox|twalk", dict(ORDER)["twalk"].split(" AS ", 1)[1]), ["rtbox"])
add("rtnamed", rewritten("tbox|twalk", dict(ORDER)["tnamed"].split(" AS ", 1)[1]).replace("PARTITION BY camera_id", "PARTITION BY camera_id, epoch"), ["rtwalk", "rtbox"])


@query("stream_track_restarts", sql("rtwalk rtbox rtnamed", """
SELECT camera_id, CAST(epoch AS INTEGER) AS epoch, seq, CAST(event_id AS INTEGER) AS det_index, class_name, track_id
FROM rtwalk JOIN rtbox USING (grp, rn) JOIN rtnamed USING (grp, n)"""))
def _(v):
    rows = restarted(v, v.detections.select("camera_id", "seq", "us", "det_index", "class_name", "confidence", "bbox"))
    done = finished(v, "stream_track_restarts", lambda: ST.stream_track(played(v, rows, "plain_us")))
    return done.select("camera_id", "epoch", "seq", "det_index", "class_name", "track_id")


@query("stream_motion_restarts", sql("rdet", """
SELECT camera_id, CAST(epoch AS INTEGER) AS epoch, seq, track_key, CASE WHEN t1 - t0 >= 500000 THEN dx END AS dx, CASE WHEN t1 - t0 >= 500000 THEN dy END AS dy,
       CASE WHEN t1 - t0 >= 500000 THEN (t1 - t0) // 1000 END AS span_ms
FROM (SELECT camera_id, epoch, seq, track_key, us AS t1, first_value(us) OVER w AS t0, fx - first_value(fx) OVER w AS dx, fy - first_value(fy) OVER w AS dy
      FROM rdet WINDOW w AS (PARTITION BY camera_id, epoch, track_key ORDER BY us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW))"""))
def _(v):
    rows = restarted(v, v.keyed.select("camera_id", "track_key", "us", "seq", "frame_w", "bbox"))
    done = finished(v, "stream_motion_restarts", lambda: ST.stream_motion(played(v, rows, "plain_us")))
    return done.select("camera_id", "epoch", "seq", "track_key", "dx", "dy", F.round(F.col("window_s") * 1000).cast("bigint").alias("span_ms"))


# Stays and crowds that end with their epoch; all rules of the restarted cameras as above, times of day included.
add("rframe", """(
  SELECT camera_id, seq - least(e, 1) * q AS seq, us - CASE WHEN e = 2 THEN fall ELSE 0 END AS us, e AS epoch
  FROM (SELECT *, CASE WHEN seq > 2 * q THEN 2 WHEN seq > q THEN 1 ELSE 0 END AS e FROM frame, rbase))""", ["frame", "rbase"])
add("rprevf", "(SELECT camera_id, epoch, us, lag(us) OVER (PARTITION BY camera_id, epoch ORDER BY us) AS prev_us FROM rframe)", ["rframe"])
_CHAIN = "det|zhit|rhit|stay|crowd|crowdrun|viol|violnext|beat|prevf"


def _of_restarts(name: str, needs: list[str]) -> None:
    text = rewritten(_CHAIN, dict(ORDER)[name].split(" AS ", 1)[1]).replace("USING (camera_id, us)", "USING (camera_id, epoch, us)")
    text = text.replace("PARTITION BY rule_id", "PARTITION BY rule_id, epoch").replace("SELECT camera_id, seq, us, zone_id", "SELECT camera_id, epoch, seq, us, zone_id")
    text = text.replace("|| first_us AS sid", "|| first_us || '|' || epoch AS sid").replace("|| '|' || first_us, camera_id", "|| '|' || first_us || '|' || epoch, camera_id")
    text = text.replace("us, seq, first_us,", "us, seq, first_us, epoch,").replace("/*recursive*/ ", "")
    add("r" + name, ("/*recursive*/ " if name == "beat" else "") + text, needs)


for _name, _needs in (("zhit", ["rdet"]), ("rhit", ["rzhit", "rule"]), ("stay", ["rrhit", "rprevf"]), ("crowd", ["rrhit"]), ("crowdrun", ["rcrowd", "rprevf"]),
                      ("viol", ["rstay", "rcrowdrun"]), ("violnext", ["rviol"]), ("beat", ["rviol", "rviolnext"])):
    _of_restarts(_name, _needs)
add("rhb", """(
  SELECT v.*, b.heartbeat_index, f.seq AS first_seq, v.camera_id || '|' || v.zone_id || '|' || v.rule_id || '|' || who || '|' || f.seq AS source_event_id
  FROM rbeat b JOIN rviol v ON v.sid = b.sid AND v.rn = b.rn JOIN rframe f ON f.camera_id = v.camera_id AND f.epoch = v.epoch AND f.us = v.first_us)""",
    ["rbeat", "rviol", "rframe"])


@query("stream_events_restarts", sql("rhb", """
SELECT camera_id, CAST(epoch AS INTEGER) AS epoch, rule_id, track_key, us, seq, first_seq, heartbeat_index, source_event_id, object_type, confidence FROM rhb"""))
def _(v):
    """Events of cameras that restart twice: the frames of each epoch are stays of their own."""
    rows = restarted(v, v.packed_frames)
    done = finished(v, "stream_events_restarts", lambda: ST.stream_rules(played(v, rows, "plain_us"), v.zones, v.rules, ST.RuleSettings(reattach=None)))
    return done.select("camera_id", "epoch", "rule_id", "track_key", "us", "seq", "first_seq", "heartbeat_index", "source_event_id", "object_type", "confidence")


@query("late_rows", "SELECT event_id FROM events WHERE event_id % 7 = 3 AND epoch_us(ts) < (SELECT max(epoch_us(ts)) FROM events)")
def _(v):
    """Every seventh event is delivered once more after all others; only those copies are late."""
    rows = v.source.select("event_id", "us", F.lit("all").alias("key"), F.col("us").alias("turn"))
    last = rows.agg(F.max("us")).first()[0]
    again = rows.where(f"event_id % 7 = 3 AND us < {last}").withColumn("turn", F.lit(last + 1))
    first = rows.where(f"us < {last}").unionByName(rows.where(f"us = {last}"))
    stream = lambda: ST.late_rows(played(v, first, "us", again), ["key"])
    return finished(v, "late_rows", stream).select("event_id")


@query("late_frames", sql("rframe", """
SELECT camera_id, CAST(2 AS INTEGER) AS epoch, seq, us FROM rframe r WHERE epoch = 2 AND seq % 5 = 1
  AND seq < (SELECT max(seq) FROM rframe m WHERE m.camera_id = r.camera_id AND m.epoch = 2)"""))
def _(v):
    """Of cameras that restart twice, a fifth of the last epoch's frames are delivered once more at the end: late, and no restart."""
    rows = v.staged("restarted-frames", lambda: restarted(v, v.frames.select("camera_id", "seq", "us")))
    fold = max(60, v.source.count() * 6 // 100)
    again = rows.where(F.col("plain_us") >= BASE_US + 2 * (fold * 5 // 3) * 200_000).where("seq % 5 = 1")
    newest = rows.where(F.col("plain_us") >= BASE_US + 2 * (fold * 5 // 3) * 200_000).groupBy("camera_id").agg(F.max("seq").alias("newest"))
    again = again.join(newest, "camera_id").where("seq < newest").drop("newest")
    done = finished(v, "late_frames", lambda: ST.late_frames(played(v, rows, "plain_us", again)))
    return done.select("camera_id", "epoch", "seq", "us")


@query("stream_correlate", sql("signal reading", """
SELECT s.event_id, arg_min(r.reading_id, (abs(s.us - r.us), r.reading_id)) AS sensor_event_id, min(abs(s.us - r.us)) AS apart_us, 'CRITICAL' AS alert_level
FROM signal s JOIN reading r ON (r.location_id = s.location_id OR r.zone_id = s.zone_id) AND abs(s.us - r.us) <= 10000000
WHERE s.event_type = 'FORBIDDEN_ZONE_INTRUSION' AND r.sensor_type = 'DOOR' AND r.positive GROUP BY s.event_id"""))
def _(v):
    signals = v.signals.select("event_id", "event_type", "location_id", "zone_id", "us")
    doors = N.sensor_events(v.readings).select(F.col("reading_id").alias("event_id"), "event_type", "location_id", "zone_id", "us")
    ends = closing(v, signals, event_id=-1, event_type="end", us=FAR), closing(v, doors, event_id=-1, event_type="end", us=FAR)
    stream = lambda: K.correlate_streams(played_all(v, signals, "us", ends[0]), played_all(v, doors, "us", ends[1]))
    return finished(v, "stream_correlate", stream).select("event_id", "sensor_event_id", "apart_us", "alert_level")


@query("stream_counts", """
WITH e AS (SELECT event_type, user_id, epoch_us(ts) AS us FROM events),
s AS (SELECT user_id, us, sum(o) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 3600000000 THEN 0 ELSE 1 END AS o FROM e)),
h AS (SELECT event_type, us // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM e GROUP BY ALL)
SELECT 'tumbling' AS kind, event_type AS of, start_us, n, CAST(NULL AS BIGINT) AS peak FROM h
UNION ALL SELECT 'sliding', event_type, s, count(*), NULL FROM (
  SELECT event_type, unnest([us // 1800000000 * 1800000000, us // 1800000000 * 1800000000 - 1800000000]) AS s FROM e) GROUP BY ALL
UNION ALL SELECT 'session', CAST(user_id AS VARCHAR), min(us), count(*), NULL FROM s GROUP BY user_id, s
UNION ALL SELECT 'peak', event_type, start_us // 21600000000 * 21600000000, CAST(sum(n) AS BIGINT), max(n) FROM h GROUP BY ALL""")
def _(v):
    """Windows under a watermark, each given out once when it is complete; and one aggregate over another."""
    rows = v.source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "us")
    last = rows.agg(F.max("us")).scalar() + 10 * 86_400_000_000
    end = rows.limit(1).select(F.timestamp_micros(F.lit(0).cast("long") + last).alias("ts"), F.lit("end").alias("event_type"), F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), F.lit(0).cast("long").alias("us") + last)
    end = end.toDF(*rows.columns)
    forms = {
        "tumbling": lambda df: G.windowed_counts(df, ["event_type"], width="1 hour"),
        "sliding": lambda df: G.windowed_counts(df, ["event_type"], width="1 hour", slide="30 minutes"),
        "session": lambda df: G.windowed_counts(df, ["user_id"], session_gap="1 hour"),
        "peak": lambda df: G.peak_counts(df, ["event_type"], width="1 hour", wider="6 hours"),
    }
    out = None
    for kind, form in forms.items():
        done = finished(v, f"stream-{kind}", lambda form=form: form(played(v, rows, "us", end).withWatermark("ts", "10 minutes")))
        of = F.col(done.columns[0]).cast("string")
        part = done.where(of.isin("end", "-1") == F.lit(False)).select(
            F.lit(kind).alias("kind"), of.alias("of"), F.unix_micros("start").alias("start_us"), "n",
            (F.col("peak") if "peak" in done.columns else F.lit(None).cast("long")).alias("peak"))
        out = part if out is None else out.unionByName(part)
    return out
