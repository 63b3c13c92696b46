"""Plans and rows that have to hold when the tables are larger."""

import os
import random

import pytest
from pyspark.sql import functions as F

import catalog
from catalog.views import Views
from zonewatch.operators import evidence as E
from zonewatch.operators import sessions as S
from zonewatch.operators import timeline as T
from zonewatch.operators.steps import OpenTracks
from zonewatch.session import DEFAULTS, stage, tuned
from zonewatch.streaming import sinks as K
from zonewatch.streaming import stateful as ST

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def views(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("given tables are not here")
    kept = {k: spark.conf.get(k, None) for k in ("zonewatch.slice.seconds", "zonewatch.slice.frames")}
    yield Views(spark, FOLDER)
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_tables_are_not_broadcast_by_their_estimate(views):
    frames = views.frames.select("camera_id", "frame_id", F.col("us").alias("frame_us"))
    assert "BroadcastHashJoin" not in plan(E.pair_frames_results(frames, views.results))
    seen = views.detections.groupBy("camera_id", "us").agg(F.collect_list("bbox").alias("b"))
    assert "BroadcastHashJoin" not in plan(views.frames.join(seen, ["camera_id", "us"], "left"))


def test_frames_are_written_by_several_tasks_and_once_each(views):
    frames = views.frames
    count = views.fold_s.first()[0] * 5 + 105
    assert frames.rdd.getNumPartitions() > 1
    got = frames.groupBy("camera_id").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.count_distinct("seq").alias("d"))
    assert {tuple(r)[1:] for r in got.collect()} == {(count, 1, count, count)}


def hits(spark, n=4000):
    """Hits of a few tracks, some of them and some cameras without a name, with pauses; and frames, some of them missing."""
    h = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("camera_id"), F.lit("z").alias("zone_id"),
        F.lit("r").alias("rule_id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("track_key"),
        (F.pmod(F.xxhash64("id"), F.lit(3000)) * 200_000).alias("us"), F.lit("loitering").alias("rule_type"), F.lit(2.0).alias("duration_threshold"),
    ).dropDuplicates(["camera_id", "track_key", "us"]).withColumn("seq", F.col("us") / 200_000)
    h = h.withColumn("seq", F.col("seq").cast("bigint"))
    grid = spark.range(3000).where("id % 40 > 26 OR id % 40 < 3").select((F.col("id") * 200_000).alias("us"))
    return h, grid.crossJoin(spark.createDataFrame([("c1",), ("c2",), ("c9",)], "camera_id string")).select("camera_id", "us")


def test_marks_looked_up_where_a_session_can_open_give_the_sessions_of_all_marks(spark):
    h, frames = hits(spark)
    marks = S.with_previous_frame(frames)
    keys = ["camera_id", "zone_id", "rule_id", "track_key"]
    for width in (1_000_000, 7_000_000, 10**12):
        every = T.sessions(h.join(marks, ["camera_id", "us"], "left"), keys, "us", 2_000_000, mark="prev_frame_us", width=width, carry={"seq": "first_seq"})
        few = T.marked_sessions(h, marks, "prev_frame_us", ["camera_id", "us"], keys, "us", 2_000_000, width=width, carry={"seq": "first_seq"})
        cols = [*keys, "us", "first_us", "first_seq"]
        got, want = [sorted(map(str, df.select(*cols).collect())) for df in (few, every)]
        assert got == want and len({r.split("first_us=")[1] for r in got}) > 5


def test_ordered_steps_shuffle_their_rows_once(spark):
    h, frames = hits(spark)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        wide = h.withColumn("load", F.xxhash64("seq"))
        for df in (T.sessions(wide, ["camera_id", "track_key"], "us", 5), T.running_sum(wide, ["camera_id"], "us", F.lit(1), "n"),
                   T.previous(wide, ["camera_id", "track_key"], "us", {"seq": "before"}), S.dwell_sessions(wide, frames)):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" in text and "coalesce(camera_id" not in text
            assert rows_shuffled(df._jdf.queryExecution().executedPlan(), "load") == 1
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(name, DEFAULTS[name])


def rows_shuffled(node, column):
    """How many exchanges above the scans carry ``column``."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    out, children = node.output(), node.children()
    here = "ShuffleExchange" in node.getClass().getSimpleName() and any(out.apply(i).name() == column for i in range(out.size()))
    return int(here) + sum(rows_shuffled(children.apply(i), column) for i in range(children.size()))


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder))


def test_a_streams_state_is_not_keyed_by_track(spark, tmp_path):
    schema = "camera_id string, track_key string, us bigint, seq bigint, frame_w int, bbox struct<x1:double,y1:double,x2:double,y2:double>"
    text = ST.stream_motion(stream_of(spark, tmp_path, schema))._jdf.queryExecution().analyzed().toString()
    assert "share" in text


def test_streams_meet_by_place_and_time(spark, tmp_path):
    schema = "event_id bigint, event_type string, location_id string, zone_id string, us bigint"
    stream = stream_of(spark, tmp_path, schema)
    text = K.correlate_streams(stream, stream)._jdf.queryExecution().analyzed().toString()
    assert "span#" in text and "= door_span#" in text


def test_a_crowded_frame_is_matched_at_once_as_box_by_box():
    r = random.Random(4)
    for most, missing in ((3, 1), (40, 5), (60, 45)):
        at_once, one_by_one = OpenTracks(0.3, missing), OpenTracks(0.3, missing)
        for seq in range(30):
            spots = [(float(r.randrange(200)), float(r.randrange(150)), r.choice([0, 30, 40])) for _ in range(r.randrange(1, most + 1))]
            boxes, cut = [(x, y, x + w, y + 100) for x, y, w in spots], r.randrange(len(spots))
            got = at_once.see_all(seq, boxes[:cut]) + at_once.see_all(seq, boxes[cut:])
            assert got == [one_by_one.see(seq, b) for b in boxes]
            assert (at_once.open, at_once.made) == (one_by_one.open, one_by_one.made)


def test_rows_made_in_place_are_played_without_a_shuffle_each_part_a_batch(views, spark):
    catalog.load()
    streams = catalog.streams
    rows = views.detections.select("camera_id", "us", "det_index")
    few = rows.where("det_index = 3 OR det_index = 900")  # some parts and tasks have no rows
    for df in (rows, few):
        stream = streams.played_in_place(views, df, "us")
        seen = []
        stream.writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.min("us"), F.max("us"), F.count("*")).first())).option(
            "checkpointLocation", streams.folder(views)).trigger(availableNow=True).start().awaitTermination(120)
        assert len(seen) == streams.PARTS and sum(s[2] for s in seen) == df.count()
        ends = [t for s in seen if s[2] for t in s[:2]]
        assert ends == sorted(ends)


def test_tracks_carry_no_more_than_they_need(spark, tmp_path):
    schema = "camera_id string, seq bigint, us bigint, det_index int, class_name string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>"
    lines = ST.stream_track(stream_of(spark, tmp_path, schema))._jdf.queryExecution().analyzed().toString().splitlines()
    below = next(k for k, line in enumerate(lines) if "EventTimeWatermark" in line)
    assert "clock_us" in lines[below + 1] and "prev_us" not in lines[below + 1] and "late" not in lines[below + 1]


def test_events_are_made_from_narrow_rows(views):
    assert "members" not in views.crowds.columns and "bbox" not in views.violations.columns
    assert "seq" not in views.timed_frames.columns
    keys = ["rule_id", "track_key", "us", "first_us"]
    shown = views.pictured_violations
    assert "bbox" in shown.columns and sorted(shown.select(*keys).collect()) == sorted(views.violations.select(*keys).collect())


def test_labels_are_made_without_the_wide_table_of_stays(views):
    from catalog.views import _STAGED

    catalog.load()
    _STAGED.pop((views.spark.sparkContext.applicationId, FOLDER, "stays"), None)
    rows = catalog.figures.labels(views).agg(F.count("*"), F.count_distinct("truth_id")).first()
    assert rows[0] == rows[1] > 0 and (views.spark.sparkContext.applicationId, FOLDER, "stays") not in _STAGED


def test_violations_alone_are_those_of_all_stays_and_leave_short_ones_out_early(spark):
    h, frames = hits(spark)
    # Tracks seen twice, too briefly for their rule, beside the ones that stay.
    brief = h.limit(600).withColumn("track_key", F.concat(F.lit("brief-"), F.col("us").cast("string")))
    brief = brief.unionByName(brief.withColumns({"us": F.col("us") + 1_900_000, "seq": F.col("seq") + 9}))
    h = stage(h.unionByName(brief), "hits")
    cols = ["camera_id", "track_key", "us", "seq", "first_us", "first_seq", "elapsed_s"]
    for width in ("1", "60"):
        before = spark.conf.get("zonewatch.slice.seconds", None)
        spark.conf.set("zonewatch.slice.seconds", width)
        try:
            alone = S.dwell_sessions(h, frames, 2.0, violating=True)
            marked = h.join(S.with_previous_frame(frames), ["camera_id", "us"], "left")
            every = S.dwell_sessions(marked, frames, 2.0).where("is_violation")
            got, want = [sorted(map(str, df.select(*cols).collect())) for df in (alone, every)]
        finally:
            spark.conf.unset("zonewatch.slice.seconds") if before is None else spark.conf.set("zonewatch.slice.seconds", before)
        assert got == want and len(got) > 100 and not any("brief" in r for r in got)


def test_sessions_of_rows_apart_by_the_gap_and_before_the_epoch(spark):
    gap = 2_000_000
    times = [-9_000_000, -7_000_000, -4_999_999, -1_000_000, 900_000, 2_900_000, 2_900_001, 4_900_001, 6_900_002, 7_000_000]
    h = spark.createDataFrame([("c", t, k) for k, t in enumerate(times)], "k string, us bigint, seq bigint")
    marks = h.select("k", "us", F.col("us").alias("m"))
    for width in (300_000, 3_000_000, 10**12):
        got = T.marked_sessions(h, marks, "m", ["k", "us"], ["k"], "us", gap, width=width, carry={"seq": "first_seq"}).orderBy("us").collect()
        first, want = None, []
        for k, t in enumerate(times):
            if k == 0 or t - times[k - 1] > gap:
                first = (t, k)
            want.append((t, *first))
        assert [(r.us, r.first_us, r.first_seq) for r in got] == want


def test_parts_of_shuffles_and_files_are_small(spark):
    """Rows that compress to 64 MB took more than a task's memory when sorted, and spilled."""
    tuned(spark)
    mb = {"8MB": 8, "32MB": 32}
    assert mb[spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")] <= 8
    assert mb[spark.conf.get("spark.sql.files.maxPartitionBytes")] <= 32
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 600


def test_pictures_are_planned_from_rows_written_once(spark):
    e = spark.range(500).select(
        F.concat(F.lit("e"), (F.col("id") % 50).cast("string")).alias("event_id"), F.concat(F.lit("a"), (F.col("id") % 7).cast("string")).alias("alert_id"),
        (F.col("id") * 300_000).alias("us"), F.col("id").cast("string").alias("frame_id"))
    taken = spark.createDataFrame([("e1", "a1", "1", 300_000)], "ai_event_id string, alert_id string, frame_id string, captured_us bigint")
    for evidence in (None, taken):
        files = E.plan_snapshots(e, evidence, every_s=5.0).inputFiles()
        assert files and all("/pictured-" in f for f in files)


def test_visits_are_made_in_more_tasks_when_there_are_more_events(spark, monkeypatch):
    monkeypatch.setattr(Views, "table", lambda self, name: self.spark.range(200_001))
    assert Views(spark, "none").tasks == 11


def test_frames_are_packed_where_their_detections_are_made(views, monkeypatch):
    monkeypatch.setattr(Views, "staged", lambda self, name, build: build())
    packed = views.packed_frames
    assert rows_shuffled(packed._jdf.queryExecution().executedPlan(), "us") == 0
    frames = views.frames.select("camera_id", "seq", "us", "location_id")
    seen = views.detections.groupBy("camera_id", "seq").agg(F.array_sort(F.collect_list("det_index")).alias("d"))
    want = frames.join(seen, ["camera_id", "seq"], "left").select("*", F.coalesce(F.size("d"), F.lit(0)).alias("n"))
    got = packed.select("camera_id", "seq", "us", "location_id", F.transform("detections", lambda d: d["det_index"]).alias("d"), F.size("detections").alias("n"))
    both = got.join(want.withColumnsRenamed({"d": "e", "n": "m"}), ["camera_id", "seq", "us", "location_id"], "full")
    assert both.where("n IS NULL OR m IS NULL OR n <> m OR (m > 0 AND d <> e)").count() == 0 and got.count() == frames.count()


def test_lines_of_frames_are_written_compressed(views):
    catalog.load()
    assert all(f.endswith(".json.gz") for f in catalog.QUERIES["read_frame_results"](views).inputFiles())


def test_what_rules_compare_is_worked_out_once_for_a_hit(views):
    text = views.rule_hits._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in text.splitlines() if "Join Inner" in line and "r_zone_id" in line)
    assert "pmod" not in join and "lower" not in join


def test_clips_are_sampled_in_one_shuffle_as_by_a_plain_loop(spark):
    from zonewatch.operators.evidence import sample_clip

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(6)
        rows, want = [], {}
        for clip in ("a", "b", "c", "d", "e"):
            n = r.choice([1, 2, 30])
            shots = sorted((r.randrange(10_000_000), k, f"{clip}{k}") for k in range(n))
            shots += [shots[-1]] if clip == "c" else []
            rows += [(clip, *s) for s in shots]
            last, kept = None, set()
            for t, _, frame in shots:
                if last is None or t - last >= 500_000:
                    last = t
                    kept.add(frame)
            want[clip] = kept | {shots[-1][2]}
        shots = spark.createDataFrame(r.sample(rows, len(rows)), "event_id string, frame_us bigint, clip_seq bigint, clip_frame_id string")
        out = sample_clip(shots, "event_id", 2.0)
        assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") + out._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") <= 1
        got = [(x.event_id, x.clip_frame_id) for x in out.collect()]
        assert len(got) == len(set(got)) and {c: {f for k, f in got if k == c} for c in want} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stays_and_tracks_move_only_what_they_are_asked_for(views, monkeypatch):
    from zonewatch.operators import tracking

    catalog.load()
    executed = lambda df: df._jdf.queryExecution().executedPlan()
    assert rows_shuffled(executed(catalog.QUERIES["dwell_sessions_reattached"](views)), "zone_name") == 0
    monkeypatch.setattr(tracking, "stage", lambda df, name: df)
    rows = views.detections.select("camera_id", "seq", "det_index", "class_name", "confidence", "bbox")
    assert rows_shuffled(executed(tracking.track(rows)), "__x1") == 0
    text = executed(catalog.QUERIES["engine_stats"](views)).toString()
    assert "bbox" not in text and "zone_name" not in text
