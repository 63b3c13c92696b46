"""Counts, rates and quality figures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND, micros
from .throttle import throttle
from .timeline import asof, running_sum, scan_in_order, values


def class_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("camera_id", "seq", "class_name").agg(F.count("*").alias("objects"))


def class_summary(detections: DataFrame) -> DataFrame:
    """``car 2 person 1`` per frame, by name."""
    entry = F.concat("class_name", F.lit(" "), F.col("objects").cast("string"))
    return class_counts(detections).groupBy("camera_id", "seq").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("class_name", entry.alias("t")))), lambda s: s["t"]
            ), " "
        ).alias("summary"),
        F.sum("objects").alias("objects"),
    )


def admission_stats(decisions: DataFrame) -> DataFrame:
    """Per camera: frames received, admitted and dropped, and the latest of each, from given decisions (``admitted``)."""
    taken = F.when(F.col("admitted"), F.col("seq"))
    return decisions.groupBy("camera_id").agg(
        F.count("*").alias("received_frames"),
        F.count_if("admitted").alias("consumed_frames"),
        F.count_if(~F.col("admitted")).alias("dropped_frames"),
        F.max_by("frame_id", F.col("seq")).alias("latest_frame_id"),
        F.max_by("frame_id", taken).alias("last_consumed_frame_id"),
        F.max("seq").alias("sequence_number"),
        F.max(taken).alias("last_consumed_sequence_number"),
        F.max_by("frame_w", F.col("seq")).alias("image_width"),
        F.max_by("frame_h", F.col("seq")).alias("image_height"),
    )


def performance(results: DataFrame, last_n: int = 30) -> DataFrame:
    """Per camera: results per second over the whole span, means of the last ``last_n`` results.

    The row-number filter is applied before the shuffle as well, so a camera sends ``last_n`` rows
    per task and no more.
    """
    newest = Window.partitionBy("camera_id").orderBy(F.col("us").desc(), F.col("seq").desc())
    tail = results.withColumn("__i", F.row_number().over(newest)).where(F.col("__i") <= last_n)
    means = tail.groupBy("camera_id").agg(
        (F.sum("inference_us") / F.count("inference_us")).alias("mean_inference_us"),
        (F.sum("latency_us") / F.count("latency_us")).alias("mean_latency_us"),
    )
    spans = results.groupBy("camera_id").agg(
        F.count("*").alias("results"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    seconds = F.greatest(F.lit(1.0), (F.col("last_us") - F.col("first_us")) / F.lit(float(SECOND)))
    rate = F.when(F.col("results") > 1, (F.col("results") - 1) / seconds).otherwise(F.lit(0.0))
    return spans.join(means, "camera_id").withColumn("results_per_s", rate)


def camera_summary(frames: DataFrame) -> DataFrame:
    return frames.groupBy("camera_id").agg(
        F.max_by("frame_id", F.struct("us", "seq")).alias("last_frame_id"),
        F.max("us").alias("last_us"),
        F.max_by("seq", F.struct("us", "seq")).alias("sequence_number"),
        F.count("*").alias("frame_count"),
        F.max_by("frame_w", F.struct("us", "seq")).alias("image_width"),
        F.max_by("frame_h", F.struct("us", "seq")).alias("image_height"),
    )


def camera_overview(stats: DataFrame, results: DataFrame) -> DataFrame:
    """Queue figures and latest result side by side, cameras known to either."""
    latest = results.groupBy("camera_id").agg(
        F.max("seq").alias("result_seq"), F.max_by("frame_id", F.col("seq")).alias("result_frame_id")
    )
    return stats.join(latest, "camera_id", "full_outer")


def engine_stats(frames: DataFrame, published: DataFrame, sessions: DataFrame, expire_s: float = 5.0) -> DataFrame:
    """Per camera: frames seen, events published, stays still open at the camera's last frame."""
    f = frames.groupBy("camera_id").agg(F.count("*").alias("frames"), F.max("us").alias("__now"))
    p = published.groupBy("camera_id").agg(F.count("*").alias("events_published"))
    last = sessions.groupBy("camera_id", "zone_id", "rule_id", "track_key").agg(F.max("us").alias("us"))
    alive = last.join(f.select("camera_id", "__now"), "camera_id").where(
        F.col("__now") - F.col("us") <= micros(expire_s)
    ).groupBy("camera_id").agg(F.count("*").alias("active_states"))
    zero = {"events_published": 0, "active_states": 0}
    return f.join(p, "camera_id", "left").join(alive, "camera_id", "left").drop("__now").fillna(zero)


def delivery_stats(log: DataFrame) -> DataFrame:
    """Sent, accepted, alerts returned, failed, and failures by code (text ``code=n``, sorted).

    ``log`` has ``client ok alert_id error_code status_code``.
    """
    code = F.coalesce("error_code", F.concat(F.lit("HTTP_"), F.coalesce(F.col("status_code").cast("string"), F.lit("ERROR"))))
    per_code = log.groupBy("client", F.when(~F.col("ok"), code).alias("code")).agg(
        F.count("*").alias("sent"),
        F.count_if("ok").alias("accepted"),
        F.count_if(F.col("ok") & F.col("alert_id").isNotNull()).alias("alerts_returned"),
    )
    entry = F.when(F.col("code").isNotNull(), F.concat("code", F.lit("="), F.col("sent").cast("string")))
    return per_code.groupBy("client").agg(
        F.sum("sent").alias("sent"),
        F.sum("accepted").alias("accepted"),
        F.sum("alerts_returned").alias("alerts_returned"),
        F.sum(F.col("sent") - F.col("accepted")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(entry)), " ").alias("error_codes"),
    )


def config_counts(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Per camera: zones, rules, enabled rules."""
    per_zone = rules.groupBy(F.col("zone_id").alias("id")).agg(
        F.count("*").alias("rules"), F.count_if("enabled").alias("enabled_rules")
    )
    return zones.join(per_zone, "id", "left").groupBy("camera_id").agg(
        F.count("*").alias("zones"),
        F.coalesce(F.sum("rules"), F.lit(0)).alias("rules"),
        F.coalesce(F.sum("enabled_rules"), F.lit(0)).alias("enabled_rules"),
    )


def event_rollup(events: DataFrame, dims: Sequence[str], mode: str = "rollup") -> DataFrame:
    """Event counts with subtotals; ``level`` tells a subtotal from a null value."""
    grouped = events.rollup(*dims) if mode == "rollup" else events.cube(*dims)
    return grouped.agg(F.count("*").alias("events"), F.grouping_id().cast("int").alias("level"))


def camera_metrics(
    frames: DataFrame, results: DataFrame, events: DataFrame, width_s: float = 60.0, slide_s: float | None = None
) -> DataFrame:
    """Per camera and window: frames read and processed per second, skipped, mean times, detections
    per frame, events. Windows slide when ``slide_s`` is given."""
    width, slide = micros(width_s), micros(slide_s or width_s)

    def cut(df: DataFrame) -> DataFrame:
        last = F.expr(f"us div {slide}L")
        first = F.expr(f"(us - {width}L) div {slide}L + 1")
        return df.withColumn("__w", F.explode(F.sequence(first, last))).withColumn("window_us", F.col("__w") * slide)

    key = ["camera_id", "window_us"]
    read = cut(frames).groupBy(*key).agg(F.count("*").alias("read_frames"))
    done = cut(results).groupBy(*key).agg(
        F.count("*").alias("processed_frames"),
        F.sum("objects").alias("__objects"),
        F.sum("inference_us").alias("__inference"),
        F.sum("latency_us").alias("__latency"),
    )
    told = cut(events).groupBy(*key).agg(F.count("*").alias("events"))
    zero = {"processed_frames": 0, "events": 0, "read_frames": 0}
    out = read.join(done, key, "full_outer").join(told, key, "full_outer").fillna(zero)
    per = lambda c: F.try_divide(F.col(c), F.col("processed_frames"))
    return out.select(
        *key, "read_frames", "processed_frames", "events",
        (F.col("read_frames") / F.lit(float(width_s))).alias("read_fps"),
        (F.col("processed_frames") / F.lit(float(width_s))).alias("processed_fps"),
        (F.col("read_frames") - F.col("processed_frames")).alias("skipped_frames"),
        per("__objects").alias("detections_per_frame"),
        per("__inference").alias("mean_inference_us"),
        per("__latency").alias("mean_latency_us"),
    )


def windowed_counts(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 minute", slide: str | None = None,
    session_gap: str | None = None,
) -> DataFrame:
    """Counts per tumbling, sliding or session window; the same call works on a stream with a watermark."""
    w = F.session_window(ts, session_gap) if session_gap else F.window(ts, width, slide or width)
    return df.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def peak_counts(df: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 hour", wider: str = "6 hours") -> DataFrame:
    """Of each wider window the rows, and the most in one narrow window of it: one windowed aggregate over another, on streams too."""
    narrow = df.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return narrow.groupBy(*keys, F.window(F.window_time("w"), wider).alias("v")).agg(F.sum("n").alias("n"), F.max("n").alias("peak")).select(
        *keys, F.col("v.start").alias("start"), F.col("v.end").alias("end"), "n", "peak")


def _earliest_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each prediction with the open label that ends first; rows come by run, in order of time."""
    heap: list[tuple[int, str, int]] = []
    for batch in batches:
        out = []
        for new, at, to, ident in zip(*[values(batch.column(c)) for c in ("__new", "at_us", "to_us", "id")]):
            if new:
                heap = []
            if to is not None:
                heappush(heap, (to, ident, at))
                continue
            while heap and heap[0][0] < at:
                heappop(heap)
            if heap:
                _, truth, begun = heappop(heap)
                out.append((ident, truth, (at - begun) / SECOND))
        cols = list(zip(*out)) if out else [[], [], []]
        kinds = (pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["pred_id", "truth_id", "delay_s"])


def match_ground_truth(pred: DataFrame, truth: DataFrame, slack_s: float = 0.0) -> DataFrame:
    """Predicted events paired one to one with labelled ones: ``outcome`` tp, fp or fn.

    A prediction (``pred_id video zone event_type start_us``) fits a label (``truth_id`` and the same,
    ``from_us to_us``) that it starts in. As many as can be are paired: in order of time, each prediction takes
    the label that ends first of those open and not taken. What is left over is false. Labels ``none`` only say
    what must not fire. Labels that overlap form runs, and each run of a key is worked through on its own.
    """
    keys = ["video", "zone", "event_type"]
    real = truth.where("event_type <> 'none'")
    spans = real.select(*keys, F.col("truth_id").alias("id"), F.col("from_us").alias("at_us"), (F.col("to_us") + micros(slack_s)).alias("to_us"))
    shots = pred.select(*keys, F.col("pred_id").alias("id"), F.col("start_us").alias("at_us"), F.lit(None).cast("bigint").alias("to_us"))
    borders = F.array(F.struct(F.col("at_us").alias("us"), F.lit(1).alias("d")), F.struct((F.col("to_us") + 1).alias("us"), F.lit(-1).alias("d")))
    steps = spans.where("to_us >= at_us").select(*keys, F.explode(borders).alias("s")).groupBy(*keys, F.col("s.us").alias("us")).agg(F.sum("s.d").alias("d"))
    open_now = running_sum(steps, keys, "us", F.col("d"), "open")
    begins = open_now.where("open > 0 AND open = d").select(*keys, F.col("us").alias("run_us"))
    placed = asof(spans.unionByName(shots), begins, keys, "at_us", "run_us", {"run_us": "run_us"}).where("run_us IS NOT NULL")
    label_first = F.col("to_us").isNull()
    paired = scan_in_order(
        placed, [*keys, "run_us"], ["at_us", label_first, "id"], _earliest_end, "pred_id string, truth_id string, delay_s double", spread=True)
    out = pred.select("event_type", "pred_id").join(paired, "pred_id", "left").select(
        "event_type", F.when(F.col("truth_id").isNull(), "fp").otherwise("tp").alias("outcome"), "pred_id", "truth_id", "delay_s")
    missed = real.join(paired.select("truth_id"), "truth_id", "left_anti").select(
        "event_type", F.lit("fn").alias("outcome"), F.lit(None).cast("string").alias("pred_id"), "truth_id", F.lit(None).cast("double").alias("delay_s"))
    return out.unionByName(missed)


def detection_quality(matches: DataFrame) -> DataFrame:
    """Precision, recall, F1 and mean delay per event type."""
    counted = matches.groupBy("event_type").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")],
        F.avg("delay_s").alias("mean_delay_s"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def count_error(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean absolute difference of people counted per frame (``video seq people``); absent is 0."""
    p = pred.select("video", "seq", F.col("people").alias("__p"))
    both = truth.select("video", "seq", F.col("people").alias("__t")).join(p, ["video", "seq"], "full_outer")
    diff = F.abs(F.coalesce("__p", F.lit(0)) - F.coalesce("__t", F.lit(0)))
    return both.groupBy("video").agg(
        F.count("*").alias("frames"), F.sum(diff).alias("total_error"), (F.sum(diff) / F.count("*")).alias("mean_abs_error")
    )


def sample_rate(frames: DataFrame, per_second: float) -> DataFrame:
    """Frames sent on when each must come ``1 / per_second`` after the camera's last one sent."""
    return throttle(frames, ["camera_id"], "us", 1.0 / per_second, tie=["seq"])
