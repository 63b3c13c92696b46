"""Which frames and clips to keep as proof of an event, and how to find them again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..session import stage
from .throttle import throttle
from .timeline import asof, interval_join, scan_in_order, slice_frames, values


def plan_snapshots(events: DataFrame, evidence: DataFrame | None = None, every_s: float = 120.0) -> DataFrame:
    """Events that get a picture: one per alert (without one: per event) and ``every_s``.

    ``evidence`` (``ai_event_id alert_id frame_id captured_us``) counts whatever its kind. An event
    never gets two pictures of one frame. The key is the alert an event has in this input; an event
    linked only later was limited on its own at first, so replays can differ from live runs there. What is left of the
    events is written once, as the throttle reads it several times. Runs a job when called.
    """
    todo = events.where(F.col("us").isNotNull()).withColumn(
        "__key", F.coalesce(F.concat(F.lit("a:"), "alert_id"), F.concat(F.lit("e:"), "event_id"))
    )
    todo = todo.dropDuplicates(["event_id", "us", "frame_id"])
    if evidence is None:
        return throttle(stage(todo, "pictured"), ["__key"], "us", every_s, tie=["event_id"]).drop("__key")
    taken = evidence.select(F.col("ai_event_id").alias("event_id"), "frame_id").distinct()
    todo = todo.join(taken, ["event_id", "frame_id"], "left_anti")
    any_taken = taken.select("event_id").distinct().withColumn("__any", F.lit(True))
    todo = todo.join(any_taken, "event_id", "left").where(
        F.col("frame_id").isNotNull() | F.col("__any").isNull()
    ).drop("__any")
    last = (
        evidence.select(F.concat(F.lit("a:"), "alert_id").alias("__key"), "captured_us")
        .unionByName(evidence.select(F.concat(F.lit("e:"), "ai_event_id").alias("__key"), "captured_us"))
        .where("__key IS NOT NULL").groupBy("__key").agg(F.max("captured_us").alias("__last_taken"))
    )
    todo = stage(todo.join(last, "__key", "left"), "pictured")
    return throttle(todo, ["__key"], "us", every_s, tie=["event_id"], seed="__last_taken").drop("__key", "__last_taken")


def frames_around(events: DataFrame, frames: DataFrame, pre: float = 5.0, post: float = 5.0) -> DataFrame:
    """Event rows paired with the frames of their camera in ``[us - pre, us + post]``."""
    spans = events.withColumn("clip_from_us", F.col("us") - micros(pre)).withColumn(
        "clip_to_us", F.col("us") + micros(post)
    )
    shots = frames.select(
        "camera_id", F.col("us").alias("frame_us"), F.col("frame_id").alias("clip_frame_id"),
        F.col("seq").alias("clip_seq"),
    )
    return interval_join(
        spans, shots, ["camera_id"], "clip_from_us", "clip_to_us", "frame_us", micros(pre + post)
    )


def _sampled(gap: int):
    """Of each group the rows ``gap`` or more after the last one taken, and its last row; no frame twice."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, held = None, set(), None
        for batch in batches:
            fresh = batch.column("__new").to_pylist()
            rows = batch.drop_columns(["__new"])
            mask: list = []
            frames = rows.column("clip_frame_id").to_pylist()
            for t, new, frame in zip(values(rows.column("frame_us")), fresh, frames):
                if new:
                    # The row before was the last of its group.
                    if mask:
                        mask[-1] = mask[-1] or frames[len(mask) - 1] not in seen
                    elif held is not None:
                        yield held
                    last, seen = None, set()
                take = last is None or t - last >= gap
                if take:
                    last, take = t, frame not in seen
                    seen.add(frame)
                mask.append(take)
                held = None
            if mask:
                held = None if frames[-1] in seen else rows.slice(len(mask) - 1, 1)
                yield rows.filter(pa.array(mask, pa.bool_()))
        if held is not None:
            yield held

    return step


def sample_clip(shots: DataFrame, clip: str = "event_id", fps: float = 10.0) -> DataFrame:
    """Frames of each clip at ``fps`` at most, the last frame always among them.

    A clip is short and clips are many, so a task reads its clips one after the other and no more than one shuffle is needed.
    """
    return scan_in_order(shots, [clip], ["frame_us", "clip_seq"], _sampled(micros(1.0 / max(0.001, fps))), shots.schema)


def plan_clips(
    snapshots: DataFrame, frames: DataFrame, pre: float = 5.0, post: float = 5.0, fps: float = 10.0
) -> DataFrame:
    """Clip per snapshot: its frames and ``completed`` or ``partial``; no frames, no clip."""
    wanted = snapshots.select("event_id", "camera_id", "us")
    shots = sample_clip(frames_around(wanted, frames, pre, post), "event_id", fps)
    # A clip holds at most fps * (pre + post) + 1 frames, so its list is bounded.
    return shots.groupBy("event_id", "camera_id", "clip_from_us", "clip_to_us").agg(
        F.count("*").alias("frames"),
        F.when(
            (F.min("frame_us") > F.first("clip_from_us")) | (F.max("frame_us") < F.first("clip_to_us")),
            F.lit("partial"),
        ).otherwise(F.lit("completed")).alias("status"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("frame_us", "clip_frame_id"))), lambda s: s["clip_frame_id"]
        ).alias("frame_ids"),
    )


def frame_for_event(events: DataFrame, frames: DataFrame) -> DataFrame:
    """The event's own frame, else the camera's latest frame at that time (``shot_frame_id``)."""
    own = frames.select("camera_id", F.col("frame_id"), F.col("us").alias("__own_us"))
    matched = events.join(own, ["camera_id", "frame_id"], "left")
    latest = frames.select("camera_id", "us", F.col("frame_id").alias("__f"))
    out = asof(matched, latest, ["camera_id"], "us", "us", {"__f": "__latest_id"})
    return out.withColumn(
        "shot_frame_id", F.when(F.col("__own_us").isNotNull(), F.col("frame_id")).otherwise(F.col("__latest_id"))
    ).drop("__own_us", "__latest_id")


def next_after(cursors: DataFrame, frames: DataFrame) -> DataFrame:
    """First frame of the camera after a cursor sequence (``after_seq``); null cursor means any.

    Cursors and frames meet in slices of the sequence, so no camera is read by one task.
    """
    wanted = cursors.withColumn("__from", F.coalesce("after_seq", F.lit(-(2**62))))
    shots = frames.select("camera_id", F.col("seq").alias("__seq"), "frame_id")
    found = asof(
        wanted, shots, ["camera_id"], "__from", "__seq", {"__seq": "seq", "frame_id": "frame_id"},
        forward=True, inclusive=False, width=slice_frames(),
    )
    return found.where("seq IS NOT NULL").drop("__from")


def pair_frames_results(frames: DataFrame, results: DataFrame) -> DataFrame:
    """Frames with the result of exactly that frame."""
    return frames.join(results, ["camera_id", "frame_id"])


def evidence_with_event(evidence: DataFrame, events: DataFrame) -> DataFrame:
    e = events.select(
        F.col("id").alias("ai_event_id"), "event_type", "zone_id", "object_type",
        F.col("alert_id").alias("event_alert_id"),
    )
    return evidence.join(e, "ai_event_id", "left")


def search_evidence(
    evidence: DataFrame, events: DataFrame, camera_id=None, event_type=None, evidence_type=None, status=None,
    from_us=None, to_us=None, zone_id=None, object_type=None, limit: int | None = 100,
) -> DataFrame:
    """Evidence newest first; only the given criteria become filters, on the side they belong to."""
    ev, out = events, evidence
    for name, value in (("camera_id", camera_id), ("evidence_type", evidence_type), ("status", status)):
        if value:
            out = out.where(F.col(name) == value)
    if from_us is not None:
        out = out.where(F.col("captured_us") >= from_us)
    if to_us is not None:
        out = out.where(F.col("captured_us") <= to_us)
    by_event = {"event_type": event_type, "zone_id": zone_id, "object_type": object_type}
    wanted = {k: v for k, v in by_event.items() if v}
    for name, value in wanted.items():
        ev = ev.where(F.col(name) == value)
    if wanted:
        out = out.join(ev.select(F.col("id").alias("ai_event_id")), "ai_event_id", "left_semi")
    return list_evidence(out, limit)


def list_evidence(evidence: DataFrame, limit: int | None = 100) -> DataFrame:
    out = evidence.orderBy(F.col("captured_us").desc(), F.col("created_us").desc(), "id")
    return out if limit is None else out.limit(max(1, min(int(limit), 500)))


def evidence_of_event(evidence: DataFrame, event_id) -> DataFrame:
    return evidence.where(F.col("ai_event_id") == event_id).orderBy("captured_us", "created_us", "id")


def related_evidence(event_ids: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each event and of the other events in its alert, each item once per event."""
    asked = event_ids.select(F.col("id").alias("asked_id")).join(
        events.select(F.col("id").alias("asked_id"), F.col("alert_id").alias("asked_alert")), "asked_id"
    )
    own = evidence.join(asked, F.col("ai_event_id") == F.col("asked_id"))
    shared = evidence.join(asked.where("asked_alert IS NOT NULL"), F.col("alert_id") == F.col("asked_alert"))
    return own.unionByName(shared).drop("asked_alert").dropDuplicates(["asked_id", "id"])


def attach_alert(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Fill the alert of evidence taken before its event had one (``links``: ``ai_event_id alert_id``)."""
    new = links.groupBy("ai_event_id").agg(F.max("alert_id").alias("__alert"))
    return evidence.join(new, "ai_event_id", "left").withColumn(
        "alert_id", F.coalesce("alert_id", "__alert")
    ).drop("__alert")
