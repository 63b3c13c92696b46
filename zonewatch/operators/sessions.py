"""How long objects stay, how long crowds hold, and when that is reported.

Rule hits carry ``camera_id zone_id rule_id track_key us seq``. ``frames`` has one row per processed
frame (``camera_id us seq``), those without detections too: a stay ends only at a processed frame in
which the object was missing for too long, and a crowd ends at the first frame below its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry, keys
from ..functions.clock import SECOND, micros
from ..functions.rules import CROWD_RULE
from ..session import stage
from .steps import Stays
from .throttle import throttle
from .timeline import marked_sessions, previous, running_sum, scan_in_order, sessions, values

STAY = ["camera_id", "zone_id", "rule_id", "track_key"]


@dataclass(frozen=True)
class Reattach:
    """When a new track continues the stay of a lost one."""

    grace_s: float = 3.0
    distance_px: float = 80.0
    low_ratio: float = 0.5
    high_ratio: float = 2.0


def with_previous_frame(frames: DataFrame) -> DataFrame:
    """Frames with the time of the camera's frame before (``prev_frame_us``)."""
    return previous(frames, ["camera_id"], "us", {"us": "prev_frame_us"})


def _timed_frames(frames: DataFrame) -> DataFrame:
    """``camera_id us prev_frame_us``, one row per instant."""
    if "prev_frame_us" in frames.columns:
        return frames.select("camera_id", "us", "prev_frame_us")
    return with_previous_frame(frames.select("camera_id", "us").distinct())


def _after_frames(hits: DataFrame, frames: DataFrame) -> DataFrame:
    """Hits with ``prev_frame_us``; the join key is camera and instant, so a busy camera spreads.

    Frames that carry it already (``with_previous_frame``, one row per instant) are taken as they are.
    A hit whose frame row is missing stays; it counts as following its track's last hit.
    """
    if "prev_frame_us" in hits.columns:
        return hits
    return hits.join(_timed_frames(frames), ["camera_id", "us"], "left")


def _timed(df: DataFrame) -> DataFrame:
    elapsed = (F.col("us") - F.col("first_us")) / F.lit(float(SECOND))
    return df.withColumn("elapsed_s", elapsed).withColumn(
        "is_violation", F.coalesce(elapsed >= F.col("duration_threshold"), F.lit(False))
    )


def dwell_sessions(
    rule_hits: DataFrame, frames: DataFrame, expire_s: float = 5.0, reattach: Reattach | None = None, violating: bool = False
) -> DataFrame:
    """Stay of each track in each zone under each rule, one row per hit.

    Adds ``first_us``, ``first_seq``, ``elapsed_s`` and ``is_violation``; with ``reattach`` also
    ``origin_key`` (the track that began the stay, and when) and ``reattached_from``. Crowd rules and
    rules without a duration are not stays and are left out. ``violating`` gives the rows at or above their duration alone,
    without working out the stays of tracks that are never there for so long. Runs jobs when called.
    """
    hits = rule_hits.where((F.col("rule_type") != CROWD_RULE) & F.col("duration_threshold").isNotNull())
    if violating:
        return _dwell(hits, frames, expire_s, reattach, F.col("duration_threshold")).where("is_violation")
    return _dwell(hits, frames, expire_s, reattach)


def _dwell(hits: DataFrame, frames: DataFrame, expire_s: float, reattach: Reattach | None, least_s: Column | None = None) -> DataFrame:
    if reattach is None:
        gap, carry = micros(expire_s), {"seq": "first_seq"}
        if "prev_frame_us" in hits.columns or gap <= 0:
            return _timed(sessions(_after_frames(hits, frames), STAY, "us", gap, mark="prev_frame_us", carry=carry))
        # Half a microsecond less, so that rounding leaves nothing out.
        lasting = None if least_s is None else least_s * SECOND - F.lit(0.5)
        return _timed(marked_sessions(
            hits, _timed_frames(frames), "prev_frame_us", ["camera_id", "us"], STAY, "us", gap, carry=carry, lasting=lasting))
    return _timed(_reattached(_after_frames(hits, frames), expire_s, reattach))


def _reattached(hits: DataFrame, expire_s: float, r: Reattach) -> DataFrame:
    """Stays that survive a change of track id.

    A lost track is only ever continued by one of the same zone, rule and class, and nothing is left
    to continue once that group has been empty for longer than ``expire_s``. So each busy stretch of
    each group is worked through on its own, in order, with only the open stays in memory.
    """
    group = ["camera_id", "zone_id", "rule_id", "class_name"]
    stretched = sessions(hits, group, "us", micros(expire_s), mark="prev_frame_us", out="__stretch")
    foot = geometry.foot_point(F.col("bbox"))
    ready = (
        stretched.withColumn("__fx", foot["x"])
        .withColumn("__fy", foot["y"])
        .withColumn("__area", geometry.bbox_area(F.col("bbox")))
    )
    added = T.StructType(
        [
            T.StructField("first_us", T.LongType()),
            T.StructField("first_seq", T.LongType()),
            T.StructField("origin_key", T.StringType()),
            T.StructField("reattached_from", T.StringType()),
        ]
    )
    drop = {"__stretch", "__fx", "__fy", "__area"}
    kept = [f for f in ready.schema.fields if f.name not in drop]
    names = [f.name for f in kept]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = None
        wanted = ["__new", "track_key", "us", "seq", "prev_frame_us", "__fx", "__fy", "__area"]
        for batch in batches:
            cols = [values(batch.column(c)) for c in wanted]
            found = []
            for new, key, us, seq, prev, x, y, area in zip(*cols):
                if new:
                    stays = Stays(micros(expire_s), micros(r.grace_s), r.distance_px, r.low_ratio, r.high_ratio)
                s = stays.see(key, us, seq, prev, x, y, area)
                found.append((s.first_us, s.first_seq, s.origin, s.came_from))
            extra = [pa.array([row[i] for row in found], t) for i, t in
                     enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + extra, names + added.fieldNames()
            )

    return scan_in_order(
        ready, [*group, "__stretch"], ["us", "seq", "det_index"], step, T.StructType(kept + added.fields), spread=True
    )


def crowd_members(rule_hits: DataFrame) -> DataFrame:
    """People per frame, zone and crowd rule: distinct tracks, their list, lowest confidence."""
    crowd = rule_hits.where(F.col("rule_type") == CROWD_RULE)
    member = F.struct("track_key", "confidence", "bbox")
    return crowd.groupBy("camera_id", "seq", "us", "zone_id", "rule_id").agg(
        F.first("duration_threshold").alias("duration_threshold"),
        F.first("people_threshold").alias("people_threshold"),
        F.first("rule_type").alias("rule_type"),
        F.coalesce(F.first(F.nullif(F.col("rule_object_type"), F.lit(""))), F.lit("person")).alias("object_type"),
        F.size(F.collect_set("track_key")).cast("bigint").alias("people"),
        F.array_sort(F.collect_list(member)).alias("members"),
        F.min("confidence").alias("min_confidence"),
    )


def crowd_sessions(members: DataFrame, frames: DataFrame) -> DataFrame:
    """Runs of consecutive camera frames at or above the people threshold, one row per frame.

    A run breaks as soon as one processed frame lies between two crowded ones. Crowded frames, few among all, are
    written out, as ``sessions`` reads them twice. Runs a job when called.
    """
    crowded = members.where(
        F.col("people_threshold").isNotNull()
        & F.col("duration_threshold").isNotNull()
        & (F.col("people") >= F.col("people_threshold"))
    )
    ordered = stage(_after_frames(crowded, frames), "crowded")
    out = sessions(
        ordered, ["camera_id", "zone_id", "rule_id"], "us", 0, mark="prev_frame_us", carry={"seq": "first_seq"}
    )
    named = out.withColumn("track_key", F.concat(F.col("people").cast("string"), F.lit(" objects")))
    return _timed(named)


def heartbeat_events(violations: DataFrame, every_s: float = 1.0) -> DataFrame:
    """Violating rows that are published: the first of a stay, then one per ``every_s``.

    Adds ``heartbeat_index`` (from 1) and ``source_event_id``, which keeps the track key it had at the
    first publication. Runs a job when called.
    """
    v = violations.where("is_violation")
    crowd = F.col("rule_type") == CROWD_RULE
    if "origin_key" in v.columns:
        # A continued stay goes on under its first track, and two stays can begin in one frame.
        v = v.withColumn("__stay", F.col("origin_key"))
    else:
        v = v.withColumn("__stay", F.when(crowd, F.lit("")).otherwise(F.col("track_key")))
    stay = ["camera_id", "zone_id", "rule_id", "__stay", "first_us"]
    # Written out: it is read for the count along the stay, for the first key, and for its rows.
    kept = stage(throttle(v, stay, "us", every_s), "heartbeats")
    first = kept.groupBy(*stay).agg(F.min_by("track_key", F.col("us")).alias("__who"))
    kept = running_sum(kept, stay, "us", F.lit(1), "heartbeat_index").join(first, stay)
    named = keys.source_event_id(
        F.col("camera_id"), F.col("zone_id"), F.col("rule_id"),
        F.when(F.col("rule_type") == CROWD_RULE, F.lit(keys.CROWD)).otherwise(F.col("__who")), F.col("first_seq"),
    )
    return kept.withColumn("source_event_id", named).drop("__stay", "__who")


def occupancy(sessions_df: DataFrame) -> DataFrame:
    """One row per stay: entered, last seen, seconds, frames."""
    return sessions_df.groupBy(*STAY, "first_us").agg(
        F.max("us").alias("last_us"),
        ((F.max("us") - F.col("first_us")) / F.lit(float(SECOND))).alias("dwell_s"),
        F.count("*").alias("frames"),
        F.max("is_violation").alias("violated"),
    )


def low_movement_dwell(sessions_df: DataFrame, min_s: float = 10.0, max_px: float = 30.0) -> DataFrame:
    """Stays of at least ``min_s`` during which the object stayed within ``max_px`` of its start."""
    foot = geometry.foot_point(F.col("bbox"))
    stay = [*STAY, "first_us"]
    starts = sessions_df.where(F.col("us") == F.col("first_us")).groupBy(*stay).agg(
        F.min(foot).alias("__start")
    )
    moved = geometry.distance(foot, F.col("__start"))
    return (
        sessions_df.join(starts, stay)
        .groupBy(*stay)
        .agg(
            ((F.max("us") - F.col("first_us")) / F.lit(float(SECOND))).alias("dwell_s"),
            F.max(moved).alias("max_moved_px"),
        )
        .where((F.col("dwell_s") >= min_s) & (F.col("max_moved_px") <= max_px))
    )


def active_violations(violations: DataFrame, asof_us, ttl_s: float = 4.0) -> DataFrame:
    """What is going on at ``asof_us``: seen within ``ttl_s``, newest first.

    A key unseen for longer than ``ttl_s`` starts anew when it comes back.
    """
    known = violations.where(F.col("us") <= asof_us)
    runs = sessions(known, ["key"], "us", micros(ttl_s), out="first_seen_us")
    latest = runs.groupBy("key").agg(
        F.max("us").alias("last_seen_us"), F.max_by("first_seen_us", F.col("us")).alias("first_seen_us")
    )
    return latest.where(F.lit(asof_us) - F.col("last_seen_us") <= micros(ttl_s)).orderBy(
        F.col("first_seen_us").desc(), "key"
    )
