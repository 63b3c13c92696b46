"""Nested event bodies built as structs; text is made only at the edge with ``to_json``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import SECOND, iso_millis_us
from .geometry import foot_point, point
from .rules import CROWD_RULE, contract_event_type


def seconds_between(first_us: Column, us: Column) -> Column:
    return (us - first_us) / F.lit(float(SECOND))


def rounded_foot(b: Column) -> Column:
    p = foot_point(b)
    return point(F.bround(p["x"], 1), F.bround(p["y"], 1))


def object_summary(
    track_key: Column, track_id: Column, class_name: Column, confidence: Column, b: Column,
    dwell_seconds: Column, direction: Column, speed: Column,
) -> Column:
    """One object inside a violation."""
    return F.struct(
        track_key.alias("track_key"),
        track_id.alias("track_id"),
        class_name.alias("class_name"),
        confidence.cast("double").alias("confidence"),
        b.alias("bbox"),
        rounded_foot(b).alias("foot_point"),
        F.bround(dwell_seconds, 2).alias("dwell_time_seconds"),
        direction.alias("direction"),
        speed.alias("speed_px_s"),
    )


def contract_object(o: Column) -> Column:
    """The same object in contract form."""
    return F.struct(
        o["track_id"].alias("track_id"),
        F.upper(F.coalesce(o["class_name"], F.lit(""))).alias("object_type"),
        o["confidence"].alias("confidence"),
        o["bbox"].alias("bbox"),
        o["foot_point"].alias("foot_point"),
        o["dwell_time_seconds"].alias("dwell_time_seconds"),
        o["direction"].alias("direction"),
        o["speed_px_s"].alias("speed_px_s"),
    )


def event_payload(model: str = "detector", tracker: str = "tracker") -> Column:
    """Body of a published event.

    Reads the columns ``camera_id location_id frame_id seq frame_w frame_h zone_name zone_type
    rule_type first_us us objects object_count reattached_from heartbeat_index detection``.
    """
    c = F.col
    elapsed = F.bround(F.bround(seconds_between(c("first_us"), c("us")), 2), 0).cast("int")
    return F.struct(
        c("camera_id"),
        c("location_id"),
        c("frame_id"),
        c("seq").alias("sequence_number"),
        c("frame_w").alias("frame_width"),
        c("frame_h").alias("frame_height"),
        c("zone_name"),
        c("zone_type"),
        c("rule_type"),
        elapsed.alias("elapsed_seconds"),
        c("object_count"),
        c("reattached_from"),
        c("heartbeat_index"),
        c("detection"),
        F.struct(
            F.lit("AI").alias("event_source"),
            contract_event_type(c("rule_type")).alias("event_type"),
            iso_millis_us(c("us")).alias("timestamp"),
            F.transform(c("objects"), contract_object).alias("objects"),
            F.struct(
                F.lit(model).alias("model_name"),
                F.lit(tracker).alias("tracker"),
                F.concat(c("rule_type"), F.lit("_v1")).alias("rule_name"),
            ).alias("metadata"),
        ).alias("contract"),
    )


def violation_summary() -> Column:
    """Short form shown live; reads the session columns of a violating row."""
    c = F.col
    crowd = c("rule_type") == CROWD_RULE
    return F.struct(
        F.concat_ws("|", c("camera_id"), c("zone_id"), c("rule_id"),
                    F.when(crowd, F.lit("crowd")).otherwise(c("track_key"))).alias("key"),
        c("source_event_id"),
        c("camera_id"),
        c("zone_id"),
        c("zone_name"),
        c("rule_id").alias("rule_config_id"),
        c("rule_type"),
        contract_event_type(c("rule_type")).alias("event_type"),
        c("object_type"),
        c("track_key").alias("track_id"),
        c("object_count"),
        F.bround(seconds_between(c("first_us"), c("us")), 1).alias("elapsed_seconds"),
        c("seq").alias("sequence_number"),
        F.when(~crowd, c("direction")).alias("direction"),
    )


def event_confidence(own: Column, detection: Column, objects: Column) -> Column:
    """Own value, else the detection's, else the lowest of the objects, else 1."""
    return F.coalesce(
        own.cast("double"),
        detection.cast("double"),
        F.array_min(F.transform(objects, lambda o: o["confidence"].cast("double"))),
        F.lit(1.0),
    )


def backend_event() -> Column:
    """Message for the alert service; reads event columns plus ``area_id`` and ``confidence``."""
    c = F.col
    return F.struct(
        c("camera_id").alias("cameraId"),
        c("area_id").alias("areaId"),
        F.coalesce(F.nullif(c("object_type"), F.lit("")), F.lit("person")).alias("objectType"),
        F.coalesce(c("confidence"), F.lit(1.0)).alias("confidence"),
        iso_millis_us(F.coalesce(c("last_seen_us"), c("started_us"))).alias("occurredAt"),
        c("id").alias("aiEventId"),
    )
