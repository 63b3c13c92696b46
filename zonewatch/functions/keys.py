"""Identifiers and storage keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import parse_instant

CROWD = "crowd"


def frame_id(camera: Column, sequence: Column) -> Column:
    return F.format_string("%s-%012d", camera, sequence.cast("bigint"))


def track_key(class_name: Column, track_id: Column, sequence: Column, det_index: Column) -> Column:
    """``class-id``; an untracked detection is named by its frame and position instead."""
    name = F.coalesce(F.nullif(class_name, F.lit("")), F.lit("object"))
    tracked = F.concat(name, F.lit("-"), track_id.cast("string"))
    loose = F.concat(name, F.lit("-"), sequence.cast("string"), F.lit("-"), det_index.cast("string"))
    return F.coalesce(tracked, loose)


def source_event_id(camera: Column, zone: Column, rule: Column, track: Column | None, first_seq: Column) -> Column:
    """Name of a violation, fixed when it is first published. ``track=None`` is a crowd."""
    who = F.lit(CROWD) if track is None else track
    seq = F.coalesce(first_seq.cast("string"), F.lit("unknown"))
    return F.concat_ws("|", camera, zone, rule, who, seq)


def alert_dedup_key(camera: Column, zone: Column, event_type: Column, object_type: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        "|",
        F.coalesce(camera, blank),
        F.coalesce(zone, blank),
        F.coalesce(event_type, blank),
        F.coalesce(object_type, blank),
    )


def contract_alert_dedup_key(alert_type: Column, location: Column, zone: Column, primary: Column, ts: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        ":",
        F.coalesce(alert_type, blank),
        F.coalesce(location, blank),
        F.coalesce(zone, blank),
        F.coalesce(primary, blank),
        F.date_format(ts, "yyyyMMddHHmm"),
    )


def safe_path_part(value: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay, everything else becomes ``_``."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_\-]", "_")


def safe_file_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}_\-.]", "_")


def snapshot_key(camera: Column, event_id: Column, frame: Column) -> Column:
    name = F.concat(F.coalesce(F.nullif(frame, F.lit("")), F.lit("latest")), F.lit(".jpg"))
    return F.concat_ws("/", camera, safe_path_part(event_id), safe_file_name(name))


def clip_key(tenant: Column, camera: Column, captured: Column, event_id: Column, suffix: str = ".mp4") -> Column:
    """``evidence/tenant/camera/yyyy/mm/dd/event/clip.ext``."""
    return F.concat_ws(
        "/",
        F.lit("evidence"),
        safe_path_part(F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default"))),
        safe_path_part(camera),
        F.date_format(captured, "yyyy/MM/dd"),
        safe_path_part(event_id),
        F.lit("clip" + suffix),
    )


def clip_key_from_text(tenant: Column, camera: Column, captured: Column, event_id: Column) -> Column:
    return clip_key(tenant, camera, parse_instant(captured), event_id)


UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def tenant_uuid(code: Column, prefix: str = "tenant:", namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """A UUID is kept in lower case; any other code gets a name-based one (version 5).

    ``prefix`` separates the names of one installation from those of another.
    """
    name = F.concat(F.unhex(F.lit(namespace.hex)), F.encode(F.concat(F.lit(prefix), code), "UTF-8"))
    digest = F.sha1(name)
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    made = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return F.when(code.rlike(UUID_SHAPE), F.lower(code)).otherwise(made)


def location_code(location: Column) -> Column:
    return F.concat(F.lit("loc-"), F.right(location, F.lit(12)))
