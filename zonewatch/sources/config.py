"""Cameras, zones and rules."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# What a camera entry may leave out.
CAMERA_DEFAULTS = {"source_type": "RTSP", "target_fps": 10.0, "frame_width": 1280, "frame_height": 720, "encoding": "JPEG"}
# End of fixed values.


def apply_camera_defaults(items: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Enabled cameras with defaults filled in; source type and encoding in upper case."""
    d = {**CAMERA_DEFAULTS, **(defaults or {})}
    col = lambda n: F.coalesce(F.col(n), F.lit(d[n]))
    return items.where(F.coalesce("enabled", F.lit(True))).select(
        "camera_id", "location_id", "name",
        F.upper(col("source_type")).alias("source_type"), "source_url",
        col("target_fps").cast("double").alias("target_fps"),
        col("frame_width").alias("frame_w"), col("frame_height").alias("frame_h"),
        F.upper(col("encoding")).alias("encoding"),
    )


def read_camera_catalog(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """JSON lines of cameras."""
    return apply_camera_defaults(spark.read.schema(schemas.CAMERA_ITEM).json(path), defaults)


def parse_points(polygon: Column) -> Column:
    """Points from ``{"points": [...]}`` or from a bare list; unreadable text has none."""
    wrapped = F.from_json(polygon, schemas.POLYGON)["points"]
    bare = F.when(F.ltrim(polygon).startswith("["), F.from_json(polygon, schemas.POINTS))
    return F.coalesce(bare, wrapped, F.array().cast(schemas.POINTS))


def parse_zones(zones: DataFrame) -> DataFrame:
    """Zones with ``points`` read from their ``polygon`` text; disabled ones left out."""
    return zones.where(F.coalesce("enabled", F.lit(True))).select(
        "id", "camera_id", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("zone_type", F.lit("")).alias("zone_type"),
        parse_points(F.col("polygon")).alias("points"),
        F.coalesce("frame_width", F.lit(0)).alias("frame_width"),
        F.coalesce("frame_height", F.lit(0)).alias("frame_height"),
        F.lit(True).alias("enabled"),
    )


def clean_rules(rules: DataFrame) -> DataFrame:
    """Rules with empty texts as null and flags filled in."""
    blank = lambda n, t: F.nullif(F.col(n).cast("string"), F.lit("")).try_cast(t).alias(n)
    return rules.select(
        "id", "zone_id", "rule_type", F.coalesce("enabled", F.lit(True)).alias("enabled"),
        blank("object_type", "string"), blank("duration_threshold", "double"), blank("people_threshold", "int"),
        blank("confidence_threshold", "double"),
        F.coalesce("use_active_time", F.lit(False)).alias("use_active_time"),
        blank("active_start_time", "string"), blank("active_end_time", "string"),
    )


def read_zone_rules(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Zones with their rules as an array; a zone without rules has an empty one."""
    r = clean_rules(rules)
    packed = r.groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct(*r.columns))).alias("rules"))
    empty = F.array().cast(packed.schema["rules"].dataType)
    return parse_zones(zones).join(packed.withColumnRenamed("zone_id", "id"), "id", "left").withColumn(
        "rules", F.coalesce("rules", empty)
    )


def refreshing_dimension(
    loader: Callable[[], DataFrame], ttl_seconds: float = 10.0, clock: Callable[[], float] = time.monotonic
) -> Callable[[], DataFrame]:
    """A callable giving a configuration at most ``ttl_seconds`` old.

    Meant for ``foreachBatch``: call it once per batch. When loading fails the last good one is given
    and the next call tries again; with none yet the error is raised.
    """
    state: dict = {"df": None, "at": None}

    def current() -> DataFrame:
        now = clock()
        if state["df"] is None or now - state["at"] >= ttl_seconds:
            try:
                fresh = loader()
                fresh.schema  # an unreadable source fails here, not in the middle of the batch
                state["df"], state["at"] = fresh, now
            except Exception:
                if state["df"] is None:
                    raise
        return state["df"]

    return current
