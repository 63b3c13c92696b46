"""Sensor readings: noise filter, liveness, and one event table for all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.clock import SECOND, micros
from .throttle import throttle
from .timeline import asof, last_n_all, previous


def sensor_active(readings: DataFrame, n: int = 3) -> DataFrame:
    """Readings with ``is_active``: the sensor's last ``n`` readings were all positive.

    ``reading_id``, where readings have one, orders those of one instant.
    """
    return last_n_all(readings, ["sensor_id"], "us", F.col("positive"), n, "is_active", tie=reading_order(readings))


def reading_order(readings: DataFrame) -> list[str]:
    return [c for c in ("reading_id",) if c in readings.columns]


def ai_active(events: DataFrame, asof_points: DataFrame, within_s: float = 3.0, min_confidence: float = 0.6) -> DataFrame:
    """Per location and instant (``location_id asof_us``): was a sure enough event seen just before."""
    sure = events.where(F.col("confidence") >= min_confidence).select(
        "location_id", F.col("us").alias("__us")
    ).distinct()
    seen = asof(asof_points, sure, ["location_id"], "asof_us", "__us", {"__us": "last_event_us"})
    return seen.withColumn(
        "is_active", F.coalesce(F.col("asof_us") - F.col("last_event_us") <= micros(within_s), F.lit(False))
    )


def liveness(messages: DataFrame, key: str, timeout_s: float, asof_us: int | Column | None = None) -> DataFrame:
    """``OFFLINE`` when a key has been silent for longer than ``timeout_s``, ``ONLINE`` when it is back.

    One pair per gap, with the downtime from the last message to the next; a key silent up to
    ``asof_us`` has an ``OFFLINE`` without downtime.
    """
    limit = micros(timeout_s)
    beats = messages.select(key, "us").distinct()
    steps = previous(beats, [key], "us", {"us": "last_us"})
    gaps = steps.where(F.col("us") - F.col("last_us") > limit)
    down = ((F.col("us") - F.col("last_us")) / F.lit(float(SECOND))).alias("downtime_s")
    event = lambda name, at, d: F.struct(F.lit(name).alias("status"), at.alias("at_us"), F.col("last_us"), d)
    nothing = F.lit(None).cast("double").alias("downtime_s")
    pairs = gaps.select(
        key,
        F.explode(
            F.array(event("OFFLINE", F.col("last_us") + limit, nothing), event("ONLINE", F.col("us"), down))
        ).alias("e"),
    ).select(key, "e.*")
    if asof_us is None:
        return pairs
    now = F.lit(asof_us) if isinstance(asof_us, int) else asof_us
    silent = beats.groupBy(key).agg(F.max("us").alias("last_us")).where(now - F.col("last_us") > limit)
    return pairs.unionByName(
        silent.select(key, event("OFFLINE", F.col("last_us") + limit, nothing).alias("e")).select(key, "e.*")
    )


def device_status(messages: DataFrame, key: str, timeout_s: float, asof_us) -> DataFrame:
    """Last message of each key and whether it still counts as online."""
    now = F.lit(asof_us) if isinstance(asof_us, int) else asof_us
    last = messages.groupBy(key).agg(F.max("us").alias("last_us"))
    online = now - F.col("last_us") <= micros(timeout_s)
    return last.withColumn("status", F.when(online, F.lit("ONLINE")).otherwise(F.lit("OFFLINE")))


def sensor_events(readings: DataFrame, temperature_limit: float = 50.0, gas_limit: float = 300.0) -> DataFrame:
    """Readings that stand for an event, with its type."""
    kind = rules.sensor_event_type(F.col("sensor_type"), F.col("value"), temperature_limit, gas_limit)
    return readings.withColumn("event_type", kind).where("event_type IS NOT NULL")


def normalise_events(ai_events: DataFrame, readings: DataFrame) -> DataFrame:
    """AI events and positive readings in one table; a reading has no confidence."""
    ai = ai_events.select(
        F.concat(F.lit("ai:"), F.col("event_id").cast("string")).alias("event_id"),
        F.lit("AI").alias("source"), "event_type", "location_id", "us",
        F.col("confidence").cast("double").alias("confidence"),
        F.col("event_id").cast("string").alias("raw_reference_id"),
    )
    iot = sensor_events(readings.where("positive")).select(
        F.concat(F.lit("iot:"), F.col("reading_id").cast("string")).alias("event_id"),
        F.lit("IOT").alias("source"), "event_type", "location_id", "us",
        F.lit(None).cast("double").alias("confidence"),
        F.col("reading_id").cast("string").alias("raw_reference_id"),
    )
    return ai.unionByName(iot)


def dedup_events(events: DataFrame, window_s: float = 60.0) -> DataFrame:
    """Events with repeats within ``window_s`` removed: per track, for crowds per zone."""
    crowd = rules.canonical_event_type(F.col("event_type")) == "RESTRICTED_ZONE_CROWDING"
    keyed = events.withColumn("__who", F.when(crowd, F.lit(None)).otherwise(F.col("track_id").cast("string")))
    return throttle(
        keyed, ["event_type", "camera_id", "zone_id", "__who"], "us", window_s, tie=["event_id"]
    ).drop("__who")


def dedup_offline(events: DataFrame, key: str, window_s: float = 300.0) -> DataFrame:
    """Offline events with repeats of the same device within five minutes removed."""
    return throttle(events.where(F.col("status") == "OFFLINE"), [key], "at_us", window_s)
