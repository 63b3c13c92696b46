"""Events merged into alerts with a lifecycle.

Events carry ``source_event_id camera_id zone_id rule_config_id event_type object_type us
started_us first_seq last_seq``; ``us`` is the time the event was last seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, rules
from ..functions.clock import micros
from ..session import stage
from .timeline import asof, sessions

ALERT = ["dedup_key", "alert_us"]


def _arrival() -> Column:
    return F.struct(F.col("us"), F.col("last_seq"), F.col("source_event_id"))


def with_alert(events: DataFrame, window_s: float = 120.0, grace_s: float | None = 30.0) -> DataFrame:
    """Events with their ``dedup_key``, the start ``alert_us`` of their alert, and ``alert_id``.

    With sweeps (``grace_s``) an alert unseen for longer than the grace is closed before the next
    event comes, so the shorter of both settings parts two alerts; ``grace_s=None`` is without sweeps.
    """
    gap = window_s if grace_s is None else min(window_s, grace_s)
    keyed = events.withColumn(
        "dedup_key",
        keys.alert_dedup_key(F.col("camera_id"), F.col("zone_id"), F.col("event_type"), F.col("object_type")),
    )
    out = sessions(keyed, ["dedup_key"], "us", micros(gap), out="alert_us")
    return out.withColumn("alert_id", F.concat("dedup_key", F.lit("@"), F.col("alert_us").cast("string")))


def alert_sessions(
    events: DataFrame, window_s: float = 120.0, grace_s: float | None = 30.0, sweeps: bool = True
) -> DataFrame:
    """One row per alert with its source count, span and, where it has one, its end.

    ``active_source_count`` is 1 at the opening event and grows with every later event of a source
    never seen before in any alert. An alert has ended once any event comes more than ``grace_s`` after it was
    last seen: ``ended_us`` is the time of the first one, or ``grace_s`` after it was last seen with ``sweeps=False``,
    which is what a stream can tell of a key alone.
    """
    linked = stage(with_alert(events, window_s, grace_s), "linked")
    order = _arrival()
    merged = linked.groupBy(*ALERT, "alert_id").agg(
        F.min_by(F.struct("camera_id", "zone_id", "rule_config_id", "event_type", "object_type",
                          "started_us", "first_seq"), order).alias("o"),
        F.min(order).alias("__opened"),
        F.max_by("last_seq", order).alias("last_seq"),
        F.max("us").alias("last_seen_us"),
        F.count("*").alias("events"),
    )
    first_seen = linked.groupBy("source_event_id").agg(
        F.min_by(F.struct(*ALERT), order).alias("at"), F.min(order).alias("__first")
    )
    fresh = first_seen.groupBy(F.col("at.dedup_key").alias("dedup_key"), F.col("at.alert_us").alias("alert_us")).agg(
        F.count("*").alias("__fresh"), F.min("__first").alias("__first")
    )
    opened_fresh = F.when(F.col("__first") == F.col("__opened"), 1).otherwise(0)
    alerts = merged.join(fresh, ALERT, "left").select(
        *ALERT, "alert_id", "o.*", "last_seq", "last_seen_us", "events",
        (F.lit(1) + F.coalesce("__fresh", F.lit(0)) - opened_fresh).cast("bigint").alias("active_source_count"),
        rules.risk_level(F.col("o.event_type")).alias("risk_level"),
    )
    if grace_s is None:
        return alerts.withColumn("ended_us", F.lit(None).cast("bigint")).withColumn("lifecycle_status", F.lit("active"))
    due = alerts.withColumn("__due", F.col("last_seen_us") + micros(grace_s))
    if not sweeps:
        last = linked.agg(F.max("us")).scalar()
        ended = F.when(F.col("__due") < last, F.col("__due"))
        return due.withColumn("ended_us", ended).drop("__due").withColumn(
            "lifecycle_status", F.when(F.col("ended_us").isNull(), F.lit("active")).otherwise(F.lit("resolved")))
    due = stage(due, "alerts")
    sweeps = stage(linked.select(F.col("us").alias("sweep_us")).distinct(), "sweeps")
    swept = asof(due, sweeps, [], "__due", "sweep_us", {"sweep_us": "ended_us"}, forward=True, inclusive=False)
    status = F.when(F.col("ended_us").isNull(), F.lit("active")).otherwise(F.lit("resolved"))
    return swept.drop("__due").withColumn("lifecycle_status", status)


def resolve_stale(alerts: DataFrame, now_us: int | Column, grace_s: float = 30.0) -> DataFrame:
    """Close active alerts unseen for more than ``grace_s`` at ``now_us``."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    stale = F.coalesce(
        (F.col("lifecycle_status") == "active") & (now - F.col("last_seen_us") > micros(grace_s)), F.lit(False)
    )
    return alerts.withColumns(
        {
            "ended_us": F.when(stale, now).otherwise(F.col("ended_us")),
            "lifecycle_status": F.when(stale, F.lit("resolved")).otherwise(F.col("lifecycle_status")),
        }
    )


def contract_alerts(events: DataFrame) -> DataFrame:
    """Alerts by event kind: intrusion, long stay, crowd.

    Reads ``event_type zone_type dwell_s people held_s``; other events give none.
    """
    kind = rules.canonical_event_type(F.col("event_type"))
    zone = rules.canonical_zone_type(F.col("zone_type"))
    alert = (
        F.when((kind == "FORBIDDEN_ZONE_INTRUSION") & (zone == "restricted_area"),
               F.struct(F.lit("UNAUTHORIZED_ENTRY").alias("alert_type"), F.lit("HIGH").alias("alert_level")))
        .when((kind == "RESTRICTED_ZONE_LOITERING") & (F.col("dwell_s") >= 10),
              F.struct(F.lit("LOITERING").alias("alert_type"), F.lit("MEDIUM").alias("alert_level")))
        .when((kind == "RESTRICTED_ZONE_CROWDING") & (F.col("people") >= 3) & (F.col("held_s") >= 5),
              F.struct(F.lit("CROWDING").alias("alert_type"), F.lit("HIGH").alias("alert_level")))
    )
    return events.withColumn("__a", alert).where("__a IS NOT NULL").select("*", "__a.*").drop("__a")


def correlate(ai_events: DataFrame, sensor_events: DataFrame, within_s: float = 10.0) -> DataFrame:
    """Intrusions with a door opened at the same place within ``within_s``: critical, with the nearest such reading.

    Same location or same zone, before or after: the nearest reading each way by as-of joins, so work and result
    grow with the events and not with the pairs. Needs ``event_id location_id zone_id us`` on both sides.
    """
    reach = micros(within_s)
    ai = ai_events.where(
        rules.canonical_event_type(F.col("event_type")) == "FORBIDDEN_ZONE_INTRUSION"
    ).select("event_id", "location_id", "zone_id", F.col("us").alias("ai_us"))
    doors = sensor_events.where(F.col("event_type") == "DOOR_OPENED")
    near = ai
    found = []
    for key in ("location_id", "zone_id"):
        # The reading with the lowest id stands for those of one instant.
        at = doors.groupBy(key, F.col("us").alias("sensor_us")).agg(F.min("event_id").alias("sensor_event_id"))
        for forward in (False, True):
            name = f"__{key}_{forward}"
            near = asof(near, at.withColumn(name, F.struct("sensor_us", "sensor_event_id")), [key], "ai_us", "sensor_us", {name: name}, forward=forward, inclusive=not forward)
            found.append(F.struct(F.abs(F.col("ai_us") - F.col(name)["sensor_us"]).alias("apart_us"), F.col(name)["sensor_event_id"].alias("sensor_event_id"),
                                  F.col(name)["sensor_us"].alias("sensor_us")))
    within = F.filter(F.array(*found), lambda c: c["apart_us"] <= reach)
    return near.withColumn("__n", F.array_min(within)).where("__n IS NOT NULL").select(
        "event_id", F.col("__n.sensor_event_id").alias("sensor_event_id"), "ai_us", F.col("__n.sensor_us").alias("sensor_us"),
        F.lit("CAMERA_SENSOR_CORRELATED_RISK").alias("alert_type"), F.lit("CRITICAL").alias("alert_level"),
        F.col("__n.apart_us").alias("apart_us"))


def search_alerts(alerts: DataFrame, status=None, risk_level=None, from_us=None, to_us=None) -> DataFrame:
    out = alerts
    if status:
        out = out.where(F.col("lifecycle_status") == status)
    if risk_level:
        out = out.where(F.col("risk_level") == risk_level)
    if from_us is not None:
        out = out.where(F.col("last_seen_us") >= from_us)
    if to_us is not None:
        out = out.where(F.col("last_seen_us") <= to_us)
    return out


def handling_status(log: DataFrame) -> DataFrame:
    """Current handling state of each alert: the latest entry of its log (``alert_id status us seq``)."""
    order = F.struct("us", "seq")
    return log.groupBy("alert_id").agg(
        F.max_by("status", order).alias("status"), F.max("us").alias("changed_us"), F.count("*").alias("changes")
    )
