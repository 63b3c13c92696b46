"""Risk of a location from the number of independent sources active there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import MINUTE, local_minutes, micros
from ..session import stage
from .sensors import reading_order
from .timeline import previous, running_sum, sessions

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def ai_intervals(events: DataFrame, within_s: float = 3.0, min_confidence: float = 0.6) -> DataFrame:
    """Spans in which the AI source of a location is active: ``within_s`` after each sure event."""
    sure = events.where(F.col("confidence") >= min_confidence).select("location_id", "us").distinct()
    runs = sessions(sure, ["location_id"], "us", micros(within_s), out="from_us")
    return runs.groupBy("location_id", "from_us").agg((F.max("us") + micros(within_s)).alias("to_us")).select(
        "location_id", F.lit("AI").alias("source"), "from_us", "to_us"
    )


def sensor_intervals(active_readings: DataFrame, hold_s: float = 300.0) -> DataFrame:
    """Spans in which a sensor is active: from an active reading to the sensor's next reading.

    A sensor that falls silent stays active for ``hold_s`` at most.
    """
    ahead = previous(active_readings, ["sensor_id"], "us", {"us": "__next"}, descending=True, tie=reading_order(active_readings))
    until = F.least(F.coalesce("__next", F.col("us") + micros(hold_s)), F.col("us") + micros(hold_s))
    return ahead.where("is_active").select(
        "location_id", F.col("sensor_type").alias("source"), F.col("us").alias("from_us"), until.alias("to_us")
    )


def _level(n: Column) -> Column:
    return F.when(n <= 0, LEVELS[0]).when(n == 1, LEVELS[1]).when(n == 2, LEVELS[2]).otherwise(LEVELS[3])


def risk_levels(intervals: DataFrame, working_from: int = 0, working_to: int = 1440) -> DataFrame:
    """Steps of the risk level per location: ``location_id from_us to_us n_sources level``.

    ``intervals`` (``location_id source from_us to_us``, end excluded) may overlap; sources of one kind
    count once. Two or more sources outside working hours (UTC minutes of the day, end excluded) are
    critical, so a span with that many is cut where the hours begin and end; cuts that don't change the
    level are left out. A span without an end is cut up to the last step of any location. The steps
    between, far fewer than the readings, are staged.
    """
    steps = intervals.where("to_us > from_us").select(
        "location_id", "source",
        F.explode(
            F.array(
                F.struct(F.col("from_us").alias("us"), F.lit(1).alias("d")),
                F.struct(F.col("to_us").alias("us"), F.lit(-1).alias("d")),
            )
        ).alias("s"),
    )
    per_source = steps.groupBy("location_id", "source", F.col("s.us").alias("us")).agg(F.sum("s.d").alias("d"))
    per_source = running_sum(stage(per_source.where("d <> 0"), "source-steps"), ["location_id", "source"], "us", F.col("d"), "open")
    per_source = stage(per_source, "open-sources")
    turned = (F.col("open") > 0).cast("int") - ((F.col("open") - F.col("d")) > 0).cast("int")
    changes = (
        per_source.withColumn("turn", turned).where("turn <> 0")
        .groupBy("location_id", "us").agg(F.sum("turn").alias("turn")).where("turn <> 0")
    )
    counted = stage(running_sum(changes, ["location_id"], "us", F.col("turn"), "n_sources"), "counted").drop("turn")
    spans = previous(counted, ["location_id"], "us", {"us": "to_us"}, descending=True)
    spans = _cut_at_hours(spans, counted, working_from, working_to)
    minute = local_minutes(F.col("us"), 0.0)
    off = ~((minute >= working_from) & (minute < working_to))
    level = F.when(off & (F.col("n_sources") >= 2), LEVELS[3]).otherwise(_level(F.col("n_sources")))
    return spans.select("location_id", F.col("us").alias("from_us"), "to_us", "n_sources", level.alias("level"))


def _cut_at_hours(spans: DataFrame, counted: DataFrame, working_from: int, working_to: int) -> DataFrame:
    """Spans with exactly two sources, the only ones whose level the hours decide, cut where working hours begin and end."""
    borders = [b for b in {working_from % 1440, working_to % 1440} if (working_to - working_from) % 1440]
    if not borders:
        return spans
    day = 1440 * MINUTE
    end = counted.agg(F.max("us")).scalar()
    spans = spans.withColumn("__end", end)
    until = F.coalesce("to_us", F.col("__end") + 1)
    days = F.sequence(F.expr(f"us div {day}L"), F.expr(f"greatest(us, coalesce(to_us, __end + 1) - 1) div {day}L"))
    at = F.flatten(F.transform(days, lambda d: F.array(*[d * day + b * MINUTE for b in borders])))
    inside = F.when(F.col("n_sources") == 2, F.filter(at, lambda t: (t > F.col("us")) & (t < until))).otherwise(F.array().cast("array<bigint>"))
    steps = F.array_sort(F.array_union(F.array("us"), inside))
    cut = spans.withColumn("__steps", steps).withColumn("__i", F.explode(F.sequence(F.lit(0), F.size("__steps") - 1)))
    return cut.select(
        "location_id", F.get("__steps", F.col("__i")).alias("us"), F.coalesce(F.get("__steps", F.col("__i") + 1), "to_us").alias("to_us"), "n_sources")


def with_risk_alert(levels: DataFrame, grace_s: float = 30.0) -> DataFrame:
    """Positive steps with the start ``alert_from_us`` of the alert they belong to.

    An alert stays open while the next positive step begins within ``grace_s`` of the last one's end.
    """
    far = F.lit(2**62)
    positive = levels.where("n_sources > 0").withColumn("__end", F.coalesce("to_us", far))
    runs = stage(sessions(positive, ["location_id"], "__end", micros(grace_s), mark="from_us", out="__run"), "runs")
    starts = runs.groupBy("location_id", "__run").agg(F.min("from_us").alias("alert_from_us"))
    return runs.join(starts, ["location_id", "__run"]).drop("__run", "__end")


def risk_alerts(levels: DataFrame, grace_s: float = 30.0) -> DataFrame:
    """One alert per location and incident: span, first, last and highest level, level changes."""
    steps = with_risk_alert(levels, grace_s)
    ranked = steps.withColumn("__rank", F.array_position(F.array(*[F.lit(l) for l in LEVELS]), F.col("level")))
    open_end = F.max(F.col("to_us").isNull())
    return ranked.groupBy("location_id", "alert_from_us").agg(
        F.min_by("level", F.col("from_us")).alias("first_level"),
        F.max_by("level", F.col("from_us")).alias("last_level"),
        F.max_by("level", F.col("__rank")).alias("highest_level"),
        F.when(~open_end, F.max("to_us") + micros(grace_s)).alias("closed_us"),
    )


def risk_alert_changes(levels: DataFrame, grace_s: float = 30.0) -> DataFrame:
    """What a dashboard is told: ``CREATED``, ``LEVEL_CHANGED`` and ``CLOSED`` of each alert."""
    steps = with_risk_alert(levels, grace_s)
    stepped = previous(
        steps, ["location_id"], "from_us", {"level": "__before", "alert_from_us": "__alert"}
    )
    opened = F.col("__alert").isNull() | (F.col("__alert") != F.col("alert_from_us"))
    changed = F.when(opened, F.lit("CREATED")).when(F.col("level") != F.col("__before"), F.lit("LEVEL_CHANGED"))
    told = stepped.withColumn("change", changed).where("change IS NOT NULL").select(
        "location_id", "alert_from_us", F.col("from_us").alias("at_us"), "change", "level"
    )
    closed = risk_alerts(levels, grace_s).where("closed_us IS NOT NULL").select(
        "location_id", "alert_from_us", F.col("closed_us").alias("at_us"), F.lit("CLOSED").alias("change"),
        F.col("last_level").alias("level"),
    )
    return told.unionByName(closed)
