"""Sensor readings, message envelopes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import clock, rules

DEVICE_TOPIC = r"devices/([^/]+)/(?:readings|status)$"


def device_of_topic(topic: Column) -> Column:
    """Device id in ``.../devices/{id}/readings`` or ``.../status``, null elsewhere."""
    return F.nullif(F.regexp_extract(topic, DEVICE_TOPIC, 1), F.lit(""))


def type_readings(raw: DataFrame, topic: str | None = None) -> DataFrame:
    """Readings with ``us`` and ``positive``; the device comes from the message, else from the topic."""
    device = F.col("device_id") if topic is None else F.coalesce("device_id", device_of_topic(F.col(topic)))
    return raw.select(
        "reading_id", device.alias("device_id"), F.coalesce("sensor_id", device).alias("sensor_id"), "sensor_type",
        "location_id", "zone_id", "value", "unit", "status",
        clock.instant_micros(F.coalesce("timestamp", "recordedAt")).alias("us"),
        rules.sensor_value_to_bool(F.col("value")).alias("positive"),
    )


def read_sensor_readings(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return type_readings(reader.schema(schemas.SENSOR_READING).json(path))


def parse_sensor_messages(messages: DataFrame, topic: str = "topic", value: str = "value") -> DataFrame:
    """Readings from a queue source with ``topic`` and ``value`` columns."""
    parsed = messages.select(
        F.col(topic).alias("__topic"),
        F.from_json(F.col(value).cast("string"), schemas.SENSOR_READING).alias("m"),
    ).select("__topic", "m.*")
    return type_readings(parsed, "__topic")


def wrap_envelope(
    df: DataFrame, message_type: str, producer: str, message_id: str, us: str, correlation_id: str | None = None,
    version: str = "1.0",
) -> DataFrame:
    """Each row as one JSON message (``value``) with its data inside."""
    data = F.struct(*[F.col(c) for c in df.columns])
    correlation = F.col(correlation_id).cast("string") if correlation_id else F.lit(None).cast("string")
    envelope = F.struct(
        F.col(message_id).cast("string").alias("message_id"),
        F.lit(message_type).alias("message_type"),
        F.lit(version).alias("schema_version"),
        correlation.alias("correlation_id"),
        clock.iso_millis_us(F.col(us)).alias("timestamp"),
        F.lit(producer).alias("producer"),
        F.to_json(data).alias("data"),
    )
    return df.select(F.to_json(envelope).alias("value"))


def unwrap_envelope(messages: DataFrame, message_type: str, data_schema: str, version: str = "1", value: str = "value") -> DataFrame:
    """Data of messages of one type and major version; others are for another reader."""
    m = messages.select(F.from_json(F.col(value).cast("string"), schemas.ENVELOPE).alias("m")).select("m.*")
    mine = (F.col("message_type") == message_type) & (
        F.substring_index("schema_version", ".", 1) == version.split(".")[0]
    )
    return m.where(mine).select(
        "message_id", "correlation_id", "producer", clock.instant_micros(F.col("timestamp")).alias("sent_us"),
        F.from_json("data", data_schema).alias("d"),
    ).select("message_id", "correlation_id", "producer", "sent_us", "d.*")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GROUND_TRUTH).option("header", True).csv(path)
