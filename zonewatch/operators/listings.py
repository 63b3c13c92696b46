"""Lists as shown to users: newest first, bounded, filtered, paged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import epochs


def clamp(limit: int, top: int = 500) -> int:
    return max(1, min(int(limit), top))


def list_events(events: DataFrame, camera_id: str | None = None, limit: int = 100) -> DataFrame:
    out = events if not camera_id else events.where(F.col("camera_id") == camera_id)
    return out.orderBy(F.col("started_us").desc(), F.col("created_us").desc(), "id").limit(clamp(limit))


def list_alerts(alerts: DataFrame, camera_id: str | None = None, limit: int = 100) -> DataFrame:
    out = alerts if not camera_id else alerts.where(F.col("camera_id") == camera_id)
    return out.orderBy(F.col("last_seen_us").desc(), F.col("alert_us").desc(), "alert_id").limit(clamp(limit))


def filter_events(
    events: DataFrame, type: str | None = None, has_alert: bool | None = None, from_us: int | None = None,
    to_us: int | None = None, camera_id: str | None = None,
) -> DataFrame:
    """Events by type, presence of an alert and start; an unknown start passes the time bounds."""
    out = events
    if camera_id:
        out = out.where(F.col("camera_id") == camera_id)
    if type:
        out = out.where(F.col("event_type") == type)
    if has_alert is not None:
        out = out.where(F.col("alert_id").isNotNull() if has_alert else F.col("alert_id").isNull())
    if from_us is not None:
        out = out.where(F.col("started_us").isNull() | (F.col("started_us") >= from_us))
    if to_us is not None:
        out = out.where(F.col("started_us").isNull() | (F.col("started_us") <= to_us))
    return out


def list_cameras(cameras: DataFrame) -> DataFrame:
    return cameras.orderBy("name", "id")


def list_zones(zones: DataFrame, camera_id: str) -> DataFrame:
    return zones.where(F.col("camera_id") == camera_id).orderBy("created_us", "id")


def list_rules(rules: DataFrame, zone_id: str) -> DataFrame:
    return rules.where(F.col("zone_id") == zone_id).orderBy("rule_type")


def page(df: DataFrame, sort: str, page: int = 1, size: int = 20, tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of one page (``sort="-field"`` is descending) and the totals for the page bar."""
    size, page = clamp(size, 100), max(1, int(page))
    column = F.col(sort.lstrip("+-"))
    ordered = df.orderBy(column.desc() if sort.startswith("-") else column.asc(), tie)
    totals = df.agg(F.count("*").alias("total_items")).select(
        F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total_items",
        F.ceil(F.col("total_items") / size).cast("bigint").alias("total_pages"),
    )
    return ordered.offset((page - 1) * size).limit(size), totals


def page_after(df: DataFrame, sort: str, after: tuple | None = None, size: int = 20, tie: str = "id") -> DataFrame:
    """The rows that follow ``after``, the last row's sort value and ``tie`` of the page before (none: the first page).

    A deep page costs what the first one does: the range is a filter, and each task hands on ``size`` rows. Rows with a
    null sort value come last, in either direction, ordered by ``tie``; ``after`` holds None where the last row's value is null.
    """
    size = clamp(size, 100)
    column, down = F.col(sort.lstrip("+-")), sort.startswith("-")
    if after is not None:
        value, ident = after
        if value is None:
            df = df.where(column.isNull() & (F.col(tie) > ident))
        else:
            beyond = column < value if down else column > value
            df = df.where(beyond | ((column == value) & (F.col(tie) > ident)) | column.isNull())
    return df.orderBy(column.desc_nulls_last() if down else column.asc_nulls_last(), tie).limit(size)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Newest row per key, reduced before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: str, n: int, arrival: str | None = None) -> DataFrame:
    """The last ``n`` rows per key.

    With ``arrival`` (a column counting rows as they came) only the stretch since ``order`` last went
    back is kept. The row-number bound is also applied before the shuffle.
    """
    if arrival:
        numbered = epochs(df, keys, arrival, order, "__epoch")
        newest = numbered.groupBy(*keys).agg(F.max("__epoch").alias("__top"))
        df = numbered.join(newest, list(keys)).where("__epoch = __top").drop("__epoch", "__top")
        order = arrival
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= n).drop("__i")


def with_location(df: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rows with location and tenant of their camera; unknown cameras drop out (see ``unknown_cameras``)."""
    c = cameras.select(F.col("id").alias("camera_id"), "location_id", "tenant_id")
    return df.drop("location_id", "tenant_id").join(c, "camera_id")


def unknown_cameras(df: DataFrame, cameras: DataFrame) -> DataFrame:
    return df.join(cameras.select(F.col("id").alias("camera_id")), "camera_id", "left_anti")
