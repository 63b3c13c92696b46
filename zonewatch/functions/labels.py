"""Texts shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import SECOND
from .rules import lookup

# Labels, arrows and colours of the user interface.
RULE_LABELS = {
    "person_intrusion": "Xâm nhập vùng cấm",
    "vehicle_intrusion": "Xe vào vùng cấm",
    "loitering": "Lảng vảng",
    "crowd_limit": "Tụ tập đông người",
    "vehicle_stopping": "Xe dừng quá lâu",
}
ZONE_LABELS = {"restricted_area": "Vùng cấm", "controlled_area": "Vùng hạn chế"}
ZONE_COLORS = {"restricted_area": "#f0533a", "controlled_area": "#f2b134"}
OBJECT_LABELS = {
    "person": "Người",
    "vehicle": "Xe (mọi loại)",
    "car": "Ô tô",
    "motorcycle": "Xe máy",
    "bus": "Xe buýt",
    "truck": "Xe tải",
    "bicycle": "Xe đạp",
}
ARROWS = {
    "right": "→",
    "up-right": "↗",
    "up": "↑",
    "up-left": "↖",
    "left": "←",
    "down-left": "↙",
    "down": "↓",
    "down-right": "↘",
    "stationary": "•",
}
MOTION_LABELS = {
    "right": "sang phải",
    "up-right": "lên, sang phải",
    "up": "đi lên (ra xa)",
    "up-left": "lên, sang trái",
    "left": "sang trái",
    "down-left": "xuống, sang trái",
    "down": "đi xuống (lại gần)",
    "down-right": "xuống, sang phải",
    "stationary": "đứng yên",
}
LEVEL_LABELS = {"admin": "Quản trị", "operator": "Vận hành", "viewer": "Chỉ xem"}
OTHER_ZONE = ("Vùng", "#8c9aad")
SECONDS, MINUTES = " giây", " phút"
JUST_NOW, SECONDS_AGO, MINUTES_AGO, HOURS_AGO = "vừa xong", " giây trước", " phút trước", " giờ trước"
# End of fixed values.


def humanize(value: Column) -> Column:
    """``vehicle_stopping`` to ``Vehicle stopping``; only the first letter changes."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), "_"), lambda s: s != "")
    text = F.array_join(parts, " ")
    return F.concat(F.upper(F.left(text, F.lit(1))), F.right(text, F.length(text) - 1))


def rule_label(rule_type: Column) -> Column:
    return F.coalesce(lookup(RULE_LABELS, rule_type), humanize(rule_type))


def object_label(object_type: Column) -> Column:
    return F.coalesce(lookup(OBJECT_LABELS, object_type), humanize(object_type))


def zone_label(zone_type: Column) -> Column:
    return F.coalesce(
        lookup(ZONE_LABELS, zone_type), F.nullif(humanize(zone_type), F.lit("")), F.lit(OTHER_ZONE[0])
    )


def zone_color(zone_type: Column) -> Column:
    return F.coalesce(lookup(ZONE_COLORS, zone_type), F.lit(OTHER_ZONE[1]))


def motion_arrow(direction: Column) -> Column:
    return F.coalesce(lookup(ARROWS, direction), F.lit(""))


def motion_label(direction: Column) -> Column:
    return F.coalesce(lookup(MOTION_LABELS, direction), F.lit(""))


def level_label(level: Column) -> Column:
    return F.coalesce(lookup(LEVEL_LABELS, level), level)


def track_label(track: Column) -> Column:
    """``person-12`` to ``#12``; anything not ending in a number stays as it is."""
    text = F.coalesce(track, F.lit(""))
    digits = F.regexp_extract(text, r"-(\d+)$", 1)
    return F.when(digits == "", text).otherwise(F.concat(F.lit("#"), digits))


def _nearest(value: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def format_duration(seconds: Column) -> Column:
    total = F.greatest(F.lit(0).cast("bigint"), _nearest(F.coalesce(seconds.cast("double"), F.lit(0.0))))
    minutes, rest = F.floor(total / 60).cast("bigint"), total % 60
    return (
        F.when(total < 60, F.concat(total.cast("string"), F.lit(SECONDS)))
        .when(rest == 0, F.concat(minutes.cast("string"), F.lit(MINUTES)))
        .otherwise(F.concat(minutes.cast("string"), F.lit(MINUTES + " "), rest.cast("string"), F.lit(SECONDS)))
    )


def format_ago(us: Column, now_us: Column) -> Column:
    """Age of an instant in words; over a day it is the date and time, missing is a dash."""
    age = _nearest((now_us - us) / F.lit(float(SECOND)))
    words = lambda step, unit: F.concat(_nearest(age / float(step)).cast("string"), F.lit(unit))
    return (
        F.when(us.isNull(), "–")
        .when(age < 5, JUST_NOW)
        .when(age < 60, words(1, SECONDS_AGO))
        .when(age < 3600, words(60, MINUTES_AGO))
        .when(age < 86400, words(3600, HOURS_AGO))
        .otherwise(F.date_format(F.timestamp_micros(us), "dd/MM HH:mm:ss"))
    )
