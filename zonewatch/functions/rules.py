"""Rule vocabulary: object groups, event names, levels, directions, sensor values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the event contract.
VEHICLES = ("car", "motorcycle", "bus", "truck")
CROWD_RULE = "crowd_limit"
EVENT_OF_RULE = {
    "person_intrusion": "FORBIDDEN_ZONE_INTRUSION",
    "vehicle_intrusion": "FORBIDDEN_ZONE_INTRUSION",
    "loitering": "RESTRICTED_ZONE_LOITERING",
    "crowd_limit": "RESTRICTED_ZONE_CROWDING",
    "vehicle_stopping": "RESTRICTED_ZONE_VEHICLE_STOPPING",
}
RISK_OF_RULE = {"person_intrusion": "high", "vehicle_intrusion": "high", "crowd_limit": "medium"}
DIRECTIONS = ("right", "up-right", "up", "up-left", "left", "down-left", "down", "down-right")
STATIONARY = "stationary"
UNKNOWN = "unknown"
CLASS_IDS = {"person": 0, "bicycle": 1, "car": 2, "motorcycle": 3, "bus": 5, "truck": 7}
ZONE_TYPE_ALIASES = {"FORBIDDEN": "restricted_area", "RESTRICTED": "controlled_area"}
EVENT_TYPE_ALIASES = {"RESTRICTED_ZONE_LONG_DWELL": "RESTRICTED_ZONE_LOITERING"}
ACCESS_LEVELS = {"viewer": 1, "operator": 2, "admin": 3}
SENSOR_ON = ("TRUE", "1", "OPEN", "OPENED", "ON", "ACTIVE", "DETECTED", "YES")
SENSOR_OFF = ("FALSE", "0", "CLOSED", "CLOSE", "OFF", "INACTIVE", "CLEAR", "NO")
# End of fixed values.


def lookup(table: dict, key: Column) -> Column:
    """Literal map; a missing key gives null."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def matches_object(wanted: Column, class_name: Column) -> Column:
    """No wanted object means any; ``vehicle`` is a group; letter case is ignored."""
    want = F.lower(F.coalesce(wanted, F.lit("")))
    have = F.lower(F.coalesce(class_name, F.lit("")))
    return (
        F.when(want == "", F.lit(True))
        .when(want == "vehicle", have.isin(*VEHICLES))
        .otherwise(have == want)
    )


def contract_event_type(rule_type: Column) -> Column:
    return F.coalesce(lookup(EVENT_OF_RULE, rule_type), F.upper(rule_type))


def canonical_event_type(event_type: Column) -> Column:
    return F.coalesce(lookup(EVENT_TYPE_ALIASES, event_type), event_type)


def canonical_zone_type(zone_type: Column) -> Column:
    return F.coalesce(lookup(ZONE_TYPE_ALIASES, zone_type), zone_type)


def risk_level(rule_type: Column) -> Column:
    return F.coalesce(lookup(RISK_OF_RULE, rule_type), F.lit("low"))


def level_rank(level: Column) -> Column:
    return F.coalesce(lookup(ACCESS_LEVELS, level), F.lit(0))


def direction_from_angle(degrees: Column) -> Column:
    """Eight sectors of 45 degrees centred on the axes; 0 is right, 90 is up."""
    turned = F.pmod(degrees.cast("double"), F.lit(360.0)) + F.lit(22.5)
    sector = F.floor(turned / F.lit(45.0)).cast("int") % 8
    return F.get(F.array(*[F.lit(d) for d in DIRECTIONS]), sector)


def parse_class_filter(text: Column) -> Column:
    """``"person, 2"`` to distinct class ids in order, with unknown names set apart.

    Returns a struct ``class_ids`` and ``unknown``; rows with unknown names, or with no id at all,
    are for the caller to reject.
    """
    items = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.lower(F.trim(s))),
        lambda s: s != "",
    )
    as_id = lambda s: F.when(s.rlike(r"^\d+$"), s.try_cast("int")).otherwise(lookup(CLASS_IDS, s))
    ids = F.array_distinct(F.filter(F.transform(items, as_id), lambda i: i.isNotNull()))
    unknown = F.filter(items, lambda s: as_id(s).isNull())
    return F.struct(ids.alias("class_ids"), unknown.alias("unknown"))


def sensor_value_to_bool(value: Column) -> Column:
    """Positive, negative or (unreadable) null."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text.isin(*SENSOR_ON), F.lit(True)).when(text.isin(*SENSOR_OFF), F.lit(False))


def sensor_event_type(sensor_type: Column, value: Column, temperature_limit: float = 50.0, gas_limit: float = 300.0) -> Column:
    """Event a reading stands for, null when it stands for none.

    A gas reading may be a switch or a measured amount; a temperature is always measured.
    """
    kind = F.upper(sensor_type)
    on = sensor_value_to_bool(value)
    amount = value.cast("string").try_cast("double")
    return (
        F.when((kind == "DOOR") & on, "DOOR_OPENED")
        .when((kind == "DOOR") & ~on, "DOOR_CLOSED")
        .when(kind.isin("PIR_MOTION", "BEAM") & on, "MOTION_DETECTED")
        .when((kind == "SMOKE") & on, "SMOKE_DETECTED")
        .when((kind == "GAS") & (F.coalesce(amount > gas_limit, F.lit(False)) | F.coalesce(on, F.lit(False))), "GAS_THRESHOLD_EXCEEDED")
        .when((kind == "TEMPERATURE") & (amount > temperature_limit), "TEMPERATURE_THRESHOLD_EXCEEDED")
    )
