"""Keeping relational tables: upserts, patches, defaults, deletes and integrity.

Every function takes the current table and returns the next one; the caller writes it to a new path
and switches over, or merges it where the storage can.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import canonical_zone_type

POLICIES = ("keep", "replace", "coalesce")


def _last_change(changes: DataFrame, key: str, policy: dict[str, str], order: Column) -> DataFrame:
    """One row per key: first value of fixed columns, last of replaced, last known of coalesced.

    Plain aggregates, so a key with very many changes is reduced before the shuffle.
    """
    aggs = []
    for name in changes.columns:
        if name == key:
            continue
        how = policy.get(name, "replace")
        if how == "keep":
            aggs.append(F.min_by(name, order).alias(name))
        elif how == "replace":
            aggs.append(F.max_by(name, order).alias(name))
        else:
            known = F.when(F.col(name).isNotNull(), order)
            aggs.append(F.max_by(name, known).alias(name))
    return changes.groupBy(key).agg(*aggs)


def upsert(
    base: DataFrame, changes: DataFrame, key: str, policy: dict[str, str], order: Sequence[str],
    match: Column | None = None,
) -> DataFrame:
    """``base`` after ``changes``: unknown keys inserted, known ones changed column by column.

    ``keep`` leaves the old value, ``replace`` takes the new one, ``coalesce`` takes it unless null;
    columns not named are replaced. ``match`` (over base columns) limits which rows may change.
    """
    bad = set(policy.values()) - set(POLICIES)
    if bad:
        raise ValueError(f"unknown policy {sorted(bad)}")
    rank = F.struct(*[F.col(o) for o in order])
    last = _last_change(changes, key, policy, rank)
    incoming = [c for c in last.columns if c != key and c in base.columns]
    n = last.select(F.col(key), F.struct(*incoming).alias("__n"))
    b = base.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("__b"),
                    (match if match is not None else F.lit(True)).alias("__match"))
    both = b.join(n, key, "full_outer")
    may = F.coalesce(F.col("__match"), F.lit(False))
    has_new, has_old = F.col("__n").isNotNull(), F.col("__b").isNotNull()
    out = []
    for name in base.columns:
        if name == key:
            out.append(F.col(key))
            continue
        old = F.col("__b")[name]
        if name not in incoming:
            out.append(old.alias(name))
            continue
        new = F.col("__n")[name]
        changed = {"keep": old, "replace": new, "coalesce": F.coalesce(new, old)}[policy.get(name, "replace")]
        out.append(F.when(~has_old, new).when(has_new & may, changed).otherwise(old).alias(name))
    return both.select(*out)


AI_EVENT_POLICY = {
    "alert_id": "coalesce",
    **{
        c: "keep"
        for c in ("id", "tenant_id", "camera_id", "zone_id", "rule_config_id", "event_type", "object_type",
                  "track_id", "first_seq", "started_us", "created_us")
    },
}


def upsert_ai_events(base: DataFrame, changes: DataFrame, order: Sequence[str] = ("us", "last_seq")) -> DataFrame:
    """Events by ``source_event_id``: what began them stays, what goes on is replaced, an alert once
    linked is never lost to a message without one."""
    return upsert(base, changes, "source_event_id", AI_EVENT_POLICY, order)


MIRROR = "backend:"


def mirror_alerts(base: DataFrame, incoming: DataFrame, order: Sequence[str] = ("us",)) -> DataFrame:
    """Alerts kept elsewhere: inserted under a ``backend:`` key, or such rows refreshed and reopened.

    Rows with any other key belong to this system and stay as they are.
    """
    new = incoming.withColumns(
        {
            "dedup_key": F.concat(F.lit(MIRROR), F.col("id")),
            "risk_level": F.lit("backend"),
            "lifecycle_status": F.lit("active"),
            "active_source_count": F.lit(1).cast("bigint"),
            "ended_us": F.lit(None).cast("bigint"),
            "last_seen_us": F.col("us"),
        }
    )
    touched = {"last_seq", "last_seen_us", "lifecycle_status", "ended_us"}
    policy = {c: "keep" for c in base.columns if c not in touched}
    return upsert(base, new, "id", policy, order, match=F.col("dedup_key").startswith(MIRROR))


def patch(base: DataFrame, changes: DataFrame, key: str, ignore_null: bool) -> DataFrame:
    """Partial update by key.

    ``ignore_null=True``: a null leaves the old value. Otherwise ``changes`` has an array ``fields``
    naming the columns to set, so a null can be set on purpose.
    """
    cols = [c for c in changes.columns if c not in (key, "fields")]
    n = changes.select(F.col(key), F.struct(*cols).alias("__n"), *([] if ignore_null else [F.col("fields").alias("__f")]))
    joined = base.join(n, key, "left")
    out = []
    for name in base.columns:
        if name not in cols:
            out.append(F.col(name))
            continue
        new = F.col("__n")[name]
        take = new.isNotNull() if ignore_null else F.coalesce(F.array_contains("__f", name), F.lit(False))
        out.append(F.when(take, new).otherwise(F.col(name)).alias(name))
    return joined.select(*out)


def touch(df: DataFrame, changed: Column, now: Column, column: str = "updated_us") -> DataFrame:
    return df.withColumn(column, F.when(changed, now).otherwise(F.col(column)))


def backfill_tenant(locations: DataFrame, cameras: DataFrame, zones: DataFrame, rules: DataFrame):
    """Fill missing tenants downwards: location to camera to zone to rule."""

    def fill(child: DataFrame, parent: DataFrame, link: str) -> DataFrame:
        p = parent.select(F.col("id").alias(link), F.col("tenant_id").alias("__t"))
        return child.join(p, link, "left").withColumn("tenant_id", F.coalesce("tenant_id", "__t")).drop("__t")

    cameras = fill(cameras, locations, "location_id")
    zones = fill(zones, cameras, "camera_id")
    return cameras, zones, fill(rules, zones, "zone_id")


# Child table, its column, parent table, what a delete of the parent does.
LINKS = (
    ("tenant_member", "tenant_id", "tenant", "cascade"),
    ("tenant_member", "user_id", "app_user", "cascade"),
    ("location", "tenant_id", "tenant", "cascade"),
    ("user_location_access", "tenant_member_id", "tenant_member", "cascade"),
    ("user_location_access", "location_id", "location", "cascade"),
    ("camera", "location_id", "location", "cascade"),
    ("camera_reference_frame", "camera_id", "camera", "cascade"),
    ("zone", "camera_id", "camera", "cascade"),
    ("rule_config", "zone_id", "zone", "cascade"),
    ("ai_event", "camera_id", "camera", "cascade"),
    ("ai_event", "zone_id", "zone", "null"),
    ("ai_event", "rule_config_id", "rule_config", "null"),
    ("ai_event", "alert_id", "alert", "null"),
    ("alert", "camera_id", "camera", "cascade"),
    ("alert", "zone_id", "zone", "null"),
    ("alert", "rule_config_id", "rule_config", "null"),
    ("evidence", "alert_id", "alert", "cascade"),
    ("evidence", "ai_event_id", "ai_event", "cascade"),
    ("evidence", "camera_id", "camera", "cascade"),
)
ORDER = (
    "tenant", "app_user", "tenant_member", "location", "user_location_access", "camera", "camera_reference_frame",
    "zone", "rule_config", "alert", "ai_event", "evidence",
)
# End of fixed values.


def delete_cascade(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting the rows of ``table`` with the ids in ``keys``."""
    gone = {table: keys.select("id").distinct()}
    out = dict(tables)
    for name in [t for t in ORDER if t in tables]:
        df = out[name]
        lost = [gone[name]] if name in gone else []
        for child, column, parent, action in LINKS:
            if child == name and parent in gone and action == "cascade":
                dead = gone[parent].select(F.col("id").alias(column))
                lost.append(df.join(dead, column, "left_semi").select("id"))
        if lost:
            gone[name] = reduce(DataFrame.unionByName, lost).distinct()
            df = df.join(gone[name], "id", "left_anti")
        for child, column, parent, action in LINKS:
            if child == name and parent in gone and action == "null":
                dead = gone[parent].select(F.col("id").alias(column), F.lit(True).alias("__dead"))
                df = df.join(dead, column, "left").withColumn(
                    column, F.when(F.col("__dead").isNull(), F.col(column))
                ).drop("__dead")
        out[name] = df.select(*tables[name].columns)
    return out


# Uniqueness, same-tenant links, ranges and value lists of the schema.
UNIQUE = {
    "tenant": [("code",)],
    "app_user": [("email",)],
    "tenant_member": [("tenant_id", "user_id")],
    "location": [("tenant_id", "code")],
    "user_location_access": [("tenant_member_id", "location_id")],
    "camera": [("location_id", "name"), ("tenant_id", "source_url")],
    "zone": [("camera_id", "name")],
    "rule_config": [("zone_id", "rule_type")],
    "ai_event": [("source_event_id",)],
}
SAME_TENANT = (
    ("camera", "location_id", "location"),
    ("zone", "camera_id", "camera"),
    ("rule_config", "zone_id", "zone"),
    ("user_location_access", "tenant_member_id", "tenant_member"),
    ("user_location_access", "location_id", "location"),
)
RANGES = {
    "zone": ["frame_width > 0", "frame_height > 0"],
    "camera_reference_frame": ["frame_width > 0", "frame_height > 0"],
    "rule_config": [
        "duration_threshold >= 0", "people_threshold >= 0", "confidence_threshold BETWEEN 0 AND 1"
    ],
    "ai_event": ["confidence BETWEEN 0 AND 1"],
}
VALUES = {
    ("tenant", "status"): ("active", "disabled"),
    ("app_user", "status"): ("active", "disabled"),
    ("tenant_member", "role"): ("owner", "admin", "operator", "viewer"),
    ("tenant_member", "status"): ("active", "disabled"),
    ("user_location_access", "permission_level"): ("admin", "operator", "viewer"),
    ("location", "status"): ("active", "disabled"),
    ("camera", "status"): ("active", "inactive", "offline", "disabled"),
}
# End of fixed values.


def check_integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Everything the schema would refuse: ``table check key``; a null never breaks a range or link."""
    found = []

    def note(df: DataFrame, table: str, check: str, key: Column) -> None:
        found.append(df.select(F.lit(table).alias("table"), F.lit(check).alias("check"), key.cast("string").alias("key")))

    for table, sets in UNIQUE.items():
        for cols in sets if table in tables else []:
            if set(cols) <= set(tables[table].columns):
                twice = tables[table].dropna(subset=list(cols)).groupBy(*cols).count().where("count > 1")
                note(twice, table, "unique " + ",".join(cols), F.concat_ws("|", *cols))
    for child, column, parent, _ in LINKS:
        if child in tables and parent in tables and column in tables[child].columns:
            ids = tables[parent].select(F.col("id").alias(column))
            lost = tables[child].where(F.col(column).isNotNull()).join(ids, column, "left_anti")
            note(lost, child, f"link {column}", F.col("id"))
    for child, column, parent in SAME_TENANT:
        if child in tables and parent in tables:
            p = tables[parent].select(F.col("id").alias(column), F.col("tenant_id").alias("__t"))
            mixed = tables[child].join(p, column).where(F.col("tenant_id") != F.col("__t"))
            note(mixed, child, f"tenant {column}", F.col("id"))
    for table, rules in RANGES.items():
        for rule in rules if table in tables else []:
            if rule.split(" ")[0] in tables[table].columns:
                note(tables[table].where(f"NOT ({rule})"), table, f"range {rule.split(' ')[0]}", F.col("id"))
    for (table, column), allowed in VALUES.items():
        if table in tables and column in tables[table].columns:
            note(tables[table].where(~F.col(column).isin(*allowed)), table, f"value {column}", F.col("id"))
    return reduce(DataFrame.unionByName, found)


# The rules a new zone starts with.
DEFAULT_RULES = (
    ("restricted_area", "person_intrusion", "person", 15, None, 0.6, True, "23:00", "06:00"),
    ("restricted_area", "vehicle_intrusion", "vehicle", 15, None, 0.6, True, "23:00", "06:00"),
    ("controlled_area", "crowd_limit", "person", 15, 5, 0.6, False, None, None),
    ("controlled_area", "loitering", "person", 15, None, 0.6, False, None, None),
    ("controlled_area", "vehicle_stopping", "vehicle", 15, None, 0.6, False, None, None),
)
# End of fixed values.
DEFAULT_RULE_TYPE = (
    "array<struct<for_type:string,rule_type:string,object_type:string,duration_threshold:int,people_threshold:int,"
    "confidence_threshold:double,use_active_time:boolean,active_start_time:string,active_end_time:string>>"
)


def default_rules(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules to insert for zones that have none, by zone type."""
    bare = zones.select(F.col("id").alias("zone_id"), "tenant_id", "zone_type").join(
        rules.select("zone_id"), "zone_id", "left_anti"
    )
    entry = lambda r: F.struct(*[F.lit(v) for v in r])
    templates = F.array(*[entry(r) for r in DEFAULT_RULES]).cast(DEFAULT_RULE_TYPE)
    kind = canonical_zone_type(F.col("zone_type"))
    mine = F.filter(templates, lambda t: t["for_type"] == F.col("__kind"))
    return bare.withColumn("__kind", kind).select("zone_id", "tenant_id", F.explode(mine).alias("t")).select(
        F.concat("zone_id", F.lit(":"), "t.rule_type").alias("id"), "tenant_id", "zone_id", "t.rule_type",
        F.lit(True).alias("enabled"), "t.object_type", "t.duration_threshold", "t.people_threshold",
        "t.confidence_threshold", "t.use_active_time", "t.active_start_time", "t.active_end_time",
    )


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` in the given schema: missing columns added with their default, the rest cast."""
    defaults = defaults or {}
    out = []
    for f in schema.fields:
        fallback = F.lit(defaults.get(f.name)).cast(f.dataType)
        if f.name not in df.columns:
            out.append(fallback.alias(f.name))
        elif f.name in defaults:
            out.append(F.coalesce(F.col(f.name).cast(f.dataType), fallback).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a partner: silent cameras, zones without rules, events without alert."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def union_distinct(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.unionByName(b).dropDuplicates(list(keys))
