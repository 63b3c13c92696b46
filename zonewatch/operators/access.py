"""Who may see which location, and rows cut down to that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import level_rank

TENANT_WIDE = ("owner", "admin")


def active_member(users: DataFrame, members: DataFrame, tenants: DataFrame, claims: DataFrame) -> DataFrame:
    """Active memberships asked for by ``claims`` (``subject``, ``tenant``).

    A subject is a user id or e-mail, a tenant an id or code. Each either-or is two joins on one key,
    then distinct, because a join on "this or that" cannot be hashed.
    """
    u = users.where("status = 'active'").select(F.col("id").alias("user_id"), "email", "full_name")
    t = tenants.select(F.col("id").alias("t_id"), "code")
    m = members.where("status = 'active'").select(
        F.col("id").alias("member_id"), "user_id", F.col("tenant_id"), "role"
    )
    by_subject = claims.join(u, F.col("subject") == F.col("user_id")).unionByName(
        claims.join(u, F.col("subject") == F.col("email"))
    ).distinct()
    both = by_subject.join(t, F.col("tenant") == F.col("t_id")).unionByName(
        by_subject.join(t, F.col("tenant") == F.col("code"))
    ).distinct()
    found = both.join(m, "user_id").where(F.col("tenant_id") == F.col("t_id"))
    return found.select("subject", "tenant", "member_id", "user_id", "tenant_id", "role", "email", "full_name")


GRANT = ["member_id", "user_id", "tenant_id", "role", "location_id", "level"]


def grants(members: DataFrame, locations: DataFrame, assignments: DataFrame) -> DataFrame:
    """What each member was given: one row without a location for owners and admins, who see all of their tenant, else
    one for each assigned location of the tenant.

    The rows grow with members and assignments, not with members times locations. All functions below take them as
    ``access``; ``effective_access`` writes them out.
    """
    wide = members.where(F.col("role").isin(*TENANT_WIDE)).withColumns(
        {"location_id": F.lit(None).cast(locations.schema["id"].dataType), "level": F.lit("admin")}
    )
    places = locations.select(F.col("id").alias("location_id"), F.col("tenant_id").alias("l_tenant"))
    given = assignments.select(F.col("tenant_member_id").alias("a_member"), "location_id", F.col("permission_level").alias("level"))
    narrow = members.where(~F.col("role").isin(*TENANT_WIDE)).join(
        given, F.col("member_id") == F.col("a_member")
    ).join(places, "location_id").where(F.col("tenant_id") == F.col("l_tenant"))
    return wide.select(*GRANT).unionByName(narrow.select(*GRANT))


def expand(access: DataFrame, locations: DataFrame) -> DataFrame:
    """Grants with a row for every location of the tenant in place of a tenant-wide one."""
    places = locations.select(F.col("id").alias("location_id"), "tenant_id")
    wide = access.where("location_id IS NULL").drop("location_id").join(places, "tenant_id")
    return access.where("location_id IS NOT NULL").unionByName(wide.select(*access.columns))


def effective_access(members: DataFrame, locations: DataFrame, assignments: DataFrame) -> DataFrame:
    """Level of each member at each location: admin everywhere for owners and admins, else as assigned."""
    return expand(grants(members, locations, assignments), locations)


def _places_of(cameras: DataFrame, locations: DataFrame | None) -> DataFrame:
    """``camera_id location_id c_tenant`` of cameras, and whether their location is one ``of_tenant``.

    That decides for tenant-wide grants. Where ``locations`` isn't given, any location counts as the camera's tenant's.
    """
    c = cameras.select(F.col("id").alias("camera_id"), "location_id", F.col("tenant_id").alias("c_tenant"))
    if locations is None:
        return c.withColumn("of_tenant", F.col("location_id").isNotNull())
    own = locations.select(F.col("id").alias("location_id"), F.col("tenant_id").alias("c_tenant"), F.lit(True).alias("of_tenant"))
    return c.join(own.distinct(), ["location_id", "c_tenant"], "left").withColumn("of_tenant", F.coalesce("of_tenant", F.lit(False)))


def _able(access: DataFrame, min_level: str) -> DataFrame:
    from ..functions.rules import ACCESS_LEVELS

    return access.where(level_rank(F.col("level")) >= ACCESS_LEVELS[min_level]).withColumnRenamed("tenant_id", "c_tenant")


def allowed_cameras(
    access: DataFrame, cameras: DataFrame, min_level: str = "viewer", locations: DataFrame | None = None
) -> DataFrame:
    """``member_id camera_id level`` for cameras of the same tenant in locations at ``min_level`` or above."""
    able, c = _able(access, min_level).select("member_id", "c_tenant", "location_id", "level"), _places_of(cameras, locations)
    placed = able.where("location_id IS NOT NULL").join(c, ["c_tenant", "location_id"])
    wide = able.where("location_id IS NULL").drop("location_id").join(c.where("of_tenant"), "c_tenant")
    cols = ["member_id", "camera_id", "location_id", "level"]
    return placed.select(*cols).unionByName(wide.select(*cols))


def scope(
    df: DataFrame, access: DataFrame | None, cameras: DataFrame, min_level: str = "viewer", locations: DataFrame | None = None
) -> DataFrame:
    """Rows of cameras one member may see; ``access=None`` is unrestricted, an empty one gives nothing.

    A tenant-wide grant is met by the camera's tenant alone.
    """
    if access is None:
        return df
    able, c = _able(access, min_level).select("c_tenant", "location_id"), _places_of(cameras, locations)
    placed = c.join(able.where("location_id IS NOT NULL"), ["c_tenant", "location_id"], "left_semi")
    wide = c.where("of_tenant").join(able.where("location_id IS NULL").select("c_tenant"), "c_tenant", "left_semi")
    return df.join(placed.select("camera_id").unionByName(wide.select("camera_id")), "camera_id", "left_semi")


VIA = {"zone", "ai_event", "evidence", "alert", "camera_reference_frame"}


def scope_via(
    df: DataFrame, kind: str, access: DataFrame | None, cameras: DataFrame, zones: DataFrame | None = None,
    min_level: str = "viewer", locations: DataFrame | None = None,
) -> DataFrame:
    """``scope`` for any table that leads to a camera; rules go through their zone."""
    if kind == "rule_config":
        if access is None:
            return df
        seen = scope(zones, access, cameras, min_level, locations).select(F.col("id").alias("zone_id"))
        return df.join(seen, "zone_id", "left_semi")
    if kind == "camera":
        return scope(df.withColumn("camera_id", F.col("id")), access, cameras, min_level, locations).drop("camera_id")
    if kind not in VIA:
        raise ValueError(kind)
    return scope(df, access, cameras, min_level, locations)


def access_decisions(
    requests: DataFrame, access: DataFrame, cameras: DataFrame, locations: DataFrame | None = None
) -> DataFrame:
    """Each request (``member_id tenant_id camera_id min_level``) with 200, 403 or 404.

    Unknown, of another tenant or not visible is 404; visible below the level asked for is 403.
    """
    placed = access.where("location_id IS NOT NULL").select("member_id", "location_id", F.col("level").alias("placed_level"))
    wide = access.where("location_id IS NULL").select("member_id", F.col("level").alias("wide_level")).distinct()
    joined = requests.join(_places_of(cameras, locations), "camera_id", "left").join(
        placed, ["member_id", "location_id"], "left"
    ).join(wide, "member_id", "left")
    level = F.coalesce("placed_level", F.when(F.col("of_tenant"), F.col("wide_level")))
    visible = (F.col("c_tenant") == F.col("tenant_id")) & level.isNotNull()
    enough: Column = level_rank(level) >= level_rank(F.col("min_level"))
    status = F.when(~F.coalesce(visible, F.lit(False)), 404).when(~enough, 403).otherwise(200)
    return joined.select(*requests.columns, status.alias("status"))


def my_locations(access: DataFrame, locations: DataFrame) -> DataFrame:
    """A member's locations with name, code and level, by name."""
    l = locations.select(F.col("id").alias("location_id"), "name", "code")
    return expand(access, locations).join(l, "location_id").select("member_id", "location_id", "name", "code", "level").orderBy(
        "member_id", "name", "location_id"
    )


def camera_visibility(
    users: DataFrame, members: DataFrame, assignments: DataFrame, locations: DataFrame, cameras: DataFrame
) -> DataFrame:
    """Assigned users with the cameras of their locations."""
    u = users.select(F.col("id").alias("user_id"), "email")
    m = members.select(F.col("id").alias("member_id"), "user_id", "role")
    a = assignments.select(F.col("tenant_member_id").alias("member_id"), "location_id", "permission_level")
    l = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"))
    c = cameras.select("location_id", F.col("name").alias("camera_name"))
    return u.join(m, "user_id").join(a, "member_id").join(l, "location_id").join(c, "location_id").select(
        "email", "role", "permission_level", "location_name", "camera_name"
    )
