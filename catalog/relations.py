"""Cameras, zones, rules, people: access, upkeep, lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as PT

from zonewatch.operators import access as X
from zonewatch.operators import evidence as E
from zonewatch.operators import listings as L
from zonewatch.operators import tables as T
from zonewatch.sources import config
from zonewatch.sources import tables as TS

from . import query
from .sqlviews import add, sql
from .views import TENANT

ROLES = {"BUILDING": "owner", "AUTOMOBILE": "admin", "MACHINERY": "operator", "HOUSEHOLD": "viewer", "FURNITURE": "viewer"}
ROLE_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLES.items()) + " END"

add("tenant", "(SELECT 'ten-' || r_regionkey AS id, 'code-' || r_regionkey AS code FROM region)", [])
add("member", f"""(
  SELECT 'm-' || c_custkey AS member_id, 'u-' || c_custkey AS user_id, lower(c_name) || '@x' AS email,
         CASE WHEN c_custkey % 10 = 0 THEN 'ten-2' ELSE '{TENANT}' END AS tenant_id, {ROLE_CASE} AS role, c_custkey,
         c_acctbal >= 0 AND c_custkey % 13 <> 0 AS active, 'loc-' || n_regionkey AS assigned
  FROM customer JOIN nation ON n_nationkey = c_nationkey)""", [])
add("access", f"""(
  SELECT m.member_id, m.user_id, m.tenant_id, m.role, l.id AS location_id, 'admin' AS level
  FROM member m JOIN location l ON l.tenant_id = m.tenant_id WHERE m.active AND m.role IN ('owner', 'admin')
  UNION ALL
  SELECT m.member_id, m.user_id, m.tenant_id, m.role, m.assigned, m.role FROM member m
  WHERE m.active AND m.role NOT IN ('owner', 'admin') AND m.tenant_id = '{TENANT}')""", ["member", "location"])


class People:
    def __init__(self, v):
        self.v = v
        c = v.table("customer")
        key = F.col("c_custkey").cast("string")
        pairs = [F.lit(x) for p in ROLES.items() for x in p]
        role = F.element_at(F.create_map(*pairs), F.col("c_mktsegment"))
        self.users = c.select(
            F.concat(F.lit("u-"), key).alias("id"), F.concat(F.lower("c_name"), F.lit("@x")).alias("email"),
            F.col("c_name").alias("full_name"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("disabled").alias("status"))
        tenant = F.when(F.col("c_custkey") % 10 == 0, "ten-2").otherwise(TENANT)
        self.members = c.select(
            F.concat(F.lit("m-"), key).alias("id"), F.concat(F.lit("u-"), key).alias("user_id"), tenant.alias("tenant_id"),
            role.alias("role"), F.when(F.col("c_custkey") % 13 != 0, "active").otherwise("disabled").alias("status"))
        n = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("loc-"), F.col("n_regionkey").cast("string")).alias("location_id"))
        self.assignments = c.join(n, "c_nationkey").select(
            F.concat(F.lit("a-"), key).alias("id"), F.concat(F.lit("m-"), key).alias("tenant_member_id"), "location_id",
            tenant.alias("tenant_id"), role.alias("permission_level"))
        rk = F.col("r_regionkey").cast("string")
        self.tenants = v.table("region").select(F.concat(F.lit("ten-"), rk).alias("id"), F.concat(F.lit("code-"), rk).alias("code"))
        even = F.col("c_custkey") % 2 == 0
        self.claims = c.select(
            F.when(even, F.concat(F.lit("u-"), key)).otherwise(F.concat(F.lower("c_name"), F.lit("@x"))).alias("subject"),
            F.when(F.col("c_custkey") % 3 == 0, tenant).otherwise(F.concat(F.lit("code-"), F.substring(tenant, 5, 1))).alias("tenant"))

    @property
    def active(self):
        return X.active_member(self.users, self.members, self.tenants, self.claims)

    @property
    def grants(self):
        return X.grants(self.active, self.v.locations, self.assignments)

    @property
    def access(self):
        return X.effective_access(self.active, self.v.locations, self.assignments)


@query("active_member", sql("member", "SELECT member_id, user_id, tenant_id, role, email FROM member WHERE active"))
def _(v):
    return People(v).active.select("member_id", "user_id", "tenant_id", "role", "email")


@query("effective_access", sql("access", "SELECT * FROM access"))
def _(v):
    return People(v).access


@query("allowed_cameras", sql("access camera", """
SELECT a.member_id, c.id AS camera_id FROM access a JOIN camera c ON c.location_id = a.location_id AND c.tenant_id = a.tenant_id
WHERE a.level IN ('operator', 'admin')"""))
def _(v):
    return X.allowed_cameras(People(v).grants, v.cameras, "operator", v.locations).select("member_id", "camera_id")


@query("camera_visibility", sql("member location camera", """
SELECT m.email, m.role, m.role AS permission_level, l.name AS location_name, c.name AS camera_name
FROM member m JOIN location l ON l.id = m.assigned JOIN camera c ON c.location_id = l.id"""))
def _(v):
    p = People(v)
    return X.camera_visibility(p.users, p.members, p.assignments, v.locations, v.cameras)


# The first operator by id, found in the table itself.
add("one", "(SELECT * FROM access WHERE member_id = (SELECT min(member_id) FROM access WHERE role = 'operator'))", ["access"])
add("mycams", "(SELECT c.id FROM camera c JOIN one a ON a.location_id = c.location_id AND a.tenant_id = c.tenant_id)", ["one", "camera"])


add("boss", "(SELECT * FROM access WHERE member_id = (SELECT min(member_id) FROM access WHERE role = 'owner'))", ["access"])


def mine(v, role="operator"):
    a = People(v).grants
    first = a.where(F.col("role") == role).agg(F.min("member_id")).scalar()
    return a.where(F.col("member_id") == first)


@query("scope_events", sql("aievent mycams", "SELECT id, camera_id FROM aievent WHERE camera_id IN (SELECT id FROM mycams)"))
def _(v):
    return X.scope(v.ai_events, mine(v), v.cameras, "operator").select("id", "camera_id")


@query("scope_tenant", sql("aievent boss camera", """
SELECT id, camera_id FROM aievent WHERE camera_id IN (
  SELECT c.id FROM camera c JOIN boss b ON b.location_id = c.location_id AND b.tenant_id = c.tenant_id)"""))
def _(v):
    return X.scope(v.ai_events, mine(v, "owner"), v.cameras, "admin", v.locations).select("id", "camera_id")


@query("scope_nothing", sql("aievent", "SELECT id FROM aievent WHERE FALSE"))
def _(v):
    return X.scope(v.ai_events, mine(v), v.cameras, "admin").select("id")


@query("scope_rules", sql("rule mycams", "SELECT id, zone_id FROM rule WHERE camera_id IN (SELECT id FROM mycams)"))
def _(v):
    return X.scope_via(v.raw_rules, "rule_config", mine(v), v.cameras, v.raw_zones).select("id", "zone_id")


@query("scope_evidence", sql("evidence mycams", "SELECT id FROM evidence WHERE camera_id IN (SELECT id FROM mycams)"))
def _(v):
    return X.scope_via(v.evidence, "evidence", mine(v), v.cameras).select("id")


@query("access_decisions", sql("member camera access", """
SELECT r.member_id, r.camera_id, r.need, CASE WHEN a.level IS NULL THEN 404
  WHEN CASE a.level WHEN 'viewer' THEN 1 WHEN 'operator' THEN 2 ELSE 3 END < CASE r.need WHEN 'viewer' THEN 1 WHEN 'operator' THEN 2 ELSE 3 END THEN 403 ELSE 200 END AS status
FROM (SELECT member_id, tenant_id, 'cam-' || c_custkey % 30 AS camera_id, (['viewer', 'operator', 'admin'])[1 + CAST(c_custkey % 3 AS INTEGER)] AS need FROM member) r
LEFT JOIN camera c ON c.id = r.camera_id AND c.tenant_id = r.tenant_id
LEFT JOIN access a ON a.member_id = r.member_id AND a.location_id = c.location_id"""))
def _(v):
    p = People(v)
    k = F.substring("id", 3, 20).cast("bigint")
    need = F.get(F.array(F.lit("viewer"), F.lit("operator"), F.lit("admin")), (k % 3).cast("int"))
    r = p.members.select(F.col("id").alias("member_id"), "tenant_id", F.concat(F.lit("cam-"), (k % 30).cast("string")).alias("camera_id"), need.alias("min_level"))
    return X.access_decisions(r, p.grants, v.cameras, v.locations).select("member_id", "camera_id", F.col("min_level").alias("need"), "status")


@query("my_locations", sql("access location", "SELECT a.member_id, a.location_id, l.name, l.code, a.level FROM access a JOIN location l ON l.id = a.location_id"))
def _(v):
    return X.my_locations(People(v).grants, v.locations)


@query("camera_catalog", """
SELECT 'cam-' || n_nationkey AS camera_id, CASE WHEN n_nationkey % 2 = 0 THEN 'RTSP' ELSE 'FILE' END AS source_type,
       CASE WHEN n_nationkey % 3 = 0 THEN 10e0 ELSE 5e0 END AS target_fps, CASE WHEN n_nationkey % 3 = 0 THEN 1280 ELSE 640 END AS frame_w
FROM nation WHERE n_nationkey % 4 <> 3""")
def _(v):
    k = F.col("n_nationkey")
    items = v.table("nation").select(
        F.concat(F.lit("cam-"), k.cast("string")).alias("camera_id"), F.lit("l").alias("location_id"), F.col("n_name").alias("name"),
        F.when(k % 2 == 1, "file").alias("source_type"), F.lit("u").alias("source_url"),
        F.when(k % 3 != 0, 5.0).alias("target_fps"), F.when(k % 3 != 0, 640).alias("frame_width"),
        F.lit(None).cast("int").alias("frame_height"), F.lit(None).cast("string").alias("encoding"),
        F.when(k % 4 == 3, False).when(k % 4 == 2, True).alias("enabled"))
    return config.apply_camera_defaults(items).select("camera_id", "source_type", "target_fps", "frame_w")


@query("present_cameras", sql("camera", "SELECT id, name, '/api/cameras/' || id || '/mjpeg' AS live_stream_url, '/api/cameras/' || id || '/latest.jpg' AS latest_frame_url FROM camera"))
def _(v):
    return TS.present_camera(v.cameras).select("id", "name", "live_stream_url", "latest_frame_url")


@query("present_zones", sql("zone", "SELECT id, zone_type, replace(polygon, '},{', '},{') AS polygon FROM zone WHERE enabled"))
def _(v):
    z = TS.present_zone(config.parse_zones(v.raw_zones))
    return z.select("id", "zone_type", F.replace("polygon", F.lit(".0"), F.lit("")).alias("polygon"))


@query("present_rules", sql("rule", "SELECT id, rule_type, left(a, 5) AS active_start_time, left(b, 5) AS active_end_time FROM rule"))
def _(v):
    return TS.present_rule(config.clean_rules(v.raw_rules)).select("id", "rule_type", "active_start_time", "active_end_time")


@query("with_location", sql("aievent camera", "SELECT e.id, c.location_id, c.tenant_id FROM aievent e JOIN camera c ON c.id = e.camera_id"))
def _(v):
    return L.with_location(v.ai_events, v.cameras).select("id", "location_id", "tenant_id")


@query("list_cameras", sql("camera", "SELECT id, name FROM camera ORDER BY name, id"))
def _(v):
    return L.list_cameras(v.cameras).select("id", "name")


@query("list_zones", sql("zone", "SELECT id FROM zone WHERE camera_id = 'cam-7'"))
def _(v):
    return L.list_zones(v.raw_zones.withColumn("created_us", F.lit(0)), "cam-7").select("id")


@query("list_rules", sql("rule", "SELECT id, rule_type FROM rule WHERE zone_id = 'cam-7:rect' ORDER BY rule_type"))
def _(v):
    return L.list_rules(v.raw_rules, "cam-7:rect").select("id", "rule_type")


@query("zones_without_rules", sql("zone rule", "SELECT id FROM zone WHERE id NOT IN (SELECT zone_id FROM rule)"))
def _(v):
    return T.without(v.raw_zones, v.raw_rules.select(F.col("zone_id").alias("id")), ["id"]).select("id")


@query("silent_cameras", sql("camera hb", "SELECT id FROM camera WHERE id NOT IN (SELECT camera_id FROM hb WHERE rule_type = 'crowd_limit')"))
def _(v):
    heard = v.beats.where("rule_type = 'crowd_limit'").select(F.col("camera_id").alias("id"))
    return T.without(v.cameras, heard, ["id"]).select("id")


@query("union_distinct", sql("visit camera", "SELECT camera_id FROM visit UNION SELECT id FROM camera"))
def _(v):
    return T.union_distinct(v.visits.select("camera_id"), v.cameras.select(F.col("id").alias("camera_id")), ["camera_id"])


@query("default_rules", sql("zone rule", """
SELECT z.id || ':' || d.t AS id, z.id AS zone_id, d.t AS rule_type, d.o AS object_type, 15 AS duration_threshold, d.p AS people_threshold, d.timed AS use_active_time
FROM zone z JOIN (VALUES ('restricted_area', 'person_intrusion', 'person', NULL, TRUE), ('restricted_area', 'vehicle_intrusion', 'vehicle', NULL, TRUE),
  ('controlled_area', 'crowd_limit', 'person', 5, FALSE), ('controlled_area', 'loitering', 'person', NULL, FALSE), ('controlled_area', 'vehicle_stopping', 'vehicle', NULL, FALSE)) d(z, t, o, p, timed)
  ON d.z = z.zone_type WHERE z.id NOT IN (SELECT zone_id FROM rule WHERE rule_type <> 'loitering')"""))
def _(v):
    return T.default_rules(v.raw_zones, v.raw_rules.where("rule_type <> 'loitering'")).select(
        "id", "zone_id", "rule_type", "object_type", "duration_threshold", "people_threshold", "use_active_time")


@query("patch_zone", sql("zone", "SELECT id, CASE WHEN n = 4 THEN 'new' ELSE name END AS name, CASE WHEN n > 2 THEN FALSE ELSE enabled END AS enabled FROM zone"))
def _(v):
    n = F.size(config.parse_points(F.col("polygon")))
    changes = v.raw_zones.select("id", F.when(n == 4, "new").alias("name"), F.when(n > 2, False).alias("enabled"))
    return T.patch(v.raw_zones, changes, "id", True).select("id", "name", "enabled")


@query("patch_rule", sql("rule", """
SELECT id, CASE WHEN rule_type = 'loitering' THEN NULL ELSE object_type END AS object_type,
       CASE WHEN rule_type = 'crowd_limit' THEN 99 ELSE people_threshold END AS people_threshold FROM rule"""))
def _(v):
    lo, crowd = F.col("rule_type") == "loitering", F.col("rule_type") == "crowd_limit"
    changes = v.raw_rules.where(lo | crowd).select(
        "id", F.lit(None).cast("string").alias("object_type"), F.lit(99).alias("people_threshold"),
        F.when(lo, F.array(F.lit("object_type"))).otherwise(F.array(F.lit("people_threshold"))).alias("fields"))
    return T.patch(v.raw_rules, changes, "id", False).select("id", "object_type", "people_threshold")


@query("upsert_cameras", sql("camera", """
SELECT id, CASE WHEN location_id <> 'loc-0' THEN lower(name) ELSE name END AS name, 'active' AS status, location_id,
       CASE WHEN location_id <> 'loc-0' THEN 2 ELSE 1 END AS updated_us FROM camera"""))
def _(v):
    base = v.cameras.where("location_id <> 'loc-4'").select("id", "name", "status", "location_id", F.lit(1).cast("int").alias("updated_us"))
    changes = v.cameras.where("location_id <> 'loc-0'").select(
        "id", F.lower("name").alias("name"), F.when(F.col("location_id") == "loc-4", "active").alias("status"), "location_id", F.lit(2).alias("updated_us"))
    return T.upsert(base, changes, "id", {"name": "replace", "status": "coalesce", "location_id": "keep"}, ["updated_us"])


@query("touch", sql("camera", "SELECT id, CASE WHEN location_id = 'loc-1' THEN 5 ELSE 1 END AS updated_us FROM camera"))
def _(v):
    c = v.cameras.withColumn("updated_us", F.lit(1))
    return T.touch(c, F.col("location_id") == "loc-1", F.lit(5)).select("id", "updated_us")


@query("backfill_tenant", sql("rule", f"SELECT id, '{TENANT}' AS tenant_id FROM rule"))
def _(v):
    blank = F.lit(None).cast("string")
    _, _, r = T.backfill_tenant(v.locations, v.cameras.withColumn("tenant_id", blank), v.raw_zones.withColumn("tenant_id", blank),
                                v.raw_rules.withColumn("tenant_id", blank))
    return r.select("id", "tenant_id")


@query("delete_cascade", sql("camera zone rule aievent", """
SELECT 'rule_config' AS t, r.id, r.zone_id AS zone_id FROM rule r JOIN zone z ON z.id = r.zone_id WHERE z.zone_type <> 'restricted_area'
UNION ALL SELECT 'ai_event', e.id, CASE WHEN z.zone_type = 'restricted_area' THEN NULL ELSE z.id END FROM aievent e JOIN zone z ON z.id = e.zone_id"""))
def _(v):
    tables = {"camera": v.cameras, "zone": v.raw_zones, "rule_config": v.raw_rules, "ai_event": v.ai_events}
    out = T.delete_cascade(tables, "zone", v.raw_zones.where("zone_type = 'restricted_area'").select("id"))
    pick = lambda n: out[n].select(F.lit(n).alias("t"), "id", "zone_id")
    return pick("rule_config").unionByName(pick("ai_event"))


@query("check_integrity", sql("member location", f"""
SELECT 'user_location_access' AS "table", 'tenant location_id' AS "check", 'a-' || c_custkey AS key FROM member WHERE tenant_id <> '{TENANT}'
UNION ALL SELECT 'user_location_access', 'value permission_level', 'a-' || c_custkey FROM member WHERE role = 'owner'
UNION ALL SELECT 'tenant_member', 'link user_id', member_id FROM member WHERE c_custkey % 17 = 0"""))
def _(v):
    p = People(v)
    kept = p.users.where(F.substring("id", 3, 20).cast("bigint") % 17 != 0)
    return T.check_integrity({
        "tenant": p.tenants, "app_user": kept, "tenant_member": p.members, "location": v.locations,
        "user_location_access": p.assignments, "camera": v.cameras, "zone": v.raw_zones, "rule_config": v.raw_rules,
        "ai_event": v.ai_events,
    })


@query("conform", sql("camera", "SELECT id, 'unknown' AS model, CAST(NULL AS INTEGER) AS floor FROM camera"))
def _(v):
    schema = PT.StructType([PT.StructField("id", PT.StringType()), PT.StructField("model", PT.StringType()), PT.StructField("floor", PT.IntegerType())])
    return T.conform(v.cameras, schema, {"model": "unknown"})


@query("evidence_of_event", sql("evidence aievent", """
SELECT id, captured_us FROM evidence WHERE ai_event_id = (SELECT min(id) FROM aievent)"""))
def _(v):
    first = v.ai_events.agg(F.min("id")).scalar()
    return E.evidence_of_event(v.evidence, first).select("id", "captured_us")
