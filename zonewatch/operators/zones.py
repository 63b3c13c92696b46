"""Which objects stand in which zones, and which rules watch them there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, geometry, keys, rules

# A broadcast table is copied to every executor; beyond this many bytes the join is shuffled.
BROADCAST_BYTES = 32 << 20
# What a row of a configuration table takes besides its polygon, and each edge of that, in a broadcast relation.
ROW_BYTES, EDGE_BYTES = 400, 64
SALTS = 32


@dataclass(frozen=True)
class SmallTable:
    """A configuration table with the facts that decide how to join it."""

    df: DataFrame
    rows: int
    max_edges: int = 0
    edges: int = 0

    @property
    def fits(self) -> bool:
        return self.rows * ROW_BYTES + self.edges * EDGE_BYTES <= BROADCAST_BYTES


def sized(df: DataFrame) -> SmallTable:
    """Count a configuration table once, up to the broadcast bound."""
    return SmallTable(df, df.limit(BROADCAST_BYTES // ROW_BYTES + 1).count())


def join_small(big: DataFrame, small: SmallTable, on: Column, key: str, small_key: str, how: str = "inner") -> DataFrame:
    """Join a big table to a configuration table on ``big.key = small.small_key`` and ``on``.

    Broadcast within the checked bound. Above it the rows of a busy key are spread over ``SALTS``
    tasks and the small side is repeated that often.
    """
    if small.fits:
        return big.join(F.broadcast(small.df), (big[key] == small.df[small_key]) & on, how)
    spread = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    copies = small.df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = (F.col(key) == F.col(small_key)) & (F.col("__salt") == F.col("__copy")) & on
    return spread.join(copies, match, how).drop("__salt", "__copy")


def eligible_zones(zones: DataFrame) -> DataFrame:
    """Enabled zones that enclose an area."""
    return zones.where(F.col("enabled") & (F.size("points") >= 3))


@dataclass(frozen=True)
class ZoneTable(SmallTable):
    """Prepared zones, and per camera the frame sizes they were drawn on."""

    sizes: DataFrame | None = None

    @property
    def unrolled(self) -> bool:
        return self.max_edges <= geometry.MAX_UNROLLED_EDGES


def prepare_zones(zones: DataFrame) -> ZoneTable:
    """Eligible zones with prepared edges and bounding box, measured for the join.

    This reads the zone table once: the polygon test is written out for the largest polygon.
    """
    z = eligible_zones(zones)
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    flat = z.select(
        F.col("camera_id").alias("z_camera_id"),
        F.col("id").alias("zone_id"),
        F.col("name").alias("zone_name"),
        "zone_type",
        F.col("frame_width").alias("z_w"),
        F.col("frame_height").alias("z_h"),
        geometry.polygon_edges(F.col("points")).alias("z_edges"),
        F.array_min(xs).alias("z_x1"),
        F.array_max(xs).alias("z_x2"),
        F.array_min(ys).alias("z_y1"),
        F.array_max(ys).alias("z_y2"),
    )
    facts = flat.select(F.size("z_edges").alias("n")).agg(F.count("*"), F.max("n"), F.sum("n")).first()
    rows, edges, total = facts[0], facts[1] or 0, facts[2] or 0
    sizes = flat.select(
        F.col("z_camera_id").alias("s_camera_id"), F.col("z_w").alias("s_w"), F.col("z_h").alias("s_h")
    ).distinct()
    return ZoneTable(flat, rows, edges, total, sizes)


def _near(p: dict[str, Column] | Column) -> Column:
    """Inside the zone's bounding box: cheap, so it comes first."""
    return (
        (p["x"] >= F.col("z_x1")) & (p["x"] <= F.col("z_x2"))
        & (p["y"] >= F.col("z_y1")) & (p["y"] <= F.col("z_y2"))
    )


ZONE_WORK = ["z_camera_id", "z_w", "z_h", "z_edges", "z_x1", "z_x2", "z_y1", "z_y2"]


def match_zones(detections: DataFrame, zones: DataFrame | ZoneTable, how: str = "inner") -> DataFrame:
    """One row per detection and zone its foot stands in; ``how="left"`` keeps the others.

    The foot point is scaled once per frame size used by the camera's zones, below the join with the
    zones, so the join condition works on two plain columns and stays in generated code.
    """
    table = zones if isinstance(zones, ZoneTable) else prepare_zones(zones)
    foot = geometry.foot_point(F.col("bbox"))
    if how == "left":
        p = geometry.scale_point(foot, F.col("frame_w"), F.col("frame_h"), F.col("z_w"), F.col("z_h"))
        inside = _near(p) & geometry.inside_edges(p, F.col("z_edges"), None)
        return join_small(detections, table, inside, "camera_id", "z_camera_id", "left").drop(*ZONE_WORK)
    sized_table = SmallTable(table.sizes, table.rows)
    scaled = join_small(detections, sized_table, F.lit(True), "camera_id", "s_camera_id")
    p = geometry.scale_point(foot, F.col("frame_w"), F.col("frame_h"), F.col("s_w"), F.col("s_h"))
    scaled = scaled.withColumns({"__px": p["x"], "__py": p["y"]})
    at = {"x": F.col("__px"), "y": F.col("__py")}
    edges = []
    if table.unrolled:
        edges = geometry.edge_columns(F.col("z_edges"), table.max_edges)
        inside = geometry.inside_edge_columns(at, table.max_edges)
    else:
        inside = geometry.inside_edges(at, F.col("z_edges"), None)
    flat = table.df.select(*[c for c in table.df.columns if not (edges and c == "z_edges")], *edges)
    same_size = (F.col("s_w") == F.col("z_w")) & (F.col("s_h") == F.col("z_h"))
    hits = join_small(
        scaled, SmallTable(flat, table.rows, table.max_edges, table.edges), same_size & _near(at) & inside, "camera_id", "z_camera_id"
    )
    return hits.select(*detections.columns, "zone_id", "zone_name", "zone_type")


def annotate_zones(detections: DataFrame, zones: DataFrame | ZoneTable) -> DataFrame:
    """Each detection with its foot point and the ids of the zones it stands in.

    Zones of a camera are few, so they are gathered per camera first and tested inside the row: no
    detection is shuffled.
    """
    table = zones if isinstance(zones, ZoneTable) else prepare_zones(zones)
    per_camera = table.df.groupBy("z_camera_id").agg(
        F.array_sort(F.collect_list(F.struct("zone_id", *ZONE_WORK[1:]))).alias("z_all")
    )
    foot = geometry.foot_point(F.col("bbox"))

    def holds(z: Column) -> Column:
        p = geometry.scale_point(foot, F.col("frame_w"), F.col("frame_h"), z["z_w"], z["z_h"])
        near = (p["x"] >= z["z_x1"]) & (p["x"] <= z["z_x2"]) & (p["y"] >= z["z_y1"]) & (p["y"] <= z["z_y2"])
        return near & geometry.inside_edges(p, z["z_edges"], None)

    joined = join_small(
        detections, SmallTable(per_camera, table.rows), F.lit(True), "camera_id", "z_camera_id", "left"
    )
    ids = F.transform(F.filter("z_all", holds), lambda z: z["zone_id"])
    return (
        joined.withColumn("foot_point", geometry.point(F.bround(foot["x"], 1), F.bround(foot["y"], 1)))
        .withColumn("zone_ids", F.coalesce(ids, F.array().cast("array<string>")))
        .drop("z_camera_id", "z_all")
    )


def rule_condition(tz_offset_hours: float = 7.0) -> Column:
    """Does a rule watch a detection: enabled, object, confidence, active hours.

    A missing confidence counts as 0; a rule without a confidence bound takes all.
    """
    minute = clock.local_minutes(F.col("us"), tz_offset_hours)
    sure = F.col("confidence_threshold").isNull() | (
        F.coalesce(F.col("confidence"), F.lit(0.0)) >= F.col("confidence_threshold")
    )
    timed = ~F.coalesce(F.col("use_active_time"), F.lit(False)) | clock.in_active_window(
        F.col("active_start_time"), F.col("active_end_time"), minute
    )
    return (
        F.coalesce(F.col("rule_enabled"), F.lit(False))
        & rules.matches_object(F.col("rule_object_type"), F.col("class_name"))
        & sure
        & timed
    )


def rule_applies(hits: DataFrame, tz_offset_hours: float = 7.0) -> DataFrame:
    return hits.where(rule_condition(tz_offset_hours))


RULE_WORK = ["r_zone_id", "r_classes", "r_confidence", "r_timed", "r_never", "r_from", "r_to"]


def prepare_rules(rule_config: DataFrame) -> SmallTable:
    """Enabled rules with object groups and clock texts already worked out, so the join compares
    plain values."""
    start, end = F.col("active_start_time"), F.col("active_end_time")
    want = F.lower(F.nullif(F.col("object_type"), F.lit("")))
    timed = F.coalesce("use_active_time", F.lit(False))
    given = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    flat = rule_config.where("enabled").select(
        F.col("id").alias("rule_id"),
        F.col("zone_id").alias("r_zone_id"),
        "rule_type",
        F.col("object_type").alias("rule_object_type"),
        F.col("duration_threshold").cast("double").alias("duration_threshold"),
        F.col("people_threshold").cast("int").alias("people_threshold"),
        F.col("confidence_threshold").cast("double").alias("r_confidence"),
        F.when(want == "vehicle", F.array(*[F.lit(k) for k in rules.VEHICLES]))
        .when(want.isNotNull(), F.array(want)).alias("r_classes"),
        timed.alias("r_timed"),
        (timed & ~given).alias("r_never"),
        clock.time_to_minutes(start).alias("r_from"),
        clock.time_to_minutes(end).alias("r_to"),
    )
    return sized(flat.where(~F.col("r_never")))


def match_rules(
    zone_hits: DataFrame, rule_config: DataFrame | SmallTable, tz_offset_hours: float = 7.0, how: str = "inner"
) -> DataFrame:
    """One row per zone hit and rule that watches it (conditions as in ``rule_condition``).

    What a hit is compared by is worked out once for it, below the join, and not for each of its zone's rules.
    """
    table = rule_config if isinstance(rule_config, SmallTable) else prepare_rules(rule_config)
    hits = zone_hits.withColumns({
        "__minute": clock.local_minutes(F.col("us"), tz_offset_hours), "__sure": F.coalesce("confidence", F.lit(0.0)),
        "__class": F.lower(F.coalesce("class_name", F.lit("")))})
    minute, a, b = F.col("__minute"), F.col("r_from"), F.col("r_to")
    watches = (
        (F.col("r_confidence").isNull() | (F.col("__sure") >= F.col("r_confidence")))
        & (F.col("r_classes").isNull() | F.array_contains("r_classes", F.col("__class")))
        & (~F.col("r_timed") | (a == b) | ((a < b) & minute.between(a, b)) | ((a > b) & ((minute >= a) | (minute <= b))))
    )
    return join_small(hits, table, watches, "zone_id", "r_zone_id", how).drop(*RULE_WORK, "__minute", "__sure", "__class")


def with_track_key(detections: DataFrame) -> DataFrame:
    return detections.withColumn(
        "track_key", keys.track_key(F.col("class_name"), F.col("track_id"), F.col("seq"), F.col("det_index"))
    )


def filter_detections(df: DataFrame, classes=("person", "car", "motorcycle"), min_confidence: float = 0.35) -> DataFrame:
    return df.where(F.col("class_name").isin(*classes) & (F.col("confidence") >= min_confidence))
