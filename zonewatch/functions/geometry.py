"""Boxes, points and polygons as Column expressions.

A box is a struct ``x1, y1, x2, y2`` in pixels, a point a struct ``x, y``. The y axis points down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Above this many edges the unrolled polygon test makes generated code too long for the JIT.
MAX_UNROLLED_EDGES = 12

EDGE_FIELDS = ("x1", "y1", "dx", "dy", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        x2.cast("double").alias("x2"),
        y2.cast("double").alias("y2"),
    )


def box_from_array(values: Column) -> Column:
    """``[x1, y1, x2, y2]`` as a box; a missing array is the empty box at the origin."""
    part = lambda i: F.coalesce(F.get(values, F.lit(i)).cast("double"), F.lit(0.0))
    return box(part(0), part(1), part(2), part(3))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def foot_point(b: Column) -> Column:
    """Middle of the lower edge: where the object stands."""
    return point((b["x1"] + b["x2"]) / F.lit(2.0), b["y2"])


def bbox_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def bbox_center_wh(b: Column) -> Column:
    return F.struct(
        ((b["x1"] + b["x2"]) / F.lit(2.0)).alias("cx"),
        ((b["y1"] + b["y2"]) / F.lit(2.0)).alias("cy"),
        (b["x2"] - b["x1"]).alias("w"),
        (b["y2"] - b["y1"]).alias("h"),
    )


def scale_point(p: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """Move a point between frame sizes; unchanged when the source size is unknown or the same."""
    unknown = (
        F.coalesce(from_w, F.lit(0)).eqNullSafe(0) | F.coalesce(from_h, F.lit(0)).eqNullSafe(0)
    )
    keep = unknown | ((from_w == to_w) & (from_h == to_h))
    safe_w = F.when(unknown, F.lit(1.0)).otherwise(from_w.cast("double"))
    safe_h = F.when(unknown, F.lit(1.0)).otherwise(from_h.cast("double"))
    return point(
        F.when(keep, p["x"]).otherwise(p["x"] * to_w / safe_w),
        F.when(keep, p["y"]).otherwise(p["y"] * to_h / safe_h),
    )


def polygon_edges(points: Column) -> Column:
    """Edges of a closed polygon, each from a vertex to the one before it.

    Flat edges get ``dy = 1``; they are never crossed, so the value is only there to keep the
    division defined.
    """
    def edge(p: Column, i: Column) -> Column:
        q = F.get(points, F.when(i == 0, F.size(points) - 1).otherwise(i - 1))
        dy = q["y"] - p["y"]
        return F.struct(
            p["x"].cast("double").alias("x1"),
            p["y"].cast("double").alias("y1"),
            (q["x"] - p["x"]).cast("double").alias("dx"),
            F.when(dy == 0, F.lit(1.0)).otherwise(dy).cast("double").alias("dy"),
            q["y"].cast("double").alias("y2"),
        )

    return F.transform(points, edge)


def _crossed(p: Column, e: Column) -> Column:
    spans = (e["y1"] > p["y"]) != (e["y2"] > p["y"])
    return spans & (p["x"] < e["dx"] * (p["y"] - e["y1"]) / e["dy"] + e["x1"])


def inside_edges(p: Column, edges: Column, max_edges: int | None) -> Column:
    """Even-odd test against prepared edges.

    With a known bound on the number of edges the test is written out edge by edge, which keeps
    the surrounding join in generated code; otherwise a lambda walks the array.
    """
    if max_edges is not None and max_edges <= MAX_UNROLLED_EDGES:
        hits = F.lit(0)
        for i in range(max_edges):
            hits = hits + F.when(_crossed(p, F.get(edges, F.lit(i))), 1).otherwise(0)
    else:
        hits = F.aggregate(
            edges, F.lit(0), lambda n, e: n + F.when(_crossed(p, e), 1).otherwise(0)
        )
    return (F.size(edges) >= 3) & (hits % 2 == 1)


def edge_columns(edges: Column, count: int) -> list[Column]:
    """Edges as plain double columns ``e0x1 ...``; missing ones are flat and never crossed."""
    fill = {"dy": 1.0}
    return [
        F.coalesce(F.get(edges, F.lit(i))[f], F.lit(fill.get(f, 0.0))).alias(f"e{i}{f}")
        for i in range(count)
        for f in EDGE_FIELDS
    ]


def inside_edge_columns(p: Column, count: int) -> Column:
    """Even-odd test against the columns of ``edge_columns``.

    ``p`` should be a plain column pair: it is repeated for every edge, and a computed point would
    be computed again each time.
    """
    hits = F.lit(0)
    for i in range(count):
        edge = {f: F.col(f"e{i}{f}") for f in EDGE_FIELDS}
        hits = hits + F.when(_crossed(p, edge), 1).otherwise(0)
    return hits % 2 == 1


def point_in_polygon(p: Column, points: Column, max_points: int | None = None) -> Column:
    """Left and top borders count as inside, right and bottom do not; under 3 points is false."""
    return inside_edges(p, polygon_edges(points), max_points)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes, 0 without overlap."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = w * h
    union = bbox_area(a) + bbox_area(b) - shared
    return F.when((shared > 0) & (union > 0), F.try_divide(shared, union)).otherwise(F.lit(0.0))


def fit_viewport(canvas_w: Column, canvas_h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Largest centred rectangle of the frame's shape in the canvas."""
    one = F.lit(1)
    scale = F.least(canvas_w / F.greatest(one, frame_w), canvas_h / F.greatest(one, frame_h))
    width, height = frame_w * scale, frame_h * scale
    return F.struct(
        ((canvas_w - width) / F.lit(2.0)).alias("x"),
        ((canvas_h - height) / F.lit(2.0)).alias("y"),
        width.alias("width"),
        height.alias("height"),
    )


def to_viewport(p: Column, frame_w: Column, frame_h: Column, view: Column) -> Column:
    one = F.lit(1)
    return point(
        view["x"] + p["x"] / F.greatest(one, frame_w) * view["width"],
        view["y"] + p["y"] / F.greatest(one, frame_h) * view["height"],
    )
