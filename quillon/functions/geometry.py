"""Geometry as column expressions: points are array<struct<x,y>>, boxes four columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("min_x", "min_y", "max_x", "max_y")


def area(points: Column) -> Column:
    """Half the absolute cross sum of a ring; 0 for fewer than three points."""
    n = F.size(points)
    turn = lambda s, i: s + points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"]
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), turn)
    return F.when(n >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))


def bbox(points: Column) -> Column:
    """Box of a list of points; null if it is empty."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y")))


def center(box: Column) -> Column:
    return F.struct(((box["min_x"] + box["max_x"]) / 2).alias("x"), ((box["min_y"] + box["max_y"]) / 2).alias("y"))


def make_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("min_x"), F.least(y1, y2).alias("min_y"), F.greatest(x1, x2).alias("max_x"), F.greatest(y1, y2).alias("max_y"))


def point_box(x: Column, y: Column) -> Column:
    return make_box(x, y, x, y)


def width(box: Column) -> Column:
    return box["max_x"] - box["min_x"]


def height(box: Column) -> Column:
    return box["max_y"] - box["min_y"]


def inflate(box: Column, by: Column | float) -> Column:
    return F.struct((box["min_x"] - by).alias("min_x"), (box["min_y"] - by).alias("min_y"), (box["max_x"] + by).alias("max_x"), (box["max_y"] + by).alias("max_y"))


def element_box(kind: Column, e) -> Column:
    """Box of a drawing element row: line, rect, circle, polygon or text (its anchor)."""
    flat = F.when(kind.isin("line", "rect"), make_box(e["x1"], e["y1"], e["x2"], e["y2"]))
    ring = flat.when(kind == "circle", make_box(e["x1"] - e["radius"], e["y1"] - e["radius"], e["x1"] + e["radius"], e["y1"] + e["radius"]))
    return ring.when(kind == "polygon", bbox(e["points"])).when(kind == "text", point_box(e["x1"], e["y1"]))


def intersects(a, b) -> Column:
    """Closed overlap of two boxes (anything with the four names); null boxes do not meet."""
    hit = (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])
    return F.coalesce(hit, F.lit(False))


def contains(box, x: Column, y: Column) -> Column:
    return x.between(box["min_x"], box["max_x"]) & y.between(box["min_y"], box["max_y"])


def to_micron(value: Column, unit_m: Column) -> Column:
    return value * (unit_m / F.lit(1e-6))


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def finite_box(box: Column) -> Column:
    return finite(box["min_x"]) & finite(box["min_y"]) & finite(box["max_x"]) & finite(box["max_y"])


def world_box(box: Column, w: Column | float = 1.0, h: Column | float = 1.0) -> Column:
    """The box itself, or (0, 0, w, h) where it is missing or not finite."""
    other = F.struct(F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), _column(w).cast("double").alias("max_x"), _column(h).cast("double").alias("max_y"))
    return F.when(finite_box(box), box).otherwise(other)


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fit(box: Column, w: Column, h: Column) -> Column:
    """pan_x, pan_y and scale that centre a box in a view with a tenth to spare."""
    scale = F.least(w / F.greatest(width(box), F.lit(1e-9)), h / F.greatest(height(box), F.lit(1e-9))) * 0.9
    mid = center(box)
    return F.struct((w / 2 - mid["x"] * scale).alias("pan_x"), (h / 2 - mid["y"] * scale).alias("pan_y"), scale.alias("scale"))


def zoom(view: Column, x: Column, y: Column, factor: Column) -> Column:
    """Zoom about a screen point; a factor that is not positive and finite changes nothing."""
    pan = lambda at, p: at - (at - p) * factor
    moved = F.struct(pan(x, view["pan_x"]).alias("pan_x"), pan(y, view["pan_y"]).alias("pan_y"), (view["scale"] * factor).alias("scale"))
    return F.when(finite(factor) & (factor > 0), moved).otherwise(view)


def pan(view: Column, dx: Column, dy: Column) -> Column:
    return F.struct((view["pan_x"] + dx).alias("pan_x"), (view["pan_y"] + dy).alias("pan_y"), view["scale"].alias("scale"))


def to_screen(view: Column, x: Column, y: Column) -> Column:
    return F.struct((x * view["scale"] + view["pan_x"]).alias("x"), (y * view["scale"] + view["pan_y"]).alias("y"))


def to_world(view: Column, x: Column, y: Column) -> Column:
    return F.struct(((x - view["pan_x"]) / view["scale"]).alias("x"), ((y - view["pan_y"]) / view["scale"]).alias("y"))


def effective_box(box: Column, w: Column, h: Column, scale: Column, pan_x: Column, pan_y: Column) -> Column:
    own = world_box(box, w, h)
    factor = F.when(finite(scale) & (scale > 0), scale).otherwise(1.0)
    mid = center(own)
    half_w = F.greatest(F.abs(width(own)), F.lit(1.0)) / factor / 2
    half_h = F.greatest(F.abs(height(own)), F.lit(1.0)) / factor / 2
    x, y = mid["x"] + pan_x, mid["y"] + pan_y
    return F.struct((x - half_w).alias("min_x"), (y - half_h).alias("min_y"), (x + half_w).alias("max_x"), (y + half_h).alias("max_y"))


def view_box(box: Column, w: Column | float, h: Column | float) -> Column:
    """``min_x min_y width height`` with four decimals; an extent of 0 counts as 1."""
    own = world_box(box, w, h)
    wide = F.when(F.abs(width(own)) < 2.220446049250313e-16, 1.0).otherwise(width(own))
    high = F.when(F.abs(height(own)) < 2.220446049250313e-16, 1.0).otherwise(height(own))
    return F.format_string("%.4f %.4f %.4f %.4f", own["min_x"], own["min_y"], wide, high)


def points_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.format_string("%.4f,%.4f", p["x"].cast("double"), p["y"].cast("double"))), " ")


def arc(cx: Column, cy: Column, radius: Column, start_deg: Column, sweep_deg: Column) -> Column:
    """Points of an arc in steps of at most five degrees; y grows downwards."""
    steps = F.greatest(F.ceil(F.abs(sweep_deg) / 5).cast("int"), F.lit(1))
    angle = lambda i: (start_deg + sweep_deg * i / steps) * (math.pi / 180)
    return F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct((cx + radius * F.cos(angle(i))).alias("x"), (cy - radius * F.sin(angle(i))).alias("y")))
