"""Fitting drawing coordinates to schematic ones by the ends of wires.

Texts give a first zoom that is slightly wrong, as they are drawn beside their
anchors; ends of wires are drawn exactly.  Each end is predicted with the zoom
at hand, paired with the nearest drawn end, and the zoom is fitted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def nearest(points: DataFrame, ends: DataFrame, keys: list[str], radius: float = 8.0, levels: int = 3) -> DataFrame:
    """(keys, px, py, x, y, distance): the nearest of ``ends`` (keys, x, y) nearer than ``radius`` to each distinct point (keys, px, py).

    Ties go to the smaller x, then y; a point without such an end gives no row, nor does one with a null.
    The reach grows by four to the radius: a point that meets an end within reach has found its
    nearest among four squares, so crowded places are settled where squares hold few.
    """
    left = points.select(*keys, "px", "py").dropna().distinct()
    ends = stage(ends.select(*keys, "x", "y").dropna().distinct())
    found = None
    for level in range(levels - 1, -1, -1):
        side = radius / 4**level
        square = lambda c, off=0.0: F.floor((F.col(c) + off) / (2 * side))  # noqa: E731, B023
        # squares of twice the reach: a point reaches into two of them on each axis
        asked = left.withColumn("_i", F.explode(F.sequence(square("px", -side), square("px", side)))).withColumn("_j", F.explode(F.sequence(square("py", -side), square("py", side))))
        d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
        hit = F.when(d2 < side * side, F.struct(d2.alias("d2"), "x", "y"))
        best = asked.join(ends.select("*", square("x").alias("_i"), square("y").alias("_j")), [*keys, "_i", "_j"], "left").groupBy(*keys, "px", "py").agg(F.min(hit).alias("_b"))
        best = stage(best) if level else best
        own = best.filter("_b is not null").select(*keys, "px", "py", "_b.x", "_b.y", F.sqrt("_b.d2").alias("distance"))
        found = own if found is None else found.unionByName(own)
        left = best.filter("_b is null").drop("_b")
    return found


def fit_zoom(wire_ends: DataFrame, drawn: DataFrame, start: DataFrame, keys: list[str], radius: float = 8.0, rounds: int = 2) -> DataFrame:
    """(keys, zoom, x_origin, y_origin, pairs, error) of each drawing in ``start`` (keys, zoom, x_origin, y_origin).

    ``wire_ends`` are schematic ends (keys, x, y), ``drawn`` ends of paths in the drawing (keys, x, y), where
    drawn = (x + x_origin) * zoom.  Each round fits both axes by least squares, leaves out what lies beyond two
    deviations, and fits again; the next round pairs anew with the better zoom.  ``error`` is the root mean square
    of what was kept.  A drawing without pairs keeps its zoom, with 0 pairs and a null error.
    """
    ends = wire_ends.select(*keys, "x", "y").dropna().distinct()
    drawn = drawn.select(*keys, "x", "y")
    zooms = start.select(*keys, F.col("zoom").cast("double"), "x_origin", "y_origin")
    least = F.sum(F.col("s") * F.col("p")) / F.nullif(F.sum(F.col("s") * F.col("s")), F.lit(0.0))
    gap = F.col("p") - F.col("zoom") * F.col("s")
    for _ in range(rounds):
        zooms = stage(zooms.select(*keys, "zoom", "x_origin", "y_origin"))
        at = ends.join(zooms, keys).withColumn("sx", F.col("x") + F.col("x_origin")).withColumn("sy", F.col("y") + F.col("y_origin"))
        at = stage(at.select(*keys, "sx", "sy", (F.col("sx") * F.col("zoom")).alias("px"), (F.col("sy") * F.col("zoom")).alias("py")))
        met = at.join(nearest(at, drawn, keys, radius), [*keys, "px", "py"])
        pairs = stage(met.select(*keys, F.explode(F.array(F.struct(F.col("sx").alias("s"), F.col("x").alias("p")), F.struct(F.col("sy").alias("s"), F.col("y").alias("p")))).alias("e")).select(*keys, "e.*"))
        first = pairs.groupBy(*keys).agg(least.alias("zoom"))
        spread = pairs.join(first, keys).groupBy(*keys).agg(F.first("zoom").alias("zoom"), F.sqrt(F.avg(gap * gap)).alias("sd"))
        kept = pairs.join(spread, keys).filter(F.abs(gap) <= 2 * F.col("sd") + 1e-9).select(*pairs.columns)
        second = kept.groupBy(*keys).agg(least.alias("zoom"), F.count("*").alias("n"))
        fitted = kept.join(second, keys).groupBy(*keys).agg(F.first("zoom").alias("fitted"), F.first("n").alias("n"), F.sqrt(F.avg(gap * gap)).alias("error"))
        zooms = zooms.join(fitted, keys, "left").select(*keys, F.coalesce("fitted", "zoom").alias("zoom"), "x_origin", "y_origin", F.expr("int(coalesce(n, 0) div 2)").alias("pairs"), "error")
    return zooms
