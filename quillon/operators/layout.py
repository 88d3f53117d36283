"""Layouts as tables: flattening, polygon booleans, attribution, spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import stage

POINTS = "array<struct<x:double,y:double>>"
#: Entries of a grid's lists up to which they go to every task.
MOST_BROADCAST = 500_000


# --- hierarchy ---------------------------------------------------------------
def top_cells(cells: DataFrame, references: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Cells without a parent, and of each group the first by name as ``top``."""
    used = references.select(*keys, F.col("child").alias("cell")).distinct()
    roots = cells.select(*keys, "cell").join(used, [*keys, "cell"], "left_anti")
    return roots.groupBy(*keys).agg(F.min("cell").alias("top"))


def instances(references: DataFrame, keys: list[str]) -> DataFrame:
    """Every chain of references below each cell: (root, cell, a, b, c, d, tx, ty, path).

    The affine map takes cell coordinates to root coordinates.  Arrays become
    one row for each element.  One join a level, to any depth; cycles end where
    a path would repeat a cell.
    """
    col = F.explode(F.sequence(F.lit(0), F.greatest("cols", F.lit(1)) - 1))
    rep = references.withColumn("_i", col).withColumn("_j", F.explode(F.sequence(F.lit(0), F.greatest("rows", F.lit(1)) - 1)))
    angle, mag, flip = F.radians("rot"), F.coalesce("mag", F.lit(1.0)), F.when(F.col("mirror"), -1.0).otherwise(1.0)
    cos, sin = F.round(F.cos(angle), 12) * mag, F.round(F.sin(angle), 12) * mag
    edge = rep.select(*keys, F.col("cell").alias("_parent"), F.col("child").alias("_child"), cos.alias("_a"), (-sin * flip).alias("_b"), sin.alias("_c"), (cos * flip).alias("_d"), (F.col("dx") + F.col("_i") * F.col("sx")).alias("_x"), (F.col("dy") + F.col("_j") * F.col("sy")).alias("_y"))
    level = edge.select(*keys, F.col("_parent").alias("root"), F.col("_child").alias("cell"), F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_c").alias("c"), F.col("_d").alias("d"), F.col("_x").alias("tx"), F.col("_y").alias("ty"), F.array("_parent", "_child").alias("path")).filter("root <> cell")
    out = level
    while True:
        step = level.withColumnRenamed("cell", "_parent").join(edge, [*keys, "_parent"]).filter(~F.array_contains("path", F.col("_child")))
        level = stage(step.select(
            *keys, "root", F.col("_child").alias("cell"),
            (F.col("a") * F.col("_a") + F.col("b") * F.col("_c")).alias("a"), (F.col("a") * F.col("_b") + F.col("b") * F.col("_d")).alias("b"),
            (F.col("c") * F.col("_a") + F.col("d") * F.col("_c")).alias("c"), (F.col("c") * F.col("_b") + F.col("d") * F.col("_d")).alias("d"),
            (F.col("a") * F.col("_x") + F.col("b") * F.col("_y") + F.col("tx")).alias("tx"), (F.col("c") * F.col("_x") + F.col("d") * F.col("_y") + F.col("ty")).alias("ty"),
            F.concat("path", F.array("_child")).alias("path"),
        ))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def flatten(polygons: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons of each cell in its own coordinates with all that it references; path names the chain."""
    own = polygons.select(*keys, "cell", "layer", "datatype", "points", F.array("cell").alias("path"))
    inst = instances(references, keys)
    move = lambda p: F.struct((F.col("a") * p["x"] + F.col("b") * p["y"] + F.col("tx")).alias("x"), (F.col("c") * p["x"] + F.col("d") * p["y"] + F.col("ty")).alias("y"))
    below = polygons.join(inst, [*keys, "cell"]).select(*keys, F.col("root").alias("cell"), "layer", "datatype", F.transform("points", move).alias("points"), "path")
    return own.unionByName(below)


def changed_cells(a: DataFrame, b: DataFrame, references: DataFrame, keys: list[str], more: DataFrame | None = None) -> DataFrame:
    """Cells whose own geometry differs, and those of ``more``, closed upwards over references; only these need a boolean.

    Geometry is compared by a sum of hashes, so it needs one aggregation.
    """
    digest = lambda df, name: df.groupBy(*keys, "cell", "layer", "datatype").agg(F.sum(F.xxhash64("points").cast("decimal(38,0)")).alias(name), F.count("*").alias(f"{name}_n"))
    both = digest(a, "ha").join(digest(b, "hb"), [*keys, "cell", "layer", "datatype"], "full")
    first = both.filter(~F.col("ha").eqNullSafe(F.col("hb")) | ~F.col("ha_n").eqNullSafe(F.col("hb_n"))).select(*keys, "cell")
    frontier = seen = stage((first if more is None else first.unionByName(more.select(*keys, "cell"))).distinct())
    up = references.select(*keys, F.col("cell").alias("_parent"), F.col("child").alias("cell")).distinct()
    while True:
        frontier = frontier.join(up, [*keys, "cell"]).select(*keys, F.col("_parent").alias("cell")).distinct().join(seen, [*keys, "cell"], "left_anti")
        frontier = stage(frontier)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


# --- rectangles: a sweep in windows -----------------------------------------
def rect_xor(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Strips where only one side covers: (keys, x1, x2, y1, y2, side).

    ``rects`` has x1, y1, x2, y2 and side ('a' or 'b').  Distinct x edges make slabs; each
    rectangle meets the slabs that it spans; in a slab, coverage is a running sum of
    +1 and -1 by y.  Slabs carry their number, so that a rectangle finds its slabs
    by a range of numbers, exploded, and an equality join.
    """
    solid = rects.filter("x1 < x2 and y1 < y2")
    edges = solid.select(*keys, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    by_x = Window.partitionBy(*keys).orderBy("x")
    slabs = edges.withColumn("_k", F.row_number().over(by_x)).withColumn("x_next", F.lead("x").over(by_x))
    first = slabs.select(*keys, F.col("x").alias("x1"), F.col("_k").alias("_k1"))
    last = slabs.select(*keys, F.col("x").alias("x2"), F.col("_k").alias("_k2"))
    spans = solid.join(first, [*keys, "x1"]).join(last, [*keys, "x2"]).withColumn("_k", F.explode(F.sequence("_k1", F.col("_k2") - 1)))
    edge = F.explode(F.array(F.struct(F.col("y1").alias("y"), F.lit(1).alias("s")), F.struct(F.col("y2").alias("y"), F.lit(-1).alias("s")))).alias("e")
    events = spans.select(*keys, "_k", "side", edge)
    sums = events.groupBy(*keys, "_k", F.col("e.y").alias("y")).agg(F.sum(F.when(F.col("side") == "a", F.col("e.s")).otherwise(0)).alias("da"), F.sum(F.when(F.col("side") == "b", F.col("e.s")).otherwise(0)).alias("db"))
    by_y = Window.partitionBy(*keys, "_k").orderBy("y")
    cover = sums.withColumn("ca", F.sum("da").over(by_y)).withColumn("cb", F.sum("db").over(by_y)).withColumn("y_next", F.lead("y").over(by_y))
    found = cover.filter("y_next is not null and (ca > 0) <> (cb > 0)")
    return found.join(slabs, [*keys, "_k"]).select(*keys, F.col("x").alias("x1"), F.col("x_next").alias("x2"), F.col("y").alias("y1"), F.col("y_next").alias("y2"), F.when(F.col("cb") > 0, "added").otherwise("removed").alias("side"))


def tile_rects(rects: DataFrame, size: float) -> DataFrame:
    """Rectangles cut along a grid of tiles (tx, ty), so that a large layer is many groups."""
    start = lambda c: F.floor(F.col(c) / size)
    stop = lambda c: F.ceil(F.col(c) / size) - 1
    cut = rects.withColumn("tx", F.explode(F.sequence(start("x1"), F.greatest(stop("x2"), start("x1"))))).withColumn("ty", F.explode(F.sequence(start("y1"), F.greatest(stop("y2"), start("y1")))))
    for c, t, f in (("x1", "tx", F.greatest), ("y1", "ty", F.greatest)):
        cut = cut.withColumn(c, f(F.col(c), F.col(t) * size))
    for c, t, f in (("x2", "tx", F.least), ("y2", "ty", F.least)):
        cut = cut.withColumn(c, f(F.col(c), (F.col(t) + 1) * size))
    return cut


def strip_metrics(strips: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Area by side, box and the cosmetic flag of each group of strips."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    by = lambda s: F.sum(F.when(F.col("side") == s, size).otherwise(0))
    found = strips.groupBy(*keys).agg(by("added").alias("added_area"), by("removed").alias("removed_area"), F.min("x1").alias("min_x"), F.min("y1").alias("min_y"), F.max("x2").alias("max_x"), F.max("y2").alias("max_y"))
    return found.withColumn("cosmetic", F.col("added_area") + F.col("removed_area") < threshold)


# --- attribution and metrics -----------------------------------------------
def cell_boxes(polygons: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Box of each cell with all below it, in its own coordinates; cells without geometry have none.

    Boxes go upwards: a cell follows when those of all its children are known, one
    round for each level of the hierarchy.  Cells of a cycle get what is known below them.
    References turn by quarters here; other angles would need the corners themselves.
    """
    group, corners = [*keys, "cell"], {c: f for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)}
    own = polygons.withColumn("_b", G.bbox(F.col("points"))).groupBy(*group).agg(*[f(f"_b.{c}").alias(c) for c, f in corners.items()])
    cells = references.select(*keys, F.col("child").alias("cell")).unionByName(references.select(*group)).unionByName(own.select(*group)).distinct()
    own = stage(cells.join(own, group, "left"))
    refs = stage(references)
    edges = refs.select(*keys, F.col("cell").alias("_parent"), F.col("child").alias("cell")).distinct()
    known = own.join(edges.select(*keys, F.col("_parent").alias("cell")).distinct(), group, "left_anti")
    while True:
        waits = edges.join(known.select(*group, F.lit(True).alias("_done")), group, "left").groupBy(*keys, "_parent").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all")).withColumnRenamed("_parent", "cell")
        ready = waits.filter("_all").join(known, group, "left_anti").select(*group)
        boxes = own.join(ready, group, "left_semi").unionByName(placed_boxes(refs.join(ready, group, "left_semi"), known, keys).select(*group, *G.BOX))
        fresh = stage(boxes.groupBy(*group).agg(*[f(c).alias(c) for c, f in corners.items()]))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    rest = own.join(known, group, "left_anti")
    below = placed_boxes(refs.join(rest.select(*group), group, "left_semi"), known, keys).select(*group, *G.BOX)
    rest = rest.unionByName(below).groupBy(*group).agg(*[f(c).alias(c) for c, f in corners.items()])
    return known.unionByName(rest).filter("min_x is not null")


def placed_boxes(references: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each reference with the box of its child as it is placed, all elements of an array together."""
    angle, mag, flip = F.radians("rot"), F.coalesce("mag", F.lit(1.0)), F.when(F.col("mirror"), -1.0).otherwise(1.0)
    cos, sin = F.round(F.cos(angle), 12) * mag, F.round(F.sin(angle), 12) * mag
    child = boxes.select(*keys, F.col("cell").alias("child"), *[F.col(c).alias(f"_{c}") for c in G.BOX])
    x = [cos * F.col(f"_{a}") - sin * flip * F.col(f"_{b}") for a in ("min_x", "max_x") for b in ("min_y", "max_y")]
    y = [sin * F.col(f"_{a}") + cos * flip * F.col(f"_{b}") for a in ("min_x", "max_x") for b in ("min_y", "max_y")]
    far = lambda n, step: (F.greatest(n, F.lit(1)) - 1) * F.col(step)
    found = references.join(child, [*keys, "child"])
    none = F.lit(0.0)
    return found.select(
        *keys, "cell", "child",
        (F.least(*x) + F.col("dx") + F.least(none, far("cols", "sx"))).alias("min_x"), (F.least(*y) + F.col("dy") + F.least(none, far("rows", "sy"))).alias("min_y"),
        (F.greatest(*x) + F.col("dx") + F.greatest(none, far("cols", "sx"))).alias("max_x"), (F.greatest(*y) + F.col("dy") + F.greatest(none, far("rows", "sy"))).alias("max_y"),
    )


def reference_boxes(polygons: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, child, box) with one row for each reference: its child with all below it, as placed.

    Groups in which a reference turns by other than quarters are flattened, as the
    box of a turned box would be too large.
    """
    turned = references.filter(F.pmod(F.coalesce("rot", F.lit(0.0)), F.lit(90.0)) != 0).select(*keys).distinct()
    if not keys or turned.isEmpty():
        straight, rest = references, None
        if not keys and not turned.isEmpty():
            straight, rest = references.limit(0), references
    else:
        straight, rest = references.join(turned, keys, "left_anti"), references.join(turned, keys, "left_semi")
    found = placed_boxes(straight, cell_boxes(polygons if rest is None else polygons.join(turned, keys, "left_anti") if keys else polygons.limit(0), straight, keys), keys)
    if rest is None:
        return found
    rows = stage(rest.withColumn("_ref", F.monotonically_increasing_id()))
    deep = flatten(polygons.join(turned, keys, "left_semi") if keys else polygons, rest, keys).select(*keys, F.col("cell").alias("_root"), "points")
    one = rows.select(*keys, F.concat(F.lit("ref "), F.col("_ref").cast("string")).alias("cell"), F.col("child"), *[c for c in rows.columns if c not in (*keys, "cell", "child")])
    spots = instances(one, keys).filter(F.size("path") == 2).select(*keys, "root", "cell", "a", "b", "c", "d", "tx", "ty")
    move = lambda p: F.struct((F.col("a") * p["x"] + F.col("b") * p["y"] + F.col("tx")).alias("x"), (F.col("c") * p["x"] + F.col("d") * p["y"] + F.col("ty")).alias("y"))
    box = spots.join(deep.withColumnRenamed("_root", "cell"), [*keys, "cell"]).withColumn("_b", G.bbox(F.transform("points", move)))
    box = box.groupBy(*keys, "root").agg(*[f(f"_b.{c}").alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])
    own = rows.withColumn("root", F.concat(F.lit("ref "), F.col("_ref").cast("string"))).select(*keys, "root", "cell", "child").join(box, [*keys, "root"])
    return found.unionByName(own.select(*keys, "cell", "child", *G.BOX))


def attribute(pieces: DataFrame, boxes: DataFrame, keys: list[str], piece_id: str) -> DataFrame:
    """Child of the smallest box that holds a piece's centre (ties by name), else null.

    Boxes lie in grids of their own size: the step is an eighth of the power of two above a box's
    longer side, so a box is in 81 cells at most, and one large box leaves the others' cells as they
    are.  Of equal boxes the first by name is kept, and a cell's list ends at its first box that covers
    the whole cell, so that lists do not grow with boxes on top of each other.  A piece looks
    into one list of each grid and stays one row; there are no more grids than powers of two.
    Pieces of one id share the best of their boxes.
    """
    size = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    level = F.ceil(F.log2(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(2.0**-40)))).cast("int") - 3
    sized = boxes.groupBy(*keys, *G.BOX).agg(F.min("child").alias("child")).withColumn("_level", level).withColumn("_step", F.pow(F.lit(2.0), F.col("_level")))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("_step")), F.floor(F.col(hi) / F.col("_step"))))
    spread = sized.filter("min_x <= max_x and min_y <= max_y").withColumn("_tx", cells("min_x", "max_x")).withColumn("_ty", cells("min_y", "max_y"))
    spread = spread.withColumn("_box", F.struct(size.alias("s"), F.col("child").alias("c"), *G.BOX))
    cell = [*keys, "_level", "_tx", "_ty"]
    across = [F.col(f"min_{c}") <= F.col(f"_t{c}") * F.col("_step") for c in "xy"] + [F.col(f"max_{c}") >= (F.col(f"_t{c}") + 1) * F.col("_step") for c in "xy"]
    whole = spread.filter(across[0] & across[1] & across[2] & across[3]).groupBy(*cell).agg(F.min("_box").alias("_whole"))
    kept = spread.select(*cell, "_box").join(whole, cell, "left").filter("_whole is null or _box <= _whole")
    lists = stage(kept.groupBy(*cell).agg(F.sort_array(F.collect_list("_box")).alias("_boxes")))
    sizes = lists.groupBy("_level").agg(F.sum(F.size("_boxes"))).collect()
    if not sizes:
        return pieces.withColumn("child", F.lit(None).cast("string"))
    few = sum(r[1] for r in sizes) <= MOST_BROADCAST
    best = F.lit(None).cast(kept.schema["_box"].dataType)
    own = pieces.withColumn("_best", best)
    for k in sorted(r[0] for r in sizes):
        grid = lists.filter(F.col("_level") == k).drop("_level")
        own = own.withColumn("_tx", F.floor(F.col("cx") / 2.0**k)).withColumn("_ty", F.floor(F.col("cy") / 2.0**k))
        own = own.join(F.broadcast(grid) if few else grid, [*keys, "_tx", "_ty"], "left")
        holds = F.filter("_boxes", lambda b: F.col("cx").between(b["min_x"], b["max_x"]) & F.col("cy").between(b["min_y"], b["max_y"]))
        own = own.withColumn("_best", F.least("_best", F.try_element_at(holds, F.lit(1)))).drop("_tx", "_ty", "_boxes")
    # pieces without an id share nothing; they are dealt by their centres
    alone = F.when(F.col(piece_id).isNull(), F.pmod(F.xxhash64("cx", "cy"), F.lit(4096)))
    own = own.select(*pieces.columns, F.when(F.col(piece_id).isNotNull(), F.struct("_best.s", "_best.c")).alias("_best"), alone.alias("_alone"))
    best = F.min(F.when(F.col("_best.c").isNotNull(), F.col("_best"))).over(Window.partitionBy(*keys, piece_id, "_alone"))
    return own.withColumn("child", best["c"]).select(*pieces.columns, "child")


def piece_metrics(pieces: DataFrame, keys: list[str], unit_um: Column | float = 1.0, threshold: float = 0.01) -> DataFrame:
    """Counts, areas, box, cosmetic and flattened flags of regions (side, area, box, origin)."""
    unit = unit_um if isinstance(unit_um, Column) else F.lit(float(unit_um))
    own = pieces.withColumn("_area", F.col("area") * unit * unit)
    by = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
    found = own.groupBy(*keys, "origin").agg(
        by("added", F.lit(1)).alias("added_polygons"), by("removed", F.lit(1)).alias("removed_polygons"),
        by("added", F.col("_area")).alias("added_area_um2"), by("removed", F.col("_area")).alias("removed_area_um2"),
        *[(f(c) * F.first(unit)).alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)],
    )
    return found.withColumn("cosmetic", F.col("added_area_um2") + F.col("removed_area_um2") < threshold).withColumn("flattened", F.size("origin") > 1)


def geometry_entries(metrics: DataFrame) -> DataFrame:
    """Metrics as diff entries: element name, kind and the map of shown values."""
    kind = F.when((F.col("added_polygons") > 0) & (F.col("removed_polygons") == 0), "added").when((F.col("removed_polygons") > 0) & (F.col("added_polygons") == 0), "removed").otherwise("modified")
    name = F.concat_ws(":", "cell", F.format_string("L%d/%d", F.col("layer").cast("int"), F.col("datatype").cast("int")), F.when(F.size("origin") > 1, F.array_join(F.expr("slice(origin, 2, size(origin))"), "/")))
    text = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    box = F.when(F.col("min_x").isNotNull(), F.format_string("%.3f,%.3f,%.3f,%.3f", *[F.col(c).cast("double") for c in G.BOX]))
    pairs = [("added_polygons", F.col("added_polygons").cast("string")), ("removed_polygons", F.col("removed_polygons").cast("string")), ("added_area_um2", text("added_area_um2")), ("removed_area_um2", text("removed_area_um2")), ("bbox_um", box), ("origin_path", F.array_join("origin", "/")), ("flattened", F.col("flattened").cast("string"))]
    shown = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())
    none = F.lit(None).cast("map<string,string>")
    return metrics.withColumn("element", name).withColumn("kind", kind).withColumn("before", none).withColumn("after", shown).withColumn("position_changed", F.lit(False)).withColumn("section", F.lit(2))


def cell_entries(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells on one side only: removed ones first, then added."""
    from .diff import set_diff

    rows = set_diff(a.select(*keys, "cell"), b.select(*keys, "cell"))
    none = F.lit(None).cast("map<string,string>")
    return rows.select(*keys, F.concat(F.lit("cell:"), "cell").alias("element"), F.col("side").alias("kind"), F.lit(False).alias("cosmetic"), F.lit(False).alias("position_changed"), none.alias("before"), none.alias("after"), F.when(F.col("side") == "removed", 0).otherwise(1).alias("section"))


def cull(elements: DataFrame, view: tuple[float, float, float, float] | None, limit: int | None = None) -> DataFrame:
    """Elements whose box meets the view; an empty view takes all; ``limit`` stops early."""
    out = elements
    if view is not None and view[0] <= view[2] and view[1] <= view[3]:
        box = {k: F.lit(float(v)) for k, v in zip(G.BOX, view, strict=True)}
        out = elements.filter(G.intersects({c: F.col(c) for c in G.BOX}, box))
    return out if limit is None else out.limit(limit)


# --- wires --------------------------------------------------------------------
def wire_ghosts(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.001) -> DataFrame:
    """Wires of A without an equal wire in B: ends within ``tolerance``, in either order.

    Ends are ordered by x, then y, and both orders of B are laid into a grid twice the tolerance wide;
    each wire of A looks into the cells around its first end.
    """
    step = tolerance * 2
    cell = lambda c: F.floor(F.col(c) / step)
    ends = ["x1", "y1", "x2", "y2"]
    turned = b.select(*keys, F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    other = b.select(*keys, *ends).unionByName(turned).distinct()
    other = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in ends]).withColumn("_gx", F.floor(F.col("_x1") / step)).withColumn("_gy", F.floor(F.col("_y1") / step))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    own = a.withColumn("_id", F.struct(*keys, *ends))
    look = own.select("_id", *keys, *ends).distinct().withColumn("_gx", F.explode(F.transform(near, lambda d: cell("x1") + d))).withColumn("_gy", F.explode(F.transform(near, lambda d: cell("y1") + d)))
    close = F.lit(True)
    for c in ends:
        close = close & (F.abs(F.col(c) - F.col(f"_{c}")) < tolerance)
    hits = look.join(other, [*keys, "_gx", "_gy"]).filter(close).select("_id").distinct()
    return own.join(hits, "_id", "left_anti").drop("_id")


def net_wires(wires: DataFrame, nets: DataFrame, keys: list[str]) -> DataFrame:
    """Wires whose label is in the list of nets."""
    return wires.join(nets.select(*keys, F.col("net").alias("label")), [*keys, "label"], "left_semi")
