"""Booleans of polygon sets as whole regions, tile by tile.

Polygons are dealt to square tiles, whose side is a power of two chosen by the density of
each group, and shuffled once.  Within its task a tile of more than MOST_EDGES edges is quartered until it
is not, and its regions are joined again over the quarters; only a tile of more than MOST_TILE
edges is quartered between tasks.  Only tiles whose geometry differs between the sides are swept.  A tile's
sweep takes the tile's edges as lines of no weight, so that no polygon needs to be clipped beforehand.

Within a tile the trapezoids of the sweep that share an edge are one region.  A region that
ends at a tile's border leaves the stretch that it covers there; stretches of two tiles that
overlap join their regions, over any number of tiles.  Outlines come from the trapezoids'
edges: stretches that two of them share cancel, and the rest is followed from end to end.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..session import release, ship_package, stage

#: Polygons that a tile holds on average, edges that a sweep and a task's tile hold at most, and how often either is quartered.
TILE_POLYGONS = 256
MOST_EDGES = 4096
MOST_TILE = 1 << 22
QUARTERINGS = 8
#: Lengths below this are no length.
LEAST = 1e-7
DECIMALS = 9
#: Tiles up to which the list of those that differ goes to every task.
MOST_BROADCAST = 500_000

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
SEAM = T.StructType([T.StructField(k, t()) for k, t in (("axis", T.IntegerType), ("at", T.DoubleType), ("low", T.DoubleType), ("high", T.DoubleType), ("far", T.BooleanType))])
EDGE = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x1", "y1", "x2", "y2")])


# --- one tile ------------------------------------------------------------------
def edges_of(points: np.ndarray, offsets: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Non-vertical edges of rings laid end to end, left to right: x1, y1, x2, y2, side, weight."""
    size = np.diff(offsets)
    after = np.arange(1, len(points) + 1)
    after[offsets[1:][size > 0] - 1] = offsets[:-1][size > 0]
    p, q, own = points, points[after], np.repeat(side, size)
    right = p[:, 0] < q[:, 0]
    kept = p[:, 0] != q[:, 0]
    ends = np.where(right[:, None], np.hstack([p, q]), np.hstack([q, p]))
    return np.hstack([ends, own[:, None], np.where(right, 1, -1)[:, None]])[kept]


def crossings(e: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Abscissae where two edges cross within both."""
    if not np.any(slope):
        return np.zeros(0)
    level, out = e[:, 1] - slope * e[:, 0], []
    step = max(1, (1 << 21) // len(e))
    for i in range(0, len(e), step):
        s = slice(i, i + step)
        differ = slope[None, :] - slope[s, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (level[s, None] - level[None, :]) / differ
        inside = (differ != 0) & (x > np.maximum(e[s, 0][:, None], e[None, :, 0])) & (x < np.minimum(e[s, 2][:, None], e[None, :, 2]))
        out.append(x[inside])
    return np.concatenate(out)


def trapezoids(e: np.ndarray, tile: tuple[float, float, float, float]) -> np.ndarray:
    """Pieces in one side only, by slab and from low to high: slab, x1, x2, low and high at either, sign (1 added, -1 removed)."""
    x0, y0, x1, y1 = tile
    e = e[(e[:, 2] > x0) & (e[:, 0] < x1) & (np.minimum(e[:, 1], e[:, 3]) < y1)]
    if not len(e):
        return np.zeros((0, 8))
    e = np.vstack([e, [x0, y0, x1, y0, 2, 1], [x0, y1, x1, y1, 2, -1]])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    cuts = np.round(np.concatenate([e[:, 0], e[:, 2], crossings(e, slope)]), DECIMALS)
    cuts = np.concatenate([[x0], np.unique(cuts[(cuts > x0 + LEAST) & (cuts < x1 - LEAST)]), [x1]])
    first = np.searchsorted(cuts, e[:, 0] - LEAST / 10)
    stop = np.minimum(np.searchsorted(cuts, e[:, 2] - LEAST / 10), len(cuts) - 1)
    size = np.maximum(stop - first, 0)
    own = np.repeat(np.arange(len(e)), size)
    slab = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    at = lambda k, x: e[k, 1] + slope[k] * (x - e[k, 0])
    y = at(own, (cuts[slab] + cuts[slab + 1]) / 2)
    order = np.lexsort((y, slab))
    own, slab, y = own[order], slab[order], y[order]
    start = np.searchsorted(slab, slab)  # first place of the slab
    wound = []
    for side in range(3):
        total = np.concatenate([[0], np.cumsum(np.where(e[own, 4] == side, e[own, 5], 0))])
        wound.append(total[1:] - total[start])
    sign = ((wound[1] != 0).astype(int) - (wound[0] != 0)) * (wound[2] == 1)
    low, high = own[:-1], own[1:]
    real = (slab[1:] == slab[:-1]) & (y[1:] - y[:-1] > LEAST)
    slab, sign, low, high, floor, ceiling = slab[:-1][real], sign[:-1][real], low[real], high[real], y[:-1][real], y[1:][real]
    fresh = np.ones(len(slab), bool)
    fresh[1:] = (slab[1:] != slab[:-1]) | (sign[1:] != sign[:-1]) | (floor[1:] - ceiling[:-1] > LEAST)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(slab)) - 1
    low, high, slab, sign = low[begin], high[end], slab[begin], sign[begin]
    kept = sign != 0
    low, high, slab, sign = low[kept], high[kept], slab[kept], sign[kept]
    a, b = cuts[slab], cuts[slab + 1]
    return np.stack([slab, a, b, at(low, a), at(high, a), at(low, b), at(high, b), sign], axis=1)


def shared(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of trapezoids of one sign that share a stretch of a slab's border."""
    height = 2 * (max(t[:, 4].max(), t[:, 6].max()) - min(t[:, 3].min(), t[:, 5].min())) + 1
    # of the next slab's trapezoids, those that overlap are one after another
    first = np.searchsorted(t[:, 0] * height + t[:, 4], (t[:, 0] + 1) * height + t[:, 5] + LEAST, "right")
    stop = np.searchsorted(t[:, 0] * height + t[:, 3], (t[:, 0] + 1) * height + t[:, 6] - LEAST, "left")
    size = np.maximum(stop - first, 0)
    left = np.repeat(np.arange(len(t)), size)
    right = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    same = (t[left, 7] == t[right, 7]) & (t[right, 0] == t[left, 0] + 1) & (t[left, 2] == t[right, 1])
    return left[same], right[same]


def labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number that each of ``n`` nodes reaches over the pairs."""
    own = np.arange(n)
    while True:
        low = np.minimum(own[left], own[right])
        new = own.copy()
        np.minimum.at(new, own[left], low)
        np.minimum.at(new, own[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == own).all():
            return own
        own = new


def outline(t: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Directed edges around trapezoids of one region, the region to their left; shared borders are left out."""
    edges = [(a, la, b, lb) for _, a, b, la, _, lb, _, _ in t if (a, la) != (b, lb)] + [(b, hb, a, ha) for _, a, b, _, ha, _, hb, _ in t]
    events: dict[float, list[tuple[float, int]]] = {}
    for _, a, b, la, ha, lb, hb, _ in t:
        events.setdefault(b, []).extend([(lb, 1), (hb, -1)])  # upwards on the right
        events.setdefault(a, []).extend([(la, -1), (ha, 1)])
    for x, own in events.items():
        edges += [(x, p, x, q) if up > 0 else (x, q, x, p) for p, q, up in net(own)]
    return edges


def net(events: list[tuple[float, int]]) -> list[tuple[float, float, int]]:
    """Stretches of a line where directed pieces do not cancel."""
    out, depth, last = [], 0, 0.0
    for y, step in sorted(events):
        if depth and y - last > LEAST:
            out.append((last, y, depth))
        if not depth or y - last > LEAST:
            last = y
        depth += step
    return out


class Corners:
    """One point for all that lie within SAME of it, whichever tile worked them out."""

    SAME = 1e-5

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[float, float]] = {}

    def __call__(self, x: float, y: float) -> tuple[float, float]:
        i, j = round(x / self.SAME), round(y / self.SAME)
        for cell in ((i + di, j + dj) for di in (0, -1, 1) for dj in (0, -1, 1)):
            p = self.known.get(cell)
            if p is not None and abs(p[0] - x) < self.SAME and abs(p[1] - y) < self.SAME:
                return p
        self.known[i, j] = (x, y)
        return x, y


def rings_of(edges: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Edges followed into rings, corners on a straight line left out; the largest ring comes first.

    Where several edges leave a point, the first one clockwise from where the ring came
    bounds the same inside.
    """
    key = Corners()
    leaving: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for a, b, c, d in edges:
        p, q = key(a, b), key(c, d)
        if p != q:
            leaving.setdefault(p, []).append(q)
    rings = []
    while leaving:
        start = next(iter(leaving))
        ring, here, came = [], start, None
        while True:
            out = leaving.get(here)
            if not out:
                break
            if came is None or len(out) == 1:
                k = 0
            else:
                back = np.arctan2(came[1] - here[1], came[0] - here[0])
                turn = [(back - np.arctan2(q[1] - here[1], q[0] - here[0])) % (2 * np.pi) or 2 * np.pi for q in out]
                k = int(np.argmin(turn))
            ring.append(here)
            came, here = here, out.pop(k)
            if not out:
                del leaving[came]
            if here == start:
                break
        ring = straightened(ring)
        if len(ring) > 2:
            rings.append(ring)
    return sorted(rings, key=lambda r: -abs(signed_area(r)))


def straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    kept = ring
    while len(kept) > 2:
        n = len(kept)
        bend = [abs((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])) > LEAST for a, b, c in ((kept[i - 1], kept[i], kept[(i + 1) % n]) for i in range(n))]
        if all(bend):
            break
        kept = [p for p, b in zip(kept, bend, strict=True) if b]
    return kept


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in pairwise([*ring, ring[0]])) / 2


def seams_of(t: np.ndarray, tile: tuple[float, float, float, float]) -> list[list[tuple]]:
    """Of each trapezoid the stretches of the tile's border that it covers: axis, place, low, high, far side."""
    x0, y0, x1, y1 = tile
    out: list[list[tuple]] = [[] for _ in t]
    for k, (_, a, b, la, ha, lb, hb, _) in enumerate(t.tolist()):
        if a == x0 and ha - la > LEAST:
            out[k].append((0, x0, la, ha, False))
        if b == x1 and hb - lb > LEAST:
            out[k].append((0, x1, lb, hb, True))
        if abs(la - y0) < LEAST and abs(lb - y0) < LEAST:
            out[k].append((1, y0, a, b, False))
        if abs(ha - y1) < LEAST and abs(hb - y1) < LEAST:
            out[k].append((1, y1, a, b, True))
    return out


def tile_regions(edges: np.ndarray, tile: tuple[float, float, float, float], outlines: bool) -> list[tuple]:
    """(sign, number, area, box, seams, edges) of each region of a tile."""
    t = trapezoids(edges, tile)
    if not len(t):
        return []
    region = labels(len(t), *shared(t))
    area = (t[:, 2] - t[:, 1]) * ((t[:, 4] - t[:, 3]) + (t[:, 6] - t[:, 5])) / 2
    ids, code = np.unique(region, return_inverse=True)
    total = np.bincount(code, area)
    box = [np.full(len(ids), v) for v in (np.inf, np.inf, -np.inf, -np.inf)]
    for f, b, column in ((np.minimum, 0, t[:, 1]), (np.minimum, 1, np.minimum(t[:, 3], t[:, 5])), (np.maximum, 2, t[:, 2]), (np.maximum, 3, np.maximum(t[:, 4], t[:, 6]))):
        f.at(box[b], code, column)
    border = (t[:, 1] == tile[0]) | (t[:, 2] == tile[2]) | (np.minimum(t[:, 3], t[:, 5]) < tile[1] + LEAST) | (np.maximum(t[:, 4], t[:, 6]) > tile[3] - LEAST)
    seams: list[list[tuple]] = [[] for _ in ids]
    for k, own in zip(code[border].tolist(), seams_of(t[border], tile), strict=True):
        seams[k] += own
    around = [outline(t[code == k]) for k in range(len(ids))] if outlines else [[]] * len(ids)
    sign = t[ids, 7]
    return [(int(sign[k]), k, float(total[k]), tuple(float(b[k]) for b in box), seams[k], around[k]) for k in range(len(ids))]


def distinct(points: np.ndarray, offsets: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the polygons without repetitions on a side, and for each what equal polygons of both sides share."""
    size, known = np.diff(offsets), 0
    kept, content = [], []
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        rows = np.ascontiguousarray(points[offsets[own][:, None] + np.arange(n)].reshape(len(own), 2 * n))
        code = np.unique(rows.view(np.dtype((np.void, rows.itemsize * 2 * n))).ravel(), return_inverse=True)[1].ravel()
        first = np.unique(code * 2 + side[own], return_index=True)[1]
        kept.append(own[first])
        content.append(code[first] + known)
        known += int(code.max()) + 1
    return np.concatenate(kept), np.concatenate(content)


def outermost(points: np.ndarray, offsets: np.ndarray, box: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Those of one side's polygons that cover what all cover: of rectangles that share three sides the longest.

    Only where all are upright rectangles that turn the same way; else windings could cancel, and all are kept.
    """
    if not len(which) or np.any(offsets[which + 1] - offsets[which] != 4):
        return which
    p = points[offsets[which][:, None] + np.arange(4)]
    q = np.roll(p, -1, axis=1)
    still = p == q
    along, next_ = p[:, 1] - p[:, 0], p[:, 2] - p[:, 1]
    turn = along[:, 0] * next_[:, 1] - along[:, 1] * next_[:, 0]
    upright = np.all(still[:, 0] == still[:, 2]) and np.all(still[:, 1] == still[:, 3]) and np.all(still.sum(axis=2) == 1) and np.all(still[:, 0, 0] != still[:, 1, 0])
    if not upright or not (np.all(turn > 0) or np.all(turn < 0)):
        return which
    for free, sign in ((3, -1), (2, -1), (1, 1), (0, 1)):
        b = box[which]
        same = [b[:, k] for k in range(4) if k != free]
        order = np.lexsort((sign * b[:, free], *same))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in same], axis=0)
        which = which[order[fresh]]
    return which


def swept(points: np.ndarray, offsets: np.ndarray, side: np.ndarray, tile: tuple[float, float, float, float], most: int, outlines: bool) -> list[tuple]:
    """Regions of a tile as ``tile_regions`` gives them, swept by quarters of at most ``most`` edges."""
    points = points + 0.0  # no negative zeros
    kept, content = distinct(points, offsets, side)
    size = np.diff(offsets)
    box = np.hstack([np.minimum.reduceat(points, offsets[:-1]), np.maximum.reduceat(points, offsets[:-1])])
    code = np.zeros(len(size), np.int64)
    code[kept] = content
    a, b = kept[side[kept] == 0], kept[side[kept] == 1]
    if len(a) == len(b) and np.array_equal(np.sort(code[a]), np.sort(code[b])):
        return []
    kept = np.concatenate([outermost(points, offsets, box, a), outermost(points, offsets, box, b)])
    found: list[tuple] = []
    todo = [(kept, tile, 0)]
    while todo:
        own, (x0, y0, x1, y1), turn = todo.pop()
        lo, hi = box[own, :2], box[own, 2:]
        own = own[(lo[:, 0] < x1) & ((hi[:, 0] > x0) | (lo[:, 0] >= x0)) & (lo[:, 1] < y1) & ((hi[:, 1] > y0) | (lo[:, 1] >= y0))]
        right = side[own] == 1
        if np.array_equal(np.sort(code[own[right]]), np.sort(code[own[~right]])):
            continue
        if size[own].sum() > most and turn < QUARTERINGS:
            x, y = (x0 + x1) / 2, (y0 + y1) / 2
            todo += [(own, t, turn + 1) for t in ((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1))]
            continue
        starts = np.concatenate([[0], np.cumsum(size[own])])
        place = np.repeat(offsets[own] - starts[:-1], size[own]) + np.arange(starts[-1])
        found += tile_regions(edges_of(points[place], starts, side[own]), (x0, y0, x1, y1), outlines)
    return joined(found, tile)


def joined(found: list[tuple], tile: tuple[float, float, float, float]) -> list[tuple]:
    """Regions of quarters, those whose stretches overlap made one; only stretches on the tile's own border stay."""
    ends = {(0, tile[0]), (0, tile[2]), (1, tile[1]), (1, tile[3])}
    lines: dict[tuple[int, int, float], tuple[list, list]] = {}
    for k, r in enumerate(found):
        for axis, at, low, high, far in r[4]:
            if (axis, at) not in ends:
                lines.setdefault((r[0], axis, at), ([], []))[far].append((low, high, k))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for near, far in lines.values():
        if not near or not far:
            continue
        n, f = np.array(sorted(near)), np.array(sorted(far))
        first = np.searchsorted(n[:, 1], f[:, 0] + LEAST, "right")
        count = np.maximum(np.searchsorted(n[:, 0], f[:, 1] - LEAST, "left") - first, 0)
        left.append(np.repeat(f[:, 2], count).astype(np.int64))
        right.append(n[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()), 2].astype(np.int64))
    whole: dict[int, list[tuple]] = {}
    for root, r in zip(labels(len(found), np.concatenate(left), np.concatenate(right)).tolist(), found, strict=True):
        whole.setdefault(root, []).append(r)
    out = []
    for k, own in enumerate(whole.values()):
        box = tuple(f(r[3][c] for r in own) for c, f in enumerate((min, min, max, max)))
        out.append((own[0][0], k, sum(r[2] for r in own), box, [s for r in own for s in r[4] if s[:2] in ends], [e for r in own for e in r[5]]))
    return out


# --- tiles of a table ------------------------------------------------------------
def tiled(polygons: DataFrame) -> DataFrame:
    """A row for each tile (_tx, _ty of side _size) that a polygon's box meets."""
    box = polygons.withColumn("_box", G.bbox(F.col("points")))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"_box.{lo}") / F.col("_size")), F.greatest(F.ceil(F.col(f"_box.{hi}") / F.col("_size")) - 1, F.floor(F.col(f"_box.{lo}") / F.col("_size")))))
    return box.withColumn("_tx", span("min_x", "max_x")).withColumn("_ty", span("min_y", "max_y")).drop("_box")


def tile_sizes(polygons: DataFrame, keys: list[str], tile: float | None) -> DataFrame:
    """Polygons with the side of their group's tiles: a power of two, for about TILE_POLYGONS in each."""
    if tile is not None:
        return polygons.withColumn("_size", F.lit(2.0 ** np.ceil(np.log2(tile))))
    box = polygons.withColumn("_box", G.bbox(F.col("points")))
    extent = F.greatest(F.max("_box.max_x") - F.min("_box.min_x"), F.max("_box.max_y") - F.min("_box.min_y"), F.lit(1e-3))
    count = F.greatest(F.count("*") / float(TILE_POLYGONS), F.lit(1.0))
    sizes = box.groupBy(*keys).agg(F.pow(F.lit(2.0), F.ceil(F.log2(extent / F.sqrt(count)))).alias("_size"))
    return polygons.join(sizes, keys)


def differing_tiles(a: DataFrame, b: DataFrame, keys: list[str], tile: float | None) -> DataFrame:
    """Polygons of both sides by tile, of the tiles where the sides differ and that are small enough for a task.

    Their points are laid end to end as _xy.  Rounds of quartering read the polygons again; only lists of tiles are written.
    """
    both = a.select(*keys, "points", F.lit(0).alias("_side")).unionByName(b.select(*keys, "points", F.lit(1).alias("_side"))).filter(F.size("points") > 2)
    todo = tiled(tile_sizes(both, keys, tile).withColumn("_base", F.col("_size")))
    group, done = [*keys, "_base", "_size", "_tx", "_ty"], None
    digest = lambda s: F.sum(F.when(F.col("_side") == s, F.xxhash64("points").cast("decimal(38,0)")).otherwise(0))
    for turn in range(QUARTERINGS + 1):
        found = stage(todo.groupBy(*group).agg(digest(0).alias("_a"), digest(1).alias("_b"), F.sum(F.size("points")).alias("_edges")).filter("_a <> _b").select(*group, "_edges"))
        tiles, crowds = found.agg(F.count("*"), F.count(F.when(F.col("_edges") > MOST_TILE, 1))).first()
        few = F.broadcast if tiles <= MOST_BROADCAST else lambda df: df
        last = turn == QUARTERINGS or not crowds
        fit = found if last else found.filter(F.col("_edges") <= MOST_TILE)
        xy = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"]))).alias("_xy")
        if last or tiles > crowds:
            own = todo.join(few(fit.select(*group)), group, "left_semi").select(*group, "_side", xy)
            done = own if done is None else done.unionByName(own)
        if last:
            return done
        # each of these tiles has more than MOST_TILE edges, so they are few
        large = found.filter(F.col("_edges") > MOST_TILE).select(*group)
        large = F.broadcast(large) if crowds <= MOST_BROADCAST else large
        halves = todo.join(large, group, "left_semi").withColumnsRenamed({"_tx": "_px", "_ty": "_py"}).withColumn("_size", F.col("_size") / 2)
        todo = tiled(halves).filter("floor(_tx / 2) = _px and floor(_ty / 2) = _py").drop("_px", "_py")
    raise AssertionError


def xor(a: DataFrame, b: DataFrame, keys: list[str], tile: float | None = None, outlines: bool = False) -> DataFrame:
    """Regions of B without A (added) and of A without B (removed), by group of ``keys``.

    One row a region: piece (unique within its group), side, area and box, with ``outlines`` also
    points and holes.  ``a`` and ``b`` have points; the non-zero rule holds on each side.
    Regions that meet only in a point are apart.
    """
    ship_package(a.sparkSession)
    group = [*keys, "_base", "_size", "_tx", "_ty"]
    cut = differing_tiles(a, b, keys, tile)
    fields = {f.name: f for f in cut.schema.fields}
    schema = T.StructType([*[fields[k] for k in group], T.StructField("side", T.StringType()), T.StructField("piece", T.StringType()), T.StructField("area", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in G.BOX], T.StructField("seams", T.ArrayType(SEAM)), T.StructField("edges", T.ArrayType(EDGE))])
    kinds = pa.struct([("axis", pa.int32()), ("at", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("far", pa.bool_())])
    lines = pa.struct([(k, pa.float64()) for k in ("x1", "y1", "x2", "y2")])

    most = MOST_EDGES

    def work(table: pa.Table) -> pa.Table:
        flat = table["_xy"].combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]) // 2
        xy = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        size, tx, ty = (table[c][0].as_py() for c in ("_size", "_tx", "_ty"))
        found = swept(xy, offsets, table["_side"].to_numpy(), (tx * size, ty * size, (tx + 1) * size, (ty + 1) * size), most, outlines)
        name = f"{size:g}/{tx}/{ty}/"
        columns = [table[k].combine_chunks().take(pa.array(np.zeros(len(found), np.int64))) for k in group]
        columns += [pa.array(["added" if r[0] > 0 else "removed" for r in found], pa.string()), pa.array([name + str(r[1]) for r in found], pa.string()), pa.array([r[2] for r in found], pa.float64())]
        columns += [pa.array([r[3][c] for r in found], pa.float64()) for c in range(4)]
        columns += [pa.array([[dict(zip(("axis", "at", "low", "high", "far"), s, strict=True)) for s in r[4]] for r in found], pa.list_(kinds)), pa.array([[dict(zip(("x1", "y1", "x2", "y2"), s, strict=True)) for s in r[5]] for r in found], pa.list_(lines))]
        return pa.Table.from_arrays(columns, names=schema.names)

    parts = stage(cut.groupBy(*group).applyInArrow(work, schema))
    return merged(parts, keys, outlines)


def merged(parts: DataFrame, keys: list[str], outlines: bool) -> DataFrame:
    """Regions over tile borders become one where their stretches overlap."""
    node = F.struct(*keys, "piece")
    # a stretch lies within one tile as first dealt, whose number along the border is part of the key
    seams = parts.select(*keys, "side", "_base", node.alias("node"), F.explode("seams").alias("s")).select(*keys, "side", "_base", "node", "s.*")
    seams = seams.withColumn("_band", F.floor((F.col("low") + F.col("high")) / 2 / F.col("_base")))
    near, far = seams.filter("not far"), seams.filter("far").withColumnsRenamed({"low": "_low", "high": "_high", "node": "_node"})
    meet = near.join(far, [*keys, "side", "_base", "axis", "at", "_band"]).filter(F.least("high", "_high") - F.greatest("low", "_low") > LEAST)
    links = stage(meet.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct())
    box = [f(c).alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)]
    if links.isEmpty():
        own = parts
    else:
        own = parts.withColumn("node", node).join(components(links), "node", "left").withColumn("piece", F.coalesce("root.piece", "piece"))
    found = own.groupBy(*keys, "side", "piece").agg(F.sum("area").alias("area"), *box, *([F.flatten(F.collect_list("edges")).alias("edges")] if outlines else []))
    if not outlines:
        return found
    # one region's outline is one row whatever its length; its inner borders are gone already but for those at tiles
    schema = T.StructType([f for f in found.schema.fields if f.name != "edges"] + [T.StructField("points", RING), T.StructField("holes", T.ArrayType(RING))])

    def work(batches):
        for batch in batches:
            rows = [whole(e.as_py()) for e in batch.column("edges")]
            ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            as_rings = lambda r: [{"x": x, "y": y} for x, y in r]
            more = [pa.array([as_rings(r[0]) if r else [] for r in rows], ring), pa.array([[as_rings(h) for h in r[1:]] for r in rows], pa.list_(ring))]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["edges"]).columns, *more], names=schema.names)

    return found.mapInArrow(work, schema)


def whole(edges: list[dict]) -> list[list[tuple[float, float]]]:
    """Rings of a region's edges; those on tile borders that stand both ways cancel."""
    upright: dict[tuple[int, float], list[tuple[float, int]]] = {}
    rest = []
    for e in edges:
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        if x1 == x2 or y1 == y2:
            axis, at, p, q = (0, x1, y1, y2) if x1 == x2 else (1, y1, x1, x2)
            upright.setdefault((axis, at), []).extend([(min(p, q), 1 if p < q else -1), (max(p, q), -1 if p < q else 1)])
        else:
            rest.append((x1, y1, x2, y2))
    for (axis, at), events in upright.items():
        for p, q, up in net(events):
            a, b = (p, q) if up > 0 else (q, p)
            rest.append((at, a, at, b) if axis == 0 else (a, at, b, at))
    return rings_of(rest)


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, of every node with a link (a, b).

    Each round hangs larger neighbours on the smallest one, then smaller ones on the smallest of them.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    size_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, last = size_of(edges), None
    while now != last and now[0]:
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = two.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        again = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, edges = edges, stage(again.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now, last = size_of(edges), now
        del two, low, hung, least, again
        release(links.sparkSession, before)
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
