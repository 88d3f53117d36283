"""Whole regions of polygon booleans against rasters, and tiles against one tile."""

import numpy as np
import pytest

from quillon.operators import regions as R

SIZE = 40


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def rect(x1, y1, x2, y2):
    return ring((x1, y1), (x2, y1), (x2, y2), (x1, y2))


def table(spark, rows):
    return spark.createDataFrame(rows, f"g int, points array<struct<x:double,y:double>>")


def filled(points):
    """Cells of a raster whose middle lies in a ring of whole-number corners."""
    x, y = np.meshgrid(np.arange(SIZE) + 0.5, np.arange(SIZE) + 0.5, indexing="ij")
    wind = np.zeros((SIZE, SIZE), int)
    for p, q in zip(points, points[1:] + points[:1]):
        if p["x"] != q["x"]:
            inside = (min(p["x"], q["x"]) < x) & (x < max(p["x"], q["x"]))
            below = p["y"] + (x - p["x"]) * (q["y"] - p["y"]) / (q["x"] - p["x"]) < y
            wind += np.where(inside & below, 1 if p["x"] < q["x"] else -1, 0)
    return wind


def parts_of(mask):
    """Cells, by edge-connected part."""
    left, out = set(zip(*(v.tolist() for v in np.nonzero(mask)))), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            own.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(own)
    return out


def rectilinear(rng, n):
    rows = []
    for x, y, w, h in rng.integers(1, 12, (n, 4)):
        x, y = 2 * int(x), 2 * int(y)
        rows.append(rect(x, y, x + w, y + h) if rng.random() < 0.5 else ring((x, y), (x + 2 + w, y), (x + 2 + w, y + 1), (x + 1, y + 1), (x + 1, y + 2 + h), (x, y + 2 + h)))
    return rows


@pytest.mark.parametrize(("tile", "most"), [(64.0, 4096), (4.0, 4096), (None, 4096), (32.0, 24)])
def test_regions_against_raster(spark, monkeypatch, tile, most):
    monkeypatch.setattr(R, "MOST_EDGES", most)
    rng = np.random.default_rng(5)
    sides = {k: [(g, p) for g in range(4) for p in rectilinear(rng, 7)] for k in "ab"}
    sides["a"] += sides["a"][:5]  # repeated polygons cover nothing more
    found = R.xor(table(spark, sides["a"]), table(spark, sides["b"]), ["g"], tile, outlines=True).collect()
    for g in range(4):
        mask = {k: np.any([filled(p) != 0 for i, p in rows if i == g], axis=0) for k, rows in sides.items()}
        for side, own in (("added", mask["b"] & ~mask["a"]), ("removed", mask["a"] & ~mask["b"])):
            got = [r for r in found if r["g"] == g and r["side"] == side]
            want = parts_of(own)
            boxes = sorted((min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1, len(p)) for p in want)
            assert sorted((r["min_x"], r["min_y"], r["max_x"], r["max_y"], round(r["area"], 6)) for r in got) == boxes
            for r in got:
                outer, holes = [(p["x"], p["y"]) for p in r["points"]], [[(p["x"], p["y"]) for p in h] for h in r["holes"]]
                assert R.signed_area(outer) + sum(R.signed_area(h) for h in holes) == pytest.approx(r["area"]) and all(R.signed_area(h) < 0 for h in holes)


def test_shapes(spark):
    ell, u = ring((0, 0), (9, 0), (9, 3), (3, 3), (3, 9), (0, 9)), ring((20, 0), (29, 0), (29, 9), (26, 9), (26, 3), (23, 3), (23, 9), (20, 9))
    frame = [rect(0, 20, 12, 23), rect(0, 29, 12, 32), rect(0, 20, 3, 32), rect(9, 20, 12, 32)]
    corner = [rect(40, 0, 42, 2), rect(42, 2, 44, 4)]
    for tile in (64.0, 2.0):
        got = sorted(((r["area"], len(r["points"]), [len(h) for h in r["holes"]]) for r in R.xor(table(spark, [(1, rect(90, 90, 91, 91))]), table(spark, [(1, p) for p in [rect(90, 90, 91, 91), ell, u, *frame, *corner]]), ["g"], tile, outlines=True).collect()), key=str)
        assert got == sorted([(45.0, 6, []), (63.0, 8, []), (108.0, 4, [4]), (4.0, 4, []), (4.0, 4, [])], key=str)


def test_slanted_polygons_tiled_as_untiled(spark):
    rng = np.random.default_rng(11)

    def star(cx, cy, n):
        angle, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(2, 9, n)
        return ring(*zip(cx + far * np.cos(angle), cy + far * np.sin(angle)))

    a, b = ([(1, star(*rng.uniform(5, 40, 2), int(rng.integers(3, 9)))) for _ in range(25)] for _ in range(2))
    untiled = R.xor(table(spark, a), table(spark, b), ["g"], 64.0).collect()
    for tile in (8.0, 2.0):
        tiles = R.xor(table(spark, a), table(spark, b), ["g"], tile, outlines=True).collect()
        key = lambda rows: sorted((r["side"], round(r["min_x"], 4), round(r["max_y"], 4), round(r["area"], 4)) for r in rows if r["area"] > 1e-6)
        assert key(tiles) == key(untiled)
        for r in tiles:
            if r["area"] > 1e-3:
                rings = [[(p["x"], p["y"]) for p in x] for x in (r["points"], *r["holes"])]
                assert sum(map(R.signed_area, rings)) == pytest.approx(r["area"], abs=1e-4)


def test_equal_sides_and_empty_tables(spark):
    rows = table(spark, [(1, rect(0, 0, 5, 5)), (2, rect(0, 0, 1, 1)), (1, ring((0, 0), (1, 1)))])
    assert R.xor(rows, rows, ["g"]).count() == 0 == R.xor(rows.limit(0), rows.limit(0), ["g"], outlines=True).count()
    assert [r["area"] for r in R.xor(rows.limit(0), rows.filter("g = 2"), ["g"]).collect()] == [1.0]


def test_layer_regions_query(spark, tmp_path):
    from quillon.plans import catalogue

    rng = np.random.default_rng(6)
    lines = [(int(50 * o + o % 2), n, int(p), int(q), float(rng.integers(1, 51)), "A") for o in range(1, 7) for n in (1, 2) for p, q in rng.integers(1, 18, (6, 2))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    masks = {}
    for order, number, part, supp, quantity, _ in lines:
        x, y = part % 500, order % 400
        own = masks.setdefault((order % 50, number), {s: np.zeros((60, 420), bool) for s in "ab"})
        own["a" if order % 2 == 0 else "b"][x : x + 1 + supp % 20, y : y + 1 + int(quantity) % 15] = True
    want = {}
    for key, m in masks.items():
        added, removed = m["b"] & ~m["a"], m["a"] & ~m["b"]
        if added.any() or removed.any():
            want[key] = (len(parts_of(added)), len(parts_of(removed)), float(added.sum()), float(removed.sum()))
    got = {(r["cell"], r["layer"]): (r["added_polygons"], r["removed_polygons"], r["added_area"], r["removed_area"]) for r in catalogue.queries()["layer_regions"](spark, str(tmp_path)).collect()}
    assert got == want


def test_crowded_tiles_are_quartered_within_their_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sides = {k: [(g, rect(x, y, x + w, y + h)) for g in (1, 2) for x, y, w, h in rng.integers(1, 12, (150, 4)).tolist()] for k in "ab"}
    # in group 2 some turn the other way, so that windings cancel
    sides["b"] += [(2, rect(x, y, x + w, y + h)[::-1]) for x, y, w, h in rng.integers(1, 18, (8, 4)).tolist()]
    sides["b"] += [(1, rect(x, y, x + w, y + h)) for x, y, w, h in rng.integers(1, 18, (60, 4)).tolist()]
    sides["a"] += sides["a"][:20]
    staged = []
    monkeypatch.setattr(R, "MOST_EDGES", 24)
    monkeypatch.setattr(R, "stage", lambda df, own=R.stage: staged.append(df.columns) or own(df))
    found = R.xor(table(spark, sides["a"]), table(spark, sides["b"]), ["g"], 32.0).collect()
    for g in (1, 2):
        mask = {}
        for k, rows in sides.items():
            once = {tuple((q["x"], q["y"]) for q in p): p for i, p in rows if i == g}
            mask[k] = sum(filled(p) for p in once.values()) != 0
        for side, own in (("added", mask["b"] & ~mask["a"]), ("removed", mask["a"] & ~mask["b"])):
            want = sorted((min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1, len(p)) for p in parts_of(own))
            assert sorted((r["min_x"], r["min_y"], r["max_x"], r["max_y"], round(r["area"], 6)) for r in found if r["g"] == g and r["side"] == side) == want
    # polygons of a tile that a task holds are not written between rounds
    assert not any({"points", "_xy"} & set(c) for c in staged)


def test_rectangles_under_longer_ones_are_left_out():
    def kept(*rings):
        points = np.array([[(p["x"], p["y"]) for p in r] for r in rings]).reshape(-1, 2)
        box = np.array([[*np.min(x, axis=0), *np.max(x, axis=0)] for x in points.reshape(-1, 4, 2)])
        return sorted(R.outermost(points, np.arange(0, len(points) + 1, 4), box, np.arange(len(rings))).tolist())

    assert kept(rect(0, 0, 4, 2), rect(0, 0, 9, 2), rect(0, 0, 9, 1), rect(1, 0, 10, 2), rect(3, 0, 9, 2)) == [1, 3]
    assert kept(rect(0, 0, 4, 2), rect(0, 0, 9, 2)[::-1]) == [0, 1]
    assert kept(rect(0, 0, 4, 2), ring((0, 0), (9, 0), (9, 2), (0, 3))) == [0, 1]


def test_layer_regions_writes_no_polygons(spark, tmp_path, monkeypatch):
    from quillon.plans import catalogue

    rng = np.random.default_rng(7)
    lines = [(50 * int(o) + 1, 1, int(p), int(q), float(rng.integers(1, 51)), "A") for o, p, q in rng.integers(0, 30, (300, 3))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    mask = np.zeros((60, 420), bool)
    for order, _, part, supp, quantity, _ in lines:
        mask[part : part + 1 + supp % 20, order % 400 : order % 400 + 1 + int(quantity) % 15] = True
    staged = []
    monkeypatch.setattr(R, "MOST_EDGES", 24)
    monkeypatch.setattr(R, "stage", lambda df, own=R.stage: staged.append(df.columns) or own(df))
    row = catalogue.queries()["layer_regions"](spark, str(tmp_path)).first()
    assert (row["added_polygons"], row["removed_polygons"], row["added_area"]) == (len(parts_of(mask)), 0, float(mask.sum()))
    assert not any({"points", "_xy"} & set(c) for c in staged)


def test_tiles_too_large_for_a_task(spark, monkeypatch):
    rows = table(spark, [(1, rect(*b)) for b in ((0, 0, 12, 3), (2, 1, 9, 11), (20, 20, 25, 30), (21, 5, 28, 9), (7, 7, 23, 8))]).coalesce(1)
    monkeypatch.setattr(R, "MOST_TILE", 16)
    found = R.xor(rows.limit(0), rows, ["g"], 32.0).collect()
    assert sorted((r["area"], r["min_x"], r["max_x"]) for r in found) == [(50.0, 20.0, 25.0), (132.0, 0.0, 28.0)]


def test_rounds_of_quartering_write_no_polygons(spark, monkeypatch):
    rng = np.random.default_rng(12)
    sides = {k: [(g, rect(x, y, x + w, y + h)) for g in (1, 2) for x, y, w, h in zip(*rng.integers(1, 33, (2, 40)).tolist(), *rng.integers(1, 5, (2, 40)).tolist())] for k in "ab"}
    staged = []
    monkeypatch.setattr(R, "MOST_TILE", 200)
    monkeypatch.setattr(R, "stage", lambda df, own=R.stage: staged.append(df.columns) or own(df))
    found = R.xor(table(spark, sides["a"]).coalesce(1), table(spark, sides["b"]).coalesce(1), ["g"], 64.0).collect()
    for g in (1, 2):
        mask = {k: np.any([filled(p) != 0 for i, p in rows if i == g], axis=0) for k, rows in sides.items()}
        for side, own in (("added", mask["b"] & ~mask["a"]), ("removed", mask["a"] & ~mask["b"])):
            want = sorted((min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1, len(p)) for p in parts_of(own))
            assert sorted((r["min_x"], r["min_y"], r["max_x"], r["max_y"], round(r["area"], 6)) for r in found if r["g"] == g and r["side"] == side) == want
    assert sum("_edges" in c for c in staged) > 1  # tiles were quartered between tasks
    assert not any({"points", "_xy"} & set(c) for c in staged)
