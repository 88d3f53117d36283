"""Layout decoding, flattening and booleans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.operators import layout as L
from quillon.plans import workflows as W
from quillon.sources import layout as S


def box(x1, y1, x2, y2, layer=1, datatype=0):
    return {"points": [(x1, y1), (x2, y1), (x2, y2), (x1, y2)], "layer": layer, "datatype": datatype}


def run(spark, a, b, threshold=0.01):
    paired = spark.createDataFrame([("t.gds", bytearray(a), bytearray(b))], "path string, before binary, after binary")
    entries, warnings = W.diff_files(paired, ["path"], W.Options(threshold_um2=threshold))
    return {r["element"]: r for r in entries.collect()}, [r["message"] for r in warnings.collect()]


def test_datatype_change(spark):
    a, b = S.encode({"TOP": [box(0, 0, 10, 10)]}), S.encode({"TOP": [box(0, 0, 10, 10, 1, 1)]})
    found, _ = run(spark, a, b)
    assert {k: v["kind"] for k, v in found.items()} == {"TOP:L1/0": "removed", "TOP:L1/1": "added"}
    assert found["TOP:L1/0"]["after"]["removed_area_um2"] == "100.000" and found["TOP:L1/0"]["after"]["bbox_um"] == "0.000,0.000,10.000,10.000"
    assert not any(v["cosmetic"] for v in found.values())
    found, _ = run(spark, a, b, 200.0)
    assert all(v["cosmetic"] for v in found.values())


def test_hierarchy(spark):
    top = [{"child": "INV", "at": (10, 10)}]
    a = S.encode({"TOP": top, "INV": [box(0, 0, 2, 1)]})
    b = S.encode({"TOP": top, "INV": [box(0, 0, 2, 1), box(2, 0, 3, 1)]})
    found, _ = run(spark, a, b)
    assert set(found) == {"INV:L1/0", "TOP:L1/0:INV"}
    assert found["TOP:L1/0:INV"]["after"]["bbox_um"] == "12.000,10.000,13.000,11.000" and found["TOP:L1/0:INV"]["after"]["flattened"] == "true"
    assert found["INV:L1/0"]["after"]["added_polygons"] == "1" and found["INV:L1/0"]["after"]["flattened"] == "false"


def test_identical_cells_and_errors(spark):
    a = S.encode({"TOP": [box(0, 0, 1, 1)], "OLD": [box(0, 0, 1, 1)]})
    assert run(spark, a, a) == ({}, [])
    found, _ = run(spark, a, S.encode({"TOP": [box(0, 0, 1, 1)], "NEW": [box(0, 0, 1, 1)]}))
    assert {k: v["kind"] for k, v in found.items()} == {"cell:OLD": "removed", "cell:NEW": "added"}
    found, warnings = run(spark, b"NOT_GDS", a)
    assert not found and "(A)" in warnings[0] and "GDSII" in warnings[0]
    found, warnings = run(spark, a[:-20], a)
    assert not found and len(warnings) == 1


def test_record_reader_forms():
    data = S.encode({"A": [{"points": [(0, 0), (10, 0)], "width": 2, "layer": 3}, {"child": "B", "at": (1, 2), "cols": 2, "rows": 3, "sx": 4, "sy": 5, "rot": 90, "mirror": True}, {"text": "vdd", "at": (1, 1), "layer": 7}], "B": [box(0, 0, 1, 1)]})
    rows = list(S.decode("s", data))
    path = next(r for r in rows if r["kind"] == "polygon" and r["cell"] == "A")
    assert sorted((p["x"], p["y"]) for p in path["points"]) == [(0, -1), (0, 1), (10, -1), (10, 1)]
    ref = next(r for r in rows if r["kind"] == "reference")
    assert (ref["cols"], ref["rows"], ref["sx"], ref["sy"], ref["rot"], ref["mirror"]) == (2, 3, 4.0, 5.0, 90.0, True)
    assert next(r for r in rows if r["kind"] == "label")["text"] == "vdd"
    for v in (1e-9, 0.001, 1.0, -2.5, 123456.0):
        assert S.real8(S.write_real8(v)) == pytest.approx(v, rel=1e-14)


@pytest.mark.parametrize("cells,refs,top", [(["ALPHA"], [], "ALPHA"), (["ZETA", "ALPHA", "BETA"], [], "ALPHA"), (["TOP", "INV", "GATE"], [("TOP", "INV"), ("INV", "GATE")], "TOP")])
def test_top_cell(spark, cells, refs, top):
    c = spark.createDataFrame([(x,) for x in cells], "cell string")
    r = spark.createDataFrame(refs, "cell string, child string")
    assert L.top_cells(c, r).first()["top"] == top


def test_tiles_keep_area(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 25.0, 7.0, "a"), (3.0, 3.0, 12.0, 30.0, "b")], "x1 double, y1 double, x2 double, y2 double, side string")
    whole = L.strip_metrics(L.rect_xor(rows.withColumn("g", F.lit(1)), ["g"]), ["g"], 0.0).first()
    tiled = L.rect_xor(L.tile_rects(rows, 10.0), ["tx", "ty"])
    total = {r["side"]: r["a"] for r in tiled.groupBy("side").agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("a")).collect()}
    assert total == {"added": whole["added_area"], "removed": whole["removed_area"]}


def test_arrays_rotation_and_cycles(spark):
    refs = spark.createDataFrame([("T", "C", 10.0, 0.0, 90.0, 1.0, False, 2, 1, 5.0, 0.0), ("C", "T", 0.0, 0.0, 0.0, 1.0, False, 1, 1, 0.0, 0.0)], "cell string, child string, dx double, dy double, rot double, mag double, mirror boolean, cols int, rows int, sx double, sy double")
    shape = spark.createDataFrame([("C", 1, 0, [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0)])], "cell string, layer int, datatype int, points array<struct<x:double,y:double>>")
    found = L.flatten(shape, refs, []).filter("cell = 'T'").collect()
    assert sorted((r["points"][0]["x"], r["points"][0]["y"]) for r in found) == [(10.0, 1.0), (15.0, 1.0)]


def test_flatten_to_any_depth(spark):
    refs = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 1.0, 0.0, 0.0, 1.0, False, 1, 1, 0.0, 0.0) for i in range(36)], "cell string, child string, dx double, dy double, rot double, mag double, mirror boolean, cols int, rows int, sx double, sy double")
    shapes = spark.createDataFrame([("c36", 1, 0, [(0.0, 0.0)])], f"cell string, layer int, datatype int, points {L.POINTS}")
    found = {r["cell"]: (r["points"][0]["x"], len(r["path"])) for r in L.flatten(shapes, refs, []).collect()}
    assert found == {f"c{i}": (36.0 - i, 37 - i) for i in range(37)}


def test_attribution_to_boxes_of_all_suppliers(spark, tmp_path):
    from quillon.plans import catalogue

    rng = np.random.default_rng(8)
    lines = [(int(o), n, int(rng.integers(1, 2000)), int(rng.integers(1, 600)), float(rng.integers(1, 51)), "A") for o in rng.integers(1, 3000, 60) for n in (1, 2)]
    lines = list({x[:2]: x for x in lines}.values())
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in range(1, 601)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    want, later = {}, 0
    for order, number, part, supp, quantity, _ in lines:
        cx, cy = part % 500 + (1 + supp % 20) / 2, order % 400 + (1 + int(quantity) % 15) / 2
        boxes = [(k * 37 % 480, k * 53 % 380, 5 + k % 40, 5 + k % 30, k) for k in range(1, 601)]
        hits = [(w * h, k) for x, y, w, h, k in boxes if x <= cx <= x + w and y <= cy <= y + h]
        want[order * 8 + number] = f"S{min(hits)[1]:09d}" if hits else None
        later += bool(hits) and min(hits)[1] > 200
    assert later > 10
    assert {r["id"]: r["child"] for r in catalogue.queries()["origin_attribution"](spark, str(tmp_path)).collect()} == want


def test_instances_apart_and_sides(spark):
    inv = [box(0, 0, 2, 1)]
    two = [{"child": "INV", "at": (0, 0)}, {"child": "INV", "at": (100, 0)}]
    # between two instances of one child: the cell's own
    found, _ = run(spark, S.encode({"TOP": two, "INV": inv}), S.encode({"TOP": [*two, box(50, 0, 51, 1)], "INV": inv}))
    assert set(found) == {"TOP:L1/0"}
    # a removed piece meets the references of side A, an added one those of side B
    a = S.encode({"TOP": [{"child": "INV", "at": (0, 0)}, box(100, 0, 101, 1)], "INV": inv})
    b = S.encode({"TOP": [{"child": "INV", "at": (100, 0)}], "INV": inv})
    found, _ = run(spark, a, b)
    assert {k: (v["after"]["added_polygons"], v["after"]["removed_polygons"]) for k, v in found.items()} == {"TOP:L1/0:INV": ("1", "1")}
    found, _ = run(spark, b, a)
    assert {k: (v["after"]["added_polygons"], v["after"]["removed_polygons"]) for k, v in found.items()} == {"TOP:L1/0:INV": ("1", "1")}


def test_whole_polygons_are_counted(spark):
    ell = {"points": [(0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30)], "layer": 1, "datatype": 0}
    frame = [box(50, 0, 90, 10), box(50, 30, 90, 40), box(50, 0, 60, 40), box(80, 0, 90, 40)]
    found, _ = run(spark, S.encode({"TOP": [box(200, 0, 201, 1)]}), S.encode({"TOP": [box(200, 0, 201, 1), ell, *frame]}))
    assert found["TOP:L1/0"]["after"]["added_polygons"] == "2" and found["TOP:L1/0"]["after"]["added_area_um2"] == "1700.000"


REFERENCE = "f int, cell string, child string, dx double, dy double, rot double, mag double, mirror boolean, cols int, rows int, sx double, sy double"


@pytest.mark.parametrize("angle", [90.0, 30.0])
def test_reference_boxes_against_flattening(spark, angle):
    refs = spark.createDataFrame([
        (1, "T", "M", 5.0, 7.0, angle, 2.0, True, 3, 2, 50.0, -40.0), (1, "T", "M", -300.0, 0.0, 0.0, 1.0, False, 1, 1, 0.0, 0.0), (1, "M", "L", 1.0, 2.0, 180.0, 1.0, False, 2, 1, 10.0, 0.0),
        (2, "X", "Y", 0.0, 0.0, 270.0, None, False, None, None, None, None), (2, "Y", "X", 9.0, 0.0, 0.0, 1.0, False, 1, 1, 0.0, 0.0), (1, "T", "EMPTY", 0.0, 0.0, 0.0, 1.0, False, 1, 1, 0.0, 0.0),
    ], REFERENCE)
    refs = refs.fillna({"cols": 1, "rows": 1, "sx": 0.0, "sy": 0.0})
    shape = spark.createDataFrame([(1, "L", 1, 0, [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0)]), (1, "M", 1, 0, [(0.0, 0.0), (1.0, 5.0), (2.0, 0.0)]), (2, "Y", 1, 0, [(1.0, 1.0), (2.0, 1.0), (2.0, 3.0)])], f"f int, cell string, layer int, datatype int, points {L.POINTS}")
    got = sorted((r["f"], r["cell"], r["child"], *(round(r[c], 6) for c in G.BOX)) for r in L.reference_boxes(shape, refs, ["f"]).collect())
    want = []
    deep = {}
    for r in L.flatten(shape, refs, ["f"]).collect():
        deep.setdefault((r["f"], r["cell"]), []).extend((p["x"], p["y"]) for p in r["points"])
    for r in refs.collect():
        if r["f"] == 2 and r["cell"] == "Y":
            continue  # in a cycle the box holds what is known below
        pts = deep.get((r["f"], r["child"]), [])
        t, m, s = np.radians(r["rot"]), r["mag"] or 1.0, -1.0 if r["mirror"] else 1.0
        spots = [(np.cos(t) * m * x - np.sin(t) * m * s * y + r["dx"] + i * r["sx"], np.sin(t) * m * x + np.cos(t) * m * s * y + r["dy"] + j * r["sy"]) for x, y in pts for i in range(r["cols"]) for j in range(r["rows"])]
        if spots:
            x, y = np.array(spots).T
            want.append((r["f"], r["cell"], r["child"], *(round(float(v), 6) for v in (x.min(), y.min(), x.max(), y.max()))))
    assert [g for g in got if g[:2] != (2, "Y")] == sorted(want)


def test_one_large_box_leaves_the_grid_of_the_others(spark):
    rng = np.random.default_rng(3)
    boxes = [(0.0, 0.0, 1e6, 1e6, "CHIP"), *((float(x), float(y), float(x + w), float(y + h), f"B{k}") for k, (x, y, w, h) in enumerate(rng.integers(1, 60, (300, 4)) * [900, 900, 1, 1])), (5.0, 5.0, 5.0, 5.0, "DOT")]
    pieces = [(k, float(x), float(y)) for k, (x, y) in enumerate([(5, 5), (-1, 5), *((b[0] + 1, b[1] + 1) for b in boxes[1:200]), *rng.integers(0, 60_000, (200, 2))])]
    got = {r["id"]: r["child"] for r in L.attribute(spark.createDataFrame([(1, *p) for p in pieces], "g int, id long, cx double, cy double"), spark.createDataFrame([(1, *b) for b in boxes], "g int, min_x double, min_y double, max_x double, max_y double, child string"), ["g"], "id").collect()}
    for k, cx, cy in pieces:
        hits = [((b[2] - b[0]) * (b[3] - b[1]), b[4]) for b in boxes if b[0] <= cx <= b[2] and b[1] <= cy <= b[3]]
        assert got[k] == (min(hits)[1] if hits else None)


@pytest.mark.parametrize("most", [500_000, 0])
def test_boxes_on_top_of_each_other_leave_lists_short(spark, monkeypatch, most):
    rng = np.random.default_rng(4)
    boxes = [(float(x), float(y), float(x + w), float(y + h), f"B{k:04d}") for k, (x, y, w, h) in enumerate(np.hstack([rng.integers(0, 20, (3000, 2)), rng.integers(17, 40, (3000, 2))]))]
    boxes += [(*b[:4], f"A{b[4]}") for b in boxes[:50]]  # equal boxes: the first by name
    pieces = [(k, float(x) / 2, float(y) / 2) for k, (x, y) in enumerate(rng.integers(-2, 120, (300, 2)))]
    pieces += [(k, 12.0 + k, 12.0) for k in range(20)] + [(None, 12.0, 12.0), (None, 13.0, 12.0)]
    kept = []
    monkeypatch.setattr(L, "MOST_BROADCAST", most)
    monkeypatch.setattr(L, "stage", lambda df, own=L.stage: kept.append(own(df)) or kept[-1])
    found = L.attribute(spark.createDataFrame([(1, *p) for p in pieces], "g int, id long, cx double, cy double"), spark.createDataFrame([(1, *b) for b in boxes], "g int, min_x double, min_y double, max_x double, max_y double, child string"), ["g"], "id")
    best = {}
    for k, cx, cy in pieces:
        hits = [((b[2] - b[0]) * (b[3] - b[1]), b[4]) for b in boxes if b[0] <= cx <= b[2] and b[1] <= cy <= b[3]]
        if hits and k is not None:
            best[k] = min(min(hits), best.get(k, min(hits)))
    want = sorted((k if k is not None else -1, best[k][1] if k in best else "") for k, _, _ in pieces)
    assert sorted((r["id"] if r["id"] is not None else -1, r["child"] or "") for r in found.collect()) == want
    # 2,925 boxes hold the point (20, 20); a list stops where the cell is covered
    assert kept and kept[0].agg(F.max(F.size("_boxes"))).first()[0] < 300


def test_view_functions(spark):
    one = spark.range(1).select(F.struct(F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(10.0).alias("max_x"), F.lit(0.0).alias("max_y")).alias("b"), F.struct(F.lit(1.0).alias("pan_x"), F.lit(2.0).alias("pan_y"), F.lit(2.0).alias("scale")).alias("v"))
    row = one.select(G.view_box(F.col("b"), 5, 5).alias("s"), G.to_world(F.col("v"), G.to_screen(F.col("v"), F.lit(3.0), F.lit(4.0))["x"], F.lit(10.0)).alias("w"), G.zoom(F.col("v"), F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("z"), F.size(G.arc(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(90.0))).alias("n")).first()
    assert row["s"] == "0.0000 0.0000 10.0000 1.0000" and row["w"]["x"] == 3.0 and row["z"]["scale"] == 2.0 and row["n"] == 19
