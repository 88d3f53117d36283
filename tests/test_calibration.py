"""Nearest ends and zooms fitted by them, against brute force."""

import math
import random

from quillon.operators import calibration


def test_nearest_against_all_pairs(spark):
    rng = random.Random(5)
    # a crowded corner, far points, and points just inside and outside the radius
    points = [(f, rng.uniform(0, s), rng.uniform(0, s)) for f, s in (("a", 3), ("a", 300), ("b", 60)) for _ in range(120)] + [("a", 1000.0, 0.0), ("a", 2000.0, 0.0), ("c", 0.0, 0.0)]
    ends = [(f, rng.uniform(0, s), rng.uniform(0, s)) for f, s in (("a", 3), ("a", 300), ("b", 60)) for _ in range(150)] + [("a", 1007.999, 0.0), ("a", 2008.0, 0.0)] * 2 + [("c", 1.0, 0.0), ("c", -1.0, 0.0), ("c", None, 1.0)]
    want = {}
    for f, px, py in points:
        near = sorted((math.dist((px, py), e[1:]), *e[1:]) for e in ends if e[0] == f and e[1] is not None)
        if near and near[0][0] < 8:
            want[f, px, py] = near[0][1:]
    p = spark.createDataFrame(points + points[:5] + [("a", None, 1.0)], "file string, px double, py double")
    e = spark.createDataFrame(ends, "file string, x double, y double")
    for levels in (1, 3):
        rows = calibration.nearest(p, e, ["file"], levels=levels).collect()
        assert {(r["file"], r["px"], r["py"]): (r["x"], r["y"]) for r in rows} == want and len(rows) == len(want)
    assert ("a", 1000.0, 0.0) in want and ("a", 2000.0, 0.0) not in want and want["c", 0.0, 0.0] == (-1.0, 0.0)


def test_zoom_from_135_ends(spark):
    rng = random.Random(3)
    zoom, first = 0.4517, 0.4541  # the first zoom is half a per cent off, as texts give it
    ends = {(rng.randrange(-60, 60) * 10, rng.randrange(-60, 60) * 10) for _ in range(200)}
    ends = sorted(ends)[:135]
    drawn = [("s", round((x + 700) * zoom, 4), round((y + 650) * zoom, 4)) for x, y in ends]
    strays = [("s", rng.uniform(0, 600), rng.uniform(0, 600)) for _ in range(15)]
    wires = spark.createDataFrame([("s", float(x), float(y)) for x, y in ends] + [("empty", 1.0, 1.0)], "file string, x double, y double")
    start = spark.createDataFrame([("s", first, 700.0, 650.0), ("empty", 0.5, 0.0, 0.0)], "file string, zoom double, x_origin double, y_origin double")
    got = {r["file"]: r for r in calibration.fit_zoom(wires, spark.createDataFrame(drawn + strays, "file string, x double, y double"), start, ["file"], rounds=3).collect()}
    assert max(abs((x + 700) * (got["s"]["zoom"] - zoom)) for x, _ in ends) < 0.01
    assert got["s"]["error"] < 0.01 and got["s"]["pairs"] > 100
    assert (got["empty"]["zoom"], got["empty"]["pairs"], got["empty"]["error"]) == (0.5, 0, None)
