"""Stored scenes read by view, and decoded layouts kept by content."""

import random

from pyspark.sql import functions as F

from quillon.operators import layout as L
from quillon.plans import workflows as W
from quillon.sources import decoded, scenes
from quillon.sources import layout as S
from tests.test_layout import box


def boxes(spark, n):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        x, y, w, h = rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice((0, 1, 2, 40)), rng.choice((0, 1, 3))
        rows.append((k, "s" if k % 3 else None, x, y, x + w, y + h, "x" * 40))
    rows += [(n, "s", -1000.0, -1000.0, 1000.0, 1000.0, "whole"), (n + 1, "s", None, None, None, None, "none"), (n + 2, "t", 5.0, 5.0, 5.0, 5.0, "point")]
    return spark.createDataFrame(rows, "id long, scene string, min_x double, min_y double, max_x double, max_y double, more string")


def test_stored_scene_equals_cull(spark, tmp_path):
    own = boxes(spark, 3000).withColumn("place", F.lit("mine"))
    for keys in ([], ["scene"]):
        path = str(tmp_path / f"scene{len(keys)}")
        scenes.write(own, path, keys, files=4)
        assert spark.read.parquet(path).count() == 3003
        for view in ((-20.0, -20.0, 30.0, 10.0), (5.0, 5.0, 5.0, 5.0), (2000.0, 0.0, 2001.0, 1.0), None):
            want = sorted(r["id"] for r in L.cull(own, view).collect())
            assert sorted(r["id"] for r in scenes.view(spark, path, view).collect()) == want
    scenes.write(own.limit(0), str(tmp_path / "empty"), [])
    assert scenes.view(spark, str(tmp_path / "empty"), (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_the_curve_has_no_jumps(spark):
    at = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.expr("id div 64").alias("y"))
    cells = [(r["x"], r["y"]) for r in at.withColumn("d", scenes.along(F.col("x"), F.col("y"))).orderBy("d").collect()]
    assert len(set(cells)) == 4096 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(cells, cells[1:]))


def test_a_view_meets_few_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    own = boxes(spark, 40_000).repartition(8, F.hash("id"))
    view = (-30.0, -30.0, 20.0, 20.0)

    def met(path):
        total = hit = 0
        for file in glob.glob(f"{path}/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
                low, high = (lambda c: stats[c].min), (lambda c: stats[c].max)
                total += 1
                hit += low("min_x") <= view[2] and high("max_x") >= view[0] and low("min_y") <= view[3] and high("max_y") >= view[1]
        return hit, total

    own.write.option("parquet.block.size", 64 << 10).parquet(str(tmp_path / "plain"))
    scenes.write(own, str(tmp_path / "curve"), files=16, group_bytes=64 << 10)
    hit, total = met(str(tmp_path / "plain"))
    assert hit == total
    hit, total = met(str(tmp_path / "curve"))
    assert total >= 16 and hit * 3 <= total


def test_second_diff_decodes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    a, b = S.encode({"TOP": [box(0, 0, 10, 10)]}), S.encode({"TOP": [box(0, 0, 10, 10, 1, 1)]})

    def run(x, y):
        paired = spark.createDataFrame([("t.gds", bytearray(x), bytearray(y))], "path string, before binary, after binary")
        entries, _ = W.diff_files(paired, ["path"], W.Options(store=store))
        return sorted((r["element"], r["kind"]) for r in entries.collect())

    want = [("TOP:L1/0", "removed"), ("TOP:L1/1", "added")]
    count = lambda event: decoded.events(spark, store).filter(F.col("event") == event).count()
    assert run(a, b) == want and (count("stored"), count("used")) == (2, 0)
    rows = spark.read.parquet(f"{store}/rows").count()
    assert run(a, b) == want and (count("stored"), count("used")) == (2, 2)
    assert spark.read.parquet(f"{store}/rows").count() == rows
    c = S.encode({"TOP": [box(0, 0, 3, 3)]})
    run(a, c)
    assert (count("stored"), count("used")) == (3, 3)


def test_store_rules(spark, tmp_path):
    path = str(tmp_path / "store")
    blobs = lambda *names: spark.createDataFrame([(n, bytearray(n.encode() * size)) for n, size in names], "blob_sha string, content binary")

    def decode(df):
        return df.select("blob_sha", F.length("content").alias("n"), F.explode(F.sequence(F.lit(1), F.when(F.col("blob_sha") == "b", 0).otherwise(2))).alias("k")).filter("n > 2")

    get = lambda df, v="1": sorted(map(tuple, decoded.through(spark, path, df, decode, v).collect()))
    ab = blobs(("a", 10), ("a", 10), ("b", 2))
    assert get(ab) == [("a", 10, 1), ("a", 10, 2)]
    assert get(ab) == [("a", 10, 1), ("a", 10, 2)] and decoded.live(spark, path).count() == 2  # b has no rows and is known
    get(ab, "2")
    assert decoded.live(spark, path).count() == 4
    get(blobs(("c", 30), ("d", 5)))
    # newest: c and d (35 bytes, one call), then version 2 of a and b (12), then version 1 (12)
    assert decoded.evict(spark, path, 47).agg(F.sum("size")).first()[0] == 12
    assert decoded.live(spark, path).count() == 4 and decoded.evict(spark, path, 47).count() == 0
    left = {r["key"]: r["size"] for r in decoded.live(spark, path).collect()}
    newest = sorted((k for k, n in left.items() if n in (30, 5)))
    kept = newest if left[newest[0]] == 5 else []
    decoded.evict(spark, path, 6)
    assert sorted(r["key"] for r in decoded.live(spark, path).collect()) == kept[:1]
    assert get(ab) == [("a", 10, 1), ("a", 10, 2)]  # evicted, decoded again
    decoded.compact(spark, path, str(tmp_path / "small"))
    assert decoded.live(spark, str(tmp_path / "small")).count() == decoded.live(spark, path).count()
    n = len(decoded.events(spark, str(tmp_path / "small")).filter("event = 'used'").collect())
    path = str(tmp_path / "small")
    assert n == 0 and get(ab) == [("a", 10, 1), ("a", 10, 2)] and decoded.events(spark, path).filter("event = 'used'").count() == 2
