"""Schematic decoding and diffs on small texts."""

from pyspark.sql import functions as F

from quillon.operators import summary
from quillon.plans import workflows as W
from quillon.sources import schematic

HEAD = "v {xschem version=3.4.4 file_version=1.2}\n"
R1 = "C {devices/res.sym} 10 20 0 0 {name=R1 value=10k}\n"
C1 = "C {devices/capa.sym} 50 20 1 0 {name=C1 value=1p}\n"
NET = "N 0 0 10 0 {lab=NET1}\n"


def run(spark, a, b, **options):
    rows = [("f.sch", None if a is None else bytearray(a), None if b is None else bytearray(b))]
    paired = spark.createDataFrame(rows, "path string, before binary, after binary")
    entries, warnings = W.diff_files(paired, ["path"], W.Options(**options))
    return {r["element"]: r for r in entries.collect()}, [r["message"] for r in warnings.collect()]


def test_minimal(spark):
    blobs = spark.createDataFrame([("f", bytearray((HEAD + R1 + NET).encode()))], "path string, content binary")
    c = schematic.components(blobs, ["path"]).collect()
    assert [(r["name"], r["symbol"], r["params"], r["x"]) for r in c] == [("R1", "devices/res.sym", {"value": "10k"}, 10.0)]
    assert [r["net"] for r in schematic.nets(blobs, ["path"]).collect()] == ["NET1"]


def test_quoted_and_multiline_attributes(spark):
    text = HEAD + 'C {s.sym} -1.5 2 0 1 {name=M1 model="a b\\"c" code="x\ny" w=1}\n'
    blobs = spark.createDataFrame([("f", bytearray(text.encode()))], "path string, content binary")
    row = schematic.components(blobs, ["path"]).first()
    assert row["name"] == "M1" and row["params"]["code"] == "x\ny" and row["params"]["w"] == "1" and row["x"] == -1.5


def test_add_remove_modify(spark):
    b = HEAD + R1.replace("10k", "22k") + "C {devices/ind.sym} 0 0 0 0 {name=L1}\n" + NET.replace("NET1", "NET2")
    found, warnings = run(spark, (HEAD + R1 + C1 + NET).encode(), b.encode())
    assert {k: v["kind"] for k, v in found.items()} == {"R1": "modified", "C1": "removed", "L1": "added", "net:NET1": "removed", "net:NET2": "added"}
    assert not any(v["cosmetic"] for v in found.values()) and not warnings


def test_move_all_is_cosmetic(spark):
    moved = HEAD + R1.replace("10 20", "15 25") + C1.replace("50 20", "55 25")
    found, _ = run(spark, (HEAD + R1 + C1).encode(), moved.encode())
    assert set(found) == {"R1", "C1", "layout"} and all(v["cosmetic"] and v["position_changed"] for v in found.values())


def test_rename(spark):
    found, _ = run(spark, (HEAD + R1).encode(), (HEAD + R1.replace("R1", "R9")).encode())
    assert set(found) == {"R1 → R9"} and found["R1 → R9"]["kind"] == "modified"


def test_identical_and_empty(spark):
    assert run(spark, (HEAD + R1).encode(), (HEAD + R1).encode()) == ({}, [])


def test_invalid_sides_warn(spark):
    good = (HEAD + R1).encode()
    for a, b, side in ((b"\xff\xfe\x00\x80", good, "A"), (good, b"\xff\xfe\x00\x80", "B"), (b"<svg/>", good, "A")):
        found, warnings = run(spark, a, b)
        assert not found and len(warnings) == 1 and f"({side})" in warnings[0]


def test_missing_side(spark):
    good = (HEAD + R1).encode()
    assert {k: v["kind"] for k, v in run(spark, None, good)[0].items()} == {"R1": "added"}
    found, warnings = run(spark, None, good, missing_side="warn")
    assert not found and len(warnings) == 1


def test_summary_levels(spark):
    rows = [("f.sch", "added", "R1", False, None, {"value": "1"}), ("f.sch", "modified", "R2", False, {"value": "1", "x": "0"}, {"value": "2", "x": "5", "m": "3"}), ("f.sch", "modified", "R3", True, None, None), ("f.sch", "removed", "net:A", False, None, None)]
    entries = spark.createDataFrame(rows, "path string, kind string, element string, cosmetic boolean, before map<string,string>, after map<string,string>")
    files = spark.createDataFrame([("f.sch", "schematic"), ("Makefile", None)], "path string, format string")
    found = {r["path"]: r for r in summary.file_summaries(files, entries, ["path"], "full").collect()}
    assert found["Makefile"]["category"] == "unknown" and found["f.sch"]["category"] == "semantic"
    assert found["f.sch"]["counts"] == {"components_added": 1, "components_modified": 1, "nets_removed": 1}
    params = {d["element"]: {p["key"]: p["value"] for p in d["params"]} for d in found["f.sch"]["details"]}
    assert params == {"A": {}, "R1": {}, "R2": {"value": "1 → 2", "m": "(nuevo) → 3"}}
    assert summary.by_category(summary.file_summaries(files, entries, ["path"])).filter(F.col("category") == "semantic").first()["files"] == 1
