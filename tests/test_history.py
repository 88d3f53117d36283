"""History, paths, blobs, sinks and a real repository."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.functions import text as X
from quillon.operators import blobs, diff, history, render
from quillon.plans import workflows as W
from quillon.sources import repository

SCH = "v {xschem version=3.4.4 file_version=1.2}\nC {r.sym} 0 0 0 0 {name=R1 value=%s}\n"


def test_globs():
    import re

    hit = lambda p, s: re.search(P.glob_regex(p), s) is not None
    assert hit("amp_*.sch", "amp_ota.sch") and not hit("amp_*.sch", "filtro.sch") and hit("*.sch", "a/b.sch") and hit("a/**/x", "a/b/c/x") and hit("a/**/x", "a/x") and hit("[!a]?", "bc")
    good, bad = P.split_patterns(["a**", "x", "[z"])
    assert len(good) == 1 and len(bad) == 2


def test_invalid_globs_match_all(spark):
    df = spark.createDataFrame([("a",)], "p string")
    assert df.filter(P.path_filter(F.col("p"), ["[z"])).count() == 1


def test_closure_through_merges(spark):
    edges = [(i, i - 1) for i in range(1, 70)] + [(i, i - 2) for i in range(2, 70)]
    e = spark.createDataFrame(edges, "child int, parent int")
    start = spark.createDataFrame([(69, 69)], "start int, node int")
    assert history.closure(e, start).count() == 70


def test_ahead_behind_of_all_branches(spark, tmp_path):
    from quillon.plans import catalogue

    orders = [(c, c * 100 + k) for c in range(1, 13) for k in range(1, 9) if (c * k) % 5 != 1] + [(13, 1302), (14, 1401), (14, 1403)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for c in {c for c, _ in orders}:
        even, odd = (sorted(k for x, k in orders if x == c and k % 2 == b) for b in (0, 1))
        parent = dict(zip(even[1:], even)) | dict(zip(odd[1:], odd)) | ({odd[0]: even[0]} if even and odd else {})
        sides = []
        for node in (even[-1:], odd[-1:]):
            seen = set(node)
            while node := [parent[x] for x in node if x in parent]:
                seen |= set(node)
            sides.append(seen)
        if all(sides):
            want[str(c)] = len(sides[0] - sides[1]), len(sides[1] - sides[0])
    assert len(want) == 12
    assert {r["name"]: (r["ahead"], r["behind"]) for r in catalogue.queries()["ahead_behind"](spark, str(tmp_path)).collect()} == want


def test_log_rules(spark):
    commits = spark.createDataFrame([("m", 3, ["a", "b"]), ("r", 1, []), ("c", 2, ["r"])], "oid string, ts int, parents array<string>")
    changed = spark.createDataFrame([("c", "Makefile", "modified")], "oid string, path string, status string")
    refs = spark.createDataFrame([("m", "main"), ("m", "HEAD")], "oid string, ref string")
    found, files = history.log(commits, changed, refs, ["*.sch"])
    assert [r["oid"] for r in found.collect()] == ["m"] and files.count() == 0
    found, _ = history.log(commits, changed, refs)
    assert {r["oid"]: r["refs"] for r in found.collect()} == {"m": ["HEAD", "main"], "r": [], "c": []}


def test_blob_policies(spark):
    tree = spark.createDataFrame([("c", "a", "s1", 3), ("c", "big", "s2", 51 << 20)], "oid string, path string, blob_sha string, size long")
    body = spark.createDataFrame([("s1", bytearray(b"abc"))], "blob_sha string, content binary")
    want = spark.createDataFrame([("c", "a"), ("c", "big"), ("c", "none")], "oid string, path string")
    read = blobs.lookup(want, tree, body)
    assert {r["path"]: r["code"] for r in read.collect()} == {"a": "ok", "big": "large", "none": "not_found"}
    rows, warnings = blobs.apply_policy(read, "silent")
    assert {r["path"]: bytes(r["content"]) for r in rows.collect()} == {"a": b"abc", "big": b"", "none": b""} and warnings.count() == 1
    rows, warnings = blobs.apply_policy(read, "lenient")
    assert {r["path"]: r["content"] is None for r in rows.collect()} == {"a": False, "big": True, "none": True} and [w["code"] for w in warnings.collect()] == ["large"]


def test_changed_files(spark):
    tree = lambda rows: spark.createDataFrame(rows, "path string, blob_sha string")
    found = diff.changed_files(tree([("old", "1"), ("m", "2"), ("x", "9")]), tree([("new", "1"), ("m", "3"), ("y", "8")]))
    assert {(r["path"], r["status"], r["old_path"]) for r in found.collect()} == {("new", "renamed", "old"), ("m", "modified", None), ("x", "removed", None), ("y", "added", None)}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.timestamp_text(F.lit(0)).alias("zero"), X.timestamp_text(F.lit(1700000000)).alias("t"), X.upstream_phrase(F.lit(2), F.lit(1)).alias("up"), X.upstream_phrase(F.lit(0), F.lit(0)).alias("even"),
        X.counts_phrase(F.create_map(F.lit("nets_added"), F.lit(1), F.lit("other"), F.lit(2))).alias("c"), X.marker(F.lit("modified"), F.lit("a → b")).alias("m"), X.first_line(F.lit("a\r\nb")).alias("l"), X.xml_escape(F.lit("<a&'\">")).alias("x"),
    ).first()
    assert tuple(row) == ("desconocido", "2023-11-14 22:13", "2 adelante, 1 atrás", "al día", "1 net añadida, 2 other", "r", "a", "&lt;a&amp;&apos;&quot;&gt;")


def test_envelope_leaves_empty_fields_out(spark):
    df = spark.createDataFrame([("Makefile", "unknown", [], None)], "path string, category string, details array<string>, errors array<string>")
    assert render.envelope(df, "status/v1").first()["json"] == '{"schema":"status/v1","path":"Makefile","category":"unknown"}'


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "t@example.org")
    run("config", "user.name", "T")
    for k, value in enumerate(("10k", "22k", "33k")):
        (tmp_path / "amp.sch").write_text(SCH % value)
        (tmp_path / "notes.txt").write_text(str(k))
        run("add", "-A")
        run("commit", "-q", "-m", f"rev {k}\n\nbody")
    (tmp_path / "amp.sch").write_text(SCH % "44k")
    (tmp_path / "new.sch").write_text(SCH % "1")
    return str(tmp_path)


def test_repository(spark, repo):
    tables = repository.snapshot(spark, repo, P.SIZE_CAP)
    commits, files, warnings = W.log(spark, tables, W.Options(level="detail"))
    assert commits.count() == 3 and warnings.count() == 0
    rows = files.collect()
    assert len(rows) == 2 and all(r["path"] == "amp.sch" and r["counts"] == {"components_modified": 1} for r in rows)
    entries, _ = W.diff(spark, repo, "HEAD", commits.filter("message like 'rev 0%'").first()["oid"], "amp.sch")
    assert entries.count() == 1
    branch, summaries, _ = W.status(spark, repo)
    assert branch.first()["name"] == "main"
    assert {r["path"]: r["category"] for r in summaries.collect()} == {"amp.sch": "semantic", "new.sch": "semantic"}
    assert W.exit_code(summaries) == 1
    with pytest.raises(repository.RepositoryNotFound):
        repository.discover("/proc")


def test_names_starts_and_filters(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, text=True).stdout.strip()
    run("checkout", "-q", "--", "amp.sch")
    run("checkout", "-q", "-b", "side", "HEAD~1")
    run("commit", "-q", "--allow-empty", "--author", "Other <o@example.org>", "-m", "aside")
    run("checkout", "-q", "main")
    run("tag", "-a", "v1", "-m", "tag", "HEAD~1")
    run("merge", "-q", "--no-ff", "-m", "both", "side")
    own, refs = repository.commits(spark, repo), repository.refs(spark, repo)
    for name in ("HEAD", "main", "side", "v1", "HEAD~1", "HEAD^", "HEAD^2", "HEAD~2^", "HEAD^2~1", "v1^0", run("rev-parse", "HEAD")[:8], "HEAD~9", "none"):
        found = history.resolve(own, refs, name).first()
        assert (found and found["oid"]) == repository.resolve(repo, name), name
    assert own.count() == 5 and repository.commits(spark, repo, "side").count() == 3 and repository.commits(spark, repo, limit=2).count() == 2
    start = history.resolve(own, refs, "side")
    assert {r["oid"] for r in history.from_start(own, start).collect()} == set(run("rev-list", "side").split())
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert history.closure(ring, spark.createDataFrame([("s", "a")], "start string, node string")).count() == 3
    files = spark.createDataFrame([(r["oid"], "amp.sch") for r in own.collect()], "oid string, path string")
    assert history.narrow(own, files, author="other")[0].first()["message"] == "aside"
    entries = spark.createDataFrame([(run("rev-parse", "v1^{commit}"), "amp.sch", "R1", "added", False)], "oid string, path string, element string, kind string, cosmetic boolean")
    kept, _ = history.narrow(own, files, kinds=("schematic",), entries=entries, element="R1")
    assert [r["message"] for r in kept.collect()] == ["rev 1\n\nbody"]
    assert history.stat(entries, ["oid"]).first()["added"] == 1


def test_payload_views_and_drivers(spark):
    import json

    none = F.lit(None).cast("map<string,string>")
    rows = [("R1", "added", False, False), ("net:Vdd", "added", False, False), ("net:Old", "removed", False, False), ("net:M", "modified", False, False), ("layout", "modified", True, True), ("A → B", "modified", False, True)]
    entries = spark.createDataFrame(rows, "element string, kind string, cosmetic boolean, position_changed boolean").withColumn("before", none).withColumn("after", F.create_map(F.lit("value"), F.lit("10k")))
    notes = spark.createDataFrame([("careful",)], "message string")
    payload = json.loads(W.diff_payload(entries, notes, "f.sch").first()["json"])
    assert [c["name"] for c in payload["components"]] == ["A → B", "R1"] and payload["components"][1]["after"] == {"value": "10k"}
    assert (payload["file"], payload["warnings"], payload["nets_added"], payload["nets_removed"], payload["is_move_all"]) == ("f.sch", ["careful"], ["Vdd"], ["Old"], True)
    empty = json.loads(W.diff_payload(entries.limit(0), notes.limit(0), "f.sch").first()["json"])
    assert empty == {"file": "f.sch", "warnings": [], "components": [], "nets_added": [], "nets_removed": [], "is_move_all": False}
    scene = spark.createDataFrame([("f", "A", 0.0, 0.0, 1.0, 1.0), ("f", "A", 2.0, 0.0, 3.0, 5.0)], "file string, component string, min_x double, min_y double, max_x double, max_y double")
    report = entries.withColumn("file", F.lit("f"))
    assert W.diff_views(report, scene, scene, ["file"], "diff").filter("ghost").count() == 2
    assert W.diff_views(report, scene, scene, ["file"], "after").filter("ghost").count() == 0
    box = W.component_boxes(report, scene.withColumn("component", F.lit("B")), ["file"]).collect()
    assert [(r["element"], r["max_x"], r["max_y"]) for r in box] == [("A → B", 3.0, 5.0)]
    lengths = W.scene_length(spark.createDataFrame([("s", "polygon"), ("s", "text"), ("t", None)], "scene string, kind string"), ["scene"])
    assert {r["scene"]: (r["length"], r["is_empty"]) for r in lengths.collect()} == {"s": (2, False), "t": (0, True)}
    seen = lambda sides, keys, options: (sides.select(*keys, "side", "content"), sides.select(*keys, F.lit("w").alias("message")).limit(0))
    drivers = [W.Driver("up", lambda p: p.endswith(".a"), seen, lambda c: F.upper(c.cast("string")).cast("binary")), W.Driver("all", lambda p: F.lit(True), seen)]
    paired = spark.createDataFrame([("x.a", bytearray(b"q"), None), ("x.b", bytearray(b"q"), bytearray(b"r"))], "path string, before binary, after binary")
    found, _ = W.run_drivers(paired, ["path"], drivers)
    assert sorted((r["path"], r["side"], bytes(r["content"])) for r in found.collect()) == [("x.a", "a", b"Q"), ("x.b", "a", b"q"), ("x.b", "b", b"r")]


def test_command_line(spark, repo, capsys):
    import json

    from quillon.__main__ import main

    assert main(["diff", "HEAD~1", "HEAD", "amp.sch", "--repo", repo, "--format", "json"]) == 0
    assert [c["kind"] for c in json.loads(capsys.readouterr().out)["components"]] == ["modified"]
    assert main(["log", "-n", "2", "--repo", repo]) == 0 and capsys.readouterr().out.count("* ") == 2
    assert main(["log", "-n", "2", "--repo", repo, "--format", "json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["schema"] == "log/v1" and len(report["commits"]) == 2 and isinstance(report["warnings"], list)
    main(["status", "--repo", repo, "--format", "json"])
    report = json.loads(capsys.readouterr().out)
    assert report["schema"] == "status/v1" and report["branch"]["name"] and isinstance(report["files"], list) and isinstance(report["warnings"], list)
    assert main(["doctor", "--repo", repo]) == 0 and "device_library" in capsys.readouterr().out


def test_log_by_type_element_stat_and_metric(spark, repo, capsys):
    import json

    from quillon.__main__ import main

    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True)
    run("add", "amp.sch", "new.sch")
    run("commit", "-q", "--date", "@2200000000 +0000", "-m", "both")
    for vmax in ("3.28", "3.31"):
        with open(f"{repo}/sim.log", "w") as out:
            out.write(f"VMAX = {vmax}\nother = 1\n")
        run("add", "sim.log")
        run("commit", "-q", "-m", vmax)
    tables = repository.snapshot(spark, repo, P.SIZE_CAP)
    found = lambda **o: sorted(r["message"].splitlines()[0] for r in W.log_entries(tables, W.Options(**o))[0].collect())
    assert found(kinds=("layout",)) == []
    assert found(element="R1", limit=1) == ["both"]
    _, _, entries, _ = W.log_entries(tables, W.Options(kinds=("schematic",), limit=1))
    assert [(r["format"], r["added"], r["removed"], r["modified"]) for r in history.stat(entries, ["oid"]).collect()] == [("schematic", 1, 0, 1)]
    assert sorted(r["value"] for r in W.metric_history(tables, "sim.log", "vmax").collect()) == [3.28, 3.31]
    assert main(["log", "--repo", repo, "--element", "R1", "--stat", "-n", "2"]) == 0
    shown = capsys.readouterr().out
    assert "amp.sch, new.sch\n  schematic: +1 -0 ~1" in shown and len([x for x in shown.splitlines() if not x.startswith(" ")]) == 2
    assert main(["log", "--repo", repo, "--path-of", "sim.log", "--metric", "Vmax", "--format", "json"]) == 0
    assert sorted(v["value"] for v in json.loads(capsys.readouterr().out)["values"]) == [3.28, 3.31]
    assert main(["log", "--repo", repo, "--start", "nowhere"]) == 2
    assert "commit not found: nowhere" in capsys.readouterr().err
