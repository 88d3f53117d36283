"""Renames by similarity against git, and reachability over segments against a walk."""

import random
import subprocess

import pytest

from quillon.operators import diff, history


def lines(rng, n):
    return [" ".join(rng.choice(["wire", "net", "cell", "pin", "gate", "R1", "C2"]) + str(rng.randrange(1000)) for _ in range(rng.randrange(1, 8))) for _ in range(n)]


def edited(rng, own, share):
    return [lines(rng, 1)[0] if rng.random() < share else x for x in own]


def git(folder, *args):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.name=x", "-c", "user.email=x@y", *args], capture_output=True, text=True, check=True).stdout


def test_similar_files_pair_as_in_git(spark, tmp_path):
    rng = random.Random(3)
    old, new = {}, {}
    for k in range(12):
        own = lines(rng, rng.randrange(20, 60))
        old[f"a/f{k}.sch"] = "\n".join(own) + "\n"
        new[f"b/f{k}.sch" if k % 2 else f"b/g{k}.sch"] = "\n".join(edited(rng, own, 0.08 * k)) + "\n"
    shared = lines(rng, 30)  # two old files compete for one new one
    old["x/one.sch"], old["x/two.sch"] = "\n".join(edited(rng, shared, 0.1)) + "\n", "\n".join(edited(rng, shared, 0.3)) + "\n"
    new["y/one.sch"] = "\n".join(shared) + "\n"
    old["same.txt"] = new["moved.txt"] = "equal\n" * 9
    old["kept.txt"], new["kept.txt"] = "a\n", "b\n"
    new["long.bin"], old["gone.bin"] = "z" * 5000, "q" * 300
    for files, remove in ((old, ()), (new, old)):
        for path in remove:
            (tmp_path / path).unlink()
        for path, text in files.items():
            (tmp_path / path).parent.mkdir(exist_ok=True)
            (tmp_path / path).write_text(text)
        if not (tmp_path / ".git").exists():
            git(tmp_path, "init", "-q")
        git(tmp_path, "add", "-A")
        git(tmp_path, "commit", "-qm", "x")
    want = set()
    for row in git(tmp_path, "diff", "--name-status", "-M50%", "HEAD~1", "HEAD").splitlines():
        code, *paths = row.split("\t")
        want.add((paths[-1], {"A": "added", "D": "removed", "M": "modified", "R": "renamed"}[code[0]], paths[0] if code[0] == "R" else None))
    sha = lambda t: f"{hash(t):x}"
    tree = lambda files: spark.createDataFrame([(p, sha(t)) for p, t in files.items()], "path string, blob_sha string")
    blobs = spark.createDataFrame([(sha(t), bytearray(t.encode())) for t in {*old.values(), *new.values()}], "blob_sha string, content binary")
    got = {tuple(r) for r in diff.changed_files(tree(old), tree(new), blobs).select("path", "status", "old_path").collect()}
    assert got == want and sum(s == "renamed" for _, s, _ in got) >= 8
    assert {s for _, s, _ in (tuple(r) for r in diff.changed_files(tree(old), tree(new)).select("path", "status", "old_path").collect())} == {"added", "removed", "modified", "renamed"}


def walk(edges, start):
    parents, seen, todo = {}, {start}, [start]
    for c, p in edges:
        parents.setdefault(c, []).append(p)
    while todo:
        for p in parents.get(todo.pop(), []):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_against_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = []
    for k in range(1, 60):
        edges.append((f"c{k:02d}", f"c{k - 1 if rng.random() < 0.75 else rng.randrange(k):02d}"))
        if rng.random() < 0.15:
            edges.append((f"c{k:02d}", f"c{rng.randrange(k):02d}"))
    edges = [*set(edges), ("loop", "loop"), ("p", "q"), ("q", "p")]
    table = spark.createDataFrame(edges, "child string, parent string")
    tips = [(f"t|{i}", f"c{rng.randrange(60):02d}", f"c{rng.randrange(60):02d}") for i in range(6)] + [("same", "c30", "c30"), ("lone", "elsewhere", "c05")]
    got = {r["name"]: (r["ahead"], r["behind"]) for r in history.ahead_behind(table, spark.createDataFrame(tips, "name string, local string, upstream string")).collect()}
    assert got == {n: (len(walk(edges, l) - walk(edges, u)), len(walk(edges, u) - walk(edges, l))) for n, l, u in tips}
    starts = [(n, l) for n, l, _ in tips] + [("cycle", "p")]
    found = {}
    for r in history.closure(table, spark.createDataFrame(starts, "start string, node string")).collect():
        found.setdefault(r["start"], set()).add(r["node"])
    assert found == {n: walk(edges, x) for n, x in starts}


def test_long_chain_is_one_segment(spark):
    chain = spark.range(1, 100_000).selectExpr("concat('c', id) as child", "concat('c', id - 1) as parent")
    index, between = history.segments(chain)
    assert index.select("segment").distinct().count() == 1 and between.count() == 0 and index.count() == 100_000
    tips = spark.createDataFrame([("m", "c99990", "c500")], "name string, local string, upstream string")
    assert tuple(history.ahead_behind(chain, tips).first()) == ("m", 99_490, 0)
