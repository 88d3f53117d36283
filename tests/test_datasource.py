"""The repository data source: planned ranges, pushed filters, equal rows to the tables."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quillon.sources import datasource, repository


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "t@example.org")
    run("config", "user.name", "T")
    for k in range(7):
        for name in ("amp.sch", "lib/a b.sch", "lib/deep/[x].sch", "library.txt"):
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(f"{name} {k}\n" * (k + 1))
        run("add", "-A")
        run("commit", "-q", "-m", f"rev {k}\n\nbody\x1fwith separator")
    return str(root)


def load(spark, repo, table, **options):
    datasource.register(spark)
    return spark.read.format("repository").options(table=table, commits_per_partition=3, **options).load(repo)


def scanned(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_tables_equal(spark, repo):
    own = load(spark, repo, "commits")
    want = repository.commits(spark, repo)
    assert own.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect())) and own.count() == 7
    files = load(spark, repo, "files")
    want = repository.tree_entries(want, repo)
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, want.select(files.columns).collect())) and files.count() == 28
    assert load(spark, repo, "commits", limit=2, start="HEAD~1").count() == 2
    with pytest.raises(Exception, match="commit not found"):
        load(spark, repo, "commits", start="nowhere").count()
    with pytest.raises(ValueError, match="commit not found"):
        repository.commits(spark, repo, "nowhere")


def test_filters_reach_git(spark, repo, capsys):
    every = load(spark, repo, "files")
    rows = [r.asDict() for r in every.collect()]
    oid = rows[5]["oid"]
    cases = [
        (F.col("path") == "lib/deep/[x].sch", lambda r: r["path"] == "lib/deep/[x].sch"),
        (F.col("path").startswith("lib"), lambda r: r["path"].startswith("lib")),
        (F.col("path").startswith("lib/d"), lambda r: r["path"].startswith("lib/d")),
        (F.col("path").isin("amp.sch", "none") & (F.col("size") < 30), lambda r: r["path"] == "amp.sch" and r["size"] < 30),
        ((F.col("oid") == oid) & F.col("path").endswith(".sch"), lambda r: r["oid"] == oid and r["path"].endswith(".sch")),
        ((F.col("path") == "amp.sch") & (F.col("path") == "library.txt"), lambda r: False),
        (F.col("path") == "lib", lambda r: False),
    ]
    for condition, wanted in cases:
        got = sorted(tuple(r) for r in every.filter(condition).collect())
        assert got == sorted(tuple(r.values()) for r in rows if wanted(r)), condition
    one = every.filter(F.col("oid") == oid)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 4
    assert "PushedFilters: [EqualTo(path,amp.sch)]" in scanned(every.filter(F.col("path") == "amp.sch"), capsys)


def test_pushed_by_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = datasource.RepositoryReader("", "files", "HEAD", None, 10)
    asked = [EqualTo(("path",), "a"), GreaterThan(("size",), 3), StringStartsWith(("path",), "x")]
    assert list(reader.pushFilters(asked)) == [asked[1]]
    assert reader.values == {"path": {"a"}} and reader.prefixes == ["x"]


def test_blobs(spark, repo):
    found = load(spark, repo, "blobs").filter(F.col("path") == "amp.sch").collect()
    assert sorted(bytes(r["content"]) for r in found) == sorted(f"amp.sch {k}\n".encode() * (k + 1) for k in range(7))
    assert all(len(r["content"]) == r["size"] for r in found)
