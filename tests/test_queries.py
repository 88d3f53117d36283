"""Every query of the library against its SQL on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names():
    from quillon.plans import catalogue

    return sorted(catalogue.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb

    from quillon.plans import catalogue

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = db.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillon.streaming import commits

    src = str(tmp_path / "in")
    spark.createDataFrame([("c1", 1, "a.sch", "x", "added"), ("c1", 1, "a.sch", "x", "added"), ("c2", 5, "a.sch", "y", "modified")], "oid string, s long, path string, author string, status string").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for f, n in ((commits.distinct_commits, 2), (commits.activity, 0)):
        q = f(stream).writeStream.format("memory").queryName(f.__name__).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f.__name__)).start()
        q.awaitTermination(120)
        assert spark.table(f.__name__).count() == n
    q = commits.last_state(stream).writeStream.format("memory").queryName("last_state").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ls")).start()
    q.awaitTermination(120)
    assert [(r["path"], r["oid"], r["changes"]) for r in spark.table("last_state").collect()] == [("a.sch", "c2", 3)]
