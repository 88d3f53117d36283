"""Operators that design notes describe: regressions, tolerances, merges, caches, canonical texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES = {}
SQL = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- operators -------------------------------------------------------------------
def violation_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each rule category on two sides; more after than before is a regression."""
    a = before.groupBy(*keys).agg(F.count("*").alias("before"))
    b = after.groupBy(*keys).agg(F.count("*").alias("after"))
    both = a.join(b, keys, "full").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("regression", F.col("delta") > 0)


def match_state(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """State change of a comparison run: PASS to FAIL blocks, FAIL to FAIL warns."""
    both = before.withColumnRenamed("state", "before").join(after.withColumnRenamed("state", "after"), keys, "full")
    verdict = F.when((F.col("before") == "PASS") & (F.col("after") == "FAIL"), "block").when((F.col("before") == "FAIL") & (F.col("after") == "FAIL"), "warn").otherwise("ok")
    return both.withColumn("verdict", verdict)


def measurements(logs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(name, value) rows of the lines ``name = number``."""
    pattern = r"(?m)^\s*([A-Za-z_]\w*)\s*=\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
    return logs.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.lower("p.name").alias("name"), F.col("p.value").cast("double").alias("value"))


def within_tolerance(head: DataFrame, base: DataFrame, nominal: DataFrame | None, keys: list[str], atol: float = 0.0, rtol: float = 0.01) -> DataFrame:
    """Whether head values lie within atol + rtol * nominal of the nominal, which defaults to the base value."""
    both = head.withColumnRenamed("value", "head").join(base.withColumnRenamed("value", "base"), keys, "full")
    both = both.join(nominal.withColumnRenamed("value", "nominal"), keys, "left") if nominal is not None else both.withColumn("nominal", F.lit(None).cast("double"))
    both = both.withColumn("nominal", F.coalesce("nominal", "base"))
    return both.withColumn("ok", F.coalesce(F.abs(F.col("head") - F.col("nominal")) <= atol + rtol * F.abs("nominal"), F.lit(False)))


def compare_waves(a: DataFrame, b: DataFrame, keys: list[str], atol: float = 1e-9, rtol: float = 1e-3) -> DataFrame:
    """Largest error of wave B at A's times, B interpolated linearly, and whether all are close.

    Both waves go through one window a key: the last B point at or before, and the first at or
    after, each time of A.
    """
    both = a.select(*keys, "t", F.col("v").alias("va"), F.lit(None).cast("double").alias("tb"), F.lit(None).cast("double").alias("vb")).unionByName(b.select(*keys, "t", F.lit(None).cast("double").alias("va"), F.col("t").alias("tb"), F.col("v").alias("vb")))
    back = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("t").rangeBetween(0, Window.unboundedFollowing)
    for name, f, w in (("0", F.last, back), ("1", F.first, ahead)):
        both = both.withColumn(f"t{name}", f("tb", ignorenulls=True).over(w)).withColumn(f"v{name}", f("vb", ignorenulls=True).over(w))
    share = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    value = F.coalesce(F.col("v0") + share * (F.col("v1") - F.col("v0")), F.col("v0"), F.col("v1"))
    own = both.filter("va is not null").withColumn("error", F.abs(value - F.col("va")))
    return own.groupBy(*keys).agg(F.count("*").alias("points"), F.max("error").alias("max_error"), F.coalesce(F.bool_and(F.col("error") <= atol + rtol * F.abs("va")), F.lit(False)).alias("close"))


def merge_classes(ours: DataFrame, theirs: DataFrame, keys: list[str], fine: list[str], units: tuple[float, float] | None = None) -> DataFrame:
    """Class of each changed item of a three-way merge.

    ``keys`` name the item (a cell), ``fine`` its parts (layers): an item changed on one side merges; one changed on
    both sides in different parts merges; the same part on both sides conflicts.  Sides of different ``units`` are rejected whole.
    """
    own = lambda df, side: df.select(*keys, *fine).distinct().withColumn(side, F.lit(1))
    both = own(ours, "o").join(own(theirs, "t"), [*keys, *fine], "full")
    per = both.groupBy(*keys).agg(F.max("o").alias("o"), F.max("t").alias("t"), F.max(F.col("o") * F.col("t")).alias("same"))
    refused = F.lit(units is not None and units[0] != units[1])
    return per.select(*keys, F.when(refused, "rejected").when(F.col("same") == 1, "conflict").when((F.col("o") == 1) & (F.col("t") == 1), "auto_layers").when(F.col("o") == 1, "ours").otherwise("theirs").alias("merge_class"))


def text_change_class(lines: DataFrame, keys: list[str]) -> DataFrame:
    """cosmetic, mixed or functional by changed text lines: coordinate-only changes are cosmetic.

    ``lines`` has side and line; a component or wire line counts without its numbers.
    """
    bare = F.regexp_replace("line", r"^([CN] (?:\{[^}]*\} )?)(?:-?\d+(?:\.\d+)? )+", "$1")
    own = lines.withColumn("_bare", F.when(F.col("line").rlike("^[CN] "), bare).otherwise(F.col("line")))
    net = own.groupBy(*keys, "_bare").agg(F.sum(F.when(F.col("side") == "b", 1).otherwise(-1)).alias("n"), F.count("*").alias("c"))
    per = net.groupBy(*keys).agg(F.sum((F.col("n") != 0).cast("int")).alias("functional"), F.sum(((F.col("n") == 0) & (F.col("c") > 0)).cast("int")).alias("moved"))
    return per.select(*keys, F.when((F.col("functional") > 0) & (F.col("moved") > 0), "mixed").when(F.col("functional") > 0, "functional").otherwise("cosmetic").alias("change_class"))


def evictions(cache: DataFrame, budget: int, group: list[str]) -> DataFrame:
    """Entries that go so that each group's newest ones fit the budget: a running size from the last access."""
    order = Window.partitionBy(*group).orderBy(F.desc("last_access"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return cache.withColumn("kept_size", F.sum("size").over(order)).filter(F.col("kept_size") > budget)


def cache_key(*parts: str):
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def canonical_netlist(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Netlists with component lines sorted, blanks single and generated stamps dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\*+ *(generated|date|created|timestamp)"))
    head, body = F.filter(kept, lambda x: x.rlike(r"^[.*+]")), F.filter(kept, lambda x: ~x.rlike(r"^[.*+]"))
    return texts.select(*keys, F.array_join(F.concat(head, F.array_sort(body)), "\n").alias("canonical"))


def strip_timestamps(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return texts.select(*keys, F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("timestamp")), "\n").alias("text"))


def cell_fingerprints(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of each cell's box, area and polygon count by layer: renamed cells keep it."""
    from ..functions import geometry as G

    own = polygons.withColumn("_b", G.bbox(F.col("points"))).withColumn("_a", G.area(F.col("points")))
    per = own.groupBy(*keys, "cell", "layer", "datatype").agg(F.count("*").alias("n"), F.round(F.sum("_a"), 6).alias("a"), *[f(f"_b.{c}").alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])
    return per.groupBy(*keys, "cell").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("layer", "datatype", "n", "a", *G.BOX)))), 256).alias("fingerprint"))


def calibrate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares scale and offset by axis, pairs beyond two deviations left out once."""
    fit = lambda df: df.groupBy(*keys).agg(F.regr_slope("sx", "x").alias("scale"), F.regr_intercept("sx", "x").alias("offset"), F.sqrt(F.regr_syy("sx", "x") * (1 - F.regr_r2("sx", "x")) / F.count("*")).alias("sd"))
    first = pairs.join(fit(pairs), keys).filter(F.abs(F.col("sx") - F.col("scale") * F.col("x") - F.col("offset")) <= 2 * F.col("sd") + 1e-9)
    return fit(first.select(*pairs.columns))


# --- queries -----------------------------------------------------------------------
@query("""WITH a AS (SELECT event_type, count(*) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) AS after FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta, coalesce(after, 0) > coalesce(before, 0) AS regression FROM a FULL JOIN b USING (event_type)""")
def drc_delta(spark, d):
    e = read(spark, d, "events")
    return violation_delta(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 and event_type <> 'view'"), ["event_type"])


@query("""WITH h AS (SELECT l_partkey, round(avg(l_quantity), 6) AS head FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey, round(avg(l_quantity), 6) AS base FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(h.l_partkey, b.l_partkey) AS l_partkey, coalesce(abs(head - base) <= 0.5 + 0.1 * abs(base), FALSE) AS ok FROM h FULL JOIN b USING (l_partkey)""")
def metric_tolerance(spark, d):
    own = lambda r: read(spark, d, "lineitem").filter(f"l_orderkey % 2 = {r}").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return within_tolerance(own(0), own(1), None, ["l_partkey"], 0.5, 0.1).select("l_partkey", "ok")


@query("""WITH o AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), t AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1),
j AS (SELECT coalesce(o.l_partkey, t.l_partkey) AS l_partkey, o.l_partkey IS NOT NULL AS o, t.l_partkey IS NOT NULL AS t FROM o FULL JOIN t ON o.l_partkey = t.l_partkey AND o.l_linenumber = t.l_linenumber)
SELECT l_partkey, CASE WHEN bool_or(o AND t) THEN 'conflict' WHEN bool_or(o) AND bool_or(t) THEN 'auto_layers' WHEN bool_or(o) THEN 'ours' ELSE 'theirs' END AS merge_class FROM j GROUP BY l_partkey""")
def merge_class(spark, d):
    line = read(spark, d, "lineitem")
    return merge_classes(line.filter("l_orderkey % 2 = 0"), line.filter("l_orderkey % 2 = 1"), ["l_partkey"], ["l_linenumber"])


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(1 + event_id % 9) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s > 40""")
def cache_evictions(spark, d):
    own = read(spark, d, "events").select("user_id", F.col("event_id").alias("key"), F.col("ts").alias("last_access"), F.expr("1 + event_id % 9").alias("size"))
    return evictions(own, 40, ["user_id"]).select("user_id", F.col("key").alias("event_id"))


@query("""WITH m AS (SELECT l_partkey, l_linenumber AS step, max(l_shipdate) AS ts FROM lineitem GROUP BY ALL)
SELECT s.l_partkey AS l_partkey, s.step AS step, coalesce(s.ts > t.ts, TRUE) AS is_stale FROM m s LEFT JOIN m t ON s.l_partkey = t.l_partkey AND t.step = s.step + 1""")
def stale_files(spark, d):
    """Each step's file of a part is the source of the next step's."""
    from ..operators import history

    line = read(spark, d, "lineitem").withColumnRenamed("l_linenumber", "step")
    path = lambda step: F.concat_ws("/", step.cast("string"), F.col("l_partkey").cast("string"))
    touched = line.select(path(F.col("step")).alias("path"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("oid"))
    pairs = line.select("l_partkey", "step").distinct().select("l_partkey", "step", path(F.col("step")).alias("source"), path(F.col("step") + 1).alias("derived"))
    return history.stale(touched, pairs).select("l_partkey", "step", "is_stale")


@query("""WITH a AS (SELECT user_id, epoch(ts) AS t, value AS v FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, epoch(ts) AS t, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
p AS (SELECT a.user_id, a.t, a.v, (SELECT max(b.t) FROM b WHERE b.user_id = a.user_id AND b.t <= a.t) AS t0, (SELECT min(b.t) FROM b WHERE b.user_id = a.user_id AND b.t >= a.t) AS t1 FROM a),
q AS (SELECT p.*, b0.v AS v0, b1.v AS v1 FROM p LEFT JOIN b b0 ON b0.user_id = p.user_id AND b0.t = t0 LEFT JOIN b b1 ON b1.user_id = p.user_id AND b1.t = t1)
SELECT user_id, count(*) AS points, round(max(abs(coalesce(v0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END * (v1 - v0), v0, v1) - v)), 6) AS max_error FROM q GROUP BY user_id""")
def wave_compare(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6").alias("t"), F.col("value").alias("v"))
    b = e.filter("event_id % 2 = 1").groupBy("user_id", "t").agg(F.max("v").alias("v"))
    return compare_waves(e.filter("event_id % 2 = 0").drop("event_id"), b, ["user_id"]).select("user_id", "points", F.round("max_error", 6).alias("max_error"))
