"""Named queries over the star-schema tables, each with the same query in SQL.

The tables play the roles of revisions, commits, files and shapes: parts are
components, orders are commits, order lines are files or rectangles, events are
changes, conversations are revised files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import predicates as P
from ..functions import text as X
from ..operators import blobs, diff, history, layout, regions, render, summary
from ..session import fresh_path
from ..sources import scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- components ----------------------------------------------------------------
def revisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, d, "part")
    a = part.filter("p_partkey % 17 <> 0")
    b = part.filter("p_partkey % 13 <> 0").withColumn("p_retailprice", F.expr("p_retailprice + if(p_partkey % 11 = 0, 1, 0)")).withColumn("p_size", F.expr("p_size + if(p_partkey % 7 = 0, 1, 0)"))
    return a, b


REVISIONS = """
a AS (SELECT * FROM part WHERE p_partkey % 17 <> 0),
b AS (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS p_size,
  p_retailprice + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS p_retailprice FROM part WHERE p_partkey % 13 <> 0)"""
DIFF = f"""WITH {REVISIONS}, j AS (
  SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(a.p_brand, b.p_brand) AS p_brand,
    CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'modified' END AS kind,
    a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL AND a.p_size <> b.p_size AS position_changed,
    a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL AND (a.p_retailprice <> b.p_retailprice OR a.p_name <> b.p_name OR a.p_type <> b.p_type) AS changed
  FROM a FULL JOIN b ON a.p_partkey = b.p_partkey AND a.p_brand = b.p_brand
), d AS (SELECT *, position_changed AND NOT changed AS cosmetic FROM j WHERE kind <> 'modified' OR position_changed OR changed)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    a, b = revisions(spark, d)
    return diff.keyed_diff(a, b, ["p_brand", "p_partkey"], ["p_type", "p_name", "p_retailprice"], ["p_size"])


@query(f"{DIFF} SELECT p_partkey, p_brand, kind, cosmetic, position_changed FROM d")
def component_diff(spark, d):
    return entries(spark, d).select("p_partkey", "p_brand", "kind", "cosmetic", "position_changed")


@query(f"""{DIFF} SELECT p_brand AS path, CAST(count(*) FILTER (NOT cosmetic) AS BIGINT) AS semantic, CAST(count(*) FILTER (cosmetic) AS BIGINT) AS cosmetic,
  CAST(count(*) FILTER (NOT cosmetic AND kind = 'added') AS BIGINT) AS components_added, CAST(count(*) FILTER (NOT cosmetic AND kind = 'removed') AS BIGINT) AS components_removed,
  CAST(count(*) FILTER (NOT cosmetic AND kind = 'modified') AS BIGINT) AS components_modified,
  CASE WHEN count(*) FILTER (NOT cosmetic) > 0 THEN 'semantic' WHEN count(*) FILTER (cosmetic) > 0 THEN 'cosmetic' ELSE 'unchanged' END AS category FROM d GROUP BY p_brand""")
def component_diff_summary(spark, d):
    own = entries(spark, d).withColumn("element", F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).withColumnRenamed("p_brand", "path")
    return summary.summarize(own, ["path"]).select("path", "semantic", "cosmetic", "components_added", "components_removed", "components_modified", "category")


PARAMS = "SELECT p_partkey, unnest(['brand', 'type', 'cents', 'x']) AS key, unnest([p_brand, p_type, CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR), CAST(p_size AS VARCHAR)]) AS value FROM"


@query(f"""WITH {REVISIONS}, pa AS ({PARAMS} a), pb AS ({PARAMS} b)
SELECT coalesce(pa.p_partkey, pb.p_partkey) AS p_partkey, coalesce(pa.key, pb.key) AS key, pa.value AS before, pb.value AS after
FROM pa FULL JOIN pb ON pa.p_partkey = pb.p_partkey AND pa.key = pb.key WHERE pa.value IS DISTINCT FROM pb.value AND coalesce(pa.key, pb.key) <> 'x'""")
def param_diff(spark, d):
    def rows(df):
        pairs = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("cents"), F.round(F.col("p_retailprice") * 100).cast("long").cast("string"), F.lit("x"), F.col("p_size").cast("string"))
        return df.select("p_partkey", F.explode(pairs))

    a, b = revisions(spark, d)
    return diff.param_rows(rows(a), rows(b), ["p_partkey"])


@query(f"""WITH {REVISIONS}, na AS (SELECT DISTINCT p_brand, p_type AS net FROM a WHERE p_size < 25), nb AS (SELECT DISTINCT p_brand, p_type AS net FROM b WHERE p_size > 15)
SELECT *, 'added' AS side FROM (SELECT * FROM nb EXCEPT SELECT * FROM na) UNION ALL SELECT *, 'removed' AS side FROM (SELECT * FROM na EXCEPT SELECT * FROM nb)""")
def net_set_diff(spark, d):
    a, b = revisions(spark, d)
    own = lambda df, test: df.filter(test).select("p_brand", F.col("p_type").alias("net"))
    return diff.set_diff(own(a, "p_size < 25"), own(b, "p_size > 15"))


@query(f"""WITH {REVISIONS} SELECT a.p_brand AS p_brand, count(*) AS common, CAST(count(*) FILTER (a.p_size <> b.p_size AND a.p_retailprice = b.p_retailprice) AS BIGINT) AS moved,
  count(*) FILTER (a.p_size <> b.p_size AND a.p_retailprice = b.p_retailprice) > count(*) * 0.1 AS is_move_all FROM a JOIN b USING (p_partkey) GROUP BY a.p_brand""")
def move_all(spark, d):
    a, b = revisions(spark, d)
    return diff.move_all(a, b, ["p_brand"], ["p_partkey"], ["p_retailprice"], ["p_size"], share=0.1)


@query("""WITH o AS (SELECT p_brand, p_type, p_size, p_retailprice, p_name AS old, count(*) OVER (PARTITION BY p_brand, p_type, p_size, p_retailprice) AS n FROM part),
v AS (SELECT p_brand, p_type, p_size, p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS p_retailprice, p_name || '_v2' AS new FROM part),
w AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size, p_retailprice) AS n FROM v)
SELECT o.p_brand AS p_brand, old, new, old || ' → ' || new AS element FROM o JOIN w USING (p_brand, p_type, p_size, p_retailprice) WHERE o.n = 1 AND w.n = 1""")
def rename_detect(spark, d):
    part = read(spark, d, "part")
    added = part.withColumn("p_name", F.concat("p_name", F.lit("_v2"))).withColumn("p_retailprice", F.expr("p_retailprice + if(p_partkey % 7 = 0, 1, 0)"))
    return diff.rename_pairs(part, added, ["p_brand"], "p_name", ["p_type", "p_size", "p_retailprice"])


# --- changes, files and status -------------------------------------------------
CHANGES = """c AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN 'added' WHEN event_id % 4 = 1 THEN 'removed' ELSE 'modified' END AS kind,
  CASE WHEN event_id % 5 = 0 THEN 'net:n' || event_id WHEN event_id % 31 = 0 THEN 'layout' WHEN event_id % 6 = 2 THEN 'R' || event_id || ' → Q' ELSE 'R' || event_id END AS element,
  value < 30 AS cosmetic, 'u' || user_id || CASE user_id % 3 WHEN 0 THEN '.sch' WHEN 1 THEN '.GDS' ELSE '.txt' END AS path FROM events)"""
KEYS = {"components_added": "e = 0 AND kind = 'added'", "components_removed": "e = 0 AND kind = 'removed'", "components_modified": "e = 0 AND kind = 'modified' AND NOT contains(element, ' → ')", "components_renamed": "e = 0 AND kind = 'modified' AND contains(element, ' → ')", "nets_added": "e = 1 AND kind = 'added'", "nets_removed": "e = 1 AND kind = 'removed'", "nets_modified": "e = 1 AND kind = 'modified'"}
COUNTS = ", ".join(f"CAST(count(*) FILTER (NOT cosmetic AND {v}) AS BIGINT) AS {k}" for k, v in KEYS.items())
TOTALS = "CAST(count(*) FILTER (NOT cosmetic) AS BIGINT) AS semantic, CAST(count(*) FILTER (cosmetic) AS BIGINT) AS cosmetic"
CATEGORY = "CASE WHEN count(*) FILTER (NOT cosmetic) > 0 THEN 'semantic' WHEN count(*) FILTER (cosmetic) > 0 THEN 'cosmetic' ELSE 'unchanged' END"
KIND_OF = "CASE WHEN element = 'layout' THEN 2 WHEN starts_with(element, 'net:') THEN 1 ELSE 0 END AS e"


def changes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    kind = F.expr("case event_id % 4 when 0 then 'added' when 1 then 'removed' else 'modified' end")
    element = F.expr("case when event_id % 5 = 0 then concat('net:n', event_id) when event_id % 31 = 0 then 'layout' when event_id % 6 = 2 then concat('R', event_id, ' → Q') else concat('R', event_id) end")
    path = F.expr("concat('u', user_id, case user_id % 3 when 0 then '.sch' when 1 then '.GDS' else '.txt' end)")
    none = F.lit(None).cast("map<string,string>")
    return e.select("user_id", path.alias("path"), kind.alias("kind"), element.alias("element"), (F.col("value") < 30).alias("cosmetic"), none.alias("before"), none.alias("after"))


@query(f"WITH {CHANGES} SELECT user_id, {TOTALS}, {COUNTS}, {CATEGORY} AS category FROM (SELECT *, {KIND_OF} FROM c) GROUP BY user_id")
def file_category(spark, d):
    return summary.summarize(changes(spark, d), ["user_id"])


@query(f"""WITH {CHANGES} SELECT path, CASE WHEN path LIKE '%.sch' THEN 'schematic' WHEN path LIKE '%.GDS' THEN 'layout' ELSE 'unknown' END AS format,
  CASE WHEN path LIKE '%.txt' THEN 'unknown' ELSE {CATEGORY} END AS category FROM c WHERE regexp_full_match(path, 'u1.*\\.sch|u.2.*') GROUP BY path""")
def status_report(spark, d):
    found = changes(spark, d).filter(P.path_filter(F.col("path"), ["u1*.sch", "u?2*", "bad[range"]))
    files = found.select("path", P.driver_of(F.col("path")).alias("format")).distinct()
    return summary.file_summaries(files, found, ["path"]).select("path", "format", "category").orderBy("path")


@query(f"WITH {CHANGES}, f AS (SELECT path, CASE WHEN path LIKE '%.txt' THEN 'unknown' ELSE {CATEGORY} END AS category FROM c GROUP BY path) SELECT category, count(*) AS files FROM f GROUP BY category")
def status_counts(spark, d):
    found = changes(spark, d)
    files = found.select("path", P.driver_of(F.col("path")).alias("format")).distinct()
    return summary.by_category(summary.file_summaries(files, found, ["path"]))


@query(f"WITH {CHANGES}, n AS (SELECT path, {COUNTS} FROM (SELECT *, {KIND_OF} FROM c) GROUP BY path) SELECT path, concat_ws(', ', " + ", ".join(f"CASE WHEN {k} <> 0 THEN {k} || ' ' || CASE WHEN {k} = 1 THEN '{v[0]}' ELSE '{v[1]}' END END" for k, v in sorted(X.COUNT_LABELS.items())) + ") AS phrase FROM n WHERE " + " + ".join(KEYS) + " > 0")
def count_labels(spark, d):
    found = summary.summarize(changes(spark, d), ["path"]).withColumn("counts", summary.counts_map())
    return found.filter(F.size("counts") > 0).select("path", X.counts_phrase(F.col("counts")).alias("phrase"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, CASE WHEN event_id % 7 = 0 THEN 'desconocido' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS guarded FROM events")
def timestamp_text(spark, d):
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    shown = lambda s: F.when(s <= 0, "desconocido").otherwise(F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=s), "yyyy-MM-dd HH:mm"))
    own = read(spark, d, "events").withColumn("s", seconds)
    return own.select("event_id", shown(F.col("s")).alias("shown"), shown(F.expr("if(event_id % 7 = 0, 0, s)")).alias("guarded"))


COUNTS_JSON = " || ".join(f"CASE WHEN {k} <> 0 THEN ',\"{k}\":' || {k} ELSE '' END" for k in KEYS)


@query(f"""WITH {CHANGES}, k AS (SELECT *, {KIND_OF} FROM c), t AS (SELECT path, {CATEGORY} AS category, {COUNTS} FROM k GROUP BY path),
n AS (SELECT path, CASE WHEN e = 1 THEN element[5:] ELSE element END AS element, CASE e WHEN 1 THEN 'net_' ELSE 'component_' END || CASE WHEN e = 0 AND kind = 'modified' AND contains(element, ' → ') THEN 'renamed' ELSE kind END AS kind FROM k WHERE NOT cosmetic AND e < 2),
l AS (SELECT path, string_agg('{{"element":"' || element || '","kind":"' || kind || '","params":[]}}', ',' ORDER BY element, kind) AS s FROM n GROUP BY path),
j AS (SELECT t.*, s, CASE WHEN path LIKE '%.sch' THEN 'schematic' WHEN path LIKE '%.GDS' THEN 'layout' ELSE 'unknown' END AS format, {COUNTS_JSON} AS counts FROM t LEFT JOIN l USING (path))
SELECT '{{"schema":"status/v1","path":"' || path || '","format":"' || format || '","category":"' || CASE format WHEN 'unknown' THEN 'unknown' ELSE category END || '"'
  || CASE WHEN counts = '' THEN '' ELSE ',"counts":{{' || counts[2:] || '}}' END || CASE WHEN s IS NULL THEN '' ELSE ',"details":[' || s || ']' END || '}}' AS json FROM j""")
def json_status(spark, d):
    found = changes(spark, d)
    files = found.select("path", P.driver_of(F.col("path")).alias("format")).distinct()
    return render.envelope(summary.file_summaries(files, found, ["path"], "detail"), "status/v1")


# --- history -------------------------------------------------------------------
def commits(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    parents = F.expr("case o_orderkey % 10 when 0 then array() when 1 then array('p1', 'p2') else array('p1') end").cast("array<string>")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("oid"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("author"), parents.alias("parents"), F.col("o_orderkey"))


def files(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    path = F.expr("concat('cell', l_partkey, if(l_linenumber % 2 = 0, '.sch', '.txt'))")
    return line.select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("oid"), path.alias("path"))


def order_refs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    ref = F.expr("case when o_orderkey % 50 = 0 then array('HEAD', o_orderpriority, 'main') when o_orderkey % 3 = 0 then array(o_orderpriority) end")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("oid"), F.explode(ref).alias("ref"))


@query("""SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS oid, left(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), 7) AS short_id, CAST(o_custkey AS VARCHAR) AS author,
  CASE WHEN o_orderkey % 50 = 0 THEN array_to_string(list_concat(['HEAD'], list_sort([o_orderpriority, 'main'])), ',') WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS refs
  FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)""")
def commit_log(spark, d):
    found, _ = history.log(commits(spark, d), files(spark, d), order_refs(spark, d))
    return found.select("oid", X.short_id(F.col("oid")).alias("short_id"), "author", F.array_join("refs", ",").alias("refs"))


@query("""WITH t AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200),
f AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 AND starts_with('cell' || l_partkey, 'cell1') AND l_orderkey % 10 NOT IN (0, 1) GROUP BY l_orderkey)
SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS oid, o_orderkey % 10 = 1 AS is_merge, coalesce(n, 0) AS files FROM t LEFT JOIN f ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 1 OR n > 0""")
def commit_log_paths(spark, d):
    found, own = history.log(commits(spark, d), files(spark, d), order_refs(spark, d), ["cell1*.sch"], limit=200)
    n = own.groupBy("oid").agg(F.count("*").alias("files"))
    return found.join(n, "oid", "left").select("oid", "is_merge", F.coalesce("files", F.lit(0)).alias("files"))


LINE_ENTRIES = """c AS (SELECT l_orderkey AS oid, l_linestatus AS path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS kind,
  CASE WHEN l_partkey % 4 = 0 THEN 'net:' ELSE 'M' END || l_partkey AS element, l_quantity < 10 AS cosmetic FROM lineitem)"""


@query(f"WITH {LINE_ENTRIES} SELECT oid, path, {TOTALS}, {COUNTS}, {CATEGORY} AS category FROM (SELECT *, {KIND_OF} FROM c) GROUP BY oid, path")
def commit_files_summary(spark, d):
    line = read(spark, d, "lineitem")
    kind = F.expr("case l_returnflag when 'A' then 'added' when 'R' then 'removed' else 'modified' end")
    element = F.expr("concat(if(l_partkey % 4 = 0, 'net:', 'M'), l_partkey)")
    own = line.select(F.col("l_orderkey").alias("oid"), F.col("l_linestatus").alias("path"), kind.alias("kind"), element.alias("element"), (F.col("l_quantity") < 10).alias("cosmetic"))
    return summary.summarize(own, ["oid", "path"])


@query("""SELECT o_custkey, string_agg(r, ',' ORDER BY r <> 'HEAD', r) AS refs FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'HEAD' ELSE o_orderpriority END AS r FROM orders) GROUP BY o_custkey""")
def refs_annotated(spark, d):
    own = read(spark, d, "orders").select("o_custkey", F.expr("if(o_orderstatus = 'F', 'HEAD', o_orderpriority)").alias("ref"))
    return history.refs_by_oid(own, "o_custkey").select("o_custkey", F.array_join("refs", ",").alias("refs"))


BRANCHES = """e AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS b, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS p,
    first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS f FROM orders)"""


@query(f"""WITH RECURSIVE {BRANCHES}, g AS (SELECT o_orderkey AS child, coalesce(p, CASE WHEN b = 1 AND f <> o_orderkey THEN f END) AS parent FROM e),
s AS (SELECT o_custkey AS name, max(o_orderkey) FILTER (b = 0) AS l, max(o_orderkey) FILTER (b = 1) AS u FROM e GROUP BY o_custkey HAVING l IS NOT NULL AND u IS NOT NULL),
r AS (SELECT name, 'l' AS side, l AS node FROM s UNION SELECT name, 'u', u FROM s UNION SELECT r.name, r.side, g.parent FROM r JOIN g ON g.child = r.node WHERE g.parent IS NOT NULL),
w AS (SELECT name, node, bool_or(side = 'l') AS l, bool_or(side = 'u') AS u FROM r GROUP BY name, node)
SELECT CAST(name AS VARCHAR) AS name, CAST(count(*) FILTER (l AND NOT u) AS BIGINT) AS ahead, CAST(count(*) FILTER (u AND NOT l) AS BIGINT) AS behind FROM w GROUP BY name""")
def ahead_behind(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("_orders")
    e = spark.sql("""SELECT o_custkey, o_orderkey, o_orderkey % 2 AS b, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS p,
        first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS f FROM _orders""")
    edges = e.select(F.col("o_orderkey").alias("child"), F.coalesce("p", F.expr("case when b = 1 and f <> o_orderkey then f end")).alias("parent"))
    tips = e.groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.max(F.expr("if(b = 0, o_orderkey, null)")).alias("local"), F.max(F.expr("if(b = 1, o_orderkey, null)")).alias("upstream")).filter("local is not null and upstream is not null")
    return history.ahead_behind(edges, tips)


@query("""WITH RECURSIVE g AS (SELECT 's' || s_suppkey AS c, 'n' || s_nationkey AS p FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node FROM supplier UNION SELECT start, p FROM r JOIN g ON c = node) SELECT * FROM r""")
def ancestor_closure(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    edges = s.select(F.expr("concat('s', s_suppkey)").alias("child"), F.expr("concat('n', s_nationkey)").alias("parent")).unionByName(n.select(F.expr("concat('n', n_nationkey)").alias("child"), F.expr("concat('r', n_regionkey)").alias("parent")))
    starts = s.select(F.expr("concat('s', s_suppkey)").alias("start"), F.expr("concat('s', s_suppkey)").alias("node"))
    return history.closure(edges, starts)


@query("""SELECT coalesce(a.path, b.path) AS path, coalesce(a.status, b.status) AS status, a.old_path AS old_path FROM (
  SELECT n.path, 'renamed' AS status, g.path AS old_path FROM (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, md5(text) AS s, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 = 2) n
  JOIN (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, md5(text) AS s, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 = 1) g ON n.s = g.s AND n.k = g.k) a
FULL JOIN (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CASE doc_id % 3 WHEN 1 THEN 'removed' ELSE 'added' END AS status FROM documents WHERE doc_id % 3 <> 0) b ON a.path = b.path
WHERE b.path IS NULL OR a.path IS NOT NULL OR b.path NOT IN (
  SELECT g.path FROM (SELECT md5(text) AS s, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 = 2) n
  JOIN (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, md5(text) AS s, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 = 1) g ON n.s = g.s AND n.k = g.k)""")
def blob_dedup_rename(spark, d):
    own = read(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.md5(F.col("text")).alias("blob_sha"))
    return diff.changed_files(own.filter("doc_id % 3 <> 2"), own.filter("doc_id % 3 <> 1"))


@query(r"""WITH t AS (SELECT doc_id % 3 AS side, replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), chr(13) || chr(10), chr(10)) AS x FROM documents WHERE text <> ''),
o AS (SELECT DISTINCT side, md5(x) AS sha, length(x) AS size, x FROM t WHERE side > 0),
s AS (SELECT side, sha, size, span, sum(length(span)) AS n FROM (SELECT side, sha, size, unnest(regexp_extract_all(x, '[^\n]{0,63}\n|[^\n]{1,64}')) AS span FROM o) GROUP BY ALL),
m AS (SELECT a.sha AS old, b.sha AS new, sum(least(a.n, b.n)) / greatest(any_value(a.size), any_value(b.size)) AS score FROM s AS a JOIN s AS b ON a.span = b.span WHERE a.side = 1 AND b.side = 2 GROUP BY a.sha, b.sha)
SELECT old, new, floor(score * 1000 + 0.5) / 1000 AS score FROM m WHERE score >= 0.5""")
def blob_similarity(spark, d):
    text = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "\r\n", "\n")
    own = read(spark, d, "documents").filter("text <> ''").select((F.col("doc_id") % 3).alias("side"), F.md5(text).alias("blob_sha"), F.encode(text, "US-ASCII").alias("content"))
    of = lambda k: diff.spans(own.filter(F.col("side") == k).select("blob_sha", "content").dropDuplicates(["blob_sha"]))
    return diff.similar_blobs(of(1), of(2), 0.5).select("old", "new", (F.floor(F.col("score") * 1000 + 0.5) / 1000.0).alias("score"))


@query("""SELECT conv_id, turn, CAST(len(list_filter(list_distinct(n), lambda x: NOT list_contains(p, x))) AS BIGINT) AS lines_added, CAST(len(list_filter(list_distinct(p), lambda x: NOT list_contains(n, x))) AS BIGINT) AS lines_removed
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS n, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), chr(10)) AS p FROM conversations) WHERE p IS NOT NULL""")
def revision_line_diff(spark, d):
    return diff.line_diff(read(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_commit FROM orders GROUP BY o_custkey""")
def last_touch(spark, d):
    return history.last_touch(read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "last_commit")


# --- contents ------------------------------------------------------------------
@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'xschem' WHEN 1 THEN 'qucs' WHEN 2 THEN 'kicad_legacy' WHEN 3 THEN 'gds' ELSE 'unknown' END AS format, page_id % 5 = 3 OR url LIKE '%.gds' AS layout FROM pages""")
def format_detect(spark, d):
    head = F.expr("case page_id % 5 when 0 then binary('v {xschem version=3.4.4') when 1 then binary('<Qucs Schematic 0.0.19>') when 2 then binary('EESchema Schematic File Version 4') when 3 then x'00060002' else binary('') end")
    own = read(spark, d, "pages").select("page_id", "url", F.concat(head, F.col("html").cast("binary")).alias("content"))
    return own.select("page_id", P.detect_format(F.col("content")).alias("format"), P.accepts_layout(F.col("content"), F.col("url")).alias("layout"))


@query("""SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'not_found' WHEN n_chars > 2000 THEN 'large' ELSE 'ok' END AS code, count(*) AS files, CAST(sum(CASE WHEN doc_id % 9 <> 0 AND n_chars <= 2000 THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM documents GROUP BY ALL""")
def size_guard(spark, d):
    docs = read(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    tree = docs.filter("doc_id % 9 <> 0").select(F.lit("c").alias("oid"), path, path.alias("blob_sha"), F.col("n_chars").alias("size"))
    body = docs.select(path.alias("blob_sha"), F.col("text").alias("content"))
    found = blobs.lookup(docs.select(F.lit("c").alias("oid"), path, "source"), tree, body, 2000)
    return found.groupBy("source", "code").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"))


# --- shapes --------------------------------------------------------------------
def rects(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    x, y = F.expr("double(l_partkey % 500)"), F.expr("double(l_orderkey % 400)")
    return line.select(F.expr("l_orderkey % 50").alias("cell"), F.col("l_linenumber").alias("layer"), x.alias("x1"), y.alias("y1"), (x + F.expr("1 + l_suppkey % 20")).alias("x2"), (y + F.expr("1 + int(l_quantity) % 15")).alias("y2"), F.expr("if(l_orderkey % 2 = 0, 'a', 'b')").alias("side"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


RECTS = """q AS (SELECT l_orderkey % 50 AS cell, l_linenumber AS layer, CAST(l_partkey % 500 AS BIGINT) AS x1, CAST(l_orderkey % 400 AS BIGINT) AS y1,
  CAST(l_partkey % 500 + 1 + l_suppkey % 20 AS BIGINT) AS x2, CAST(l_orderkey % 400 + 1 + CAST(floor(l_quantity) AS BIGINT) % 15 AS BIGINT) AS y2, CASE WHEN l_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS side,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem)"""


def corners(x1, y1, x2, y2):
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def rings(df: DataFrame) -> DataFrame:
    return df.withColumn("points", corners(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))


@query(f"WITH {RECTS} SELECT cell, layer, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area, count(*) AS polygons FROM q GROUP BY cell, layer")
def polygon_area(spark, d):
    return rings(rects(spark, d)).groupBy("cell", "layer").agg(F.sum(G.area(F.col("points"))).alias("area"), F.count("*").alias("polygons"))


@query(f"WITH {RECTS} SELECT layer, CAST(min(x1) AS DOUBLE) AS min_x, CAST(min(y1) AS DOUBLE) AS min_y, CAST(max(x2) AS DOUBLE) AS max_x, CAST(max(y2) AS DOUBLE) AS max_y FROM q GROUP BY layer")
def bbox_union(spark, d):
    box = rings(rects(spark, d)).withColumn("b", G.bbox(F.col("points")))
    return box.groupBy("layer").agg(*[f(f"b.{c}").alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])


@query(f"""WITH {RECTS}, g AS (SELECT cell, layer, side, x, unnest(range(y1, y2)) AS y FROM (SELECT cell, layer, side, y1, y2, unnest(range(x1, x2)) AS x FROM q)),
u AS (SELECT cell, layer, x, y, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM g GROUP BY ALL), w AS (SELECT * FROM u WHERE a <> b)
SELECT cell, layer, CAST(count(*) FILTER (b) AS DOUBLE) AS added_area, CAST(count(*) FILTER (a) AS DOUBLE) AS removed_area, CAST(min(x) AS DOUBLE) AS min_x, CAST(min(y) AS DOUBLE) AS min_y,
  CAST(max(x) + 1 AS DOUBLE) AS max_x, CAST(max(y) + 1 AS DOUBLE) AS max_y, count(*) < 500 AS cosmetic FROM w GROUP BY cell, layer""")
def layer_xor(spark, d):
    return region_metrics(spark, d).drop("added_polygons", "removed_polygons")


def region_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = rings(rects(spark, d)).select("cell", "layer", "points", "side")
    found = regions.xor(own.filter("side = 'a'"), own.filter("side = 'b'"), ["cell", "layer"], tile=512.0).withColumn("origin", F.array(F.lit("top")))
    metrics = layout.piece_metrics(found, ["cell", "layer"], 1.0, 500.0)
    return metrics.select("cell", "layer", "added_polygons", "removed_polygons", F.col("added_area_um2").alias("added_area"), F.col("removed_area_um2").alias("removed_area"), *G.BOX, "cosmetic")


@query()
def layer_regions(spark, d):
    """Whole polygons added and removed: no SQL, as a flood fill over all layers takes too long there."""
    return region_metrics(spark, d).select("cell", "layer", "added_polygons", "removed_polygons", "added_area", "removed_area")


@query(f"""WITH {RECTS}, p AS (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS id, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM q),
b AS (SELECT s_suppkey, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS child, s_suppkey * 37 % 480 AS x1, s_suppkey * 53 % 380 AS y1, s_suppkey * 37 % 480 + 5 + s_suppkey % 40 AS x2, s_suppkey * 53 % 380 + 5 + s_suppkey % 30 AS y2 FROM supplier),
j AS (SELECT p.id, b.child, row_number() OVER (PARTITION BY p.id ORDER BY (b.x2 - b.x1) * (b.y2 - b.y1), b.child) AS k FROM p JOIN b ON cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2)
SELECT p.id AS id, j.child AS child FROM p LEFT JOIN j ON p.id = j.id AND j.k = 1""")
def origin_attribution(spark, d):
    supplier = read(spark, d, "supplier")
    pieces = rects(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.lit(1).alias("g"))
    box = supplier.select(F.expr("concat('S', lpad(s_suppkey, 9, '0'))").alias("child"), F.expr("s_suppkey * 37 % 480").alias("min_x"), F.expr("s_suppkey * 53 % 380").alias("min_y"), F.expr("s_suppkey * 37 % 480 + 5 + s_suppkey % 40").alias("max_x"), F.expr("s_suppkey * 53 % 380 + 5 + s_suppkey % 30").alias("max_y"), F.lit(1).alias("g"))
    return layout.attribute(pieces, box, ["g"], "id").select("id", "child")


@query(f"WITH {RECTS} SELECT l_orderkey, l_linenumber FROM q WHERE x1 <= 180 AND x2 >= 120 AND y1 <= 140 AND y2 >= 100")
def viewport_cull(spark, d):
    own = rects(spark, d).withColumnsRenamed({"x1": "min_x", "y1": "min_y", "x2": "max_x", "y2": "max_y"})
    return layout.cull(own, (120, 100, 180, 140)).select("l_orderkey", "l_linenumber")


@query(f"WITH {RECTS}, v AS (SELECT layer, l_orderkey, l_linenumber, x1, y1, x2, y2 FROM q) SELECT layer, l_orderkey, l_linenumber FROM v WHERE x1 <= 60 AND x2 >= 20 AND y1 <= 50 AND y2 >= 30")
def stored_view(spark, d):
    """Rectangles of a view, read from a scene that was written along a curve."""
    own = rects(spark, d).select("layer", "l_orderkey", "l_linenumber", F.col("x1").alias("min_x"), F.col("y1").alias("min_y"), F.col("x2").alias("max_x"), F.col("y2").alias("max_y"))
    path = fresh_path(spark, "scene")
    scenes.write(own, path, ["layer"])
    return scenes.view(spark, path, (20, 30, 60, 50)).select("layer", "l_orderkey", "l_linenumber")


WIRES = "SELECT layer, x1, y1, CASE WHEN l_partkey % 2 = 0 THEN x1 ELSE x2 END AS x2, CASE WHEN l_partkey % 2 = 0 THEN y2 ELSE y1 END AS y2, l_orderkey, l_linenumber, 'net' || l_suppkey % 40 AS label, side FROM q"


def wires(spark: SparkSession, d: str) -> DataFrame:
    upright = F.col("l_partkey") % 2 == 0
    own = rects(spark, d).withColumn("_x2", F.when(upright, F.col("x1")).otherwise(F.col("x2"))).withColumn("_y2", F.when(upright, F.col("y2")).otherwise(F.col("y1")))
    return own.select("layer", "x1", "y1", F.col("_x2").alias("x2"), F.col("_y2").alias("y2"), "l_orderkey", "l_linenumber", F.expr("concat('net', l_suppkey % 40)").alias("label"), "side")


@query(f"""WITH {RECTS}, w AS ({WIRES}), b AS (SELECT layer, x1 * 2 % 500 AS x1, y1, x1 * 2 % 500 + x2 - x1 AS x2, y2 FROM w WHERE l_orderkey % 3 = 0), a AS (SELECT * FROM w WHERE l_orderkey % 3 <> 0)
SELECT l_orderkey, l_linenumber FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.layer = a.layer AND ((a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) OR (a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1)))""")
def wire_ghosts(spark, d):
    own = wires(spark, d)
    b = own.filter("l_orderkey % 3 = 0").select("layer", (F.col("x1") * 2 % 500).alias("_x1"), "y1", (F.col("x1") * 2 % 500 + F.col("x2") - F.col("x1")).alias("x2"), "y2").withColumnRenamed("_x1", "x1")
    # turned ends and a shift below the tolerance must not matter
    b = b.select("layer", F.col("x2").alias("x1"), F.col("y2").alias("y1"), (F.col("x1") + 0.0004).alias("x2"), F.col("y1").alias("y2"))
    return layout.wire_ghosts(own.filter("l_orderkey % 3 <> 0"), b, ["layer"]).select("l_orderkey", "l_linenumber")


@query(f"""WITH {RECTS}, w AS ({WIRES}), n AS (SELECT layer, x1, label FROM w GROUP BY ALL HAVING bool_and(side = 'a'))
SELECT l_orderkey, l_linenumber, label FROM w JOIN n USING (layer, x1, label) WHERE side = 'a'""")
def net_wires(spark, d):
    """Wires of side A on the nets that side B no longer has; a file is a layer and a column."""
    own = wires(spark, d).select("layer", "x1", "label", "side", "l_orderkey", "l_linenumber")
    nets = lambda side: own.filter(F.col("side") == side).select("layer", "x1", F.col("label").alias("net"))
    gone = diff.set_diff(nets("a"), nets("b")).filter("side = 'removed'").drop("side")
    return layout.net_wires(own.filter("side = 'a'"), gone, ["layer", "x1"]).select("l_orderkey", "l_linenumber", "label")


PALETTE_SQL = "[" + ", ".join(f"'rgba({r},{g},{b},1.000)'" for r, g, b in render.PALETTE) + "]"


@query(f"""WITH o AS (SELECT DISTINCT l_linenumber AS layer, l_suppkey % 5 AS datatype FROM lineitem), n AS (SELECT layer, CAST(datatype AS INTEGER) AS datatype, CAST(row_number() OVER (ORDER BY layer, datatype) - 1 AS INTEGER) AS style_order FROM o)
SELECT layer, datatype, 'layer_' || layer || '_' || datatype AS name, ({PALETTE_SQL})[(layer * 31 + datatype) % 12 + 1] AS fill, style_order, NOT (layer = 2 AND datatype < 3) AS visible FROM n""")
def layer_styles(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"), F.expr("int(l_suppkey % 5)").alias("datatype"))
    catalog = own.filter("layer = 2 and datatype < 3").distinct().select("layer", "datatype", F.lit(False).alias("visible"))
    return render.styles(own, catalog).select("layer", "datatype", "name", X.rgba(F.col("fill")).alias("fill"), "style_order", "visible")


@query("""SELECT r_name AS cell, n_name AS child, s_suppkey, CAST(n_nationkey * 10 + s_suppkey % 100 AS DOUBLE) AS x, CAST(r_regionkey * 1000 + n_nationkey * 7 + s_suppkey % 90 AS DOUBLE) AS y, r_name || '/' || n_name || '/S' || s_nationkey AS path
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hier_flatten(spark, d):
    r, n, s = (read(spark, d, t) for t in ("region", "nation", "supplier"))
    unit = [F.lit(0.0).alias("rot"), F.lit(1.0).alias("mag"), F.lit(False).alias("mirror"), F.lit(1).alias("cols"), F.lit(1).alias("rows"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy")]
    leaf = F.concat(F.lit("S"), F.col("n_nationkey").cast("string"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    refs = up.select(F.col("r_name").alias("cell"), F.col("n_name").alias("child"), F.expr("double(n_nationkey * 10)").alias("dx"), F.expr("double(r_regionkey * 1000)").alias("dy"), *unit)
    refs = refs.unionByName(n.select(F.col("n_name").alias("cell"), leaf.alias("child"), F.lit(0.0).alias("dx"), F.expr("double(n_nationkey * 7)").alias("dy"), *unit))
    ring = F.array(F.struct(F.expr("double(s_suppkey % 100)").alias("x"), F.expr("double(s_suppkey % 90)").alias("y")))
    shapes = s.select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("cell"), F.col("s_suppkey").cast("int").alias("layer"), F.lit(0).alias("datatype"), ring.alias("points"))
    found = layout.flatten(shapes, refs, []).filter(F.size("path") == 3)
    return found.select("cell", F.col("path")[1].alias("child"), F.col("layer").cast("long").alias("s_suppkey"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"), F.array_join("path", "/").alias("path"))


@query("""SELECT n_regionkey AS region, min(n_name) AS top FROM nation GROUP BY n_regionkey""")
def top_cell(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    below = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("cell"), F.expr("concat('A', s_suppkey)").alias("child"))
    cells = n.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("cell")).unionByName(below.select("region", F.col("child").alias("cell")))
    return layout.top_cells(cells, below, ["region"])


@query(f"""WITH {RECTS} SELECT l_orderkey, l_linenumber, printf('%.4f,%.4f %.4f,%.4f %.4f,%.4f %.4f,%.4f', CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x2 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y2 AS DOUBLE)) AS points,
  '&lt;' || l_returnflag || '&gt;&amp;' AS label FROM q""")
def svg_points(spark, d):
    own = rings(rects(spark, d))
    return own.select("l_orderkey", "l_linenumber", G.points_text(F.col("points")).alias("points"), X.xml_escape(F.concat(F.lit("<"), F.col("l_returnflag"), F.lit(">&"))).alias("label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import notes

    from . import presentation

    return QUERIES | notes.QUERIES | presentation.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import notes

    from . import presentation

    return SQL | notes.SQL | presentation.SQL
