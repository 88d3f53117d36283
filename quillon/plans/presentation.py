"""Queries over scalar functions, views, presentation and notes, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import predicates as P
from ..functions import text as X
from ..operators import blobs, calibration, diff, history, render
from . import notes, workflows
from .catalogue import CHANGES, DIFF, RECTS, changes, commits, corners, entries, files, order_refs, read, rects, rings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def boxed(spark: SparkSession, d: str) -> DataFrame:
    box = G.make_box(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    return rects(spark, d).withColumn("box", box)


FLOATS = f"{RECTS}, d AS (SELECT * REPLACE (CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2) FROM q)"


# --- views -----------------------------------------------------------------------
@query(f"""WITH {FLOATS}, v AS (SELECT *, least(800.0 / greatest(x2 - x1, 1e-9), 600.0 / greatest(y2 - y1, 1e-9)) * 0.9 AS s, l_linenumber / 2.0 - 1 AS k FROM d),
f AS (SELECT *, 400 - (x1 + x2) / 2 * s AS px, 300 - (y1 + y2) / 2 * s AS py FROM v),
z AS (SELECT *, CASE WHEN k > 0 THEN 100 - (100 - px) * k ELSE px END + 3 AS qx, CASE WHEN k > 0 THEN 50 - (50 - py) * k ELSE py END - 2 AS qy, CASE WHEN k > 0 THEN s * k ELSE s END AS t FROM f)
SELECT l_orderkey, l_linenumber, floor((x1 * t + qx) * 1000 + 0.5) / 1000 AS screen_x, floor((y1 * t + qy) * 1000 + 0.5) / 1000 AS screen_y, floor((10 - qx) / t * 1000 + 0.5) / 1000 AS world_x, floor((20 - qy) / t * 1000 + 0.5) / 1000 AS world_y FROM z""")
def view_transforms(spark, d):
    at = lambda v: F.lit(float(v))
    own = boxed(spark, d).withColumn("view", G.fit(F.col("box"), at(800), at(600)))
    own = own.withColumn("view", G.zoom(F.col("view"), at(100), at(50), F.col("l_linenumber") / 2 - 1)).withColumn("view", G.pan(F.col("view"), at(3), at(-2)))
    own = own.withColumn("s", G.to_screen(F.col("view"), F.col("x1"), F.col("y1"))).withColumn("w", G.to_world(F.col("view"), at(10), at(20)))
    return own.select("l_orderkey", "l_linenumber", *[(F.floor(F.col(f"{a}.{c}") * 1000 + 0.5) / 1000.0).alias(f"{n}_{c}") for a, n in (("s", "screen"), ("w", "world")) for c in "xy"])


@query(f"""WITH {FLOATS}, e AS (SELECT *, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 ELSE 1 END AS f FROM d)
SELECT l_orderkey, l_linenumber, round((x1 + x2) / 2 + 5 - greatest(abs(x2 - x1), 1) / f / 2, 4) AS min_x, round((y1 + y2) / 2 - 7 + greatest(abs(y2 - y1), 1) / f / 2, 4) AS max_y,
  printf('%.4f %.4f %.4f %.4f', x1, y1, x2 - x1, y2 - y1) AS view_box, x2 - x1 + 2 AS wide FROM e""")
def effective_views(spark, d):
    own = boxed(spark, d).withColumn("e", G.effective_box(F.col("box"), F.lit(1.0), F.lit(1.0), (F.col("l_suppkey") % 4).cast("double"), F.lit(5.0), F.lit(-7.0)))
    return own.select("l_orderkey", "l_linenumber", F.round("e.min_x", 4).alias("min_x"), F.round("e.max_y", 4).alias("max_y"), G.view_box(F.col("box"), 1.0, 1.0).alias("view_box"), G.width(G.inflate(F.col("box"), 1.0)).alias("wide"))


@query(f"""WITH {FLOATS} SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 2 THEN x1 - l_suppkey % 7 WHEN 3 THEN x1 ELSE least(x1, x2) END AS min_x, CASE l_linenumber % 4 WHEN 2 THEN y1 + l_suppkey % 7 WHEN 3 THEN y1 ELSE greatest(y1, y2) END AS max_y FROM d""")
def element_boxes(spark, d):
    own = rings(rects(spark, d)).withColumn("radius", F.expr("double(l_suppkey % 7)"))
    turned = {"x1": F.col("x2"), "y1": F.col("y1").cast("double"), "x2": F.col("x1"), "y2": F.col("y2").cast("double"), "radius": F.col("radius"), "points": F.col("points")}
    plain = {k: F.col(k).cast("double") if k != "points" else F.col(k) for k in ("x1", "y1", "x2", "y2", "radius", "points")}
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "line").when(k == 1, "polygon").when(k == 2, "circle").otherwise("text")
    box = F.when(k == 0, G.element_box(F.lit("line"), turned)).otherwise(G.element_box(kind, plain))
    return own.withColumn("b", box).select("l_orderkey", "l_linenumber", F.col("b.min_x").cast("double").alias("min_x"), F.col("b.max_y").cast("double").alias("max_y"))


@query("""WITH a AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS c, 1.0 + s_suppkey % 9 AS r, CAST(s_suppkey % 360 AS DOUBLE) AS t, CAST(s_suppkey * 13 % 720 - 360 AS DOUBLE) AS w FROM supplier)
SELECT s_suppkey, CAST(greatest(ceil(abs(w) / 5), 1) + 1 AS INTEGER) AS points, round(c + r * cos((t + w) * (pi() / 180)), 6) + 0.0 AS x, round(-(r * sin((t + w) * (pi() / 180))), 6) + 0.0 AS y FROM a""")
def arc_points(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.expr("double(s_suppkey % 50)").alias("c"), F.expr("1.0D + s_suppkey % 9").alias("r"), F.expr("double(s_suppkey % 360)").alias("t"), F.expr("double(s_suppkey * 13 % 720 - 360)").alias("w"))
    own = s.withColumn("p", G.arc(F.col("c"), F.lit(0.0), F.col("r"), F.col("t"), F.col("w")))
    return own.select("s_suppkey", F.size("p").alias("points"), F.round(F.element_at("p", -1)["x"], 6).alias("x"), F.round(F.element_at("p", -1)["y"], 6).alias("y"))


# --- names and phrases -------------------------------------------------------------
@query(f"""WITH {CHANGES} SELECT user_id, element, CASE WHEN kind = 'modified' AND contains(element, ' → ') THEN 'r' WHEN kind = 'added' THEN '+' WHEN kind = 'removed' THEN '-' ELSE '~' END AS marker,
  split_part(element, ' → ', 1) AS old_name, CASE WHEN contains(element, ' → ') THEN split_part(element, ' → ', 2) ELSE element END AS new_name, regexp_replace(element, '^net:', '') AS net_name,
  element = 'layout' AS is_marker, regexp_matches('cell:L' || user_id || '/2', '^[^:]*:L[0-9]+/[0-9]+(:.*)?$') AS is_geometry, replace(path, '/', ' → ') AS shown_path FROM c""")
def element_names(spark, d):
    e = F.col("element")
    geometry = P.is_layout_geometry(F.concat(F.lit("cell:L"), F.col("user_id").cast("string"), F.lit("/2")))
    return changes(spark, d).select("user_id", "element", X.marker(F.col("kind"), e).alias("marker"), X.old_name(e).alias("old_name"), X.new_name(e).alias("new_name"), P.net_name(e).alias("net_name"), P.is_layout_marker(e).alias("is_marker"), geometry.alias("is_geometry"), X.arrow_path(F.col("path")).alias("shown_path"))


@query("""WITH a AS (SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 3 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 THEN 'al día' ELSE concat_ws(', ', CASE WHEN a > 0 THEN a || ' adelante' END, CASE WHEN b > 0 THEN b || ' atrás' END) END AS phrase, 'Asunto ' || o_orderkey AS subject, printf('%.3f', o_orderkey / 8.0) AS shown FROM a""")
def upstream_phrases(spark, d):
    message = F.concat(F.lit("Asunto "), F.col("o_orderkey").cast("string"), F.lit("\r\n\r\ncuerpo"))
    return read(spark, d, "orders").select("o_orderkey", X.upstream_phrase(F.col("o_orderkey") % 4, F.col("o_custkey") % 3).alias("phrase"), X.first_line(message).alias("subject"), X.decimals(F.col("o_orderkey") / 8, 3).alias("shown"))


# --- reading -----------------------------------------------------------------------
@query("""WITH c AS (SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'not_found' WHEN n_chars > 2000 THEN 'large' ELSE 'ok' END AS code FROM documents)
SELECT 'lenient' AS policy, source, CAST(count(*) FILTER (code = 'ok') AS BIGINT) AS present, CAST(count(*) FILTER (code = 'large') AS BIGINT) AS warned FROM c GROUP BY source
UNION ALL SELECT 'silent', source, count(*), CAST(count(*) FILTER (code = 'large') AS BIGINT) FROM c GROUP BY source""")
def read_policies(spark, d):
    docs = read(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    tree = docs.filter("doc_id % 9 <> 0").select(F.lit("c").alias("oid"), path, path.alias("blob_sha"), F.col("n_chars").alias("size"))
    found = blobs.lookup(docs.select(F.lit("c").alias("oid"), path, "source"), tree, docs.select(path.alias("blob_sha"), F.col("text").cast("binary").alias("content")), 2000)
    out = None
    for policy in ("lenient", "silent"):
        rows, warnings = blobs.apply_policy(found, policy)
        per = rows.groupBy("source").agg(F.count("content").alias("present"))
        warned = warnings.join(docs.select(path, "source"), "path").groupBy("source").agg(F.count("*").alias("n"))
        own = per.join(warned, "source", "left").select(F.lit(policy).alias("policy"), "source", "present", F.coalesce("n", F.lit(0)).alias("warned"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT page_id, CASE page_id % 3 WHEN 1 THEN url || ' (A): UTF-8 inválido' WHEN 2 THEN url || ' (A): el formato no es xschem' END AS message,
  CASE page_id % 4 WHEN 0 THEN 'magic' WHEN 1 THEN 'spice' WHEN 2 THEN 'klayout' END AS tool FROM pages""")
def side_warnings(spark, d):
    head = F.expr("case page_id % 3 when 0 then binary('v {xschem version=3}') when 1 then x'FFFE' else binary('') end")
    tools = F.expr("case page_id % 4 when 0 then binary('magic\\ntech') when 1 then binary('* title') when 2 then x'00060002' else binary('') end")
    own = read(spark, d, "pages").select("page_id", "url", F.concat(head, F.lit("<p>").cast("binary")).alias("content"), tools.alias("other"))
    return own.select("page_id", P.side_warning(F.col("content"), F.col("url"), F.lit("A")).alias("message"), P.tool_of(F.lit("file.unknown"), F.col("other")).alias("tool"))


# --- drawings ------------------------------------------------------------------------
POINTS = "printf('%.4f,%.4f %.4f,%.4f %.4f,%.4f %.4f,%.4f', x1, y1, x2, y1, x2, y2, x1, y2)"
PALETTE_SQL = "[" + ", ".join(f"'rgba({r},{g},{b},1.000)'" for r, g, b in render.PALETTE) + "]"


@query(f"""WITH {FLOATS}, c AS (SELECT *, l_suppkey % 2 AS t, ({PALETTE_SQL})[(layer * 31 + l_suppkey % 2) % 12 + 1] AS k FROM d),
p AS (SELECT cell, layer, t, '<polygon points="' || {POINTS} || '" fill="' || k || '" stroke="' || k || '" fill-opacity="1.000" stroke-opacity="1.000" stroke-width="0.6"/>' AS s FROM c)
SELECT cell, layer, CAST(t AS INTEGER) AS datatype, md5('<g id="layer-' || layer || '-' || t || '" data-layer="' || layer || '" data-datatype="' || t || '">' || string_agg(s, '' ORDER BY s) || '</g>') AS svg FROM p GROUP BY cell, layer, t""")
def layer_groups(spark, d):
    own = rings(rects(spark, d)).withColumn("datatype", F.expr("int(l_suppkey % 2)"))
    elements = render.scene(own, None, ["cell"])
    groups = render.layer_svg(elements, render.styles(elements), ["cell"])
    return groups.select("cell", F.col("layer").cast("long").alias("layer"), "datatype", F.md5("svg").alias("svg"))


@query(f"""WITH {FLOATS}, p AS (SELECT cell, side, '<polygon points="' || {POINTS} || CASE side WHEN 'a' THEN '" fill="rgba(200,0,0,1.000)" stroke="rgba(120,0,0,1.000)" stroke-width="0.8"/>' ELSE '" fill="rgba(0,200,0,1.000)" stroke="rgba(0,120,0,1.000)" stroke-width="0.8"/>' END AS s FROM d)
SELECT cell, CAST(CASE side WHEN 'a' THEN 1 ELSE 0 END AS INTEGER) AS place, md5('<g id="layer-highlights-' || CASE side WHEN 'a' THEN 'removed' ELSE 'added' END || '">' || string_agg(s, '' ORDER BY s) || '</g>') AS svg FROM p GROUP BY cell, side""")
def highlight_groups(spark, d):
    own = rings(rects(spark, d)).withColumn("side", F.expr("if(side = 'a', 'removed', 'added')"))
    return render.highlight_svg(own, ["cell"]).select("cell", "place", F.md5("svg").alias("svg"))


@query(f"""WITH {FLOATS}, h AS (SELECT layer, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS e FROM d GROUP BY layer)
SELECT layer, '<svg xmlns="http://www.w3.org/2000/svg" width="800" height="600" viewBox="' || printf('%.4f %.4f %.4f %.4f', a - 5, b, c + 5 - a, e - b) || '" role="img" aria-label="layout-scene"><rect x="0" y="0" width="100%" height="100%" fill="rgba(1,2,3,1.000)"/><g>' || layer || '</g></svg>' AS svg FROM h""")
def drawing_documents(spark, d):
    own = rings(rects(spark, d))
    box = own.withColumn("b", G.bbox(F.col("points"))).groupBy("layer").agg(*[f(f"b.{c}").alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])
    marks = box.select("layer", F.array(F.struct((F.col("min_x") - 5).alias("x"), F.col("min_y").alias("y"))).alias("points"))
    layers = box.select("layer", F.lit(0).alias("style_order"), F.concat(F.lit("<g>"), F.col("layer").cast("string"), F.lit("</g>")).alias("svg"))
    return render.document_svg(layers, None, render.expanded_boxes(box, marks, ["layer"]), ["layer"], background=(1, 2, 3))


@query(f"""{DIFF} SELECT p_partkey, CASE WHEN cosmetic THEN 'moved' WHEN kind = 'modified' AND position_changed THEN 'modified_moved' ELSE kind END AS look FROM d WHERE NOT cosmetic OR position_changed""")
def change_looks(spark, d):
    return render.change_list(entries(spark, d)).select("p_partkey", "look")


@query("""SELECT l_linenumber AS layer, CAST((l_linenumber * 40503 % 65536) % 156 + 100 AS INTEGER) AS r, CAST(((l_linenumber * 40503 % 65536) >> 4) % 156 + 100 AS INTEGER) AS g, CAST(((l_linenumber * 40503 % 65536) >> 8) % 156 + 100 AS INTEGER) AS b FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem)""")
def viewer_colors(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("layer")).distinct()
    return own.withColumn("c", render.gui_layer_color(F.col("layer"))).select("layer", "c.r", "c.g", "c.b")


@query(f"""{DIFF} SELECT p_brand, list_sort(coalesce(list('C' || p_partkey) FILTER (p_partkey % 5 <> 0), [])) AS names, list_sort(coalesce(list('C' || p_partkey) FILTER (p_partkey % 5 = 0 AND kind = 'added'), [])) AS nets_added,
  list_sort(coalesce(list('C' || p_partkey) FILTER (p_partkey % 5 = 0 AND kind = 'removed'), [])) AS nets_removed FROM d GROUP BY p_brand""")
def split_reports(spark, d):
    none = F.lit(None).cast("map<string,string>")
    own = entries(spark, d).select("p_brand", F.expr("concat(if(p_partkey % 5 = 0, 'net:', ''), 'C', p_partkey)").alias("element"), "kind", "cosmetic", "position_changed", none.alias("before"), none.alias("after"))
    found = workflows.split_report(own, ["p_brand"])
    return found.select("p_brand", F.transform("components", lambda c: c["name"]).alias("names"), "nets_added", "nets_removed")


@query(f"""{DIFF} SELECT p_partkey, 'ghost' AS what FROM d WHERE position_changed OR kind = 'removed' UNION ALL SELECT p_partkey, 'box' FROM d WHERE kind <> 'removed'""")
def diff_view_elements(spark, d):
    part = read(spark, d, "part")
    scene = lambda where: part.filter(where).select("p_brand", F.col("p_partkey").cast("string").alias("component"), *[F.col("p_size").cast("double").alias(c) for c in G.BOX])
    report = entries(spark, d).withColumn("element", F.col("p_partkey").cast("string"))
    shown = workflows.diff_views(report, scene("p_partkey % 17 <> 0"), scene("p_partkey % 13 <> 0"), ["p_brand"], "diff").filter("ghost")
    boxes = workflows.component_boxes(report, scene("p_partkey % 13 <> 0"), ["p_brand"])
    return shown.select(F.col("component").cast("long").alias("p_partkey"), F.lit("ghost").alias("what")).unionByName(boxes.select(F.col("element").cast("long").alias("p_partkey"), F.lit("box").alias("what")))


# --- history ---------------------------------------------------------------------------
@query("""WITH t AS (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS oid FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200),
f AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS oid, string_agg('          cell' || l_partkey || '.sch    (cambio)', chr(10) ORDER BY 'cell' || l_partkey || '.sch') AS s FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT t.oid AS oid, '* ' || left(t.oid, 7) || CASE WHEN o_orderkey % 50 = 0 THEN ' (' || array_to_string(list_concat(['HEAD'], list_sort([o_orderpriority, 'main'])), ', ') || ')' WHEN o_orderkey % 3 = 0 THEN ' (' || o_orderpriority || ')' ELSE '' END
  || CASE WHEN o_orderkey % 10 = 1 THEN ' [merge]' ELSE '' END || '  ' || o_orderstatus || chr(10) || '          ' || o_custkey || ' · 1970-01-12 13:46' || chr(10)
  || CASE WHEN o_orderkey % 10 = 1 THEN '          (merge commit; v1 no calcula diff por archivo)' WHEN o_orderkey % 10 = 0 THEN '          (commit raíz)' ELSE coalesce(s, '          (sin cambios reconocidos)') END AS text FROM t LEFT JOIN f USING (oid)""")
def log_blocks(spark, d):
    status = read(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("\n\ncuerpo")).alias("message"))
    found, own = history.log(commits(spark, d).join(status, "o_orderkey"), files(spark, d), order_refs(spark, d), limit=200)
    text = render.log_text(found.withColumn("ts", F.lit(1_000_000)), own.select("oid", "path", F.lit("(cambio)").alias("phrase")))
    return text.select("oid", "text")


@query("""SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS oid, count(*) AS files FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE contains(CAST(o_custkey AS VARCHAR), '1') AND l_linenumber % 2 = 0 GROUP BY o_orderkey""")
def log_filters(spark, d):
    found, own = history.narrow(commits(spark, d), files(spark, d), author="1", kinds=("schematic",))
    return found.join(own.groupBy("oid").agg(F.count("*").alias("files")), "oid").select("oid", "files")


# --- notes -----------------------------------------------------------------------------
@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS a, CASE WHEN c_custkey % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS b FROM customer)
SELECT c_custkey, CASE WHEN a = 'PASS' AND b = 'FAIL' THEN 'block' WHEN a = 'FAIL' AND b = 'FAIL' THEN 'warn' ELSE 'ok' END AS verdict FROM s""")
def lvs_states(spark, d):
    c = read(spark, d, "customer")
    state = lambda n: F.when(F.col("c_custkey") % n == 0, "FAIL").otherwise("PASS").alias("state")
    return notes.match_state(c.filter("c_custkey % 7 <> 0").select("c_custkey", state(3)), c.select("c_custkey", state(5)), ["c_custkey"]).select("c_custkey", "verdict")


@query("""SELECT p_partkey, 'delay' AS name, p_size + 0.5 AS value FROM part UNION ALL SELECT p_partkey, 'gain', CAST(p_partkey || 'e-1' AS DOUBLE) FROM part""")
def measured_values(spark, d):
    text = F.expr("concat('Delay = ', p_size, '.5\\nno value here\\n  gain=', p_partkey, 'e-1')")
    return notes.measurements(read(spark, d, "part").select("p_partkey", text.alias("text")), ["p_partkey"])


@query("""SELECT p_partkey, '.end' || chr(10) || 'c1 x y' || chr(10) || 'r' || p_size || ' a b 1k' AS canonical, 'magic' || chr(10) || 'rect 1 2' AS stripped, sha256(p_name || chr(31) || p_brand) AS key FROM part""")
def canonical_texts(spark, d):
    part = read(spark, d, "part")
    netlist = F.expr("concat('* Generated today\\nR', p_size, ' a   b 1k\\n\\nC1 x\\ty\\n.END')")
    plain = notes.canonical_netlist(part.select("p_partkey", netlist.alias("text")), ["p_partkey"])
    bare = notes.strip_timestamps(part.select("p_partkey", F.lit("magic\ntimestamp 123\nrect 1 2").alias("text")), ["p_partkey"]).withColumnRenamed("text", "stripped")
    return plain.join(bare, "p_partkey").join(part.select("p_partkey", notes.cache_key("p_name", "p_brand").alias("key")), "p_partkey")


@query("""WITH c AS (SELECT p_partkey, floor(p_retailprice) % 2 = 1 AS moved, p_size % 3 = 0 AS named FROM part)
SELECT p_partkey, CASE WHEN moved AND named THEN 'mixed' WHEN named THEN 'functional' ELSE 'cosmetic' END AS change_class FROM c WHERE moved OR named""")
def text_changes(spark, d):
    """Every part is a file of two lines; odd prices move its component, every third size renames its text."""
    part = read(spark, d, "part")
    x = F.expr("p_size + if(floor(p_retailprice) % 2 = 1, 5, 0)")
    name = F.expr("concat(p_name, if(p_size % 3 = 0, '!', ''))")
    lines = lambda x, name: part.select("p_partkey", F.explode(F.array(F.format_string("C {%s} %d 20 0 0 {name=R1}", "p_type", x.cast("int")), F.format_string("T {%s} 0 0 0 0 0.4 0.4 {}", name))).alias("line"))
    found = diff.set_diff(lines(F.col("p_size"), F.col("p_name")), lines(x, name))
    return notes.text_change_class(found.withColumn("side", F.expr("if(side = 'added', 'b', 'a')")), ["p_partkey"])


@query(f"""WITH {RECTS} SELECT DISTINCT CAST(cell AS VARCHAR) AS old, 'x' || cell AS new FROM q""")
def renamed_cells(spark, d):
    own = rings(rects(spark, d)).select(F.col("cell").cast("string").alias("cell"), "layer", F.lit(0).alias("datatype"), "points")
    old = notes.cell_fingerprints(own, []).withColumnRenamed("cell", "old")
    return old.join(notes.cell_fingerprints(own.withColumn("cell", F.concat(F.lit("x"), "cell")), []).withColumnRenamed("cell", "new"), "fingerprint").select("old", "new")


ENDS_SQL = f"""{FLOATS}, w AS (SELECT DISTINCT cell, layer, unnest([x1, x2]) AS x, unnest([y1, y2]) AS y, 2 + layer / 8.0 AS z FROM d),
drawn AS (SELECT DISTINCT cell, layer, floor((x + 7) * z * 100 + 0.5) / 100 AS x, floor((y + 3) * z * 100 + 0.5) / 100 + CASE WHEN x % 29 = 0 THEN 0.5 ELSE 0 END AS y FROM w),
p AS (SELECT cell, layer, x + 7 AS sx, y + 3 AS sy, (x + 7) * (z + 0.0005) AS px, (y + 3) * (z + 0.0005) AS py FROM w),
j AS (SELECT p.cell, p.layer, sx, sy, px, py, drawn.x AS x, drawn.y AS y, (drawn.x - px) * (drawn.x - px) + (drawn.y - py) * (drawn.y - py) AS d2 FROM p JOIN drawn ON p.cell = drawn.cell AND p.layer = drawn.layer AND drawn.x BETWEEN px - 8 AND px + 8 AND drawn.y BETWEEN py - 8 AND py + 8),
m AS (SELECT cell, layer, sx, sy, min({{'d2': d2, 'x': x, 'y': y}}) AS b FROM j WHERE d2 < 64 GROUP BY cell, layer, sx, sy)"""


def ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ends of all wires, their drawing with some ends half a pixel off, and a first zoom that is slightly wrong."""
    own = rects(spark, d).select("cell", "layer", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select("cell", "layer", "e.*").distinct()
    z = 2 + F.col("layer") / 8.0
    shown = lambda c, origin: F.floor((F.col(c) + origin) * z * 100 + 0.5) / 100
    drawn = own.select("cell", "layer", shown("x", 7).alias("x"), (shown("y", 3) + F.expr("if(x % 29 = 0, 0.5D, 0D)")).alias("y"))
    start = own.select("cell", "layer").distinct().select("cell", "layer", (z + 0.0005).alias("zoom"), F.lit(7.0).alias("x_origin"), F.lit(3.0).alias("y_origin"))
    return own, drawn, start


@query(f"""WITH {ENDS_SQL} SELECT cell, layer, sx, sy, b.x AS x, b.y AS y FROM m""")
def endpoint_matches(spark, d):
    own, drawn, start = ends(spark, d)
    at = own.join(start, ["cell", "layer"])
    at = at.select("cell", "layer", (F.col("x") + F.col("x_origin")).alias("sx"), (F.col("y") + F.col("y_origin")).alias("sy"), ((F.col("x") + F.col("x_origin")) * F.col("zoom")).alias("px"), ((F.col("y") + F.col("y_origin")) * F.col("zoom")).alias("py"))
    return at.join(calibration.nearest(at, drawn, ["cell", "layer"]), ["cell", "layer", "px", "py"]).select("cell", "layer", "sx", "sy", "x", "y")


@query(f"""WITH {ENDS_SQL}, e AS (SELECT cell, layer, sx AS s, b.x AS p FROM m UNION ALL SELECT cell, layer, sy, b.y FROM m),
f AS (SELECT cell, layer, sum(s * p) / sum(s * s) AS z FROM e GROUP BY ALL),
g AS (SELECT cell, layer, z, sqrt(avg((p - z * s) * (p - z * s))) AS sd FROM e JOIN f USING (cell, layer) GROUP BY ALL),
k AS (SELECT cell, layer, s, p FROM e JOIN g USING (cell, layer) WHERE abs(p - z * s) <= 2 * sd + 1e-9)
SELECT cell, layer, floor(sum(s * p) / sum(s * s) * 1000000 + 0.5) / 1000000 AS zoom, CAST(count(*) // 2 AS INTEGER) AS pairs FROM k GROUP BY cell, layer""")
def calibrations(spark, d):
    own, drawn, start = ends(spark, d)
    found = calibration.fit_zoom(own, drawn, start, ["cell", "layer"], rounds=1)
    return found.select("cell", "layer", (F.floor(F.col("zoom") * 1_000_000 + 0.5) / 1_000_000).alias("zoom"), "pairs")
