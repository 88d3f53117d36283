"""Presentation: styles, SVG, annotations, JSON envelopes and text reports.

Sinks build one row for each file, commit or drawing; nothing is gathered over
the whole table unless a whole document is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

# Layer colours in palette order; fill and stroke of highlights and annotations.
PALETTE = ((76, 175, 80), (33, 150, 243), (255, 193, 7), (244, 67, 54), (0, 188, 212), (156, 39, 176), (255, 152, 0), (63, 81, 181), (205, 220, 57), (121, 85, 72), (96, 125, 139), (233, 30, 99))
HIGHLIGHTS = {"added": ((0, 200, 0), (0, 120, 0)), "removed": ((200, 0, 0), (120, 0, 0)), "modified": ((255, 180, 0), (180, 120, 0))}
ANNOTATIONS = {"added": ("rgba(0,200,0,0.25)", "rgba(0,200,0,0.85)"), "removed": ("rgba(200,0,0,0.25)", "rgba(200,0,0,0.85)"), "cosmetic": ("rgba(120,120,120,0.20)", "rgba(120,120,120,0.85)"), "modified": ("rgba(255,180,0,0.25)", "rgba(255,180,0,0.85)")}
WIRE_COLORS = {"added": "rgba(0,200,0,0.9)", "removed": "rgba(200,0,0,0.9)"}


def color(rgb: tuple[int, int, int], alpha: int = 255) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("rgba", (*rgb, alpha), strict=True)])


def layer_color(layer: Column, datatype: Column) -> Column:
    """Colour of a layer; all process kits share one palette."""
    return F.get(F.array(*[color(c) for c in PALETTE]), F.pmod(layer * 31 + datatype, F.lit(len(PALETTE))).cast("int"))


def gui_layer_color(layer: Column) -> Column:
    """Viewer colour of a layer: a 16-bit product spread over three channels."""
    h = F.pmod(layer.cast("long") * 40503, F.lit(1 << 16))
    channel = lambda k: (F.pmod(F.shiftright(h, k), F.lit(156)) + 100).cast("int")
    return F.struct(channel(0).alias("r"), channel(4).alias("g"), channel(8).alias("b"), F.lit(255).alias("a"))


def styles(observed: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One style for each layer of the catalog or of the data, numbered by (layer, datatype)."""
    tags = observed.select("layer", "datatype").distinct()
    have = catalog.columns if catalog is not None else []
    joined = tags.join(catalog, ["layer", "datatype"], "full") if catalog is not None else tags
    default = {"name": F.format_string("layer_%d_%d", F.col("layer").cast("int"), F.col("datatype").cast("int")), "fill": layer_color(F.col("layer"), F.col("datatype")), "opacity": F.lit(1.0), "visible": F.lit(True)}
    for name, value in default.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), value) if name in have else value)
    joined = joined.withColumn("stroke", F.coalesce(F.col("stroke"), F.col("fill")) if "stroke" in have else F.col("fill"))
    # a row a layer: layers are few, whatever the number of shapes
    place = F.row_number().over(Window.orderBy("layer", "datatype")) - 1
    joined = joined.withColumn("style_order", place)
    if "order" in have:
        joined = joined.withColumn("style_order", F.coalesce("order", "style_order")).drop("order")
    return joined.orderBy("style_order", "layer", "datatype")


def scene(polygons: DataFrame, labels: DataFrame | None, keys: list[str]) -> DataFrame:
    """Drawing elements: polygons on the base plane, labels on the label plane; layers clamped to 16 bits."""
    clamp = F.least(F.col("layer").cast("long"), F.lit(65535)).cast("int").alias("layer")
    base = polygons.select(*keys, F.lit("polygon").alias("kind"), F.lit(0).alias("plane"), clamp, F.col("datatype").cast("int").alias("datatype"), "points", F.lit(None).cast("string").alias("text"))
    if labels is None:
        return base
    at = F.array(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("points")
    return base.unionByName(labels.select(*keys, F.lit("text").alias("kind"), F.lit(1).alias("plane"), clamp, F.col("texttype").cast("int").alias("datatype"), at, "text"))


def element_svg(fill: Column, stroke: Column, opacity: Column) -> Column:
    polygon = F.format_string('<polygon points="%s" fill="%s" stroke="%s" fill-opacity="%.3f" stroke-opacity="%.3f" stroke-width="0.6"/>', G.points_text(F.col("points")), X.rgba(fill), X.rgba(stroke), opacity.cast("double"), opacity.cast("double"))
    at = F.col("points")[0]
    text = F.format_string('<text x="%.4f" y="%.4f" fill="%s" font-family="monospace" font-size="3.0" text-anchor="middle">%s</text>', at["x"], at["y"], X.rgba(stroke), X.xml_escape(F.coalesce("text", F.lit(""))))
    return F.when(F.col("kind") == "polygon", polygon).otherwise(text)


def layer_svg(elements: DataFrame, style: DataFrame, keys: list[str], show_labels: bool = True) -> DataFrame:
    """One SVG group for each drawing and visible layer: base plane first, then labels."""
    shown = elements if show_labels else elements.filter("kind <> 'text'")
    own = shown.join(style.filter("visible"), ["layer", "datatype"])
    own = own.withColumn("svg", element_svg(F.col("fill"), F.col("stroke"), F.col("opacity")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plane", "svg"))), lambda e: e["svg"]), "")
    head = F.format_string('<g id="layer-%d-%d" data-layer="%d" data-datatype="%d">', *[F.col(c).cast("int") for c in ("layer", "datatype", "layer", "datatype")])
    return own.groupBy(*keys, "layer", "datatype", "style_order").agg(F.concat(head, parts, F.lit("</g>")).alias("svg"))


def highlight_svg(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One SVG group for each drawing and kind of highlight, added, removed, then modified."""
    pick = lambda k: F.when(F.col("side") == "added", X.rgba(color(HIGHLIGHTS["added"][k]))).when(F.col("side") == "removed", X.rgba(color(HIGHLIGHTS["removed"][k]))).otherwise(X.rgba(color(HIGHLIGHTS["modified"][k])))
    one = F.format_string('<polygon points="%s" fill="%s" stroke="%s" stroke-width="0.8"/>', G.points_text(F.col("points")), pick(0), pick(1))
    group = pieces.withColumn("_svg", one).groupBy(*keys, "side").agg(F.array_join(F.array_sort(F.collect_list("_svg")), "").alias("_body"))
    place = F.when(F.col("side") == "added", 0).when(F.col("side") == "removed", 1).otherwise(2)
    return group.select(*keys, place.alias("place"), F.format_string('<g id="layer-highlights-%s">%s</g>', "side", "_body").alias("svg"))


def document_svg(layers: DataFrame, highlights: DataFrame | None, boxes: DataFrame, keys: list[str], width: int = 800, height: int = 600, background: tuple[int, int, int] | None = None) -> DataFrame:
    """One SVG document for each drawing; ``boxes`` has the box of each."""
    join_parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "svg"))), lambda e: e["svg"]), "")
    parts = layers.select(*keys, F.col("style_order").cast("int").alias("_o"), "svg")
    if highlights is not None:
        parts = parts.unionByName(highlights.select(*keys, (F.col("place") + 1_000_000).cast("int").alias("_o"), "svg"))
    body = parts.groupBy(*keys).agg(join_parts.alias("_body"))
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in G.BOX])
    head = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="'), G.view_box(box, width, height), F.lit('" role="img" aria-label="layout-scene">'))
    back = F.concat(F.lit('<rect x="0" y="0" width="100%" height="100%" fill="'), X.rgba(color(background)), F.lit('"/>')) if background else F.lit("")
    return boxes.join(body, keys, "left").select(*keys, F.concat(head, back, F.coalesce("_body", F.lit("")), F.lit("</svg>")).alias("svg"))


def expanded_boxes(boxes: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes extended by all highlight points."""
    own = pieces.select(*keys, G.bbox(F.col("points")).alias("b")).select(*keys, "b.*").unionByName(boxes.select(*keys, *G.BOX))
    return own.groupBy(*keys).agg(*[f(c).alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])


def annotate(svgs: DataFrame, changes: DataFrame, side_a: DataFrame, side_b: DataFrame, net_lines: DataFrame, keys: list[str]) -> DataFrame:
    """SVG texts with boxes on changed components and lines on changed nets, put before the first closing tag.

    Removed components stand where side A has them (side B if A lacks them),
    others where B has them.  Names of renamed components are split.
    """
    own = changes.filter(~F.col("element").startswith("net:")).withColumn("_old", X.old_name(F.col("element"))).withColumn("_new", X.new_name(F.col("element")))
    a = side_a.select(*keys, F.col("name").alias("_old"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    b = side_b.select(*keys, F.col("name").alias("_new"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    placed = own.join(a, [*keys, "_old"], "left").join(b, [*keys, "_new"], "left")
    gone = F.col("kind") == "removed"
    x = F.when(gone, F.coalesce("_ax", "_bx")).otherwise(F.col("_bx"))
    y = F.when(gone, F.coalesce("_ay", "_by")).otherwise(F.col("_by"))
    style = F.when(F.col("kind") != "modified", F.col("kind")).when(F.col("cosmetic"), "cosmetic").otherwise("modified")
    pick = lambda k: F.element_at(F.create_map(*[v for n, s in ANNOTATIONS.items() for v in (F.lit(n), F.lit(s[k]))]), style)
    rect = F.format_string('<rect x="%.1f" y="%.1f" width="40" height="40" fill="%s" stroke="%s"/>', x - 20, y - 20, pick(0), pick(1))
    boxes = placed.filter(x.isNotNull()).select(*keys, rect.alias("svg"))
    wire = F.element_at(F.create_map(*[v for n, c in WIRE_COLORS.items() for v in (F.lit(n), F.lit(c))]), F.col("kind"))
    lines = net_lines.select(*keys, F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f" stroke="%s"/>', "x1", "y1", "x2", "y2", wire).alias("svg"))
    marks = boxes.unionByName(lines).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("svg")), "").alias("_marks"))
    joined = svgs.join(marks, keys, "left")
    at = F.locate("</svg>", F.col("svg"))
    put = F.concat(F.expr("substring(svg, 1, locate('</svg>', svg) - 1)"), F.col("_marks"), F.expr("substring(svg, locate('</svg>', svg))"))
    return joined.withColumn("svg", F.when(F.col("_marks").isNotNull() & (at > 0), put).otherwise(F.col("svg"))).drop("_marks")


def change_list(entries: DataFrame) -> DataFrame:
    """Entries that a viewer lists: cosmetic ones only if they moved; moved and modified-and-moved are told apart."""
    kept = entries.filter(~F.col("cosmetic") | F.col("position_changed"))
    look = F.when(F.col("cosmetic"), "moved").when((F.col("kind") == "modified") & F.col("position_changed"), "modified_moved").otherwise(F.col("kind"))
    return kept.withColumn("look", look)


# --- sinks -----------------------------------------------------------------------
def envelope(rows: DataFrame, schema: str | None, pretty: bool = False) -> DataFrame:
    """Each row as JSON with its schema tag, if any, first; empty lists, empty maps and nulls left out."""
    fields = []
    for f in rows.schema.fields:
        col = F.col(f.name)
        if f.dataType.typeName() in ("array", "map"):
            col = F.when(F.size(col) > 0, col)
        fields.append(col.alias(f.name))
    options = {"pretty": "true"} if pretty else {}
    return rows.select(F.to_json(F.struct(*([] if schema is None else [F.lit(schema).alias("schema")]), *fields), options).alias("json"))


def diff_text(entries: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """One text report for each file: counts, rows and nets."""
    live, net = ~F.col("cosmetic"), F.col("element").startswith("net:")
    params = F.when(F.col("kind") == "modified", F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(F.lit("\n      "), e["key"], F.lit(": "), e["value"])), ""))
    row = F.concat(F.lit("  "), X.marker(F.col("kind"), F.col("element")), F.lit(" "), F.col("element"), F.coalesce(params, F.lit("")))
    rank = F.when(net, F.when(F.col("kind") == "added", 1).otherwise(2)).otherwise(0)
    own = entries.withColumn("_row", F.when(live & (F.col("element") != "layout"), F.struct(rank.alias("r"), F.col("element").alias("e"), row.alias("t"))))
    found = own.groupBy(*keys).agg(F.sum((live & ~net).cast("int")).alias("n"), F.sum((~live & ~net).cast("int")).alias("c"), F.bool_or(live).alias("some"), F.array_sort(F.collect_list("_row")).alias("rows"))
    head = F.concat(F.format_string("Archivo : %s\nCambios : %d", F.col(path), F.col("n")), F.when(F.col("c") > 0, F.format_string("\nCosméticos: %d", F.col("c"))).otherwise(""), F.lit("\n\n"))
    body = F.array_join(F.transform("rows", lambda r: r["t"]), "\n")
    return found.select(*keys, F.when(F.col("some"), F.concat(head, body)).otherwise("Sin cambios semanticos.").alias("text"))


def log_text(commits: DataFrame, files: DataFrame) -> DataFrame:
    """One text block for each commit; ``files`` has oid, path and phrase."""
    line = F.concat(F.lit("          "), F.col("path"), F.lit("    "), F.col("phrase"))
    per = files.groupBy("oid").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_files"))
    refs = F.when(F.size("refs") > 0, F.concat(F.lit(" ("), F.array_join("refs", ", "), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("* "), X.short_id(F.col("oid")), refs, F.when(F.col("is_merge"), " [merge]").otherwise(""), F.lit("  "), X.first_line(F.col("message")), F.lit("\n          "), F.col("author"), F.lit(" · "), X.timestamp_text(F.col("ts")))
    body = F.when(F.col("is_merge"), "          (merge commit; v1 no calcula diff por archivo)").when(F.col("is_root"), "          (commit raíz)").otherwise(F.coalesce("_files", F.lit("          (sin cambios reconocidos)")))
    return commits.join(per, "oid", "left").select("oid", "ts", F.concat_ws("\n", head, body).alias("text"))


def stat_text(commits: DataFrame, files: DataFrame, stats: DataFrame) -> DataFrame:
    """(oid, ts, text): id, author and files of each commit that has files, then its counts by format."""
    paths = files.groupBy("oid").agg(F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("_paths"))
    line = F.format_string("  %s: +%d -%d ~%d", F.coalesce("format", F.lit("?")), "added", "removed", "modified")
    counts = stats.groupBy("oid").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    own = commits.join(paths, "oid").join(counts, "oid", "left")
    head = F.concat_ws("  ", X.short_id(F.col("oid")), "author", X.timestamp_text(F.col("ts")), "_paths")
    return own.select("oid", "ts", F.concat_ws("\n", head, "_lines").alias("text"))


def status_header(branch: DataFrame) -> DataFrame:
    vs = F.when(F.col("upstream").isNotNull(), F.concat(F.lit(" — vs "), F.col("upstream"), F.lit(": "), X.upstream_phrase(F.col("ahead"), F.col("behind")))).otherwise("")
    return branch.select(F.concat(F.lit("En rama "), F.col("name"), F.lit(" (HEAD "), F.col("head_short"), F.lit(")"), vs).alias("text"))


def status_lines(summaries: DataFrame, include_unknown: bool = False) -> DataFrame:
    """(section, path, text) lines of a status report in its five sections."""
    section = F.when(F.col("category") == "semantic", 0).when(F.col("category") == "cosmetic", 1).when(F.col("category") == "unchanged", 2).when(F.col("category") == "error", 3).otherwise(4)
    tail = F.when(F.col("category") == "semantic", X.counts_phrase(F.col("counts"))).when(F.col("category") == "cosmetic", "(solo cambios cosméticos)")
    if "errors" in summaries.columns:
        tail = tail.when(F.col("category") == "error", F.coalesce(F.get("errors", F.lit(0)), F.lit("(sin detalle)")))
    lines = summaries.select(section.alias("section"), "path", F.concat(F.lit("  "), F.concat_ws("    ", "path", tail)).alias("text"))
    if include_unknown:
        return lines
    count = lines.filter("section = 4").groupBy("section").agg(F.lit("").alias("path"), F.format_string("No reconocidos (%d): use --include-unknown para listarlos.", F.count("*")).alias("text"))
    return lines.filter("section < 4").unionByName(count.filter("text is not null"))


def full_report_text(entries: DataFrame, warnings: DataFrame, keys: list[str]) -> DataFrame:
    """Entry list with cosmetic tags, then the driver's warnings, of each file."""
    mark = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "removed", "-").otherwise("~")
    row = F.concat(F.lit("      "), mark, F.lit(" "), F.col("element"), F.when(F.col("cosmetic"), " [cosmetic]").otherwise(""))
    own = entries.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("_rows"))
    notes = warnings.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("        - "), "message"))), "\n").alias("_notes"))
    both = own.join(notes, keys, "full")
    return both.select(*keys, F.concat_ws("\n", F.lit("      ── reporte completo ──"), F.coalesce("_rows", F.lit("      (sin entradas)")), F.when(F.col("_notes").isNotNull(), F.concat(F.lit("      avisos del driver:\n"), "_notes"))).alias("text"))
