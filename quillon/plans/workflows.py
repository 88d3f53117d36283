"""Orchestrated queries: file diff, working-tree status and annotated history.

Each is one set-at-a-time plan over all files and commits: pair both blobs of
every changed file, decode each distinct blob once, diff by key, summarise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import predicates as P
from ..functions import text as X
from ..operators import blobs as B
from ..operators import diff as D
from ..operators import history, layout, regions, summary
from ..session import ship_package, stage
from ..sources import decoded as kept
from ..sources import layout as stream
from ..sources import repository, schematic

ENTRY = ("element", "kind", "cosmetic", "position_changed", "before", "after", "section")


@dataclass
class Options:
    """``missing_side``: all_changes takes an absent side as empty; warn gives a warning and no changes.

    ``kinds`` (driver names) and ``element`` (a component, net or cell) keep the commits of a log that change such
    files or that element; the limit counts what they keep.  ``store`` is a folder that keeps decoded layouts between calls.
    """

    threshold_um2: float = 0.01
    missing_side: str = "all_changes"
    size_cap: int = P.SIZE_CAP
    level: str = "summary"
    patterns: list[str] = field(default_factory=list)
    limit: int | None = 20
    limit_after_filter: bool = False
    kinds: tuple[str, ...] = ()
    element: str | None = None
    store: str | None = None
    drivers: list[Driver] = field(default_factory=list)


@dataclass
class Driver:
    """A format driver: what decides that it takes a file, how two sides become entries, and a hook before the diff.

    ``entries`` takes (sides, keys, options) and gives (entries, warnings); ``normalize`` changes a
    content column before it is decoded and is the identity unless given.  With ``checked`` a side
    that is not of the driver's format leaves the comparison with a warning.
    """

    name: str
    accepts: Callable[[Column], Column]
    entries: Callable[[DataFrame, list[str], Options], tuple[DataFrame, DataFrame | None]]
    normalize: Callable[[Column], Column] = lambda content: content
    checked: bool = False


def schematic_entries(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Diff entries of schematic files; ``sides`` has keys, side ('a' or 'b') and content.

    Components by name, nets by set difference, a layout marker where more than
    four fifths of the common components only moved; renames are told apart.
    """
    own = schematic.components(sides, [*keys, "side"])
    a, b = own.filter("side = 'a'").drop("side"), own.filter("side = 'b'").drop("side")
    found = _component_diff(a, b, keys)
    same = ["symbol", "params_text", "x", "y", "rotation", "mirror"]
    flat = lambda df, kind, side: df.filter(F.col("kind") == kind).select(*keys, "name", f"{side}.*")
    renamed = D.rename_pairs(flat(found, "removed", "before"), flat(found, "added", "after"), keys, "name", same)
    gone = renamed.select(*keys, F.col("old").alias("name")).unionByName(renamed.select(*keys, F.col("new").alias("name")))
    plain = found.join(gone, [*keys, "name"], "left_anti")
    shown = lambda c: F.when(F.col(c).isNotNull(), F.map_concat(F.create_map(F.lit("symbol"), F.col(f"{c}.symbol"), *[v for k in ("x", "y", "rotation", "mirror") for v in (F.lit(k), F.col(f"{c}.{k}").cast("string"))]), F.col(f"{c}.params")))
    rows = plain.select(*keys, F.col("name").alias("element"), "kind", "cosmetic", "position_changed", shown("before").alias("before"), shown("after").alias("after"))
    none = F.lit(None).cast("map<string,string>")
    moved = renamed.select(*keys, "element", F.lit("modified").alias("kind"), F.lit(False).alias("cosmetic"), F.lit(False).alias("position_changed"), none.alias("before"), none.alias("after"))
    nets = schematic.nets(sides, [*keys, "side"])
    net = D.set_diff(nets.filter("side = 'a'").drop("side"), nets.filter("side = 'b'").drop("side"))
    net = net.select(*keys, F.concat(F.lit("net:"), "net").alias("element"), F.col("side").alias("kind"), F.lit(False).alias("cosmetic"), F.lit(False).alias("position_changed"), none.alias("before"), none.alias("after"))
    text = lambda df: df.withColumn("_t", F.concat_ws("|", "symbol", F.to_json(F.array_sort(F.map_entries("params")))))
    all_moved = D.move_all(text(a), text(b), keys, ["name"], ["_t"], ["x", "y", "rotation", "mirror"]).filter("is_move_all")
    marker = all_moved.select(*keys, F.lit("layout").alias("element"), F.lit("modified").alias("kind"), F.lit(True).alias("cosmetic"), F.lit(True).alias("position_changed"), none.alias("before"), none.alias("after"))
    out = rows.unionByName(moved).unionByName(net).unionByName(marker)
    return out.withColumn("section", F.when(F.col("element") == "layout", 2).when(F.col("element").startswith("net:"), 1).otherwise(0))


def _component_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed diff with the parameters compared as one canonical text and carried along."""
    text = lambda df: df.withColumn("params_text", F.to_json(F.array_sort(F.map_entries("params"))))
    found = D.keyed_diff(text(a), text(b), [*keys, "name"], ["symbol", "params_text"], ["x", "y", "rotation", "mirror"])
    maps = lambda df, c: df.select(*keys, "name", F.col("params").alias(c))
    both = found.join(maps(a, "_pa"), [*keys, "name"], "left").join(maps(b, "_pb"), [*keys, "name"], "left")
    both = both.withColumn("before", F.when(F.col("before").isNotNull(), F.col("before").withField("params", F.col("_pa"))))
    return both.withColumn("after", F.when(F.col("after").isNotNull(), F.col("after").withField("params", F.col("_pb")))).drop("_pa", "_pb")


def layout_entries(sides: DataFrame, keys: list[str], threshold: float = 0.01, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings) of layout files; ``sides`` has keys, side and content.

    Only cells whose geometry differs, and the cells above them, are flattened
    and compared; both sides are scaled by side B's unit.
    """
    tagged = sides.withColumn("blob_sha", F.sha2("content", 256)).withColumn("path", F.to_json(F.struct(*keys)))
    names = tagged.select("path", *keys).distinct()
    distinct = tagged.select("blob_sha", "content").dropDuplicates(["blob_sha"])
    decoded = stage(stream.decode_blobs(distinct)) if store is None else kept.through(sides.sparkSession, store, distinct, stream.decode_blobs, f"layout {stream.VERSION}")
    t = stream.tables(decoded, tagged.select(F.col("side").alias("rev"), "path", "blob_sha"))
    of = lambda name, side: t[name].filter(F.col("rev") == side).drop("rev")
    bad = t["errors"].select("path").distinct()
    good = lambda df: df.join(bad, "path", "left_anti")
    cells = layout.cell_entries(good(of("cells", "a")), good(of("cells", "b")), ["path"])
    refs = t["references"].filter(F.col("child").isNotNull())
    moved = D.set_diff(refs.filter("rev = 'a'").drop("rev"), refs.filter("rev = 'b'").drop("rev")).select("path", "cell")
    changed = layout.changed_cells(of("polygons", "a"), of("polygons", "b"), refs.drop("rev").distinct(), ["path"], moved)
    common = of("cells", "a").select("path", "cell").intersect(of("cells", "b").select("path", "cell"))
    wanted = stage(changed.join(common, ["path", "cell"], "left_semi"))
    def flattened(side: str) -> DataFrame:
        own = of("polygons", side).withColumnRenamed("path", "file")
        below = of("references", side).withColumnRenamed("path", "file")
        return layout.flatten(own, below, ["file"]).join(wanted.withColumnRenamed("path", "file"), ["file", "cell"], "left_semi").drop("path")

    pieces = stage(regions.xor(flattened("a"), flattened("b"), ["file", "cell", "layer", "datatype"]))
    pieces = pieces.withColumn("id", F.struct("layer", "datatype", "piece")).withColumn("cx", (F.col("min_x") + F.col("max_x")) / 2).withColumn("cy", (F.col("min_y") + F.col("max_y")) / 2)
    # added regions belong to references of side B, removed ones to those of side A
    sided = lambda name: t[name].withColumnRenamed("path", "file").withColumn("side", F.when(F.col("rev") == "b", "added").otherwise("removed")).drop("rev")
    boxes = stage(layout.reference_boxes(sided("polygons"), sided("references").filter(F.col("child").isNotNull()), ["file", "side"]))
    placed = layout.attribute(pieces, boxes.join(wanted.withColumnRenamed("path", "file"), ["file", "cell"], "left_semi"), ["file", "cell", "side"], "id")
    origin = F.when(F.col("child").isNull(), F.array("cell")).otherwise(F.array("cell", "child"))
    unit = of("libraries", "b").select(F.col("path").alias("file"), (F.col("unit_m") / 1e-6).alias("unit_um"))
    scaled = placed.withColumn("origin", origin).join(unit, "file", "left").withColumn("unit_um", F.coalesce("unit_um", F.lit(1.0)))
    metrics = layout.piece_metrics(scaled, ["file", "cell", "layer", "datatype"], F.col("unit_um"), threshold).withColumnRenamed("file", "path")
    rows = layout.geometry_entries(metrics).select("path", *ENTRY).unionByName(cells.select("path", *ENTRY))
    code = F.when(F.col("message") == "not_gdsii", "not_gdsii").otherwise("parse")
    warnings = t["errors"].select("path", P.layout_warning(code, F.col("path"), F.col("rev"), F.col("message")).alias("message"))
    return rows.join(names, "path").select(*keys, *ENTRY), warnings.join(names, "path").select(*keys, "message")


def two_sides(paired: DataFrame, keys: list[str], driver: str, missing_side: str) -> tuple[DataFrame, DataFrame]:
    """(sides, warnings) of paired blobs of one driver; invalid sides leave the comparison with a warning."""
    own = paired
    wanted = "xschem" if driver == "schematic" else "gds"
    both = own.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("content")) for s, c in (("a", "before"), ("b", "after"))])).alias("s")).select(*keys, "s.*")
    warn = F.when(F.col("content").isNotNull(), P.side_warning(F.col("content"), F.col("path"), F.upper("side"), wanted) if driver == "schematic" else F.when(P.detect_format(F.col("content")) != "gds", P.layout_warning(F.lit("not_gdsii"), F.col("path"), F.upper("side"), F.lit(""))))
    if missing_side == "warn":
        warn = F.when(F.col("content").isNull(), F.format_string("%s (%s): lado vacío", "path", F.upper("side"))).otherwise(warn)
    checked = both.withColumn("message", warn)
    bad = checked.filter("message is not null").select(*keys, "message")
    sides = checked.join(bad.select(*keys).distinct(), keys, "left_anti").filter("content is not null").drop("message")
    return sides, bad


def built_in() -> list[Driver]:
    """The drivers that every comparison has, behind those of the options."""
    def layouts(sides: DataFrame, keys: list[str], options: Options) -> tuple[DataFrame, DataFrame | None]:
        if sides.isEmpty():
            return sides.sparkSession.createDataFrame([], schematic_entries(sides, keys).select(*keys, *ENTRY).schema), None
        return layout_entries(sides, keys, options.threshold_um2, options.store)

    of = lambda name: lambda path: F.coalesce(P.driver_of(path) == name, F.lit(False))
    return [Driver("schematic", of("schematic"), lambda sides, keys, options: (schematic_entries(sides, keys), None), checked=True), Driver("layout", of("layout"), layouts, checked=True)]


def format_of(path: Column, options: Options) -> Column:
    """Name of the driver that takes a path, null if none does."""
    found = F.lit(None).cast("string")
    for driver in reversed([*options.drivers, *built_in()]):
        found = F.when(driver.accepts(path), driver.name).otherwise(found)
    return found


def diff_files(paired: DataFrame, keys: list[str], options: Options) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings) of paired files of all drivers; ``paired`` has keys (path among them), before and after."""
    return run_drivers(paired, keys, [*options.drivers, *built_in()], options)


def run_drivers(paired: DataFrame, keys: list[str], drivers: list[Driver], options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings) of paired files by given drivers; the first that accepts a path takes it."""
    options = options or Options()
    found, taken = None, F.lit(False)
    notes = paired.select(*keys, F.lit("").alias("message")).limit(0)
    for driver in drivers:
        own = paired.filter(driver.accepts(F.col("path")) & ~taken).withColumns({c: driver.normalize(F.col(c)) for c in ("before", "after")})
        taken = taken | driver.accepts(F.col("path"))
        if driver.checked:
            both, bad = two_sides(own, keys, driver.name, options.missing_side)
            notes = notes.unionByName(bad)
        else:
            both = own.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("content")) for s, c in (("a", "before"), ("b", "after"))])).alias("s")).select(*keys, "s.*").filter("content is not null")
        rows, warnings = driver.entries(both, keys, options)
        rows = rows.select(*keys, *ENTRY) if set(ENTRY) <= set(rows.columns) else rows
        found = rows if found is None else found.unionByName(rows)
        notes = notes if warnings is None else notes.unionByName(warnings.select(*keys, "message"))
    return found, notes


def diff(spark: SparkSession, repo: str, a: str, b: str, path: str, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings) of one file between two commits."""
    options = options or Options()
    root = repository.discover(repo)
    ends = [repository.resolve(root, c) for c in (a, b)]
    if None in ends:
        raise ValueError(f"commit not found: {a if ends[0] is None else b}")
    ship_package(spark)
    pair = spark.createDataFrame([(*ends, path)], "parent string, oid string, path string")
    tree = repository.tree_entries(spark.createDataFrame([(e,) for e in sorted(set(ends))], "oid string"), root).filter(F.col("path") == path)
    body = repository.blobs(tree, root, options.size_cap)
    found = B.pair(pair.withColumn("status", F.lit("modified")).withColumn("old_path", F.lit(None).cast("string")), tree, body, options.size_cap)
    entries, warnings = diff_files(found, ["path"], options)
    large = found.filter("before_code = 'large' or after_code = 'large'").select("path", F.concat("path", F.lit(": blob demasiado grande")).alias("message"))
    return entries, warnings.unionByName(large)


def log(spark: SparkSession, tables: dict[str, DataFrame], options: Options | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, file summaries, warnings) of a history snapshot; unchanged files are left out."""
    options = options or Options()
    commits, files, entries, warnings = log_entries(tables, options)
    own = summary.file_summaries(files.select("oid", "path", "format"), entries, ["oid", "path"], options.level)
    return commits, own.filter("category <> 'unchanged'"), warnings


def log_entries(tables: dict[str, DataFrame], options: Options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(commits, files, entries, warnings) of a history snapshot."""
    keys = ["oid", "path"]
    narrowed = bool(options.kinds) or options.element is not None
    commits, files = history.log(tables["commits"], tables["changed_files"], tables["refs"], options.patterns, None if narrowed else options.limit, options.limit_after_filter)
    if options.kinds:
        commits, files = history.narrow(commits, files, kinds=options.kinds)
        if options.element is None:
            commits, files = first_of(commits, files, options.limit)
    paired = stage(B.pair(files.select("parent", *keys, "status", "old_path"), tables["tree_entries"], tables["blobs"], options.size_cap))
    entries, warnings = diff_files(paired, keys, options)
    entries = stage(entries)
    if options.element is not None:
        commits, files = history.narrow(commits, files, entries=entries, element=options.element)
        commits, files = first_of(commits, files, options.limit)
        entries = entries.join(files.select(*keys), keys, "left_semi")
    return commits, files, entries, warnings


def first_of(commits: DataFrame, files: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """The newest commits that narrowing kept, and their files."""
    commits = stage(history.newest(commits, limit))
    return commits, files.join(commits.select("oid"), "oid", "left_semi")


def metric_history(tables: dict[str, DataFrame], path: str, metric: str, size_cap: int = P.SIZE_CAP) -> DataFrame:
    """(oid, ts, path, value) of a measured value at each commit that touches a log file, newest first; one row for each line that gives it, none for a file that is not UTF-8."""
    own = history.touches(tables["changed_files"], tables["tree_entries"], tables["commits"], path).select("oid", "ts")
    at = tables["tree_entries"].filter((F.col("path") == path) & P.within_cap(F.col("size"), size_cap)).join(own, "oid")
    texts = at.join(tables["blobs"], "blob_sha").select("oid", "ts", "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return measured(texts, ["oid", "ts", "path"], metric).orderBy(F.desc("ts"), "oid", "value")


def measured(texts: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, value) of one measured value of texts, whatever the case of its name."""
    from .notes import measurements

    return measurements(texts, keys).filter(F.col("name") == metric.lower()).select(*keys, "value")


def status(spark: SparkSession, repo: str, options: Options | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(branch, file summaries, warnings) of the work tree against HEAD."""
    options = options or Options()
    root = repository.discover(repo)
    branch = repository.branch(spark, root)
    changes = repository.working_changes(spark, root).filter(P.path_filter(F.col("path"), options.patterns))
    tree = repository.tree_entries(branch.select(F.col("head_oid").alias("oid")), root) if not branch.isEmpty() else spark.createDataFrame([], "oid string, path string, blob_sha string, size long")
    head = tree.join(changes.select(F.coalesce("old_path", "path").alias("path")), "path", "left_semi")
    body = head.join(repository.blobs(head, root, options.size_cap), "blob_sha").select(F.col("path").alias("_from"), F.col("content").alias("before"))
    disk = repository.working_files(spark, root).filter(P.within_cap(F.col("size"), options.size_cap)).select("path", F.col("content").alias("after"))
    paired = stage(changes.withColumn("_from", F.coalesce("old_path", "path")).join(body, "_from", "left").join(disk, "path", "left"))
    entries, warnings = diff_files(paired, ["path"], options)
    files = changes.select("path", format_of(F.col("path"), options).alias("format"))
    return branch, summary.file_summaries(files, stage(entries), ["path"], options.level).orderBy("path"), warnings


def split_report(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each file: components, nets_added, nets_removed and is_move_all.

    A cosmetic layout marker stands for the move of all; other entries of the marker and changed nets are left out.
    """
    net, marker = P.is_net(F.col("element")), P.is_layout_marker(F.col("element"))
    plain = F.struct(F.col("element").alias("name"), "kind", "cosmetic", "position_changed", "before", "after")
    # maps are not ordered, so the order goes by the name and the rest follows as it comes
    row = F.when(~net & ~marker, F.struct(F.col("element").alias("o"), F.to_json(plain).alias("j")))
    names = lambda k: F.array_sort(F.collect_list(F.when(net & (F.col("kind") == k), P.net_name(F.col("element")))))
    found = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), names("added").alias("nets_added"), names("removed").alias("nets_removed"), F.bool_or(marker & F.col("cosmetic")).alias("is_move_all"))
    parts = "name string, kind string, cosmetic boolean, position_changed boolean, before map<string,string>, after map<string,string>"
    return found.select(*keys, F.transform("_rows", lambda r: F.from_json(r["j"], parts)).alias("components"), "nets_added", "nets_removed", "is_move_all")


def diff_payload(entries: DataFrame, warnings: DataFrame, path: str) -> DataFrame:
    """The one JSON document of a file diff: file, warnings, components, nets_added, nets_removed, is_move_all."""
    spark = entries.sparkSession
    one = spark.createDataFrame([(path,)], "file string")
    report = split_report(entries.withColumn("file", F.lit(path)), ["file"])
    notes = warnings.agg(F.array_sort(F.collect_list("message")).alias("warnings")).withColumn("file", F.lit(path))
    none = F.array().cast("array<string>")
    own = one.join(report, "file", "left").join(notes, "file", "left")
    return own.select(F.to_json(F.struct("file", "warnings", F.coalesce("components", F.from_json(F.lit("[]"), report.schema["components"].dataType)).alias("components"), F.coalesce("nets_added", none).alias("nets_added"), F.coalesce("nets_removed", none).alias("nets_removed"), F.coalesce("is_move_all", F.lit(False)).alias("is_move_all")), {"pretty": "true"}).alias("json"))


def diff_views(report: DataFrame, scene_a: DataFrame, scene_b: DataFrame, keys: list[str], tab: str) -> DataFrame:
    """Drawing elements of a view: before shows side A, after side B, diff side B with ghosts of side A below it.

    Ghosts are the components of A that moved or are gone, renamed ones by their old names;
    scenes have keys, component and their elements.
    """
    if tab == "before":
        return scene_a.withColumn("ghost", F.lit(False))
    own = scene_b.withColumn("ghost", F.lit(False))
    return own if tab == "after" else own.unionByName(ghosts(report, scene_a, keys).withColumn("ghost", F.lit(True)))


def ghosts(report: DataFrame, scene_a: DataFrame, keys: list[str]) -> DataFrame:
    """Elements of side A of the components that moved or are gone."""
    gone = report.filter(F.col("position_changed") | (F.col("kind") == "removed")).select(*keys, X.old_name(F.col("element")).alias("component")).distinct()
    return scene_a.join(gone, [*keys, "component"], "left_semi")


def component_boxes(report: DataFrame, scene_b: DataFrame, keys: list[str]) -> DataFrame:
    """Box of each changed component among the elements of side B, renamed ones by their new names; no row without elements."""
    box = scene_b.groupBy(*keys, "component").agg(*[f(c).alias(c) for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])
    own = report.withColumn("component", X.new_name(F.col("element")))
    return own.join(box, [*keys, "component"]).select(*keys, "element", "kind", *G.BOX)


def scene_length(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """Number of elements of each scene and whether it is empty; scenes without elements have a null kind."""
    return scenes.groupBy(*keys).agg(F.count("kind").alias("length")).withColumn("is_empty", F.col("length") == 0)


def exit_code(summaries: DataFrame) -> int:
    """0 without semantic changes, 1 with, 2 where a file could not be analysed."""
    found = summaries.agg(summary.has_semantic(summaries), F.coalesce(F.bool_or(F.col("category") == "error"), F.lit(False)).alias("e")).first()
    return 2 if found["e"] else int(found["has_semantic"])
