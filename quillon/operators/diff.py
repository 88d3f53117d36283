"""Two-sided diffs of keyed rows: full outer joins and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARROW
from ..session import stage

PLACEMENT = ("x", "y", "rotation", "mirror")


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], content: list[str], placement: list[str] = ()) -> DataFrame:
    """One row for each key that differs: kind, cosmetic, position_changed, before and after.

    Added and removed keys lie on one side only.  A change of placement columns
    alone is cosmetic.
    """
    cols = [*content, *placement]
    left = a.select(*keys, F.struct(*cols).alias("before"))
    right = b.select(*keys, F.struct(*cols).alias("after"))
    both = left.join(right, keys, "full")
    differs = lambda names: _any(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in names)
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    two = F.col("before").isNotNull() & F.col("after").isNotNull()
    changed, moved = differs(content), differs(placement)
    out = both.withColumn("kind", kind).withColumn("position_changed", two & moved).withColumn("cosmetic", two & moved & ~changed)
    return out.filter(~two | changed | moved).select(*keys, "kind", "cosmetic", "position_changed", "before", "after")


def _any(tests) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def param_diff(before: Column, after: Column, skip: tuple[str, ...] = PLACEMENT) -> Column:
    """Map of ``key: old → new`` over the union of keys; new and deleted keys are named so."""
    none = F.create_map().cast("map<string,string>")
    text = lambda k, x, y: F.when(x.isNull(), F.concat(F.lit(f"(nuevo){ARROW}"), y)).when(y.isNull(), F.concat(x, F.lit(f"{ARROW}(eliminado)"))).otherwise(F.concat(x, F.lit(ARROW), y))
    both = F.map_zip_with(F.coalesce(before, none), F.coalesce(after, none), lambda k, x, y: F.when(~x.eqNullSafe(y), text(k, x, y)))
    return F.map_filter(both, lambda k, v: v.isNotNull() & ~k.isin(*skip))


def param_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The same diff on long rows (keys, key, value): one row for each parameter that differs."""
    left = a.withColumnRenamed("value", "before")
    right = b.withColumnRenamed("value", "after")
    return left.join(right, [*keys, "key"], "full").filter(~F.col("before").eqNullSafe(F.col("after"))).filter(~F.col("key").isin(*PLACEMENT))


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with ``side`` added or removed; one shuffle for both directions."""
    names = a.columns
    flags = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    seen = flags.groupBy(*names).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return seen.filter("_a <> _b").select(*names, F.when(F.col("_b") == 1, "added").otherwise("removed").alias("side"))


def move_all(a: DataFrame, b: DataFrame, group: list[str], keys: list[str], content: list[str], placement: list[str], share: float = 0.8) -> DataFrame:
    """For each group whether more than ``share`` of common rows changed placement alone."""
    left, right = a.alias("l"), b.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*group, *keys]]
    same = ~_any(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in content)
    moved = _any(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in placement)
    both = left.join(right, on).select(*[F.col(f"l.{g}").alias(g) for g in group], (same & moved).cast("long").alias("m"))
    found = both.groupBy(*group).agg(F.count("*").alias("common"), F.sum("m").alias("moved"))
    return found.withColumn("is_move_all", F.col("moved") > F.col("common") * share)


def rename_pairs(removed: DataFrame, added: DataFrame, keys: list[str], name: str, same: list[str]) -> DataFrame:
    """(old, new) of removed and added rows equal in ``same``, where the pairing is unique on both sides.

    Equality goes by a hash of the content first, so the join has one key.
    """
    digest = lambda df: df.withColumn("_h", F.xxhash64(*keys, *same)).withColumn("_n", F.count("*").over(Window.partitionBy("_h"))).filter("_n = 1")
    old = digest(removed).select("_h", *keys, F.col(name).alias("old"), *[F.col(c).alias(f"_o_{c}") for c in same])
    new = digest(added).select("_h", *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(name).alias("new"), *[F.col(c).alias(f"_n_{c}") for c in same])
    equal = F.lit(True)
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    for c in same:
        equal = equal & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    return old.join(new, "_h").filter(equal).select(*keys, "old", "new", F.concat("old", F.lit(ARROW), "new").alias("element"))


def line_diff(rows: DataFrame, path: str, order: str, text: str) -> DataFrame:
    """Lines added and removed between consecutive revisions of each file."""
    last = F.lag(text).over(Window.partitionBy(path).orderBy(order))
    before, after = F.split(F.col("_last"), "\n"), F.split(F.col(text), "\n")
    kept = rows.withColumn("_last", last).filter(F.col("_last").isNotNull())
    return kept.select(path, order, F.size(F.array_except(after, before)).cast("long").alias("lines_added"), F.size(F.array_except(before, after)).cast("long").alias("lines_removed"))


def changed_files(a: DataFrame, b: DataFrame, blobs: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """path, status and old_path between two trees (path, blob_sha); equal blobs pair as renames.

    A removed and an added path of the same blob pair in path order.  With ``blobs``
    (blob_sha, content) what is left pairs by similarity of at least ``threshold``.
    """
    both = a.select("path", F.col("blob_sha").alias("sa")).join(b.select("path", F.col("blob_sha").alias("sb")), "path", "full")
    diff = both.filter(~F.col("sa").eqNullSafe(F.col("sb")))
    turn = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = diff.filter("sb is null").select("path", "sa", turn("sa").alias("k"))
    new = diff.filter("sa is null").select("path", "sb", turn("sb").alias("k"))
    pairs = new.alias("n").join(gone.alias("g"), (F.col("n.sb") == F.col("g.sa")) & (F.col("n.k") == F.col("g.k")))
    renamed = pairs.select(F.col("n.path").alias("path"), F.lit("renamed").alias("status"), F.col("g.path").alias("old_path"))
    if blobs is not None:
        renamed = stage(renamed)
        left = gone.select("path", F.col("sa").alias("blob_sha")).join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti")
        right = new.select("path", F.col("sb").alias("blob_sha")).join(renamed.select("path"), "path", "left_anti")
        similar = similar_files(left, right, blobs, threshold)
        renamed = renamed.unionByName(similar.select("path", F.lit("renamed").alias("status"), "old_path"))
    used = renamed.select("path").unionByName(renamed.select(F.col("old_path").alias("path")))
    rest = diff.join(used, "path", "left_anti")
    status = F.when(F.col("sa").isNull(), "added").when(F.col("sb").isNull(), "removed").otherwise("modified")
    return renamed.unionByName(rest.select("path", status.alias("status"), F.lit(None).cast("string").alias("old_path")))


# --- similar files ----------------------------------------------------------------
#: A span ends at a line feed, or after 64 bytes without one.
SPAN = r"[^\n]{0,63}\n|[^\n]{1,64}"


def spans(blobs: DataFrame) -> DataFrame:
    """(blob_sha, span, bytes, size): the distinct spans of each blob with the bytes that they hold in it; CR before LF does not count."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    one = blobs.select("blob_sha", F.length(text).alias("size"), F.explode(F.regexp_extract_all(text, F.lit(f"({SPAN})"), 1)).alias("_s"))
    return one.groupBy("blob_sha", "size", F.md5("_s").alias("span")).agg(F.sum(F.length("_s")).alias("bytes"))


def similar_blobs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(old, new, score) of blobs that share at least ``threshold`` of the bytes of the larger one.

    Only the rarest spans of a blob are joined: those that hold all but ``threshold`` of its
    bytes, as a similar blob cannot miss all of them.  Pairs that meet so are then measured
    on all their spans.  Spans that stand everywhere are in few of these prefixes.
    """
    left, right = stage(left), stage(right)
    seen = left.select("span").unionByName(right.select("span")).groupBy("span").agg(F.count("*").alias("_df"))

    def rare(table: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("bytes").over(Window.partitionBy("blob_sha").orderBy("_df", "span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return table.join(seen, "span").withColumn("_before", before).filter(F.col("_before") <= F.col("size") * (1 - threshold)).select("blob_sha", "size", "span")

    near = rare(left).withColumnsRenamed({"blob_sha": "old", "size": "_so"}).join(rare(right).withColumnsRenamed({"blob_sha": "new", "size": "_sn"}), "span")
    near = near.filter(F.least("_so", "_sn") >= F.greatest("_so", "_sn") * threshold).select("old", "new").distinct()
    mine = left.select(F.col("blob_sha").alias("old"), "span", F.col("bytes").alias("_bo"), F.col("size").alias("_so"))
    theirs = right.select(F.col("blob_sha").alias("new"), "span", F.col("bytes").alias("_bn"), F.col("size").alias("_sn"))
    kept = near.join(mine, "old").join(theirs, ["new", "span"]).groupBy("old", "new").agg((F.sum(F.least("_bo", "_bn")) / F.max(F.greatest("_so", "_sn"))).alias("score"))
    return kept.filter(F.col("score") >= threshold)


def similar_files(removed: DataFrame, added: DataFrame, blobs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(old_path, path, score): removed and added paths paired one to one, the most similar first.

    Ties go to equal file names, then by path.  Copies of one blob stand for each other in path order.  In each round
    every pair that is the best of both its paths is taken, which gives the pairs of a walk down
    the sorted list.
    """
    ids = lambda t: t.select("blob_sha").distinct()
    table = blobs.dropDuplicates(["blob_sha"])
    scores = similar_blobs(spans(table.join(ids(removed), "blob_sha", "left_semi")), spans(table.join(ids(added), "blob_sha", "left_semi")), threshold)
    turn = F.row_number().over(Window.partitionBy("blob_sha").orderBy("path"))
    old = removed.withColumn("_k", turn).select(F.col("path").alias("old_path"), F.col("blob_sha").alias("old"), "_k")
    new = added.withColumn("_k", turn).select("path", F.col("blob_sha").alias("new"), "_k")
    name = lambda c: F.substring_index(c, "/", -1)
    rank = F.struct((-F.col("score")).alias("s"), (name("old_path") != name("path")).alias("n"), F.col("path").alias("p"), F.col("old_path").alias("o"))
    left = stage(scores.join(old, "old").join(new, ["new", "_k"]).select("old_path", "path", "score", rank.alias("_rank")))
    taken = left.select("old_path", "path", "score").limit(0)
    while not left.isEmpty():
        best = lambda c: F.min("_rank").over(Window.partitionBy(c))
        won = stage(left.withColumn("_a", best("old_path")).withColumn("_b", best("path")).filter("_rank = _a and _rank = _b").select("old_path", "path", "score"))
        taken = taken.unionByName(won)
        left = stage(left.join(won.select("old_path"), "old_path", "left_anti").join(won.select("path"), "path", "left_anti"))
    return taken
