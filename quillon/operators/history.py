"""Commit graphs: reachability, first parents, references, filtered logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import driver_of, path_filter
from ..session import release
from ..session import stage as checkpointed


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node reachable from each start, itself included, by squared jumps.

    ``edges`` are (child, parent), ``starts`` (start, node).  Round k follows
    jumps of exactly 2^k steps from all nodes within fewer than 2^k, so a chain
    of n commits takes log n rounds; distinct keeps merges from multiplying paths.
    A round without a new node is the last: nodes farther off lie behind nearer
    ones.  So cycles end too.
    """
    jumps = checkpointed(edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).filter("u is not null and v is not null").distinct())
    seen, many = checkpointed(starts.select("start", "node").distinct()), -1
    while many != (many := seen.count()) and not jumps.isEmpty():
        step = seen.join(jumps, seen["node"] == jumps["u"]).select("start", F.col("v").alias("node"))
        before, seen = seen, checkpointed(seen.unionByName(step).distinct())
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.v") == F.col("b.u"))
        old, jumps = jumps, checkpointed(twice.select(F.col("a.u").alias("u"), F.col("b.v").alias("v")).distinct())
        release(edges.sparkSession, before, old)
    return seen


def segments(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of a graph: (node, segment, place) and (segment, parent segment) edges.

    A segment is a run of commits without a merge or a fork within; it is named by its oldest
    commit, and places count from there.  So a graph has as many segments as
    merges and forks, and to reach a node of a segment at a place is to reach all places below.
    Runs are followed by doubling: a run of n commits takes log n rounds of n rows.
    """
    known = checkpointed(edges.select("child", "parent").filter("child is not null and parent is not null and child <> parent").distinct())
    nodes = known.select(F.col("child").alias("node")).unionByName(known.select(F.col("parent").alias("node"))).distinct()
    alone = lambda c: known.groupBy(c).agg(F.count("*").alias("n")).filter("n = 1").select(c)
    inner = known.join(alone("child"), "child", "left_semi").join(alone("parent"), "parent", "left_semi")
    at = nodes.join(inner.select(F.col("child").alias("node"), F.col("parent").alias("low")), "node", "left")
    at = checkpointed(at.select("node", F.coalesce("low", "node").alias("low"), F.col("low").isNotNull().cast("long").alias("place")))
    total = at.count()
    for _ in range(max(1, total).bit_length() + 1):  # a cycle would go on for ever
        step = at.alias("x").join(at.select(F.col("node").alias("_n"), F.col("low").alias("_low"), F.col("place").alias("_place")), F.col("x.low") == F.col("_n"))
        before, at = at, checkpointed(step.select("node", F.col("_low").alias("low"), (F.col("place") + F.col("_place")).alias("place")))
        moved = at.join(before.withColumnRenamed("low", "_old"), "node").filter("low <> _old").isEmpty()
        release(edges.sparkSession, before)
        if moved:
            break
    oldest = nodes.join(inner.select(F.col("child").alias("node")), "node", "left_anti").select(F.col("node").alias("low"), F.lit(True).alias("_end"))
    ends = F.coalesce("_end", F.lit(False))  # the nodes of a cycle are segments of their own
    index = checkpointed(at.join(oldest, "low", "left").select("node", F.when(ends, F.col("low")).otherwise(F.col("node")).alias("segment"), F.when(ends, F.col("place")).otherwise(0).alias("place")))
    # only a segment's oldest commit has parents outside, and these are the newest of theirs
    between = known.join(index.filter("place = 0").select(F.col("node").alias("child")), "child", "left_semi")
    between = between.join(index.select(F.col("node").alias("parent"), F.col("segment").alias("_up")), "parent").select("child", F.col("_up").alias("parent"))
    return index, checkpointed(between.distinct())


def entered(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, entries): of each start the segments that it reaches and the highest place in each, null for all of it."""
    index, between = segments(edges)
    at = checkpointed(starts.select("start", "node").distinct().join(index, "node", "left").select("start", F.coalesce("segment", "node").alias("segment"), F.coalesce("place", F.lit(0)).alias("place")))
    first = between.join(at.select(F.col("segment").alias("child")).distinct(), "child", "left_semi")
    above = at.join(first.select(F.col("child").alias("segment"), F.col("parent").alias("node")), "segment").select("start", "node").distinct()
    whole = reachable(between, above).select("start", F.col("node").alias("segment"), F.lit(None).cast("long").alias("place"))
    both = at.unionByName(whole).groupBy("start", "segment").agg(F.when(F.count("*") == F.count("place"), F.max("place")).alias("place"))
    return index, both


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node reachable from each start, itself included."""
    index, entries = entered(edges, starts)
    below = entries.withColumnRenamed("place", "_top").join(index, "segment").filter("_top is null or place <= _top").select("start", "node")
    return below.unionByName(starts.select("start", "node")).distinct()


def edges_of(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("oid").alias("child"), F.explode("parents").alias("parent"))


def from_start(commits: DataFrame, start: DataFrame) -> DataFrame:
    """The commits reachable from the one row of ``start`` (oid), as a log from HEAD or another start lists them."""
    nodes = closure(edges_of(commits), start.select(F.lit("s").alias("start"), F.col("oid").alias("node")))
    return commits.join(nodes.select(F.col("node").alias("oid")), "oid", "left_semi")


def ahead_behind(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """name, ahead and behind of each row of ``tips`` (name, local, upstream).

    Commits are counted by segment, from the places at which either side enters it.
    """
    ends = tips.select("name", F.explode(F.array(F.struct(F.lit("local").alias("side"), F.col("local").alias("node")), F.struct(F.lit("upstream").alias("side"), F.col("upstream").alias("node")))).alias("e"))
    starts = ends.select(F.concat_ws("|", "name", "e.side").alias("start"), F.col("e.node").alias("node"))
    index, entries = entered(edges, starts)
    length = index.groupBy("segment").agg((F.max("place") + 1).alias("_n"))
    held = entries.join(length, "segment", "left").select(F.substring_index("start", "|", -1).alias("side"), F.expr("left(start, length(start) - length(substring_index(start, '|', -1)) - 1)").alias("name"), "segment", F.coalesce(F.col("place") + 1, F.col("_n"), F.lit(1)).alias("n"))
    per = held.groupBy("name", "segment").agg(F.coalesce(F.max(F.when(F.col("side") == "local", F.col("n"))), F.lit(0)).alias("l"), F.coalesce(F.max(F.when(F.col("side") == "upstream", F.col("n"))), F.lit(0)).alias("u"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))).cast("long")
    return per.groupBy("name").agg(more("l", "u").alias("ahead"), more("u", "l").alias("behind"))


def refs_by_oid(refs: DataFrame, key: str = "oid", ref: str = "ref") -> DataFrame:
    """References of each commit as one list: HEAD first, the others by name."""
    order = F.array_sort(F.collect_list(F.struct((F.col(ref) != "HEAD").alias("late"), F.col(ref).alias("ref"))))
    return refs.groupBy(key).agg(F.transform(order, lambda r: r["ref"]).alias("refs"))


def first_parent(commits: DataFrame) -> DataFrame:
    """Commits with is_merge, is_root and their first parent."""
    n = F.size(F.coalesce("parents", F.array().cast("array<string>")))
    return commits.withColumn("is_merge", n > 1).withColumn("is_root", n == 0).withColumn("first_parent", F.when(n > 0, F.element_at("parents", 1)))


def newest(commits: DataFrame, limit: int | None) -> DataFrame:
    ordered = commits.orderBy(F.desc("ts"), "oid")
    return ordered if limit is None else ordered.limit(limit)


STEP = re.compile(r"(~|\^)(\d*)")


def resolve(commits: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """The commit that a name stands for; at most one row.

    A name is a reference or a unique prefix of an id, with steps after it:
    ``~n`` goes n first parents back, ``^n`` to parent n, ``^`` and ``~`` alone one back,
    ``^0`` nowhere.  References are peeled to commits where they are read.
    """
    base = re.match(r"(.*?)((?:[~^]\d*)*)(?:\^\{(?:commit)?\})?$", name)
    by_ref = refs.filter(F.col("ref") == base[1]).select("oid").distinct()
    by_id = commits.filter(F.col("oid").startswith(base[1])).select("oid").distinct() if len(base[1]) >= 4 else commits.select("oid").limit(0)
    named = by_ref.withColumn("rank", F.lit(0)).unionByName(by_id.withColumn("rank", F.lit(1)))
    best = named.filter(F.col("rank") == named.agg(F.min("rank")).first()[0]) if not named.isEmpty() else named
    if best.limit(2).count() > 1:
        return best.select("oid").limit(0)
    at = best.select("oid")
    for kind, digits in STEP.findall(base[2]):
        n = int(digits) if digits else 1
        for _ in range(n if kind == "~" else min(n, 1)):
            parent = F.get("parents", F.lit(0 if kind == "~" else n - 1))
            at = commits.join(at, "oid", "left_semi").select(parent.alias("oid")).filter("oid is not null")
    return at


def narrow(commits: DataFrame, files: DataFrame, author: str | None = None, since: int | None = None, kinds: tuple[str, ...] = (), entries: DataFrame | None = None, element: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, files) by author (part of the name), time, driver names of the files, or an element among the diff entries (oid, path, element)."""
    if author is not None:
        commits = commits.filter(F.lower("author").contains(author.lower()))
    if since is not None:
        commits = commits.filter(F.col("ts") >= since)
    if kinds:
        files = files.filter(driver_of(F.col("path")).isin(*kinds))
    if element is not None:
        name = F.regexp_replace("element", "^(cell|net):", "")
        files = files.join(entries.filter((name == element) | name.startswith(element + ":")).select("oid", "path").distinct(), ["oid", "path"], "left_semi")
    if kinds or element is not None:
        commits = commits.join(files.select("oid").distinct(), "oid", "left_semi")
    return commits, files.join(commits.select("oid"), "oid", "left_semi")


def stat(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries added, removed and modified of each group and driver."""
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k)
    return entries.filter(~F.col("cosmetic")).groupBy(*keys, driver_of(F.col("path")).alias("format")).agg(n("added"), n("removed"), n("modified"))


def log(commits: DataFrame, changed: DataFrame, refs: DataFrame, patterns: list[str] = (), limit: int | None = 20, limit_after_filter: bool = False) -> tuple[DataFrame, DataFrame]:
    """(commits, files) of a history.

    The newest ``limit`` commits are taken before the path filter, unless
    ``limit_after_filter``.  Merges and roots have no files; files without a driver are left out.  With a
    path filter, commits without files go, merges stay.
    """
    taken = first_parent(commits if limit_after_filter else newest(commits, limit))
    # a limited list is bounded by the limit; Spark decides on its size whether to broadcast it
    plain = taken.filter(~F.col("is_merge") & ~F.col("is_root")).select("oid")
    own = changed.filter(path_filter(F.col("path"), list(patterns)) & driver_of(F.col("path")).isNotNull())
    files = own.join(plain, "oid", "left_semi").withColumn("format", driver_of(F.col("path")))
    if patterns:
        some = files.select("oid").distinct().withColumn("_has", F.lit(True))
        taken = taken.join(some, "oid", "left").filter(F.col("is_merge") | F.col("_has")).drop("_has")
    if limit_after_filter:
        taken = newest(taken, limit)
        files = files.join(taken.select("oid"), "oid", "left_semi")
    annotated = taken.join(refs_by_oid(refs), "oid", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    return annotated, files


def touches(changed: DataFrame, tree: DataFrame, commits: DataFrame, path: str) -> DataFrame:
    """Commits that touch a path: a root holds it, another changes it (as new or old path)."""
    own = first_parent(commits)
    by_change = changed.filter((F.col("path") == path) | (F.col("old_path") == path)).select("oid").distinct()
    by_tree = tree.filter(F.col("path") == path).select("oid").distinct()
    return own.filter("is_root").join(by_tree, "oid", "left_semi").unionByName(own.filter("not is_root").join(by_change, "oid", "left_semi"))


def status_of(index_new: Column, worktree_new: Column, deleted: Column, renamed: Column) -> Column:
    """Precedence renamed, removed, added, modified."""
    return F.when(renamed, "renamed").when(deleted, "removed").when(index_new | worktree_new, "added").otherwise("modified")


def last_touch(touched: DataFrame, element: list[str], order: str = "ts", commit: str = "oid") -> DataFrame:
    """For each element the last commit that touches it; ties go to the larger id."""
    return touched.groupBy(*element).agg(F.max_by(commit, F.struct(order, commit)).alias("last_commit"), F.max(order).alias("last_ts"))


def stale(touched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (source, derived) whose source was touched later than the derived file."""
    last = last_touch(touched, ["path"]).select("path", "last_ts")
    src = last.toDF("source", "source_ts")
    der = last.toDF("derived", "derived_ts")
    return pairs.join(src, "source").join(der, "derived", "left").withColumn("is_stale", F.coalesce(F.col("source_ts") > F.col("derived_ts"), F.lit(True)))


def previous(rows: DataFrame, path: str, order: str, column: str) -> Column:
    return F.lag(column).over(Window.partitionBy(path).orderBy(order))
