"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of the total size by weight, at most ``MOST`` times its
own size; what is over is dealt again by weight.  A source is taken in whole
copies first.  The rest of its budget is filled from counts of documents by
exact length: an even part of each length, then larger lengths while much is
missing, then a bounded-knapsack dynamic programme over the last words.  The
documents of each length are then chosen by a seeded hash.

Only lengths and counts meet in one task, never documents: a group of one
source and length that is taken in part is cut into hash ranges of about
RANGE_ROWS rows, and rows are ranked within them; all other rows stay where they are
or, in large groups, get their group's plan without being moved.

Defined cases: null or blank text has size 0 and is taken 0 times; the null
source is a source of its own, the last; ties of the hash go by doc_id, and rows
that agree in doc_id, source and size may stand for each other; if all sizes
are 0 all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST = 3
RANGE_ROWS = 1024
KNAPSACK_WORDS = 1 << 17


def fill(budget: int, sizes: list[int], spare: list[int]) -> list[int]:
    """How many of each size to take so that their sum is as near below ``budget`` as can be.

    Bounded knapsack over sets of reachable sums, one bit a sum; counts are
    split in powers of two.
    """
    mask = (1 << (budget + 1)) - 1
    reach, before = 1, []
    for size, most in zip(sizes, spare, strict=True):
        before.append(reach)
        left, step = min(most, budget // size), 1
        while left > 0:
            part = min(step, left)
            reach |= (reach << (part * size)) & mask
            left, step = left - part, step * 2
        if reach >> budget & 1:
            break
    rest = reach.bit_length() - 1
    taken = [0] * len(sizes)
    for i in range(len(before) - 1, -1, -1):
        while not before[i] >> rest & 1:
            taken[i] += 1
            rest -= sizes[i]
    return taken


def plan_source(sizes: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """(whole copies of the source, further documents of each size)."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if total <= 0:
        return 0, [0] * len(sizes)
    copies = min(MOST, int(target // total))
    budget = 0 if copies >= MOST else max(0, round(target - copies * total))
    extra = [c * budget // total if s else 0 for s, c in zip(sizes, counts, strict=True)]
    left = budget - sum(s * e for s, e in zip(sizes, extra, strict=True))
    order = sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i])
    for i in order:  # until what is left is small enough for the programme
        if left <= KNAPSACK_WORDS:
            break
        more = min(counts[i] - extra[i], (left - KNAPSACK_WORDS // 2) // sizes[i])
        if more > 0:
            extra[i] += more
            left -= more * sizes[i]
    for i in order:  # more is left only if no spare document leaves half the programme's span: one of them fits at most
        if left > KNAPSACK_WORDS and extra[i] < counts[i] and sizes[i] <= left:
            extra[i] += 1
            left -= sizes[i]
    usable = [i for i in order if extra[i] < counts[i] and sizes[i] <= left]
    if 0 < left <= KNAPSACK_WORDS and usable:
        for i, n in zip(usable, fill(left, [sizes[i] for i in usable], [counts[i] - extra[i] for i in usable]), strict=True):
            extra[i] += n
    return copies, extra


def targets(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sid, source, source_size and target of each source (one row a source).

    The level L solves sum(least(MOST * size, L * weight)) = total: sources
    are sorted by where they reach their cap, and the first that stays below it
    at the level of the rest fixes L.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = by_source.withColumn("sid", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1))
    listed = listed.withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    all_of = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(all_of) - capped) / open_weight
    found = listed.withColumn("level", F.when(F.col("cap") / F.col("weight") >= level, level))
    found = found.withColumn("level", F.max("level").over(all_of))  # the first such source has the highest
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return found.select("sid", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; sources weigh by code-point order, repeating."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    name = F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source))
    rows = common.stage(docs.select("doc_id", source.alias("source"), name.alias("name"), size.alias("size")))
    goal = common.stage(targets(rows, weights).withColumn("name", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))).drop("source"))
    group = F.col("sid").cast("long") * F.lit(1 << 40) + F.col("size")
    coded = common.attach(rows.select("doc_id", "name", "size"), goal, "name").select("doc_id", "size", "source_size", "target", "sid", group.alias("group"))
    coded = common.stage(coded)
    lengths = coded.groupBy("group", "sid", "size").agg(F.count("*").alias("n"), F.any_value("target").alias("target"))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("size")
        copies, extra = plan_source(table["size"].to_pylist(), table["n"].to_pylist(), table["target"][0].as_py())
        whole = pa.array([copies] * table.num_rows, pa.int64())
        return pa.table({"group": table["group"], "n": table["n"], "copies": whole, "extra": pa.array(extra, pa.int64())})

    plan = common.stage(lengths.groupBy("sid").applyInArrow(work, "group long, n long, copies long, extra long"))
    placed = common.attach(coded, plan, "group")
    out = lambda df, more: df.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more.cast("long"))).alias("taken"))
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    # a split group is cut into ranges of the hash, of which one at most is split again
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    cut = placed.filter(split).withColumn("draw", draw).withColumn("part", F.floor(F.col("draw") / float(1 << 40) * ranges))
    counted = cut.groupBy("group", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counted.select("group", "part", before.alias("before")), ["group", "part"])
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy("draw", "doc_id"))
    return out(placed.filter(~split), F.col("extra") >= F.col("n")).unionByName(out(ranked.withColumn("place", place), F.col("before") + F.col("place") <= F.col("extra")))


def apply(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 11) -> DataFrame:
    """``docs`` as mixed: each row as many times as it is taken, 0 to ``MOST``.

    Blank texts have no words to take and stay once.  Rows that share a doc_id
    have their copies added up and shared out evenly, the first rows by text one
    more.  Other columns of ``docs`` may have any names.
    """
    found = mix(docs, weights, seed)
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1).cast("int")
    per = common.stage(found.select("doc_id", times.alias("times")).groupBy("doc_id").agg(F.sum("times").alias("times"), F.count("*").alias("rows")))
    whole = docs.select(F.struct("*").alias("row"))
    joined = whole.join(per, F.col("row.doc_id").eqNullSafe(F.col("doc_id"))).select("row", "times", "rows")
    if not per.filter("rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
        joined = joined.withColumn("place", place).withColumn("times", F.expr("times div rows + if(place <= times % rows, 1, 0)"))
    repeated = joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
