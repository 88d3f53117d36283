"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Two different lines are near copies if they are within ``tau`` edits and no more than one
edit for each ``share`` characters of the shorter one.

Segments.  A line is cut into tau + 1 segments; of two lines within tau edits
at least one segment of the shorter stands unchanged in the longer, at a place
that the lengths and the segment's number bound.  Each line is indexed by
(length, segment number, segment text) and probes the lengths len - tau to len
at those places alone.  Keys are 64-bit hashes.

Candidates.  Of the lines under one key the one of the smallest hash is the
centre, and only (centre, member) pairs are candidates, so a large group of
near copies gives as many pairs as it has lines.

Check.  A line has 128 parity bits, one for each hash of two neighbouring characters; an
edit turns four at most, so pairs that differ in more go before their texts are looked up.
What remains is verified by banded bit-parallel edit distance: the band of 2 tau + 1
diagonals is one machine word, and a step for each character of the longer line moves
it down by one row.

Rest.  Where one of several members fails the check, lines that are near copies of one another
can still lie under its key in different classes.  The lines of these keys are
joined once more by pairs of segments, of which tau + 2 leave two unchanged, and
pairs in different classes that the parity bits let through are checked alike.

Result.  Near copies are joined into classes; of each class the first line in
(doc_id, text hash, line number) order is kept, and so is every line without a copy.

Defined cases: null text has no lines; blank lines are kept and belong to no
class; lines of fewer than ``share`` characters have exact copies only;
equal lines of one document are copies too; rows with the same doc_id are told
apart by their texts, so rows equal in both count as one; very long lines are
lines like any other; an empty table gives no rows; other columns of the
documents may have any names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits allowed are at most one for so many characters of the shorter line.
SHARE = 8


def lines_of(docs: DataFrame) -> DataFrame:
    """line, wide (four bytes a character), n (characters) and h (64-bit hash) of every line that is not blank.

    They come out of one generator, so that no later expression works them out
    again; a segment of ``wide`` is found without counting characters.
    """
    cut = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.encode(x, "UTF-32").alias("wide"), F.xxhash64(x).alias("h")))
    own = docs.select(F.explode(cut).alias("l")).select("l.line", "l.wide", F.shiftright(F.octet_length("l.wide"), 2).alias("n"), "l.h")
    return own.filter(F.trim("line") != "")


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines, line_no and h of every line that is not blank, and a row of line number -1 for each document."""
    blank = F.struct(F.lit(-1).alias("line_no"), F.lit(None).cast("long").alias("h"))
    each = F.transform(F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")), lambda x, i: F.struct(i.alias("line_no"), F.when(F.trim(x) != "", F.xxhash64(x)).alias("h")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.explode(F.array(F.filter(each, lambda e: e["h"].isNotNull()))).alias("full"))
    out = own.select("doc_id", "text_hash", F.size("full").alias("n_lines"), F.explode(F.concat(F.array(blank), "full")).alias("l"))
    return out.select("doc_id", "text_hash", "n_lines", "l.line_no", "l.h")


# --- keys ----------------------------------------------------------------------
def segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, size) of segment i, from 1, of a line of this length; the last segments are the longer ones."""
    base = F.floor(length / parts).cast("int")
    over = length - base * parts
    return base * (i - 1) + F.greatest(F.lit(0), over + (i - 1 - parts)) + 1, base + (over >= parts + 1 - i).cast("int")


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(characters fewer, segment, shift) under which a line meets one no longer than itself; (0, i, 0) is its own index."""
    parts, out = tau + 1, []
    for less in range(tau + 1):
        for i in range(1, parts + 1):
            low, high = max(-(i - 1), less - (parts - i)), min(i - 1, less + (parts - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def probes_of_two(tau: int) -> list[tuple[int, int, int, int, int]]:
    """(characters fewer, segments i < j, their shifts): two of tau + 2 segments that an alignment leaves unchanged."""
    out = []
    for less in range(tau + 1):
        for i, j in itertools.combinations(range(1, tau + 3), 2):
            for a, b in itertools.product(range(-tau, tau + 1), repeat=2):
                if abs(a) + abs(b - a) + abs(less - b) <= tau:
                    out.append((less, i, j, a, b))
    return out


def keyed(lines: DataFrame, tau: int, two: bool, share: int, *carried: str) -> DataFrame:
    """``carried`` and k of each line and probe; the last bit of k marks index keys.

    Probes are rows of a literal, so one short expression serves all of them.
    """
    names = ("less", "i", "j", "a", "b") if two else ("less", "i", "a")
    table = F.array(*[F.struct(*[F.lit(v).alias(x) for x, v in zip(names, p, strict=True)]) for p in (probes_of_two(tau) if two else probes(tau))])
    own = lines.select(*carried, "wide", "n", F.explode(table).alias("p"))
    length, parts = F.col("n") - F.col("p.less"), tau + 2 if two else tau + 1
    held, text, plain = length >= share, [], F.col("p.less") == 0
    for i, shift in (("i", "a"), ("j", "b"))[: 1 + two]:
        start, size = segment(length, F.col(f"p.{i}"), parts)
        at = start + F.col(f"p.{shift}")
        held = held & (at >= 1) & (at + size - 1 <= F.col("n"))
        text += [F.col(f"p.{i}"), F.substring("wide", at * 4 - 3, size * 4)]
        plain = plain & (F.col(f"p.{shift}") == 0)
    key = F.xxhash64(length, *text)
    return own.filter(held).select(*carried, key.bitwiseAND(F.lit(-2)).bitwiseOR(plain.cast("long")).alias("k"))


def members(lines: DataFrame, tau: int, share: int) -> DataFrame:
    """k, c and h: the lines under each key that an indexed line has, and the key's centre."""
    own = keyed(lines.filter(F.col("n") >= share), tau, False, share, "h").select("h", F.col("k").bitwiseAND(F.lit(-2)).alias("k"), F.col("k").bitwiseAND(F.lit(1)).alias("own"))
    met = own.groupBy("k").agg(F.min("h").alias("c"), F.max("h").alias("top"), F.max("own").alias("own"))
    centers = common.stage(met.filter("c <> top and own = 1").select("k", "c"))
    common.release(lines.sparkSession)
    return common.stage(own.select("k", "h").join(common.sized(centers), "k").filter("h <> c").select("k", "c", "h").distinct())


def rest_pairs(lines: DataFrame, tau: int, share: int) -> DataFrame:
    """a and b of ``lines`` (with their classes as root) that lie in different classes, share a pair of segments and may be near copies."""
    carried = ("h", "n", "p0", "p1", "root")
    own = keyed(lines, tau, True, share, *carried)
    own = own.select(*carried, F.col("k").bitwiseAND(F.lit(-2)).alias("k"), F.col("k").bitwiseAND(F.lit(1)).alias("own"))
    met = own.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("indexed"))
    met = common.stage(met.filter("low <> high and indexed = 1").select("k"))
    early = common.stage(own.join(common.sized(met), "k", "left_semi").distinct())
    index = early.filter("own = 1").select("k", *[F.col(c).alias(f"{c}_a") for c in carried])
    other = early.select("k", "own", *[F.col(c).alias(f"{c}_b") for c in carried])
    both = index.join(other, "k").filter((F.col("root_a") != F.col("root_b")) & ((F.col("own") == 0) | (F.col("h_a") < F.col("h_b"))) & may_be_near(tau, share))
    return both.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()


# --- check ---------------------------------------------------------------------
def characters(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def with_parity(lines: DataFrame) -> DataFrame:
    """``lines`` with 128 bits, each the parity of the neighbouring characters that hash to it."""
    laid = common.stage(lines.withColumn("chars", characters("line")))
    of_two = F.transform("chars", lambda c, i: F.xxhash64(c, F.get("chars", i + 1)))

    def bit(h: Column, low: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, low).bitwiseAND(F.lit(63)).cast("int"))

    none = F.lit(0).cast("long")
    both = F.aggregate(of_two, F.struct(none.alias("p0"), none.alias("p1")), lambda s, h: F.struct(s["p0"].bitwiseXOR(bit(h, 0)).alias("p0"), s["p1"].bitwiseXOR(bit(h, 6)).alias("p1")))
    out = common.stage(laid.select(*lines.columns, both.alias("p")).select(*lines.columns, "p.p0", "p.p1"))
    common.release(lines.sparkSession, laid)
    return out


def may_be_near(tau: int, share: int) -> Column:
    """Whether lengths and parities of lines _a and _b let them be near copies."""
    allowed = F.least(F.lit(tau), F.floor(F.least("n_a", "n_b") / share))
    apart = F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))) + F.bit_count(F.col("p1_a").bitwiseXOR(F.col("p1_b")))
    return (F.abs(F.col("n_a") - F.col("n_b")) <= allowed) & (apart <= allowed * 8)


def near_pairs(pairs: DataFrame, texts: DataFrame, tau: int, share: int) -> DataFrame:
    """``pairs`` that lengths and parities let through."""
    side = lambda x: texts.select(F.col("h").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "p0", "p1")])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(may_be_near(tau, share)).select("a", "b")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with the shorter and the longer line and their sizes."""
    left = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"), F.col("n").alias("n_a"))
    right = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"), F.col("n").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b")
    first = F.col("n_a") <= F.col("n_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select("a", "b", pick("line_a", "line_b").alias("short"), pick("line_b", "line_a").alias("long"), F.least("n_a", "n_b").alias("m"), F.greatest("n_a", "n_b").alias("n"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def band_distance(pairs: DataFrame, tau: int) -> DataFrame:
    """``pairs`` (short, long, m, n, others) with their edit distance as ``edits``: exact where it is at most tau.

    Lines have at least tau characters.  Bit d of the band at character j of the longer line
    stands for place j - tau + d of the shorter.  ``up`` and ``down`` mark vertical differences
    +1 and -1.  The score runs down the last diagonal of the band to the end of the shorter line and along it from there.
    Characters are laid out and staged before, so that a step only looks them up.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    spark = pairs.sparkSession
    blank = lambda n: F.array_repeat(F.lit(None).cast("string"), n)
    others = [c for c in pairs.columns if c not in ("short", "long")]
    spread = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    laid = common.stage(spread.select(*others, F.concat(blank(F.lit(tau)), characters("short"), blank((F.col("n") - F.col("m") + tau + 1).cast("int"))).alias("places"), characters("long").alias("right")))

    def mask(char: Column, j: Column) -> Column:
        """The places of the shorter line in the band that hold this character, as bits."""
        bits = [F.when(F.get("places", j + d) == char, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
        return sum(bits[1:], bits[0]).cast("long")

    def step(state: Column, match: Column) -> Column:
        up, down, m = state["up"], state["down"], F.col("m")
        cross = ((match.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(match).bitwiseOR(down)).bitwiseAND(F.lit(full))

        def after(x: Column) -> Column:
            plus = down.bitwiseOR(F.lit(full).bitwiseXOR(x.bitwiseOR(up)))
            minus = x.bitwiseAND(up)
            lower = F.shiftright(x, 1)
            j = state["j"] + 1
            at = F.greatest((m - j + tau).cast("int"), F.lit(0))
            grow = F.when(j + tau <= m, 1 - F.getbit(x, F.lit(width - 1))).otherwise(F.getbit(plus, at) - F.getbit(minus, at))
            return F.struct(minus.bitwiseOR(F.lit(full).bitwiseXOR(lower.bitwiseOR(plus))).alias("up"), lower.bitwiseAND(plus).alias("down"), (state["score"] + grow).cast("long").alias("score"), j.cast("long").alias("j"))

        return let(cross, after)

    first = F.struct(F.lit(full ^ ((1 << tau) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(tau).cast("long").alias("score"), F.lit(0).cast("long").alias("j"))
    return laid.select(*others, F.aggregate(F.transform("right", mask), first, step, lambda s: s["score"]).alias("edits"))


def checked(pairs: DataFrame, texts: DataFrame, tau: int, share: int) -> DataFrame:
    """a and b of the pairs that are near copies."""
    found = band_distance(with_texts(pairs, texts), tau)
    return common.stage(found.filter(F.col("edits") <= F.least(F.lit(tau), F.floor(F.col("m") / share))).select("a", "b"))


# --- the operator ----------------------------------------------------------------
def similar_lines(docs: DataFrame, tau: int = 2, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(links, roots): pairs a < b of hashes of near copies that connect every class, and the classes."""
    if share <= tau:
        raise ValueError("share must be above tau")
    lines = lines_of(docs)
    met = members(lines, tau, share)
    wanted = common.stage(met.select(F.explode(F.array("c", "h")).alias("h")).distinct())
    texts = with_parity(lines.select("h", "line", "n").join(common.sized(wanted), "h", "left_semi").dropDuplicates(["h"]))
    pairs = met.select(F.col("c").alias("a"), F.col("h").alias("b")).distinct()
    links = checked(near_pairs(pairs, texts, tau, share), texts, tau, share)
    roots = common.components(links)
    tried = met.join(links.select(F.col("a").alias("c"), F.col("b").alias("h"), F.lit(True).alias("near")), ["c", "h"], "left")
    bad = tried.groupBy("k").agg(F.count("*").alias("others"), F.count("near").alias("found")).filter("others > 1 and found < others")
    again = common.stage(met.join(bad.select("k"), "k", "left_semi").select(F.explode(F.array("c", "h")).alias("h")).distinct())
    left = texts.withColumn("wide", F.encode("line", "UTF-32")).join(again, "h", "left_semi").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    second = rest_pairs(left, tau, share)
    more = checked(second.join(pairs, ["a", "b"], "left_anti"), texts, tau, share)
    if not more.isEmpty():
        links = common.stage(links.unionByName(more))
        roots = common.components(links)
    common.release(docs.sparkSession, met, wanted, texts, again)
    return links, roots


def placed_lines(docs: DataFrame, tau: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``rows_of``; doc_id, text_hash and cut of each document that loses lines: its (line_no, doc_id copied from))."""
    rows = common.stage(rows_of(docs))
    lines = rows.filter("line_no >= 0")
    _, roots = similar_lines(docs, tau, share)
    of_line = common.stage(lines.groupBy("h").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first"), F.count("*").alias("size")))
    linked = common.stage(of_line.join(roots.withColumnRenamed("node", "h"), "h").select("h", "root", "first"))
    of_class = common.attach(linked.select("h", "root"), linked.groupBy("root").agg(F.min("first").alias("first")), "root").select("h", "first")
    alone = of_line.filter("size > 1").join(linked, "h", "left_anti").select("h", "first")
    placed = common.attach(lines, common.stage(of_class.unionByName(alone)), "h")
    gone = placed.filter(F.col("first").isNotNull() & ~F.struct("doc_id", "text_hash", "line_no").eqNullSafe(F.col("first")))
    each = F.struct("line_no", F.col("first.doc_id").alias("doc_id"))
    return rows, gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(each)).alias("cut"))


def copies(docs: DataFrame, tau: int = 2, share: int = SHARE) -> DataFrame:
    """doc_id, n_lines, dropped and copied_from of every document.

    ``dropped`` are the numbers, from 0 and ascending, of the lines that go;
    ``copied_from`` has the doc_id of the first line of the class of each.
    """
    rows, gone = placed_lines(docs, tau, share)
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "cut")
    own = rows.filter("line_no < 0").select("doc_id", "text_hash", "n_lines")
    out = own.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    cut = F.coalesce("cut", F.array().cast("array<struct<line_no:int,doc_id:bigint>>"))
    return out.select("doc_id", "n_lines", F.transform(cut, lambda x: x["line_no"]).alias("dropped"), F.transform(cut, lambda x: x["doc_id"]).alias("copied_from"))


def clean(docs: DataFrame, tau: int = 2, share: int = SHARE) -> DataFrame:
    """``docs`` with the dropped lines cut from their texts; null text stays null."""
    _, gone = placed_lines(docs, tau, share)
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), F.transform("cut", lambda x: x["line_no"]).alias("cut"))
    whole = docs.select(F.struct("*").alias("row"))
    joined = whole.join(gone, F.col("row.doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("row.text") == F.col("of_text")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("cut", i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(kept)
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
