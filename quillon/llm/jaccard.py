"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes.  It is cut into
fragments, and so is each document's n-gram set.

Candidates.  Two sets of sizes a and b with similarity t or more differ in at
most k = (a + b) (1 - t) / (1 + t) n-grams.  Of more than k fragments at least
one is then equal in both sets.  Sizes fall into classes; a class fixes the
number of fragments, k + 1 and a reserve for empty ones, for pairs within it or
with the class below.  A set with more empty fragments than the reserve is cut
again by another order, and after eight cuts shows its empty fragments too, so no
pair is lost.  A few fragments more than needed make similar sets share several of
them, so that a set that meets strangers in one or two buckets need not be tried again.
Within a bucket of sets that share a fragment the smallest is the
centre, and only (centre, member) pairs are candidates.

Pruning.  Sizes and parity bits, at least one for each n-gram, bound the overlap from above; only
pairs that they let through get their n-gram lists.

Counts.  The lists are cut into eight fragments of the order, one row a (fragment, set).
For each candidate pair the overlaps are counted fragment by fragment and the partial
counts summed; the test is exact in integers.

Rest.  Where a set fails the test in as many buckets of several members as it shares
with a similar one at least, linked pairs can still lie in different components.  The
sets of these components are joined once more, by prefixes in the order of frequency
among them: first a few sets of each gram with the others, then all pairs that still
lie in different components.

Exact copies are one set from the start, each partition passes on one
row for each fragment, and documents get the component of a set with many copies
without being moved, so a group of copies is never gathered in one task.
Nodes are 64-bit hashes of the sets.

Defined cases: null, empty and blank texts have the empty set and no links; a
text of fewer than n words has its whole sequence as its one n-gram; rows with
the same doc_id are links of each other only by their texts; very long texts
are one row like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
FRAGMENTS = 8
CLASS_RATIO = 1.5
BUCKET_ROWS = 200_000
FILTER_BITS = 1 << 25
CUTS = 8
#: Sets of each early gram that are tried with all others before the pairs that are left.
STARS = 8
#: One fragment more than needed for so many.
SPARE = 8


# --- sets --------------------------------------------------------------------
def gram_hashes(offsets: np.ndarray, codes: np.ndarray, words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram; of the whole sequence where a text has fewer than n words."""
    word = common.hash_words(common.strings(words))[codes] if len(words) else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    total = np.zeros(max(len(word) - n + 1, 0), U64)
    for k in range(n):
        total = total * U64(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k]
    inside = owner[: len(total)] == owner[n - 1 :] if len(total) else np.zeros(0, bool)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < n))
    whole = np.zeros(len(short), U64)
    length = np.diff(offsets)[short]
    for k in range(int(length.max(initial=0))):  # fewer than n steps
        on = length > k
        whole[on] = whole[on] * U64(0x9E3779B97F4A7C15) + word[offsets[short[on]] + k]
    whole += length.astype(U64)
    return np.concatenate([owner[: len(total)][inside], short]), common.mix(np.concatenate([total[inside], whole]))


class Sets:
    """The n-gram sets of a slice: sorted hashes, set after set."""

    def __init__(self, text: pa.Array, n: int):
        owner, gram = gram_hashes(*common.split_words(text, lower=True), n)
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        first = np.ones(len(gram), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        self.owner, self.gram = owner[first], gram[first]
        self.size = np.bincount(self.owner, minlength=len(text))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        # the node of a set: a hash of its members in order and of its size
        rank = (np.arange(len(self.gram)) - self.at[self.owner]).astype(U64)
        mixed = common.mix(self.gram + rank * U64(0xD1342543DE82EF95))
        self.node = common.mix(common.segment_sum(mixed, self.at) + self.size.astype(U64)).astype(np.int64)


def classes(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(CLASS_RATIO) + 1e-9).astype(np.int64)


def class_shape(cls: int, num: int, den: int) -> tuple[int, int, int]:
    """(fragments, reserve, fragments that two similar sets share) for pairs whose larger set is of class ``cls``."""
    top = int(np.ceil(CLASS_RATIO ** (cls + 1) + 1e-6))
    least = max(CLASS_RATIO**cls * num / den, 1.0)
    k = 2 * top * (den - num) // (den + num)
    reserve, shared = 0, 1 + (k + 1) // SPARE
    for _ in range(3 if k else 0):
        expect = (k + shared + reserve) * np.exp(-least / (k + shared + reserve))
        reserve = int(expect + np.sqrt(expect))
    return k + shared + reserve, reserve, shared


def needs(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many crowded buckets a set must fail before a similar one can have escaped it.

    Two similar sets that no bucket tries have ``shared`` buckets in common, in
    each of which one of them at least fails against the centre: one of them in half of these.
    """
    cls, back = np.unique(classes(size), return_inverse=True)
    return np.array([-(-class_shape(int(c), num, den)[2] // 2) for c in cls], np.int64)[back]


def signatures(sets: Sets, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the fragments by which ``rows`` can meet a partner."""
    out_sig, out_row = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    own = classes(sets.size[rows])
    up = classes(sets.size[rows] * den // num)  # the largest partner's class
    for cls in np.unique(np.concatenate([own, up])):
        f, reserve, _ = class_shape(int(cls), num, den)
        members = rows[(own == cls) | (up == cls)]
        for cut in range(CUTS):
            size = sets.size[members]
            which = np.repeat(np.arange(len(members)), size)
            place = np.repeat(sets.at[members] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            gram = sets.gram[place] if not cut else common.mix(sets.gram[place] + U64(cut))
            part = ((gram >> U64(32)) * U64(f)) >> U64(32)  # the fragment of the order that a gram lies in
            slot = which * f + part.astype(np.int64)
            if cut:
                order = np.argsort(slot, kind="stable")
                slot, gram = slot[order], gram[order]
            start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            filled = slot[start]
            tag = common.mix(np.array([int(cls) * CUTS + cut + 1], U64) << U64(32))
            out_sig.append(common.mix(np.add.reduceat(common.mix(gram), start) + common.mix((filled % f).astype(U64) + tag)))
            out_row.append(members[filled // f])
            hollow = np.bincount(filled // f, minlength=len(members)) < f - reserve
            if cut == CUTS - 1:
                for i in np.flatnonzero(hollow):
                    empty = np.setdiff1d(np.arange(f), filled[filled // f == i] % f)
                    out_sig.append(common.mix(empty.astype(U64) + tag + U64(1 << 60)))
                    out_row.append(np.full(len(empty), members[i]))
            members = members[hollow]
            if not len(members):
                break
    return np.concatenate(out_sig), np.concatenate(out_row)


# --- a bounded filter on ids -----------------------------------------------
def bit_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each id of the one column, FILTER_BITS in all whatever their number; false positives only."""
    spot = F.pmod(F.col(ids.columns[0]), F.lit(FILTER_BITS)).cast("long")
    bits = ids.select(F.bitmap_bucket_number(spot + 1).alias("b"), F.bitmap_bit_position(spot + 1).alias("p"))
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():
        at = (r["b"] - 1) * 4096
        found[at : at + 4096] = np.frombuffer(r["m"], np.uint8)[: len(found) - at]
    return found


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    spot = np.mod(ids, FILTER_BITS)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


# --- passes over the texts ---------------------------------------------------
def set_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_grams, node, need and parity of every document; the node of an empty set is null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(common.text_of(batch), n)
        node = pa.array(sets.node, mask=sets.size == 0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets.size), node, pa.array(needs(sets.size, num, den)), parity(sets)], names=["doc_id", "n_grams", "node", "need", "parity"])

    return common.map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_grams long, node long, need long, parity array<long>")


def parity(sets: Sets) -> pa.Array:
    """A bit for each hash of a gram, the parity of the grams that hash to it; at least as many bits as grams.

    Sets differ in at least as many grams as bits.  The number of bits is a power of two
    from 256; one half of them xor the other half is the parity of half as many bits.
    """
    bits = np.left_shift(1, np.maximum(8, np.ceil(np.log2(np.maximum(sets.size, 1))).astype(np.int64)))
    start = np.concatenate([[0], np.cumsum(bits)])
    slot = start[sets.owner] + (common.mix(sets.gram) & (bits - 1).astype(U64)[sets.owner]).astype(np.int64)
    odd = (np.bincount(slot, minlength=start[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(start // 64, pa.int32()), pa.array(np.packbits(odd, bitorder="little").view("<i8")))


def distinct_rows(sets: Sets, seen: set[int]) -> np.ndarray:
    """Rows of non-empty sets that this task has not met."""
    rows = np.flatnonzero(sets.size > 0)
    _, first = np.unique(sets.node[rows], return_index=True)
    fresh = [r for r in rows[np.sort(first)] if int(sets.node[r]) not in seen]
    if len(seen) < 2_000_000:  # beyond it repeats are passed on, and fall together later
        seen.update(int(sets.node[r]) for r in fresh)
    return np.array(fresh, np.int64)


def center_pairs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures, their smallest nodes and numbers of nodes; the place of its signature and the node of every other."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(first)
    place = np.cumsum(first) - 1
    return sig[at], node[at], np.diff(np.append(at, len(sig))), place[~first], node[~first]


def pair_rows(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs with the sum of ``times``."""
    order = np.lexsort((b, a))
    a, b, times = a[order], b[order], times[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    total = np.add.reduceat(times, np.flatnonzero(new)) if len(a) else times
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(total.astype(np.int64))], names=["a", "b", "times"])


def star_candidates(docs: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """Distinct (a, b) pairs of nodes: for each signature the smallest node with every other.

    ``times`` counts the signatures under which a pair met that a third set has too,
    so that a similar pair may be hidden behind this one.

    Rows in flight are packed: a row has the signatures of one bucket of one
    slice and the node of each.  Within a bucket 31 bits of a signature tell it
    from the others; the last bit marks those that several sets of a slice
    share.  Two signatures that fall together only give more pairs to test.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in common.slices(batch):
                sets = Sets(common.text_of(part), n)
                sig, row = signatures(sets, distinct_rows(sets, seen), num, den)
                sig, center, many, place, other = center_pairs(sig, sets.node[row])
                bucket = (sig % U64(buckets)).astype(np.int64)
                tag = ((sig >> U64(33)).astype(np.uint32) << np.uint32(1)) | (many > 1).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                keys, left, right = [], [], []
                for k in np.flatnonzero(np.diff(cut)):
                    own = order[cut[k] : cut[k + 1]]
                    keys.append(int(k))
                    left.append(tag[own].tobytes())
                    right.append(center[own].tobytes())
                spread = np.mod(other, buckets)
                for k in np.unique(spread):  # pairs found here; dealt over keys of their own
                    keys.append(-1 - int(k))
                    left.append(center[place[spread == k]].tobytes())
                    right.append(other[spread == k].tobytes())
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["bucket", "left", "right"])

    def join(key, table):
        left, right = b"".join(table["left"].to_pylist()), np.frombuffer(b"".join(table["right"].to_pylist()), np.int64)
        if key[0].as_py() < 0:
            return pa.Table.from_batches([pair_rows(np.frombuffer(left, np.int64), right, np.ones(len(right), np.int64))])
        tag = np.frombuffer(left, np.uint32)
        crowded = np.unique(tag[tag & 1 == 1] >> 1)
        found, center, many, place, other = center_pairs(tag >> 1, right)
        sole = (many == 2) & ~np.isin(found, crowded)
        return pa.Table.from_batches([pair_rows(center[place], other, ~sole[place])])

    packed = docs.select("text").mapInArrow(common.tidy(emit), "bucket long, left binary, right binary")
    pairs = packed.groupBy("bucket").applyInArrow(join, "a long, b long, times long")
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("times"))


def gram_table(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """node and grams (one sorted list for each fragment of the order) of the nodes ``wanted`` (node, doc).

    Only rows whose doc_id the filter lets through are cut into n-grams.
    """
    bits = bit_filter(wanted.filter("doc is not null").select("doc"))
    steps = np.arange(1, FRAGMENTS).astype(U64) << U64(61)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            doc = batch.column(0)
            asked = passes(bits, pc.fill_null(doc, 0).to_numpy(zero_copy_only=False)) | pc.is_null(doc).to_numpy(zero_copy_only=False)
            for part in common.slices(batch.filter(pa.array(asked))):
                sets = Sets(common.text_of(part), n)
                rows = distinct_rows(sets, seen)
                if not len(rows):
                    continue
                grams = [sets.gram[sets.at[r] : sets.at[r + 1]] for r in rows]
                inner = np.concatenate([[0, *np.searchsorted(g, steps), len(g)] for g in grams]).reshape(len(rows), -1)
                at = np.concatenate([[0], np.cumsum(np.diff(inner, axis=1).reshape(-1))])
                values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(grams).view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * FRAGMENTS, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(sets.node[rows]), lists], names=["node", "grams"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(emit), "node long, grams array<array<long>>")
    return common.stage(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def bounded(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` with both sizes, the need of b, and whether sizes and parities let them be similar."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_grams").alias("n_a"), F.col("parity").alias("parity_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_grams").alias("n_b"), F.col("parity").alias("parity_b"), "need")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "times", "n_a", "n_b", "need", may_be_similar(F.col("n_a"), F.col("n_b"), num, den).alias("fits"))


def may_be_similar(n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """Whether sizes and parities let two sets be similar; neither has twice the size of the other, so at most one fold is due."""

    def folded(x: str, y: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        fold = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(y), fold).otherwise(F.col(x))

    differ = F.zip_with(folded("parity_a", "parity_b"), folded("parity_b", "parity_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    sizes = F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num
    return F.when(sizes, apart * (num + den) <= (n_a + n_b) * (den - num)).otherwise(F.lit(False))


def linked(pairs: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b, n_a, n_b) and whether they are similar.

    Vertical partitioning: each fragment of the order is a row of its own, the
    overlap of two sets is counted in each fragment apart, and the
    partial counts are summed for each pair.
    """
    ends = common.stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = lists.join(common.sized(ends), "node", "left_semi")
    parts = own.select("node", F.posexplode("grams").alias("fragment", "part")).filter(F.size("part") > 0)
    met = pairs.select("a", "b").join(parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("part_b")), "b")
    met = met.join(parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("part_a")), ["a", "fragment"])
    partial = met.select("a", "b", F.size(F.array_intersect("part_a", "part_b")).alias("shared"))
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    both = pairs.join(total, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    similar = F.col("shared") * den >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * num
    return both.select(*pairs.columns, similar.alias("similar"))


def early_grams(lists: DataFrame, nodes: DataFrame, again: DataFrame, num: int, den: int) -> DataFrame:
    """gram, node and the place of the gram, of the first grams of each set of ``again`` (node, root).

    Here the order is by frequency among these nodes, then by gram.  Similar sets
    share one of their first size - ceil(t size) + 1 grams in any common order,
    and a gram of one node alone takes a place without giving a partner.  So a
    variant with enough grams of its own has no candidates at all, however large its group.
    """
    own = lists.join(again, "node").select("node", "root", F.explode(F.flatten("grams")).alias("gram"))
    often = own.groupBy("gram").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    often = common.stage(often.filter("c > 1").select("gram", "c", (F.col("low") != F.col("high")).alias("apart")))
    common.release(lists.sparkSession)
    shared = own.select("node", "gram").join(often, "gram")
    sized = shared.join(nodes.select("node", "n_grams"), "node")
    of_node = Window.partitionBy("node")
    place = F.row_number().over(of_node.orderBy("c", "gram")) + F.col("n_grams") - F.count("*").over(of_node)
    prefix = F.col("n_grams") - F.ceil(F.col("n_grams") * num / den - 1e-9) + 1
    early = sized.withColumn("place", place).filter((F.col("place") <= prefix) & F.col("apart")).select("gram", "node", "place")
    return common.stage(early.join(nodes.select("node", "n_grams", "parity"), "node"))


def met_early(early: DataFrame, roots: DataFrame, num: int, den: int, star: bool) -> DataFrame:
    """Pairs of nodes in different components that share an early gram and may be similar.

    All of them, or those of ``STARS`` nodes of each gram with the others: the ones where the gram
    comes first, which of a group of variants are the ones with the fewest grams of their own.
    """
    rooted = early.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def side(x: str) -> DataFrame:
        return rooted.select("gram", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("place", "n_grams", "root", "parity")])

    n_a, n_b = F.col("n_grams_a"), F.col("n_grams_b")
    one = side("a")
    if star:
        turn = F.row_number().over(Window.partitionBy("gram").orderBy("place_a", "a"))
        one = one.withColumn("turn", turn).filter(F.col("turn") <= STARS).drop("turn")
    # at the first common gram nothing before it is common, which bounds the overlap by what follows
    follows = (F.least(n_a - F.col("place_a"), n_b - F.col("place_b")) + 1) * (num + den) >= (n_a + n_b) * num
    both = one.join(side("b"), "gram").filter((F.lit(star) | (F.col("a") < F.col("b"))) & (F.col("root_a") != F.col("root_b")) & follows & may_be_similar(n_a, n_b, num, den))
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("n_grams_a", "n_grams_b").alias("n_a"), pick("n_grams_b", "n_grams_a").alias("n_b")).distinct()


# --- the operator --------------------------------------------------------------
def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sets, nodes, links, roots): documents with their nodes, distinct nodes, links between them, components.

    Links have similarity num / den or more; they connect every component, though
    pairs inside one may stay untested.
    """
    if 3 * num < 2 * den or num > den:
        raise ValueError("the similarity must be from 2/3 to 1: below it a set could meet partners beyond the next class of sizes")
    common.ready(docs.sparkSession)
    sets = common.stage(set_table(docs, n, num, den))
    nodes = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n_grams", "need", "parity")])
    nodes = common.stage(nodes)
    grams = nodes.agg(F.coalesce(F.sum("n_grams"), F.lit(0))).first()[0]
    buckets = max(16, int(grams * 2 * (den - num) / (den + num) * 2.2) // BUCKET_ROWS)
    first = common.stage(bounded(star_candidates(docs, n, num, den, buckets), nodes, num, den))
    crowded = first.groupBy("b").agg(F.sum("times").alias("times"), F.any_value("need").alias("need")).filter("times >= need").select("b")
    ends = first.filter("fits").select("a", "b").unionByName(first.filter("times > 0").join(crowded, "b", "left_semi").select("a", "b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    spark = docs.sparkSession
    common.release(spark)
    lists = gram_table(docs, n, common.stage(nodes.select("node", "doc").join(ends, "node", "left_semi")))
    tried = common.stage(linked(first.filter("fits"), lists, num, den))
    common.release(spark)
    links = common.stage(tried.filter("similar").select("a", "b"))
    roots = common.components(links)
    failed = first.filter("not fits and times > 0").unionByName(tried.filter("not similar and times > 0").drop("similar"))
    beaten = failed.groupBy("b").agg(F.sum("times").alias("times"), F.any_value("need").alias("need")).filter("times >= need").select("b")
    missed = failed.join(beaten, "b", "left_semi").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    touched = missed.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
    again = common.stage(touched.join(roots, "root", "left").select(F.coalesce("node", "root").alias("node"), "root").distinct())
    if not again.isEmpty():
        early, done = early_grams(lists, nodes, again, num, den), first.select("a", "b")
        common.release(spark)
        for star in (True, False):  # what the stars link need not be tried pair by pair
            pairs = common.stage(met_early(early, roots, num, den, star).join(done, ["a", "b"], "left_anti"))
            more = common.stage(linked(pairs, lists, num, den).filter("similar").select("a", "b"))
            if not more.isEmpty():
                links = links.unionByName(more)
                roots = common.components(links)
            common.release(spark)
            done = done.unionByName(pairs.select("a", "b"))
        links = common.stage(links)
        common.release(spark, early)
    common.release(spark, first, lists, tried)
    return sets, nodes, links, roots


def classes_of(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_grams and component_id (the smallest doc_id reachable by links) of each row."""
    sets, nodes, _, roots = join(docs, n, num, den)
    rooted = common.stage(roots.join(nodes.select("node", "doc"), "node"))
    name = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_node = common.attach(rooted.select("node", "root"), name, "root").select("node", "component_id")
    alone = nodes.filter("copies > 1").join(rooted, "node", "left_anti").select("node", F.col("doc").alias("component_id"))
    known = common.stage(of_node.unionByName(alone))
    return common.attach(sets.select("doc_id", "n_grams", "node"), known, "node").select("doc_id", "n_grams", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows without n-grams stay.

    Rows that go are few beside those that stay, so they are the side to look up.
    Of rows that share a doc_id and have n-grams one stays.
    """
    found = common.stage(classes_of(docs, n, num, den))
    gone = found.filter((F.col("n_grams") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.filter("n_grams > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = common.stage(twice)
    if twice.isEmpty():
        return kept
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
