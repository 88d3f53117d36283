"""Phrase collocations: frequent phrases of 2 to 5 words whose parts stand together more often than by chance.

Texts are cut into pieces, and identical pieces of a language become one row with its
number of copies.  Phrases are counted with those weights: partial counts of a task's
pieces are dealt by the hash of language and phrase, and duckdb adds up each bucket,
on disk where the bucket is larger than its memory.

Words come first, then pairs, then longer phrases.  A phrase that is frequent has
frequent words and frequent pairs only, so each pass leaves out phrases with a word or
a pair that is not; those sets are held as bits of a filter of fixed size, whose false
hits cost work and change no result.

Every cut of a candidate asks for the counts of its two parts: requests are shuffled to
the counted phrases, and parts that very many candidates ask for go to every task.

Defined cases: null text is the empty text, null lang is ``und``; empty pieces and texts
have no words; repeated rows count as often as they stand; ties go as stated by ``rank``
order; further columns are ignored; an empty table, or one without a frequent phrase,
gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .binary_tokens import fresh_path

LONGEST = 5
#: Bits of the filters of frequent words and pairs (16 MiB).
FILTER_BITS = 1 << 27
#: Text that a task gathers before it counts, and the memory of a bucket before it goes to disk.
GATHER_BYTES = 12 << 20
BUCKET_MEMORY = "256MB"
#: Parts that a language is cut into for a first ranking.
RANK_PARTS = 64
PARTS = "lang string, phrase string, times long"

#: Bytes as they stand in pieces: A-Z in lower case, marks and line ends as line feeds, tabs as spaces.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[65:91] += 32
BYTES[[*b".,;:!?", 10, 11, 12, 13]] = 10
BYTES[9] = 32


def pieces_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, piece (words between single spaces) and how often the slice holds it."""
    text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    lang = pc.fill_null(batch.column("lang"), "und")
    data, offsets = common.flat_bytes(text)
    clean = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(BYTES[data]))
    lists = pc.split_pattern(clean, "\n")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    piece = pc.utf8_trim(lists.flatten(), " ")
    double = pc.match_substring(piece, "  ")
    if pc.any(double).as_py():
        piece = pc.if_else(double, pc.replace_substring_regex(piece, " +", " "), piece)
    owner = lang.take(pa.array(np.repeat(np.arange(len(lang)), size)))
    found = pa.table({"lang": owner, "phrase": piece.cast(pa.string())}).filter(pc.greater(pc.binary_length(piece), 0))
    found = found.group_by(["lang", "phrase"]).aggregate([([], "count_all")])
    return pa.record_batch([found[c].combine_chunks() for c in ("lang", "phrase", "count_all")], names=["lang", "phrase", "times"])


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER_BYTES) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def places(lang: str, phrases: pa.Array) -> np.ndarray:
    """The bit of each phrase of a language in a filter."""
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in common.strings(phrases)), np.uint64, len(phrases)) % np.uint64(FILTER_BITS)


def holds(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(frequent: DataFrame) -> np.ndarray:
    """Bits of all phrases of a counted table; its size does not depend on the table's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            for lang in pc.unique(table["lang"]).to_pylist():
                own = places(lang, table.filter(pc.equal(table["lang"], lang))["phrase"].combine_chunks())
                yield pa.record_batch([pa.array((own >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (own & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    set_bits = frequent.select("lang", "phrase").mapInArrow(work, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[set_bits["at"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    return bits


class Words:
    """The words of a table of pieces of one language, as codes."""

    def __init__(self, table: pa.Table):
        lists = pc.split_pattern(table["phrase"].combine_chunks(), " ")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.times = np.repeat(table["times"].to_numpy(), size)
        self.joined = np.ones(len(self.codes), bool)  # to the word after it
        self.joined[np.cumsum(size)[size > 0] - 1] = False

    def counted(self, ids: np.ndarray, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """Phrases of ``n`` words at the places ``at``, told apart by ``ids``, and their weights."""
        key, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        columns = [self.names.take(pa.array(self.codes[at[first] + k])) for k in range(n)]
        return pc.binary_join_element_wise(*columns, " "), np.bincount(inverse, self.times[at], minlength=len(key)).astype(np.int64)

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """Places of pairs of words that the filter of words holds."""
        return np.flatnonzero(self.joined[:-1] & words[self.codes[:-1]] & words[self.codes[1:]])


def counts_of(pieces: DataFrame, work) -> DataFrame:
    """Partial counts: ``work`` gives (phrases, weights) of the pieces of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            for lang in pc.unique(table["lang"]).to_pylist():
                for phrases, times in work(lang, Words(table.filter(pc.equal(table["lang"], lang)))):
                    for k in range(0, len(phrases), 1 << 16):
                        part = phrases.slice(k, 1 << 16)
                        yield pa.record_batch([pa.array([lang] * len(part), pa.string()), part.cast(pa.string()), pa.array(times[k : k + len(part)], pa.int64())], names=["lang", "phrase", "times"])

    return pieces.mapInArrow(common.tidy(run), PARTS)


def in_buckets(parts: DataFrame, least: int, totals: bool = False) -> DataFrame:
    """Counts of at least ``least``, added up by duckdb in each hash bucket; ``totals`` adds a language's sum with a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": "1", "memory_limit": BUCKET_MEMORY, "temp_directory": spill, "preserve_insertion_order": "false"}) as db:
            db.execute("CREATE TABLE parts (lang VARCHAR, phrase VARCHAR, times BIGINT)")
            for table in gathered(batches):
                db.register("more", table)
                db.execute("INSERT INTO parts FROM more")
                db.unregister("more")
            queries = ["SELECT lang, phrase, sum(times)::BIGINT AS f FROM parts GROUP BY lang, phrase HAVING sum(times) >= $least"]
            if totals:
                queries.append("SELECT lang, NULL::VARCHAR AS phrase, sum(times)::BIGINT AS f FROM parts GROUP BY lang HAVING $least > 0")
            for query in queries:
                yield from db.sql(query, params={"least": least}).to_arrow_reader(1 << 16)

    return parts.repartition("lang", "phrase").mapInArrow(common.tidy(run), "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that stand at least ``least`` times (lang, phrase, m, f), and the words of each language (lang, n)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "pieces")
    cut = common.map_slices(docs.select("lang", "text"), pieces_of, PARTS)
    cut.groupBy("lang", "phrase").agg(F.sum("times").alias("times")).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)
    common.release(spark)  # the shuffle behind a written table goes before the next one is made

    def words(lang: str, own: Words):
        yield own.names, np.bincount(own.codes, own.times, minlength=len(own.names)).astype(np.int64)

    told = common.stage(in_buckets(counts_of(pieces, words), least, totals=True))
    single = told.filter(F.col("phrase").isNotNull())
    common.release(spark)
    usual = spark.sparkContext.broadcast(filter_of(single))

    def pairs(lang: str, own: Words):
        at = own.pairs(holds(usual.value, places(lang, own.names)))
        yield own.counted(own.codes[at] * len(own.names) + own.codes[at + 1], at, 2)

    pieces = pieces.filter(F.instr("phrase", " ") > 0)
    levels = [single.withColumn("m", F.lit(1))]
    if longest >= 2:
        two = common.stage(in_buckets(counts_of(pieces, pairs), least))
        common.release(spark)
        levels.append(two.withColumn("m", F.lit(2)))
    if longest >= 3:
        known = spark.sparkContext.broadcast(filter_of(two))

        def longer(lang: str, own: Words):
            at = own.pairs(holds(usual.value, places(lang, own.names)))
            key, first, ids = np.unique(own.codes[at] * len(own.names) + own.codes[at + 1], return_index=True, return_inverse=True)
            good = holds(known.value, places(lang, pc.binary_join_element_wise(*[own.names.take(pa.array(own.codes[at[first] + k])) for k in (0, 1)], " ")))
            at, ids = at[good[ids]], ids[good[ids]]
            follows = np.zeros(len(own.codes) + 1, bool)  # places where a pair of the filter begins
            follows[at] = True
            for m in range(3, longest + 1):
                kept = follows[at + m - 2]
                at, ids = at[kept], ids[kept]
                ids = np.unique(ids * len(own.names) + own.codes[at + m - 1], return_inverse=True)[1]
                yield own.counted(ids, at, m)

        more = common.stage(in_buckets(counts_of(pieces, longer), least))
        common.release(spark)
        levels.append(more.withColumn("m", F.size(F.split("phrase", " "))))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, told.filter(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))


def mine(docs: DataFrame, least: int = 100, most: int = 2000, longest: int = LONGEST, covered: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``most`` best phrases of each language.

    A phrase goes where a longer candidate holds it and stands at least ``covered``
    hundredths as often; one word longer is enough to look at, as what lies between
    stands no less often than the longer one.
    """
    common.ready(docs.sparkSession)
    frequent, sizes = frequent_phrases(docs, least, longest)
    key = lambda phrase: F.concat_ws("\0", "lang", phrase)
    candidates = frequent.filter("m >= 2").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("first", key(F.concat_ws(" ", F.slice(words, F.lit(1), F.col("k"))))).withColumn("rest", key(F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")))))
    answers = lambda name, part: frequent.select(key("phrase").alias(part), F.col("f").alias(name))
    cuts = common.stage(cuts)
    total = cuts.count()
    cuts = common.stage(common.attach(cuts, answers("l", "first"), "first", total))
    cuts = common.stage(common.attach(cuts, answers("r", "rest"), "rest", total))
    cuts = common.stage(common.attach(cuts, sizes, "lang", total))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"a_n": wide("a") * wide("n") * F.lit(1000).cast("decimal(38,0)"), "l_r": wide("l") * wide("r")}).withColumn("score", F.expr("a_n div l_r"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    inside = lambda part, f: cuts.filter(F.col("a") * 100 >= F.col(f) * covered).filter(F.col("m") > 2).select(F.col(part).alias("key"))
    dropped = inside("first", "l").filter(F.col("k") == F.col("m") - 1).unionByName(inside("rest", "r").filter("k = 1")).distinct()
    kept = scored.withColumn("key", key("phrase")).join(dropped, "key", "left_anti")
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = kept.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
