"""Shared pieces of the training-data operators: staging, text kernels, samples.

Text kernels work on Arrow batches.  A batch is split into words once and
dictionary-encoded, so that per-word work (hashing, scoring, tokenising) is done
once for each *distinct* word of a bounded slice and spread back by gather.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, release, ship_package, stage  # noqa: F401 (operators take them from here)

#: Bytes of text that one kernel call works on; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to a worker at a time, where the session leaves it at its default.
BATCH_ROWS = 4096
U64 = np.uint64


# --- session helpers -------------------------------------------------------
#: Tables of at most so many rows of two or three longs go to every task.
SMALL_ROWS = 500_000
#: Keys of more rows than this, and than one HOT_KEYS-th of all rows, are hot.
HOT_ROWS = 64
HOT_KEYS = 50_000


def ready(spark: SparkSession) -> None:
    """The package on the workers, and batches small enough that long texts do not pile up in one."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task stands beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Cached makers of what a worker keeps between tasks of one stage.
CACHES: list = []


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over the batches of a task; what other stages left is dropped first, and memory given back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cached in CACHES:
            if cached is not keep:
                cached.cache_clear()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(df: DataFrame, **extra: T.DataType) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in extra]
    return T.StructType(fields + [T.StructField(k, v, True) for k, v in extra.items()])


# --- Arrow slices ----------------------------------------------------------
def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its text column reaches ``most`` bytes; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size.astype(np.int64))
    start = 0
    while start < n:
        before = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as strings, null as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between bytes 0x20 and 0x09-0x0D.

    Returns the word offsets of each text (n + 1), a code for each word, and the
    distinct words that the codes point to.
    """
    trimmed = pc.ascii_trim_whitespace(text)
    if lower:
        trimmed = pc.ascii_lower(trimmed)
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # only texts without any word have an empty word
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[empty], minlength=len(counts))
        words = words.filter(pa.array(~empty))
    coded = words.dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def strings(words: pa.Array) -> list[str]:
    """The array as a list, by way of numpy: a tenth of the time of to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def hash_words(words: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each slice values[offsets[i]:offsets[i + 1]]; 0 for an empty slice."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: faster here than hashing."""
    if not len(x):
        return x
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def distinct_per_text(offsets: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) pairs without repeats."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    pair = unique(owner * max(size, 1) + codes)
    return pair // max(size, 1), pair % max(size, 1)


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all words, and the offsets of each word."""
    array = words.cast(pa.large_binary())
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType, column: str = "text", most: int = SLICE_BYTES, keep=None) -> DataFrame:
    """Apply ``work`` to bounded slices of each partition, without a shuffle."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run, keep), schema)


# --- bounded samples of labelled rows ---------------------------------------
#: Labels whose counts the driver holds; with more, counts are joined.
FEW_LABELS = 1000
#: Ids that are sent to every task; with more, they are joined by a shuffle.
FEW_IDS = 200_000


def remainder(column: str, by: int):
    """crc32 of the id's decimal text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % by


def bounded_sample(rows: DataFrame, label: str, per_class: int, seed: int = 17) -> DataFrame:
    """At most ``per_class`` rows of each label: those of the smallest id hash.

    A first cut by rate leaves about 1.5 times the bound, so that ranking never
    sorts a whole class.
    """
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40))
    known = rows.filter(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().limit(FEW_LABELS + 1).collect()}
    if not counts:
        return rows.limit(0)
    rate = lambda n: F.least(F.lit(1.0), (1.5 * per_class + 64.0) / n)
    if len(counts) <= FEW_LABELS:
        near = known.withColumn("_cut", F.coalesce(*[F.when(F.col(label) == F.lit(k), rate(F.lit(n))) for k, n in sorted(counts.items())]))
    else:  # as many labels as there may be: counts are joined
        near = attach(known, known.groupBy(label).agg(F.count("*").alias("_n")), label).withColumn("_cut", rate(F.col("_n"))).drop("_n")
    near = near.withColumn("_draw", draw).filter(F.col("_draw") < F.col("_cut") * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_draw", "doc_id"))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= per_class).drop("_rank", "_draw", "_cut")


def texts_of(docs: DataFrame, chosen: DataFrame, label: str, most_bytes: int) -> tuple[list[str], list]:
    """Texts and labels of a bounded choice of ids; ids beyond ``most_bytes`` of text are left out.

    Each label has an equal share of the bytes.  A text counts, and is given,
    with no more characters than a sixteenth of the bytes of a share, so that
    a long one takes at most a quarter of it and no label is left without texts.

    The ids go to every task if they are as few as FEW_IDS.
    """
    ids = stage(chosen.select("doc_id", label).distinct())
    few = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    share = most_bytes // max(1, ids.select(label).distinct().count())
    kept = docs.select("doc_id", F.substring("text", 1, max(1, share // 16)).alias("text")).join(few, "doc_id")
    draw = F.xxhash64(F.col("doc_id"), F.lit(5))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy(label).orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    table = kept.withColumn("_size", size).filter(F.col("_size") <= share).orderBy(draw, "doc_id").select("text", label).toArrow()
    return pc.fill_null(table["text"], "").to_pylist(), table[label].to_pylist()


# --- joins on hot keys ---------------------------------------------------------
def sized(table: DataFrame) -> DataFrame:
    """A staged table of a few longs, to be sent to every task if it is small enough."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def attach(rows: DataFrame, table: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` joined from the left with ``table``, which has one row a key; ``rows`` should be staged.

    Rows of a hot key never meet in one task.  A key is hot with more than
    HOT_ROWS rows and more than one HOT_KEYS-th of all rows, so there are at
    most HOT_KEYS such keys, and what ``table`` has on them goes to every task.
    Rows without a key are not moved at all.  ``total`` is the number of rows, where known.
    """
    total = rows.count() if total is None else total
    if total <= HOT_ROWS:
        return rows.join(table, key, "left").select(*rows.columns, *[c for c in table.columns if c != key])
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = stage(rows.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > most)).select(key))
    extra = [c for c in table.columns if c != key]
    few = F.broadcast(hot.join(table, key, "left").withColumn("_hot", F.lit(True)))
    still = rows.join(few, key, "left").filter(F.col(key).isNull() | F.col("_hot")).select(*rows.columns, *extra)
    moved = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return still.unionByName(moved.select(*rows.columns, *extra))


# --- components --------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node with a link.

    Star contraction: each round hangs a node's larger neighbours on its smallest
    one, then each node's smaller neighbours on the smallest of them, until
    nothing changes.  Minima are combined before the shuffle; each round is cut
    off in the checkpoint folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    size_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, last = size_of(edges), None
    while now != last and now[0]:
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attach(two.filter("v > u"), low, "u", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, edges = edges, stage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now, last = size_of(edges), now
        del two, low, large, hung
        release(links.sparkSession, before)  # a round leaves many small files
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
