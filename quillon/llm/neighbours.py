"""Approximate nearest neighbours by cross-polytope hashing.

A vector's direction goes through three rounds of random signs and a fast Hadamard
transform, which together act like a random rotation; its hash is the nearest signed
axis, the component of the largest absolute value with its sign.  Every row is in one
bucket of each table.  A query probes, in each table, the buckets of the axes that its
rotated vector points to most, and is compared exactly with all rows found there.

The number of probes comes from a bounded sample of rows: the fewest with which the
sample's own nearest neighbours are found at the recall asked for.  Neighbours among
all rows are nearer than those among a sample, so that the recall over all rows is higher.
Where norms differ, a row's direction gets a further component that makes all norms
equal, so that the largest inner product is the nearest direction.

Rows and probes meet by shuffle on (length, table, bucket).  Buckets of many rows are
cut into chunks of rows, and those of many probes into chunks of probes; a probe goes
to every chunk of rows.  A task holds one chunk of rows and streams the probes past it;
it keeps each probe's k best, which meet once more by query.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without an id; vectors of different lengths are never compared;
rows with the query's own id are not its candidates; of rows that share another id the
nearest counts, once; of repeated query ids one vector is asked, the first in array
order; ties go to the smaller id; fewer candidates than k give all that the probed
buckets hold, and with few rows the probes are widened until these are all or many; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TABLES = 8
ROUNDS = 3
#: Bounds of the sample from which the number of probes is fitted, and the recall that it must reach there.
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 256
TARGET = 0.95
#: Rows and probes of a chunk: rows at least and at most, as the table grows.
CHUNK_ROWS = (1024, 32_768)
CHUNK_PROBES = 65_536
#: Pairs that a task scores at a time.
PAIRS = 1 << 21
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, the vector as it stands, its length and squared norm; unusable vectors left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.filter(x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0))
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return kept.select("vec_id", x.alias("v"), F.size(x).alias("dim"), square.alias("square"))


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def directions(x: np.ndarray, longest: float, lift: bool, query: bool) -> np.ndarray:
    """Unit vectors, with ``lift`` one component more; filled up with zeros to a power of two."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    width = width_of(x.shape[1] + lift)
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x / (norm if query or not lift else longest)
    if lift and not query:
        out[:, x.shape[1]] = np.sqrt(np.maximum(1 - (norm[:, 0] / longest) ** 2, 0))
    return out


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Rows after the table's pseudo-random rotation: random signs, then a Hadamard transform, three times."""
    n, width = x.shape
    draw = np.random.default_rng([width, table])
    for _ in range(ROUNDS):
        x = x * draw.choice([-1.0, 1.0], width)
        half = 1
        while half < width:
            pairs = x.reshape(n, -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            half *= 2
        x = x / np.sqrt(width)
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """Bucket of each row in each table: twice the axis, one more where it points the other way."""
    out = np.empty((len(x), TABLES), np.int64)
    for t in range(TABLES):
        y = rotated(x, t)
        axis = np.abs(y).argmax(axis=1)
        out[:, t] = 2 * axis + (y[np.arange(len(x)), axis] < 0)
    return out


def probe_order(x: np.ndarray, table: int) -> np.ndarray:
    """All buckets of a table for each query, those of the axes nearest to it first."""
    y = rotated(x, table)
    return np.argsort(-np.stack([y, -y], axis=2).reshape(len(x), -1), axis=1, kind="stable")


def fitted(x: np.ndarray, longest: float, lift: bool, k: int, target: float) -> int:
    """Fewest probes a table with which the sample's own k nearest rows are found at the target recall."""
    score = x[:SAMPLE_QUERIES] @ x.T
    np.fill_diagonal(score, -np.inf)
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    held, asked = buckets(directions(x, longest, lift, False)), directions(x[:SAMPLE_QUERIES], longest, lift, True)
    first = np.full(near.shape, 1 << 30)
    for t in range(TABLES):
        place = np.argsort(probe_order(asked, t), axis=1)
        first = np.minimum(first, np.take_along_axis(place, held[near, t], axis=1))
    return 1 + int(np.sort(first, axis=None)[int(np.ceil(target * first.size)) - 1])


def by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(row filter, components as doubles) of the vectors of each length."""
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        own = pa.array(size == dim)
        yield own, v.filter(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def hashed(table: DataFrame, longest: float, lift: bool, probes: int | None) -> DataFrame:
    """A row for each vector and table with its bucket, or with ``probes`` a row for each probe."""
    schema = T.StructType([*table.schema.fields, T.StructField("at", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in by_length(batch) if batch.num_rows else ():
                d = directions(x, longest, lift, probes is not None)
                if probes is None:
                    found = buckets(d) + np.arange(TABLES) * 2 * d.shape[1]
                else:
                    found = np.hstack([probe_order(d, t)[:, :probes] + t * 2 * d.shape[1] for t in range(TABLES)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.astype(np.int32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.filter(own).columns, lists], names=schema.names)

    return table.mapInArrow(common.tidy(work), schema).withColumn("at", F.explode("at"))


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows: (query id, row id, score); of one id the nearest, ties to the smaller id."""
    rough = q @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
        floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1] - slack
        i, j = np.nonzero((rough >= floor[:, None]) & np.isfinite(rough))
    else:
        i, j = np.nonzero(np.isfinite(rough))
    score = np.concatenate([(q[i[s : s + 65_536]] * x[j[s : s + 65_536]]).sum(axis=1) for s in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return query_ids[i[kept]], ids[j[kept]], score[kept]


def chunk_by_chunk(k: int):
    """Sorted rows of a task: of each key the chunk of rows, then the probes that stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "at", "chunk", "turn", "side")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, stop in zip(edges, edges[1:]):
                own = batch.slice(start, stop - start)
                key, side = tuple(keys[start, :4].tolist()), keys[start, 4]
                ids = own.column("vec_id").to_numpy()
                x = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, key[0])
                if key != now:
                    now, held = key, []
                if side == 0:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                step = max(1, PAIRS // len(held[0][0]))
                for s in range(0, len(ids), step):
                    found = best_of(ids[s : s + step], x[s : s + step], *held[0], k)
                    if len(found[0]):
                        yield pa.record_batch([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query row."""
    spark = rows.sparkSession
    common.ready(spark)
    table = usable(rows)
    n, longest, shortest = table.agg(F.count("*"), F.sqrt(F.max("square")), F.sqrt(F.min("square"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lift = bool(shortest < longest * (1 - 1e-6))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, n // SAMPLE_ROWS)))
    sample = table.filter(draw == 0).limit(2 * SAMPLE_ROWS).select("v").toArrow()
    fits = [(fitted(x, longest, lift, k, target), 2 * width_of(x.shape[1] + lift)) for _, x in by_length(sample)] if len(sample) else [(1, 2)]
    few = max(-(-4 * k * axes // n) for _, axes in fits)  # where buckets hold few rows, enough for k
    probes = max(few, max(p for p, _ in fits))
    table = table.drop("square")
    asked = table.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    held, sent = hashed(table, longest, lift, None), hashed(asked, longest, lift, probes)
    per_chunk = int(np.clip(n * TABLES // 256, *CHUNK_ROWS))
    full = held.groupBy("dim", "at").agg(F.ceil(F.count("*") / per_chunk).alias("chunks"))
    asks = sent.groupBy("dim", "at").agg(F.ceil(F.count("*") / CHUNK_PROBES).alias("turns"))
    # a row for each bucket: twice the components, times the tables
    sizes = common.sized(common.stage(full.join(asks, ["dim", "at"])))
    drawn = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1))
    key = ("dim", "at", "chunk", "turn")
    held = held.join(sizes, ["dim", "at"]).withColumn("chunk", drawn("chunks", 11)).withColumn("turn", every("turns")).withColumn("side", F.lit(0))
    sent = sent.join(sizes, ["dim", "at"]).withColumn("turn", drawn("turns", 12)).withColumn("chunk", every("chunks")).withColumn("side", F.lit(1))
    met = held.select(*key, "side", "vec_id", "v").unionByName(sent.select(*key, "side", "vec_id", "v")).repartition(*key).sortWithinPartitions(*key, "side")
    found = met.mapInArrow(common.tidy(chunk_by_chunk(k)), FOUND).repartition("query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
