"""Exact top-k by inner product with multi-resolution segment bounds.

Vectors are cut into segments at several resolutions; of each segment the mean
and the deviation are kept.  Within a segment of n components

    |q - x|^2  >=  n (mean_q - mean_x)^2 + n (dev_q - dev_x)^2,

so a sum over segments bounds the distance from below, and with the two norms it
bounds the inner product (|q|^2 + |x|^2 - |q - x|^2) / 2 from above.

Rows are dealt into blocks of like statistics.  The range of a block's statistics
bounds all its rows at once: queries whose k-th score lies above pass it by.  Within a
block the bounds go coarse to fine, each for the queries and rows that still have
a pair that may reach the query's k-th score, and exact scores are worked out for
what is left: pair by pair where that is little, as a product of the remaining
queries and rows otherwise.  The first k-th scores come from a bounded sample of the rows.

The query set is stated and goes over all rows in chunks of bounded bytes: one pass
over the table a chunk, of which each partition keeps the k best of each query that
reach the sample's.  The driver holds one chunk and the sample at a time.

Defined cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows without an id; vectors of different lengths are never
compared; rows with the query's own id are not its candidates; repeated rows of
another id each count; of repeated query ids one vector is asked, the first in
array order; fewer candidates than k give all; an empty table gives no rows.
Scores are exact whatever their size, and held at the limits of a long beyond them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 16 << 20
SAMPLE_ROWS = 4096
ROW_BLOCK = 512
SLACK = 1e-6
#: Below this product of two lengths float sums of whole numbers are exact.
EXACT = 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id and the scaled, floored components; unusable vectors left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.filter(x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite)
    return kept.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))


def by_length(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole components) of the vectors of each length."""
    if not batch.num_rows:
        return
    ids, v = batch.column("vec_id"), batch.column("v")
    if isinstance(v, pa.ChunkedArray):
        ids, v = ids.combine_chunks(), v.combine_chunks()
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        own = pa.array(size == dim)
        yield ids.filter(own).to_numpy(), v.filter(own).flatten().to_numpy().reshape(-1, dim)


def segment_counts(dim: int) -> list[int]:
    return [s for s in (1, 4, 16) if s <= dim // 2] or [1]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, each scaled by the root of its length."""
    cut = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(cut)
    total = np.add.reduceat(x, cut[:-1], axis=1)
    square = np.add.reduceat(x * x, cut[:-1], axis=1)
    mean = total / size
    deviation = np.sqrt(np.maximum(square / size - mean * mean, 0))
    return np.hstack([mean * np.sqrt(size), deviation * np.sqrt(size)])


def like_blocks(means: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in blocks of at most ``most``, halved along the widest mean."""
    todo, out = [np.arange(len(means))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        wide = int(np.argmax(means[own].std(axis=0)))
        order = np.argpartition(means[own, wide], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class Block:
    """Queries of one length with their statistics and the k best found so far.

    ``scored`` counts the pairs that got exact scores, ``offered`` all pairs.
    """

    def __init__(self, ids: np.ndarray, whole: np.ndarray, k: int):
        self.ids, self.whole, self.k = ids, whole, k
        self.x = whole.astype(np.float64)
        self.norm = (self.x * self.x).sum(axis=1)
        self.levels = [(s, statistics(self.x, s)) for s in segment_counts(self.x.shape[1])]
        fine = self.levels[-1][1]
        mean, dev = fine[:, : fine.shape[1] // 2], fine[:, fine.shape[1] // 2 :]
        self.range = np.hstack([np.maximum(mean, 0), np.minimum(mean, 0), dev])
        self.floor = np.full(len(ids), LEAST, np.int64)
        self.found = [np.zeros(0, np.int64)] * 3  # query, id, score
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = self.offered = 0

    def scores(self, q: np.ndarray, whole: np.ndarray, x: np.ndarray, norm: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
        """Whole inner products of queries ``q`` with all rows, or of single pairs (q, row)."""
        if np.sqrt(self.norm[q].max() * norm.max()) >= EXACT:  # in whole numbers of any size
            a, b = self.whole[q].astype(object), whole.astype(object)
            raw = a @ b.T if pairs is None else (a * b[pairs]).sum(axis=1)
            return np.clip(raw, LEAST, MOST).astype(np.int64)
        if pairs is None:
            return (self.x[q] @ x.T).astype(np.int64)
        return np.einsum("ij,ij->i", self.x[q], x[pairs]).astype(np.int64)

    def add(self, ids: np.ndarray, whole: np.ndarray) -> None:
        """Offer rows: block by block, bounds coarse to fine, then exact scores of what is left."""
        x = whole.astype(np.float64)
        norm = (x * x).sum(axis=1)
        levels = [statistics(x, s) for s, _ in self.levels]
        half = levels[-1].shape[1] // 2
        self.offered += len(self.ids) * len(ids)
        for own in like_blocks(levels[-1][:, :half], ROW_BLOCK):
            fine = levels[-1][own]
            most = self.range @ np.concatenate([fine[:, :half].max(axis=0), fine[:, :half].min(axis=0), fine[:, half:].max(axis=0)])
            q = np.flatnonzero(most + SLACK * (self.norm + norm[own].max()) >= self.floor)
            alive = np.ones((len(q), len(own)), bool)
            for (_, mine), theirs in zip(self.levels, levels, strict=True):
                if not len(q):
                    break
                alive &= mine[q] @ theirs[own].T >= self.floor[q][:, None] - SLACK * (self.norm[q][:, None] + norm[own][None, :])
                open_q, open_r = alive.any(axis=1), alive.any(axis=0)
                q, own, alive = q[open_q], own[open_r], alive[np.ix_(open_q, open_r)]
            if not len(q):
                continue
            if alive.sum() * 8 < alive.size:
                i, j = np.nonzero(alive)
                self.scored += len(i)
                score = self.scores(q[i], whole[own], x[own], norm[own], j)
                i, j = q[i], own[j]
            else:
                self.scored += alive.size
                score = self.scores(q, whole[own], x[own], norm[own], None)
                i, j = np.nonzero(score >= self.floor[q][:, None])
                score, i, j = score[i, j], q[i], own[j]
            kept = (score >= self.floor[i]) & (self.ids[i] != ids[j])
            self.fresh.append((i[kept], ids[j[kept]], score[kept]))
            if sum(len(f[0]) for f in self.fresh) > 4 * self.k * len(self.ids):
                self.settle()
        self.settle()

    def settle(self) -> None:
        """Keep the k best of each query and raise the k-th scores."""
        q, v, s = (np.concatenate([old, *new]) for old, new in zip(self.found, zip(*self.fresh, strict=True) if self.fresh else [[]] * 3, strict=True))
        self.fresh = []
        order = np.lexsort((v, -s.astype(np.float64), q)) if not len(s) or abs(s).max() < EXACT else np.array(sorted(range(len(s)), key=lambda i: (q[i], -int(s[i]), v[i])))
        q, v, s = q[order], v[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.found = [q[kept], v[kept], s[kept]]
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


OUT = "query_id long, vec_id long, score long"


def against(chunk: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """A pass of one partition's rows against the queries (ids, components, k-th scores) of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {}
        for ids, whole, floor in chunk:
            blocks[whole.shape[1]] = Block(ids, whole, k)
            blocks[whole.shape[1]].floor = floor.copy()
        for batch in batches:
            for ids, whole in by_length(batch):
                if whole.shape[1] in blocks:
                    blocks[whole.shape[1]].add(ids, whole)
        for block in blocks.values():
            q, v, s = block.found
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def seeded(ids: np.ndarray, whole: np.ndarray, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries with a lower bound of their k-th scores, from the sample."""
    block = Block(ids, whole, k)
    if whole.shape[1] in sample:
        own, x = sample[whole.shape[1]]
        for i in range(0, len(own), ROW_BLOCK):
            block.add(own[i : i + ROW_BLOCK], x[i : i + ROW_BLOCK])
    return ids, whole, block.floor


def search(rows: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query row."""
    spark = rows.sparkSession
    common.ship_package(spark)
    table = usable(rows, scale)
    asked = common.stage(table.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    total = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    chunks = -(-total * 8 // CHUNK_BYTES)
    if not chunks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = max(1, table.count() // SAMPLE_ROWS)
    drawn = table.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(share)) == 0).limit(2 * SAMPLE_ROWS).toArrow()
    sample = {x.shape[1]: (ids, x) for ids, x in by_length(drawn)}
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = None
    for c in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow()
        chunk = [seeded(ids, x, sample, k) for ids, x in by_length(own)]
        found = table.mapInArrow(against(chunk, k), OUT).withColumn("rank", rank).filter(F.col("rank") <= k)
        found = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if chunks > 1:  # each pass ends before the next chunk is taken in
            found = common.stage(found)
        out = found if out is None else out.unionByName(found)
    return out
