"""Token ids in fixed-width bit-packed blocks.

A block holds whole documents: their ids one after another, each in the fewest
bits that hold the vocabulary.  Beside the packed bytes a block row keeps the
documents' ids and id counts, so that one document is unpacked without its
neighbours.  Blocks are ordered by document id: shards are ranges of it, and a
shard's blocks follow one another.  The block table is written with Spark's own
committed writer, so a lost executor leaves neither gaps nor duplicates.

Defined cases: null text is the empty text and has the end id alone; rows with
the same doc_id are ordered by text and each is kept; a null doc_id sorts first;
further columns are ignored; an empty table gives an empty block table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_IDS = 1 << 16
CACHE_WORDS = 500_000
#: Longer slices than elsewhere: more words are met once only.
SLICE_BYTES = 8 << 20
SENTINEL = "\x01"
BLOCKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
DOCUMENTS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, little-endian; 64 ids fill exactly ``bits`` 64-bit words."""
    n = -(-len(ids) // 64) * 64
    rows = np.zeros(n, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 64)
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block; only the groups of 64 that hold them are read."""
    first, last = start // 64, -(-stop // 64)
    words = np.frombuffer(payload, "<u8", (last - first) * bits, first * bits * 8).reshape(-1, bits)
    mask = np.uint64((1 << bits) - 1)
    rows = np.empty((len(words), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        rows[:, j] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            rows[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (rows & mask).reshape(-1)[start - first * 64 : stop - first * 64]


class WordEncoder:
    """Encodes texts with a tokenizers file, each distinct word once.

    The tokenizer's pre-tokeniser never joins characters across ASCII white
    space, so a text's ids are those of its words one after another.  An ASCII
    word of letters and closing marks is two pre-tokens, its letters in any case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.sentinel = self.ids([SENTINEL])[0][0]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        letters, others, marked = [], [], []
        for w in words:
            (letters if w.isascii() and w.isalpha() else marked if SENTINEL in w else others).append(w)
        self.learn_groups(letters, " ", lambda ids: np.flatnonzero(self.closes[ids]) + 1, 0)
        self.learn_groups(others, f" {SENTINEL} ", lambda ids: np.append(np.flatnonzero(ids == self.sentinel), len(ids)), 1)
        self.known.update((w, np.array(self.ids([w])[0], np.uint32).tobytes()) for w in marked)

    def learn_groups(self, words: list[str], between: str, ends, skip: int) -> None:
        """Encode words in groups; ``ends`` finds where each word's ids end, ``skip`` ids lie between words."""
        for i in range(0, len(words), 256):
            group = words[i : i + 256]
            ids = np.array(self.ids([between.join(group)])[0], np.uint32)
            end = ends(ids)
            if len(end) != len(group):
                self.known.update((w, np.array(x, np.uint32).tobytes()) for w, x in zip(group, self.ids(group), strict=True))
                continue
            raw, end, start = ids.tobytes(), (end * 4).tolist(), 0
            for w, stop in zip(group, end, strict=True):
                self.known[w] = raw[start:stop]
                start = stop + 4 * skip

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two piece codes for each word, and the flat ids and offsets of the pieces."""
        parts = pc.extract_regex(words, r"^(?P<stem>[A-Za-z]+)(?P<tail>[.,;:!?]+)?$")
        whole = pc.is_null(parts)
        stem = pc.if_else(whole, words, pc.ascii_lower(pc.fill_null(pc.struct_field(parts, "stem"), "")))
        tail = pc.if_else(whole, "", pc.fill_null(pc.struct_field(parts, "tail"), ""))
        coded = pa.concat_arrays([stem, tail]).dictionary_encode()
        wanted = common.strings(coded.dictionary)
        known = self.known
        new = [w for w in wanted if w not in known]
        if len(known) + len(new) > CACHE_WORDS:  # words met again stay
            self.known = known = {"": b""} | {w: known[w] for w in wanted if w in known}
        self.learn(new)
        ids = [known[w] for w in wanted]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
        return code, np.frombuffer(b"".join(ids), np.uint32), np.concatenate([[0], np.cumsum(size)])

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of ids of each text."""
        offsets, codes, words = common.split_words(text)
        if not len(words):
            return np.full(len(text), end, np.uint32), np.ones(len(text), np.int64)
        two, flat, at = self.pieces(words)
        piece = two[codes].reshape(-1)
        size = np.diff(at)[piece]
        total = common.segment_sum(size, offsets * 2)
        counts = total + 1
        out = np.full(counts.sum(), end, np.uint32)
        where = np.ones(len(out), bool)
        where[np.cumsum(counts) - 1] = False
        shift = at[piece] - np.concatenate([[0], np.cumsum(size)[:-1]])
        out[where] = flat[np.arange(size.sum()) + np.repeat(shift, size)]
        return out, counts


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker: tasks of the same worker share the words met before."""
    return WordEncoder(path)


common.CACHES.append(encoder)


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Block rows in ascending doc_id order within and across shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        bits = max(width_of(coder.tokenizer.get_vocab_size()), width_of(end_id + 1))
        block, before, shard = 0, 0, None
        for batch in batches:
            for part in common.slices(batch, most=SLICE_BYTES):
                ids, counts = coder.encode(common.text_of(part), end_id)
                doc_ids = part.column("doc_id").to_pylist()
                shard = part.column("shard")[0].as_py()
                at, first = np.concatenate([[0], np.cumsum(counts)]), 0
                while first < len(counts):
                    last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_IDS, side="right")) - 1)
                    n = int(at[last] - at[first])
                    yield pa.RecordBatch.from_pylist(
                        [{"shard": shard, "block": block, "bits": bits, "before": before, "n_ids": n, "doc_ids": doc_ids[first:last], "counts": counts[first:last].tolist(), "payload": pack(ids[at[first] : at[last]], bits)}],
                        schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())]),
                    )
                    block, before, first = block + 1, before + n, last

    common.ready(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(common.tidy(run, encoder), BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> str:
    """Write the block table of ``docs`` at ``path``."""
    encode_blocks(docs, tokenizer_path, end_id).write.mode("overwrite").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """One row per document of a block table, computed from the unpacked ids.

    ``start`` counts the ids of all documents before it; shard totals are one
    number a shard, summed in shard order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.concatenate([[0], np.cumsum(row["counts"])]).astype(np.int64)
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(row["counts"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["before"]), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    common.ready(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row a shard
    base, bases = 0, []
    for r in totals:
        bases.append((r["shard"], base))
        base += r["n"]
    table = spark.createDataFrame(bases, "shard int, base long")
    documents = blocks.mapInArrow(common.tidy(run), DOCUMENTS)
    return documents.join(table, "shard", "left").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark, path: str, doc_id: int) -> np.ndarray:
    """Random access: the ids of one document, from its block alone."""
    row = spark.read.schema(BLOCKS).parquet(path).filter(F.array_contains("doc_ids", F.lit(doc_id))).first()
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(doc_id)
    start = sum(row["counts"][:k])
    return unpack(row["payload"], row["bits"], start, start + row["counts"][k])


def fresh_path(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    common.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, path or fresh_path(spark, "token-blocks"), tokenizer_path, end_id))
