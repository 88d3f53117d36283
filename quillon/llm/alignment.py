"""Alignment of two tokenizers: token groups of each document, and how usual each link is.

Both tokenizers cut the same bytes, a space and the text.  Offsets where tokens of both
end cut the text into groups; tokens whose byte ranges overlap are linked.

A text is first cut into chunks at places where both tokenizers always end a token
(between a character and the space or line feed after it, and so on), so that a chunk's
tokens do not depend on its neighbours.  Each distinct chunk is encoded once for a
worker's cache; its token intervals go into two duckdb tables, where ASOF joins find
the first and last overlapping token, a range join lists the links, and window sums
number the groups.  A document's figures are sums over its chunks.

Documents stay in one Arrow slice, so the number of a slice's documents that hold a
pair linked is a partial count; Spark adds the partial counts up.  The slices, written
under the shared folder, then meet the counts: as one table in every task where the
pairs are as few as MOST_PAIRS, as requests shuffled to the pairs and back otherwise.

Defined cases: a text that is null or empty, or whose tokens of either side do not join
to the same bytes, has no tokens: zeros and the empty string; each of repeated rows, or
rows that share a doc_id or have none, is a document; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .binary_tokens import fresh_path

#: Chunks that a worker remembers between slices.
CACHE_CHUNKS = 400_000
#: Pairs whose counts go to every task (16 bytes each).
MOST_PAIRS = 2_000_000
SHIFT = 32
#: The letters that chunk_ends knows, before a mark.
LETTERS_BEFORE_MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,;:!?]"
#: A space and letters on which all versions of Unicode agree.
PLAIN = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
#: Leading bytes of the characters beyond ASCII that are white space, by their length.
WIDE_SPACE_2, WIDE_SPACE_3 = 0xC2, (0xE1, 0xE2, 0xE3)

SLICES = T.StructType(
    [
        T.StructField("slice", T.StringType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("figures", T.BinaryType()),  # n_a, n_b, n_groups, n_links of each document
        T.StructField("digests", T.ArrayType(T.StringType())),
        T.StructField("offsets", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),  # of each document's pairs, among the slice's
        T.StructField("times", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("docs", T.ArrayType(T.LongType())),  # of the partition's pairs so far, in its last slice
        T.StructField("of_pairs", T.ArrayType(T.LongType())),
    ]
)
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

#: Offsets where tokens of both sides end, numbered; each token belongs to the first one at or after its end.
TOKENS_SQL = """
WITH cut AS (SELECT a.e, sum(1) OVER (ORDER BY a.e ROWS UNBOUNDED PRECEDING) AS g FROM a SEMI JOIN b ON a.e = b.e),
t AS (SELECT 0 AS side, a.*, g FROM a ASOF JOIN cut ON a.e <= cut.e UNION ALL SELECT 1, b.*, g FROM b ASOF JOIN cut ON b.e <= cut.e)
SELECT side, id, chunk, g::BIGINT AS g FROM t ORDER BY g, side, i
"""
#: Overlapping byte ranges within a chunk.
LINKS_SQL = """
SELECT a.chunk, a.id::BIGINT * 4294967296 + b.id AS pair FROM a JOIN b ON a.chunk = b.chunk AND a.s < b.e AND b.s < a.e ORDER BY a.i, b.i
"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """A byte-level tokenizers file; it encodes a chunk as it stands.

    Where the file's merges stand in the order of their ids, as ranks do, chunks of a
    space and letters are encoded by tiktoken with the file's own vocabulary.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.sizes = np.array([len(x) for x in self.bytes])
        self.splits = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" a,\nb  c")] == ["Ġa", ",", "Ċ", "b", "Ġ", "Ġc"]
        model = json.loads(self.tokenizer.to_str())["model"]
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        single = [i for p, i in model["vocab"].items() if len(p) == 1 and p in letters]
        self.fast = None
        if self.splits and merged and len(single) == 256 and max(single) < merged[0] and all(x < y for x, y in zip(merged, merged[1:])) and len(model["vocab"]) <= 257 + len(merged):
            ranks = {self.bytes[i]: i for i in [*single, *merged]}
            self.fast = tiktoken.Encoding("of-file", pat_str=r" ?\p{L}+|[\s\S]", mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Chunks of a space and letters are encoded together, as such a space begins a token."""
        plain = [self.fast is not None and PLAIN(c) is not None for c in chunks]
        out: list = [None] * len(chunks)
        alone = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([chunks[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = e.ids
        joined = [k for k, p in enumerate(plain) if p]
        if joined:
            group = [chunks[k] for k in joined]
            ids = self.fast.encode_ordinary("".join(group))
            end = np.cumsum(self.sizes[ids])
            stop = np.searchsorted(end, np.cumsum([len(c.encode()) for c in group]), side="right").tolist()
            for k, x, y in zip(joined, [0, *stop], stop):
                out[k] = ids[x:y]
        return out


class PieceSide:
    """A sentencepiece file that adds a space before a text and falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        text = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.sizes = np.array([len(x) for x in self.bytes])
        self.mark = self.model.encode("\n")
        self.splits = len(self.mark) == 2 and not any("▁" in p.lstrip("▁") or "\n" in p or re.search(LETTERS_BEFORE_MARKS, p) for p in text)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """A chunk's first space is the one that the model adds; others stand behind a line feed, which is a token of its own."""
        ids = self.model.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
        return [x if c[0] == " " else x[2:] if x[:2] == self.mark else [] for c, x in zip(chunks, ids, strict=True)]


def chunk_ends(data: np.ndarray, offsets: np.ndarray, split: bool) -> np.ndarray:
    """Ends of the chunks of texts laid end to end: all text ends and, with ``split``, the safe places between."""
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets[1:]] = True
    if split and len(data) > 1:
        white = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        wide = np.zeros(len(data), bool)  # last bytes of what may be white space beyond ASCII
        wide[1:] |= data[:-1] == WIDE_SPACE_2
        if len(data) > 2:
            wide[2:] |= np.isin(data[:-2], WIDE_SPACE_3)
        solid = ~white & ~wide
        follows = ~white & (data != WIDE_SPACE_2) & ~np.isin(data, WIDE_SPACE_3)
        feed = data == 10
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        marks = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
        here = ends[1:-1]
        here |= solid[:-1] & ((data[1:] == 32) | feed[1:])
        here |= letter[:-1] & marks[1:]
        here[1:] |= solid[:-2] & feed[1:-1] & follows[2:]
    ends[0] = False
    return np.flatnonzero(ends)


class Aligner:
    """What a worker knows of chunks: token, group and link counts, group strings and linked pairs."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.split = self.a.splits and self.b.splits
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "400MB"})
        names = [str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)))]
        self.names = {mark: np.array([n + mark for n in names], object) for mark in ",|;"}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.figures = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.groups = np.zeros(0, object)
        self.at = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def kept(self, wanted: list[str]) -> None:
        """Forget all but ``wanted``."""
        old = {c: self.known[c] for c in wanted if c in self.known}
        own = np.fromiter(old.values(), np.int64, len(old))
        size = np.diff(self.at)[own]
        self.pairs = self.pairs[spread(self.at[own], size)]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.figures, self.good, self.groups = self.figures[own], self.good[own], self.groups[own]
        self.known = dict(zip(old, range(len(old))))

    def learn(self, chunks: list[str]) -> None:
        raw = [c.encode() for c in chunks]
        sides, good = [side.encode(chunks) for side in (self.a, self.b)], np.ones(len(chunks), bool)
        for side, ids in zip((self.a, self.b), sides, strict=True):
            good &= [b"".join([side.bytes[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)]
        counts, tables = [], []
        for side, ids in zip((self.a, self.b), sides, strict=True):
            if not good.all():
                ids = [x if ok else [] for x, ok in zip(ids, good, strict=True)]
            flat = np.array(list(chain.from_iterable(ids)), np.int64)
            end = np.cumsum(side.sizes[flat])
            counts.append(np.array(list(map(len, ids)), np.int64))
            tables.append(pa.table({"i": np.arange(len(flat)), "s": end - side.sizes[flat], "e": end, "id": flat, "chunk": np.repeat(np.arange(len(ids)), counts[-1])}))
        figures, strings, pairs, at = self.aligned(*tables, counts)
        n = len(self.good)
        self.known.update(zip(chunks, range(n, n + len(chunks))))
        self.figures = np.concatenate([self.figures, figures])
        self.good = np.concatenate([self.good, good])
        self.groups = np.concatenate([self.groups, strings])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])

    def aligned(self, a: pa.Table, b: pa.Table, counts: list[np.ndarray]):
        """Figures, group strings, linked pairs and their offsets of the chunks that the intervals belong to."""
        n = len(counts[0])
        if not len(a):
            return np.zeros((n, 4), np.int64), np.full(n, "", object), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        self.db.register("a", a)
        self.db.register("b", b)
        tokens = self.db.sql(TOKENS_SQL).fetchnumpy()
        links = self.db.sql(LINKS_SQL).fetchnumpy()
        self.db.unregister("a")
        self.db.unregister("b")
        side, ids, group, chunk = (np.asarray(tokens[k]) for k in ("side", "id", "g", "chunk"))
        last = np.append(group[1:] != group[:-1], True)
        turn = np.append(side[1:] != side[:-1], True) & ~last
        text = np.where(last, self.names[";"][ids], np.where(turn, self.names["|"][ids], self.names[","][ids]))
        token_at = np.searchsorted(chunk, np.arange(n + 1)).tolist()
        strings = np.array(["".join(text[x:y].tolist())[:-1] for x, y in zip(token_at, token_at[1:])], object)
        n_links = np.bincount(links["chunk"], minlength=n)
        figures = np.stack([counts[0], counts[1], np.bincount(chunk[last], minlength=n), n_links], axis=1)
        return figures, strings, np.asarray(links["pair"], np.int64), np.concatenate([[0], np.cumsum(n_links)])

    def codes_of(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > CACHE_CHUNKS:
            self.kept(chunks)
        for start in range(0, len(new), 20_000):
            self.learn(new[start : start + 20_000])
        return np.fromiter((self.known[c] for c in chunks), np.int64, len(chunks))

    def slice_of(self, batch: pa.RecordBatch) -> dict:
        """Figures, digests and linked pairs of each document of a slice."""
        text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        n = len(text)
        nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        full = pc.if_else(pc.equal(text, nothing), nothing, pc.binary_join_element_wise(nothing, text, space))
        data, offsets = common.flat_bytes(full)
        ends = chunk_ends(data, offsets, self.split) if len(data) else np.zeros(0, np.int64)
        per_text = np.searchsorted(ends, offsets, side="right")
        starts = np.concatenate([[0], ends]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        known = self.codes_of(common.strings(coded.dictionary) if len(ends) else [])
        codes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(ends) else np.zeros(0, np.int64)
        bad = np.flatnonzero(common.segment_sum((~self.good[codes]).astype(np.int64), per_text))
        owner = np.repeat(np.arange(n), np.diff(per_text))
        if len(bad):  # as a whole these texts may still be told apart
            whole = [" " + text[int(k)].as_py() for k in bad]
            base = len(self.good)
            for w in whole:
                self.learn([w])
            keep = ~np.isin(owner, bad)
            codes, owner = np.concatenate([codes[keep], base + np.arange(len(bad))]), np.concatenate([owner[keep], bad])
            order = np.argsort(owner, kind="stable")
            codes, owner = codes[order], owner[order]
            per_text = np.searchsorted(owner, np.arange(n + 1))
        figures = common.segment_sum(self.figures[codes], per_text)
        strings, digests = self.groups[codes].tolist(), []
        for x, y in zip(per_text.tolist(), per_text[1:].tolist()):
            digests.append(hashlib.sha256(";".join(strings[x:y]).encode()).hexdigest() if y > x and strings[x] else "")
        key, times = np.unique(owner * (len(self.good) + 1) + codes, return_counts=True)
        owner, codes = key // (len(self.good) + 1), key % (len(self.good) + 1)
        size = np.diff(self.at)[codes]
        pair = self.pairs[spread(self.at[codes], size)]
        pairs, code = np.unique(pair, return_inverse=True)
        key, inverse = np.unique(np.repeat(owner, size) * max(1, len(pairs)) + code, return_inverse=True)
        total = np.bincount(inverse, np.repeat(times, size), minlength=len(key)).astype(np.int64)
        owner, code = key // max(1, len(pairs)), key % max(1, len(pairs))
        if len(bad):  # whole texts are not met again
            self.figures, self.good, self.groups = self.figures[:base], self.good[:base], self.groups[:base]
            self.at, self.pairs = self.at[: base + 1], self.pairs[: self.at[base]]
            for w in whole:
                self.known.pop(w, None)
        return {"figures": figures, "digests": digests, "offsets": np.searchsorted(owner, np.arange(n + 1)), "codes": code, "times": total, "pairs": pairs, "docs": np.bincount(code, minlength=len(pairs))}


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] places, one run after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


common.CACHES.append(aligner)


def added(left: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([left[0], pairs]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([left[1], docs])).astype(np.int64)


def aligned_slices(docs: DataFrame, path_a: str, path_b: str, most: int = common.SLICE_BYTES) -> DataFrame:
    """One row a slice of documents; partial counts of pairs stand in a partition's last row, or earlier where they are many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def row(batch, got, told) -> pa.RecordBatch:
            ids = batch.column("doc_id").to_pylist() if batch is not None else []
            whole = lambda k, kind: got[k].astype(kind).tobytes()
            values = [uuid.uuid4().hex, ids, whole("figures", "<i8"), got["digests"], whole("offsets", "<i8"), whole("codes", "<i4"), whole("times", "<i4"), got["pairs"], *((told[1], told[0]) if told else ([], []))]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=SLICES.names)

        for batch in batches:
            for part in common.slices(batch, "text", most):
                got = known.slice_of(part)
                counts = added(counts, got["pairs"], got["docs"])
                told = counts if len(counts[0]) > MOST_PAIRS // 2 else None
                if told:
                    counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield row(part, got, told)
        if len(counts[0]):
            empty = dict.fromkeys(("figures", "offsets", "codes", "times", "pairs"), np.zeros(0, np.int64)) | {"digests": []}
            yield row(None, empty, counts)

    common.ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(common.tidy(work, aligner), SLICES)


def documents_of(slice_row: dict, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """Rows of a slice's documents, given the counts of its pairs and whether each is its A id's best."""
    figures = np.frombuffer(slice_row["figures"], "<i8").reshape(-1, 4)
    offsets, codes, times = (np.frombuffer(slice_row[k], t) for k, t in (("offsets", "<i8"), ("codes", "<i4"), ("times", "<i4")))
    n_best, count_sum = (common.segment_sum(times.astype(np.int64) * x[codes], offsets) for x in (best.astype(np.int64), docs))
    columns = [pa.array(slice_row["doc_ids"], pa.int64()), *[pa.array(figures[:, k]) for k in range(4)], pa.array(n_best), pa.array(count_sum), pa.array(slice_row["digests"], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=DOCUMENTS.names)


def with_table(slices: DataFrame, counts: DataFrame) -> DataFrame:
    """Every task holds the counts of all pairs, which are few."""
    table = counts.orderBy("pair").toArrow()
    shared = slices.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["docs"].to_numpy(), table["best"].to_numpy()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                at = np.searchsorted(pair, own.column("pairs").flatten().to_numpy(zero_copy_only=False))
                yield documents_of(own.drop_columns(["pairs"]).to_pylist()[0], docs[at], best[at])

    return slices.mapInArrow(common.tidy(work), DOCUMENTS)


def with_requests(slices: DataFrame, counts: DataFrame) -> DataFrame:
    """Each slice asks for the counts of its pairs; answers come back to the slice."""
    asked = slices.select(F.col("slice").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("of", "at", "docs", "best")

    def work(own: pa.Table, got: pa.Table) -> pa.Table:
        order = np.argsort(got["at"].to_numpy())
        docs, best = (got[c].to_numpy(zero_copy_only=False)[order] for c in ("docs", "best"))
        return pa.Table.from_batches([documents_of(row, docs, best) for row in own.to_pylist()])

    return slices.drop("pairs").groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(work, DOCUMENTS)


def align(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS, most: int = common.SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "aligned")
    aligned_slices(docs, path_a, path_b, most).write.option("compression", "zstd").parquet(path)
    told = spark.read.parquet(path)
    slices = told.select("slice", "doc_ids", "figures", "digests", "offsets", "codes", "times", "pairs").filter(F.size("doc_ids") > 0)
    partial = told.select(F.explode(F.arrays_zip("of_pairs", "docs")).alias("p")).select(F.col("p.of_pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = partial.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an A id has at most as many pairs as B has ids
    top = F.max("docs").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    counts = common.stage(counts.withColumn("best", F.col("docs") == top))
    return (with_table if counts.count() <= most_pairs else with_requests)(slices, counts)
