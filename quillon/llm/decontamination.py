"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words, lower-cased, letters and digits only.
A text holds an item of m words if some stretch of it is within ``rate * m``
word edits of the item.

1. Item-sized windows.  An item with at most k edits keeps a run of
   m / (k + 1) words, so each occurrence shares an n-gram of up to three words
   with the item; windows of m words start where such a shared n-gram places
   the item's start.
2. CGK embedding.  A random walk copies words of the window: at each step a
   random function of (step, word) decides whether the walk moves on.  Two
   sequences at a small edit distance fall into step again, so that edits
   become differing places of the copies.
3. Bit sampling.  Each repetition has a walk of its own and compares a few
   sampled places by hash.  The number of repetitions is fixed for each class
   of item lengths, on simulated edits, so that the target recall is reached.
4. Exact check.  Windows that agree in some repetition are verified by
   bit-parallel edit distance over the stretch around them.
5. Classes out of reach.  Where MOST_REPEATS repetitions do not reach the
   target, as with long items, no window is left to chance: neighbouring ones
   are joined and verified, but for those with fewer shared n-grams than the
   allowed edits must leave.

Whole texts are worked, without a shuffle.  Items go out in blocks of bounded
size; each block is one pass.

Defined cases: null and empty texts hold nothing; items without words match
nothing; items of fewer than 1 / rate words match exactly only; repeated items
each match; repeated rows match alike; a null id is kept as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

U64 = np.uint64
ITEM_BLOCK = 4000
SAMPLES = 3
MOST_REPEATS = 64
TRIALS = 400
#: Words from which a class out of reach ends the fitting.
LONG = 64
SALT = U64(0x9E3779B97F4A7C15)
MARK = U64((1 << 20) - 1)


def word_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text and the 64-bit ids of its normalised words."""
    offsets, codes, words = common.split_words(text)
    bare = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]+", "").dictionary_encode()
    ids = common.hash_words(common.strings(bare.dictionary), 3)
    if len(bare.dictionary):
        blank = pc.equal(pc.binary_length(bare.dictionary), 0).to_numpy(zero_copy_only=False)
        ids = np.where(blank, U64(0), ids | U64(1))
    full = (ids[bare.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, U64))[codes]
    kept = full != 0
    return np.concatenate([[0], np.cumsum(kept)])[offsets], full[kept]


def ngrams(ids: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(len(ids) - n + 1, 0), U64)
    for k in range(n):
        total = total * SALT + ids[k : len(ids) - n + 1 + k]
    return common.mix(total + U64(n))


def walk_keys(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, m: np.ndarray, repeats: int) -> np.ndarray:
    """Sampled-place keys, one row a repetition, of windows start..start + m that end at ``stop`` at the latest."""
    n = len(start)
    keys = np.zeros((repeats, n), U64)
    ids = np.append(ids, U64(0))
    rep = np.arange(repeats)
    draws = common.mix((rep[:, None] * SAMPLES + np.arange(SAMPLES)).astype(U64) * SALT + U64(77))
    places = ((draws >> U64(11)).astype(np.float64) / 2.0**53)[:, :, None] * (2.0 * m)[None, None, :]
    places = places.astype(np.int64)
    pointer = np.zeros((repeats, n), np.int64)
    end = np.minimum(stop - start, m)
    length = int(2 * m.max(initial=0))
    salt = np.arange(1, max(length, SAMPLES) + 1).astype(U64) * SALT
    own = common.mix(rep.astype(U64) + U64(5))[:, None]
    for step in range(length):
        word = np.where(pointer < end, ids[np.minimum(start + pointer, len(ids) - 1)], U64(0))
        for s in range(SAMPLES):
            at = places[:, s] == step
            keys[at] += common.mix(word[at] + salt[s])
        coin = common.mix(word + salt[step : step + 1] + own)
        pointer += (coin >> U64(63)).astype(np.int64)
    return common.mix(keys + rep.astype(U64)[:, None])


def infix_edits(item: list[int], words: list[int]) -> int:
    """Fewest word edits between ``item`` and any stretch of ``words`` (bit-parallel)."""
    m = len(item)
    place: dict[int, int] = {}
    for i, w in enumerate(item):
        place[w] = place.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in words:
        same = place.get(w, 0)
        cross = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (full & ~(cross | up)), up & cross
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(cross | plus)), plus & cross
        best = min(best, score)
    return best


class Index:
    """Word n-grams and LSH keys of a block of items."""

    def __init__(self, item_ids: list[int], texts: list[str], rate: float = 0.2, recall: float = 0.98, seed: int = 5):
        at, ids = word_ids(pa.array(texts, pa.string()))
        own = [i for i in range(len(texts)) if at[i + 1] > at[i]]
        self.item_ids = [item_ids[i] for i in own]
        self.words = [ids[at[i] : at[i + 1]] for i in own]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = (self.size * rate + 1e-9).astype(np.int64)
        self.run = np.minimum(3, np.maximum(1, self.size // (self.edits + 1)))
        self.lists = [w.tolist() for w in self.words]
        self.grams, self.marks = {}, {}
        for n in np.unique(self.run):
            found = [(g, i, o) for i in np.flatnonzero(self.run == n) for o, g in enumerate(ngrams(self.words[i], int(n)).tolist())]
            gram = np.array([x[0] for x in found], U64)
            order = np.argsort(gram, kind="stable")
            self.marks[int(n)] = np.zeros(int(MARK) + 1, bool)
            self.marks[int(n)][gram & MARK] = True
            self.grams[int(n)] = (gram[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order])
        self.repeats, self.tables = np.zeros(len(self.words), np.int64), {}
        rng = np.random.default_rng(seed)
        band = np.floor(4 * np.log2(self.size)).astype(np.int64)
        for b in np.unique(band):
            own = np.flatnonzero(band == b)
            self.repeats[own] = self.fit_repeats(own, recall, rng)
            if not self.repeats[own[0]] and self.size[own].min() >= LONG:
                break  # longer ones would need more repetitions still
        for r in np.unique(self.repeats[self.repeats > 0]):
            own = np.flatnonzero(self.repeats == r)
            flat, first = np.concatenate([self.words[i] for i in own]), np.concatenate([[0], np.cumsum(self.size[own])]).astype(np.int64)
            keys = walk_keys(flat, first[:-1], first[1:], self.size[own], int(r))
            owner = np.broadcast_to(own, keys.shape).reshape(-1)
            order = np.argsort(keys.reshape(-1), kind="stable")
            self.tables[int(r)] = keys.reshape(-1)[order], owner[order]

    def fit_repeats(self, own: np.ndarray, recall: float, rng: np.random.Generator) -> int:
        """Fewest repetitions that reach ``recall`` on the items ``own`` with as many random edits as are allowed; 0 if none do."""
        pairs, m = [], []
        for i in np.resize(rng.permutation(own), TRIALS):
            other = self.words[i].tolist()
            for _ in range(self.edits[i]):
                p, kind = int(rng.integers(max(len(other), 1))), rng.integers(3)
                other[p : p + (kind != 1)] = [int(rng.integers(1 << 62))] if kind != 2 else []
            pairs += [self.words[i], np.array(other, U64)]
            m += [self.size[i]] * 2
        first = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int64)
        keys = walk_keys(np.concatenate(pairs), first[:-1], first[1:], np.array(m, np.int64), MOST_REPEATS)
        reached = np.cumsum(keys[:, ::2] == keys[:, 1::2], axis=0).astype(bool).mean(axis=1)
        enough = np.flatnonzero(reached >= recall)
        return int(enough[0]) + 1 if len(enough) else 0

    def windows(self, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows (text, item, start, place) where the n-gram at a place of an item starts it in a text."""
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        rows = []
        for n, (gram, item, offset) in self.grams.items():
            own = ngrams(ids, n)
            hit = np.flatnonzero(self.marks[n][own & MARK])  # a few false ones pass
            hit = hit[owner[hit] == owner[hit + n - 1]]
            low, high = (np.searchsorted(gram, own[hit], side=side) for side in ("left", "right"))
            many = high - low
            where = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(hit) else np.zeros(0, np.int64)
            pos = np.repeat(hit, many)
            rows.append(np.stack([owner[pos], item[where], pos - offset[where], offset[where]], axis=1))
        found = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
        return found[np.lexsort(found.T[::-1])]

    def stretches(self, found: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first start, last start) of runs of windows with as many shared n-grams as a copy must have.

        The starts that one copy's n-grams place differ by no more than its
        edits; an edit takes at most n of the item's n-grams.
        """
        if not len(found):
            return []
        text, item, start, place = found.T
        run = np.concatenate([[0], np.cumsum((text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.edits[item[1:]]))])
        both = np.unique(np.stack([run, place], axis=1), axis=0)
        first, last = np.flatnonzero(np.diff(run, prepend=-1)), np.flatnonzero(np.diff(run, append=run[-1] + 1))
        k = item[first]
        need = np.maximum(1, self.size[k] - self.run[k] + 1 - self.run[k] * self.edits[k])
        kept = np.bincount(both[:, 0], minlength=len(first)) >= need
        return list(zip(*(x[kept].tolist() for x in (text[first], k, start[first], start[last])), strict=True))

    def matches(self, text: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, fewest edits) of every item that a text holds."""
        if not self.words:
            return []
        offsets, ids = word_ids(text)
        found = self.windows(offsets, ids)
        best: dict[tuple[int, int], int] = {}

        def verify(t: int, k: int, first: int, last: int) -> None:
            if best.get((t, k)) == 0:
                return
            e = int(self.edits[k])
            d = infix_edits(self.lists[k], ids[max(offsets[t], first - e) : max(offsets[t], min(offsets[t + 1], last + self.size[k] + e))].tolist())
            if d <= e:
                best[t, k] = min(d, best.get((t, k), d))

        repeats = self.repeats[found[:, 1]]
        for stretch in self.stretches(found[repeats == 0]):
            verify(*stretch)
        for r, (table, key_items) in self.tables.items():
            own = found[repeats == r][:, :3]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]).any(axis=1)
            owner, item, start = own[new].T
            for i in range(0, len(owner), 1 << 14):
                o, m = owner[i : i + (1 << 14)], self.size[item[i : i + (1 << 14)]]
                s = np.maximum(start[i : i + (1 << 14)], offsets[o])
                keys = walk_keys(ids, s, offsets[o + 1], m, r)
                low, high = (np.searchsorted(table, keys.reshape(-1), side=side) for side in ("left", "right"))
                many = high - low
                some = np.flatnonzero(many)
                where = np.repeat(low[some], many[some]) + np.concatenate([np.arange(c) for c in many[some]] or [np.zeros(0, np.int64)]).astype(np.int64)
                window = np.repeat(some % len(o), many[some])
                pairs = {(int(o[w]), int(k), int(s[w])) for w, k in zip(window, key_items[where], strict=True)}
                for t, k, at in sorted(pairs):
                    verify(t, k, at, at)
        return [(t, k, d) for (t, k), d in sorted(best.items())]


def item_blocks(items: DataFrame, rate: float, recall: float):
    """Indexes over blocks of at most ITEM_BLOCK items."""
    n = items.count()
    blocks = max(1, -(-n // ITEM_BLOCK))
    for b in range(blocks):
        part = items.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        table = part.orderBy("item_id", "text").toArrow()
        if table.num_rows:
            yield Index(table["item_id"].to_pylist(), pc.fill_null(table["text"], "").to_pylist(), rate, recall)


def find(docs: DataFrame, items: DataFrame, rate: float = 0.2, recall: float = 0.98) -> DataFrame:
    """doc_id, item_id and edits of every benchmark item that a document holds."""
    schema = "doc_id long, item_id long, edits int"

    def worker(index: Index):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = index.matches(common.text_of(batch))
            if not found:
                return None
            t, k, d = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(t)), pa.array([index.item_ids[i] for i in k], pa.int64()), pa.array(d, pa.int32())], names=["doc_id", "item_id", "edits"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in item_blocks(items, rate, recall):
        part = common.map_slices(rows, worker(index), T._parse_datatype_string(schema))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def remove(docs: DataFrame, items: DataFrame, rate: float = 0.2, recall: float = 0.98) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; no shuffle."""

    def worker(index: Index):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bad = np.zeros(batch.num_rows, bool)
            bad[[t for t, _, _ in index.matches(common.text_of(batch))]] = True
            return batch.filter(pa.array(~bad))

        return work

    for index in item_blocks(items, rate, recall):
        docs = common.map_slices(docs, worker(index), docs.schema)
    return docs
