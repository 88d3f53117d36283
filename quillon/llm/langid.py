"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts, up to ``ORDER`` bytes within a word,
with the counts of a bounded labelled sample.  A byte costs -log2 of its PPM-C
probability in the longest seen context; a context that lacks it charges its
escape probability and hands on to the next shorter one, down to a uniform
byte.  Statistics are frozen: scoring never changes them, so a word's cost
does not depend on its place, and each distinct word is costed once.

A text's language is the one of the shortest total code; its score is that
language's share under equal priors.

Defined cases: null text, or text without letters, is ``und`` with score 0;
words are lower-cased and stripped of ASCII marks at their ends; equal costs go
to the first language by name; without any labelled row all texts are ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 4
START, END = 1, 2
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
U64 = np.uint64


def normal_words(words: pa.Array) -> pa.Array:
    return pc.ascii_trim(pc.utf8_lower(words), MARKS)


def symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, symbol, depth) of every byte and end mark; depth: symbols before it, the start mark included.

    An empty word has no symbols.
    """
    data, offsets = common.flat_bytes(words)
    size = np.diff(offsets)
    length = np.where(size > 0, size + 2, 0)
    at = np.concatenate([[0], np.cumsum(length)])
    wide = np.full(at[-1], END, np.uint8)
    full = size > 0
    wide[at[:-1][full]] = START
    wide[np.repeat(at[:-1] + 1 - offsets[:-1], size) + np.arange(len(data))] = data
    owner = np.repeat(np.arange(len(size)), length)
    return owner, wide, np.arange(at[-1]) - np.repeat(at[:-1], length)


def contexts(wide: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each place as one number, tagged with the order."""
    key = np.full(len(wide), (order + 1) << 56, U64)
    for k in range(1, order + 1):
        shifted = np.zeros(len(wide), U64)
        shifted[k:] = wide[: len(wide) - k]
        key |= shifted << U64(8 * k)
    return key


class Model:
    """Costs by (context, byte) and by escaping context, for all languages together."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        n = len(self.langs)
        pairs, weights = [[] for _ in range(n)], [[] for _ in range(n)]
        for k, lang in enumerate(self.langs):
            text = pa.array([t for t, own in zip(texts, langs, strict=True) if own == lang], pa.string())
            _, codes, words = common.split_words(text)
            owner, wide, depth = symbols(normal_words(words))
            often = np.bincount(codes, minlength=len(words)).astype(np.float64)[owner]
            for order in range(ORDER + 1):
                ok = depth >= max(order, 1)
                pairs[k].append(contexts(wide, order)[ok] | wide[ok])
                weights[k].append(often[ok])
        joined = [np.unique(np.concatenate(p), return_inverse=True) for p in pairs] if n else []
        self.pair = np.unique(np.concatenate([u for u, _ in joined])) if n else np.zeros(0, U64)
        counts = np.zeros((len(self.pair), n))
        for k, (seen, inverse) in enumerate(joined):
            counts[np.searchsorted(self.pair, seen), k] = np.bincount(inverse, np.concatenate(weights[k]))
        owner_context = self.pair & ~U64(0xFF)
        self.context, group = np.unique(owner_context, return_inverse=True)
        total = np.zeros((len(self.context), n))
        kinds = np.zeros((len(self.context), n))
        for k in range(n):
            total[:, k] = np.bincount(group, counts[:, k], minlength=len(self.context))
            kinds[:, k] = np.bincount(group, counts[:, k] > 0, minlength=len(self.context))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(counts / (total + kinds)[group])
        # lower orders first: a pair that a language lacks escapes to the pair one order shorter
        order = (self.pair >> U64(56)).astype(np.int64) - 1
        self.cost = np.where(counts > 0, own, np.inf)
        for o in range(ORDER + 1):
            rows = np.flatnonzero(order == o)
            if o:
                keep = U64((1 << (8 * o)) - 1)
                shorter = (self.pair[rows] & keep) | U64(o << 56)
                lower = self.cost[np.searchsorted(self.pair, shorter)]
            else:
                lower = np.full((len(rows), n), 8.0)
            missing = counts[rows] == 0
            self.cost[rows] = np.where(missing, self.escape[group[rows]] + lower, self.cost[rows])

    def word_costs(self, words: pa.Array) -> np.ndarray:
        """Code length in bits of each word under each language."""
        n = len(self.langs)
        owner, wide, depth = symbols(normal_words(words))
        bits = np.zeros((len(words), n))
        open_ = np.flatnonzero(depth > 0)
        for order in range(ORDER, -1, -1):
            if not len(open_):
                break
            able = open_[depth[open_] >= max(order, 1)]
            rest = open_[depth[open_] < max(order, 1)]
            key = contexts(wide, order)[able]
            pair = key | wide[able]
            place = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            hit = self.pair[place] == pair
            miss = np.flatnonzero(~hit)
            near = np.minimum(np.searchsorted(self.context, key[miss]), len(self.context) - 1)
            seen = self.context[near] == key[miss]
            for k in range(n):
                bits[:, k] += np.bincount(owner[able[hit]], self.cost[place[hit], k], minlength=len(words))
                bits[:, k] += np.bincount(owner[able[miss[seen]]], self.escape[near[seen], k], minlength=len(words))
            open_ = np.concatenate([rest, able[miss]])
        bits += np.bincount(owner[open_], minlength=len(words))[:, None] * 8.0
        return bits


def fit(docs: DataFrame, labelled: DataFrame, per_language: int = 400, most_bytes: int = 12 << 20) -> Model:
    """Learn from at most ``per_language`` rows of each language and ``most_bytes`` of text in all."""
    chosen = common.bounded_sample(labelled.filter(F.col("lang").isNotNull()).select("doc_id", "lang"), "lang", per_language)
    model = Model(*common.texts_of(docs, chosen, "lang", most_bytes))
    common.give_back()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but those of the same names, with lang_pred and score."""
    names = pa.array([*model.langs, "und"], pa.string())
    schema = common.schema_of(docs, lang_pred=T.StringType(), score=T.DoubleType())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, codes, words = common.split_words(common.text_of(batch))
        n, k = batch.num_rows, len(model.langs)
        best, score = np.full(n, k), np.zeros(n)
        if k and len(words):
            cost = model.word_costs(words)
            total = np.stack([common.segment_sum(cost[codes, j], offsets) for j in range(k)], axis=1)
            letter = pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False)
            some = common.segment_sum(letter[codes].astype(np.int64), offsets) > 0
            best = np.where(some, total.argmin(axis=1), k)
            share = 1.0 / np.exp2(np.maximum(total.min(axis=1)[:, None] - total, -1000.0)).sum(axis=1)
            score = np.where(some, share, 0.0)
        out = {f.name: c for f, c in zip(batch.schema, batch.columns, strict=True)} | {"lang_pred": names.take(pa.array(best)), "score": pa.array(score)}
        return pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], names=schema.fieldNames())

    return common.map_slices(docs, work, schema)
