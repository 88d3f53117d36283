"""Toxicity classifier with counterfactual regularisation.

A document's features are the whole words and byte n-grams (edges marked) that
it holds, kept where a bounded labelled sample ties them to label 1.  Logistic
regression over them carries one more term: identity terms in labelled
sentences are swapped for others of their group, and the squared change of the
score is penalised, so that a neutral mention of a group does not raise a score.
As the score is linear in the features, the change of a swap is the weights
times the difference of the two sentences' features.  Every sentence of the sample with
a term is swapped with every other term of its group, and so is the term alone.

Defined cases: a null or empty text scores the model's base rate; one class or
no labelled row gives that share to all texts; repeated rows score alike.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words as W
from .langid import normal_words
from .quality import SLICE_BYTES
from .quality import score as apply_model

BUCKETS = 1 << 20
SIZES = (4, 5, 6)
MOST_FEATURES = 4096

# Neutral words for groups of people; terms of one line may stand for each other.
IDENTITY_GROUPS = [
    "woman women man men girl girls boy boys mother father",
    "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists catholic",
    "black white asian african european american latino arab",
    "gay lesbian straight bisexual transgender",
    "old young elderly disabled deaf blind",
    "german germans french spanish mexican chinese turkish polish immigrant immigrants refugee refugees",
    "frau frauen mann männer mädchen junge",
    "christen muslime juden ausländer flüchtlinge",
    "femme femmes homme hommes fille garçon",
    "chrétiens musulmans juifs étrangers réfugiés",
    "mujer mujeres hombre hombres niña niño",
    "cristianos musulmanes judíos extranjeros refugiados",
]
PARTNERS = {term: [t for t in group.split() if t != term] for group in IDENTITY_GROUPS for term in group.split()}
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    owner, bucket = W.byte_ngrams(words, SIZES, BUCKETS)
    return np.concatenate([owner, np.arange(len(words))]), np.concatenate([bucket, W.whole_words(words, BUCKETS, 7)])


def text_buckets(text: pa.Array, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs of a slice without repeats; only buckets marked in ``live``, if given."""
    offsets, codes, words = common.split_words(text)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = normal_words(words).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[codes]
    owner, bucket = features(words)
    if live is not None:
        owner, bucket = owner[live[bucket]], bucket[live[bucket]]
    has = np.bincount(owner, minlength=len(words))
    at = np.concatenate([[0], np.cumsum(has)])
    bucket = bucket[np.argsort(owner, kind="stable")]
    texts = np.repeat(np.arange(len(text)), np.diff(offsets))
    some = has[codes] > 0
    pair = common.unique(texts[some] * len(words) + codes[some])
    texts, codes = pair // len(words), pair % len(words)
    size = has[codes]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    pair = common.unique(np.repeat(texts, size) * BUCKETS + bucket[np.repeat(at[codes], size) + inside])
    return pair // BUCKETS, pair % BUCKETS


def buckets_of(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct feature buckets of each text, worked out in bounded slices."""
    if not texts:
        return
    for part in common.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), most=1 << 18):
        owner, bucket = text_buckets(part.column(0))
        yield from np.split(bucket, np.searchsorted(owner, np.arange(1, part.num_rows)))


ANY_TERM = re.compile(r"(?i)\b(?:" + "|".join(sorted(PARTNERS, key=len, reverse=True)) + r")\b")


def counterfactuals(texts: list[str]) -> Iterator[tuple[str, str]]:
    """Sentences of the sample with an identity term, and the same with every other term of its group."""
    for text in texts:
        if not ANY_TERM.search(text):
            continue
        for sentence in SENTENCE.findall(text):
            for word in WORD.findall(sentence.lower()):
                for other in PARTNERS.get(word, []):
                    yield sentence, re.sub(rf"(?i)\b{re.escape(word)}\b", other, sentence)


class Model:
    """weight: one number for each bucket, 0 for all but the chosen features."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, text: pa.Array) -> np.ndarray:
        owner, bucket = text_buckets(text, self.weight != 0)
        logit = self.bias + np.bincount(owner, self.weight[bucket], minlength=len(text))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(texts: list[str], labels: list[int], penalty: float = 1.0, sparse: float = 2e-4, rounds: int = 300) -> Model:
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    held = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for ids, label in zip(buckets_of(texts), labels, strict=True):
        held[label][ids] += 1
    rate = [(h + 0.5) / (n + 1) for h, n in zip(held, np.bincount(y.astype(int), minlength=2), strict=True)]
    # chosen: the strongest signed root of the likelihood ratio among features of label 1
    both = (held[0] + held[1] + 1) / (len(y) + 2)
    ratio = held[1] * np.log(rate[1] / both) + held[0] * np.log(rate[0] / both)
    ratio[(rate[1] < 3 * rate[0]) | (held[1] < 3)] = 0
    keep = np.argsort(-ratio, kind="stable")[:MOST_FEATURES]
    keep = np.sort(keep[ratio[keep] > 9.0])
    column = np.full(BUCKETS, -1)
    column[keep] = np.arange(len(keep))

    def rows(own: list[str]) -> np.ndarray:
        x = np.zeros((len(own), len(keep)), np.float32)
        for i, ids in enumerate(buckets_of(own)):
            x[i, column[ids][column[ids] >= 0]] = 1
        return x

    x = rows(texts)
    change = np.zeros((0, len(keep)), np.float32)
    swaps = itertools.chain(counterfactuals(texts), ((term, other) for term, partners in PARTNERS.items() for other in partners))
    for some in iter(lambda: list(itertools.islice(swaps, 1000)), []):  # equal changes count once
        change = np.unique(np.concatenate([change, rows([b for _, b in some]) - rows([a for a, _ in some])]), axis=0)
    w, b = np.zeros(len(keep)), float(np.log(y.mean() / (1 - y.mean())))
    seen_w = np.full(len(keep), 1e-8)
    seen_b = 1e-8
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):  # proximal gradient with a step for each weight
        small = w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip((x @ small).astype(np.float64) + b, -40, 40)))
        error = (p - y) * balance / len(y)
        slope = x.T @ error.astype(np.float32) + penalty * 2 * (change.T @ (change @ small)) / max(1, len(change))
        seen_w += slope**2
        seen_b += error.sum() ** 2
        step = 0.3 / np.sqrt(seen_w)
        w = w - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        b -= 0.3 / np.sqrt(seen_b) * error.sum()
    weight = np.zeros(BUCKETS)
    weight[keep] = w
    return Model(weight, b)


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", per_class: int = 1500, most_bytes: int = 12 << 20) -> Model:
    """Learn from at most ``per_class`` rows of each label and ``most_bytes`` of text in all."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select("doc_id", label)
    model = train(*common.texts_of(docs, common.bounded_sample(rows, label, per_class), label, most_bytes))
    common.give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    return apply_model(docs, model, threshold)


def remove(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score at or over ``threshold``, in one pass and without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(common.text_of(batch)) < threshold))

    return common.map_slices(docs, work, docs.schema, most=SLICE_BYTES)
