"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its words' features: the word itself,
its byte n-grams with marked edges, and a mark for a word that repeats the word
before it.  All are hashed into one table.  A softmax layer over that mean is
learned together with the vectors by stochastic gradient descent in numpy.

Defined cases: an empty or null text scores the learned share of label 1; a
sample with one class, or none, scores that share; ties in the sample go by id
hash, then id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words as W

BUCKETS = 1 << 17
DIM = 8
SIZES = (2, 3, 4)
#: Features of a word take many times its bytes, so slices are shorter here.
SLICE_BYTES = 2 << 20
EDGE_BUCKET = BUCKETS  # the mark of a repeated word


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    owner, bucket = W.byte_ngrams(words, SIZES, BUCKETS)
    whole = W.whole_words(words, BUCKETS)
    return np.concatenate([owner, np.arange(len(words))]), np.concatenate([bucket, whole])


def repeats(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """1 where a word equals the one before it in the same text."""
    same = np.zeros(len(codes), np.float64)
    same[1:] = codes[1:] == codes[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    same[firsts] = 0
    return same


class Model:
    def __init__(self, value: np.ndarray, prior: float, base: float):
        self.value = value  # logit share of each bucket: vectors folded with the output layer
        self.prior = prior
        self.base = base

    def scores(self, text: pa.Array) -> np.ndarray:
        offsets, codes, words = common.split_words(text)
        count = np.diff(offsets)
        if not len(words):
            return np.full(len(text), self.prior)
        owner, bucket = features(words)
        size = np.bincount(owner, minlength=len(words))
        word = np.bincount(owner, self.value[bucket], minlength=len(words))
        again = repeats(offsets, codes)
        total = common.segment_sum(word[codes] + again * size[codes] * self.value[EDGE_BUCKET], offsets)
        mass = common.segment_sum((1 + again) * size[codes], offsets)
        logit = np.clip(self.base + total / np.maximum(mass, 1), -40, 40)
        return np.where(count > 0, 1 / (1 + np.exp(-logit)), self.prior)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    offsets, codes, words = common.split_words(pa.array([text], pa.string()))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    owner, bucket = features(words)
    often = np.bincount(codes, minlength=len(words)).astype(np.float64)
    size = np.bincount(owner, minlength=len(words))
    again = float((repeats(offsets, codes) * size[codes]).sum())
    bucket = np.append(bucket, EDGE_BUCKET)
    weight = np.append(often[owner], again)
    found, inverse = np.unique(bucket, return_inverse=True)
    mass = np.bincount(inverse, weight)
    return found.astype(np.int32), (mass / mass.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 8.0, seed: int = 3) -> Model:
    y = np.array(labels, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS + 1, DIM), np.float32) - 0.5) / DIM
    output = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS + 1), prior, float(np.log(prior / (1 - prior))))
    found = [document_features(t) for t in texts]
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))  # both classes weigh the same while learning
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)):
            ids, share = found[i]
            if not len(ids):
                continue
            mean = share @ vectors[ids]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= step * min(weight[y[i]], 4.0) * 0.1
            back = output @ p
            output -= np.outer(mean, p)
            bias -= p * 0.1
            vectors[ids] -= np.outer(share / max(share.max(), 1e-6) * 0.2, back).astype(np.float32)
    margin = vectors.astype(np.float64) @ (output[:, 1] - output[:, 0])
    return Model(margin, prior, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", per_class: int = 1200, most_bytes: int = 16 << 20) -> Model:
    """Learn from at most ``per_class`` rows of each label and ``most_bytes`` of text in all."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select("doc_id", label)
    model = train(*common.texts_of(docs, common.bounded_sample(rows, label, per_class), label, most_bytes))
    common.give_back()
    return model


def score(docs: DataFrame, model, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with score and predicted."""
    schema = common.schema_of(docs, score=T.DoubleType(), predicted=T.IntegerType())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(common.text_of(batch))
        out = {f.name: c for f, c in zip(batch.schema, batch.columns, strict=True)} | {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}
        return pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], names=schema.fieldNames())

    return common.map_slices(docs, work, schema, most=SLICE_BYTES)
