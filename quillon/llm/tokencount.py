"""Token counts of a unigram segmentation, shared over a trie of pre-tokens.

A text's pre-tokens are its words between ASCII white space, each with the
word-start mark before it.  A slice's distinct pre-tokens form a trie.  The forward score
of a node is the best log-probability of any segmentation of its prefix into
vocabulary pieces, so pre-tokens with a common beginning share the work; the
token count of that best path is stored with it, and the count at a
pre-token's last node is the pre-token's count.  The trie is worked level by
level, all nodes of a level together.

Piece probabilities follow a Zipf law on the rank of the piece in the vocabulary
file, log p = -log(rank + 2), ranks from 0 among normal pieces.  A character
outside the vocabulary costs one token for each of its UTF-8 bytes, each at the
least log p less ten.

Defined cases: null and blank texts have 0 tokens; equal scores go to the path
with the longer last piece; a pre-token of more than ``LONG`` characters is
segmented by itself, alike; repeated rows count alike.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

U64 = np.uint64
MARK = "▁"
LONG = 256
BASE = U64(0x100000001B3)
SPOTS = U64((1 << 20) - 1)


def read_vocabulary(path: str) -> list[str]:
    """Normal pieces of a sentencepiece file in rank order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64), np.concatenate([[0], np.cumsum(size)])


def utf8_size(char: np.ndarray) -> np.ndarray:
    return 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)


class Counter:
    def __init__(self, pieces: list[str]):
        self.rank = {p: i for i, p in reversed(list(enumerate(pieces)))}
        self.longest = max(map(len, pieces), default=1)
        self.byte = -np.log(len(pieces) + 2) - 10.0
        self.tables = {}
        for n in range(1, self.longest + 1):
            own = sorted({p for p in pieces if len(p) == n})
            if not own:
                continue
            chars, _ = codepoints(own)
            chars = chars.reshape(-1, n)
            key = np.zeros(len(own), U64)
            for k in range(n):
                key = key * BASE + chars[:, k] + U64(1)
            order = np.argsort(key)
            spots = np.zeros(int(SPOTS) + 1, bool)
            spots[common.mix(key) & SPOTS] = True
            self.tables[n] = (key[order], -np.log(np.array([self.rank[p] for p in own]) + 2.0)[order], spots)
        powers = np.ones(self.longest + 1, U64)
        for n in range(1, self.longest + 1):
            powers[n : n + 1] = powers[n - 1 : n] * BASE
        self.powers = powers

    def alone(self, word: str) -> int:
        """The same rule for one long pre-token, without a trie."""
        text = MARK + word
        best, count = [0.0], [0]
        for j in range(1, len(text) + 1):
            top = best[j - 1] + self.byte * len(text[j - 1].encode("utf-8", "surrogatepass"))
            tokens = count[j - 1] + len(text[j - 1].encode("utf-8", "surrogatepass"))
            if text[j - 1] in self.rank:
                top, tokens = best[j - 1] - np.log(self.rank[text[j - 1]] + 2.0), count[j - 1] + 1
            for n in range(2, min(self.longest, j) + 1):
                rank = self.rank.get(text[j - n : j])
                if rank is not None and best[j - n] - np.log(rank + 2.0) >= top:
                    top, tokens = best[j - n] - np.log(rank + 2.0), count[j - n] + 1
            best.append(top)
            count.append(tokens)
        return count[-1]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > LONG):
            out[i] = self.alone(words[i])
        short = np.flatnonzero(size <= LONG)
        chars, at = codepoints([MARK + words[i] for i in short])
        length = np.diff(at)
        # level 0 is the root; a node has its parent, prefix hash, best score and tokens
        parent, prefix, best, tokens = np.zeros(1, np.int64), np.zeros(1, U64), np.zeros(1), np.zeros(1, np.int64)
        parents, prefixes, bests, token_counts = [parent], [prefix], [best], [tokens]
        node = np.zeros(len(short), np.int64)
        live = np.arange(len(short))
        for depth in range(1, int(length.max(initial=0)) + 1):
            live = live[length[live] >= depth]
            edge = (node[live].astype(U64) << U64(21)) | chars[at[live] + depth - 1]
            kinds, place = np.unique(edge, return_inverse=True)
            parent = (kinds >> U64(21)).astype(np.int64)
            char = kinds & U64((1 << 21) - 1)
            prefix = prefixes[-1][parent] * BASE + char + U64(1)
            ancestor = parent
            top = bests[-1][parent] + self.byte * utf8_size(char)
            tokens = token_counts[-1][parent] + utf8_size(char)
            known_one = np.zeros(len(kinds), bool)
            for n in range(1, min(self.longest, depth) + 1):
                level = depth - n
                if n > 1:
                    ancestor = parents[level + 1][ancestor]
                if n not in self.tables:
                    continue
                keys, score, spots = self.tables[n]
                piece = prefix - prefixes[level][ancestor] * self.powers[n]
                maybe = np.flatnonzero(spots[common.mix(piece) & SPOTS])
                found = np.minimum(np.searchsorted(keys, piece[maybe]), len(keys) - 1)
                hit = keys[found] == piece[maybe]
                maybe, found = maybe[hit], found[hit]
                value = bests[level][ancestor[maybe]] + score[found]
                better = np.ones(len(maybe), bool) if n == 1 else value >= top[maybe]
                chosen = maybe[better]
                top[chosen] = value[better]
                tokens[chosen] = token_counts[level][ancestor[chosen]] + 1
                known_one[chosen] = True
            parents.append(parent)
            prefixes.append(prefix)
            bests.append(top)
            token_counts.append(tokens)
            node[live] = place
            done = live[length[live] == depth]
            out[short[done]] = tokens[node[done]]
        return out


@cache
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(read_vocabulary(path))


common.CACHES.append(counter)


def count(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, codes, words = common.split_words(common.text_of(batch))
        own = counter(vocabulary_path).counts(words.to_pylist()) if len(words) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(common.segment_sum(own[codes], offsets))], names=["doc_id", "n_words", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return common.map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema, keep=counter)
