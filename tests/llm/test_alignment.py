"""Token alignment against whole-text encoding and all pairs of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from quillon.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, slice string, pairs long"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "a", " a", "  a  b ", "Hello, world!\nNext line.\n\nTwo  spaces\t\ttabs \r\n end", "it's we'll I'VE don't", "x▁y", "plain ▁ mark", "<s> </s> <unk> <0x0A> <|endoftext|>", "1234567 3.14 a1b2",
    "naïve café Ünïcode ß × ÷", "日本語 テキスト。中文", "emoji 😀👍🏽 end", "nb sp em　id\u0085x", "a\x00b \x1c \x1f c", "ﬁ Å ½ ² x².", "word" * 300, " \n \n a\n\n\nb \n c", "…—“q” a.b,c;d:e!f?g", "́e é, x",
]


def tokens_of(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
    raw = ([bytes(letters[c] for c in a.id_to_token(i)) if a.id_to_token(i) != "<|endoftext|>" else b"<|endoftext|>" for i in ids[0]], [])
    for i in ids[1]:
        p = b.id_to_piece(i)
        raw[1].append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    return ids, raw


def expected(rows):
    told, held = [], Counter()
    for doc_id, text in rows:
        ids, raw = tokens_of(text) if text else (([], []), ([], []))
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            told.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans = []
        for k in (0, 1):
            at, own = 0, []
            for i, r in zip(ids[k], raw[k]):
                own.append((at, at + len(r), i))
                at += len(r)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        group, start = [], 0
        for cut in cuts:
            group.append("|".join(",".join(str(t[2]) for t in own if start < t[1] <= cut) for own in spans))
            start = cut
        held.update(set(links))
        told.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), links, hashlib.sha256(";".join(group).encode()).hexdigest()))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(((d, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for d, na, nb, ng, links, sha in told), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def texts(n, seed=1):
    draw = random.Random(seed)
    parts = ["the", "tion", "Word", "x1", "naïve", "été", "größe", "don't", "(a)", "3.5", "\n", "\n\n", "  ", ",", ".", "!", "日本", "\t", "ing", "über"]
    return ["".join(draw.choice(parts) + draw.choice(["", " ", " ", "\n"]) for _ in range(draw.randrange(60))) for _ in range(n)]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (3, "a"), (None, "a b"), (99, "Hello, world!")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    want = expected(rows)
    assert rows_of(alignment.align(docs, A, B)) == want
    assert next(r for r in want if r[0] == 8)[1:] == (0, 0, 0, 0, 0, 0, "")  # a mark that turns into a space


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_counts_over_slices(spark, most_pairs):
    rows = list(enumerate(texts(120)))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(3)
    assert rows_of(alignment.align(docs, A, B, most_pairs, most=2_000)) == expected(rows)


def test_full_memory_forgets_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 40)
    known, fresh = alignment.Aligner(A, B), None
    for part in range(6):
        batch = pa.record_batch([pa.array(texts(15, seed=part))], names=["text"])
        fresh = alignment.Aligner(A, B)
        got, want = known.slice_of(batch), fresh.slice_of(batch)
        assert got["digests"] == want["digests"] and (got["figures"] == want["figures"]).all() and (got["pairs"] == want["pairs"]).all() and (got["times"] == want["times"]).all()


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
