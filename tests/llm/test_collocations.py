"""Phrase collocations against a count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, n long"


def expected(rows, least, most, covered=100):
    f = defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        usual = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in usual.items():
            if any(len(q) > len(p) and within(p, q) and 100 * c >= covered * a for q, c in usual.items()):
                continue
            score, _, l, r = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (lang, t) in enumerate(rows)], SCHEMA)


def texts(seed, n):
    draw = random.Random(seed)
    words = ["The", "of", "new", "york", "city", "état", "a", "b", "é x", "New", "hall", "X"]
    return ["".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "; "]) for _ in range(draw.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize(("least", "most", "covered"), [(3, 2000, 100), (8, 10, 100), (3, 50, 60)])
def test_all_phrases(spark, least, most, covered):
    rows = [(("en", "fr", None, "und")[i % 4], t) for i, t in enumerate(texts(5, 60))] + [("en", "new york city hall of the state")] * 40 + [(None, None), ("fr", ""), ("de", " ,. "), ("xx", "one two one two")]
    got = sorted(tuple(r) for r in collocations.mine(table(spark, rows).repartition(3), least, most, covered=covered).collect())
    assert got == expected(rows, least, most, covered) and got


def test_false_hits_of_the_filter_change_nothing(spark, monkeypatch):
    rows = [("en", t) for t in texts(9, 40)]
    want = expected(rows, 4, 100)
    monkeypatch.setattr(collocations, "filter_of", lambda frequent: np.full(collocations.FILTER_BITS // 64, (1 << 64) - 1, np.uint64))
    assert sorted(tuple(r) for r in collocations.mine(table(spark, rows), 4, 100).collect()) == want


def test_hot_piece_and_products_beyond_64_bits(spark):
    parts = spark.createDataFrame([("en", "a b", 3_000_000_000_000), ("en", "a c", 5_000_000_000), ("en", "d", 7_000_000_000_000)], collocations.PARTS)

    def work(lang, own):
        yield own.names, np.bincount(own.codes, own.times, minlength=len(own.names)).astype(np.int64)

    got = {r["phrase"]: r["f"] for r in collocations.in_buckets(collocations.counts_of(parts, work), 100, totals=True).filter("phrase is not null").collect()}
    assert got == {"a": 3_005_000_000_000, "b": 3_000_000_000_000, "c": 5_000_000_000, "d": 7_000_000_000_000}
    rows = [("en", "a b c d")] * 200_000
    docs = spark.range(200_000).selectExpr("id as doc_id", "'a b c d' as text", "'en' as lang")
    got = [tuple(r) for r in collocations.mine(docs).collect()]
    assert got == [("en", 1, "a b c d", len(rows), len(rows), len(rows), 4 * len(rows), 4000)]


def test_nothing_frequent(spark):
    assert collocations.mine(table(spark, [("en", "a b")])).count() == 0 == collocations.mine(table(spark, [("en", "a b")]).limit(0)).count()
