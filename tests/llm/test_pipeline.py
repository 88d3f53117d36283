"""The pipeline stage by stage against brute force, queries against their SQL, held-out accuracy on the tables."""

import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import mixing, queries

DATA = "/root/testdata"
VOCABULARY = ["".join(s) for s in itertools.product(("ba", "do", "ki", "lu", "me", "no", "ra", "su"), repeat=3)]
TOXIC = ["grumvile", "hatchspit", "scornful"]


def prose(rng, n):
    return rng.choice(VOCABULARY, n).tolist()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark with planted toxic texts, near copies, and edited items."""
    rng = np.random.default_rng(21)
    items = [" ".join(prose(rng, 30)) for _ in range(3)]
    texts = [" ".join(prose(rng, 25) + ([TOXIC[i % 3]] * 2 if i % 3 == 0 else [])) for i in range(120)]
    base = prose(rng, 120)
    for edits in (0, 0, 1, 2, 3, 9, 40):  # up to two places lie within 0.8
        own = list(base)
        for _ in range(edits):
            own[rng.integers(len(own))] = f"x{rng.integers(10_000)}"
        texts.append(" ".join(own))
    for edits in (0, 3, 6, 12):
        own = items[1].split()
        for at in rng.choice(30, edits, replace=False):
            own[at] = f"y{rng.integers(10_000)}"
        texts.append(" ".join(prose(rng, 15) + own + prose(rng, 15)))
    texts += ["", None, "one two", "one two", "long " + " ".join(prose(rng, 3000))]
    rows = [(i, t, "en", ["b", "a", "c", "b", None][i % 5], len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, tables):
    """(rows into, rows out of) each stage."""
    docs, found = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tables}/out-{name}"
        stage(spark, docs, tables).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "binary_tokens":
            assert out.columns == docs.columns
        found[name] = [[tuple(r) for r in t.collect()] for t in (docs, out)]
        docs = out
    return found


def in_order(rows):
    return sorted(rows, key=repr)


def test_toxicity_stage(steps):
    before, after = steps["toxicity"]
    assert in_order(after) == in_order(r for r in before if not any(w in (r[1] or "") for w in TOXIC))


def test_join_stage(steps):
    before, after = steps["ngram_jaccard"]
    before, gone = sorted(before), set()
    sets = []
    for r in before:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(before)))
    for i, j in itertools.combinations(range(len(before)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    gone = {i for i, r in enumerate(root) if r != i}
    assert len(gone) >= 4 and in_order(after) == in_order(r for i, r in enumerate(before) if i not in gone)


def fewest_edits(item, words):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        last, row = row, [0]
        for i, x in enumerate(item):
            row.append(min(last[i] + (x != w), last[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def test_decontamination_stage(spark, tables, steps):
    before, after = steps["decontamination"]
    items = [r["text"].split() for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    clean = [r for r in before if all(fewest_edits(x, (r[1] or "").split()) > len(x) // 5 for x in items)]
    assert len(before) - len(clean) == 3 and in_order(after) == in_order(clean)


def test_mixing_stage(steps):
    before, after = steps["mixing"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        total[r[3]] += size(r)
        largest[r[3]] = max(largest[r[3]], size(r))
    times = Counter(after)
    for r, k in times.items():
        taken[r[3]] += k * size(r)
    assert set(times) <= set(before) and all(k <= (mixing.MOST if size(r) else 1) for r, k in times.items())
    assert all(times[r] == 1 for r in before if not size(r))
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = dict(zip(sources, itertools.cycle((5, 2, 1))))
    target, held = {}, set()
    while True:  # what is above a cap is dealt again among the others
        rest = sum(total.values()) - sum(target[s] for s in held)
        for s in set(sources) - held:
            target[s] = rest * weight[s] / sum(weight[x] for x in set(sources) - held)
        over = {s for s in set(sources) - held if target[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3 * total[s] for s in over}
        held |= over
    assert all(target[s] - largest[s] <= taken[s] <= target[s] + 1 for s in sources)


def test_token_stage(steps):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.tokenizer_path())
    before, after = steps["binary_tokens"]
    want, start = [], 0
    for r in sorted(before, key=lambda r: (r[0], r[1] or "")):
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(after) == sorted(want)


def test_run_is_its_stages(spark, tables, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect())) == sorted(steps["binary_tokens"][1])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    rel = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, f"{DATA}/sf0.001").select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name,label,right", [("op2_toxicity", "toxic", 0.95), ("op9_quality", "quality", 0.95), ("op5_language_id", "lang", 0.98)])
def test_held_out_accuracy(spark, name, label, right):
    folder = f"{DATA}/sf0.01"
    known = spark.read.parquet(f"{folder}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label)
    out = queries.queries()[name](spark, folder).filter("held_out").join(known, "doc_id").filter(f"{label} is not null").collect()
    hits = [r[label] == r["lang_pred" if label == "lang" else "predicted"] for r in out]
    assert len(hits) > 80 and sum(hits) / len(hits) >= right
    if label == "toxic":  # clean rows are left alone
        assert not any(r["predicted"] for r in out if not r["toxic"])


CLASHES = ("score", "predicted", "node", "times", "rows", "row", "drop", "edits")


@pytest.mark.parametrize("filled", [False, True])
def test_pipeline_edges(spark, tmp_path, filled):
    plain = [(1, None, None), (2, "", "a"), (3, " \n ", "a"), (None, "a b c d e f", "a"), (5, "a b c d e f", "a"), (5, "a b c d e f", "a"), (6, "q r s t", None)]
    labels = [(None, None, None), (5, 1, None), (6, 1, 0)]
    items = [(None, None), (1, ""), (2, " "), (3, "zz yy xx ww vv uu")]
    docs = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in plain if filled], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels if filled else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items if filled else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = in_order(r["doc_id"] for r in out.collect())
        once = name != "toxicity"  # of repeated rows one stays
        assert rows == in_order(r[0] for i, r in enumerate(plain) if filled and not (once and i == 5))
        docs = out
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {1, 2, 3} <= {r["doc_id"] for r in got} if filled else not got
