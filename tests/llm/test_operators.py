"""The ten operators against brute force on small tables."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import binary_tokens, common, decontamination, jaccard, langid, linededup, mixing, quality, tokencount, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


# --- 1 --------------------------------------------------------------------------
def test_mixing_plan_is_near_the_target():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = sorted(rng.choice(60, rng.integers(1, 12), replace=False).tolist())
        counts = rng.integers(1, 6, len(sizes)).tolist()
        total = sum(s * c for s, c in zip(sizes, counts))
        target = rng.random() * 3 * total
        copies, extra = mixing.plan_source(sizes, counts, target)
        got = total * copies + sum(s * e for s, e in zip(sizes, extra))
        assert all(0 <= e <= c for e, c in zip(extra, counts)) and target - max(sizes) <= got <= target + 1


def test_fill_is_best_by_enumeration():
    sizes, spare = [9, 7, 4], [2, 1, 3]
    for budget in range(1, 40):
        best = max(t for t in (sum(s * n for s, n in zip(sizes, c)) for c in itertools.product(range(3), range(2), range(4))) if t <= budget)
        assert sum(s * n for s, n in zip(sizes, mixing.fill(budget, sizes, spare))) == best


def test_mixing_rows(spark):
    docs = corpus(spark, ["a b", None, "", "x " * 10, "y " * 10, "y " * 10], ["b", "b", "a", None, "a", "a"])
    first = mixing.mix(docs).orderBy("doc_id").collect()
    assert [r["size"] for r in first] == [2, 0, 0, 10, 10, 10] and first == mixing.mix(docs).orderBy("doc_id").collect()
    want = {r["doc_id"]: r["target"] for r in first}
    # weights 5, 2, 1 for a, b and null; b is held at three times its 2 words
    assert want[0] == 6 and want[4] == pytest.approx(26 * 5 / 6) and want[3] == pytest.approx(26 / 6)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in first)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- 2, 9 -----------------------------------------------------------------------
def test_toxicity_learns_and_leaves_group_mentions(spark):
    rng = np.random.default_rng(2)
    bad = ["zornig", "blöder", "garstig"]
    texts = [prose(rng, 30) + (f" {bad[i % 3]} " + prose(rng, 5) if i % 2 else " the muslim women spoke") for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    score = model.scores(pa.array([prose(rng, 30) + " garstig", prose(rng, 30) + " christian men", "", prose(rng, 200)]))
    assert score[0] >= 0.7 and (score[1:] < 0.7).all() and ((score >= 0) & (score <= 1)).all()
    docs = corpus(spark, [prose(rng, 20) + " zornig", prose(rng, 20), None, ""])
    assert [r["doc_id"] for r in toxicity.remove(docs, model).orderBy("doc_id").collect()] == [1, 2, 3]
    pair = toxicity.counterfactuals(["Two women left. Rain."])
    assert ("Two women left", "Two woman left") in pair


def test_long_text_leaves_its_class_in_the_sample(spark):
    docs = corpus(spark, ["é" * 5000, "b" * 5000, *["c d"] * 6])
    chosen = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, label int")
    texts, labels = common.texts_of(docs, chosen, "label", 2000)
    assert sorted(labels) == [0] * 4 + [1] * 4 and sorted(set(texts)) == ["b" * 62, "c d", "é" * 62]


def test_quality_learns(spark):
    rng = np.random.default_rng(3)
    good = [prose(rng, 40) for _ in range(100)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choice(WORDS, 40)) for _ in range(50)] + [" ".join(f"{w} {w} {w}" for w in rng.choice(WORDS, 12)) for _ in range(50)]
    model = quality.train(good[:80] + junk[:40] + junk[50:90], [1] * 80 + [0] * 80)
    held = model.scores(pa.array(good[80:] + junk[40:50] + junk[90:]))
    assert (held[:20] >= 0.7).all() and (held[20:] < 0.7).all()
    out = quality.score(corpus(spark, ["", None, good[0]]), model).collect()
    assert len({out[0]["score"], out[1]["score"]}) == 1 and out[2]["predicted"] == 1
    assert quality.train([], []).scores(pa.array(["x"]))[0] == pytest.approx(0.5)


# --- 3 --------------------------------------------------------------------------
def test_decontamination(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary, 30)) for _ in range(6)]
    edited = items[1].split()
    edited[5:6] = []
    edited[12] = "other"
    edited.insert(20, "more")
    noise = [" ".join(rng.choice(vocabulary, 80)) for _ in range(4)]
    docs = corpus(spark, [noise[0] + " " + items[0].upper().replace(" ", ",\n") + " " + noise[1], noise[2] + " " + " ".join(edited) + " " + noise[3], noise[2], None, "", " ".join(items[2].split()[:10])])
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.find(docs, bench).collect()}
    assert found == {(0, 0): 0, (1, 1): 3}
    assert [r["doc_id"] for r in decontamination.remove(docs, bench).orderBy("doc_id").collect()] == [2, 3, 4, 5]
    assert decontamination.find(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_long_edited_items():
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    sizes = [20, 60, 150] + [300, 400, 700] * 8
    items = [rng.choice(vocabulary, n).tolist() for n in sizes]
    texts, want = [], {}
    for i, words in enumerate(items):
        edited = list(words)
        for k in range(len(words) // 5):
            p = int(rng.integers(len(edited)))
            edited[p : p + (k % 3 != 1)] = [f"z{k}"] if k % 3 < 2 else []
        texts.append(" ".join([*rng.choice(vocabulary, 50), *edited, *rng.choice(vocabulary, 50)]))
        want[i, i] = decontamination.infix_edits(words, texts[-1].split())
    index = decontamination.Index(list(range(len(items))), [" ".join(w) for w in items])
    found = {(t, index.item_ids[k]): d for t, k, d in index.matches(pa.array(texts))}
    assert found == want


def test_infix_edits():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, w = rng.integers(0, 4, rng.integers(1, 9)).tolist(), rng.integers(0, 4, rng.integers(0, 15)).tolist()
        row = [0] * (len(w) + 1)
        for i, c in enumerate(a, 1):
            new = [i]
            for j, z in enumerate(w, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != z)))
            row = new
        assert decontamination.infix_edits(a, w) == min(row)


# --- 4 --------------------------------------------------------------------------
def test_topk(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 8) / 4.0], 0) for i in range(90)]
    rows += [(200, None, 0), (220, [float("nan")] * 8, 0), (240, [None] + [1.0] * 7, 0), (5, rows[5][1], 0), (260, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if v and None not in v and not np.isnan(v).any() and len(v) == 8]
    for q, x in ok:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:20]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert 200 not in got and 220 not in got and 260 not in got


# --- 5 --------------------------------------------------------------------------
def test_language_model(spark):
    texts = ["the cat and the dog", "der hund und die katze", "the house and the tree", "das haus und der baum"] * 3
    model = langid.Model(texts, ["en", "de"] * 6)
    docs = corpus(spark, ["the dog", "der baum", None, "12 34 !!", "", "THE TREE."])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(docs, langid.Model([], [])).filter("lang_pred <> 'und'").count() == 0


def test_code_lengths_by_definition():
    texts = ["abab abc", "bca"]
    model = langid.Model(texts, ["x", "x"])
    counts: dict[bytes, Counter] = {}
    for word in "abab abc bca".split():
        wide = b"\x01" + word.encode() + b"\x02"
        for p in range(1, len(wide)):
            for o in range(0, min(langid.ORDER, p) + 1):
                counts.setdefault((o, wide[p - o : p]), Counter())[wide[p]] += 1

    def cost(word):
        bits, wide = 0.0, b"\x01" + word.encode() + b"\x02"
        for p in range(1, len(wide)):
            for o in range(min(langid.ORDER, p), -1, -1):
                seen = counts.get((o, wide[p - o : p]))
                if seen and seen[wide[p]]:
                    bits -= np.log2(seen[wide[p]] / (seen.total() + len(seen)))
                    break
                bits -= np.log2(len(seen) / (seen.total() + len(seen))) if seen else 0
            else:
                bits += 8
        return bits

    words = ["abab", "bb", "zq", "abcabc", "é"]
    assert model.word_costs(pa.array(words))[:, 0] == pytest.approx([cost(w) for w in words])


# --- 6 --------------------------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_classes(texts, tau=2, share=8):
    """(doc, line number, class's first (doc, line number)) of every line, by definition."""
    rows = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    distinct = list(dict.fromkeys(x for _, _, x in rows))
    root = dict(zip(distinct, distinct))
    for x, y in itertools.combinations(distinct, 2):
        m = min(len(x), len(y))
        if abs(len(x) - len(y)) <= tau <= m and edits(x, y) <= min(tau, m // share):
            root = {k: root[x] if r == root[y] else r for k, r in root.items()}
    first = {}
    for d, i, x in rows:
        first.setdefault(root[x], (d, i))
    return [(d, i, first[root[x]]) for d, i, x in rows]


def near_lines(rng):
    lines = []
    for _ in range(40):
        base = list(rng.choice(list("abcé 😀"), rng.integers(3, 40)))
        lines.append("".join(base))
        for _ in range(rng.integers(0, 5)):
            p = rng.integers(len(base))
            base[p : p + rng.integers(0, 2)] = list(rng.choice(list("abcé😁"), rng.integers(0, 2)))
            lines.append("".join(base) or "x")
    template = "the same long opening of a line that many share, then a number "
    return lines + [template + str(k) for k in rng.integers(100_000, 10_000_000, 60)]  # one segment in common, mostly far apart


def test_line_classes_against_all_pairs(spark):
    lines = near_lines(np.random.default_rng(7))
    texts = ["\n".join(lines[i : i + 10]) for i in range(0, len(lines), 10)] + [None, "", "short\nshort\n\n\n" + lines[0], " \n", "y" * 20_000 + "\n" + "z" * 5, "y" * 20_001]
    docs = corpus(spark, texts)
    want = {}
    for d, i, first in line_classes(texts):
        if (d, i) != first:
            want.setdefault(d, []).append((i, first[0]))
    got = {r["doc_id"]: r for r in linededup.copies(docs).collect()}
    assert {d: list(zip(r["dropped"], r["copied_from"])) for d, r in got.items() if r["dropped"]} == want
    assert [r["n_lines"] for _, r in sorted(got.items())] == [sum(x.strip(" ") != "" for x in (t or "").split("\n")) for t in texts]
    assert sum(map(len, want.values())) > 30 and want[len(texts) - 1] == [(0, len(texts) - 2)]


def test_line_dedup_keeps_what_has_no_copy(spark):
    rows = [(7, "first line here\nsecond line is different", "x"), (7, "first line here\nanother one of its own", "x"), (7, "first line here\nanother one of its own", "x"), (None, "first line here", "x"), (8, None, "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    got = linededup.clean(docs)
    assert got.columns == docs.columns
    left = sorted((r["text"] for r in got.collect()), key=str)
    # the null id comes first; rows equal in id and text count as one
    assert left == sorted([None, "", "first line here", "second line is different", "another one of its own", "another one of its own"], key=str)
    assert linededup.clean(docs.limit(0)).count() == linededup.copies(docs.limit(0)).count() == 0


def test_line_check_looks_characters_up(spark):
    pairs = spark.createDataFrame([(1, 2, "kitten", "sitting", 6, 7), (3, 4, "abcdefgh", "abcdefgh", 8, 8)], "a long, b long, short string, long string, m int, n int")
    found = linededup.band_distance(pairs, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan and "regexp" not in plan  # they were laid out before
    assert {r["a"]: r["edits"] for r in found.collect()} == {1: 3, 3: 0}


# --- 7 --------------------------------------------------------------------------
def test_trie_counts():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bab", "c", "abab"]
    counter = tokencount.Counter(pieces)
    words = ["".join(w) for n in range(0, 6) for w in itertools.product("abz", repeat=n)] + ["é", "b" * 300]
    assert counter.counts(words).tolist() == [counter.alone(w) for w in words]
    assert counter.alone("é") == 1 + 2  # the mark, and two bytes


# --- 8 --------------------------------------------------------------------------
def components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) * den >= len(a | b) * num:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 4, 5)])
def test_jaccard_join_against_all_pairs(spark, n, num, den):
    rng = np.random.default_rng(8)
    texts = ["", None, "one", "One", "two words", " \n "]
    for size in (12, 40, 120):
        base = [f"v{i}" for i in rng.integers(0, 5000, size)]
        for _ in range(14):  # variants about the threshold, some linked through others alone
            own = list(base)
            for _ in range(rng.integers(0, 4 + size // 40)):
                own[rng.integers(len(own))] = f"x{rng.integers(10_000)}"
            texts.append(" ".join(own))
    texts += [texts[-1], texts[10].upper()]
    docs = corpus(spark, texts)
    got = {r["doc_id"]: (r["n_grams"], r["component_id"]) for r in jaccard.classes_of(docs, n, num, den).collect()}
    want = dict(enumerate(components(texts, n, num, den)))
    assert got == want
    if n == 5:
        kept = [r["doc_id"] for r in jaccard.keep_one(docs.unionByName(docs.filter("doc_id = 6")), n, num, den).collect()]
        assert sorted(kept) == [i for i, (_, r) in want.items() if i == r]


# --- 10 -------------------------------------------------------------------------
@pytest.mark.parametrize("bits", [1, 7, 16, 17, 33])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 500, dtype=np.uint64)
    data = binary_tokens.pack(ids, bits)
    assert (binary_tokens.unpack(data, bits, 0, 500) == ids).all() and (binary_tokens.unpack(data, bits, 99, 321) == ids[99:321]).all()
    assert len(data) <= 500 * bits / 8 + 8 * bits


def test_token_blocks(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Hello, World! it's 12\x01 x", None, "", "á Ünïcode's <|endoftext|> end", "<|ENDOFTEXT|> İI \x01", "same same SAME.", "\x1c  odd"]
    docs = corpus(spark, texts).repartition(3)
    out = binary_tokens.write(docs, str(tmp_path / "blocks"), path)
    got = {r["doc_id"]: r for r in binary_tokens.read(spark, out).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        assert binary_tokens.read_document(spark, out, i).tolist() == ids
        start += len(ids)


# --- shared ----------------------------------------------------------------------
def test_split_words_and_components(spark):
    offsets, codes, words = common.split_words(pa.array([" a  b\n", "", "\t", "b\x0bc"]))
    assert offsets.tolist() == [0, 2, 2, 2, 4] and [words.to_pylist()[c] for c in codes] == ["a", "b", "b", "c"]
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3)] + [(i, i + 1) for i in range(20, 40)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(links).collect()}
    assert {k: v for k, v in got.items() if k < 10} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and {got[i] for i in range(20, 41)} == {20}
