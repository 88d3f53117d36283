"""Queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary_tokens, collocations, decontamination, jaccard, langid, linededup, mixing, neighbours, quality, tokencount, topk, toxicity
from .common import read_table, remainder

TOKENIZER_FILE = "word_bpe_49k.json"
PIECES_FILE = "piece_bpe_32k.model"
BYTES_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(by: int, value: int):
    return F.coalesce(remainder("doc_id", by) == value, F.lit(False)).alias("held_out")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), (5, 2, 1))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and edits of every benchmark item within a fifth of its words in word edits."""
    return decontamination.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON c.i = q.i AND c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs, docs.filter(remainder("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two edits: doc_id, n_lines, n_links and dropped line numbers."""
    return linededup.copies(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECES_FILE))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return jaccard.classes_of(docs, 3, 90, 100).withColumnRenamed("n_grams", "n_shingles")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM g AS x JOIN g AS y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM met JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * s >= 90 * (p.n + q.n - s)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other
)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(remainder("doc_id", 4) != 2))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2), "score", "predicted")


def op10_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_tokens.encode_and_read(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTES_FILE), tokenizer_path(PIECES_FILE))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents
), p AS (SELECT lang, unnest(regexp_extract_all(s, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM w, range(1, 6) AS r(m) WHERE len(w) >= m
), f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cut AS (
  SELECT c.lang, c.m, c.phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest FROM c, range(1, 5) AS r(k) WHERE k < m
), part AS (
  SELECT cut.*, x.f AS l, y.f AS r FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = first JOIN f AS y ON y.lang = cut.lang AND y.phrase = rest
), scored AS (
  SELECT part.lang, phrase, a, l, r, n, k, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM part JOIN n USING (lang)
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, first AS phrase FROM part WHERE m > 2 AND k = m - 1 AND 100 * a >= 100 * l
  UNION SELECT lang, rest FROM part WHERE m > 2 AND k = 1 AND 100 * a >= 100 * r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


QUERIES = (op1_mixing, op2_toxicity, op3_decontamination, op4_topk, op5_language_id, op6_line_dedup, op7_token_counts, op8_ngram_jaccard, op9_quality, op10_binary_tokens, op11_alignment, op12_collocations, op13_neighbours)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op8_ngram_jaccard": OP8_SQL, "op12_collocations": OP12_SQL}
