"""A training-corpus pipeline of five stages.

Each stage takes the documents that the one before kept; its result is written
as Parquet and read again as the next one's documents.  All but the last return
the columns of documents.

1. toxicity: documents that score 0.7 or more go; the model learns from labels.
2. ngram_jaccard: of documents of five-word shingles at 0.8 or more, one stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: sources are taken to their target weights; a document that the mix
   takes k times, 0 to 3, is written k times.
5. binary_tokens: ids in bit-packed blocks, one row a document read back from them.

Defined cases: null, empty and blank texts are clean, without copies, and stay once;
of repeated rows with words one stays; of a group of copies the smallest doc_id
stays, and every row with a null doc_id; further columns are carried through the first four stages under any name; an
empty table of documents, labels or benchmark gives empty results or drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import binary_tokens, decontamination, jaccard, mixing, toxicity
from quillon.llm.common import read_table
from quillon.llm.queries import tokenizer_path

#: Not SQL: a learned model, a seeded choice and a tokenizer are among the stages.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs, (5, 2, 1))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return binary_tokens.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("binary_tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written under the shared checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = binary_tokens.fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
