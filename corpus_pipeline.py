"""From raw documents to token ids: five stages, each over all that the one before has kept.

1. quality: documents that the classifier rejects go (score below 0.3).
2. near_duplicates: one document of each class of similar documents stays.
3. decontamination: documents contaminated by the benchmark go.
4. secrets: spans of secrets are replaced by a mark in the text; no document goes.
5. tokens: the texts' byte-level BPE ids, with digests of the ids and of the decoded bytes.

Stages 1 to 4 return the columns of documents, and any others, whatever their names. A null or empty text
passes stages 2 to 4 as it is and has no ids; stage 1 judges it by the classifier's bias. Repeated rows of one
doc_id stay together: with equal texts stages 2 to 5 treat them alike. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folia.llm import bpe, decontaminate, jaccard, quality, secrets
from folia.llm.shared import written
from folia.sources.tables import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, public_tokenizers.path(RANKS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: The classifier and the join's pruning have no counterpart in SQL; tests hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
