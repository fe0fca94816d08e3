"""The queries of this subpackage, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folia.llm import bpe, decontaminate, dsir, fingerprints, html_text, jaccard, katz, merkle, oracles, quality, repeats, secrets, token_counts, toxicity
from folia.sources.tables import table

RANKS = "byte_bpe_multi_50k.tiktoken"
UNIGRAMS = "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count(table(spark, d, "documents"), public_tokenizers.path(UNIGRAMS))


def op3_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"), public_tokenizers.path(RANKS))


def op6_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(table(spark, d, "documents"))


def op7_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.report(table(spark, d, "documents"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, d, "documents"))


def op10_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(table(spark, d, "pages"))


def op11_katz(spark: SparkSession, d: str) -> DataFrame:
    return katz.score(table(spark, d, "documents"))


def op12_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return dsir.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.manifest(table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_token_counts, op3_bpe, op4_decontamination, op5_secrets, op6_ngram_jaccard_join, op7_repeats, op8_toxicity, op9_fingerprints, op10_html_text, op11_katz, op12_importance_resampling, op13_merkle_manifest, pipeline)
    return {f.__name__: f for f in found}


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

#: Whole windows compared as text, without fingerprints.
OP4 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
span AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="text")} AS w FROM documents),
size AS (SELECT DISTINCT n FROM span),
part AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT r, i, part.n, item FROM part JOIN span ON part.win = span.win AND part.n = span.n),
word AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
who AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN who USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4, "op12_importance_resampling": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
