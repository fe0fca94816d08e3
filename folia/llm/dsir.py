"""Importance resampling of documents towards a target distribution.

Documents and target texts are compared by hashed features, all runs of one and two consecutive words. A
bucket's gain says how much likelier it is in the target than in the documents; a document's weight is the
mean gain of its features, and with Gumbel noise added to the weights the highest scores are a sample drawn
without replacement, with chances in proportion to the exponentials of the weights.

Features are made by Arrow kernels over slices of a few MB: lower case, split, flatten, dictionary; shifted
indices of the dictionary form pairs, only different words and pairs are hashed, and their gains are taken
and summed by document.

Null and empty texts have no features and weight 0. Equal scores are drawn by the smaller doc_id, null last;
rows of one doc_id and score take their ranks in any order. A null doc_id is hashed as an empty one. Empty
tables give no rows, an empty target has no features, T = 0. Extra columns are passed over.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.arrow import map_batches
from folia.llm.shared import written
from folia.operators.numbering import number

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Text whose words and pairs are told apart at once.
SLICE = 8 << 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[pa.Array]:
    """`texts` in runs of at most `limit` bytes, or of one text."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.slice(a, b - a)
        a = b


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, text of each feature)."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_GAPS)
    flat, text = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    flat, text = flat.filter(real), text.filter(real).to_numpy()
    coded = flat.dictionary_encode()
    idx = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = [zlib.crc32(w) for w in words]
    before = [zlib.crc32(b" ", c) for c in crc]

    inside = text[1:] == text[:-1]
    pairs = pa.array((idx[:-1] * len(words) + idx[1:])[inside]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), max(1, len(words)))
    paired = [zlib.crc32(words[j], before[i]) for i, j in zip(left.tolist(), right.tolist())]

    one = np.array(crc, np.int64)[idx] % BUCKETS
    two = np.array(paired, np.int64)[pairs.indices.to_numpy(zero_copy_only=False)] % BUCKETS
    return np.bincount(text, minlength=len(texts)), np.concatenate([one, two]), np.concatenate([text, text[1:][inside]])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in slices(b.column(0)):
                total += np.bincount(features(part)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    # at most BUCKETS rows
    for r in rows.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in the documents."""
    n_own, n_target = float(own.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * n_own) / (float(s + 1) * n_target))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[], [], []]
        for part in slices(b.column("text")):
            words, bucket, text = features(part)
            total = np.zeros(len(part), np.int64)
            order = np.argsort(text, kind="stable")
            begin = np.searchsorted(text[order], np.flatnonzero(words))
            if len(begin):
                total[words > 0] = np.add.reduceat(gain[bucket[order]], begin)
            n = words + np.maximum(words - 1, 0)
            for c, v in zip(cols, (words, n, np.where(n > 0, total // np.maximum(n, 1), 0))):
                c.append(v)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.concatenate(c), pa.int64()) for c in cols)], ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    Of the documents with at least `least_words` words, `percent` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weights(docs, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "dsir-scores")
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    placed = number(able.withColumn("_all", F.lit(0)), "_all", [F.desc("score"), F.asc_nulls_last("doc_id")], "rank", "long")
    ranked = placed.withColumn("rank", F.when(F.col("rank") < n, F.col("rank") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))
