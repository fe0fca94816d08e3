"""Quality classifier: hashed word n-gram logistic regression, learnt with follow-the-regularised-leader.

Tokens are runs of word bytes and runs of other visible bytes. Features are the hashed single tokens and
pairs of neighbours, and a mark for each token that repeats the one before it; a text's feature vector is
its counts over their Euclidean norm, a sparse vector of 2^BITS places. Learning goes over all labelled rows
outside the held-out fold, dealt by doc_id into parts of about PART rows, SHARDS at least, that each learn on
their own in Spark tasks; the model is the mean of theirs, summed in blocks of places. Scoring is one sparse
dot product for each row.

Nulls count as empty texts; an empty text has the bias alone. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folia.llm import textkit as tk
from folia.llm.arrow import free, held_out, labelled_ids, map_batches, trainable

BITS = 18
#: Parts at least, labelled rows of one (on average), and places of vectors that are learnt from at once: a part of more learns in several models.
SHARDS, PART, PLACES = 4, 4_000, 1 << 22
#: Places of a model that are summed at once, and bytes of text whose features are found at once.
BLOCK, PIECE = 1 << 12, 1 << 19
PASSES = 3
FOLD = (5, 0)
THRESHOLD = 0.3

_KIND = np.where(tk.SPACE, 0, np.where(tk.WORD, 1, 2)).astype(np.int8)
_KIND[:32] = 0


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, and where each row's begin."""
    s, e, row = tk.runs(_KIND[buf], offs)
    rows, m = len(offs) - 1, len(s)
    h = tk.span_hash(tk.prefix_hash(buf), s, e)
    one = h >> tk.U(64 - bits)
    near = np.zeros(m, bool)
    near[1:] = row[1:] == row[:-1]
    pair = np.zeros(m, tk.U)
    pair[1:] = tk.mix(h[1:] * tk.U(3) + (h[:-1] ^ tk.U(0x5851F42D4C957F2D))) >> tk.U(64 - bits)
    again = near.copy()
    again[1:] &= h[1:] == h[:-1]
    idx = np.concatenate([one, pair[near], np.full(int(again.sum()), 1, tk.U)]).astype(np.int64)
    of = np.concatenate([row, row[near], row[again]])
    order = np.argsort(of, kind="stable")
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(of, minlength=rows), out=begin[1:])
    return idx[order], begin


def vectors(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each row's vector."""
    idx, begin = features(buf, offs)
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
        at, n = np.unique(idx[a:z], return_counts=True)
        yield at, n / (np.sqrt(float((n * n).sum())) or 1.0)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES, alpha: float = 1.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate rates; the last weight is the bias."""
    n = np.zeros(1 << BITS | 1)
    z = np.zeros(1 << BITS | 1)
    weight = lambda at: np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))
    for _ in range(passes):
        for at, x, y in rows:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-float(w @ x))) - y) * x
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weight(np.arange(len(z)))


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Models of the rows of each part, in blocks. Rows: part, doc_id, y (of a label, else null), text (else null), a label before its texts."""
    part = label = None
    made, size, own = 0, 0, []

    def model() -> pa.RecordBatch:
        w = learn(own).astype("<f4")
        blocks = [w[i : i + BLOCK].tobytes() for i in range(0, len(w), BLOCK)]
        k = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array([part] * k, pa.int64()), pa.array([made] * k, pa.int64()), pa.array([len(own)] * k, pa.int64()), pa.array(blocks, pa.binary())], ["block", "part", "model", "n", "w"])

    for b in batches:
        parts, ids, ys = (b.column(i).to_pylist() for i in range(3))
        for a, _, buf, offs in tk.pieces(b.column(3), PIECE):
            for i, (at, x) in enumerate(vectors(buf, offs), a):
                if own and (parts[i] != part or size >= PLACES):
                    yield model()
                    made, size, own = made + 1, 0, []
                part = parts[i]
                if ys[i] is not None:
                    label = ids[i], ys[i]
                elif label and label[0] == ids[i]:
                    own.append((at.astype(np.int32), x.astype(np.float32), label[1]))
                    size += len(at)
    if own:
        yield model()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block over all models, weighted by their rows."""
    block, n, total = None, 0, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "n", "w"])
    for b in batches:
        for k, m, w in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))):
            if k != block:
                if total is not None:
                    yield row()
                block, n, total = k, 0, 0.0
            n, total = n + m, total + np.frombuffer(w, "<f4").astype(float) * m
    if total is not None:
        yield row()


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The mean of the models of all parts of the labelled rows; without any all weights are 0."""
    chosen = labelled_ids(labels, "quality", FOLD)
    parts = max(SHARDS, -(-chosen.count() // PART))
    key = F.col("doc_id").cast("long").alias("doc_id")
    at = F.pmod(F.xxhash64(F.lit(7), key), F.lit(parts)).alias("part")
    texts = docs.where(trainable(FOLD)).select(at, key, F.lit(None).cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    # labels and texts meet in their part: neither side is sent to all executors, and texts are shuffled once
    dealt = texts.union(chosen.select(at, key, "y", F.lit(None).cast("string").alias("text"))).repartition("part")
    models = dealt.sortWithinPartitions("part", F.xxhash64("doc_id"), "doc_id", F.col("y").isNull(), "text").mapInArrow(_models, "block long, part long, model long, n long, w binary")
    summed = models.repartition("block").sortWithinPartitions("block", "part", "model").mapInArrow(_sums, "block long, n long, w binary")
    got = sorted(summed.collect())  # 65 rows of fixed size
    return np.concatenate([np.frombuffer(r["w"]) / r["n"] for r in got]) if got else np.zeros(1 << BITS | 1)


def score(docs: DataFrame, weights: np.ndarray, out: str = "score") -> DataFrame:
    """`docs` with a column `out`, 0 to 1, replaced if there."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # of fixed size
    docs = docs.drop(out)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        w, got = sent.value, []
        for _, _, buf, offs in tk.pieces(b.column("text"), PIECE):
            got += [float(w[at] @ x) for at, x in vectors(buf, offs)]
        p = 1 / (1 + np.exp(-(np.array(got) + float(w[-1]))))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, out])

    return map_batches(docs, kernel, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    own = free(docs, "_quality")
    return score(docs, train(docs, labels), own).where(F.col(own) >= THRESHOLD).drop(own)
