"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles. Two sketches merge by
keeping the k smallest of both, so sketches of parts give the sketch of the whole; they estimate
resemblance, containment and the number of distinct shingles. As text a sketch is base64 of its sorted
hashes, six bytes each; equal texts have equal sketches.

Nulls count as empty texts, whose sketch is the empty string; two empty sketches are alike (1.0), an empty
and another one are not (0.0). Other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folia.llm import textkit as tk
from folia.llm.arrow import map_batches, shuffle_partitions

K = 128
_BITS = np.uint64(16)


def sketches(buf: np.ndarray, offs: np.ndarray, k: int = K, words: int = 5) -> list[np.ndarray]:
    """Sorted bottom-k hashes (48 bits) of every row."""
    h, begin = tk.shingles(buf, offs, words)
    h = h >> _BITS
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        x = h[a:b]
        if b - a > 4 * k:  # copies may hide among the smallest, so take more until k differ
            m = 2 * k
            while m < b - a and len(y := np.unique(np.partition(x, m)[:m])) < k:
                m *= 2
            x = y if m < b - a else np.unique(x)
        else:
            x = np.unique(x)
        out.append(x[:k])
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 2:] = raw
    return full.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    top = both[-1]
    shared = np.intersect1d(a[a <= top], b[b <= top], assume_unique=True)
    return len(shared) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**48)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j * (na + nb) / (1 + j) / na)


def fingerprint(df: DataFrame, text: str = "text", k: int = K, words: int = 5, out: str = "fingerprint") -> DataFrame:
    """`df` with the sketch of its `text` column as a string column `out` (replaced if there)."""
    df = df.drop(out) if out != text else df
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        got: list[str] = []
        for _, _, buf, offs in tk.pieces(b.column(text)):
            got += [to_text(s) for s in sketches(buf, offs, k, words)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return map_batches(df, kernel, schema)


def _pairs(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[list[tuple]]:
    """(doc_id, text, next text) of rows in order, about `limit` characters at a time."""
    held: tuple | None = None  # the row whose next one is looked for
    rows, size = [], 0
    for batch in batches:
        for x in range(0, batch.num_rows, 256):  # few rows at a time leave Arrow
            part = batch.slice(x, 256)
            for i, t, k, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail"))):
                if held is not None and held[2] == k:
                    rows.append((held[0], held[1], t))
                    size += len(held[1]) + len(t)
                held = None if tail else (i, t, k)
                if size >= limit:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _dealt(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, text, bucket, tail) in the partitions and the order that `_pairs` reads.

    The documents are dealt once into ranges of descending doc_id; the first rows of a range are also sent
    to the range before it, as its tail.
    """
    spark = docs.sparkSession
    p = partitions or shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / p for i in range(1, p)], 0.2 / p))) if p > 1 else []
    edges = np.array(cuts, np.int64)

    def bucket(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("doc_id")
        at = len(edges) - np.searchsorted(edges, np.array(ids.fill_null(0)), "right")
        at = np.where(np.array(ids.is_null()), len(edges) + 1, at).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.array(at)], ["doc_id", "bucket"])

    # one row for each of at most p + 1 buckets
    tops = map_batches(docs.select("doc_id"), bucket, "doc_id long, bucket int").groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    before = {r["top"]: tops[i - 1]["bucket"] for i, r in enumerate(tops)}

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        base = bucket(b).column("bucket")
        ids = b.column("doc_id").to_pylist()
        heads = [i for i, x in enumerate(ids) if x in before]
        rows = pa.concat_arrays([base, pa.array([before[ids[i]] for i in heads], pa.int32())])
        tail = pa.array([0] * len(ids) + [1] * len(heads), pa.int32())
        take = pa.array([*range(len(ids)), *heads], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text").take(take), rows, tail], ["doc_id", "text", "bucket", "tail"])

    dealt = map_batches(docs, place, "doc_id long, text string, bucket int, tail int").repartition(p, "bucket")
    return dealt.sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, text, next_text) with the next document in descending doc_id; after the last comes the first.

    Rows of equal doc_id are ordered by text, rows without doc_id stand last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "text", "next_text"])

    return _dealt(docs, partitions).mapInArrow(run, "doc_id long, text string, next_text string")


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next
    document in descending doc_id. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pairs(batches):
            cols: list[list] = [[] for _ in range(8)]
            edited = []
            for _, t, x in rows:
                half = len(t) // 2
                edited.append((t[: len(t) - half] + x[:half]).encode())
            own = sketches(*tk.from_texts([r[1].encode() for r in rows]), k)
            new = sketches(*tk.from_texts(edited), k)
            for i, (doc_id, t, x) in enumerate(rows):
                follows = i + 1 < len(rows) and rows[i + 1][1] == x
                after = own[i + 1] if follows else sketches(*tk.from_texts([x.encode()]), k)[0]
                for c, v in zip(cols, (doc_id, len(t), hashlib.sha256(edited[i]).hexdigest(), to_text(own[i]), to_text(new[i]), resemblance(own[i], new[i], k), resemblance(own[i], after, k), distinct(own[i], k))):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return _dealt(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double")
