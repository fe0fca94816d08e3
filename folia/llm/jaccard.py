"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of five-word shingles (hashes; a text of fewer words has one shingle). Equal sets form a
copy class and are represented once. MinHash values in bands of ROWS propose candidates; within a bucket
pairs are compared a few values at a time, and a pair is dropped as soon as the posterior probability
(uniform prior) that its similarity reaches THRESHOLD is below TOLERANCE. What is left is verified exactly
on the shingle sets.

No step writes all pairs of a group: a bucket's kernel returns a spanning forest of its surviving pairs.
The members of a component of these forests are verified with each other by matrix products, BLOCK by BLOCK
members a task, with their copies taken as one. That is every surviving pair, and those that the posterior
dropped or no bucket held but which other survivors connect, so a link inside a component is never lost; the
number of links of every document needs all of them anyway. From there comes again a spanning forest, whose
components are the classes. Sets are told apart by 128-bit digests.

A document's links are the other documents of similarity THRESHOLD or more, copies included; its class id is
the least doc_id of all that it reaches over links, its copy id that of its copy class. Null and empty
texts have no shingles, no links, and are their own class. Repeated rows of one doc_id with different texts
are told apart by their sets and share the id; rows without doc_id are left out. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import textkit as tk
from folia.llm.arrow import free, map_batches
from folia.llm.shared import drop, written

THRESHOLD, WORDS = 0.8, 5
BANDS, ROWS = 32, 5
#: Values compared before each look at the posterior, and the probability below which a pair goes.
STEP, TOLERANCE = 16, 1e-6
#: Members of a block at most, and bytes of their shingle sets (on average).
BLOCK, BLOCK_BYTES = 1500, 24 << 20
_N = BANDS * ROWS


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = tk.mix(np.arange(1, 2 * _N + 1, dtype=tk.U))
    return x[:_N] | tk.U(1), x[_N:]


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for _, _, buf, offs in tk.pieces(texts):
        h, begin = tk.shingles(buf, offs, WORDS)
        for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield np.unique(h[a:z])


def signature(shingles: np.ndarray) -> np.ndarray:
    """_N MinHash values of 32 bits, by a multiply-add hash each."""
    a, c = _seeds()
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        for j in range(0, _N, 32):
            v = ((part[None, :] * a[j : j + 32, None] + c[j : j + 32, None]) >> tk.U(32)).astype(np.uint32)
            np.minimum(out[j : j + 32], v.min(1), out=out[j : j + 32])
    return out


@lru_cache
def _least_matches() -> list[int]:
    """For every number of values compared in steps of STEP, the fewest matches that keep a pair."""

    def below(m: int, n: int) -> bool:
        # P(similarity >= threshold | m of n match) under a uniform prior is the upper tail of Beta(m + 1, n - m + 1),
        # which is the probability of at most m successes among n + 1 draws of the threshold's probability
        tail = sum(math.comb(n + 1, i) * THRESHOLD**i * (1 - THRESHOLD) ** (n + 1 - i) for i in range(m + 1))
        return tail < TOLERANCE

    return [next(m for m in range(n + 1) if not below(m, n)) for n in range(STEP, _N + 1, STEP)]


def _survivors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) whose signatures the posterior doesn't rule out."""
    least = _least_matches()
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    match = np.zeros(len(i), np.int16)
    for step, need in enumerate(least):
        at = slice(step * STEP, (step + 1) * STEP)
        match = match + (a[i, at] == b[j, at]).sum(1, dtype=np.int16)
        keep = match >= need
        i, j, match = i[keep], j[keep], match[keep]
        if not len(i):
            break
    return i, j


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbours with equal first `keys` columns."""
    before, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != before:
                if rows:
                    yield before, rows
                before, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield before, rows


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each bucket block's surviving pairs. Rows: bucket, i, j, block, doc_id, signature."""
    left, right = [], []
    for (_, bi, bj), rows in _groups(batches, 3):
        sig = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), _N)
        ids = [r[1] for r in rows]
        one = np.array([k for k, r in enumerate(rows) if r[0] == bi])
        two = one if bi == bj else np.array([k for k, r in enumerate(rows) if r[0] == bj])
        forest = _Forest(len(rows))
        if len(one) and len(two):
            for x in range(0, len(one), 64):
                part = one[x : x + 64]
                at = np.array([forest.root(k) for k in two.tolist()])
                main = np.bincount(at).argmax()  # pairs inside one tree can join nothing
                inside = np.array([forest.root(k) == main for k in part.tolist()])
                for mine, rest in ((part[inside], two[at != main]), (part[~inside], two)):
                    if len(mine) and len(rest):
                        i, j = _survivors(sig[mine], sig[rest])
                        for p, q in zip(mine[i].tolist(), rest[j].tolist()):
                            if p != q and forest.join(p, q):
                                left.append(ids[p])
                                right.append(ids[q])
        if len(left) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
            left, right = [], []
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of 0/1 matrices over the shingles that both sides have."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.float32)
    values, back = np.unique(np.concatenate(a), return_inverse=True)
    other = np.concatenate(b)
    at = np.minimum(np.searchsorted(values, other), len(values) - 1)
    hit = values[at] == other
    used = np.unique(at[hit])
    name = np.full(len(values), -1)
    name[used] = np.arange(len(used))
    row_a, row_b = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))[hit]
    col_a, col_b = name[back], name[at[hit]]
    row_a, col_a = row_a[col_a >= 0], col_a[col_a >= 0]
    oa, ob = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[oa], col_a[oa], row_b[ob], col_b[ob]
    out = np.zeros((len(a), len(b)), np.float32)
    for x in range(0, len(used), 2048):
        xa, za = np.searchsorted(col_a, [x, x + 2048])
        xb, zb = np.searchsorted(col_b, [x, x + 2048])
        ma, mb = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        ma[row_a[xa:za], col_a[xa:za] - x] = 1
        mb[row_b[xb:zb], col_b[xb:zb] - x] = 1
        out += ma @ mb.T
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: component, i, j, block, doc_id, copies, shingles. Returns (id, links found here, a neighbour in the forest)."""
    out: list[tuple] = []
    for (_, bi, bj), rows in _groups(batches, 3):
        sets = [np.frombuffer(r[3], "<u8") for r in rows]
        one = [k for k, r in enumerate(rows) if r[0] == bi]
        two = one if bi == bj else [k for k, r in enumerate(rows) if r[0] == bj]
        if not one or not two:
            continue
        n = np.array([len(s) for s in sets], np.float64)
        copies = np.array([r[2] for r in rows], np.int64)
        both = shared_counts([sets[k] for k in one], [sets[k] for k in two])
        # in whole numbers: shared * 10 >= 8 * union
        linked = both * (1 + THRESHOLD) >= THRESHOLD * (n[one][:, None] + n[two][None, :]) - 1e-6
        if bi == bj:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(rows), np.int64)
        links[one] += linked @ copies[two]
        if bi != bj:
            links[two] += linked.T @ copies[one]
        forest, near = _Forest(len(rows)), [None] * len(rows)
        more = []
        for p in range(len(one)):
            to = np.flatnonzero(linked[p])
            for q in to.tolist():
                x, y = one[p], two[q]
                if forest.join(x, y):
                    more.append((rows[x][1], 0, rows[y][1]))
        out += [(r[1], int(links[k]), near[k]) for k, r in enumerate(rows)] + more
        if len(out) > 50_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["id", "links", "near"])


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the least id that every end of an edge (a, b) reaches.

    Alternates the large-star and small-star steps until no edge changes; each step is one shuffle by node
    with partial minima, and an id of very many edges is a plain group of an aggregate.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written: both sides of their joins are then plain shuffles, of which a node of very many edges can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large star: the larger neighbours of a node go to its least one
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "edges")
        # small star: a node and its smaller neighbours go to the least of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        for old in (now, least, large, low):
            drop(old)
        now = after
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("class")).union(now.select(F.col("v"), F.col("v"))).distinct()
        before = state


def _blocked(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows with (i, j, block): each member stands in every pair of blocks that its own takes part in. sizes: (key, n, bytes)."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = rows.join(sizes.select(key, blocks.alias("_k")), key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    return dealt.select("*", other.alias("_o")).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).drop("_k", "_o")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_id, n_links of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, sigs, bands, sizes, seen = [], [], [], [], {}
        for s in _sets(b.column("text")):
            key = hashlib.md5(s.tobytes()).digest() if len(s) else None
            keys.append(key)
            sizes.append(len(s))
            if key is None or key in seen:
                sigs.append(None if key is None else sigs[seen[key]])
                bands.append(None if key is None else bands[seen[key]])
                continue
            seen[key] = len(sigs)
            v = signature(s)
            sigs.append(v.astype("<u2").tobytes())
            mixed = tk.mix(v.astype(tk.U).reshape(BANDS, ROWS) + tk.U(11))
            bands.append(tk.mix((mixed * (np.arange(ROWS, dtype=tk.U) * tk.U(2) + tk.U(3))).sum(1, dtype=tk.U) + np.arange(BANDS, dtype=tk.U)).view(np.int64).tolist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "key", "sig", "bands", "size"])

    signed = written(map_batches(docs, sign, "doc_id long, key binary, sig binary, bands array<long>, size long"), "signed")
    ids = written(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("size").alias("size")).withColumn("id", F.col("key")), "classes")
    reps = signed.join(ids.select("key", "id", F.col("first").alias("doc_id")), ["key", "doc_id"]).dropDuplicates(["key"]).select("id", "sig", "bands")
    reps = written(reps, "reps")

    # buckets of the same members are looked at once; they are told apart by 128 bits, like the sets themselves
    told = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"_{i}") for i in range(2)]
    buckets = reps.select("id", F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n"), *told).where("n > 1")
    buckets = buckets.groupBy("n", "_0", "_1").agg(F.min("band").alias("band")).select("band", "n")
    buckets = written(buckets, "buckets")
    in_band = reps.select("id", "sig", F.explode("bands").alias("band"))
    dealt = _blocked(in_band.join(buckets.select("band"), "band", "left_semi"), "band", buckets.withColumn("bytes", F.lit(0)))
    proposed = dealt.select("band", "i", "j", "block", "id", "sig").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_propose, "a binary, b binary")
    maybe = written(components(proposed).withColumnRenamed("class", "comp"), "maybe")

    # the sets of the members of components, from their texts again
    want = maybe.join(ids, "id")
    sizes = want.groupBy("comp").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes"))

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [s.astype("<u8").tobytes() for s in _sets(b.column("text"))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("comp", "id", "copies")), pa.array([hashlib.md5(s).digest() == k for s, k in zip(got, b.column("key").to_pylist())]), pa.array(got, pa.binary())], ["comp", "id", "copies", "own", "set"])

    texts = docs.join(want.select(F.col("first").alias("doc_id"), "id", "comp", "copies", "key"), "doc_id")
    members = map_batches(texts.select("comp", "id", "copies", "key", "text"), sets, "comp binary, id binary, copies long, own boolean, set binary").where("own").drop("own").dropDuplicates(["id"])
    blocks = _blocked(members, "comp", sizes).select("comp", "i", "j", "block", "id", "copies", "set")
    checked = written(blocks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify, "id binary, links long, near binary"), "links")
    classes = components(checked.where("near is not null").select(F.col("id").alias("a"), F.col("near").alias("b")))
    degree = checked.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = ids.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    least = nodes.groupBy("class").agg(F.min("first").alias("class_id"))
    of_class = nodes.join(least, "class").join(degree, "id", "left").select("key", "class_id", F.col("first").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "key").join(of_class, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id (with all its rows, if it has several); rows without doc_id stay."""
    classes = join(docs).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    gone = classes.where("class_id <> doc_id").select("doc_id")
    own = free(docs, "_gone")
    gone = gone.withColumnRenamed("doc_id", own)
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
