"""Removal of repeated passages: every byte inside a string of SPAN bytes that also starts elsewhere.

Sorting all suffixes of all texts would move every byte several times. As in induced sorting, only a
sample of suffixes is sorted, and what holds for them decides the rest. The sample is drawn by content: of
each window of SPAN bytes the K bytes with the least hash are its anchor, so equal windows have equal
anchors at equal places, and windows in a row mostly share one. Spark's external sort (runs on disk, merged
by priority queues) orders the anchors; an anchor that stands in one place only settles all its windows as
unique. Around the others the bytes of their windows travel to the anchor's partition, where windows are
named by 64 bits of two independent hashes, and those of two or more places are repeated.

Everything is said of texts, not rows: a text of two or more rows is repeated as a whole if it is long
enough, and stands for one place towards others, so copies cost nothing. An anchor with very many places is
never gathered: runs of windows with equal bytes are marked where they stand, and the windows of the others
are named there, counted by name and looked up in the names of two or more places.

Nulls count as empty texts. Matches never cross documents. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import textkit as tk
from folia.llm.arrow import map_batches
from folia.llm.shared import written

SPAN, K = 400, 32
#: Places of one anchor beyond which its windows are counted by name, not in the anchor's partition.
PLACES = 20_000
#: Anchors up to which the list of such anchors is sent to all executors (8 bytes each).
BROADCAST_LIMIT = 1_000_000
#: Kinds of runs of windows: of an anchor with few places; else alone with its bytes, the first of runs with equal bytes, another of these.
_COLD, _ALONE, _FIRST, _SAME = range(4)
_AT = np.uint64((1 << 22) - 1)
#: Bytes of a text that are looked at together; below 2^22.
_PART = 1 << 21


def _name(buf: np.ndarray, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit names of byte spans, from hashes in two rings: strings made to collide in one differ in the other."""
    return tk.mix(tk.span_hash(prefix, s, e) + tk.prime_hash(tk.prime_prefix(buf), s, e) * tk.U(0xC2B2AE3D27D4EB4F))


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    """The minimum of each `wide` entries in a row."""
    m, size = h, 1
    while size * 2 <= wide:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = wide - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(buf: np.ndarray, offs: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """(row, anchor's hash, its place, first window, last window, hash of the windows' bytes) of every run of windows with one anchor.

    Places are within rows.
    """
    n = len(buf)
    if n < span:
        return (np.zeros(0, np.int64),) * 6
    prefix = tk.prefix_hash(buf)
    at = np.arange(n - k + 1)
    h = tk.span_hash(prefix, at, at + k)
    best = (_least((h & ~_AT) | at.astype(tk.U), span - k + 1) & _AT).astype(np.int64)  # leftmost of equal ones
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(best)]
    inside = np.arange(len(best)) + span <= offs[row + 1]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & inside)
    row_f = row[first]
    last = np.minimum(np.append(np.flatnonzero(new)[1:], len(best))[np.cumsum(new)[first] - 1] - 1, offs[row_f + 1] - span)
    place = best[first]
    whole = _name(buf, prefix, first, last + span).view(np.int64)
    return row_f, h[place].view(np.int64), place - offs[row_f], first - offs[row_f], last - offs[row_f], whole


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, their first bytes) of slices; texts longer than _PART come in parts that overlap."""
    for a, b, buf, offs in tk.pieces(texts, _PART):
        if len(buf) <= 2 * _PART - 1 and len(buf) < 1 << 22:
            yield buf, offs, np.arange(a, b), np.zeros(b - a, np.int64)
        else:
            for x in range(0, len(buf), _PART):
                part = buf[x : x + _PART + SPAN - 1]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([x])


def _key(text: bytes) -> bytes:
    return hashlib.md5(text).digest()


def _site(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    return tk.mix(keys + place.astype(tk.U) * tk.U(0x9E3779B97F4A7C15)).view(np.int64)


def _anchor_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = b.column("text").cast(pa.large_string()).fill_null("")
    keys = [_key(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
    first8 = np.frombuffer(b"".join(x[:8] for x in keys), "<u8")
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for buf, offs, rows, start in _parts(texts):
        r, v, p, lo, hi, whole = anchors(buf, offs)
        if len(r):
            at, row = start[r], rows[r]
            for c, x in zip(out, (v, _site(first8[row], p + at), row, p + at, lo + at, hi + at, whole)):
                c.append(x)
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    arrays = [pa.array(cols[0]), pa.array(cols[1]), pa.array(keys, pa.binary()).take(pa.array(cols[2])), *(pa.array(c) for c in cols[3:])]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "site", "key", "place", "lo", "hi", "content"])


def _window_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The bytes of each run of windows once for so many texts, with all its owners (key, first window)."""
    for b in batches:
        for x in range(0, b.num_rows, rows):
            yield _window_part(b.slice(x, rows))


def _window_part(b: pa.RecordBatch) -> pa.RecordBatch:
    own: dict[tuple, dict] = {}
    for key, text, runs in zip(b.column("key").to_pylist(), b.column("text"), b.column("runs").to_pylist()):
        cold = [r for r in runs if r["kind"] == _COLD]
        raw = text.as_py().encode() if cold else b""
        for r in cold:
            own.setdefault((r["anchor"], raw[r["lo"] : r["hi"] + SPAN]), {})[key + r["lo"].to_bytes(8, "little")] = None
    anchor, content, owners = [v for v, _ in own], [c for _, c in own], [b"".join(who) for who in own.values()]
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.binary()), pa.array(owners, pa.binary())], ["anchor", "content", "owners"])


def _names(contents: list[bytes], keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, site, row, place in the row) of all windows of contents, and the windows before each row."""
    buf, offs = tk.from_texts(contents)
    prefix = tk.prefix_hash(buf)
    n = np.diff(offs) - SPAN + 1
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(begin[-1]) - begin[row]
    at = offs[row] + inner
    return _name(buf, prefix, at, at + SPAN), _site(keys[row], starts[row] + inner), row, inner, begin


def _hot_names(batches: Iterator[pa.RecordBatch], windows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(name, site, whether its run's bytes stand elsewhere, key, run's first window, window) of anchors with many places; of runs with equal bytes only the first's."""

    def out(rows: list[tuple[bytes, bytes, int, bool]]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(r[1][:8] for r in rows), "<u8")
        lo = np.array([r[2] for r in rows], np.int64)
        names, sites, row, inner, _ = _names([r[0] for r in rows], keys, lo)
        many = np.array([r[3] for r in rows])[row]
        arrays = [pa.array(names.view(np.int64)), pa.array(sites), pa.array(many), pa.array([r[1] for r in rows], pa.binary()).take(pa.array(row)), pa.array(lo[row]), pa.array(lo[row] + inner)]
        return pa.RecordBatch.from_arrays(arrays, ["name", "site", "many", "key", "lo", "start"])

    rows, size = [], 0
    for b in batches:
        for key, text, runs in zip(b.column("key").to_pylist(), b.column("text"), b.column("runs").to_pylist()):
            named = [r for r in runs if r["kind"] in (_ALONE, _FIRST)]
            raw = text.as_py().encode() if named else b""
            for r in named:
                rows.append((raw[r["lo"] : r["hi"] + SPAN], key, r["lo"], r["kind"] == _FIRST))
                size += r["hi"] - r["lo"] + 1
                if size > windows:
                    yield out(rows)
                    rows, size = [], 0
    if rows:
        yield out(rows)


def _in_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """(key, first byte, byte behind the last) of windows in a row, out of (key, starts)."""
    keys, start, end = [], [], []
    for key, at in zip(b.column("key").to_pylist(), b.column("starts").to_pylist()):
        at = np.unique(np.array(at, np.int64))
        new = np.flatnonzero(np.append(True, np.diff(at) > 1))
        keys += [key] * len(new)
        start += at[new].tolist()
        end += (at[np.append(new[1:], len(at)) - 1] + SPAN).tolist()
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["key", "start", "end"])


def _repeated(rows: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, first byte, byte behind the last) of repeated strings among rows (content, owners) of whole anchors."""
    keys = np.frombuffer(b"".join(r[1][:8] for r in rows), "<u8")
    starts = np.frombuffer(b"".join(r[1][16:24] for r in rows), "<i8")
    names, sites, row, _, begin = _names([r[0] for r in rows], keys, starts)
    many = np.array([len(r[1]) > 24 for r in rows])
    order = np.argsort(names, kind="stable")
    cut = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    low, high = np.minimum.reduceat(sites[order], cut), np.maximum.reduceat(sites[order], cut)
    more = np.maximum.reduceat(many[row][order].view(np.int8), cut) > 0
    again = np.zeros(len(names), bool)
    again[order] = np.repeat((low != high) | more, np.diff(np.append(cut, len(names))))
    s, e, r = tk.runs(again.view(np.int8), begin)
    for a, z, i in zip((s - begin[r]).tolist(), (e - begin[r]).tolist(), r.tolist()):
        who = rows[i][1]
        for x in range(0, len(who), 24):
            lo = int.from_bytes(who[x + 16 : x + 24], "little")
            yield who[x : x + 16], lo + a, lo + z - 1 + SPAN


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; they are settled whenever enough whole anchors are there."""

    def out(rows: list) -> Iterator[pa.RecordBatch]:
        for got in batched(_repeated(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["key", "start", "end"])

    rows: list[tuple[bytes, bytes]] = []
    size, before = 0, None
    for b in batches:
        for anchor, content, owners in zip(*(c.to_pylist() for c in b.columns)):
            if size > 1 << 21 and anchor != before:
                yield from out(rows)
                rows, size = [], 0
            before = anchor
            rows.append((content, owners))
            size += len(content) + len(owners)
    if rows:
        yield from out(rows)


def _cut(b: pa.RecordBatch) -> pa.RecordBatch:
    keys, removed, spans, sha, kept = [], [], [], [], []
    for key, text, found in zip(b.column("key").to_pylist(), b.column("text"), b.column("found").to_pylist()):
        raw, at, gone, n, parts = text.as_py().encode(), 0, 0, 0, []
        for start, end in sorted((f["start"], f["end"]) for f in found):
            if start > at or not n:
                parts.append(raw[at:start])
                n += 1
                gone += end - start
                at = end
            elif end > at:
                gone += end - at
                at = end
        parts.append(raw[at:])
        rest = b"".join(parts)
        for c, v in zip((keys, removed, spans, sha, kept), (key, gone, n, hashlib.sha256(rest).hexdigest(), rest)):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _hot_runs(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, anchor, kind, lo, hi) of the runs of anchors with many places, copies of texts once."""
    own = rows.join(hot, "anchor").dropDuplicates(["key", "place", "lo"])
    # written: both sides of the join are then plain shuffles, of which a frequent content's can be split
    same = written(own.groupBy("anchor", "content").agg(F.min("site").alias("_a"), F.max("site").alias("_z")).where("_a <> _z").drop("_z"), "contents")
    kind = F.when(F.col("_a").isNull(), _ALONE).when(F.col("site") == F.col("_a"), _FIRST).otherwise(_SAME)
    return own.join(same, ["anchor", "content"], "left").select("key", "anchor", kind.alias("kind"), "lo", "hi")


def _hot_found(some: DataFrame) -> DataFrame:
    """(key, start, end) of repeated strings around anchors with many places."""
    runs = some.select("key", F.explode("runs").alias("r")).where(F.col("r.kind").isin(_FIRST, _SAME))
    whole = runs.select("key", F.col("r.lo").alias("start"), (F.col("r.hi") + SPAN).alias("end"))
    named = some.where(F.exists("runs", lambda r: r["kind"].isin(_ALONE, _FIRST))).select("key", "text", "runs")
    named = named.mapInArrow(_hot_names, "name long, site long, many boolean, key binary, lo long, start long")
    names = named.groupBy("name").agg(F.min("site").alias("_a"), F.max("site").alias("_z"), F.max("many").alias("_m")).where("_a <> _z or _m")
    again = named.where("not many").join(written(names.select("name"), "names"), "name")
    by_run = again.groupBy("key", "lo").agg(F.collect_list("start").alias("starts")).select("key", "starts")
    return whole.unionByName(map_batches(by_run, _in_rows, "key binary, start long, end long"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with repeated strings beside copies: key, text, found), (all texts: key, id, n of rows)."""
    none = F.lit(-(1 << 63))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select(F.unhex(F.md5("text")).alias("key"), "id", "text")
    rows = written(map_batches(texts.select("text"), _anchor_rows, "anchor long, site long, key binary, place long, lo long, hi long, content long"), "anchors")
    contents = rows.groupBy("anchor", "content").agg(F.min("site").alias("_a"), F.max("site").alias("_z"), F.count("*").alias("_n"))
    spread = contents.groupBy("anchor").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.sum("_n").alias("_n")).where("_a <> _z")
    spread = written(spread.select("anchor", (F.col("_n") > PLACES).alias("hot")), "spread")
    hot = spread.where("hot").select("anchor")
    n_hot = hot.limit(BROADCAST_LIMIT + 1).count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_LIMIT else hot
    cold = rows.drop("site", "content")
    cold = cold.join(hot, "anchor", "left_anti") if n_hot else cold
    again = cold.join(spread.where("not hot").select("anchor"), "anchor").dropDuplicates(["key", "place", "lo"]).withColumn("kind", F.lit(_COLD))
    again = again.select("key", "anchor", "kind", "lo", "hi")
    again = again.unionByName(_hot_runs(rows, hot)) if n_hot else again
    by_text = again.groupBy("key").agg(F.collect_list(F.struct("anchor", "kind", "lo", "hi")).alias("runs"))
    ids = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    some = written(keyed.join(by_text.join(ids.drop("n"), "key"), ["key", "id"]), "repeats")
    windows = some.select("key", "text", "runs").mapInArrow(_window_rows, "anchor long, content binary, owners binary")
    found = windows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_settle, "key binary, start long, end long")
    found = found.unionByName(_hot_found(some)) if n_hot else found
    lists = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return some.select("key", "text").dropDuplicates(["key"]).join(lists, "key"), ids


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, kept (the remaining bytes) of every document."""
    some, ids = find(docs)
    cut = map_batches(some, _cut, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    copies = ids.where("n > 1").select("key", F.lit(True).alias("copied"))
    return _joined(own.select("doc_id", "key", "text"), cut, copies, True)


def _joined(own: DataFrame, cut: DataFrame, copies: DataFrame, texts: bool) -> DataFrame:
    out = own.withColumns({"n_bytes": F.octet_length("text").cast("long"), "sha": F.sha2("text", 256)})
    out = out if texts else out.drop("text")
    out = out.join(cut, "key", "left").join(copies, "key", "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= SPAN)
    cols = [
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    cols.append((cols[2] > 0).alias("repeated"))
    return out.select(*cols, *([F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8"))).alias("kept")] if texts else []))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether any is removed) of every document; whole texts stay where they are read."""
    some, ids = find(docs)
    cut = map_batches(some, _cut, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary").drop("kept")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    return _joined(own.select("doc_id", "key", "text"), cut, ids.where("n > 1").select("key", F.lit(True).alias("copied")), False)
