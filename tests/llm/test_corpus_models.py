"""Language model, importance resampling and Merkle manifest against plain loops over small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from folia.llm import dsir, katz, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdeé"), RNG.integers(1, 5))) for _ in range(60)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n, p=np.arange(60, 0, -1) / 1830))


TEXTS = [None, "", " \t\n ", "one", "One ONE one", prose(3000, 1), "\x1c odd\x0b\x0cgaps ", "x" * 50_000, "🙂 é É", *(prose(40, s) for s in range(60)), *["twice told tale"] * 9]
ROWS = [(i * 3, t, ["en", None, "é", "z"][i % 4] if i < 40 else "en", "s" if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5], (None, prose(30, 9), None, None, None), (None, None, None, None, None), (ROWS[7][0], "another of this id", "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    wide = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in ROWS], f"{DOCS}, pos int, bucket string, rank int, score int")
    return wide.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# language model


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def katz_by_loops(rows, order):
    learn = [tokens(r[1]) for r in rows if not held(r[0])]
    counts = [Counter(), *(defaultdict(Counter) for _ in range(2, order + 1))]
    before = lambda t, i, m: tuple(t[max(0, i - m + 1) : i]) if i >= m - 1 else ("START", *t[:i])
    for t in learn:
        counts[0].update(t)
        for m in range(2, order + 1):
            for i, w in enumerate(t):
                counts[m - 1][before(t, i, m)][w] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    times = [[sum(c == r for c in counts[0].values()) for r in range(1, 7)]]
    times += [[sum(c == r for h in k.values() for c in h.values()) for r in range(1, 7)] for k in counts[1:]]

    def discount(m, r):
        if r > 5:
            return 1.0
        k = times[m - 1]
        last = 6 * k[5] / k[0] if k[0] else 1.0
        d = ((r + 1) * k[r] / (r * k[r - 1]) - last) / (1 - last) if k[r - 1] and last != 1 else 0
        return d if 0 < d < 1 else 1 - 1 / (2 * r)

    def single(w):
        if not n:
            return 1.0
        left = sum(c * (1 - discount(1, c)) for c in counts[0].values())
        c = counts[0][w]
        return (c * discount(1, c) if c else left or 1.0) / (n if left else n + 1)

    def p(m, history, w):
        if m == 1:
            return single(w)
        seen, shorter = counts[m - 1].get(history), (history[1:] if history[0] != "START" or len(history) == m - 1 and m > 2 and len(history) > 1 else history)
        if m == 2:
            shorter = ()
        elif history[0] == "START":
            shorter = history[1:] if len(history) == m - 1 else history
        if not seen:
            return p(m - 1, shorter, w)
        c = sum(seen.values())
        left = sum(x * (1 - discount(m, x)) for x in seen.values())
        c, left = (c, left) if left > 1e-9 else (c + 1, 1.0)
        if seen[w]:
            return seen[w] * discount(m, seen[w]) / c
        return left / c / (1 - sum(p(m - 1, shorter, x) for x, y in seen.items() if y)) * p(m - 1, shorter, w)

    memo = {}

    def cached(history, w):
        if (history, w) not in memo:
            memo[history, w] = p(order, history, w)
        return memo[history, w]

    out = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((counts[0][w] + 1) / (n + v + 1)) for w in t)
        known = sum(counts[0][w] > 0 for w in t)
        out.append((r[0], held(r[0]), len(t), known, n, base, sum(math.log10(cached(before(t, i, order), w)) for i, w in enumerate(t))))
    return out, cached, counts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_model_equals_plain_loops(docs, order):
    want, p, counts = katz_by_loops(ROWS, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted(map(tuple, katz.score(docs, order).collect()), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    if order == 2:  # what stands after a history sums to 1, the unknown word included
        for h in list(counts[1])[:20]:
            assert abs(sum(p(h, w) for w in [*counts[0], "never seen"]) - 1) < 1e-9


def test_parts_of_frequent_histories_and_small_blocks(docs):
    """Results don't depend on how texts are cut into blocks and n-grams are dealt out."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    want, got = (sorted(map(tuple, katz.score(docs, 3, **sizes).collect()), key=key) for sizes in ({}, {"block": 3000, "bucket": 400}))
    assert [w[:5] for w in want] == [g[:5] for g in got] and np.allclose([w[5:] for w in want], [g[5:] for g in got], rtol=1e-9)


def test_backoff_model_of_nothing(docs, empty):
    assert katz.score(empty).count() == 0
    from pyspark.sql import functions as F

    alone = katz.score(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)).collect()
    assert alone and {(r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in alone} == {(0, 0, 0.0, 0.0)}


def test_packed_arrays():
    for a in (np.zeros(0, np.int64), np.array([-1, 0, 1 << 62]), np.arange(1000)):
        assert (katz.unpack(katz.pack(a)) == a).all()
    assert katz.unpack(katz.pack(np.array([0.1, -2.5])), np.float64).tolist() == [0.1, -2.5]


# importance resampling


def grams(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def resample_by_loops(rows, target):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(grams(r[1])[1])
    for x in target:
        t.update(grams(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(ns + 10_000) / (float(s[b] + 1) * float(nt + 10_000))))
    out = []
    for r in rows:
        n, f = grams(r[1])
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_importance_resampling_equals_plain_loops(spark, docs, empty):
    target = [prose(50, 77), None, "", "ONE one x-ray 12"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert sorted(map(tuple, dsir.resample(docs, bench).collect()), key=str) == resample_by_loops(ROWS, target)
    assert sorted(map(tuple, dsir.resample(docs, bench.limit(0)).collect()), key=str) == resample_by_loops(ROWS, [])
    assert dsir.resample(empty, bench).count() == 0


def test_slices_keep_every_text():
    texts = pa.array(["a" * 10, None, "b" * 200, "", "c"])
    parts = list(dsir.slices(texts, 50))
    assert [len(p) for p in parts] == [2, 1, 2] and pa.concat_arrays(parts).to_pylist() == ["a" * 10, "", "b" * 200, "", "c"]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return sha(*map(field, (r[0], r[3], r[2], r[4], text)))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        a = i - i % 8
        yield nodes[a:i], nodes[i + 1 : a + 8]
        i //= 8


def manifest_by_loops(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))) for x in langs}
    trees = {x: tree([leaf_of(r, r[1]) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            drawn = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f = leaf_of(r, lower(r[1]) if drawn and r[1] is not None else r[1])
            proof = []
            for b, a in [*path(trees[x], i), *path(top, k)]:
                proof += [*b, *a]
                f = sha(*b, f, *a)
            out.append((r[0], leaf_of(r, r[1]), trees[x][-1][0], top[-1][0], sha(*proof), f, f == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 4])
def test_manifest_equals_plain_loops(docs, empty, width):
    assert sorted(map(tuple, merkle.manifest(docs, width).collect()), key=str) == manifest_by_loops(ROWS)
    assert merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_of_one_language_and_of_many(spark, n):
    for lang in (lambda i: "en", lambda i: f"l{i:03d}"):
        rows = [(i, "T" * i, lang(i), "s", i) for i in range(n)]
        got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted(map(tuple, got), key=str) == manifest_by_loops(rows)
