"""Secret spans: planted random and structured runs of every encoding, and base spans against a scan by hand."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest

from folia.llm import secrets as S

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("text").collect() if r["text"]]


@pytest.fixture(scope="module")
def models(texts):
    return S.learn(iter(texts[::2])), S.of_vocabulary(RANKS)


def by_hand(text: str) -> list[tuple[int, int, int]]:
    """The three base patterns, character by character."""
    out, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    body = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        if word is None:
            at += 1
            continue
        i = at + len(word)
        i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "="):
            at += 1
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
        j = i
        while j < len(text) and text[j] in body:
            j += 1
        if j == i:
            at += 1
            continue
        if j - i >= 6:
            out.append((at, j, 0))
        at = j
    for start, chars, head, least, kind in (("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 4, 20, 1), ("", "0123456789abcdef", 0, 24, 2)):
        at = 0
        while at < len(text):
            j = at + head
            if text.startswith(start, at) and text[j : j + 1] and text[j] in chars:
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - at >= least:
                    out.append((at, j, kind))
                at = j
            else:
                at += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


ODD = ['Token = "abc123def" x PASSWORD:short1 api_key=12 AKIA' + "A" * 16 + " AKIAAB " + "0" * 23 + " " + "0a" * 12, "ſecret=abcdefgh", "secret=token=abcdefg", "apikey'  :  'a/b+c_d.e=f-g'", "token:=abcdefg", "AKIAAKIA" + "B" * 20, "é secret:abcdefg 🙂 " + "f" * 30, ""]


def test_base_spans_equal_a_scan_by_hand(texts):
    for t in [*ODD, *texts]:
        assert S.base_spans(t) == by_hand(t), t[:200]


def key(rng, name, n):
    return "".join(rng.choice(dict(S._ALPHABETS)[name]) for _ in range(n))


@pytest.mark.parametrize("name, least", [("HEX", 0.97), ("base32", 0.97), ("base36", 0.97), ("base62", 0.97), ("base64", 0.97), ("base64url", 0.97)])
def test_random_runs_are_found(models, name, least):
    rng = random.Random(3)
    found = 0
    for _ in range(300):
        k = key(rng, name, 32)
        got = S.random_spans(f"the key {k}, then", [], models)
        found += got == [(8, 40)] or bool(got) and got[0][0] >= 8 and got[0][1] <= 41
    assert found >= least * 300


@pytest.mark.parametrize("name", ["HEX", "base32", "base36", "base62", "base64", "base64url"])
@pytest.mark.parametrize("n, least", [(20, 0.83), (24, 0.92), (40, 0.97)])
def test_recall_by_length(models, name, n, least):
    rng = random.Random(11)
    assert sum(bool(S.random_spans(f"the key {key(rng, name, n)}, then", [], models)) for _ in range(300)) >= least * 300


@pytest.mark.parametrize("prefix, name", [("ghp_", "hex"), ("sk_live_", "HEX"), ("github_pat_", "base62"), ("glpat-", "base36")])
def test_the_encoding_is_that_behind_the_prefix(models, prefix, name):
    rng = random.Random(12)
    keys = [prefix + key(rng, name, 36) for _ in range(200)]
    assert sum(S.random_spans(k, [], models) == [(0, len(k))] for k in keys) >= 190


def test_many_dressed_words_keep_the_level(models, texts):
    """Runs of words by themselves, and of words of the hexadecimal letters with numbers: as rare as stated."""
    rng = random.Random(13)
    words = [w for t in texts[1::2] for w in S._TEXT_WORD.findall(t)]
    few = ["FACADE", "BAD", "CAFE", "DEAD", "BEEF", "FEED", "ACE", "DAD", "BEAD", "FADE"]
    dates = [f"20{rng.randrange(10, 30)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}" for _ in range(50)]
    styles = [lambda: "_".join(rng.choice(words) for _ in range(6)), lambda: rng.choice(words) + "-" + "".join(rng.choice(dates) for _ in range(3)), lambda: rng.choice(few) + "".join(rng.choice(dates) for _ in range(3))]
    false = sum(bool(S.random_spans(f" {styles[i % 3]()[:60]} ", [], models)) for i in range(6000))
    assert false <= S.LEVEL * 6000


def test_text_in_other_dress_is_left_alone(models, texts):
    """Less than the stated share: none of 4,000 runs of words that the models haven't learnt from, in five styles."""
    rng = random.Random(5)
    words = [w for t in texts[1::2] for w in S._TEXT_WORD.findall(t)]
    number = lambda: str(rng.randrange(10 ** rng.randrange(1, 5))) if rng.random() < 0.3 else ""
    styles = [lambda w: "".join(x.capitalize() + number() for x in w), lambda w: "_".join(x.lower() for x in w), lambda w: "-".join(x.lower() + number() for x in w), lambda w: "_".join(x.upper() for x in w), lambda w: "".join(x.lower() for x in w)]
    false = sum(bool(S.random_spans(f"see {styles[i % 5]([rng.choice(words) for _ in range(12)])[: rng.randrange(20, 60)]} here", [], models)) for i in range(4000))
    assert false <= S.LEVEL * 4000


@pytest.mark.parametrize("run", ["2024NovemberReportDraft17", "MyVeryLongClassName2Impl4", "a_perfectly_ordinary_identifier_of_code", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a" * 40, "-" * 40, "20240101123000000000", "AbCdEfGhIjKlMnOpQrStUvWx", "aBcDeFgHiJkLmNoPqRsTuVwXyZ", "0123456789ABCDEF01234567", "00FF00FF00FF00FF00FF00FF", "ABCDEFABCDEFABCDEF012345", "internationalization/documentation"])
def test_structured_runs_are_left_alone(models, run):
    assert S.random_spans(f"x {run} y", [], models) == []


def test_runs_are_cut_at_base_spans_and_at_slashes(models):
    rng = random.Random(9)
    k = key(rng, "base62", 40)
    t = f"{k}/{'0a' * 12}"
    assert [(S.KINDS[x], t[a:z]) for a, z, x in S.spans(t, models)] == [("random", k + "/"), ("hex", "0a" * 12)]
    t = f"/path/to-the/{key(rng, 'base64url', 40)}-_/x"
    (span,) = S.random_spans(t, [], models)
    assert t[span[0] : span[1]] == t[13:55]


def test_without_a_model_there_are_base_spans_only():
    assert S.spans("secret=abcdefgh " + key(random.Random(1), "base62", 60), ()) == [(0, 15, 0)]


def test_tables(spark):
    k = key(random.Random(2), "base62", 48)
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (3, f"x {k} y", 9, "c"), (3, f"x {k} y", 9, "c"), (None, "secret=abcdefgh", 9, None), (5, "word " * 300_000 + k, 1, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `spans ``odd` string").withColumnRenamed("spans `odd", "sp`ans")
    got = {(r["doc_id"], r["spans"]) for r in S.scan(df, RANKS).collect()}
    assert got == {(1, ""), (2, ""), (3, "random:2:50"), (None, "assign:0:15"), (5, "random:1500000:1500048")}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in S.scan(df, RANKS).where("doc_id in (1, 2, 3, 5)").collect()} == {empty}
    clean = S.redact(df, RANKS)
    assert clean.columns == df.columns
    assert {(r["doc_id"], r["text"], r["n_chars"], r["sp`ans"]) for r in clean.where("doc_id <> 5 or doc_id is null").collect()} == {(1, None, None, "a"), (2, "", 0, "b"), (3, "x [secret] y", 12, "c"), (None, "[secret]", 8, None)}
    assert S.scan(df.limit(0), RANKS).count() == 0 and S.redact(df.limit(0), RANKS).count() == 0


def test_the_query_equals_the_kernel_on_every_row(spark):
    from folia.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = S.train(docs, RANKS)
    want = {r["doc_id"]: S._joined(sorted(by_hand(r["text"] or "") + [(a, z, 3) for a, z in S.random_spans(r["text"] or "", [x[:2] for x in by_hand(r["text"] or "")], models)], key=lambda x: (x[0], x[2]))) for r in docs.collect()}
    assert {r["doc_id"]: r["spans"] for r in queries.op5_secrets(spark, "/root/testdata/sf0.001").collect()} == want


def learnt_by_hand(texts):
    """The model of text from all texts, word by word."""
    import math
    import re

    import numpy as np

    docs = []
    for t in texts:
        own = np.zeros((26, 26))
        for w in re.findall(r"[A-Za-z]{3,20}", t):
            for a, b in zip(w.lower(), w.lower()[1:]):
                own[ord(a) - 97, ord(b) - 97] += 1
        docs.append(own)
    counts = np.ones((26, 26)) + sum(docs)
    bits = np.log2(counts / counts.sum(1, keepdims=True) * 26)
    mean = float((counts * bits).sum() / counts.sum())
    var = float((counts * (bits - mean) ** 2).sum() / counts.sum())
    off = [((d * bits).sum() / d.sum() - mean) ** 2 - var / d.sum() for d in docs if d.sum() >= 100]
    return [*bits.ravel(), *(counts.sum(0) / counts.sum()), mean, math.sqrt(var), max(S.SPREAD, math.sqrt(max(0.0, sum(off) / len(off))))]


def test_the_model_of_text_is_learnt_from_every_document(spark):
    """2,600 documents, of which the last letters of the alphabet stand in a few: a sample of 2,000 gives other counts."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("etaoin" if i % 13 else "zxqvwj") for _ in range(rng.randint(1, 45))) for _ in range(12)) + " é abcé" for i in range(2_600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got, *rest = S.train(docs)
    assert not rest and [*got.bits.ravel(), *got.share, got.mean, got.pair_sd, got.text_sd] == pytest.approx(learnt_by_hand(texts), abs=1e-6)
