"""Counts by the real vocabulary against an independent tokenizer, and the automaton's order of matches."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from folia.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def real():
    from tokenizers import Tokenizer, models

    vocabulary, by_bytes = token_counts.read_vocabulary(PATH)
    least = min(s for _, s in vocabulary)
    pieces = [("<unk>", least), *vocabulary, *((f"<0x{i:02X}>", least) for i in range(256))]
    return token_counts.Counter(vocabulary, by_bytes, 10_000), Tokenizer(models.Unigram(pieces, 0, True))


def texts() -> list[str]:
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyzABCéüñß,.;:-'()0123456789\n\t  한글漢字🙂́\x00")
    return ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 120, 300)] + ["a" * 3000, "  lead", "tail  ", "\n\n\n", "한" * 50, "🙂🙂", "▁x▁ y", "word.\nNext word.\n\nLast"]


def test_counts_equal_an_independent_tokenizer(real):
    ours, theirs = real
    for t in texts():
        assert ours.count(t) == len(theirs.encode("▁" + t.replace(" ", "▁")).ids), repr(t)


def test_chunks_hold_the_whole_text(real):
    for t in texts():
        t = " " + t.replace("▁", " ")
        assert "".join(real[0].chunks.findall(t)) == t


def test_whole_texts_cut_in_chunks_score_as_one(real):
    for t in texts()[:60]:
        marked = (" " + t.replace("▁", " ")).replace(" ", token_counts.SPACE)
        assert real[0].count(t) == real[0].viterbi(marked)[1]


def test_documents_equal_an_independent_tokenizer(spark, real):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == (len(real[1].encode("▁" + r["text"].replace(" ", "▁")).ids) if r["text"] else 0)


def test_nothing_to_count_and_very_long_texts(spark, real):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", "z")], "doc_id long, text string, n_tokens string")
    got = token_counts.count(rows, PATH)
    assert got.columns == ["doc_id", "n_tokens"] and sorted(r["n_tokens"] for r in got.collect()) == [0, 0, 0, 2]
    assert token_counts.count(rows.limit(0), PATH).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000)], "doc_id long, text string")
    assert token_counts.count(long, PATH).first()["n_tokens"] == len(real[1].encode("▁word" * 400_000 + "▁").ids)
