"""Extra columns with the operators' own names, nulls, repeated rows and empty tables through every stage and operator."""

from __future__ import annotations

import public_tokenizers
import pytest

from folia.llm import bpe, decontaminate, fingerprints, jaccard, quality, repeats, secrets, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EXTRA = ["_quality", "_key", "key", "score", "words", "id", "class_id", "spans", "bucket", "ids", "n_hit", "text_", "a`b", "c.d"]
GOOD = "the boats lay still against the long stone wall and the wind turned by noon while crews rowed out to the bar once more"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, GOOD), (1, GOOD), (2, GOOD + " again"), (3, None), (4, ""), (None, GOOD), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (6, "password=abcdefgh1 " + GOOD)]
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    for i, name in enumerate(EXTRA):
        df = df.withColumn(f"x{i}", df["doc_id"].cast("string"))
    return df.toDF("doc_id", "text", "n_chars", *EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, None), (None, "x y")], "item_id long, text string")


def stages(labels, benchmark):
    return {
        "quality": lambda d: quality.keep(d, labels), "near_duplicates": jaccard.keep_one, "decontamination": lambda d: decontaminate.clean(d, benchmark), "secrets": lambda d: secrets.redact(d, RANKS),
        "fingerprint": lambda d: fingerprints.fingerprint(d), "judge": lambda d: decontaminate.judge(d.drop("n_hit"), benchmark),
    }


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "secrets", "fingerprint", "judge"])
def test_columns_of_any_name_stay_as_they_are(docs, labels, benchmark, name):
    out = stages(labels, benchmark)[name](docs)
    at = [out.columns.index(n) for n in EXTRA if n in out.columns and (name, n) != ("judge", "n_hit")]
    assert len(at) >= len(EXTRA) - 1 and (name in ("fingerprint", "judge") or out.columns == docs.columns)
    rows = [tuple(r) for r in out.collect()]
    first = out.columns.index("doc_id")
    assert rows and all(r[i] == (None if r[first] is None else str(r[first])) for r in rows for i in at)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "secrets"])
def test_stages_over_empty_tables(docs, labels, benchmark, name):
    out = stages(labels, benchmark)[name](docs.limit(0))
    assert out.columns == docs.columns and out.count() == 0


def test_what_goes(docs, labels, benchmark):
    made = stages(labels, benchmark)
    ids = lambda df: sorted((r[0] is None, r[0] or 0) for r in df.collect())
    assert (False, 5) not in ids(made["decontamination"](docs)) and len(ids(made["decontamination"](docs))) == docs.count() - 1
    assert (False, 2) not in ids(made["near_duplicates"](docs)) and {(False, 1), (False, 3), (False, 4), (False, 5)} <= set(ids(made["near_duplicates"](docs)))
    assert "password" not in next(r["text"] for r in made["secrets"](docs).collect() if r["doc_id"] == 6)


def test_queries_pass_other_columns_over(docs, labels):
    n = docs.count()
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=False).count() == n
    assert toxicity.classify(docs, labels).count() == n and quality.classify(docs, labels).count() == n
    assert repeats.report(docs).count() == n and secrets.scan(docs, RANKS).count() == n


def test_no_labels_and_no_documents(docs, labels):
    got = toxicity.classify(docs, labels.limit(0)).collect()
    assert len({round(r["score"], 9) for r in got}) == 1 and toxicity.classify(docs.limit(0), labels).count() == 0
    assert len({round(r["score"], 9) for r in quality.classify(docs, labels.limit(0)).collect()}) == 1 and quality.classify(docs.limit(0), labels).count() == 0


def test_ties_and_very_long_texts(spark, labels):
    rows = spark.createDataFrame([(i, GOOD) for i in range(6)] + [(9, "word and other words " * 60_000)], "doc_id long, text string")
    for op in (toxicity.classify, quality.classify):
        got = {r["doc_id"]: r["score"] for r in op(rows, labels).collect()}
        assert len(got) == 7 and len({got[i] for i in range(6)}) == 1 and all(0 <= s <= 1 for s in got.values())


def test_names_differ_where_one_ring_collides():
    """Two words of 2,048 letters that every polynomial hash modulo 2^64 takes for equal."""
    import numpy as np

    from folia.llm import repeats as R
    from folia.llm import textkit as tk

    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    buf, offs = tk.from_texts([a.encode(), b.encode()])
    prefix = tk.prefix_hash(buf)
    assert len(set(tk.span_hash(prefix, offs[:-1], offs[1:]).tolist())) == 1
    assert len(set(R._name(buf, prefix, offs[:-1], offs[1:]).tolist())) == 2
    x = np.frombuffer(b"abcabcabc", np.uint8)
    h = tk.prime_hash(tk.prime_prefix(x), np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_the_string_kernel_is_valid():
    """Symmetric, of unit diagonal, and without negative eigenvalues."""
    import numpy as np

    from folia.llm import toxicity as X

    marks = [b" idiot ", b"idiot", b"moron", b" stupid", b"worthless ", b"dragon", b"oron", b" a ", b"aaaaaaaa"]
    gram = np.stack([X.kernel(X._wide(t)[None, :], u) for t in marks for u in marks]).reshape(len(marks), -1).astype(float)
    some = [i for i in range(len(marks)) if gram[i, i] > 0]
    gram = gram[np.ix_(some, some)]
    assert np.allclose(gram, gram.T, atol=1e-5) and np.allclose(np.diag(gram), 1, atol=1e-5) and np.linalg.eigvalsh((gram + gram.T) / 2).min() > -1e-6
