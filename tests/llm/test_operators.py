"""Each operator against a brute-force version on small tables, with nulls, empty, long, tied and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from folia.llm import bpe, decontaminate, fingerprints, html_text, jaccard, quality, repeats, secrets, textkit, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefghéß"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


LONG = prose(9000, 1)
BASE = prose(150, 2)
NEAR = BASE.replace(BASE.split()[70], "changed", 1)
TEXTS = [None, "", "one", "Two words", BASE, BASE, NEAR, LONG, prose(40, 4) + " " + BASE[:600], "x" * 900, "été " * 300, prose(200, 5), "  \n ", "🙂 " + prose(30, 6), NEAR + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[7], (None, BASE, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_words_and_hashes_do_not_depend_on_place():
    buf, offs = textkit.from_texts([b"", b"ab cd", b"zz ab cd", b""])
    s, e, row = textkit.runs(textkit.WORD[buf].view(np.int8), offs)
    h = textkit.span_hash(textkit.prefix_hash(buf), s, e)
    assert row.tolist() == [1, 1, 2, 2, 2] and h[0] == h[3] and h[1] == h[4] and h[0] != h[2]


def test_bpe_equals_the_tokenizer_library(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, own.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in got) == want
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS}
    assert {r["decoded_sha256"] for r in got} == texts
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_appends_and_edits():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = bpe.PrefixBpe(ranks)
    r = np.random.default_rng(0)
    for _ in range(200):
        s = "".join(r.choice(list("abcde éß한x🙂"), r.integers(1, 60))).encode()
        last = enc.extend(s, [])
        assert enc.read(last) == [ranks[p] for p in enc.merge(s)]
        more = enc.extend(s + b"the end", list(last))
        assert enc.read(more) == [ranks[p] for p in enc.merge(s + b"the end")]
        a = int(r.integers(0, len(s) + 1))
        b = int(r.integers(a, len(s) + 1))
        text, edited = enc.edit(s, last, a, b, b"new")
        assert text == s[:a] + b"new" + s[b:] and edited == enc.extend(text, [])


def test_bpe_splits_odd_characters_as_the_pattern_says():
    import regex

    split = bpe.Splitter(public_tokenizers.PATTERN)
    for t in ["½²Ⅳ 一二 x'll 're 'S", "a\u0085b  c", "_ _a 1_2", "  end  ", "\n\n x\t\ty", "🙂 é́"]:
        assert split.findall(t) == regex.findall(public_tokenizers.PATTERN, t)


def test_token_counts_equal_a_unigram_tokenizer(docs):
    from tokenizers import Tokenizer, models

    vocabulary = [("▁", -3.0), ("▁a", -2.0), ("a", -2.5), ("b", -2.5), ("ab", -5.0), ("▁ab", -4.5), ("bc", -1.0), ("c", -2.0), ("abc", -3.5), ("▁▁", -1.0)]
    ours = token_counts.Counter(vocabulary, False, 100)
    theirs = Tokenizer(models.Unigram([("<unk>", -20.0), *vocabulary], 0, False))
    for t in ["abc", "ab c", "a  b", "abcabc xx yx", "a", " ", "xyz abc  ", "ß" * 5]:
        assert ours.count(t) == len(theirs.encode("▁" + t.replace(" ", "▁")).ids), t
    got = token_counts.count(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["n_tokens"] for r in got.where("doc_id in (0, 1)").collect()} == {0}
    assert got.count() == docs.count()


def test_secrets_over_tables(docs, empty):
    got = secrets.scan(docs.withColumn("spans", docs["n_chars"])).collect()
    assert len(got) == docs.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan(empty).count() == 0
    cut = secrets.redact(docs).collect()
    assert sorted((r["text"] or "") for r in cut) == sorted((r["text"] or "") for r in docs.collect())


def test_redaction(spark):
    df = spark.createDataFrame([(1, "token=abcdef token=ghijkl end", 7)], "doc_id long, text string, n_chars long")
    r = secrets.redact(df).first()
    assert r["text"] == "[secret] [secret] end" and r["n_chars"] == len(r["text"])


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[10:40])), (2, BASE), (3, "two WORDS"), (10, "one"), (4, None), (5, ""), (6, prose(30, 77)), (1, " ".join(BASE.split()[10:40]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in docs.collect():
        w, hit, names = words(r["text"]), set(), set()
        for i, t in items:
            v = words(t)
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        names.add(str(i))
        want.append((r["doc_id"], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=key) == sorted(want, key=key)
    limit = decontaminate.BROADCAST_LIMIT
    try:
        decontaminate.BROADCAST_LIMIT = 0  # the way for large benchmarks gives the same
        assert sorted(map(tuple, decontaminate.report(docs, bench).collect()), key=key) == sorted(want, key=key)
    finally:
        decontaminate.BROADCAST_LIMIT = limit
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("n_hit > 0").count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_of_repetitive_texts_equals_sql(spark, monkeypatch, limit):
    import duckdb
    from folia.llm import queries

    phrases = [["aa"], prose(2, 50).split(), prose(7, 51).split(), prose(8, 52).split(), prose(9, 53).split(), prose(12, 54).split(), prose(20, 55).split()]
    texts = [prose(lead, 60 + lead).split()[:lead] + p * n + prose(5, 70).split() for p in phrases for n in (2, 3, 60) for lead in (0, 1, 9, 13)]
    texts += [["aa"] * 500, ["aa"] * 22, [w for w in prose(30, 56).split() for _ in range(2)]]
    items = [(f"{i}", " ".join((p * 13)[:13])) for i, p in enumerate(phrases)] + [("long", " ".join(phrases[2] * 4)), ("twice", " ".join(texts[-1]))]
    frames = {"documents": spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "benchmark": spark.createDataFrame(items, "item_id string, text string")}
    duck = duckdb.connect()
    for name, df in frames.items():
        duck.register(name, df.toPandas())
    want = sorted(duck.execute(queries.OP4).fetchall())
    monkeypatch.setattr(decontaminate, "BROADCAST_LIMIT", limit)
    assert sorted(map(tuple, decontaminate.report(*frames.values()).collect())) == want
    assert [r[2] for r in want if r[0] == len(texts) - 3] == [500]


def test_jaccard_join(docs, empty):
    got = {r["doc_id"]: r for r in jaccard.join(docs.withColumn("class_id", docs["n_chars"])).collect()}
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    links = {i: 0 for i, _ in sets}
    up = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets):
            if a != b and x and y and 10 * len(x & y) >= 8 * len(x | y):
                links[i] += 1
                up = {k: min(up[i], up[j]) if v in (up[i], up[j]) else v for k, v in up.items()}
    per_row = {i: n // sum(k == i for k, _ in sets) for i, n in links.items()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (up[i], per_row[i]) for i in up}
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == set(up.values())


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard._least_matches()
    assert all(m <= jaccard.THRESHOLD * n for m, n in zip(least, range(jaccard.STEP, jaccard._N + 1, jaccard.STEP)))


def test_blocks_of_large_groups_give_the_same(spark, docs):
    block, size = jaccard.BLOCK, jaccard.BLOCK_BYTES
    many = spark.createDataFrame([(i, BASE.replace(BASE.split()[i % 9], f"w{i}", 1)) for i in range(60)], "doc_id long, text string")
    whole = sorted(map(tuple, jaccard.join(many).collect()))
    try:
        jaccard.BLOCK = 7
        assert sorted(map(tuple, jaccard.join(many).collect())) == whole
        jaccard.BLOCK, jaccard.BLOCK_BYTES = block, 9000  # some seven sets
        assert sorted(map(tuple, jaccard.join(many).collect())) == whole
    finally:
        jaccard.BLOCK, jaccard.BLOCK_BYTES = block, size
    assert {r[1] for r in whole} == {0}


def brute_repeats(texts, span):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], []).append((k, i))
    out = []
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1)
        out.append((len(t), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("places", [20_000, 2])
def test_repeats(docs, empty, places):
    rows = docs.collect()
    want = brute_repeats([(r["text"] or "").encode() for r in rows], repeats.SPAN)
    before = repeats.PLACES
    try:
        repeats.PLACES = places
        got = repeats.remove(docs.withColumn("key", docs["n_chars"])).collect()
        short = repeats.report(docs).collect()
    finally:
        repeats.PLACES = before
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expect = sorted(((r["doc_id"], *w) for r, w in zip(rows, want)), key=key)
    assert sorted((tuple(r)[:5] for r in got), key=key) == expect
    assert sorted((tuple(r)[:5] for r in short), key=key) == expect
    assert all(r["repeated"] == (r["n_removed"] > 0) for r in (*short, *got))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.report(empty).count() == 0


def test_no_task_gathers_an_anchor_of_many_places(spark, monkeypatch):
    settle, places = repeats._settle, 20

    def counted(batches):
        seen, batches = {}, list(batches)
        for b in batches:
            for r in b.to_pylist():
                group = seen.setdefault((r["anchor"], r.get("share")), set())
                group |= {(r["content"], r["owners"][x : x + 24]) for x in range(0, len(r["owners"]), 24)}
                assert len(group) <= places
        yield from settle(iter(batches))

    phrase, tails = prose(70, 200)[:330], [prose(60, 201 + i) for i in range(6)]
    texts = [prose(80, 300 + i) + " " + phrase + (tails[i % 6] if i % 3 == 0 else prose(60, 500 + i)) for i in range(60)]
    texts += [BASE + prose(20, 600 + i) for i in range(30)] + [phrase + "yz" * 600]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = brute_repeats([t.encode() for t in texts], repeats.SPAN)
    monkeypatch.setattr(repeats, "PLACES", places)
    monkeypatch.setattr(repeats, "_settle", counted)
    got = sorted(tuple(r)[:5] for r in repeats.report(df).collect())
    assert got == [(i, *w) for i, w in enumerate(want)]


def test_anchors_of_parts_equal_those_of_the_whole(docs):
    part = repeats._PART
    try:
        repeats._PART = 1000
        got = sorted((r["doc_id"] or -1, r["n_removed"], r["kept_sha256"]) for r in repeats.report(docs).collect())
    finally:
        repeats._PART = part
    assert got == sorted((r["doc_id"] or -1, r["n_removed"], r["kept_sha256"]) for r in repeats.report(docs).collect())


def test_fingerprints(docs, empty):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    got = fingerprints.compare_edited(docs).collect()
    want = []
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, x = r["text"] or "", nxt["text"] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + x[:h]
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert fingerprints.compare_edited(empty).count() == 0
    a, b = (fingerprints.sketches(*textkit.from_texts([t.encode()]))[0] for t in (LONG, LONG[: len(LONG) * 2 // 3]))
    x, y = shingles(LONG), shingles(LONG[: len(LONG) * 2 // 3])
    assert abs(fingerprints.resemblance(a, b) - len(x & y) / len(x | y)) < 0.15
    assert abs(fingerprints.distinct(a) / len(x) - 1) < 0.35
    assert abs(fingerprints.containment(b, a) - 1) < 0.3
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    half, rest = LONG[:20000], LONG[20000:]
    parts = [fingerprints.sketches(*textkit.from_texts([t.encode()]))[0] for t in (half, rest)]
    assert len(np.intersect1d(fingerprints.merge(*parts), a)) >= 120
    named = fingerprints.fingerprint(docs.withColumn("fingerprint", docs["lang"]))
    assert named.columns == [*docs.columns, "fingerprint"]


def test_next_documents_for_any_number_of_ranges(docs):
    want = sorted((r["text"], r["next_text"]) for r in fingerprints.with_next(docs, 1).collect())
    for p in (2, 5, 30):
        assert sorted((r["text"], r["next_text"]) for r in fingerprints.with_next(docs, p).collect()) == want


def labelled(spark, label):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(60, 1000 + i)
        if bad:
            t = " ".join(f"{w}!!" for w in t.split()) if label == "quality" else t.replace(" ", " numskull ", 3)
        rows.append((i, t, "en", "s", len(t)))
        marks.append((i, int(bad == (label == "toxic")), int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "x", None, None, None)]
    marks += [(1000, None, None), (None, 1, 1), (0, marks[0][1], marks[0][2])]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, spark.createDataFrame([(i, q if label == "quality" else 1, t) for i, q, t in marks], "doc_id long, quality int, toxic int")


def test_quality(spark, empty):
    docs, labels = labelled(spark, "quality")
    got = [r for r in quality.classify(docs.withColumn("score", docs["n_chars"]), labels).collect()]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in known)
    test = [r for r in known if r["held_out"]]
    assert np.mean([(r["predicted"] == 0) == (r["doc_id"] % 4 == 0) for r in test]) > 0.95
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == docs.count()


def test_toxicity(spark, empty):
    docs, labels = labelled(spark, "toxic")
    got = toxicity.classify(docs, labels).collect()
    test = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in test)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in test]) > 0.95
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.classify(docs, labels.where("false")).count() == docs.count()


def test_string_kernel_counts_gapped_subsequences():
    from itertools import combinations

    def slow(s, t):
        total = 0.0
        for i in combinations(range(len(s)), toxicity.P):
            for j in combinations(range(len(t)), toxicity.P):
                if all(s[a] == t[b] for a, b in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    mark, word = b"idiot", b"id*iots"
    wide = b"  " + word + b"  "
    rows = toxicity.matrix(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    want = (slow(wide, mark) / (slow(mark, mark) * slow(wide, wide)) ** 0.5) ** toxicity.POWER
    assert abs(float(toxicity.kernel(rows, mark)[0]) - want) < 1e-4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>First  para
with <b>bold</b> &lt;x&gt;.<br>After</p><p>Second.</p><div class="comments"><p>nice post</p></div></article><aside>Related</aside><form><input value="x"><label>Name</label></form><footer>&copy; me</footer></body></html>"""


def test_html_text(spark):
    w = html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert html_text.main_text(PAGE, w) == "Head & line\nFirst para with bold <x>. After\nSecond."
    assert html_text.main_text(None, w) == "" == html_text.main_text("", w) == html_text.main_text("<html>", w)
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (1, "u", PAGE), (4, "v", "<p>" + "word. " * 20000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages.withColumn("text", pages["url"])).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" == got[3]["text"] and got[4]["n_chars"] > 100_000
    assert html_text.extract(pages.where("false")).count() == 0


def test_minimum_cut_is_the_cheapest_labelling():
    from itertools import product

    r = np.random.default_rng(8)
    for _ in range(60):
        n = int(r.integers(1, 8))
        bias = r.normal(0, 1, n).tolist()
        ties = [(int(a), int(b), float(r.random())) for a, b in r.integers(0, n, (10, 2)) if a != b]
        cost = lambda x: sum(max(0, b) if not v else max(0, -b) for b, v in zip(bias, x)) + sum(w for a, b, w in ties if x[a] != x[b])  # noqa: B023,E731
        assert abs(cost(html_text.cut(bias, ties)) - min(map(cost, product([False, True], repeat=n)))) < 1e-9


def test_quality_learns_from_every_label(spark, monkeypatch):
    """A mark of bad texts that stands in the last part of the labels only: each part, and each slice of one, adds its share to the mean."""
    docs, labels = labelled(spark, "quality")
    monkeypatch.setattr(quality, "PART", 20)
    got = quality.train(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    own = sorted(i for i in rows if i in marks and zlib.crc32(str(i).encode()) % 5)
    parts = -(-len(own) // 20)
    ids = spark.createDataFrame([(i,) for i in own], "doc_id long")
    dealt = ids.selectExpr("doc_id", f"pmod(xxhash64(7, doc_id), {parts}) AS part", "xxhash64(doc_id) AS h").orderBy("part", "h").collect()
    want, n = np.zeros((1 << quality.BITS) + 1), 0
    for p in range(parts):
        mine = [r["doc_id"] for r in dealt if r["part"] == p]
        buf, offs = quality.tk.from_texts([(rows[i] or "").encode() for i in mine])
        vectors = [(at, x.astype(np.float32), marks[i]) for i, (at, x) in zip(mine, quality.vectors(buf, offs))]
        want += quality.learn(vectors).astype(np.float32) * len(mine) if mine else 0
        n += len(mine)
    assert n == len(own) and parts > 4 and np.allclose(got, want / n, atol=1e-6)
    monkeypatch.setattr(quality, "PLACES", 500)  # several models a part
    assert np.abs(quality.train(docs, labels)).sum() > 0


def test_quality_takes_more_labels_than_a_sample_held(spark):
    """17,000 labelled rows; the rows by which bad texts can be told are those with the largest hashes, which a sample of 16,000 left out."""
    ids = spark.range(22_000).where("crc32(cast(cast(id AS string) AS binary)) % 5 <> 0").selectExpr("id AS doc_id", "row_number() OVER (ORDER BY xxhash64(id), id) AS r").where("r <= 17000")
    docs = ids.selectExpr("doc_id", "CASE WHEN r > 16000 THEN 'zzyzx marker' ELSE 'plain words' END AS text", "r")
    labels = ids.selectExpr("doc_id", "CASE WHEN r > 16000 THEN 0 ELSE 1 END AS quality")
    weights = quality.train(docs.drop("r"), labels)
    got = quality.score(spark.createDataFrame([(1, "zzyzx marker"), (2, "plain words")], "doc_id long, text string"), weights).collect()
    assert {r["doc_id"]: r["score"] >= quality.THRESHOLD for r in got} == {1: False, 2: True}


def test_no_worker_keeps_an_encoder(spark, docs):
    """Pieces and tables of the encoder go with its tasks: stages that follow in the same Python processes have their memory."""
    import pandas as pd
    import public_tokenizers

    bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count()

    def kept(frames):
        import gc

        for _ in frames:
            pass
        gc.collect()
        yield pd.DataFrame({"n": [sum(type(o).__name__ in ("PrefixBpe", "_Pieces") for o in gc.get_objects())]})

    assert sum(r["n"] for r in spark.range(4).repartition(4).mapInPandas(kept, "n long").collect()) == 0
