"""Edges of pages, bundles of forms, stores, batches, changes and overlaps against literal cases and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.operators import bundles as B
from folia.operators import search as S
from folia.operators import catalog as C
from folia.operators import edges as E
from folia.operators import storage as R


def test_pages_lose_headers_numbers_and_trailing_markers(spark):
    pages = [
        ["학교 업무 매뉴얼 11", "첫째 글", "Ⅱ . 교무 ‧ 연구"],
        ["12", "학교 업무 매뉴얼", "둘째 글", "IV. 부록", "Ⅱ . 교무 ‧ 연구"],
        ["학교 업무 매뉴얼", "13", "셋째 글", "IV. 부록"],
        ["학교 업무 매뉴얼 99", "넷째 글", "Ⅸ. 한 번"],
        ["15", "다섯째 글"],
        [],
        ["Ⅱ . 교무 ‧ 연구"],
    ]
    df = spark.createDataFrame([("b", i + 1, x) for i, x in enumerate(pages)] + [("c", 1, ["7", "alone"]), ("c", 2, None)], "book string, page int, lines array<string>")
    got = {(r["book"], r["page"]): tuple(r)[2:] for r in E.strip_pages(df).collect()}
    # a number above the header isn't read; 99 disagrees with the offset of three others only if they are three
    assert got["b", 1] == (11, "Ⅱ. 교무‧연구", "학교 업무 매뉴얼", "첫째 글")
    assert got["b", 2] == (None, "Ⅱ. 교무‧연구", "학교 업무 매뉴얼", "둘째 글\nIV. 부록")  # one page ends with it
    assert got["b", 3] == (13, "", "학교 업무 매뉴얼", "셋째 글\nIV. 부록")
    assert got["b", 4] == (99, "", "학교 업무 매뉴얼", "넷째 글\nⅨ. 한 번")
    assert got["b", 5] == (None, "", "", "다섯째 글")
    assert got["b", 6] == (None, "", "", "")
    assert got["b", 7] == (None, "Ⅱ. 교무‧연구", "", "")
    assert got["c", 1] == (None, "", "", "alone") and got["c", 2] == (None, "", "", "")
    more = spark.createDataFrame([("b", i + 1, [f"머리말 {i + 11 if i != 2 else 77}", f"글 {i}"]) for i in range(5)], "book string, page int, lines array<string>")
    assert [r["printed"] for r in E.strip_pages(more).orderBy("page").collect()] == [11, 12, None, 14, 15]
    assert E.strip_pages(df.limit(0)).count() == 0


def test_lines_in_margins(spark):
    rows = []
    for p in range(1, 5):
        rows += [("b", p, 0, "안내서", 800.0, True), ("b", p, 1, str(p + 4), 801.0, True), ("b", p, 2, "본문의 글", 500.0, False), ("b", p, 3, "Ⅲ. 교무", 90.0, False), ("b", p, 4, str(p), 30.0, True)]
    rows += [("b", 5, 0, "3", 801.0, True), ("b", 5, 1, "Ⅳ. 끝", 90.0, False)]
    lines = spark.createDataFrame(rows, "book string, page int, line int, text string, y double, marginal boolean")
    pages = spark.createDataFrame([("b", p) for p in range(1, 7)], "book string, page int")
    got = [tuple(r)[1:] for r in E.strip_margins(lines, pages).orderBy("page").collect()]
    assert got[:4] == [(p, p + 4, "Ⅲ. 교무", "안내서", "본문의 글") for p in range(1, 5)]
    assert got[4:] == [(5, None, "", "", "Ⅳ. 끝"), (6, None, "", "", "")]


def test_bundles_are_matched_in_order_and_wrap(spark):
    texts = ["여는 쪽", "가정통신문 양식 1", "신청서 (예시2) 가", "가정통신문 양식 2", "신 청 서 가"]
    pages = spark.createDataFrame([("d", i, None if i == 3 else i + 10, t) for i, t in enumerate(texts)] + [("e", 0, None, "신청서 가")], "doc_id string, n int, pdf_page int, text string")
    names = ["가정통신문 양식", "신청서 가 (예시)", "가정통신문", "여는쪽", "없는 서식", "가"]
    forms = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(names)] + [("e", 1, "신청서 가"), ("f", 1, "신청서 가")], "doc_id string, form_no int, text string")
    matched = B.match_bundle(forms, pages)
    got = {(r["doc_id"], r["form_no"]): (r["page"], r["found"]) for r in matched.collect()}
    assert got == {("d", 1): (11, True), ("d", 2): (12, True), ("d", 3): (4, True), ("d", 4): (10, True), ("d", 5): (None, False), ("d", 6): (None, False), ("e", 1): (None, True), ("f", 1): (None, False)}
    report = {r["doc_id"]: tuple(r)[1:] for r in B.bundle_report(matched).collect()}
    assert report == {"d": (6, 4, [5, 6]), "e": (1, 1, []), "f": (1, 0, [1])}


def batches_by_loop(sizes, limit):
    held = number = 0
    for x in sizes:
        yield number
        held += x or 0
        if held >= limit:
            held, number = 0, number + 1


@pytest.mark.parametrize("limit", [1, 7, 60, 10_000])
def test_batches_do_not_depend_on_ranges(spark, limit):
    r = np.random.default_rng(limit)
    rows = [("hot" if i % 4 else f"g{i % 12}", i, int(x) if x else None, "more") for i, x in enumerate(r.integers(0, 25, 600) * (r.random(600) < 0.9))]
    df = spark.createDataFrame(rows, "own string, place long, size long, total string").repartition(5)
    got = {x["place"]: x["batch"] for x in R.batches(df, "own", "place", "size", limit).collect()}
    for g in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == g]
        assert [got[x[1]] for x in own] == list(batches_by_loop([x[2] for x in own], limit))
    assert R.batches(df.limit(0), "own", "place", "size", limit).count() == 0


def test_jumps_equal_a_walk():
    r = np.random.default_rng(1)
    for _ in range(300):
        sizes, limit = r.integers(0, 15, r.integers(1, 12)) * (r.random() < 0.9), int(r.integers(1, 30))
        jumps = R._jumps(sizes, limit)
        for held in range(limit):
            own = jumps.iloc[int(np.searchsorted(jumps["at"].to_numpy(), held, "right")) - 1]
            numbers = list(batches_by_loop([held, *sizes], limit))
            end, n = held, 0
            for x in sizes:
                end += x
                end, n = (0, n + 1) if end >= limit else (end, n)
            assert numbers and ((held + own["total"], 0) if own["held"] < 0 else (own["held"], own["closed"])) == (end, n)


def test_stores_are_kept_then_filled_in_order(spark):
    r = np.random.default_rng(3)
    files = [("s" if i % 3 else "t", i, 1000 + i, int(r.integers(0, 60)), "pdf", [None, None, "store_2026_2", "store_2025_1", "other_2026_9"][i % 5]) for i in range(150)] + [("s", 999, 1, 5000, "hwp", None), ("s", 1000, 2, None, "hwp", None)]
    used = [("s", "store_2026_1", 95), ("s", "store_2026_2", 40), ("s", "store_2026_2", 30), ("u", "store_2026_1", 10)]
    got = R.plan_storage(spark.createDataFrame(files, "site string, place int, doc_id long, bytes int, format string, store string").repartition(4), spark.createDataFrame(used, "site string, store string, bytes long"), 2026, 100)
    plan = {r["doc_id"]: (r["store"], r["path"]) for r in got.collect()}
    for site in "st":
        room = {}
        for s, store, size in used:
            if s == site:
                room[store] = room.get(store, 0) + size
        for _, _, doc, size, kind, store in sorted((f for f in files if f[0] == site), key=lambda f: f[1]):
            size = size or 0
            names = [store] if store and store.endswith(("2026_2", "2026_9")) else []
            names += [f"store_2026_{n}" for n in range(1, 51)]
            at = next((n for n in names if room.get(n, 0) + size <= 100), "store_2026_51")
            room[at] = room.get(at, 0) + size
            assert plan[doc] == (at, f"files/{doc}.{kind}")
    assert plan[1][0] == "store_2026_51" and len(plan) == len(files)


def test_changes_since_marks(spark):
    commits = spark.createDataFrame([(i, i // 2) for i in range(30)], "sha long, at int")
    mine = spark.createDataFrame([("a", i) for i in range(20, 30)] + [("b", 3)], "client string, sha long")
    watch = spark.createDataFrame([("a", 19), ("b", 25), ("c", None), ("d", 77), ("e", 29)], "client string, mark long")
    for span in (1, 4, 1000):
        seen, state = C.unseen_changes(commits, mine, watch, span)
        own = {}
        for r in seen.collect():
            own.setdefault(r["client"], []).append(r["sha"])
        assert {k: sorted(v) for k, v in own.items()} == {"b": [26, 27, 28, 29], "d": list(range(30))}
        assert {r["client"]: tuple(r)[1:] for r in state.collect()} == {"a": (29, False, False), "b": (25, False, False), "c": (29, False, True), "d": (77, True, False), "e": (29, False, False)}
    none = commits.limit(0)
    assert C.unseen_changes(none, mine, watch)[0].count() == 0


def test_overlaps_of_parts():
    r = np.random.default_rng(5)
    for _ in range(400):
        a, b = ("".join(r.choice(list("ab"), r.integers(0, 90))) for _ in range(2))
        if r.random() < 0.6:
            b = a[len(a) - int(r.integers(0, len(a) + 1)) :] + b
        slow = next((i for i in range(min(len(a), len(b), C.OVERLAP_MAX), C.OVERLAP_MIN - 1, -1) if a[-i:] == b[:i]), 0)
        assert C.overlap(a, b) == slow
    assert C.overlap("x" * 700, "x" * 900) == 600 and C.overlap("", "x") == 0


def test_hosts_and_folders_in_decomposed_letters(spark):
    import unicodedata

    down = lambda t: unicodedata.normalize("NFD", t)
    rows = [("http://xn--%20a/b%20c", down("서식 (www.한글.kr)"), 1), ("http://%20/x", "none", 2), ("https://a.kr/%C2%B9%C3%BD%C2%B7%C3%89", "", 3), ("ftp://x", "", 4), ("http://a b/keep", "ww.b.com", 5)]
    got = {r["i"]: r["url"] for r in C.fix_url(spark.createDataFrame(rows, "url string, text string, i int")).collect()}
    assert got == {1: "http://www.한글.kr/", 2: "http://%20/x", 3: "https://a.kr/%EB%B2%95%EB%A0%B9", 4: "", 5: "http://www.b.com/keep"}
    meta = C.guess_meta(spark.createDataFrame([(down("초등/계획.pdf"),)], "path string"), [], [], []).first()
    assert meta["levels"] == ["초등"]
    assert spark.range(1).select(T.link_type(F.lit("보고 PPT"), F.lit("http://a/fileDown.do"))).first()[0] == "서식"


def test_search_reads_parts_of_lists_by_shard(spark, monkeypatch):
    from folia.operators import search as S
    from folia.operators import shards as H

    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcd"), 4)) for _ in range(25)]
    texts = [(lev, i * 7, " ".join(r.choice(words, 12))) for lev in ("en", "fr") for i in range(40)] + [("en", 999, ""), ("fr", 5, "x")]
    sections = spark.createDataFrame(texts, "level string, ref long, text string")
    queries = S.parse(spark.createDataFrame([(i, w) for i, w in enumerate([*words[:6], f"{words[0]} {words[1]}", "zz", "a", ""])], "q long, raw string"))
    want = {(q, lev, ref) for q, raw in ((x["q"], x["terms"]) for x in queries.collect()) for lev, ref, t in texts if (g := {p for w in raw if len(w) > 1 for p in map("".join, zip(w, w[1:]))}) and g <= set(map("".join, zip(t.replace(" ", ""), t.replace(" ", "")[1:])))}
    for part in (10, 100_000):
        monkeypatch.setattr(H, "PART", part)
        index = H.write_index(H.postings(sections))
        assert {tuple(x) for x in H.candidates(queries, index).collect()} == want and want
        assert index.groupBy("level", "gram").count().agg(F.max("count")).first()[0] == (28 if part == 10 else 1)
    plan = index.where(F.col("shard").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "shard" in plan.split("PartitionFilters")[1][:80]


def test_whole_documents(spark):
    from folia.operators import documents as D
    from folia.plans.views import cut_by_length

    none = None
    docs = [("a", none, "2026_학교+계획.pdf", ["초등"], none, none, "2026", none, D.COMMON_SITE, "가, 나\n가"), ("b", " 표 ", "x.xlsx", [], none, " 감사관 ", none, none, none, none), ("c", none, "", [], none, none, none, "hwpx", none, none), ("d", "빈 자료", "d.pdf", [], none, none, none, none, none, none)]
    docs = spark.createDataFrame(docs, "doc_id string, title string, filename string, levels array<string>, category string, department string, year string, format string, site string, keywords string")
    long = "본문의 내용이 충분히 길게 이어지는 글입니다 그리고 더"
    apart = " ".join("연수계획서안내" * 6)
    blocks = [("a", 0, "표지 안내의 글이 길게 있는 쪽입니다", 1, none), ("a", 1, f"1. 첫째 업무\n{long}", 2, 5), ("a", 2, f"2. 둘째 업무\n{long}", 3, 6), ("b", 0, "칸", 1, none), ("c", 0, apart, none, none)]
    blocks = spark.createDataFrame([(d, n, t, p, q, "", none) for d, n, t, p, q in blocks], "doc_id string, n int, text string, pdf_page int, printed_page int, footer_label string, lines array<struct<text:string,size:double>>")
    links = [("a", 0, 1, "http://x/fileDown.do?1", "서식"), ("a", 1, 1, "http://x/fileDown.do?1", "긴 서식"), ("a", 2, 2, "http://x/fileDown.do?1", "「서식"), ("a", 3, 2, "http://law.go.kr", ""), ("a", 4, 2, "http://x/download?2", "참고"), ("b", 0, 0, "http://x", "y")]
    links = spark.createDataFrame([(*x, 1.0, 2.0) for x in links], "doc_id string, i int, block int, url string, text string, left double, top double")
    got = {r["doc_id"]: r for r in D.create(docs, blocks, links, lambda b: cut_by_length(b, 1800)).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["title"], a["department"], a["year"], a["format"], a["kind"], a["keywords"]) == ("2026 학교 계획", D.COMMON_DEPARTMENT, 2026, "pdf", "text", ["가", "나"])
    assert [(s["id"], s["heading"], s["block_start"], s["block_end"], s["pdf_pages"], s["printed_pages"], s["untitled"]) for s in a["sections"]] == [("sec-001", "2026 학교 계획 (앞부분)", 0, 0, [1], [], False), ("sec-002", "첫째 업무", 1, 1, [2], [5], False), ("sec-003", "둘째 업무", 2, 2, [3], [6], False)]
    assert [(k["id"], k["s"], k["text"], k["type"], k["form_no"]) for k in a["links"]] == [("lnk-0001", 2, "긴 서식", "서식", 1), ("lnk-0002", 3, "서식", "서식", 1), ("lnk-0003", 3, "http://law.go.kr", "법령", None), ("lnk-0004", 3, "참고", "참고", 2)]
    assert [n["k"] for n in a["nodes"]].count("task") == 3 and a["warnings"] == [] and not a["toc_found"]
    assert (b["title"], b["department"], b["kind"], b["sections"], b["links"], b["warnings"], len(b["blocks"])) == ("표", "감사관", "link", [], [], [], 1)
    assert c["title"] == D.NO_TITLE and c["warnings"] == ["no contents", "spaced"] and c["blocks"][0]["text"] == "연수계획서안내" * 6 and c["sections"][0]["untitled"]
    assert d["warnings"] == ["scan"] and d["blocks"] == []


def shuffled(spark, df) -> int:
    """Bytes that executors write for shuffles while `df` is computed, as for tables too large to be sent whole."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before, key = written(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset(key)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written() - before


def test_bundles_shuffle_no_more_than_their_texts(spark):
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("가나다라마바사아자차abcde"), 4000)) for _ in range(60)]
    pages = spark.createDataFrame([("d", i, i + 1, t) for i, t in enumerate(texts)], "doc_id string, n int, pdf_page int, text string")
    names = [t[k : k + n] for k, (t, n) in enumerate(zip(texts, [3, 4, 6, 9, 10, 13, 14, 20] * 7))]
    forms = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(names)], "doc_id string, form_no int, text string")
    matched = B.match_bundle(forms, pages)
    assert shuffled(spark, matched) < 2 * sum(len(t.encode()) for t in texts)
    at, want = 0, []
    for name in names:
        held = [i for i, t in enumerate(texts) if name[:14] in t]
        at = next((i for i in held if i >= at), held[0])
        want.append(at + 1)
    assert [r["page"] for r in matched.orderBy("form_no").collect()] == want


def test_previews_shuffle_what_they_show(spark):
    r = np.random.default_rng(6)
    rows = [(1, i % 20, f"{i}.{i % 3}", "같은 앞부분의 아주 긴 제목이 여기에 서른네 글자가 넘도록 이어진다 " * (i % 2) + "".join(r.choice(list("가나다라마바사"), 3000))) for i in range(100)]
    peek = S.result_peek(spark.createDataFrame(rows, "q int, doc_id long, c string, t string"))
    assert shuffled(spark, peek) < sum(len(t) for *_, t in rows) / 10
    cut = lambda t: t if len(t) <= S.PEEK else t[: S.PEEK] + "…"
    for x in peek.collect():
        own = sorted(([int(n) for n in c.split(".")], t) for _, doc, c, t in rows if doc == x["doc_id"])
        assert (x["first"], x["second"], x["more"]) == (cut(own[0][1]), cut(own[1][1]), len(own) - 2)
