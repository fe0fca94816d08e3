"""Queries against DuckDB, and literal cases of the text functions that the tables don't hold."""

import os

import duckdb
import pytest
from folia import registry
from folia.functions import text as T
from folia.operators.matching import similar_keys
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
    else:
        want = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize(
    "text,want",
    [("1. 목적", True), ("가. 목적", True), ("(가) 목적", True), ("① 목적", True), ("제 2 장 총칙", True), ("◆ 안내", True), ("2026 계획", False), ("1인 1악기", False), ("3.5배", False), ("", False)],
)
def test_numbered_titles(spark, text, want):
    assert value(spark, T.is_numbered(F.lit(text))) is want


@pytest.mark.parametrize("text,want", [("학부모 상담을 실시해야 합니다.", True), ("신청 기한은 언제까지인가 합니까?", False), ("합니다", False), ("교육과정 운영 계획", False)])
def test_sentences(spark, text, want):
    assert value(spark, T.is_sentence(F.lit(text))) is want


@pytest.mark.parametrize("text,want", [("", True), ("커", True), ("운영 계획", False), ("CONTENTS", True), ("PART 1", False), ("Annual School Plan", False), ("ϡܐꓐꓑ 계획", True)])
def test_garbled_titles(spark, text, want):
    assert value(spark, T.is_garbled(F.lit(text))) is want


def test_numbers_and_types(spark):
    assert [value(spark, T.heading_number(F.lit(x))) for x in ("12. 가", "다) 나", "③ 다")] == [12, 3, 3]
    assert value(spark, T.link_type(F.lit("참가 신청서"), F.lit("https://a.kr/fileDown.do?x"))) == "서식"
    assert value(spark, T.link_type(F.lit("법"), F.lit("https://www.law.go.kr/x"))) == "법령"
    assert value(spark, T.page_label(F.array(F.lit(3), F.lit(5)), F.array(F.lit(1)))) == "PDF 3~5쪽(인쇄 1쪽)"
    assert value(spark, T.match_key(F.lit("2026 유치원 도움자료 (최종).pdf"))) == "유치원도움자료"
    assert value(spark, T.renew_title(F.lit("2026 도움자료 12026"), F.lit(2026), F.lit(2027))) == "2027 도움자료 12026"
    assert value(spark, T.clean_title(F.lit("출결 관리 ····· 12"))) == "출결 관리"


def test_clean_and_tidy(spark):
    assert value(spark, T.clean_text(F.lit("\ta​  b \r\n\r\n\r\n\r\n c\x07"))) == "a b\n\nc"
    long = "학교 폭력 예방 교육 실시: 학기마다 한 번 이상 전체 학생과 교직원을 대상으로 운영하고 결과를 남긴다"
    once = value(spark, T.tidy_title(F.lit(long)))
    assert once["title"] == "학교 폭력 예방 교육 실시" and value(spark, T.tidy_title(F.lit(once["title"])))["rest"] == ""


def test_codes_go_both_ways(spark):
    for own in ([], [0], [5, 3, 3, 1000], [36, 1_000_000, 7]):
        code = T.encode_postings(F.array(*map(F.lit, own)).cast("array<bigint>"))
        assert list(value(spark, T.decode_postings(code))) == sorted(set(own))


def test_spaced_texts_are_whole(spark, tmp_path):
    plain, apart = "An ordinary line of words. " * 40 + "its end", "학 교 생 활 안 내 서 의 " * 60 + "끝 말"
    texts = dict(zip((1, 2, 3, 5, 6, 7), [apart, plain, None, "", plain + "\n" + plain, apart]))  # every fourth gets a foreword
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in registry.queries()["repair_spaced_docs"](spark, str(tmp_path)).collect()}
    bare = lambda t: (t or "").replace(" ", "")
    assert sorted(got) == list(texts) and all(bare(got[i]) == bare(t) for i, t in texts.items())
    assert got[2] == plain and got[1] == got[7] and len(got[1]) < len(apart)
    joined = {(r["doc_id"], r["n"]): r["text"] for r in registry.queries()["join_spaced"](spark, str(tmp_path)).collect()}
    lines = {(i, n): x.strip() for i, t in texts.items() for n, x in enumerate((t or "").splitlines())}
    assert {k: bare(v) for k, v in joined.items()} == {k: "연수계획서" + bare(x) for k, x in lines.items()}


def test_references_of_long_documents_are_their_own(spark):
    from folia.plans.index_queries import postings, refs

    docs = spark.createDataFrame([(i, ["en"] if i else ["en", "fr"], 2024, f"t{i}") for i in range(3)], "doc_id long, levels array<string>, year int, title string")
    sizes = [2500, 3, 1001]
    sections = spark.createDataFrame([(i, s, "ab") for i, n in enumerate(sizes) for s in range(n)], "doc_id long, s int, text string")
    own = refs(docs, sections)
    got = {(r["level"], r["doc_id"], r["s"]): r["ref"] for r in own.collect()}
    assert len(got) == sum(sizes) + sizes[0] == len({(k[0], v) for k, v in got.items()})
    assert all(v == k[1] * 1000 + k[2] for k, v in got.items() if k[2] < 1000) and got["en", 0, 1000] == 3000 and got["en", 2, 1000] == 5000
    assert {r["level"]: len(r["refs"]) for r in postings(own).collect()} == {"en": sum(sizes), "fr": sizes[0]}


def test_similar_keys_equal_brute_force(spark):
    from collections import Counter

    keys = ["abcdef", "abcdeg", "abcabc", "bcabca", "xyz", "xyzz", "aaaa", "aaaaa", "a", "hello world", "hello worlds", "abcdefgh"]

    def dice(a, b):
        x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
        return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)

    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r[0], r[1]) for r in similar_keys(df, df).collect()}
    long = [k for k in keys if len(k) > 1]
    assert got == {(a, b) for a in long for b in long if a == b or dice(a, b) >= 0.72}
