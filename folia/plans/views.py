"""Catalog views over the parquet tables, once as DataFrames and once as SQL for comparison.

Documents become catalog entries with a title (the first sentence of the first line), levels, a department, a
year and keywords; their lines become blocks; blocks are cut into sections by length; anchors of pages become links.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from folia.functions import text as T
from folia.operators.numbering import number
from folia.sources.tables import table

LIMIT = 300
COMMON = "common"
LEVELS = ["en", "fr", "de", "es", COMMON]


def docs_v(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    last = F.filter(F.split(F.element_at(F.split("text", "\n"), -1), " "), lambda w: w != "")
    return docs.select(
        "doc_id",
        F.trim(F.split_part(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("."), F.lit(1))).alias("title"),
        F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(COMMON))).otherwise(F.array("lang")).alias("levels"),
        F.col("source").alias("department"),
        (2024 + F.col("doc_id") % 3).cast("int").alias("year"),
        F.element_at(F.array(*map(F.lit, ("pdf", "hwpx", "xlsx", "hwp"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("format"),
        F.col("n_chars").alias("bytes"),
        F.col("doc_id").alias("created_at"),
        F.array_distinct(F.slice(last, 1, 2)).alias("keywords"),
    )


def blocks_v(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, text): trimmed lines that aren't empty, numbered from 0."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("n", "text"))


@F.pandas_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("s", "block_start", "block_end")])))
def _by_length(sizes: pd.Series, limit: pd.Series) -> pd.Series:
    """A document's sections: a new one begins once the running length is beyond the limit."""
    out = []
    for own, most in zip(sizes, limit):
        starts, run = [], most + 1
        for i, x in enumerate(() if own is None else own.tolist()):
            if run > most:
                starts.append(i)
                run = 0
            run += x
        ends = [*starts[1:], 0 if own is None else len(own)]
        out.append([{"s": k, "block_start": a, "block_end": z - 1} for k, (a, z) in enumerate(zip(starts, ends))])
    return pd.Series(out)


def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """(doc_id, s, block_start, block_end, lines) of rows (doc_id, lines), each section with its own lines only."""
    of = _by_length(F.transform("lines", F.length), F.lit(limit))
    own = F.transform("of", lambda x: F.struct(x["s"].alias("s"), x["block_start"].alias("block_start"), x["block_end"].alias("block_end"), F.slice("lines", x["block_start"] + 1, x["block_end"] - x["block_start"] + 1).alias("own")))
    return rows.withColumn("of", of).select("doc_id", F.inline(own))


def sections_by_length(docs: DataFrame, limit: int = 1800) -> DataFrame:
    """(doc_id, s, block_start, block_end, heading, text) of documents (doc_id, text), cut by running length.

    The block that crosses the limit still belongs to its section; the heading is the first line's first
    40 characters. No shuffle: a document's blocks stay in its row.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = _cut(docs.select("doc_id", lines.alias("lines")), limit)
    return cut.select("doc_id", "s", "block_start", "block_end", F.left(F.get("own", F.lit(0)), F.lit(40)).alias("heading"), F.array_join("own", "\n\n").alias("text"))


def cut_by_length(blocks: DataFrame, limit: int = 1800) -> DataFrame:
    """Sections (s from 1, with parent_heading) of paragraphs (doc_id, n, text) by running length."""
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("b")).select("doc_id", F.col("b.text").alias("lines"))
    heading = F.left(F.split_part(F.get("own", F.lit(0)), F.lit("\n"), F.lit(1)), F.lit(40))
    return _cut(rows, limit).select("doc_id", (F.col("s") + 1).alias("s"), heading.alias("heading"), F.lit("").alias("parent_heading"), "block_start", "block_end")


def sections_v(spark: SparkSession, d: str) -> DataFrame:
    return sections_by_length(table(spark, d, "documents").select("doc_id", "text"), LIMIT)


def links_v(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, i, url, text): anchors of pages in order, with hosts put before relative addresses."""
    anchors = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    names = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    rows = table(spark, d, "pages").where(F.col("html").isNotNull()).select("page_id", host.alias("host"), F.posexplode(F.arrays_zip(anchors.alias("href"), names.alias("name"))).alias("i", "a"))
    url = F.when(F.col("i") % 17 == 16, F.concat(F.lit("mailto:"), F.col("a.href"))).when(F.col("i") % 3 == 1, F.concat("host", F.lit("/fileDown.do?seq="), F.col("a.href"))).otherwise(F.concat("host", F.col("a.href")))
    return rows.select("page_id", "i", url.alias("url"), F.col("a.name").alias("text"))


def book_v(spark: SparkSession, d: str) -> DataFrame:
    """(book, page, lines): one book for each source, its documents as pages by doc_id."""
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id", lines_of("text").alias("lines"))
    place = number(docs.select("book", "doc_id"), "book", ["doc_id"], "page").select("doc_id", (F.col("page") + 1).alias("page"))
    return docs.join(place, "doc_id").select("book", "page", "lines")


def lines_of(text: str):
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def printed(page):
    """Printed page numbers of books: mostly four less, every seventh three less, every fifth none."""
    return F.when(page % 5 == 0, F.lit(None)).when(page % 7 == 0, page - 3).otherwise(page - 4)


def queries_v(spark: SparkSession, d: str) -> DataFrame:
    """(q, raw): words 2 to 4 of every benchmark item."""
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n ]+", " "), " ")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.array_join(F.slice(words, 2, 3), " ").alias("raw"))


def outline_v(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, b, k, c, t): all blocks as outline nodes with depths 1,2,3,3,2,3,3 repeated."""
    b = blocks_v(spark, d).withColumn("m", F.col("n") % 7)
    chapter, task = (F.col("n") / 7).cast("int") + 1, F.when(F.col("m") <= 3, 1).otherwise(2)
    item = F.when(F.col("m").isin(2, 5), 1).otherwise(2)
    code = F.when(F.col("m") == 0, chapter.cast("string")).when(F.col("m").isin(1, 4), F.concat_ws(".", chapter, task)).otherwise(F.concat_ws(".", chapter, task, item))
    kind = F.when(F.col("m") == 0, "ch").when(F.col("m").isin(1, 4), "task").when(F.col("m") == 3, "link").when(F.col("m") == 6, "bullet").otherwise("item")
    return b.select("doc_id", F.col("n").alias("b"), kind.alias("k"), code.alias("c"), F.col("text").alias("t"))


# ---- the same views in DuckDB's SQL -------------------------------------------------------------

_IGNORED_RE2 = T.IGNORED.replace("'", "''")


def sql_norm(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[{_IGNORED_RE2}]+', '', 'g')"


def sql_grams(x: str) -> str:
    """Distinct neighbouring pairs, sorted."""
    chars = f"string_split({x}, '')"
    pairs = f"list_transform(list_zip({chars}[1:length({x}) - 1], {chars}[2:length({x})]), lambda p: p[1] || p[2])"
    return f"(CASE WHEN length({x}) >= 2 THEN list_sort(list_distinct({pairs})) WHEN length({x}) = 1 THEN [{x}] ELSE [] END)"


def sql_shard(g: str, n: int = T.SHARDS) -> str:
    one = f"((xor({T.FNV_OFFSET}::BIGINT, ord({g})::BIGINT)::HUGEINT * {T.FNV_PRIME}) % 4294967296)::BIGINT"
    two = f"((xor({one}, ord(substr({g}, 2, 1))::BIGINT)::HUGEINT * {T.FNV_PRIME}) % 4294967296)::BIGINT"
    return f"(CASE WHEN length({g}) > 1 THEN {two} ELSE {one} END % {n})::INTEGER"


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"

DOCS = f"""docs_v AS (
  SELECT doc_id, trim(split_part(split_part(text, chr(10), 1), '.', 1)) AS title, CASE WHEN doc_id % 10 = 0 THEN ['{COMMON}'] ELSE [lang] END AS levels, source AS department,
    (2024 + doc_id % 3)::INTEGER AS year, ['pdf', 'hwpx', 'xlsx', 'hwp'][doc_id % 4 + 1] AS format, n_chars AS bytes, doc_id AS created_at,
    CASE WHEN len(w) > 1 AND w[1] <> w[2] THEN w[1:2] ELSE w[1:1] END AS keywords
  FROM (SELECT *, list_filter(string_split(string_split(text, chr(10))[-1], ' '), lambda x: x <> '') AS w FROM documents))"""
BLOCKS = f"""blocks_v AS (
  SELECT doc_id, i - 1 AS n, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS l FROM documents)))"""
SECTIONS = f"""{BLOCKS},
run_v AS (
  SELECT doc_id, n, 0 AS s, length(text) AS len FROM blocks_v WHERE n = 0
  UNION ALL
  SELECT b.doc_id, b.n, CASE WHEN r.len > {LIMIT} THEN r.s + 1 ELSE r.s END, CASE WHEN r.len > {LIMIT} THEN 0 ELSE r.len END + length(b.text)
  FROM run_v r JOIN blocks_v b ON b.doc_id = r.doc_id AND b.n = r.n + 1),
sections_v AS (
  SELECT doc_id, s::INTEGER AS s, min(n)::INTEGER AS block_start, max(n)::INTEGER AS block_end, left(arg_min(text, n), 40) AS heading, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text
  FROM run_v JOIN blocks_v USING (doc_id, n) GROUP BY doc_id, s)"""
LINKS = r"""links_v AS (
  SELECT page_id, i::INTEGER AS i, CASE WHEN i % 17 = 16 THEN 'mailto:' || href[i + 1] WHEN i % 3 = 1 THEN host || '/fileDown.do?seq=' || href[i + 1] ELSE host || href[i + 1] END AS url, name[i + 1] AS text
  FROM (SELECT *, unnest(range(len(href))) AS i FROM (
    SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS href,
      regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS name FROM pages WHERE html IS NOT NULL)))"""
BOOK = f"""book_v AS (SELECT source AS book, (row_number() OVER (PARTITION BY source ORDER BY doc_id, text))::INTEGER AS page, {_LINES} AS lines FROM documents)"""
QUERIES = """queries_v AS (SELECT item_id AS q, array_to_string(string_split(regexp_replace(text, '[\n ]+', ' ', 'g'), ' ')[2:4], ' ') AS raw FROM benchmark)"""
OUTLINE = f"""outline_v AS (
  SELECT doc_id, n::INTEGER AS b, CASE WHEN m = 0 THEN 'ch' WHEN m IN (1, 4) THEN 'task' WHEN m = 3 THEN 'link' WHEN m = 6 THEN 'bullet' ELSE 'item' END AS k,
    CASE WHEN m = 0 THEN ch WHEN m IN (1, 4) THEN ch || '.' || tk ELSE ch || '.' || tk || '.' || CASE WHEN m IN (2, 5) THEN '1' ELSE '2' END END AS c, text AS t
  FROM (SELECT *, n % 7 AS m, (n // 7 + 1)::VARCHAR AS ch, CASE WHEN n % 7 <= 3 THEN '1' ELSE '2' END AS tk FROM blocks_v))"""


def with_views(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n" + body
