"""Lists of a level as they are published: documents, sections and outlines with all their fields; checks before that; the editor's list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.operators import documents as D
from folia.operators.lists import consistency, editor_list, finalize, section_rows, summaries, toc_rows
from folia.plans import catalog_queries as K
from folia.plans import index_queries as I
from folia.plans import text_queries as Q
from folia.plans import views as V
from folia.registry import query

# every third section has keywords, every fifth is marked as untitled, every fourth was named by somebody; a page's links belong to its document's first three sections in turn
_OWN = f"""own_v AS (SELECT s.*, format, CASE WHEN s % 3 = 0 THEN list_filter(string_split(array_to_string(w[greatest(len(w) - 1, 1):], ','), ','), lambda x: x <> '') ELSE [] END AS keys, s % 4 <> 0 AND (s % 5 = 4 OR (doc_id % 2 <> 0 AND (format = 'hwpx' OR regexp_matches(heading, '\\s[0-9]+쪽$|\\s구간 [0-9]+$')))) AS untitled
  FROM (SELECT *, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM sections_v) s JOIN (SELECT doc_id, format FROM docs_v) USING (doc_id)),
file_v AS (SELECT page_id AS doc_id, (i % 3)::INTEGER AS s, i, url, {Q._KIND} = 'file' AS file FROM links_v),
lead_v AS ({Q.LEAD})"""


def _sections(spark, d) -> DataFrame:
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    keys = F.when(F.col("s") % 3 == 0, F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), ",\n"))
    rows = V.sections_v(spark, d).withColumns({"keywords": keys, "parent_heading": F.concat(F.lit("단원 "), F.floor(F.col("s") / 4).cast("string")), "auto": F.col("s") % 4 != 0, "marked": F.col("s") % 5 == 4})
    return rows.join(V.docs_v(spark, d).select("doc_id", "format", (F.col("doc_id") % 2 == 0).alias("toc_found")), "doc_id")


def _blocks(spark, d) -> DataFrame:
    """Blocks with page numbers; every fourth has no printed one."""
    n = F.col("n")
    return V.blocks_v(spark, d).select("doc_id", "n", (n + 1).alias("pdf_page"), F.when(n % 4 != 3, n + 3).alias("printed_page"), F.lit("").alias("footer_label"), "text")


def _links(spark, d) -> DataFrame:
    return V.links_v(spark, d).select(F.col("page_id").alias("doc_id"), (F.col("i") % 3).alias("s"), "i", "url", "text", T.link_kind(F.col("url")).alias("kind"))


_PAGES = "array_to_string(range(block_start + 1, block_end + 2), ',') AS pages, array_to_string(list_transform(list_filter(range(block_start, block_end + 1), lambda n: n % 4 <> 3), lambda n: n + 3), ',') AS printed"


@query(V.with_views(V.DOCS, I._LEVEL_DOCS, V.SECTIONS, I._REFS, V.LINKS, _OWN, body=f"""
SELECT level, ref, heading, '단원 ' || (s // 4) AS parent, {_PAGES}, array_to_string(list_distinct_kept, ',') AS keywords, lead, coalesce(n, 0) AS files, untitled
FROM (SELECT r.level, r.ref, o.*, CASE WHEN len(keys) > 1 AND keys[1] = keys[2] THEN keys[1:1] ELSE keys END AS list_distinct_kept FROM ref_v r JOIN own_v o USING (doc_id, s)) JOIN lead_v USING (doc_id, s)
LEFT JOIN (SELECT doc_id, s, count(*) AS n FROM file_v WHERE file GROUP BY doc_id, s) USING (doc_id, s)"""))
def section_index(spark, d):
    rows = I.refs(V.docs_v(spark, d), _sections(spark, d).drop("format")).join(V.docs_v(spark, d).select("doc_id", "format"), "doc_id")
    got = section_rows(rows, _blocks(spark, d), _links(spark, d))
    text = lambda c: F.array_join(c, ",").alias(c)
    return got.select("level", "ref", "heading", F.col("parent_heading").alias("parent"), text("pages"), text("printed"), text("keywords"), "lead", "files", "untitled")


@query(V.with_views(V.DOCS, V.SECTIONS, V.LINKS, V.BLOCKS.replace("blocks_v", "line_v"), body=f"""
SELECT doc_id, title, array_to_string(levels, ',') AS levels, department, year, format, CASE WHEN format IN ('pdf', 'hwpx') THEN 'text' ELSE 'link' END AS kind, array_to_string(keywords, ',') AS keywords, coalesce(sections, 0) AS sections, coalesce(forms, 0) AS forms,
  coalesce(blocks, 0) AS blocks, coalesce(blocks, 0) AS outline, '../store_' || year || '/files/' || doc_id || '.' || format AS file
FROM docs_v LEFT JOIN (SELECT doc_id, count(*) AS sections FROM sections_v GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS blocks FROM line_v GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT page_id AS doc_id, count(DISTINCT url) AS forms FROM links_v WHERE {Q._KIND} = 'file' GROUP BY page_id) USING (doc_id)"""))
def doc_summary(spark, d):
    docs = V.docs_v(spark, d).withColumns({"repo": F.concat(F.lit("store_"), F.col("year").cast("string")), "path": F.concat(F.lit("files/"), F.col("doc_id").cast("string"), F.lit("."), "format")})
    links = _links(spark, d)
    numbers = links.where("kind = 'file'").groupBy("doc_id", "url").agg(F.min("i").alias("form_no"))
    got = summaries(docs, V.sections_v(spark, d), numbers, _blocks(spark, d), V.outline_v(spark, d))
    return got.select("doc_id", "title", F.array_join("levels", ",").alias("levels"), "department", "year", "format", "kind", F.array_join("keywords", ",").alias("keywords"), "sections", "forms", "blocks", "outline", "file")


@query(V.with_views(V.BLOCKS, V.OUTLINE, V.LINKS, f"tidy_v AS ({Q.TIDY})", body=f"""
SELECT o.doc_id, c, left(k, 1) AS kind, CASE WHEN k IN ('ch', 'link') THEN CASE WHEN l.text IS NOT NULL THEN coalesce(nullif(l.text, ''), o.t) ELSE o.t END WHEN rest <> '' THEN title || '…' ELSE title END AS title,
  CASE WHEN b % 4 <> 3 THEN (b + 3) || 'p' ELSE (b + 1) || '쪽' END AS page, CASE WHEN l.url IS NULL THEN '' WHEN {Q._KIND} = 'law' THEN '법령' WHEN {Q._KIND} = 'site' THEN '사이트' ELSE '서식' END AS type, coalesce(l.url, '') AS url
FROM outline_v o JOIN tidy_v t ON t.doc_id = o.doc_id AND t.n = o.b LEFT JOIN links_v l ON o.k = 'link' AND l.page_id = o.doc_id AND l.i = o.b // 7 WHERE k <> 'bullet'"""))
def toc_index(spark, d):
    """Outlines with the links of the document's page on their link nodes, in order."""
    nodes = V.outline_v(spark, d).withColumns({"l": F.when(F.col("k") == "link", F.floor(F.col("b") / 7)), "cut": F.lit(False)})
    links = _links(spark, d).select("doc_id", F.col("i").cast("long").alias("id"), "text", "url", "kind", F.lit(None).cast("string").alias("type"))
    return toc_rows(nodes, links, _blocks(spark, d))


@query(V.with_views(V.DOCS, V.SECTIONS, body=f"""
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN department WHEN doc_id % 2 = 0 THEN '{D.COMMON_DEPARTMENT}' ELSE '' END AS department, coalesce(string_agg(s || ':' || pages || ':' || printed, '|' ORDER BY s), '') AS sections
FROM docs_v LEFT JOIN (SELECT doc_id, s, {_PAGES} FROM sections_v) USING (doc_id) GROUP BY doc_id, department"""))
def finalize_documents(spark, d):
    docs = V.docs_v(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("department")).alias("department"), F.when(F.col("doc_id") % 2 == 0, D.COMMON_SITE).alias("site"))
    got = finalize(docs, _blocks(spark, d), _sections(spark, d))
    pages = F.transform("sections", lambda s: F.concat_ws(":", s["s"].cast("string"), F.array_join(s["pdf_pages"], ","), F.array_join(s["printed_pages"], ",")))
    return got.select("doc_id", "department", F.array_join(pages, "|").alias("sections"))


# ---- checks ---------------------------------------------------------------------------------------


def _listed(spark, d) -> DataFrame:
    """Every fiftieth document stands twice in the catalog."""
    docs = V.docs_v(spark, d).select("doc_id", "title", "levels")
    return docs.unionByName(docs.where("doc_id % 50 = 0").withColumn("title", F.concat("title", F.lit(" 2"))))


@query(V.with_views(V.DOCS, "valid_v AS (" + K.VALIDATED + ")", body="""
SELECT 'error' AS kind, 'id' AS problem, doc_id::VARCHAR AS what FROM docs_v WHERE doc_id % 50 = 0
UNION ALL SELECT 'error', unnest(string_split(errors, ',')), doc_id::VARCHAR FROM valid_v WHERE errors <> ''
UNION ALL SELECT 'warning', unnest(string_split(warnings, ',')), doc_id::VARCHAR FROM valid_v WHERE warnings <> ''
UNION ALL SELECT 'error', 'no details', doc_id::VARCHAR FROM docs_v WHERE doc_id % 11 = 0
UNION ALL SELECT DISTINCT 'error', 'level index', l FROM (SELECT doc_id, unnest(levels) AS l FROM docs_v) WHERE doc_id % 97 = 1
UNION ALL SELECT 'deletion', 'file', 'data/documents/' || doc_id || '.json' FROM docs_v WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0
UNION ALL SELECT 'deletion', 'file', 'data/search/old/' || doc_id || '.json' FROM docs_v WHERE doc_id % 40 = 0"""))
def consistency_check(spark, d):
    """Details are missing of every eleventh, a level's index lacks every 97th; files of every thirteenth and of an old level are left over."""
    docs = V.docs_v(spark, d)
    i, name = F.col("doc_id"), lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string"), F.lit(".json"))
    details = docs.where(i % 11 != 0).select("doc_id")
    index = docs.select("doc_id", F.explode("levels").alias("level")).where(i % 97 != 1)
    valid = K.validate_documents(spark, d).select("doc_id", F.split(F.nullif("errors", F.lit("")), ",").alias("errors"), F.split(F.nullif("warnings", F.lit("")), ",").alias("warnings"))
    saved = docs.where(i % 11 != 0).select(name("data/documents/").alias("path")).unionByName(docs.where(i % 40 == 0).select(name("data/search/old/").alias("path"))).unionByName(docs.where(i % 45 == 0).select(name("images/").alias("path")))
    written = docs.where((i % 11 != 0) & (i % 13 != 0)).select(name("data/documents/").alias("path"))
    return consistency(_listed(spark, d), valid, details, index, saved, written)


_ASKED = (("text", "on", "", "", False, False), ("level", "", "en", "", False, False), ("common", "", V.COMMON, "", False, False), ("category", "", "", "pdf", False, False), ("source", "", "", "", True, False), ("check", "th", "", "", False, True))


@query(V.with_views(V.DOCS, f"item_v AS (SELECT *, format AS category, doc_id % 3 <> 0 AS stored, doc_id % 4 = 1 AS odd FROM docs_v), ask_v AS (SELECT * FROM (VALUES {', '.join(str(x).replace('True', 'true').replace('False', 'false') for x in _ASKED)}) x(request, q, level, cat, bare, checked))", body=f"""
SELECT request, doc_id, (row_number() OVER (PARTITION BY request ORDER BY CASE WHEN level = '{V.COMMON}' THEN department ELSE '' END, CASE WHEN level <> '' THEN year END DESC, CASE WHEN level <> '' THEN title END, CASE WHEN level = '' THEN created_at END DESC, doc_id))::INTEGER AS place
FROM item_v JOIN ask_v ON (q = '' OR contains({V.sql_norm("title || category || department")}, q)) AND (level = '' OR list_contains(levels, level)) AND (cat = '' OR category = cat) AND (NOT bare OR NOT stored) AND (NOT checked OR odd)"""))
def filter_documents(spark, d):
    """Six requests: by text, level, common material, category, files without a source, and files to be checked that hold a text."""
    docs = V.docs_v(spark, d).withColumns({"category": F.col("format"), "stored": F.col("doc_id") % 3 != 0, "odd": F.col("doc_id") % 4 == 1})
    asked = spark.createDataFrame(list(_ASKED), "request string, q string, level string, category string, no_source boolean, check boolean")
    return editor_list(docs, asked, V.COMMON).select("request", "doc_id", "place")
