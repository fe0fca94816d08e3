"""Checks, edits, editions, files, earlier exports and outline sheets over the documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import spacing
from folia.functions import text as T
from folia.operators import catalog as C
from folia.operators import contents as P
from folia.operators import outline as O
from folia.plans import index_queries as I
from folia.plans import link_queries as L
from folia.plans import views as V
from folia.registry import query
from folia.sources.tables import table
from folia.sources.written import path_of, written

# ---- addresses and files ------------------------------------------------------------------------


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://www.form' || page_id || '.co.kr/' WHEN 1 THEN 'https://law.example/%EB%B2%95%EB%A0%B9/' || page_id WHEN 2 THEN url ELSE '' END AS url FROM pages""")
def fix_url(spark, d):
    """Every page's address: with a broken host and a name in the text, with a path encoded twice, as it is, and not of the web."""
    m = F.col("page_id") % 4
    url = F.when(m == 0, "http://xn--%20broken/").when(m == 1, F.concat(F.lit("https://law.example/%C2%B9%C3%BD%C2%B7%C3%89/"), F.col("page_id").cast("string"))).when(m == 2, F.col("url")).otherwise("mailto:x@example.com")
    text = F.concat(F.lit("서식 (ww.form"), F.col("page_id").cast("string"), F.lit(".co.kr)"))
    return C.fix_url(table(spark, d, "pages").select("page_id", url.alias("url"), text.alias("text"))).select("page_id", "url")


def _paths(spark, d) -> DataFrame:
    """Files below folders of departments, levels and years; some hidden, temporary or empty, and all found twice."""
    i, n = F.col("page_id"), F.col("page_id").cast("string")
    top = F.element_at(F.array(*map(F.lit, ("초등특수교육과", "유치원 자료", "공통", "2023 보관"))), (i % 4 + 1).cast("int"))
    sub = F.element_at(F.array(*map(F.lit, ("업무 매뉴얼", "중등", "유·초 이음"))), (i % 3 + 1).cast("int"))
    name = F.when(i % 11 == 0, F.concat(F.lit("~$plan"), n)).when(i % 13 == 0, F.lit("Thumbs.db")).when(i % 5 == 0, F.concat(F.lit("초등 계획 2024-"), n, F.lit(".hwp"))).otherwise(F.concat(F.lit("plan"), n, F.lit(".pdf")))
    rows = table(spark, d, "pages").select("page_id", F.concat_ws("/", top, sub, F.when(i % 17 == 0, ".git"), name).alias("path"), F.when(i % 19 == 0, 0).otherwise(F.octet_length(F.coalesce("html", F.lit("")))).cast("long").alias("size"))
    return rows.unionByName(rows)


_PATHS = """path_v AS (SELECT page_id, ['초등특수교육과', '유치원 자료', '공통', '2023 보관'][page_id % 4 + 1] AS top, ['업무 매뉴얼', '중등', '유·초 이음'][page_id % 3 + 1] AS sub, page_id % 17 = 0 AS hidden,
  CASE WHEN page_id % 11 = 0 THEN '~$plan' || page_id WHEN page_id % 13 = 0 THEN 'Thumbs.db' WHEN page_id % 5 = 0 THEN '초등 계획 2024-' || page_id || '.hwp' ELSE 'plan' || page_id || '.pdf' END AS name, CASE WHEN page_id % 19 = 0 THEN 0 ELSE strlen(coalesce(html, '')) END AS size FROM pages)"""


@query(V.with_views(_PATHS, body="SELECT DISTINCT top || '/' || sub || '/' || name AS path, size FROM path_v WHERE NOT hidden AND page_id % 11 <> 0 AND page_id % 13 <> 0 AND size > 0"))
def list_files(spark, d):
    return C.list_files(_paths(spark, d))


@query(V.with_views(_PATHS, body="""
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN '중등' WHEN page_id % 4 = 1 THEN '유아' WHEN page_id % 4 = 2 THEN '공통' WHEN name LIKE '초등%' THEN '초등' ELSE '' END AS levels,
  CASE WHEN name LIKE '초등%' THEN 2024 WHEN page_id % 4 = 3 THEN 2023 ELSE -1 END AS year, CASE WHEN page_id % 4 = 0 THEN '초등특수교육과' ELSE '' END AS department, CASE WHEN page_id % 3 = 0 THEN '업무매뉴얼' ELSE '' END AS category FROM path_v"""))
def guess_meta(spark, d):
    own = C.guess_meta(_paths(spark, d).distinct(), ["초등특수교육과", "중등교육과"], ["업무매뉴얼", "서식"], [])
    return own.select("page_id", F.array_join("levels", ",").alias("levels"), F.coalesce("year", F.lit(-1)).alias("year"), "department", "category")


_STORED = """store_v AS (SELECT doc_id, n_chars AS bytes, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'files_' || doc_id % 3 END AS repo, CASE WHEN doc_id % 4 = 1 THEN 'edit_' || doc_id % 2 END AS edit_repo FROM documents)"""


@query(V.with_views(_STORED, body="""
SELECT store, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT repo AS store, bytes FROM store_v UNION ALL SELECT edit_repo, bytes // 2 FROM store_v) WHERE store <> '' GROUP BY store"""))
def storage_usage(spark, d):
    i = F.col("doc_id")
    repo = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("files_"), (i % 3).cast("string")))
    edit = F.when(i % 4 == 1, F.concat(F.lit("edit_"), (i % 2).cast("string")))
    rows = table(spark, d, "documents").select(repo.alias("original_repo"), F.col("n_chars").alias("original_bytes"), edit.alias("edit_repo"), F.floor(F.col("n_chars") / 2).alias("edit_bytes"))
    return C.storage_usage(rows)


@query("""SELECT path, problem FROM (
  SELECT 'files/' || doc_id || '.pdf' AS path, doc_id % 6 <> 0 AS used, doc_id % 7 <> 0 AS stored, doc_id % 23 = 0 AS large FROM documents UNION ALL SELECT 'files/' || doc_id || '.hwp', doc_id % 6 <> 0 AND doc_id % 2 = 0, doc_id % 7 <> 0, false FROM documents),
  (VALUES ('unused'), ('missing'), ('too large')) x(problem)
WHERE (problem = 'unused' AND stored AND NOT used) OR (problem = 'missing' AND used AND NOT stored) OR (problem = 'too large' AND stored AND large)""")
def orphan_files(spark, d):
    """Each document's PDF and editable file; every seventh's aren't stored, every sixth uses none, odd ones use no editable one."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    pdf, hwp = (F.concat(F.lit("files/"), i.cast("string"), F.lit(x)) for x in (".pdf", ".hwp"))
    there = docs.where(i % 7 != 0)
    size = F.when(i % 23 == 0, C.FILE_MAX + 1).otherwise(F.lit(1000)).cast("long")
    stored = there.select(pdf.alias("path"), size.alias("bytes")).union(there.select(hwp, F.lit(1000).cast("long")))
    return C.orphan_files(stored, docs.where(i % 6 != 0).select("doc_id", pdf.alias("original_path"), F.when(i % 2 == 0, hwp).alias("edit_path")))


_ATTACH = f"""file_v AS (SELECT {V.sql_norm('title')} AS key, title AS name, bytes AS size FROM docs_v WHERE doc_id % 3 <> 0), want_v AS (SELECT doc_id, {V.sql_norm('title')} AS key, title, doc_id % 4 = 0 AS stored, CASE WHEN doc_id % 5 = 0 THEN 500 END AS waiting FROM docs_v)"""


@query(V.with_views(V.DOCS, _ATTACH, body="""
SELECT doc_id, name, size, CASE WHEN waiting IS NULL THEN 'attached' ELSE 'replaced' END AS how FROM want_v JOIN (SELECT key, arg_min(name, (size, name)) AS name, min(size) AS size FROM file_v GROUP BY key) USING (key)
WHERE title <> '' AND CASE WHEN waiting IS NOT NULL THEN size < waiting ELSE NOT stored END"""))
def attach_originals(spark, d):
    docs, i = V.docs_v(spark, d), F.col("doc_id")
    files = docs.where(i % 3 != 0).select(F.col("title").alias("name"), F.col("bytes").alias("size"))
    return C.attach_originals(files, docs.select("doc_id", F.col("title").alias("filename"), (i % 4 == 0).alias("stored"), F.when(i % 5 == 0, 500).alias("waiting")))


_WATCH = """com_v AS (SELECT event_id AS sha, ts AS tm, user_id % 3 AS author FROM events), watch_v AS (SELECT * FROM (VALUES (0, (SELECT count(*) // 2 FROM events)), (1, NULL), (2, -1), (3, (SELECT arg_min(event_id, (ts, event_id)) FROM events))) x(client, mark)),
head_v AS (SELECT arg_max(sha, (tm, sha)) AS head FROM com_v),
new_v AS (SELECT client, sha, author FROM watch_v w, com_v c WHERE mark IS NOT NULL AND (mark NOT IN (SELECT sha FROM com_v) OR (c.tm, c.sha) > (SELECT (tm, sha) FROM com_v m WHERE m.sha = w.mark)))"""


@query(V.with_views(_WATCH, body="""
SELECT client, sum(CASE WHEN author = client THEN 0 ELSE 1 END)::BIGINT AS unseen, coalesce(min(CASE WHEN author <> client THEN sha END), -1) AS first_unseen, any_value(mark) AS mark, bool_or(overflow) AS overflow, bool_or(first) AS first FROM (
  SELECT w.client, n.sha, coalesce(n.author, w.client) AS author, w.mark IS NULL AS first, w.mark IS NOT NULL AND w.mark NOT IN (SELECT sha FROM com_v) AS overflow, CASE WHEN w.mark IS NULL THEN head ELSE w.mark END AS mark
  FROM watch_v w, head_v LEFT JOIN new_v n ON n.client = w.client) GROUP BY client"""))
def unseen_changes(spark, d):
    """Four clients: with a mark in the middle, without one, with one that is gone, and with the oldest."""
    events = table(spark, d, "events")
    commits = events.select(F.col("event_id").alias("sha"), F.col("ts").alias("at"))
    mine = events.select((F.col("user_id") % 3).cast("int").alias("client"), F.col("event_id").alias("sha"))
    marks = events.agg(F.floor(F.count("*") / 2).alias("mid"), F.min_by("event_id", F.struct("ts", "event_id")).alias("old"))  # one row
    watch = marks.select(F.inline(F.array(*(F.struct(F.lit(c).alias("client"), m.cast("long").alias("mark")) for c, m in ((0, F.col("mid")), (1, F.lit(None)), (2, F.lit(-1)), (3, F.col("old")))))))
    seen, state = C.unseen_changes(commits, mine, watch)
    n = seen.groupBy("client").agg(F.count("*").alias("unseen"), F.min("sha").alias("first_unseen"))
    return state.join(n, "client", "left").select("client", F.coalesce("unseen", F.lit(0).cast("long")).alias("unseen"), F.coalesce("first_unseen", F.lit(-1).cast("long")).alias("first_unseen"), "mark", "overflow", "first")


# ---- checks -------------------------------------------------------------------------------------


@query("""SELECT doc_id AS line, CASE WHEN doc_id % 9 = 0 THEN 'damaged' WHEN doc_id % 10 = 0 THEN 'no id' ELSE 'no details' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 7 = 0""")
def check_doc_list(spark, d):
    """A list of all documents as JSON lines: every ninth cut off, every tenth without id, every seventh without details."""
    i = F.col("doc_id")
    whole = F.to_json(F.struct(F.when(i % 10 != 0, F.concat(F.lit("doc-"), i.cast("string"))).alias("id"), F.lit("자료").alias("title")))
    docs = table(spark, d, "documents")
    lines = docs.select(i.alias("line"), F.when(i % 9 == 0, F.left(whole, F.lit(9))).otherwise(whole).alias("value"))
    return C.check_doc_list(lines, docs.where(i % 7 != 0).select(F.concat(F.lit("doc-"), i.cast("string")).alias("id")))


_RULES = """rule_v AS (SELECT doc_id, title, format, n, nl, (SELECT count(*) FROM links_v l WHERE l.page_id = d.doc_id AND l.i % 17 = 16) AS no_web FROM docs_v d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections_v GROUP BY doc_id) s USING (doc_id) LEFT JOIN (SELECT page_id AS doc_id, count(*) AS nl FROM links_v GROUP BY page_id) k USING (doc_id))"""


VALIDATED = V.with_views(V.DOCS, V.SECTIONS, V.LINKS, _RULES, body="""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'id' END, CASE WHEN title = '' OR doc_id % 13 = 0 THEN 'title' END, CASE WHEN doc_id % 17 = 0 THEN 'level' END, CASE WHEN doc_id % 19 = 0 AND doc_id % 17 <> 0 THEN 'common level' END,
    CASE WHEN doc_id % 23 = 0 THEN 'works url' END, CASE WHEN doc_id % 29 = 0 AND doc_id % 3 <> 0 AND format = 'pdf' THEN 'pdf path' END, CASE WHEN doc_id % 31 = 0 THEN 'original path' END, CASE WHEN doc_id % 37 = 0 THEN 'original store' END, CASE WHEN doc_id % 41 = 0 THEN 'edit path' END,
    CASE WHEN n > 0 AND doc_id % 43 = 0 THEN 'section name' END, CASE WHEN n > 0 AND doc_id % 47 = 0 THEN 'section range' END, CASE WHEN n > 1 AND doc_id % 53 = 0 THEN 'section id' END, CASE WHEN doc_id % 59 = 0 THEN 'bundle url' END], lambda x: x IS NOT NULL), ',') AS errors,
  array_to_string(list_filter([CASE WHEN doc_id % 19 = 0 AND doc_id % 17 <> 0 AND doc_id % 2 = 0 THEN 'department' END, CASE WHEN format = 'pdf' AND doc_id % 3 = 0 THEN 'no pdf' END, CASE WHEN doc_id % 23 <> 0 AND NOT (format = 'pdf' AND doc_id % 3 <> 0) AND doc_id % 5 = 0 AND doc_id % 31 <> 0 THEN 'no source' END,
    CASE WHEN format = 'pdf' AND doc_id % 7 = 0 THEN 'no outline' END, CASE WHEN nl > 0 AND doc_id % 6 = 0 THEN 'cut urls' END, CASE WHEN no_web > 0 THEN 'not of the web' END, CASE WHEN format IN ('pdf', 'hwpx') AND n IS NULL THEN 'no sections' END], lambda x: x IS NOT NULL), ',') AS warnings FROM rule_v""")


@query(VALIDATED)
def validate_documents(spark, d):
    """Documents each of whose fields is wrong where its id has a divisor of its own."""
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    bad = lambda p, wrong, right: F.when(i % p == 0, wrong).otherwise(right)
    blocks = V.blocks_v(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    path = F.concat(F.lit("files/a"), n, F.lit(".hwp"))
    docs = V.docs_v(spark, d).join(blocks, "doc_id", "left").select(
        "doc_id", bad(11, "x y", F.concat(F.lit("doc-"), n)).alias("id"), bad(13, "", F.col("title")).alias("title"), F.when(i % 17 == 0, F.array().cast("array<string>")).when(i % 19 == 0, F.array(F.lit("공통"), F.lit("유아"))).otherwise(F.array(F.lit("유아"))).alias("levels"),
        F.when(i % 2 != 0, "x").alias("department"), F.when(i % 23 == 0, "ftp://x").alias("works_url"), F.when(i % 59 == 0, "x").otherwise("https://b").alias("bundle_url"), "format", T.kind_of(F.col("format")).alias("kind"),
        F.when((F.col("format") == "pdf") & (i % 3 != 0), F.when(i % 29 == 0, "x.pdf").otherwise(F.concat(F.lit("files/a"), n, F.lit(".pdf")))).when((F.col("format") == "pdf") & (i % 29 == 0), F.lit(None)).alias("pdf_path"),
        F.when(i % 31 == 0, "other").when(i % 5 != 0, path).alias("original_path"), F.when(i % 37 == 0, "a/b").otherwise("files_1").alias("original_repo"), F.when(i % 41 == 0, path).alias("edit_path"), F.lit(None).cast("string").alias("edit_repo"), (i % 7 != 0).alias("has_outline"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
    own = V.sections_v(spark, d).select("doc_id", F.when(i % 53 == 0, "sec-1").otherwise(F.concat(F.lit("sec-"), F.col("s").cast("string"))).alias("id"), bad(43, "", F.lit("x")).alias("heading"), bad(47, -1, F.col("block_start")).alias("block_start"), "block_end")
    links = V.links_v(spark, d).select(F.col("page_id").alias("doc_id"), "url")
    cut = links.where(i % 6 == 0).select("doc_id").distinct().withColumn("url", F.lit("https://files.example.org/boardCnts/fileDown.do?fileSeq=1"))
    got = C.validate(docs, own, links.unionByName(cut))
    return got.select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(V.with_views(V.DOCS, V.SECTIONS, body="""
SELECT 'level' AS kind, level AS name, count(*) AS docs, sum(n)::BIGINT AS sections FROM (SELECT unnest(levels) AS level, coalesce(n, 0) AS n FROM docs_v LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections_v GROUP BY doc_id) USING (doc_id)) GROUP BY level
UNION ALL SELECT 'department', department, count(*), 0 FROM docs_v GROUP BY department UNION ALL SELECT 'all', '', count(*), (SELECT count(*) FROM sections_v) FROM docs_v UNION ALL SELECT 'shards', '', 128, 0"""))
def write_manifest(spark, d):
    """Counts by level and department as one JSON object, written, and read again by its schema."""
    levels = I.level_counts(spark, d).where("docs > 0").select(F.lit("level").alias("kind"), F.col("level").alias("name"), "docs", "sections")
    docs, zero = V.docs_v(spark, d), F.lit(0).cast("long").alias("sections")
    depts = docs.groupBy("department").agg(F.count("*").alias("docs")).select(F.lit("department").alias("kind"), F.col("department").alias("name"), "docs", zero)
    n = V.sections_v(spark, d).groupBy().agg(F.count("*").alias("sections"))
    every = docs.groupBy().agg(F.count("*").alias("docs")).join(F.broadcast(n)).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "docs", "sections")  # one row each
    shards = spark.range(1).select(F.lit("shards").alias("kind"), F.lit("").alias("name"), F.lit(T.SHARDS).cast("long").alias("docs"), zero)
    rows = levels.unionByName(depts).unionByName(every).unionByName(shards)
    one = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("kind", "name", "docs", "sections"))).alias("counts")).select(F.lit("2.0").alias("version"), "counts")
    return written(one, "manifest", kind="json").select(F.inline("counts"))


# ---- editions -----------------------------------------------------------------------------------


@query(V.with_views(V.DOCS, body="""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'files/o' || doc_id || '.hwp' ELSE 'files/e' || doc_id || '.docx' END AS path, CASE WHEN doc_id % 3 = 0 THEN 'hwp' ELSE 'docx' END AS format FROM docs_v
WHERE format = 'pdf' AND (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND (doc_id % 5 = 0 OR doc_id % 7 = 0)))"""))
def keep_edit_original(spark, d):
    """Old editions whose source is a hwp file, a PDF with an editable file beside it, or a PDF alone; new ones of the same year, of none, or of the next."""
    i, n, docs = F.col("doc_id"), F.col("doc_id").cast("string"), V.docs_v(spark, d)
    new = docs.select("doc_id", F.when(i % 5 == 0, F.col("year")).when(i % 7 != 0, F.col("year") + 1).alias("year"), "format")
    old = docs.select(
        "doc_id", "year", F.lit("files_1").alias("original_repo"), F.concat(F.lit("files/o"), n, F.when(i % 3 == 0, ".hwp").otherwise(".pdf")).alias("original_path"), F.when(i % 3 == 0, "hwp").otherwise("pdf").alias("original_format"),
        F.when(i % 3 == 1, "files_1").alias("edit_repo"), F.concat(F.lit("files/e"), n, F.lit(".docx")).alias("edit_path"), F.lit("docx").alias("edit_format"),
    )
    return C.keep_edit_original(old, new)


def _links(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    return V.links_v(spark, d).select(F.col("page_id").alias("doc_id"), "i", F.col("i").alias("id"), "url", "text", F.lit("서식").alias("type"), none.alias("url_orig"), none.alias("text_orig"), F.lit(False).alias("type_set"))


def _edits(links: DataFrame) -> DataFrame:
    i = F.col("i")
    return links.where(i % 2 == 0).select("doc_id", "id", F.when(i % 6 == 0, F.concat("url", F.lit("#new"))).when(i % 6 == 2, "").alias("new_url"), F.when(i % 4 == 0, F.concat(F.lit("  new "), "text")).alias("new_text"), F.when(i % 10 == 0, "참고").alias("new_type"))


_EDITED = """edit_v AS (SELECT page_id AS doc_id, i, url AS old_url, text AS old_text, CASE WHEN i % 6 = 0 THEN url || '#new' ELSE url END AS url, CASE WHEN i % 4 = 0 THEN trim('new ' || text) ELSE text END AS text, CASE WHEN i % 10 = 0 THEN '참고' ELSE '서식' END AS type,
  CASE WHEN i % 6 = 0 THEN url ELSE '' END AS url_orig, CASE WHEN i % 4 = 0 THEN text ELSE '' END AS text_orig, i % 10 = 0 AS type_set FROM links_v)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("id").alias("i"), "url", "text", "type", F.coalesce("url_orig", F.lit("")).alias("url_orig"), F.coalesce("text_orig", F.lit("")).alias("text_orig"), "type_set")


@query(V.with_views(V.LINKS, _EDITED, body="SELECT doc_id, i, url, text, type, url_orig, text_orig, type_set FROM edit_v"))
def edit_link(spark, d):
    """Links of even number with a new address (every sixth), the first one back, a new name or type."""
    links = _links(spark, d)
    return _shown(C.edit_links(links.drop("i"), _edits(links)))


@query(V.with_views(V.LINKS, _EDITED, """last_v AS (SELECT doc_id, old_url, max(i) AS j FROM edit_v WHERE url_orig <> '' OR i % 4 = 0 OR type_set GROUP BY doc_id, old_url)""", body="""
SELECT n.doc_id, n.i, coalesce(CASE WHEN o.url_orig <> '' THEN o.url END, n.old_url) AS url, coalesce(CASE WHEN o.i % 4 = 0 THEN o.text END, n.old_text) AS text, coalesce(CASE WHEN o.type_set THEN o.type END, '서식') AS type,
  CASE WHEN o.url_orig <> '' THEN n.old_url ELSE '' END AS url_orig, CASE WHEN o.i % 4 = 0 THEN n.old_text ELSE '' END AS text_orig, coalesce(o.type_set, false) AS type_set
FROM edit_v n LEFT JOIN last_v l ON l.doc_id = n.doc_id AND l.old_url = n.old_url LEFT JOIN edit_v o ON o.doc_id = l.doc_id AND o.i = l.j"""))
def carry_link_edits(spark, d):
    links = _links(spark, d)
    return _shown(C.carry_link_edits(C.edit_links(links.drop("i"), _edits(links)), links.select("doc_id", "id", "url", "text", "type")))


_FORMS = """form_v AS (SELECT page_id, 'f' || i AS id, s, i, url, text, i % 11 = 7 AS manual, CASE WHEN i % 3 = 0 THEN i + 100 END AS page FROM attach_v),
head_v AS (SELECT page_id, s, a, 'section ' || s % 4 AS heading FROM sec_v)"""


@query(V.with_views(V.LINKS, L._SECTIONS, L._OWNED, L._ATTACH, _FORMS, body="""
SELECT n.page_id, n.id, n.s, coalesce(o.page, -1) AS bundle_page, false AS manual FROM form_v n LEFT JOIN (SELECT page_id, url, arg_max(page, i) AS page FROM form_v WHERE NOT manual AND page IS NOT NULL GROUP BY page_id, url) o ON o.page_id = n.page_id AND o.url = n.url WHERE NOT n.manual
UNION ALL SELECT f.page_id, f.id, t.s, coalesce(f.page, -1), true FROM form_v f JOIN head_v h ON h.page_id = f.page_id AND h.s = f.s JOIN (SELECT page_id, heading, max(s) AS s FROM head_v WHERE s % 5 <> 1 GROUP BY page_id, heading) t ON t.page_id = f.page_id AND t.heading = h.heading WHERE f.manual"""))
def carry_forms(spark, d):
    """Forms of an old edition, every eleventh added by hand; in the new one each fifth section is gone, and four names go round."""
    own = L._attached(spark, d)
    links = V.links_v(spark, d)
    heads = L.page_sections(links).select(F.col("page_id").alias("doc_id"), "s", F.concat(F.lit("section "), (F.col("s") % 4).cast("string")).alias("heading"), F.col("a").alias("block_start"))
    i = F.col("i")
    old = own.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("f"), i.cast("string")).alias("id"), "s", "i", "url", "text", (i % 11 == 7).alias("manual"), F.when(i % 3 == 0, i + 100).alias("bundle_page"))
    new = old.where("not manual").withColumn("bundle_page", F.lit(None).cast("int"))
    got = C.carry_forms(old, new, heads, heads.where("s % 5 <> 1"))
    return got.select(F.col("doc_id").alias("page_id"), "id", "s", F.coalesce("bundle_page", F.lit(-1)).alias("bundle_page"), "manual")


@query(V.with_views(V.LINKS, L._SECTIONS, L._OWNED, L._ATTACH, body="""
SELECT page_id, id, s, (dense_rank() OVER (PARTITION BY page_id ORDER BY o))::INTEGER AS form_no FROM (SELECT page_id, id, s, min(o) OVER (PARTITION BY page_id, url) AS o FROM (
  SELECT page_id, id, s, url, i AS o FROM attach_v WHERE regexp_matches(url, '(?i)fileDown') UNION ALL
  SELECT page_id, 'man-' || lpad(i::VARCHAR, 4, '0'), s, '/download/' || i % 3, 1000000 + i FROM attach_v WHERE i % 4 = 1))"""))
def add_forms(spark, d):
    """Forms added by hand beside every fourth link, some with one address: numbered behind the automatic ones."""
    own = L._attached(spark, d).withColumn("manual", F.lit(False))
    more = own.where("i % 4 = 1").select("page_id", F.concat(F.lit("man-"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("id"), "s", F.concat(F.lit("/download/"), (F.col("i") % 3).cast("string")).alias("url"), "i", F.lit("added").alias("text"), F.lit(True).alias("manual"))
    return L.numbered(own.unionByName(more)).select("page_id", "id", "s", "form_no")


@query(V.with_views(V.SECTIONS, body=f"""
SELECT n.doc_id, n.s, coalesce(o.keyword, '') AS keyword, coalesce(o.hand, false) AS by_hand FROM sections_v n
LEFT JOIN (SELECT doc_id, {V.sql_norm('heading')} AS key, arg_max('kw' || s, s) AS keyword, arg_max(s % 3 = 0, s) AS hand FROM sections_v WHERE (doc_id + s) % 4 <> 0 GROUP BY ALL) o ON o.doc_id = n.doc_id AND o.key = {V.sql_norm('n.heading')}"""))
def carry_keywords(spark, d):
    """Keywords of old sections, and whether their headings were written by hand, for new sections of the same heading; the last of several."""
    new = V.sections_v(spark, d).select("doc_id", "s", T.norm(F.col("heading")).alias("key"))
    old = new.where((F.col("doc_id") + F.col("s")) % 4 != 0).groupBy("doc_id", "key").agg(F.concat(F.lit("kw"), F.max("s").cast("string")).alias("keyword"), (F.max("s") % 3 == 0).alias("hand"))
    return new.join(old, ["doc_id", "key"], "left").select("doc_id", "s", F.coalesce("keyword", F.lit("")).alias("keyword"), F.coalesce("hand", F.lit(False)).alias("by_hand"))


# ---- outlines -----------------------------------------------------------------------------------


def _auto(spark, d) -> DataFrame:
    return V.outline_v(spark, d).select("doc_id", "c", "t", "b", F.lit(None).cast("string").alias("l"), "k")


def _manual(spark, d) -> DataFrame:
    """Manual outlines of every second document: other titles, without bullets, some with links that a sheet made."""
    rows = _auto(spark, d).where("doc_id % 2 = 0 and k <> 'bullet'")
    return rows.select("doc_id", "c", F.concat(F.lit("m "), "t").alias("t"), "b", F.when(F.col("k") == "link", F.concat(F.when(F.col("b") % 2 == 0, "toc-").otherwise("lnk-"), F.col("b").cast("string"))).alias("l"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, body="""
SELECT doc_id, 'shown' AS kind, c, 'm ' || t AS t FROM outline_v WHERE doc_id % 2 = 0 AND k <> 'bullet'
UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM outline_v WHERE k <> 'bullet') THEN 'auto' ELSE 'shown' END, c, t FROM outline_v"""))
def manual_outline_apply(spark, d):
    return C.manual_apply(_auto(spark, d), _manual(spark, d)).select("doc_id", "kind", "c", "t")


@query(V.with_views(V.BLOCKS, V.OUTLINE, body="SELECT doc_id, c, t, '' AS link FROM outline_v UNION ALL SELECT doc_id, '', '', 'lnk-' || b FROM outline_v WHERE doc_id % 2 = 0 AND k = 'link' AND b % 2 = 1"))
def manual_outline_revert(spark, d):
    """What manual_outline_apply has shown, taken back, with the links that are left."""
    manual = _manual(spark, d)
    nodes, links = C.manual_revert(C.manual_apply(_auto(spark, d), manual), manual.where("l is not null").select("doc_id", F.col("l").alias("id")))
    return nodes.select("doc_id", "c", "t", F.lit("").alias("link")).union(links.select("doc_id", F.lit(""), F.lit(""), "id"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, "size_v AS (SELECT doc_id, (max(n) + 1) // 2 AS size FROM blocks_v GROUP BY doc_id)", body="""
SELECT doc_id, c, least(b, greatest(size - 1, 0))::INTEGER AS b, '' AS link FROM outline_v JOIN size_v USING (doc_id) WHERE doc_id % 2 = 0 AND k <> 'bullet'
UNION ALL SELECT doc_id, '', CASE WHEN b % 2 = 0 THEN least(b, greatest(size - 1, 0)) ELSE b END::INTEGER, CASE WHEN b % 2 = 0 THEN 'toc-' ELSE 'lnk-' END || b FROM outline_v JOIN size_v USING (doc_id) WHERE doc_id % 2 = 0 AND k = 'link'"""))
def manual_outline_carry(spark, d):
    """Manual outlines of documents that are half as long in the new edition; links that a sheet made aren't there yet."""
    manual = _manual(spark, d)
    sizes = V.blocks_v(spark, d).groupBy("doc_id").agg(((F.max("n") + 1) / 2).cast("int").alias("n_blocks"))
    links = manual.where("l is not null").select("doc_id", F.col("l").alias("id"), F.col("b").alias("block"), F.startswith("l", F.lit("toc-")).alias("manual"))
    nodes, more = C.manual_carry(manual, links, links.where("not manual"), sizes)
    return nodes.select("doc_id", "c", "b", F.lit("").alias("link")).union(more.select("doc_id", F.lit(""), "block", "id"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, body="SELECT doc_id, c, CASE WHEN k = 'task' AND doc_id % 3 <> 0 THEN 'section ' || b ELSE t END AS title FROM outline_v"))
def sync_outline(spark, d):
    """Titles of tasks follow their sections' headings; manual outlines (every third) keep theirs."""
    nodes = V.outline_v(spark, d)
    headings = nodes.where("k = 'task'").select("doc_id", "c", F.concat(F.lit("section "), F.col("b").cast("string")).alias("heading"))
    rows = nodes.join(headings, ["doc_id", "c"], "left")
    return rows.select("doc_id", "c", F.when(F.col("doc_id") % 3 == 0, F.col("t")).otherwise(F.coalesce("heading", "t")).alias("title"))


_GARBLED = r"""(trim(t) = '' OR NOT (regexp_matches(trim(t), '(?i)^(part|chapter|step|unit|appendix|q\s*&\s*a|faq)\b') OR (len(regexp_extract_all(trim(t), '\b[A-Za-z][a-z]{2,}\b')) >= 2 AND NOT regexp_matches(trim(t), '[\[\]^$\\{}|`~#@]'))) OR (odd >= 4 OR (odd >= 2 AND odd >= 0.15 * length(own))))"""


@query(V.with_views(V.BLOCKS, V.OUTLINE, rf"""odd_v AS (SELECT *, length(regexp_replace(own, '[가-힣ㄱ-ㆎ一-鿿 -~·°×‐-⁯⅐-⇿①-➿\x{{3000}}-〿㈀-㏿＀-￯]', '', 'g')) AS odd FROM (SELECT *, regexp_replace(t, '\s+', '', 'g') AS own FROM outline_v))""", body=f"""
SELECT doc_id, b, c FROM odd_v WHERE k = 'ch' OR (k <> 'bullet' AND ((k = 'link' AND b % 2 = 0) OR NOT {_GARBLED}))"""))
def clean_outline(spark, d):
    rows = V.outline_v(spark, d).withColumn("l", F.when((F.col("k") == "link") & (F.col("b") % 2 == 0), "id"))
    return O.clean_outline(rows).select("doc_id", "b", "c")


@query(V.with_views(L._CHAT, L._CHAPTERS, body="""
SELECT conv_id, split_part(c, '.', 1) AS code, 'ch' AS k, any_value(role) AS title FROM chap_v JOIN chat_v USING (conv_id, n) GROUP BY conv_id, split_part(c, '.', 1)
UNION ALL SELECT conv_id, c, 'task', left(text, 40) FROM chap_v JOIN chat_v USING (conv_id, n) UNION ALL SELECT conv_id, c || '.1', 'link', 'form ' || n FROM chap_v WHERE n % 3 = 0"""))
def fallback_outline(spark, d):
    """Chapters, tasks and links of documents without an outline."""
    rows = L.chapters(L._chat(spark, d))
    heads = rows.groupBy("conv_id", "ch").agg(F.min_by("role", "n").alias("title")).select("conv_id", F.col("ch").cast("string").alias("code"), F.lit("ch").alias("k"), "title")
    tasks = rows.select("conv_id", F.col("c").alias("code"), F.lit("task").alias("k"), F.left("text", F.lit(40)).alias("title"))
    links = rows.where("n % 3 = 0").select("conv_id", F.concat(F.col("c"), F.lit(".1")).alias("code"), F.lit("link").alias("k"), F.concat(F.lit("form "), F.col("n").cast("string")).alias("title"))
    return heads.unionByName(tasks).unionByName(links)


@query(V.with_views(V.BLOCKS, V.OUTLINE, "kept_v AS (SELECT *, CASE WHEN k = 'link' THEN ['서식', '참고', '법령', '사이트'][b % 4 + 1] ELSE '' END AS type FROM outline_v WHERE k <> 'bullet' AND NOT (k = 'task' AND b % 3 = 1))", body="""
SELECT k.doc_id, least(6, count(p.c) + 1)::INTEGER AS depth, CASE WHEN k.type <> '' THEN 'link ' || k.b ELSE k.t END AS title, k.b + 1 AS page, k.type, CASE WHEN k.type <> '' THEN 'https://x/' || k.b ELSE '' END AS url, k.c AS code
FROM kept_v k LEFT JOIN kept_v p ON p.doc_id = k.doc_id AND starts_with(k.c, p.c || '.') GROUP BY k.doc_id, k.c, k.t, k.b, k.type"""))
def outline_to_rows(spark, d):
    """Outlines, some of whose tasks are missing, as sheet rows: depth below what is left, links with their own text, type and address."""
    nodes = V.outline_v(spark, d).where("k <> 'bullet' AND NOT (k = 'task' AND b % 3 = 1)")
    kind = F.element_at(F.array(*map(F.lit, O.LINK_KINDS)), (F.col("b") % 4 + 1).cast("int"))
    links = nodes.where("k = 'link'").select("doc_id", "c", F.concat(F.lit("link "), F.col("b").cast("string")).alias("lt"), kind.alias("type"), F.concat(F.lit("https://x/"), F.col("b").cast("string")).alias("url"))
    rows = nodes.join(L.reparent(nodes.select("doc_id", "c")), ["doc_id", "c"]).join(links, ["doc_id", "c"], "left")
    none = F.lit("")
    return rows.select("doc_id", F.least("depth", F.lit(O.MAX_DEPTH)).alias("depth"), F.coalesce("lt", "t").alias("title"), (F.col("b") + 1).alias("page"), F.coalesce("type", none).alias("type"), F.coalesce("url", none).alias("url"), F.col("c").alias("code"))


def _sheets(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sheets of outlines without bullets: items (depth 3) that are wrong in three ways, some pages left out, links by address, by name and new."""
    nodes = V.outline_v(spark, d).where("k <> 'bullet'").withColumn("depth", F.size(F.split("c", r"\.")))
    b, deep = F.col("b"), F.col("depth") == 3
    depth = F.when(deep & (b % 11 == 2), "x").otherwise(F.col("depth").cast("string"))
    title = F.when(deep & (b % 13 == 2), "").otherwise(F.concat(F.lit("t"), b.cast("string")))
    page = F.when(deep & (b % 17 == 2), "999999").when(b % 5 == 3, "").otherwise((b + 1).cast("string"))
    link = F.col("k") == "link"
    sheet = nodes.select("doc_id", (b + 1).alias("row"), depth.alias("depth"), title.alias("title"), page.alias("page"), F.when(link, "서식").alias("kind"), F.when(link & (b % 2 == 0), F.concat(F.lit("https://x/"), b.cast("string"))).alias("url"))
    blocks = V.blocks_v(spark, d).select("doc_id", F.col("n").alias("block"), (F.col("n") + 1).alias("page"))
    links = nodes.where("k = 'link' and b % 4 < 2").select("doc_id", F.concat(F.lit("lnk-"), b.cast("string")).alias("id"), F.concat(F.lit("https://x/"), b.cast("string")).alias("url"), F.concat(F.lit("t"), b.cast("string")).alias("text"))
    return sheet, blocks, links


_SHEET = """row_v AS (SELECT *, len(string_split(c, '.')) AS depth, len(string_split(c, '.')) = 3 AND b % 11 = 2 AS e1, len(string_split(c, '.')) = 3 AND b % 13 = 2 AS e2, len(string_split(c, '.')) = 3 AND b % 17 = 2 AS e3 FROM outline_v WHERE k <> 'bullet'),
ok_v AS (SELECT *, CASE WHEN depth = 3 THEN string_split(c, '.')[1] || '.' || string_split(c, '.')[2] || '.' || row_number() OVER (PARTITION BY doc_id, string_split(c, '.')[1:2], depth ORDER BY b) ELSE c END AS code, CASE WHEN k = 'link' AND (b % 4 < 2 OR b % 2 = 0) THEN 'link' WHEN depth = 3 THEN 'item' ELSE k END AS kind,
  CASE WHEN b % 5 = 3 THEN coalesce(max(CASE WHEN b % 5 <> 3 THEN b END) OVER (PARTITION BY doc_id ORDER BY b), 0) ELSE b END AS place FROM row_v WHERE NOT (e1 OR e2 OR e3))"""


@query(V.with_views(V.BLOCKS, V.OUTLINE, _SHEET, body="""
SELECT doc_id, b + 1 AS row, code AS c, kind AS k, place AS b, '' AS message FROM ok_v
UNION ALL SELECT doc_id, b + 1, '', '', -1, CASE WHEN e1 THEN 'depth is not 1 to 6: x' WHEN e2 THEN 'no title' ELSE 'no such page: 999999' END FROM row_v WHERE e1 OR e2 OR e3
UNION ALL SELECT doc_id, b + 1, '', '', -1, 'no page: that of the row above' FROM ok_v WHERE b % 5 = 3
UNION ALL SELECT doc_id, b + 1, '', '', -1, 'no address and no link of this name' FROM ok_v WHERE k = 'link' AND kind <> 'link'"""))
def rows_to_outline(spark, d):
    nodes, told = O.rows_to_outline(*_sheets(spark, d))
    return nodes.select("doc_id", "row", "c", "k", "b", F.lit("").alias("message")).union(told.select("doc_id", "row", F.lit(""), F.lit(""), F.lit(-1), "message"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, "ed_v AS (SELECT *, b % 4 = 1 AS moved, b % 6 = 1 AS named FROM outline_v WHERE k <> 'bullet')", body="""
SELECT doc_id, c, CASE WHEN named THEN 'n ' || t ELSE t END AS t, k, CASE WHEN moved THEN 0 ELSE b END AS b, CASE WHEN moved AND b <> 0 THEN 0.0 ELSE b + 0.5 END AS y, CASE WHEN named THEN '' ELSE 'd ' || b END AS d, CASE WHEN k = 'link' THEN 'l' || b ELSE '' END AS l FROM ed_v"""))
def rows_from_editor(spark, d):
    """Rows of outlines as an editor sends them back: every fourth on another page, every sixth with another title; the others keep place and text."""
    b = F.col("b")
    nodes = V.outline_v(spark, d).where("k <> 'bullet'")
    old = nodes.select("doc_id", "c", "k", "t", F.array(F.concat(F.lit("d "), b.cast("string"))).alias("d"), "b", (b + 0.5).cast("double").alias("y"), F.lit(1.0).alias("x"), F.when(F.col("k") == "link", F.concat(F.lit("l"), b.cast("string"))).alias("l"), F.lit(None).cast("string").alias("s"))
    edited = nodes.select("doc_id", (b + 1).alias("row"), F.size(F.split("c", r"\.")).cast("string").alias("depth"), F.when(b % 6 == 1, F.concat(F.lit("n "), "t")).otherwise(F.col("t")).alias("title"), F.when(b % 4 == 1, "1").otherwise((b + 1).cast("string")).alias("page"), F.lit("").alias("kind"), F.lit("").alias("url"), F.col("c").alias("from"))
    blocks = V.blocks_v(spark, d).select("doc_id", F.col("n").alias("block"), (F.col("n") + 1).alias("page"))
    got, _ = O.rows_from_editor(edited, old, blocks, spark.createDataFrame([], "doc_id long, id string, url string, text string"))
    none = F.lit("")
    return got.select("doc_id", "c", "t", "k", "b", "y", F.coalesce(F.array_join("d", "|"), none).alias("d"), F.coalesce("l", none).alias("l"))


@query(V.with_views(V.SECTIONS, V.LINKS, "own_v AS (SELECT page_id AS doc_id, i % 3 AS s, i % 5 AS form_no, min(i) AS i FROM links_v GROUP BY page_id, i % 3, i % 5)", body="""
SELECT doc_id, s, text, block_end - block_start + 1 AS blocks, coalesce((SELECT string_agg(form_no || ' ' || l.text, ' | ' ORDER BY form_no) FROM own_v o JOIN links_v l ON l.page_id = o.doc_id AND l.i = o.i WHERE o.doc_id = x.doc_id AND o.s = x.s), '') AS forms FROM sections_v x"""))
def section_detail(spark, d):
    """Sections with their blocks and forms, one of each number, the first; links of a page belong to its document's first three sections in turn."""
    links = V.links_v(spark, d).select(F.col("page_id").alias("doc_id"), (F.col("i") % 3).alias("s"), (F.col("i") % 5).alias("form_no"), "i", "text")
    first = links.groupBy("doc_id", "s", "form_no").agg(F.min_by("text", "i").alias("text"))
    forms = first.groupBy("doc_id", "s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("form_no", "text"))), lambda x: F.concat_ws(" ", x["form_no"], x["text"])), " | ").alias("forms"))
    return V.sections_v(spark, d).join(forms, ["doc_id", "s"], "left").select("doc_id", "s", "text", (F.col("block_end") - F.col("block_start") + 1).alias("blocks"), F.coalesce("forms", F.lit("")).alias("forms"))


# ---- earlier exports, sheets, written documents ---------------------------------------------------


def _chunks(spark, d) -> DataFrame:
    """Turns of conversations in parts of 300 characters: every fifth turn's without overlap, others' overlapping by 30 to 69."""
    rows = table(spark, d, "conversations").where("text is not null and text <> ''").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    share = F.when(F.col("turn") % 5 == 0, 0).otherwise(30 + F.col("conv_id") % 40).cast("int")
    rows = rows.withColumn("step", 300 - share)
    at = F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / F.col("step")).cast("int")), lambda i: i * F.col("step"))
    parts = rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + 1).cast("int").alias("location"), F.posexplode(at).alias("part", "at"), "text")
    return parts.select("doc_id", "location", "part", F.substring("text", F.col("at") + 1, F.lit(300)).alias("text"))


_CHUNKS = """turn_v AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text <> '' GROUP BY conv_id, turn), step_v AS (SELECT *, (300 - CASE WHEN turn % 5 = 0 THEN 0 ELSE 30 + conv_id % 40 END)::INTEGER AS step FROM turn_v),
part_v AS (SELECT conv_id AS doc_id, (turn * 2 + 1)::INTEGER AS location, i AS part, trim(regexp_replace(regexp_replace(substr(text, i * step + 1, 300), ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10)) AS text FROM (SELECT *, unnest(range(0, (length(text) - 1) // step + 1)) AS i FROM step_v)),
join_v AS (SELECT doc_id, location, part, text FROM part_v WHERE part = 0 UNION ALL
  SELECT j.doc_id, j.location, p.part, j.text || CASE WHEN o = 0 AND j.text <> '' THEN chr(10) ELSE '' END || substr(p.text, o + 1) FROM (
    SELECT j.*, coalesce(list_max(list_filter(range(20, least(length(j.text), length(p.text), 600) + 1), lambda k: right(j.text, k) = left(p.text, k))), 0) AS o FROM join_v j JOIN part_v p ON p.doc_id = j.doc_id AND p.location = j.location AND p.part = j.part + 1) j
  JOIN part_v p ON p.doc_id = j.doc_id AND p.location = j.location AND p.part = j.part + 1),
v1_v AS (SELECT doc_id, location, arg_max(text, part) AS text FROM join_v GROUP BY doc_id, location)"""


@query(V.with_views(_CHUNKS, body="SELECT doc_id, location, text FROM v1_v"))
def read_v1(spark, d):
    return C.read_v1(_chunks(spark, d))


@query(V.with_views(_CHUNKS, f"""whole_v AS (SELECT doc_id, n, location, coalesce(text, '') AS text FROM (SELECT doc_id, unnest(range(0, max(location) + 2)) AS n, unnest(range(1, max(location) + 3)) AS location FROM v1_v GROUP BY doc_id) LEFT JOIN v1_v USING (doc_id, location)),
full_v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS s FROM whole_v WHERE length({V.sql_norm('text')}) >= 15)""", body="""
SELECT doc_id, s::INTEGER AS s, n::INTEGER AS block_start, n::INTEGER AS block_end, 'conv ' || doc_id || ' ' || location || '쪽' AS heading, CASE WHEN location % 3 = 0 THEN 'k' || location || ',all' ELSE '' END AS keywords FROM full_v"""))
def migrate_v1(spark, d):
    """Conversations of an earlier export as documents of a page for each turn: missing pages in between, a section for each page, keywords of every third page."""
    pages = C.read_v1(_chunks(spark, d))
    top = pages.groupBy("doc_id").agg(F.max("location").alias("top"))
    blocks = C.migrate_v1(pages, top.select("doc_id", (F.col("top") + 2).alias("size")))
    none = F.lit(None)
    rows = blocks.withColumns({"printed_page": none.cast("int"), "footer_label": F.lit(""), "lines": none.cast("array<struct<text:string,size:double>>")})
    sections = P.sections_from_headings(rows, top.select("doc_id", F.concat(F.lit("conv "), F.col("doc_id").cast("string")).alias("title")))
    words = pages.where("location % 3 = 0").select("doc_id", F.col("location").alias("page"), F.concat(F.lit("k"), F.col("location").cast("string"), F.lit(" , all\nall")).alias("keywords"))
    told = C.page_keywords(sections.select("doc_id", "s", "block_start", "block_end"), words)
    return sections.join(told, ["doc_id", "s"], "left").select("doc_id", "s", "block_start", "block_end", "heading", F.coalesce(F.array_join("keywords", ","), F.lit("")).alias("keywords"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, body="""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b))::INTEGER AS row, c AS code, '단계 "' || t || '", x' AS title FROM outline_v WHERE doc_id % 3 <> 2 UNION ALL
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b))::INTEGER, c, '단계' FROM outline_v WHERE doc_id % 3 = 2"""))
def read_toc_csv(spark, d):
    """A sheet for each outline as a file's bytes: commas and UTF-8, tabs and UTF-8, or commas and the Korean code page, with quoted cells."""
    i = F.col("doc_id") % 3
    quoted = F.concat(F.lit('"'), F.replace(F.concat(F.lit('단계 "'), "t", F.lit('", x')), F.lit('"'), F.lit('""')), F.lit('"'))
    tab = F.when(i == 1, "\t").otherwise(",")
    # the third kind holds the bytes of one Korean word and ASCII codes
    line = F.when(i == 2, F.concat(F.encode("c", "UTF-8"), F.unhex(F.lit("2CB4DCB0E8")))).otherwise(F.encode(F.concat("c", tab, quoted), "UTF-8"))
    head = F.when(i == 2, F.unhex(F.lit("B9F8C8A32CB4DCB0E8"))).otherwise(F.encode(F.concat(F.lit("번호"), tab, F.lit("단계")), "UTF-8"))
    rows = V.outline_v(spark, d).select("doc_id", "b", F.hex(line).alias("h"), F.hex(head).alias("head"))
    own = rows.groupBy("doc_id").agg(F.first("head").alias("head"), F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]).alias("lines"))
    files = own.select(F.col("doc_id").cast("string").alias("path"), F.unhex(F.concat_ws("0D0A", "head", F.array_join("lines", "0D0A"))).alias("content"))
    return C.read_sheets(files).where("row > 0").select(F.col("path").cast("long").alias("doc_id"), "row", F.get("cells", F.lit(0)).alias("code"), F.get("cells", F.lit(1)).alias("title"))


@query(V.with_views(V.DOCS, V.SECTIONS, body="SELECT doc_id, title, array_to_string(levels, ',') AS levels, year, count(s) AS sections, coalesce(max(block_end), -1) AS last_block FROM docs_v LEFT JOIN sections_v USING (doc_id) GROUP BY doc_id, title, levels, year"))
def read_documents(spark, d):
    """Documents with nested sections, written as JSON arrays over several lines, five hundred to a file, and read by schema."""
    own = V.sections_v(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "block_start", "block_end", "heading"))).alias("sections"))
    docs = V.docs_v(spark, d).select("doc_id", "title", "levels", "year").join(own, "doc_id", "left")
    files = docs.groupBy((F.col("doc_id") / 500).cast("long").alias("part")).agg(F.to_json(F.collect_list(F.struct(*docs.columns)), {"pretty": "true"}).alias("value"))
    path = path_of(spark, "details")
    files.write.partitionBy("part").text(path)
    got = spark.read.schema(docs.schema).option("multiLine", True).json(f"{path}/*")
    last = F.coalesce(F.element_at("sections", -1)["block_end"], F.lit(-1))
    return got.select("doc_id", "title", F.array_join("levels", ",").alias("levels"), "year", F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("sections"), last.alias("last_block"))


# ---- letter-spaced texts --------------------------------------------------------------------------


@query(V.with_views(V.BLOCKS, body="SELECT doc_id, n, '연수계획서 ' || text AS text FROM blocks_v"))
def join_spaced(spark, d):
    """Whole blocks with a letter-spaced heading before them."""
    own = F.concat(F.lit("연 수 계 획 서 "), "text")
    return V.blocks_v(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), spacing.join_spaced(own).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN array_to_string(list_transform(range(0, 40), lambda i: '연수계획서안내'), '. ') || '. ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents")
def repair_spaced_docs(spark, d):
    """Documents whose Hangul words are mostly single letters get them rejoined; every fourth has a letter-spaced foreword."""
    fore = F.repeat(F.lit("연 수 계 획 서 안 내. "), 40)
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(fore, text)).otherwise(text).alias("text")).withColumn("ratio", T.spaced_ratio(F.col("text")))
    flagged = rows.where("ratio > 0.5").select("doc_id", spacing.join_spaced_more("text").alias("text"))
    return flagged.unionByName(rows.where("ratio <= 0.5").select("doc_id", "text"))
