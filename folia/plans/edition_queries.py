"""Upkeep of the catalog: edits, new editions, storage, batches of new files, written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import spacing
from folia.functions import text as T
from folia.operators import catalog as C
from folia.operators import documents as D
from folia.operators import edges as E
from folia.operators import storage as R
from folia.plans import index_queries as I
from folia.plans import link_queries as L
from folia.plans import views as V
from folia.registry import query
from folia.sources.tables import table
from folia.sources.written import written


@query(V.with_views(V.BLOCKS, body=f"SELECT doc_id, n, regexp_matches(text, '(?i)t{T.GAP}h{T.GAP}e{T.GAP}o') AS hit FROM blocks_v"))
def loose_regex(spark, d):
    return V.blocks_v(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), F.regexp_like("text", T.loose_pattern(F.lit("the o"))).alias("hit"))


def _sql_gaps(w: str) -> str:
    return f"array_to_string(string_split({V.sql_norm(w)}, ''), '{T.GAP}')"


def _sql_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_HIT = f"regexp_replace(raw, '(?i)(' || {_sql_gaps('w')} || '|' || {_sql_gaps("'the o'")} || ')', chr(1) || '\\1' || chr(2), 'g')"


@query(V.with_views(V.BLOCKS, body=f"""
SELECT doc_id, n, CASE WHEN {V.sql_norm("w")} = '' THEN {_sql_escape("raw")} ELSE replace(replace({_sql_escape(_HIT)}, chr(1), '<mark>'), chr(2), '</mark>') END AS text
FROM (SELECT doc_id, n, '<b> "' || text || '" & ''co''' AS raw, CASE WHEN n % 3 = 2 THEN ' . ' ELSE regexp_extract(text, '[A-Za-z]{{2,}}') END AS w FROM blocks_v)"""))
def highlight_terms(spark, d):
    """The first word of each line and two fixed ones, with gaps between letters; in every third line none."""
    raw = F.concat(F.lit('<b> "'), "text", F.lit("\" & 'co'"))
    word = F.regexp_extract("text", "[A-Za-z]{2,}", 0)
    n = F.col("n")
    terms = F.when((n % 3 == 2) | (T.norm(word) == ""), F.array(F.lit(" . "))).otherwise(F.array(word, F.lit("the o")))
    return V.blocks_v(spark, d).select("doc_id", n.cast("long").alias("n"), T.highlight_terms(raw, terms).alias("text"))


@query(V.with_views(V.BLOCKS, body="SELECT doc_id, n, length(regexp_replace(text || 'ϡܐ', '[가-힣ㄱ-ㆎ一-鿿 -~·°×‐-⁯⅐-⇿①-➿\\x{3000}-〿㈀-㏿＀-￯]', '', 'g')) AS odd FROM blocks_v"))
def odd_chars(spark, d):
    return V.blocks_v(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), T.odd_chars(F.concat("text", F.lit("ϡܐ"))).cast("long").alias("odd"))


@query(V.with_views(V.DOCS, body="SELECT doc_id, trim(title) AS title FROM docs_v"))
def strip_part(spark, d):
    part = F.element_at(F.array(F.lit("Ⅱ. "), F.lit("IV ")), (F.col("doc_id") % 2 + 1).cast("int"))
    return V.docs_v(spark, d).select("doc_id", F.trim(T.strip_part(F.concat(part, "title"))).alias("title"))


@query(V.with_views(V.BLOCKS, body=f"SELECT doc_id, n, length({V.sql_norm('text')}) < 15 AS empty FROM blocks_v"))
def is_empty_block(spark, d):
    return V.blocks_v(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), (F.length(T.norm(F.col("text"))) < 15).alias("empty"))


_MARKED = "CASE n % 6 WHEN 0 THEN 'Ⅲ. ' WHEN 1 THEN 'XI ．' WHEN 2 THEN 'VI' WHEN 3 THEN 'i. ' ELSE '' END || CASE WHEN n % 4 < 2 THEN left(text, 27) ELSE text END"


@query(V.with_views(V.BLOCKS, body=f"SELECT doc_id, n, regexp_matches({_MARKED}, '^\\s*(?:Ⅲ|[IVX]{{1,4}})\\s*[.．]\\s*[^\\s].{{0,25}}$') AS marker FROM blocks_v"))
def is_section_marker(spark, d):
    """Lines behind roman numbers with and without a full stop, whole or cut."""
    n = F.col("n")
    mark = F.coalesce(*(F.when(n % 6 == i, m) for i, m in enumerate(("Ⅲ. ", "XI ．", "VI", "i. "))), F.lit(""))
    line = F.concat(mark, F.when(n % 4 < 2, F.left("text", F.lit(27))).otherwise(F.col("text")))
    return V.blocks_v(spark, d).select("doc_id", n.cast("long").alias("n"), E.is_marker(line).alias("marker"))


@query(V.with_views(V.LINKS, body="SELECT page_id, i, CASE WHEN i % 2 = 1 THEN 'https://files.example.org/boardCnts/fileDown.do?m=' || page_id || '&s=x&fileSeq=' || i ELSE '' END AS url FROM links_v WHERE page_id IN (SELECT page_id FROM links_v GROUP BY page_id HAVING max(i) >= 0)"))
def suggest_url(spark, d):
    """Addresses that lost their board's parameters, with those of the first sound address of the same page."""
    host = "https://files.example.org/boardCnts/fileDown.do?"
    board = F.concat(F.lit("m="), F.col("page_id").cast("string"), F.lit("&s=x&"))
    rows = V.links_v(spark, d).select("page_id", "i", F.concat(F.lit(host), F.when(F.col("i") % 2 == 0, board).otherwise(""), F.lit("fileSeq="), F.col("i").cast("string")).alias("url"))
    sample = rows.where(~T.suspect_url(F.col("url"))).groupBy("page_id").agg(F.regexp_extract(F.min_by("url", "i"), r"[?&](m=[^&]+&s=[^&]+)", 1).alias("board"))
    fixed = F.when(T.suspect_url(F.col("url")), F.concat(F.lit(host), "board", F.lit("&"), F.substring_index("url", "?", -1))).otherwise("")
    return rows.join(sample, "page_id", "left").select("page_id", "i", fixed.alias("url"))


@query(V.with_views(V.SECTIONS, body="SELECT doc_id, s, 'PDF ' || (block_start + 1) || CASE WHEN block_end > block_start THEN '~' || (block_end + 1) ELSE '' END || '쪽' || CASE WHEN block_start > 3 THEN '(인쇄 ' || (block_start - 3) || CASE WHEN block_end > block_start THEN '~' || (block_end - 3) ELSE '' END || '쪽)' ELSE '' END AS label FROM sections_v"))
def page_label(spark, d):
    pages = F.sequence(F.col("block_start") + 1, F.col("block_end") + 1)
    printed = F.when(F.col("block_start") > 3, F.transform(pages, lambda p: p - 4)).otherwise(F.array().cast("array<int>"))
    return V.sections_v(spark, d).select("doc_id", "s", T.page_label(pages, printed).alias("label"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{D.COMMON_DEPARTMENT}' ELSE '' END AS department FROM documents")
def default_department(spark, d):
    """Every third document comes from the site of common material, another third from its source, the rest from none."""
    i = F.col("doc_id")
    site = F.when(i % 3 == 0, D.COMMON_SITE).when(i % 3 == 1, F.col("source"))
    return table(spark, d, "documents").select("doc_id", D.default_department(site).alias("department"))


@query(V.with_views(V.DOCS, V.SECTIONS, body="""
SELECT doc_id, s, s % 7 <> 0 AND (s % 5 = 1 OR (doc_id % 3 <> 0 AND (format = 'hwpx' OR regexp_matches(heading || CASE WHEN s % 2 = 0 THEN ' 구간 ' || s ELSE '' END, '\\s[0-9]+쪽$|\\s구간 [0-9]+$')))) AS untitled FROM sections_v JOIN docs_v USING (doc_id)"""))
def is_untitled(spark, d):
    """Names that somebody has set, marked ones, those of documents with and without contents, and of paragraphs."""
    s = F.col("s")
    name = F.concat("heading", F.when(s % 2 == 0, F.concat(F.lit(" 구간 "), s.cast("string"))).otherwise(""))
    rows = V.sections_v(spark, d).join(V.docs_v(spark, d).select("doc_id", "format"), "doc_id")
    return rows.select("doc_id", "s", D.is_untitled(s % 7 != 0, s % 5 == 1, F.col("doc_id") % 3 == 0, F.col("format"), name).alias("untitled"))


@query(V.with_views(V.SECTIONS, body="""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, s))::INTEGER AS id, a AS block_start, z AS block_end, auto FROM (
  SELECT doc_id, s, CASE WHEN s % 4 = 1 AND block_end > block_start THEN block_start + 1 ELSE block_start END AS a, block_end AS z, NOT (s % 4 = 1 AND block_end > block_start) AS auto FROM sections_v)"""))
def edit_sections(spark, d):
    """Sections with their intervals changed where an edit is valid; edited ones aren't automatic any more."""
    own = V.sections_v(spark, d)
    edits = own.where("s % 4 = 1").select("doc_id", "s", (F.col("block_start") + 1).alias("a"))
    ok = F.col("a").isNotNull() & (F.col("a") <= F.col("block_end"))
    new = own.join(edits, ["doc_id", "s"], "left").withColumns({"block_start": F.when(ok, F.col("a")).otherwise(F.col("block_start")), "auto": ~ok})
    return new.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_start", "s")).alias("id"), "block_start", "block_end", "auto")


@query(V.with_views(V.LINKS, "sec_v AS (SELECT page_id, s, s * 3 AS a, s * 3 + 2 AS z FROM (SELECT page_id, unnest(range(0, max(i) // 3 + 1)) AS s FROM links_v GROUP BY page_id))", body="SELECT l.page_id, l.i, s.s::INTEGER AS s FROM links_v l JOIN sec_v s ON s.page_id = l.page_id AND l.i BETWEEN s.a AND s.z"))
def reassign_links(spark, d):
    links = V.links_v(spark, d)
    n = links.groupBy("page_id").agg(F.max("i").alias("top")).select("page_id", F.explode(F.sequence(F.lit(0), (F.col("top") / 3).cast("int"))).alias("s"))
    return L.owned(links, n.select("page_id", "s", (F.col("s") * 3).alias("a"), (F.col("s") * 3 + 2).alias("z"))).select("page_id", "i", "s")


_SHEETS = """sheet_v AS (SELECT '목차_' || title || ' ' || doc_id || '.xlsx' AS name, CASE WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 3 = 1 THEN -doc_id - 1 END AS given, CASE WHEN doc_id % 5 = 4 THEN title || doc_id ELSE title END AS said FROM docs_v)"""


@query(V.with_views(V.DOCS, _SHEETS, body=f"""
SELECT name, coalesce(doc_id, -1) AS doc_id, how, CASE WHEN doc_id IS NULL THEN 'unknown' WHEN row_number() OVER (PARTITION BY doc_id ORDER BY name DESC) > 1 THEN 'repeated' ELSE '' END AS problem FROM (
  SELECT name, coalesce(i.doc_id, t.doc_id) AS doc_id, CASE WHEN i.doc_id IS NOT NULL THEN 'id' WHEN t.doc_id IS NOT NULL THEN 'name' ELSE '' END AS how
  FROM sheet_v LEFT JOIN docs_v i ON i.doc_id = given LEFT JOIN (SELECT {V.sql_norm('title')} AS key, max(doc_id) AS doc_id FROM docs_v GROUP BY ALL) t ON t.key = {V.sql_norm('said')})"""))
def bulk_toc_match(spark, d):
    """A sheet for every document: a third with its id, a third with an unknown one, the rest, and those of unknown ids, by the name."""
    i = F.col("doc_id")
    docs = V.docs_v(spark, d).select("doc_id", "title")
    name = F.concat(F.lit("목차_"), "title", F.lit(" "), i.cast("string"), F.lit(".xlsx"))
    sheets = docs.select(name.alias("name"), F.when(i % 3 == 0, i).when(i % 3 == 1, -i - 1).alias("given"), F.when(i % 5 == 4, F.concat("title", i.cast("string"))).otherwise(F.col("title")).alias("title"))
    got = C.match_sheets(sheets, docs)
    return got.select("name", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "how", "problem")


@query(V.with_views(V.DOCS, body="""
SELECT doc_id, CASE WHEN new THEN year + 1 ELSE year END AS year, CASE WHEN new THEN (year + 1) || ' ' || title ELSE year || ' ' || title END AS title,
  CASE WHEN new AND (doc_id % 2 = 0 OR doc_id % 7 = 0) THEN 'new' ELSE CASE WHEN doc_id % 7 = 0 THEN '' ELSE levels[1] END END AS levels, CASE WHEN new AND doc_id % 3 = 0 THEN 'new category' ELSE format END AS category,
  CASE WHEN new AND doc_id % 4 = 0 THEN 'new department' ELSE department END AS department, CASE WHEN new AND doc_id % 20 = 0 THEN 'http://new' ELSE 'http://' || doc_id END AS works_url, CASE WHEN new AND doc_id % 25 = 0 THEN 'new site' ELSE 'old site' END AS site, created_at
FROM (SELECT *, doc_id % 5 = 0 AS new FROM docs_v)"""))
def replace_edition(spark, d):
    """Documents after new editions of every fifth, which say some fields and leave others; levels guessed from a file's name don't count, but where there are none."""
    i = F.col("doc_id")
    some = lambda test, x: F.when(test, F.lit(x))
    docs = V.docs_v(spark, d).select("doc_id", F.concat_ws(" ", "year", "title").alias("title"), "year", F.when(i % 7 != 0, F.col("levels")).otherwise(F.array().cast("array<string>")).alias("levels"), F.col("format").alias("category"), "department", F.concat(F.lit("http://"), i.cast("string")).alias("works_url"), F.lit("old site").alias("site"), "created_at")
    new = docs.where(i % 5 == 0).select("doc_id", F.lit(None).cast("string").alias("title"), (F.col("year") + 1).alias("year"), F.array(F.lit("new")).alias("levels"), F.when(i % 2 == 0, "folder").otherwise("file").alias("levels_from"), some(i % 3 == 0, "new category").alias("category"), some(i % 4 == 0, "new department").alias("department"), some(i % 20 == 0, "http://new").alias("works_url"), some(i % 25 == 0, "new site").alias("site"))
    got = C.replace_editions(docs, new)
    return got.select("doc_id", "year", "title", F.array_join("levels", ",").alias("levels"), "category", "department", "works_url", "site", "created_at")


_YEAR, _ROOM = 2026, 20_000
_STORED = f"""file_v AS (SELECT department AS site, doc_id, bytes, format, doc_id % 4 <> 3 AS wanted, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN doc_id % 3 + 1 END AS lies FROM docs_v),
taken_v AS (SELECT site, n, sum(bytes)::BIGINT AS bytes FROM (SELECT site, doc_id % 2 + 1 AS n, bytes FROM file_v WHERE NOT wanted UNION ALL SELECT site, 2, bytes // 4 FROM file_v WHERE doc_id % 6 = 1) GROUP BY site, n),
turn_v AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY doc_id) AS r FROM file_v WHERE wanted),
fit_v AS (
  SELECT site, 0::BIGINT AS r, list_transform(range(1, 52), lambda i: coalesce(list_sum(list_transform(list_filter(t, lambda x: x.n = i), lambda x: x.bytes)), 0)::BIGINT) AS used, 0::BIGINT AS n, 0::BIGINT AS doc_id
  FROM (SELECT site, coalesce(list({{'n': n, 'bytes': bytes}}) FILTER (n IS NOT NULL), []) AS t FROM (SELECT DISTINCT site FROM turn_v) LEFT JOIN taken_v USING (site) GROUP BY site)
  UNION ALL SELECT site, r, list_transform(range(1, 52), lambda i: used[i] + CASE WHEN i = n THEN bytes ELSE 0 END), n, doc_id FROM (
    SELECT t.site, t.r, used, t.doc_id, t.bytes, CASE WHEN used[lies] + t.bytes <= {_ROOM} THEN lies ELSE coalesce(list_position(list_transform(used[1:50], lambda u: u + t.bytes <= {_ROOM}), true), 51) END AS n
    FROM fit_v f JOIN turn_v t ON t.site = f.site AND t.r = f.r + 1))"""


@query(V.with_views(V.DOCS, _STORED, body=f"SELECT site, f.doc_id, 'store_{_YEAR}_' || n AS store, 'files/' || f.doc_id || '.' || format AS path FROM fit_v f JOIN file_v USING (site, doc_id) WHERE r > 0"))
def plan_storage(spark, d):
    """Three of four files of each department are published; some lie in stores of this year or the last, others and editable ones take room."""
    i = F.col("doc_id")
    files = V.docs_v(spark, d).select(F.col("department").alias("site"), "doc_id", i.alias("place"), "bytes", "format")
    name = lambda year, n: F.concat(F.lit("store_"), (year).cast("string"), F.lit("_"), n.cast("string"))
    wanted = files.where(i % 4 != 3).withColumn("store", F.when(i % 5 == 0, name(_YEAR - i % 2, i % 3 + 1)))
    used = files.where(i % 4 == 3).select("site", name(F.lit(_YEAR), i % 2 + 1).alias("store"), "bytes")
    edits = files.where(i % 6 == 1).select("site", name(F.lit(_YEAR), F.lit(2)).alias("store"), F.floor(F.col("bytes") / 4).alias("bytes"))
    return R.plan_storage(wanted, used.unionByName(edits), _YEAR, _ROOM)


@query(V.with_views(V.DOCS, I._LEVEL_DOCS, V.SECTIONS, I._REFS, I._POST, body=f"SELECT level, {V.sql_shard('gram')} AS shard, count(DISTINCT gram) AS grams, sum(len(refs))::BIGINT AS refs FROM post_v GROUP BY ALL"))
def write_shards(spark, d):
    """Posting lists written by level and shard, and counted from the files."""
    files = I.index(spark, d)[0]
    return files.groupBy("level", "shard").agg(F.count_distinct("gram").alias("grams"), F.sum(F.size(F.split("code", ","))).cast("long").alias("refs"))


@query(V.with_views(V.DOCS, V.SECTIONS, body="SELECT doc_id, title, count(s) AS sections FROM docs_v LEFT JOIN sections_v USING (doc_id) GROUP BY doc_id, title"))
def write_details(spark, d):
    """Documents with nested sections as JSON, and read again by schema."""
    own = V.sections_v(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "block_start", "block_end", "heading"))).alias("sections"))
    files = written(V.docs_v(spark, d).select("doc_id", "title", "levels").join(own, "doc_id", "left"), "details", kind="json")
    return files.select("doc_id", "title", F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("sections"))

