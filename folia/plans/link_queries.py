"""Links, forms, outlines and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.plans import views as V
from folia.registry import query
from folia.sources.tables import table

# pages as documents: the block of a link is its number; sections of five blocks, the last of them overlapping
_SECTIONS = "sec_v AS (SELECT page_id, s, s * 5 AS a, s * 5 + 5 AS z FROM (SELECT page_id, unnest(range(0, max(i) // 5 + 1)) AS s FROM links_v GROUP BY page_id))"
_OWNED = """own_v AS (SELECT l.page_id, l.i, l.url, l.text, max(s.s) AS s FROM links_v l LEFT JOIN sec_v s ON s.page_id = l.page_id AND l.i BETWEEN s.a AND s.z GROUP BY ALL)"""


def page_sections(links: DataFrame) -> DataFrame:
    n = links.groupBy("page_id").agg(F.max("i").alias("top")).select("page_id", F.explode(F.sequence(F.lit(0), (F.col("top") / 5).cast("int"))).alias("s"))
    return n.select("page_id", "s", (F.col("s") * 5).alias("a"), (F.col("s") * 5 + 5).alias("z"))


def owned(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Links with the last section whose interval holds their block; no section covers more blocks than it has, so it's spread over them."""
    blocks = sections.select("page_id", "s", F.explode(F.sequence("a", "z")).alias("i")).groupBy("page_id", "i").agg(F.max("s").alias("s"))
    return links.join(blocks, ["page_id", "i"], "left")


def attach(links: DataFrame, sections: DataFrame) -> DataFrame:
    """(page_id, id, s, url, i, text): one link for each section and address.

    Its place is the first one's; its text is the longest, of equally long ones the first, unless the longer
    one holds closing quotation brackets, which mean that a link covers part of a name only.
    """
    rows = owned(links, sections).withColumn("text", F.when(F.col("text") == "", F.col("url")).otherwise(F.col("text")))
    firsts = rows.groupBy("page_id", "s", "url").agg(F.min("i").alias("i"), F.min_by("text", "i").alias("first"), F.max_by("text", F.when(~F.col("text").rlike("[」』]"), F.struct(F.length("text"), -F.col("i")))).alias("long"))
    text = F.when(F.length("long") > F.length("first"), F.col("long")).otherwise(F.col("first"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[「『」』]", ""), r"^[\s,，.·]+|[\s,，]+$", ""), r"\s+", " ")
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("i"))
    return firsts.select("page_id", F.concat(F.lit("lnk-"), F.lpad(number.cast("string"), 4, "0")).alias("id"), "s", "url", "i", F.when(clean == "", F.col("url")).otherwise(clean).alias("text"))


_ATTACH = r"""attach_v AS (SELECT page_id, 'lnk-' || lpad((row_number() OVER (PARTITION BY page_id ORDER BY i))::VARCHAR, 4, '0') AS id, s::INTEGER AS s, url, i, CASE WHEN x = '' THEN url ELSE x END AS text
  FROM (SELECT page_id, s, url, min(i) AS i, regexp_replace(regexp_replace(arg_max(text, length(text) * 100000 - i), '^[\s,，.·]+|[\s,，]+$', '', 'g'), '\s+', ' ', 'g') AS x FROM (SELECT * REPLACE (CASE WHEN text = '' THEN url ELSE text END AS text) FROM own_v) GROUP BY page_id, s, url))"""


def _attached(spark, d):
    links = V.links_v(spark, d)
    return attach(links, page_sections(links))


@query(V.with_views(V.LINKS, _SECTIONS, _OWNED, _ATTACH, body="SELECT * FROM attach_v"))
def attach_links(spark, d):
    return _attached(spark, d)


_NUMBER = """form_v AS (SELECT page_id, id, s, url, text, CASE WHEN manual THEN 1 ELSE 0 END AS manual, (dense_rank() OVER (PARTITION BY page_id ORDER BY first))::INTEGER AS form_no
  FROM (SELECT *, min(o) OVER (PARTITION BY page_id, url) AS first FROM (SELECT *, i % 11 = 7 AS manual, i + CASE WHEN i % 11 = 7 THEN 1000000 ELSE 0 END AS o FROM attach_v WHERE regexp_matches(url, '(?i)fileDown')))
)"""


def safe_name(text: Column) -> Column:
    """At most 60 characters that file names may hold."""
    return F.trim(F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|]', ""), r"\s+", " ")), F.lit(60)))


def numbered(links: DataFrame) -> DataFrame:
    """Links to files with form_no: by first appearance of the address, those added by hand (manual) behind the others."""
    order = F.struct(F.coalesce("manual", F.lit(False)).alias("m"), F.col("i"), F.col("id"))
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("manual:"), "id"))
    files = links.where(T.link_kind(F.col("url")) == "file").withColumns({"_key": key, "_o": order})
    first = files.withColumn("_f", F.min("_o").over(Window.partitionBy("page_id", "_key")))
    return first.withColumn("form_no", F.dense_rank().over(Window.partitionBy("page_id").orderBy("_f")))


def _forms(spark, d):
    return numbered(_attached(spark, d).withColumn("manual", F.col("i") % 11 == 7))


@query(V.with_views(V.LINKS, _SECTIONS, _OWNED, _ATTACH, _NUMBER, body="SELECT page_id, id, form_no, manual FROM form_v"))
def number_forms(spark, d):
    return _forms(spark, d).select("page_id", "id", "form_no", F.col("manual").cast("int").alias("manual"))


@query(V.with_views(V.LINKS, _SECTIONS, _OWNED, _ATTACH, _NUMBER, body="SELECT page_id, form_no, min(id) AS id FROM form_v GROUP BY page_id, form_no"))
def form_list(spark, d):
    return _forms(spark, d).groupBy("page_id", "form_no").agg(F.min("id").alias("id"))


_SAFE = r"""trim(left(trim(regexp_replace(regexp_replace(text, '[\\/:*?"<>|]', '', 'g'), '\s+', ' ', 'g')), 60))"""


@query(V.with_views(V.LINKS, _SECTIONS, _OWNED, _ATTACH, _NUMBER, body=f"""
SELECT page_id, coalesce(s, -1) AS s, CASE WHEN s IS NULL THEN '기타' WHEN s % 2 = 0 THEN '단원 ' || (s // 2) || ' › 업무 ' || s ELSE '업무 ' || s END AS title, string_agg(lpad(form_no::VARCHAR, 3, '0') || '_' || {_SAFE}, ' | ' ORDER BY form_no) AS forms, count(*) AS n
FROM (SELECT page_id, form_no, arg_min(s, id) AS s, arg_min(text, id) AS text FROM form_v GROUP BY page_id, form_no) GROUP BY page_id, s"""))
def forms_by_section(spark, d):
    """Each form once, below its first section; every second section stands below a heading."""
    forms = _forms(spark, d).groupBy("page_id", "form_no").agg(F.min_by("s", "id").alias("s"), F.min_by("text", "id").alias("text"))
    s = F.col("s")
    sections = page_sections(V.links_v(spark, d)).select("page_id", "s", F.concat(F.lit("업무 "), s.cast("string")).alias("heading"), F.when(s % 2 == 0, F.concat(F.lit("단원 "), F.floor(s / 2).cast("string"))).alias("parent_heading"))
    title = F.when(F.col("heading").isNull(), "기타").otherwise(F.concat_ws(" › ", F.nullif("parent_heading", F.lit("")), "heading"))
    rows = forms.join(sections, ["page_id", "s"], "left").withColumns({"title": title, "name": F.concat_ws("_", F.lpad(F.col("form_no").cast("string"), 3, "0"), safe_name(F.col("text")))})
    own = F.sort_array(F.collect_list(F.struct("form_no", "name")))
    return rows.groupBy("page_id", F.coalesce("s", F.lit(-1)).alias("s"), "title").agg(own.alias("f"), F.count("*").alias("n")).select("page_id", "s", "title", F.array_join("f.name", " | ").alias("forms"), "n")


@query(V.with_views(V.LINKS, _SECTIONS, _OWNED, _ATTACH, _NUMBER, body="SELECT page_id, (dense_rank() OVER (PARTITION BY page_id ORDER BY form_no))::INTEGER AS form_no, id FROM form_v WHERE manual = 0 OR right(id, 1) <> '2'"))
def remove_form(spark, d):
    kept = _forms(spark, d).where(~F.col("manual") | (F.right("id", F.lit(1)) != "2")).drop("form_no", "_key", "_o", "_f")
    return numbered(kept).select("page_id", "form_no", "id")


# ---- outlines -----------------------------------------------------------------------------------

_CHAT = "chat_v AS (SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS n, coalesce(text, '') AS text FROM conversations)"


def _chat(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (n - 1).alias("n"), F.coalesce("text", F.lit("")).alias("text"))


def chapters(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, n, role) with codes: a new chapter whenever the heading above changes, tasks counted inside."""
    w = Window.partitionBy("conv_id").orderBy("n")
    new = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")), 0).otherwise(1)
    run = rows.withColumn("_new", new).withColumn("ch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    task = F.row_number().over(Window.partitionBy("conv_id", "ch").orderBy("n"))
    return run.withColumn("c", F.concat_ws(".", "ch", task)).drop("_new")


_CHAPTERS = """chap_v AS (SELECT conv_id, n, ch || '.' || row_number() OVER (PARTITION BY conv_id, ch ORDER BY n) AS c FROM (
  SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM role AND n > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY n) AS ch FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM chat_v)))"""


@query(V.with_views(_CHAT, _CHAPTERS, body="SELECT conv_id, n, c FROM chap_v"))
def outline_chapters(spark, d):
    return chapters(_chat(spark, d)).select("conv_id", "n", "c")


@query(V.with_views(V.BLOCKS, V.OUTLINE, body="SELECT doc_id, c, (row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(c, '.'), lambda x: x::INTEGER), b))::INTEGER AS place FROM outline_v"))
def sort_outline(spark, d):
    key = F.transform(F.split("c", r"\."), lambda x: x.cast("int"))
    return V.outline_v(spark, d).select("doc_id", "c", F.row_number().over(Window.partitionBy("doc_id").orderBy(key, "b")).alias("place"))


_KEPT = "kept_v AS (SELECT doc_id, c FROM outline_v WHERE k <> 'bullet' AND NOT (k = 'task' AND b % 3 = 1))"


def reparent(nodes: DataFrame) -> DataFrame:
    """(doc_id, c, parent, depth): each node below its nearest surviving ancestor; depth counts those."""
    ups = nodes.select("doc_id", "c", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("c", r"\."))), lambda i: F.array_join(F.slice(F.split("c", r"\."), 1, i), "."))).alias("up")).where("up <> c")
    found = ups.join(nodes.select("doc_id", F.col("c").alias("up")).distinct(), ["doc_id", "up"]).groupBy("doc_id", "c").agg(F.max_by("up", F.length("up")).alias("parent"), F.count("*").alias("n"))
    return nodes.join(found, ["doc_id", "c"], "left").select("doc_id", "c", F.coalesce("parent", F.lit("")).alias("parent"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("depth"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, _KEPT, body="""
SELECT k.doc_id, k.c, coalesce(arg_max(p.c, length(p.c)), '') AS parent, (count(p.c) + 1)::INTEGER AS depth
FROM kept_v k LEFT JOIN kept_v p ON p.doc_id = k.doc_id AND starts_with(k.c, p.c || '.') GROUP BY k.doc_id, k.c"""))
def reparent_outline(spark, d):
    return reparent(V.outline_v(spark, d).where("k <> 'bullet' AND NOT (k = 'task' AND b % 3 = 1)").select("doc_id", "c"))


@query(V.with_views(V.BLOCKS, V.OUTLINE, _KEPT, body="""
SELECT doc_id, c, title FROM (SELECT doc_id, c, CASE WHEN b % 6 = 0 THEN lower(t) || ' *' ELSE t END AS title FROM outline_v)"""))
def outline_edits(spark, d):
    rows = V.outline_v(spark, d)
    edits = rows.where("b % 6 = 0").select("doc_id", "c", F.concat(F.lower("t"), F.lit(" *")).alias("new"))
    return rows.join(edits, ["doc_id", "c"], "left").select("doc_id", "c", F.coalesce("new", "t").alias("title"))


