"""Index building: catalog order, postings, counts, changes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.operators.numbering import number
from folia.operators.shards import PART, postings, write_index
from folia.plans import views as V
from folia.registry import query
from folia.sources.tables import table
from folia.sources.written import once, written

_LEVEL_DOCS = """level_v AS (
  SELECT level, doc_id, title, department, year, (row_number() OVER (PARTITION BY level ORDER BY year DESC, title, doc_id) - 1)::INTEGER AS n
  FROM (SELECT unnest(levels) AS level, doc_id, title, department, year FROM docs_v))"""
#: Sections in one level's postings: reference = document's number * SECTIONS + section.
SECTIONS = 1000


def level_order(docs: DataFrame, collation: str | None = None) -> DataFrame:
    """Documents once for each level, with their number in its order: latest year, then title, then id.

    With a collation, titles are compared by its rules.
    """
    rows = docs.withColumn("level", F.explode("levels"))
    return number(rows, "level", [F.desc("year"), F.collate("title", collation) if collation else F.col("title"), F.col("doc_id")], "n")


@query(V.with_views(V.DOCS, _LEVEL_DOCS, body="SELECT level, doc_id, n FROM level_v"))
def level_docs(spark, d):
    return level_order(V.docs_v(spark, d)).select("level", "doc_id", "n")


@query(V.with_views(V.DOCS, _LEVEL_DOCS, body=f"""
SELECT level, doc_id, (row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = '{V.COMMON}' THEN department ELSE '' END, year DESC, title, doc_id))::INTEGER AS place FROM level_v"""))
def sort_for_level(spark, d):
    rows = V.docs_v(spark, d).withColumn("level", F.explode("levels"))
    group = F.when(F.col("level") == V.COMMON, F.col("department")).otherwise("")
    placed = number(rows.withColumn("group", group), "level", [F.col("group"), F.desc("year"), F.col("title"), F.col("doc_id")], "place")
    return placed.select("level", "doc_id", (F.col("place") + 1).alias("place"))


def refs(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with their level and reference number.

    Every further SECTIONS sections of a long document take a number of their own behind the level's documents.
    """
    places = level_order(docs).select("doc_id", "level", "n")
    part = F.floor(F.col("s") / SECTIONS).cast("int")
    longer = sections.where(F.col("s") >= SECTIONS).select("doc_id", part.alias("part")).distinct()
    more = number(longer.join(places, "doc_id"), "level", ["n", "part"], "_k")
    more = more.join(places.groupBy("level").agg(F.count("*").cast("int").alias("_docs")), "level").select("doc_id", "level", "part", (F.col("_docs") + F.col("_k")).alias("_more"))
    rows = sections.join(places, "doc_id").withColumn("part", part).join(more, ["doc_id", "level", "part"], "left").drop("part")
    return rows.withColumn("ref", F.coalesce("_more", "n").cast("long") * SECTIONS + F.col("s") % SECTIONS).drop("_more")


_REFS = f"ref_v AS (SELECT s.*, l.level, l.n::BIGINT * {SECTIONS} + s.s AS ref FROM sections_v s JOIN level_v l USING (doc_id))"
_POST = f"post_v AS (SELECT level, gram, ref // {PART} AS part, list_sort(list(ref)) AS refs FROM (SELECT level, ref, unnest({V.sql_grams(V.sql_norm('text'))}) AS gram FROM ref_v) WHERE length(gram) = 2 GROUP BY level, gram, ref // {PART})"


def index(spark, d) -> tuple[DataFrame, DataFrame]:
    """(posting lists, (level, ref, doc_id, s)) as written once a session, for all searches."""
    own = lambda: refs(V.docs_v(spark, d), V.sections_v(spark, d))
    return once(spark, d, "documents", "lists", lambda: write_index(postings(own()))), once(spark, d, "documents", "refs", lambda: written(own().select("level", "ref", "doc_id", "s"), "refs"))


@query(V.with_views(V.DOCS, _LEVEL_DOCS, V.SECTIONS, _REFS, _POST, body="SELECT level, gram, part, array_to_string(refs, ',') AS refs FROM post_v"))
def body_postings(spark, d):
    return postings(refs(V.docs_v(spark, d), V.sections_v(spark, d))).select("level", "gram", "part", F.array_join("refs", ",").alias("refs"))


@query(V.with_views(V.DOCS, _LEVEL_DOCS, V.SECTIONS, _REFS, _POST, body=f"SELECT level, gram, part, {V.sql_shard('gram')} AS shard, array_to_string(list_transform(list_zip(refs, [0::BIGINT] || refs[1:len(refs) - 1]), lambda p: lower(to_base(p[1] - p[2], 36))), ',') AS code FROM post_v"))
def search_shards(spark, d):
    return postings(refs(V.docs_v(spark, d), V.sections_v(spark, d))).select("level", "gram", "part", T.gram_shard(F.col("gram")).alias("shard"), T.encode_postings(F.col("refs")).alias("code"))


_ALL_LEVELS = "(VALUES " + ", ".join(f"('{x}')" for x in V.LEVELS) + ") v(level)"


@query(V.with_views(V.DOCS, V.SECTIONS, body=f"""
SELECT v.level, coalesce(docs, 0) AS docs, coalesce(sections, 0)::BIGINT AS sections FROM {_ALL_LEVELS}
LEFT JOIN (SELECT level, count(*) AS docs, sum(n) AS sections FROM (SELECT unnest(levels) AS level, coalesce(n, 0) AS n FROM docs_v LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections_v GROUP BY doc_id) USING (doc_id)) GROUP BY level) c ON c.level = v.level"""))
def level_counts(spark, d):
    n = V.sections_v(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    own = V.docs_v(spark, d).select("doc_id", F.explode("levels").alias("level")).join(n, "doc_id", "left").groupBy("level").agg(F.count("*").alias("docs"), F.sum(F.coalesce("n", F.lit(0))).alias("sections"))
    known = spark.createDataFrame([(x,) for x in V.LEVELS], "level string")
    zero = F.lit(0).cast("long")
    return known.join(own, "level", "left").select("level", F.coalesce("docs", zero).alias("docs"), F.coalesce("sections", zero).alias("sections"))


@query("SELECT source AS department, count(*) AS docs FROM documents GROUP BY source")
def department_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("department")).agg(F.count("*").alias("docs"))


@query("SELECT lang AS level, count(*) AS files, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY lang")
def index_stats(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("level")).agg(F.count("*").alias("files"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("bytes"))


def _saved(spark, d, now: bool) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("doc_id") % (11 if now else 13) != 0)
    body = F.concat(F.coalesce("text", F.lit("")), F.when((F.col("doc_id") % 9 == 0) & F.lit(now), "!").otherwise(""))
    return docs.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), T.blob_sha(body).alias("sha"))


def changes(saved: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): new, changed and deleted files between two lists of (path, sha)."""
    both = now.withColumnRenamed("sha", "sha_now").join(saved.withColumnRenamed("sha", "sha_saved"), "path", "full")
    kind = F.when(F.col("sha_saved").isNull(), "new").when(F.col("sha_now").isNull(), "deleted").when(F.col("sha_now") != F.col("sha_saved"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


@query("SELECT 'documents/' || doc_id || '.json' AS path, CASE WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN 'new' WHEN doc_id % 11 = 0 AND doc_id % 13 <> 0 THEN 'deleted' ELSE 'changed' END AS change FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0) AND (doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 9 = 0)")
def index_diff(spark, d):
    return changes(_saved(spark, d, False), _saved(spark, d, True))


@query("SELECT 'documents/' || doc_id || '.json' AS path FROM documents WHERE doc_id % 9 = 0 OR (doc_id % 11 = 0) <> (doc_id % 13 = 0) EXCEPT SELECT 'documents/' || doc_id || '.json' FROM documents WHERE doc_id % 11 = 0 AND doc_id % 13 = 0")
def remote_conflicts(spark, d):
    return changes(_saved(spark, d, False), _saved(spark, d, True)).select("path")
