"""What is published of documents in lists: sections, summaries, outlines; checks before that; the editor's own list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.operators.documents import default_department, is_untitled
from folia.operators.numbering import number

# fixed values: kinds of nodes that are searched, by the letter of the list; characters of a section's lead; folders whose files are replaced
KINDS = {"ch": "c", "task": "t", "part": "p", "group": "g", "item": "i", "link": "l"}
LEAD = 90
PUBLISHED = r"^data/(documents|indexes|search|toc)/"


def _paged(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections (doc_id, block_start, block_end, ...) with the page numbers of their blocks that have one, as pages and printed."""
    own = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "pdf_page", "printed_page"))).alias("_b"))
    inside = F.slice("_b", F.col("block_start") + 1, F.col("block_end") - F.col("block_start") + 1)
    at = lambda c: F.filter(F.transform(inside, lambda b: b[c]), lambda x: x.isNotNull())
    none = F.array().cast("array<int>")
    return rows.join(own, "doc_id", "left").withColumns({"pages": F.coalesce(at("pdf_page"), none), "printed": F.coalesce(at("printed_page"), none)}).drop("_b")


def section_rows(sections: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Sections with what a level's list says of them: pages, keywords, lead, files and whether they have no title.

    sections: (doc_id, s, heading, text, block_start, block_end, keywords as a list in a text, auto, marked,
    toc_found, format, ...); blocks: (doc_id, n, pdf_page, printed_page); links: (doc_id, s, kind).
    """
    files = links.where("kind = 'file'").groupBy("doc_id", "s").agg(F.count("*").alias("files"))
    rows = _paged(sections, blocks).join(files, ["doc_id", "s"], "left").withColumn("files", F.coalesce("files", F.lit(0).cast("long")))
    untitled = is_untitled(F.col("auto"), F.col("marked"), F.col("toc_found"), F.col("format"), F.col("heading"))
    return rows.withColumns({"keywords": T.split_list(F.col("keywords")), "lead": T.section_lead(F.col("heading"), F.col("text"), LEAD), "untitled": untitled}).drop("text")


def summaries(docs: DataFrame, sections: DataFrame, forms: DataFrame, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents (doc_id, format, repo, path, ...) with kind, file address and the numbers of their sections, forms, blocks and outline nodes.

    forms: (doc_id, form_no).
    """
    out = docs.withColumns({"kind": T.kind_of(F.col("format")), "file": T.file_url(F.col("repo"), F.col("path"))})
    for name, rows, n in (("sections", sections, F.count("*")), ("forms", forms, F.count_distinct("form_no")), ("blocks", blocks, F.count("*")), ("outline", nodes, F.count("*"))):
        out = out.join(rows.groupBy("doc_id").agg(n.alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def toc_rows(nodes: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, c, kind, title, page, type, url) of outline nodes that are searched.

    nodes: (doc_id, c, k, t, b, l, cut): long titles are cut, but for chapters and links; what was cut ends in
    an ellipsis. A link's node has its text, type (told by its kind if it has none) and address. links:
    (doc_id, id, text, url, kind, type); blocks: (doc_id, n, pdf_page, printed_page).
    """
    rows = nodes.where(F.col("k").isin(*KINDS)).join(links.withColumnRenamed("id", "l"), ["doc_id", "l"], "left")
    rows = rows.join(blocks.select("doc_id", F.col("n").alias("b"), "pdf_page", "printed_page"), ["doc_id", "b"], "left")
    whole = F.col("k").isin("ch", "link")
    rows = rows.withColumn("_tidy", T.tidy_title(F.col("t")))
    cut = F.coalesce(F.col("cut"), F.lit(False)) | (~whole & (F.col("_tidy.rest") != ""))
    title = F.concat(F.when(whole, F.col("t")).otherwise(F.col("_tidy.title")), F.when(cut, "…").otherwise(""))
    kind = F.coalesce("type", F.when(F.col("kind") == "law", "법령").when(F.col("kind") == "site", "사이트").when(F.col("kind").isNotNull(), "서식"), F.lit(""))
    letter = F.coalesce(*(F.when(F.col("k") == k, v) for k, v in KINDS.items()))
    page = F.coalesce(F.concat(F.col("printed_page").cast("string"), F.lit("p")), F.concat(F.nullif("pdf_page", F.lit(0)).cast("string"), F.lit("쪽")), F.lit(""))
    return rows.select("doc_id", "c", letter.alias("kind"), F.coalesce(F.nullif("text", F.lit("")), title).alias("title"), page.alias("page"), kind.alias("type"), F.coalesce("url", F.lit("")).alias("url"))


def finalize(docs: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents as they are saved: with a department (told by the origin where there is none), blocks without
    working fields, and sections with page numbers and keywords.

    docs: (doc_id, department, site, ...); blocks: (doc_id, n, pdf_page, printed_page, footer_label, text);
    sections: (doc_id, s, heading, block_start, block_end, keywords as a list in a text).
    """
    own = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "pdf_page", "printed_page", F.coalesce("footer_label", F.lit("")).alias("footer_label"), "text"))).alias("blocks"))
    fields = F.struct("s", "heading", "block_start", "block_end", F.col("pages").alias("pdf_pages"), F.col("printed").alias("printed_pages"), T.split_list(F.col("keywords")).alias("keywords"))
    cut = _paged(sections, blocks).groupBy("doc_id").agg(F.sort_array(F.collect_list(fields)).alias("sections"))
    out = docs.withColumn("department", F.coalesce("department", default_department(F.col("site")))).join(own, "doc_id", "left").join(cut, "doc_id", "left")
    for c in ("blocks", "sections"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    return out


def consistency(docs: DataFrame, validated: DataFrame, details: DataFrame, index: DataFrame, saved: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, problem, what): errors and warnings of the catalog, and saved files that are to be deleted.

    docs: (doc_id, title, levels) with every entry of the catalog; validated: (doc_id, errors, warnings) as
    lists; details: (doc_id) with a file; index: (doc_id, level) as listed by level; saved, files: (path) in the
    folder and of the new output. An id that occurs again is an error, as are a document without details
    and a level whose list isn't that of the catalog.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("levels").alias("levels"))
    row = lambda df, kind, problem, what: df.select(F.lit(kind).alias("kind"), problem.alias("problem"), what.cast("string").alias("what"))
    twice = row(ids.where("n > 1"), "error", F.lit("id"), F.col("doc_id"))
    told = [row(validated.select("doc_id", F.explode(f"{k}s").alias("p")), k, F.col("p"), F.col("doc_id")) for k in ("error", "warning")]
    bare = row(ids.join(details, "doc_id", "left_anti"), "error", F.lit("no details"), F.col("doc_id"))
    want, have = ids.select("doc_id", F.explode("levels").alias("level")), index.select("doc_id", "level").distinct()
    wrong = want.join(have, ["doc_id", "level"], "left_anti").unionByName(have.join(want, ["doc_id", "level"], "left_anti")).select("level").distinct()
    gone = saved.where(F.col("path").rlike(PUBLISHED)).join(files, "path", "left_anti")
    out = twice
    for more in (*told, bare, row(wrong, "error", F.lit("level index"), F.col("level")), row(gone, "deletion", F.lit("file"), F.col("path"))):
        out = out.unionByName(more)
    return out


def editor_list(docs: DataFrame, requests: DataFrame, common: str) -> DataFrame:
    """Documents of each request with their place in its list, from 1.

    docs: (doc_id, title, category, department, levels, year, created_at, stored, odd): stored: has a source,
    odd: needs a check; requests: (request, q, level, category, no_source, check), a screen's worth of them,
    empty where they don't filter. With a level the order is the readers': common material by department,
    then latest year, title and id; else the latest entries come first. Places are numbered by ranges.
    """
    asked = requests.select("request", T.norm(F.col("q")).alias("q"), F.col("level").alias("_level"), F.col("category").alias("_category"), "no_source", "check")
    key = T.norm(F.concat("title", F.coalesce("category", F.lit("")), F.coalesce("department", F.lit(""))))
    fits = (
        ((F.col("q") == "") | F.contains("_key", F.col("q"))) & ((F.col("_level") == "") | F.array_contains("levels", F.col("_level"))) & ((F.col("_category") == "") | (F.col("category") == F.col("_category")))
        & (~F.col("no_source") | ~F.col("stored")) & (~F.col("check") | F.col("odd"))
    )
    rows = requests_of(docs.withColumn("_key", key), asked).where(fits)
    by_level = F.col("_level") != ""
    order = {"_a": F.when(F.col("_level") == common, F.coalesce("department", F.lit(""))).otherwise(""), "_b": F.when(by_level, -F.coalesce("year", F.lit(0)).cast("long")).otherwise(-F.col("created_at").cast("long")), "_c": F.when(by_level, F.col("title")).otherwise("")}
    return number(rows.withColumns(order), "request", ["_a", "_b", "_c", "doc_id"], "place").withColumn("place", F.col("place") + 1).drop("_a", "_b", "_c", "_key", "_level", "_category", "q")


def requests_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Each document beside every request of a screen: their list is an array in the row, so that nothing is joined."""
    held = asked.agg(F.collect_list(F.struct(*asked.columns)).alias("_r")).first()["_r"]
    if not held:
        return docs.limit(0).select("*", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns))
    of = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in asked.columns)) for r in held))
    return docs.select("*", F.inline(of))
