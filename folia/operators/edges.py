"""Running headers, page numbers and markers of units at the edges of pages.

Pages are rows (book, page, lines) of texts alone, or lines of glyphs with a mark of the margin they stand
in. What repeats is counted over a book by key; lines are peeled from both ends inside a page's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions import text as T

# fixed values: lines looked at from the top, share of pages and number of pages that make a line a repeated one,
# votes that a difference of page numbers needs, points between a page number and the header beside it
TOP_LINES, REPEAT_SHARE, REPEAT_LEAST, VOTES, SAME_LINE = 3, 0.15, 3, 3, 3
#: A roman number, a full stop and up to 26 characters.
MARKER = r"^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]|[IVX]{1,4})\s*[.．]\s*\S.{0,25}$"
NUMBER_ALONE, NUMBER_WITHIN = r"^\d{1,4}$", r"(?:^|\s)(\d{1,4})(?=\s|$)"


def is_marker(line: Column) -> Column:
    return T.text_or_empty(line).rlike(MARKER)


def bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(T.text_or_empty(line), r"\d+", ""))


def key(line: Column) -> Column:
    """What lines of a header have in common: everything but digits."""
    return T.norm(F.regexp_replace(T.text_or_empty(line), r"\d+", ""))


def tidy_marker(line: Column) -> Column:
    """One space behind the first full stop, none around middle dots."""
    stop = F.regexp_replace(line, r"^([^.．]*?)\s*([.．])\s*", "$1$2 ")
    return F.trim(F.regexp_replace(F.regexp_replace(stop, r"\s*([‧·・])\s*", "$1"), r"\s+", " "))


def edge_keys(pages: DataFrame) -> DataFrame:
    """(book, page, key): the keys of each page's first two and last two lines."""
    tail = F.when(F.size("lines") > 2, F.slice("lines", F.greatest(F.lit(3), F.size("lines") - 1), F.lit(2))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.transform(F.concat(F.slice("lines", 1, 2), tail), key))
    return pages.select("book", "page", F.explode(keys).alias("key")).where("key <> ''")


def repeated(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, key, pages): the keys of 15 % of a book's pages or more, of three at least. keys: (book, page, key), each once a page."""
    total = pages.groupBy("book").agg(F.count("*").alias("total"))
    n = keys.groupBy("book", "key").agg(F.count("*").alias("pages")).join(total, "book")
    return n.where(F.col("pages") >= F.greatest(F.lit(REPEAT_LEAST), F.ceil(F.col("total") * REPEAT_SHARE))).select("book", "key", "pages")


def offset_votes(pages: DataFrame) -> DataFrame:
    """(book, diff, n): the most frequent difference of page and printed page; of equally frequent ones that seen first."""
    votes = pages.where("printed is not null").groupBy("book", (F.col("page") - F.col("printed")).alias("diff")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    best = votes.groupBy("book").agg(F.max_by(F.struct("diff", "n"), F.struct("n", -F.col("first"))).alias("v"))
    return best.select("book", "v.diff", "v.n")


def _voted(pages: DataFrame) -> DataFrame:
    """Without printed numbers that disagree with three pages' or more."""
    rows = pages.join(offset_votes(pages), "book", "left")
    odd = (F.col("n") >= VOTES) & (F.col("page") - F.col("printed") != F.col("diff"))
    return rows.withColumn("printed", F.when(~F.coalesce(odd, F.lit(False)), F.col("printed"))).drop("diff", "n")


def _marked(pages: DataFrame, as_key) -> DataFrame:
    """`pages` with `marked`: the places, from 0, of lines that are markers seen at the ends of two pages or more.

    Only markers leave their rows, to be looked up by book and key, so a book may have any number of them.
    """
    at = F.filter(F.transform("lines", lambda x, i: F.when(is_marker(x), F.struct(i.alias("i"), as_key(x).alias("key")))), lambda m: m.isNotNull())
    last = F.element_at("lines", -1)
    twice = pages.where(F.size("lines") > 0).where(is_marker(last)).groupBy("book", as_key(last).alias("key")).agg(F.count("*").alias("_n")).where("_n >= 2").select("book", "key")
    found = pages.select("book", "page", F.inline(at)).join(twice, ["book", "key"]).groupBy("book", "page").agg(F.sort_array(F.collect_list("i")).alias("marked"))
    return pages.join(found, ["book", "page"], "left")


def _tail(lines: Column, marked: Column, low: Column) -> Column:
    """Lines that stay below the page's trailing markers; those before place `low` aren't touched."""
    end = F.aggregate(F.reverse(F.coalesce(marked, F.array().cast("array<int>"))), F.size(lines), lambda end, i: F.when((i == end - 1) & (i >= low), i).otherwise(end))
    return end


def strip_pages(pages: DataFrame) -> DataFrame:
    """(book, page, printed, footer, header, body) of pages (book, page, lines) without coordinates.

    From the top at most three lines go: repeated ones that are no markers, the first of which is the header
    and gives the printed number, and numbers alone, which give it only below a header. From the end all
    markers go that end two pages or more; the last line is the footer. Printed numbers that disagree with
    the page offset of three or more are dropped. A page of null lines is an empty one.
    """
    own = pages.select("book", "page", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    often = repeated(edge_keys(own), own).groupBy("book").agg(F.collect_list("key").alias("keys"))  # at most 26 keys of a share of 15 %
    rows = _marked(own.join(often, "book", "left"), key)
    again = lambda x: F.coalesce(F.array_contains("keys", key(x)), F.lit(False)) & ~is_marker(x)
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("n"), F.lit("").alias("header"), F.lit(None).cast("int").alias("printed"))

    def peel(acc: Column, x: Column) -> Column:
        header, alone = acc["open"] & again(x), acc["open"] & x.rlike(NUMBER_ALONE)
        number = F.nullif(F.regexp_extract(x, r"\d{1,4}", 0), F.lit("")).cast("int")
        return F.struct(
            (header | alone).alias("open"),
            (acc["n"] + (header | alone).cast("int")).alias("n"),
            F.when(header & (acc["header"] == ""), bare(x)).otherwise(acc["header"]).alias("header"),
            F.coalesce(acc["printed"], F.when(header | (alone & (acc["header"] != "")), number)).alias("printed"),
        )

    top = rows.withColumn("top", F.aggregate(F.slice("lines", 1, TOP_LINES), start, peel))
    cut = top.withColumn("end", _tail(F.col("lines"), F.col("marked"), F.col("top.n")))
    footer = F.when(F.col("end") < F.size("lines"), tidy_marker(F.element_at("lines", -1))).otherwise("")
    body = F.array_join(F.slice("lines", F.col("top.n") + 1, F.col("end") - F.col("top.n")), "\n")
    return _voted(cut.select("book", "page", F.col("top.printed").alias("printed"), footer.alias("footer"), F.col("top.header").alias("header"), body.alias("body")))


def margin_keys(lines: DataFrame) -> DataFrame:
    """(book, page, key) of lines (book, page, text, marginal) in the margins, each key once a page."""
    return lines.where("marginal").select("book", "page", key(F.col("text")).alias("key")).where("key <> ''").distinct()


def strip_margins(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, page, printed, footer, header, body) of lines of glyphs (book, page, line, text, y, marginal).

    Lines in the margins that repeat go: the first number among them is the printed one, the first marker
    that didn't give it the footer, the first other line the header. Numbers alone in the margins go as well
    and count if a repeated line stands within three points of their height. Trailing markers of the body
    that end two pages or more go, too, the last being the footer if there is none yet. pages: (book, page),
    with those that have no lines.
    """
    rows = lines.withColumn("key", key(F.col("text"))).join(repeated(margin_keys(lines), pages).select("book", "key", F.lit(True).alias("again")), ["book", "key"], "left")
    rows = rows.withColumn("again", F.col("marginal") & F.coalesce("again", F.lit(False)))
    alone = F.col("marginal") & ~F.col("again") & F.col("text").rlike(NUMBER_ALONE)
    number = F.nullif(F.regexp_extract("text", NUMBER_WITHIN, 1), F.lit("")).cast("int")
    line = F.struct("line", "text", "y", "again", alone.alias("alone"), F.when(F.col("again"), number).when(alone, F.col("text").cast("int")).alias("number"), is_marker(F.col("text")).alias("marker"))
    page = pages.select("book", "page").join(rows.groupBy("book", "page").agg(F.sort_array(F.collect_list(line)).alias("l")), ["book", "page"], "left")
    page = page.withColumn("l", F.coalesce("l", F.array().cast(page.schema["l"].dataType)))
    beside = lambda x: F.exists("l", lambda o: o["again"] & (F.abs(o["y"] - x["y"]) < SAME_LINE))
    first = lambda test: F.get(F.filter("l", test), F.lit(0))
    page = page.withColumn("told", first(lambda x: x["number"].isNotNull() & (x["again"] | (x["alone"] & beside(x)))))
    gave = lambda x: F.coalesce(x["line"] == F.col("told")["line"], F.lit(False))
    body = F.transform(F.filter("l", lambda x: ~x["again"] & ~x["alone"]), lambda x: x["text"])
    page = page.select(
        "book", "page", F.col("told")["number"].alias("printed"), F.coalesce(first(lambda x: x["again"] & x["marker"] & ~gave(x))["text"], F.lit("")).alias("footer"),
        F.coalesce(bare(first(lambda x: x["again"] & ~x["marker"])["text"]), F.lit("")).alias("header"), body.alias("lines"),
    )
    cut = _marked(page, T.norm)
    end = _tail(F.col("lines"), F.col("marked"), F.lit(0))
    footer = F.when(F.col("footer") != "", F.col("footer")).when(end < F.size("lines"), F.element_at("lines", -1)).otherwise("")
    text = T.clean_text(F.array_join(F.slice("lines", F.lit(1), end), "\n"))
    return _voted(cut.select("book", "page", "printed", tidy_marker(footer).alias("footer"), "header", text.alias("body")))
