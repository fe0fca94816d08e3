"""Text functions over whole tables, and page structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.operators import edges as E
from folia.plans import views as V
from folia.registry import query
from folia.sources.tables import table

_RAW = "coalesce(text, '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(x, '\\r\\n?', chr(10), 'g'), '[\\t\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), ' {{2,}}', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text
FROM (SELECT doc_id, chr(9) || replace({_RAW}, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  ') || ' ' AS x FROM documents)""")
def clean_text(spark, d):
    noisy = F.concat(F.lit("\t"), F.replace("text", F.lit(". "), F.lit(".\r\n\n\n  ")), F.lit(" "))
    return _docs(spark, d).select("doc_id", T.clean_text(noisy).alias("text"))


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({_RAW}, ',', ' ,'), '. ', ' 3 . 5  ( '), ' +([,.)\\]」』〉》:;!?%])', '\\1', 'g'), '([(\\[「『〈《]) +', '\\1', 'g'), '(\\d) +\\. +(\\d)', '\\1.\\2', 'g'), ' {{2,}}', ' ', 'g') AS text FROM documents""")
def repair_spacing(spark, d):
    return _docs(spark, d).select("doc_id", T.repair_spacing(F.replace(F.replace("text", F.lit(","), F.lit(" ,")), F.lit(". "), F.lit(" 3 . 5  ( "))).alias("text"))


@query(f"SELECT doc_id, {V.sql_norm('text')} AS key FROM documents")
def norm_text(spark, d):
    return T.normalized(_docs(spark, d), "text").select("doc_id", T.norm(F.col("text")).alias("key"))


@query(f"SELECT doc_id, array_to_string({V.sql_grams(V.sql_norm('text'))}, ' ') AS grams FROM documents")
def bigrams(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(T.bigrams(T.norm(F.col("text")))), " ").alias("grams"))


@query(f"SELECT gram, {V.sql_shard('gram')} AS shard FROM (SELECT DISTINCT unnest({V.sql_grams(V.sql_norm('text'))}) AS gram FROM documents)")
def gram_shard(spark, d):
    return _docs(spark, d).select(F.explode(T.bigrams(T.norm(F.col("text")))).alias("gram")).distinct().select("gram", T.gram_shard(F.col("gram")).alias("shard"))


_CODE = "array_to_string(list_transform(range(1, len(l) + 1), lambda i: lower(to_base((l[i] - CASE WHEN i = 1 THEN 0 ELSE l[i - 1] END)::BIGINT, 36))), ',')"


@query(f"SELECT source, {_CODE} AS code FROM (SELECT source, list_sort(list_distinct(list(doc_id))) AS l FROM documents GROUP BY source)")
def encode_postings(spark, d):
    refs = table(spark, d, "documents").groupBy("source").agg(F.collect_set("doc_id").alias("refs"))
    return refs.select("source", T.encode_postings(F.col("refs")).alias("code"))


@query("SELECT source, array_to_string(list_sort(list_distinct(list(doc_id))), ',') AS refs FROM documents GROUP BY source")
def decode_postings(spark, d):
    return encode_postings(spark, d).select("source", F.array_join(T.decode_postings(F.col("code")), ",").alias("refs"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i: struct_pack(i := i, x := l[i])), lambda s: list_position(l, s.x) = s.i), lambda s: s.x), '|') AS parts FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({_RAW}, '[,\\n]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def split_list(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.split_list(F.col("text")), "|").alias("parts"))


_ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("SELECT page_id, " + _ESC.format(x="coalesce(html, '')") + " AS html FROM pages")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("html"))


_GAP_RE2 = T.GAP
_LOOSE = f"'(?i)(t{_GAP_RE2}h{_GAP_RE2}e{_GAP_RE2}o{_GAP_RE2}n)'"


@query(f"SELECT doc_id, replace(replace({_ESC.format(x=f'regexp_replace({_RAW}, {_LOOSE}, chr(1) || chr(92) || 1 || chr(2), ' + chr(39) + 'g' + chr(39) + ')')}, chr(1), '<mark>'), chr(2), '</mark>') AS html FROM documents")
def highlight(spark, d):
    return _docs(spark, d).select("doc_id", T.highlight(F.col("text"), F.lit("the on")).alias("html"))


_HIT = f"regexp_extract(t, {_LOOSE}, 0)"


@query(f"""
SELECT doc_id, CASE WHEN hit = '' THEN trim(left(t, 220)) || CASE WHEN length(t) > 220 THEN '…' ELSE '' END
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(t, s + 1, e - s)) || CASE WHEN e < length(t) THEN '…' ELSE '' END END AS snippet
FROM (SELECT *, CASE WHEN nl >= low AND p - nl < 60 AND nl >= 0 THEN nl + 1 ELSE low END AS s, least(length(t), p + length(hit) + 160) AS e
FROM (SELECT *, p - instr(reverse(left(t, p + 1)), chr(10)) + 1 + CASE WHEN instr(left(t, p + 1), chr(10)) = 0 THEN -1000000000 ELSE 0 END AS nl, greatest(0, p - 60) AS low
FROM (SELECT *, instr(t, hit) - 1 AS p FROM (SELECT doc_id, t, {_HIT} AS hit FROM (SELECT doc_id, {_RAW} AS t FROM documents)))))""")
def snippet(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet(F.col("text"), F.lit("the on")).alias("snippet"))


_DEBRIS = ("", "ϡܐ", "ϡܐϡܐ", "교무 ", "ϡ가", "Part 2")


@query(V.with_views(V.DOCS, body=f"""
SELECT doc_id, t = '' OR odd >= 4 OR (odd >= 2 AND odd / length(own) >= 0.15) OR CASE WHEN regexp_matches(own, '[가-힣一-鿿]') THEN len(regexp_extract_all(own, '[가-힣A-Za-z一-鿿]')) < 2
  ELSE NOT (regexp_matches(t, '(?i)^(part|chapter|step|unit|appendix|q\\s*&\\s*a|faq)\\b') OR (len(regexp_extract_all(t, '\\b[A-Za-z][a-z]{{2,}}\\b')) >= 2 AND NOT regexp_matches(t, '[\\[\\]^$\\\\{{}}|`~#@]'))) END AS garbled, odd
FROM (SELECT *, length(regexp_replace(own, '[가-힣ㄱ-ㆎ一-鿿 -~·°×‐-⁯⅐-⇿①-➿\\x{{3000}}-〿㈀-㏿＀-￯]', '', 'g')) AS odd FROM (
  SELECT doc_id, t, regexp_replace(t, '\\s+', '', 'g') AS own FROM (SELECT doc_id, trim({list(_DEBRIS)}[doc_id % 6 + 1] || CASE WHEN doc_id % 12 = 5 THEN '' WHEN doc_id % 12 = 3 THEN left(title, 1) ELSE title END) AS t FROM docs_v)))"""))
def is_garbled(spark, d):
    """Titles behind debris of a font, behind Hangul and Latin words, and some of one letter."""
    i = F.col("doc_id")
    title = F.when(i % 12 == 5, "").when(i % 12 == 3, F.left("title", F.lit(1))).otherwise(F.col("title"))
    own = F.concat(F.element_at(F.array(*map(F.lit, _DEBRIS)), (i % 6 + 1).cast("int")), title)
    return V.docs_v(spark, d).select("doc_id", T.is_garbled(own).alias("garbled"), T.odd_chars(F.regexp_replace(own, r"\s+", "")).cast("long").alias("odd"))


@query(V.with_views(V.BLOCKS, body="SELECT doc_id, n, regexp_matches((n + 1)::VARCHAR || ['. ', ') ', '.1 ', ' '][n % 4 + 1] || text, '^\\s*(\\d{1,3}([.-]\\d{1,3})*[.)](\\D|$)|\\d{1,3}([.-]\\d{1,3})+\\s)') AS numbered FROM blocks_v"))
def is_numbered(spark, d):
    mark = F.element_at(F.array(*map(F.lit, (". ", ") ", ".1 ", " "))), F.col("n") % 4 + 1)
    return V.blocks_v(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), T.is_numbered(F.concat((F.col("n") + 1).cast("string"), mark, F.col("text"))).alias("numbered"))


@query(V.with_views(V.BLOCKS, body=f"""
SELECT doc_id, n, x <> '' AND y <> '' AND (starts_with(x, y) OR starts_with(y, x) OR left(x, least(4, length(x), length(y))::BIGINT) = left(y, least(4, length(x), length(y))::BIGINT)) AS similar
FROM (SELECT b.doc_id, b.n, {V.sql_norm('a.text')} AS x, {V.sql_norm('b.text')} AS y FROM blocks_v a JOIN blocks_v b ON a.doc_id = b.doc_id AND a.n + 1 = b.n)"""))
def titles_similar(spark, d):
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("n"))
    return V.blocks_v(spark, d).withColumn("before", before).where("before is not null").select("doc_id", F.col("n").cast("long").alias("n"), T.titles_similar(F.col("before"), F.col("text")).alias("similar"))


@query(V.with_views(V.DOCS, body="SELECT doc_id, len(w) >= 4 AND len(list_filter(w, lambda x: length(x) = 1)) / len(w) > 0.5 AS broken FROM (SELECT doc_id, list_filter(string_split(CASE WHEN doc_id % 3 = 0 THEN array_to_string(string_split(title, ''), ' ') ELSE title END, ' '), lambda x: x <> '') AS w FROM docs_v)"))
def looks_broken(spark, d):
    spread = F.when(F.col("doc_id") % 3 == 0, F.array_join(F.split("title", ""), " ")).otherwise(F.col("title"))
    return V.docs_v(spark, d).select("doc_id", T.looks_broken(spread).alias("broken"))


TIDY = r"""SELECT doc_id, n, CASE WHEN length(t) > 40 THEN trim(regexp_replace(left(t, cut), '[\s:：,]+$', '')) ELSE t END AS title, CASE WHEN length(t) > 40 THEN trim(regexp_replace(substr(t, cut + 1), '^[\s:：.。,-]+', '')) ELSE '' END AS rest
FROM (SELECT *, CASE WHEN m <> '' THEN 12 + length(rtrim(m)) WHEN instr(h, ' ') > 0 AND length(h) - instr(reverse(h), ' ') >= 12 THEN length(h) - instr(reverse(h), ' ') ELSE 40 END AS cut
FROM (SELECT *, regexp_extract(substr(h, 13, 40), '^(?s:.*?)([:：]\s|\s[-–→]\s)', 0) AS m FROM (SELECT doc_id, n, text AS t, left(text, 41) AS h FROM (SELECT doc_id, n, regexp_replace(text, '\s+', ' ', 'g') AS text FROM blocks_v))))"""


@query(V.with_views(V.BLOCKS, body=TIDY))
def tidy_title(spark, d):
    return V.blocks_v(spark, d).select("doc_id", F.col("n").cast("long").alias("n"), T.tidy_title(F.col("text")).alias("t")).select("doc_id", "n", "t.title", "t.rest")


_KIND = "CASE WHEN regexp_matches(url, '(?i)fileDown|download|filedown|atchFile|attach') THEN 'file' WHEN regexp_matches(url, '(?i)law\\.go\\.kr') THEN 'law' ELSE 'site' END"


@query(V.with_views(V.LINKS, body=f"SELECT page_id, i, {_KIND} AS kind FROM links_v"))
def link_kind(spark, d):
    return V.links_v(spark, d).select("page_id", "i", T.link_kind(F.col("url")).alias("kind"))


@query(V.with_views(V.LINKS, body=f"SELECT page_id, i, CASE WHEN {_KIND} <> 'file' THEN '사이트' WHEN i % 2 = 0 THEN '서식' ELSE '참고' END AS type FROM links_v"))
def link_type(spark, d):
    name = F.when(F.col("i") % 2 == 0, F.concat("text", F.lit(" 신청서"))).otherwise(F.col("text"))
    return V.links_v(spark, d).select("page_id", "i", T.link_type(name, F.col("url")).alias("type"))


@query(V.with_views(V.LINKS, body="SELECT page_id, i, CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE '' END AS url FROM links_v"))
def safe_url(spark, d):
    return V.links_v(spark, d).select("page_id", "i", T.safe_url(F.col("url")).alias("url"))


@query(V.with_views(V.LINKS, body="SELECT page_id, i, regexp_matches(u, '(?i)/boardCnts/fileDown\\.do\\?') AND regexp_matches(u, '(?i)[?&]fileSeq=') AND NOT regexp_matches(u, '(?i)[?&]m=') AS suspect FROM (SELECT *, 'https://files.example.org/boardCnts/fileDown.do?' || CASE WHEN i % 2 = 0 THEN 'm=1&' ELSE '' END || 'fileSeq=' || i AS u FROM links_v)"))
def suspect_url(spark, d):
    url = F.concat(F.lit("https://files.example.org/boardCnts/fileDown.do?"), F.when(F.col("i") % 2 == 0, "m=1&").otherwise(""), F.lit("fileSeq="), F.col("i").cast("string"))
    return V.links_v(spark, d).select("page_id", "i", T.suspect_url(url).alias("suspect"))


@query(V.with_views(V.DOCS, body="SELECT doc_id, regexp_extract(lower(name), '\\.([a-z0-9]{2,5})$', 1) AS format, CASE WHEN format IN ('pdf', 'hwpx') THEN 'text' ELSE 'link' END AS kind FROM (SELECT doc_id, title || '.' || format AS name, format FROM docs_v)"))
def format_kind(spark, d):
    fmt = T.format_of(F.concat("title", F.lit("."), "format"))
    return V.docs_v(spark, d).select("doc_id", fmt.alias("format"), T.kind_of(fmt).alias("kind"))


@query(V.with_views(V.DOCS, body="SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN '../files_' || year || '_1/files/' || doc_id || '.' || format ELSE 'files/' || doc_id || '.' || format END AS url FROM docs_v"))
def file_url(spark, d):
    path = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("files/"), F.col("doc_id").cast("string"), F.lit("."), "format"))
    repo = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("files_"), F.col("year").cast("string"), F.lit("_1")))
    return V.docs_v(spark, d).select("doc_id", T.file_url(repo, path).alias("url"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'common' WHEN lang = 'en' THEN 'en,fr' WHEN lang = 'fr' THEN 'fr' ELSE 'fr,' || lang END AS levels FROM documents")
def clean_levels(spark, d):
    raw = F.array_compact(F.array(F.col("lang"), F.lit("fr"), F.lit("none"), F.when(F.col("doc_id") % 10 == 0, V.COMMON)))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.clean_levels(raw, V.LEVELS, V.COMMON), ",").alias("levels"))


@query("SELECT source AS department, CASE WHEN source = 'src0' THEN source WHEN count(*) > 2 THEN source ELSE 'other' END AS dept_group, count(*) AS n FROM documents GROUP BY source")
def dept_group(spark, d):
    n = table(spark, d, "documents").groupBy(F.col("source").alias("department")).agg(F.count("*").alias("n"))
    return n.select("department", F.when(F.col("department") == "src0", F.col("department")).when(F.col("n") > 2, F.col("department")).otherwise("other").alias("dept_group"), "n")


@query(V.with_views(V.DOCS, body="SELECT doc_id, regexp_replace(year || ' ' || title || ' 1' || year, '(^|[^0-9])' || year || '([^0-9]|$)', '\\1' || (year + 1) || '\\2', 'g') AS title FROM docs_v"))
def renew_title(spark, d):
    y = F.col("year").cast("string")
    return V.docs_v(spark, d).select("doc_id", T.renew_title(F.concat(y, F.lit(" "), "title", F.lit(" 1"), y), F.col("year"), F.col("year") + 1).alias("title"))


@query("SELECT doc_id, sha1(encode('blob ' || strlen(coalesce(text, ''))) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS sha FROM documents")
def blob_sha(spark, d):
    return _docs(spark, d).select("doc_id", T.blob_sha(F.col("text")).alias("sha"))


_LATIN, _HANGUL = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"


@query(f"""
SELECT doc_id, CASE WHEN len(w) >= 30 THEN len(list_filter(w, lambda x: length(x) = 1)) / len(w) ELSE 0.0 END AS ratio FROM (
  SELECT doc_id, list_filter(string_split_regex(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(t, '([가-사])', '\\1 ', 'g') ELSE t END, '\\s+'), lambda x: regexp_full_match(x, '[가-힣]+')) AS w
  FROM (SELECT doc_id, translate(lower({_RAW}), '{_LATIN}', '{_HANGUL}') AS t FROM documents))""")
def spaced_ratio(spark, d):
    """Whole texts with their letters as syllables; in every third document some of these stand apart."""
    own = F.translate(F.lower("text"), _LATIN, _HANGUL)
    return _docs(spark, d).select("doc_id", T.spaced_ratio(F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(own, "([가-사])", "$1 ")).otherwise(own)).alias("ratio"))


_ENDINGS = ("", " 합니다.", " 한다", " 있다 ?", " 하며 。 ", "다")


@query(V.with_views(V.BLOCKS, body=f"""
SELECT doc_id, n, NOT regexp_matches(t, '[?？]\\s*$') AND regexp_matches(t, '{T.SENTENCE_END}') AND length(regexp_replace(t, '\\s', '', 'g')) >= 12 AS sentence
FROM (SELECT doc_id, n, trim((CASE WHEN n % 7 = 0 THEN left(text, 6) ELSE text END) || {list(_ENDINGS)}[n % 6 + 1]) AS t FROM blocks_v)"""))
def is_sentence(spark, d):
    """Lines, some of them short, behind which stand endings of sentences and others."""
    n = F.col("n")
    line = F.concat(F.when(n % 7 == 0, F.left("text", F.lit(6))).otherwise(F.col("text")), F.element_at(F.array(*map(F.lit, _ENDINGS)), n % 6 + 1))
    return V.blocks_v(spark, d).select("doc_id", n.cast("long").alias("n"), T.is_sentence(line).alias("sentence"))


_MARK = "CASE n % 5 WHEN 0 THEN '(' || (n + 1) || ') ' WHEN 1 THEN substr('가나다라마바사아자차카타파하', n % 14 + 1, 1) || '. ' WHEN 2 THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', n % 20 + 1, 1) || ' ' WHEN 3 THEN (n + 1) || '. ' ELSE '' END"


@query(V.with_views(V.BLOCKS, body=f"""
SELECT doc_id, n, (CASE WHEN n % 5 = 1 THEN n % 14 + 1 WHEN n % 5 = 2 THEN n % 20 + 1 WHEN n % 5 IN (0, 3) THEN left((n + 1)::VARCHAR, 3)::INTEGER WHEN regexp_matches(text, '^\\(?[0-9]') THEN regexp_extract(text, '[0-9]{{1,3}}')::INTEGER ELSE 0 END)::INTEGER AS number FROM blocks_v"""))
def heading_number(spark, d):
    """Lines behind numbers, letters of the alphabet and circled digits; the SQL says what was put there."""
    return V.blocks_v(spark, d).withColumn("text", F.concat(F.expr(_MARK), "text")).select("doc_id", F.col("n").cast("long").alias("n"), T.heading_number(F.col("text")).alias("number"))


@query(V.with_views(V.DOCS, body="""
SELECT doc_id, trim(CASE WHEN doc_id % 4 = 2 THEN '업무·' || trim(t) ELSE t END) AS title
FROM (SELECT doc_id, regexp_replace(regexp_replace(title, '\\s{2,}.*$', ''), '\\s+', ' ', 'g') AS t FROM docs_v)"""))
def clean_title(spark, d):
    """Titles before leaders and page numbers, the overview mark, behind a middle dot, and before two spaces; the SQL takes those without."""
    title, i = F.col("title"), F.col("doc_id")
    own = F.when(i % 4 == 0, F.concat(title, F.lit(" ····· 12"))).when(i % 4 == 1, F.concat(title, F.lit(" 업무개요 12쪽"))).when(i % 4 == 2, F.concat(F.lit("업무 ‧ "), F.trim(title))).otherwise(F.concat(title, F.lit("  끝")))
    return V.docs_v(spark, d).select("doc_id", T.clean_title(own).alias("title"))


# ---- page structure -----------------------------------------------------------------------------


@query(V.with_views(V.SECTIONS, body="SELECT doc_id, s, block_start, block_end, heading FROM sections_v"))
def sections_by_length(spark, d):
    return V.sections_v(spark, d).select("doc_id", "s", "block_start", "block_end", "heading")


@query(V.with_views(V.SECTIONS, body="SELECT doc_id, s, text FROM sections_v"))
def section_text(spark, d):
    return V.sections_v(spark, d).select("doc_id", "s", "text")


@query(V.with_views(V.SECTIONS, body="SELECT doc_id, s, array_to_string(range(block_start + 1, block_end + 2), ',') AS pdf_pages FROM sections_v"))
def section_pages(spark, d):
    return V.sections_v(spark, d).select("doc_id", "s", F.array_join(F.sequence(F.col("block_start") + 1, F.col("block_end") + 1), ",").alias("pdf_pages"))


LEAD = f"""SELECT doc_id, s, CASE WHEN length(x) > 90 THEN left(x, 90) || '…' ELSE x END AS lead
FROM (SELECT doc_id, s, trim(regexp_replace(array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i <= 3 AND (contains({V.sql_norm('l[i]')}, h) OR contains(h, {V.sql_norm('l[i]')})) THEN NULL ELSE l[i] END), lambda y: y IS NOT NULL), ' '), '\\s+', ' ', 'g')) AS x
FROM (SELECT doc_id, s, {V.sql_norm('heading')} AS h, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM sections_v))"""


@query(V.with_views(V.SECTIONS, body=LEAD))
def section_lead(spark, d):
    return V.sections_v(spark, d).select("doc_id", "s", T.section_lead(F.col("heading"), F.col("text"), 90).alias("lead"))


_PRINTED = "CASE WHEN page % 5 = 0 THEN NULL WHEN page % 7 = 0 THEN page - 3 ELSE page - 4 END"
_VOTE = f"vote_v AS (SELECT book, diff, n FROM (SELECT book, diff, count(*) AS n, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(page)) AS r FROM (SELECT book, page, page - ({_PRINTED}) AS diff FROM book_v) WHERE diff IS NOT NULL GROUP BY book, diff) WHERE r = 1)"


@query(V.with_views(V.BOOK, _VOTE, body=f"SELECT book, page, CASE WHEN n >= 3 AND page - ({_PRINTED}) <> diff THEN -1 ELSE coalesce({_PRINTED}, -1) END AS printed FROM book_v JOIN vote_v USING (book)"))
def page_offset_vote(spark, d):
    pages = V.book_v(spark, d).select("book", "page", V.printed(F.col("page")).alias("printed"))
    joined = pages.join(E.offset_votes(pages), "book")
    return joined.select("book", "page", F.when((F.col("n") >= 3) & (F.col("page") - F.col("printed") != F.col("diff")), -1).otherwise(F.coalesce("printed", F.lit(-1))).alias("printed"))


@query(V.with_views(V.BOOK, _VOTE, body=f"""
SELECT w.book, w.p AS printed, CASE WHEN e.page IS NOT NULL THEN e.page WHEN w.p + diff BETWEEN 1 AND top THEN w.p + diff ELSE -1 END AS page
FROM (SELECT book, unnest(range(1, max(page) + 1))::INTEGER AS p, max(page) AS top FROM book_v GROUP BY book) w JOIN vote_v v USING (book)
LEFT JOIN (SELECT book, {_PRINTED} AS p, min(page) AS page FROM book_v GROUP BY ALL) e ON e.book = w.book AND e.p = w.p"""))
def block_for_printed(spark, d):
    pages = V.book_v(spark, d).select("book", "page", V.printed(F.col("page")).alias("printed"))
    want = pages.groupBy("book").agg(F.max("page").alias("top")).select("book", "top", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("printed"))
    exact = pages.where("printed is not null").groupBy("book", "printed").agg(F.min("page").alias("page"))
    at = F.col("printed") + F.col("diff")
    return want.join(E.offset_votes(pages), "book").join(exact, ["book", "printed"], "left").select("book", "printed", F.coalesce("page", F.when(at.between(1, F.col("top")), at), F.lit(-1)).alias("page"))
