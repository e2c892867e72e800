"""Queries over texts: pages, clipping, headings, names, tokens, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspan.functions import pages as pg
from leafspan.functions import text as tx
from leafspan.plans import inputs as v
from leafspan.registry import query

_CITE = tx.CITE.replace("'", "''")
_LEADER = r"\.{3,}\s*\d+\s*$"


@query(f"WITH {v.PAGES} SELECT * FROM pages_v")
def pages_view(spark, sf_dir):
    return v.doc_pages(spark, sf_dir)


@query(
    r"""
WITH c AS (
  SELECT doc_id, text, length(text) AS n, left(text, 4000) AS h, chr(10) AS nl FROM documents
), d AS (
  SELECT *, CASE WHEN strpos(h, nl || nl) > 0 THEN length(h) - strpos(reverse(h), nl || nl) - 1
                 WHEN strpos(h, nl) > 0 THEN length(h) - strpos(reverse(h), nl) ELSE 4000 END AS cut FROM c
)
SELECT doc_id, CASE WHEN n <= 4000 THEN text
  ELSE left(text, cut) || nl || nl || '[内容已截断，共 ' || n || ' 字符，已显示前 ' || cut || ' 字符]' END AS text
FROM d"""
)
def clipped_text(spark, sf_dir):
    return v.read(spark, sf_dir, "documents").select("doc_id", tx.clipped(F.col("text")).alias("text"))


@query(
    r"""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]'))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL
"""
)
def token_counts(spark, sf_dir):
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


@query(
    f"""
WITH {v.PAGES}
SELECT doc_id, sum(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')))::BIGINT AS n_tokens, count(*) AS n_pages,
  max(page_num) AS last_page
FROM pages_v GROUP BY doc_id HAVING sum(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))) > 200"""
)
def documents_over_token_limit(spark, sf_dir):
    n = tx.token_count(F.col("text"))
    pages = v.doc_pages(spark, sf_dir).groupBy("doc_id")
    out = pages.agg(F.sum(n).alias("n_tokens"), F.count("*").alias("n_pages"), F.max("page_num").alias("last_page"))
    return out.filter("n_tokens > 200")


@query(
    f"""
WITH {v.PAGES}
SELECT doc_id, string_agg('<start_index_' || page_num || '>' || chr(10) || text || chr(10) || '<end_index_' || page_num || '>' || chr(10), ''
  ORDER BY page_num) AS text FROM pages_v WHERE page_num BETWEEN 2 AND 4 GROUP BY doc_id"""
)
def tagged_page_range(spark, sf_dir):
    n = F.col("page_num").cast("string")
    tagged = F.concat(F.lit("<start_index_"), n, F.lit(">\n"), "text", F.lit("\n<end_index_"), n, F.lit(">\n"))
    inside = v.doc_pages(spark, sf_dir).filter("page_num BETWEEN 2 AND 4").select("doc_id", F.struct("page_num", tagged.alias("t")).alias("p"))
    pages = inside.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return pages.select("doc_id", F.array_join("p.t", "").alias("text"))


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}') || regexp_extract_all({0}, '[一-鿿]'))"


@query(
    f"SELECT doc_id, len({_TOKENS.format('text')})::BIGINT AS n, array_to_string(list_sort({_TOKENS.format('text')}), ' ') AS tokens "
    "FROM documents WHERE text IS NOT NULL"
)
def retrieval_tokens(spark, sf_dir):
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    rows = docs.select("doc_id", tx.retrieval_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query(
    f"""
WITH {v.ANSWERS}
SELECT doc_id, unnest(range(1, len(d) + 1))::BIGINT AS seq, unnest(d) AS doc_name, unnest(p)::BIGINT AS page
FROM (SELECT doc_id, regexp_extract_all(answer, '{_CITE}', 1) AS d, regexp_extract_all(answer, '{_CITE}', 2) AS p FROM answers_v)"""
)
def extract_citations(spark, sf_dir):
    rows = v.answers(spark, sf_dir).select("doc_id", F.posexplode(tx.citations(F.col("answer"))).alias("pos", "c"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("seq"), "c.doc_name", F.col("c.page").cast("long").alias("page"))


@query(f"WITH {v.ANSWERS} SELECT doc_id, regexp_replace(answer, '{_CITE}', '', 'g') AS answer FROM answers_v")
def clean_answers(spark, sf_dir):
    return v.answers(spark, sf_dir).select("doc_id", tx.without_citations(F.col("answer")).alias("answer"))


@query(
    f"""
WITH {v.ANSWERS}, p AS (
  SELECT doc_id, trim(answer, ' ' || chr(10)) AS text, regexp_split_to_array(trim(answer, ' ' || chr(10)), '\\n\\s*\\n') AS parts FROM answers_v
), q AS (
  SELECT *, list_max(list_transform(parts, lambda x, i: CASE WHEN trim(x) <> '' AND NOT regexp_matches(x, '{tx.INVITATION}') THEN i ELSE 0 END)) AS keep
  FROM p
)
SELECT doc_id, CASE WHEN keep = len(parts) OR keep = 0 THEN text
  ELSE array_to_string(list_filter(parts[1:keep], lambda x: trim(x) <> ''), chr(10) || chr(10)) END AS answer FROM q"""
)
def answers_without_invitation(spark, sf_dir):
    return v.answers(spark, sf_dir).select("doc_id", tx.without_invitation(F.col("answer")).alias("answer"))


@query(
    f"""
WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text || ' Table 12' WHEN 1 THEN text || ' table 9 on page 3'
  WHEN 2 THEN '表 7 ' || text ELSE text END AS query FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(query, '{tx.TABLE_REFERENCE}') AND NOT regexp_matches(query, '{tx.PAGE_REFERENCE}')
  THEN query || '{tx.TABLE_HINT.replace("'", "''")}' ELSE query END AS query FROM q"""
)
def queries_with_table_hint(spark, sf_dir):
    k, text = F.col("item_id") % 4, F.col("text")
    asked = (
        F.when(k == 0, F.concat(text, F.lit(" Table 12")))
        .when(k == 1, F.concat(text, F.lit(" table 9 on page 3")))
        .when(k == 2, F.concat(F.lit("表 7 "), text))
        .otherwise(text)
    )
    return v.read(spark, sf_dir, "benchmark").select("item_id", tx.with_table_hint(asked).alias("query"))


@query(
    r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE ' v' || page_id || '.PDF' END AS path FROM pages)
SELECT page_id, b AS base_name, replace(path, '/', '-') AS file_name,
  CASE WHEN s = '' THEN 'document' ELSE s END AS stem, CASE WHEN lower(b) LIKE '%.pdf' THEN b ELSE b || '.pdf' END AS doc_name
FROM (SELECT page_id, path, string_split(path, '/')[-1] AS b,
  regexp_replace(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1'), '[^\p{L}\p{N}_-]', '_', 'g') AS s FROM p)"""
)
def document_names(spark, sf_dir):
    path = F.concat(
        F.regexp_replace("url", "^https?://", ""),
        F.when(F.col("page_id") % 2 == 0, F.lit(".pdf")).otherwise(F.concat(F.lit(" v"), F.col("page_id").cast("string"), F.lit(".PDF"))),
    )
    return v.read(spark, sf_dir, "pages").select(
        "page_id",
        tx.base_name(path).alias("base_name"),
        F.replace(path, F.lit("/"), F.lit("-")).alias("file_name"),
        tx.safe_stem(path).alias("stem"),
        tx.document_name(path).alias("doc_name"),
    )


#: A line of a table of contents for each heading: number, title, leader and page.
_LINE = "structure || '. ' || title || ' ' || repeat('.', (ord % 6)::INTEGER) || ' ' || physical_index"


def _lines(spark, sf_dir):
    h = v.headings(spark, sf_dir)
    leader = F.repeat(F.lit("."), (F.col("ord") % 6).cast("int"))
    return h.withColumn(
        "line", F.concat("structure", F.lit(". "), "title", F.lit(" "), leader, F.lit(" "), F.col("physical_index").cast("string"))
    )


@query(
    f"""
WITH {v.HEADINGS}
SELECT ord, regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '{_LEADER}', '')), '\\s+\\d+\\s*$', '')),
  '^[.\\-:;,)]+', '') AS title FROM (SELECT ord, {_LINE} AS line FROM headings_v)"""
)
def heading_titles(spark, sf_dir):
    return _lines(spark, sf_dir).select("ord", tx.heading_title(F.col("line")).alias("title"))


@query(
    f"""
WITH {v.HEADINGS}, l AS (SELECT ord // 10 AS page, ord, {_LINE} AS line FROM headings_v)
SELECT page, bool_or(n >= 5) AS is_contents FROM (
  SELECT page, sum(CASE WHEN regexp_matches(line, '{_LEADER}') OR (length(line) > 25 AND regexp_matches(line, '\\s\\d+\\s*$')) THEN 1 ELSE 0 END) AS n
  FROM (SELECT page, trim(line) AS line FROM l) GROUP BY page) GROUP BY page"""
)
def contents_pages(spark, sf_dir):
    text = F.array_join(F.array_sort(F.collect_list(F.struct("ord", "line"))).getField("line"), "\n")
    pages = _lines(spark, sf_dir).groupBy(F.floor(F.col("ord") / 10).alias("page")).agg(text.alias("text"))
    return pages.select("page", tx.is_contents_page(F.col("text")).alias("is_contents"))


@query(
    f"""
WITH {v.HEADINGS}
SELECT ord, coalesce(nullif(trim(substr(t, length(structure) + 1)), ''), t) AS title, structure
FROM (SELECT ord, structure, structure || CASE WHEN ord % 2 = 0 THEN '  ' ELSE ' . ' END || title AS raw FROM headings_v),
  LATERAL (SELECT regexp_replace(raw, '^(' || replace(structure, '.', '\\.') || ')(\\s*\\.\\s*|\\s+)', '\\1') AS t)"""
)
def section_titles(spark, sf_dir):
    raw = F.concat("structure", F.when(F.col("ord") % 2 == 0, F.lit("  ")).otherwise(F.lit(" . ")), "title")
    return v.headings(spark, sf_dir).select("ord", tx.section_title(raw, F.col("structure")).alias("title"), "structure")


_FRONT = [
    "Abstract",
    "  ABSTRACT ..... 3",
    "Status of This   Memo",
    "[Copyright Notice]",
    "Table of Contents 2",
    "TOC",
    "- contents -",
    "1. Introduction",
    "",
]
_ALIASES = ", ".join(f"('{a}', '{n}')" for a, n in tx.FRONT_ALIASES.items())
# Each document begins with one of these lines or, in turn, with its own first words.
_FRONT_SQL = f"SELECT doc_id, doc_id % 25 * 10 AS line_no, coalesce(nullif([{', '.join(f"'{t}'" for t in _FRONT)}][doc_id % {len(_FRONT)} + 1], ''), regexp_extract(text, '[A-Za-z ]+')) AS line FROM documents WHERE text IS NOT NULL"


@query(
    f"""
WITH a(alias, name) AS (VALUES {_ALIASES}), n AS (
  SELECT doc_id, line_no, line, lower(trim(regexp_replace(trim(trim(regexp_replace(trim(regexp_replace(
    trim(regexp_replace(line, '\\s+', ' ', 'g')), '\\.{{2,}}\\s*\\d+\\s*$', '')), '\\s+\\d+\\s*$', '')),
    ' -_:;,.()[]{{}}<>'), '\\s+', ' ', 'g'))) AS key FROM ({_FRONT_SQL})
)
SELECT doc_id, line_no, key, CASE WHEN name = 'Table of Contents' AND line_no >= 40 THEN NULL ELSE name END AS heading
FROM n LEFT JOIN a ON a.alias = n.key"""
)
def front_headings(spark, sf_dir):
    form = F.nullif(F.get(F.array(*map(F.lit, _FRONT)), (F.col("doc_id") % len(_FRONT)).cast("int")), F.lit(""))
    line = F.coalesce(form, F.regexp_extract("text", "[A-Za-z ]+", 0))
    rows = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", (F.col("doc_id") % 25 * 10).alias("line_no"), line.alias("line"))
    return rows.select("doc_id", "line_no", tx.front_text(F.col("line")).alias("key"), tx.front_heading(F.col("line"), F.col("line_no")).alias("heading"))


_SPECS = ["7", " 7 ", "7-11", "11-7", "7,9,11", "9, 7,7", "7,", "7,9-11", "", "a", "-5", "3-", "1,2,3,4,5,6,7,8,9,10,11", "20-22", "0"]
# Each document is asked for pages in one of these forms, with a number of its own in the place of 7.
_SPECS_SQL = f"s AS (SELECT doc_id, replace([{', '.join(f"'{s}'" for s in _SPECS)}][doc_id % {len(_SPECS)} + 1], '7', (doc_id % 23 + 1)::VARCHAR) AS spec FROM documents)"
_PARTS = "list_transform(string_split(trim(spec), ','), lambda x: try_cast(trim(x) AS INTEGER))"
_PARSED = f"""
p AS (SELECT doc_id, spec, CASE WHEN contains(spec, ',') THEN CASE WHEN len(list_filter({_PARTS}, lambda x: x IS NULL)) = 0 THEN list_sort({_PARTS}) END
  WHEN contains(spec, '-') THEN CASE WHEN a <= b THEN range(a, b + 1) END
  WHEN try_cast(trim(spec) AS INTEGER) IS NOT NULL THEN [try_cast(trim(spec) AS INTEGER)] END AS pages,
  CASE WHEN contains(spec, ',') THEN list_filter({_PARTS}, lambda x: x IS NOT NULL)
  WHEN contains(spec, '-') THEN CASE WHEN a <= b THEN range(a, b + 1) ELSE [] END
  WHEN try_cast(trim(spec) AS INTEGER) IS NOT NULL THEN [try_cast(trim(spec) AS INTEGER)] ELSE [] END AS lenient
  FROM (SELECT *, try_cast(trim(left(spec, strpos(spec, '-') - 1)) AS BIGINT) AS a, try_cast(trim(substr(spec, strpos(spec, '-') + 1)) AS BIGINT) AS b FROM s))"""


@query(
    f"""
WITH {_SPECS_SQL}, {_PARSED}
SELECT doc_id, spec, array_to_string(pages, ',') AS pages, array_to_string(lenient, ',') AS lenient,
  CASE WHEN pages IS NULL THEN 'Invalid pages format: ' || spec || '. Use ''7'', ''7-11'', or ''7,9,11''.'
    WHEN len(pages) > 10 THEN 'Too many pages (' || len(pages) || ', max 10). Please request fewer pages.'
    WHEN len(list_filter(pages, lambda x: x < 1 OR x > 20)) > 0
      THEN 'Pages out of range: [' || array_to_string(list_filter(pages, lambda x: x < 1 OR x > 20), ', ') || ']' END AS error
FROM p"""
)
def page_specs(spark, sf_dir):
    form = F.get(F.array(*map(F.lit, _SPECS)), (F.col("doc_id") % len(_SPECS)).cast("int"))
    spec = F.replace(form, F.lit("7"), (F.col("doc_id") % 23 + 1).cast("string"))
    rows = v.read(spark, sf_dir, "documents").select("doc_id", spec.alias("spec")).select(
        "doc_id", "spec", pg.page_list(F.col("spec")).alias("p"), pg.lenient_page_list(F.col("spec")).alias("l")
    )
    return rows.select(
        "doc_id",
        "spec",
        F.array_join(F.col("p").cast("array<string>"), ",").alias("pages"),
        F.array_join(F.col("l").cast("array<string>"), ",").alias("lenient"),
        pg.request_error(F.col("p"), F.col("spec"), F.lit(20)).alias("error"),
    )


@query(
    r"""
SELECT n_regionkey::BIGINT AS region, '| ' || 'key | name |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE replace(n_name, 'A', '\|') END || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM nation GROUP BY n_regionkey"""
)
def markdown_tables(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    name = F.translate("n_name", "A", "|")
    row = F.when(F.col("n_nationkey") % 5 == 0, F.array(key)).otherwise(F.array(key, name))
    rows = v.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).getField("r").alias("rows")
    )
    head = F.array(F.array(F.lit("key"), F.lit("name")))
    return rows.select(
        F.col("n_regionkey").cast("long").alias("region"), tx.markdown_table(F.concat(head, F.col("rows"))).alias("markdown")
    )


@query(
    r"""
SELECT doc_id, trim(array_to_string(string_split(text, chr(10))[2:3], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS lines
FROM documents WHERE text IS NOT NULL"""
)
def line_slices(spark, sf_dir):
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.lines_between(F.col("text"), F.lit(1), F.lit(2)).alias("lines"))


@query(
    f"""
WITH {v.HEADINGS}
SELECT ord, 'turn_' || lpad(ord::VARCHAR, 4, '0') AS turn_id, 'ev_' || lpad(ord::VARCHAR, 6, '0') AS evidence_id,
  'tmp_' || left(sha1('doc|' || title || '|' || physical_index || '|' || ord || '|' || structure), 12) AS provisional_id FROM headings_v"""
)
def identifiers(spark, sf_dir):
    n = F.col("ord")
    text = lambda c: F.col(c).cast("string")
    return v.headings(spark, sf_dir).select(
        "ord",
        tx.numbered("turn_", n, 4).alias("turn_id"),
        tx.numbered("ev_", n, 6).alias("evidence_id"),
        tx.provisional_id(F.lit("doc"), F.col("title"), text("physical_index"), text("ord"), F.col("structure")).alias("provisional_id"),
    )
