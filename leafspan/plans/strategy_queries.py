"""Queries over indexes that are chosen, checked and mended document by document."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspan.operators import models, strategy, titles, toc
from leafspan.plans import inputs as v
from leafspan.registry import query

# Each page begins with its number and its first word as a heading. The first strategy is right for every third document and
# mostly right for the next ones; the second is mostly right for half of the others, and the third reads headings, some of them a page late.
_SHIFTS = {
    "numbered": "CASE WHEN doc % 3 = 0 THEN 0 WHEN doc % 3 = 1 THEN CASE WHEN page % 5 = 4 THEN 1 ELSE 0 END ELSE 1 END",
    "unnumbered": "CASE WHEN doc % 2 = 0 AND page % 4 <> 3 THEN 0 ELSE 1 END",
    "headings": "CASE WHEN page % 7 = 6 OR doc % 11 = 5 THEN 1 ELSE 0 END",
}


def _pages(spark, sf_dir):
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    rows = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), F.when(word == "", "Part").otherwise(word).alias("title"), "text")
    return rows.select("doc", "page", "title", F.concat("page", F.lit(". "), "title", F.lit("\n"), "text").alias("text"))


def _build(name):
    def build(own):
        # what a strategy knows of a page: its number and its heading
        head = F.regexp_extract("text", r"^\d+\. ([A-Za-z]+)", 1)
        rows = own.select("doc", F.col("page").alias("ord"), F.col("page").cast("string").alias("structure"), head.alias("title"), "page")
        return rows.withColumn("physical_index", F.col("page") + F.expr(_SHIFTS[name]))

    return build


def _found(text: str, structure: str, title: str) -> str:
    return f"regexp_matches({text}, '(?i)' || {structure} || '\\.?\\s*' || {title})"


def _rounds(name: str, left: str) -> str:
    """The statement's tables for one strategy: entries i, checked entries c and states m, once and after each repair."""
    out = f"""
i_{name}0 AS MATERIALIZED (
  SELECT doc, page AS ord, page::VARCHAR AS structure, title, page + {_SHIFTS[name]} AS pi, pages FROM (SELECT g.doc, page, title, pages FROM g JOIN {left} l ON l.doc = g.doc)
  WHERE page + {_SHIFTS[name]} <= pages)"""
    for r in range(strategy.MOST_REPAIRS + 1):
        ill = f"accuracy > {strategy.MENDABLE} AND wrong > 0" if r == 0 else "wrong > 0"
        out += f""",
c_{name}{r} AS MATERIALIZED (
  SELECT i.*, coalesce({_found("g.text", "structure", "i.title")}, false) AS found FROM i_{name}{r} i LEFT JOIN g ON g.doc = i.doc AND g.page = pi),
m_{name}{r} AS MATERIALIZED (
  SELECT l.doc, l.pages, CASE WHEN coalesce(max(pi), 0) < l.pages / 2 THEN 0.0 ELSE coalesce(avg(found::INTEGER), 0.0) END AS accuracy, coalesce(sum((NOT found)::BIGINT), 0) AS wrong
  FROM {left if r == 0 else f"(SELECT * FROM m_{name}{r - 1} WHERE {ill if r > 1 else f'accuracy > {strategy.MENDABLE} AND wrong > 0'})"} l LEFT JOIN c_{name}{r} c ON c.doc = l.doc GROUP BY l.doc, l.pages)"""
        if r == strategy.MOST_REPAIRS:
            break
        near = "OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN {})"
        good = "CASE WHEN found THEN pi END IGNORE NULLS"
        out += f""",
b_{name}{r} AS MATERIALIZED (
  SELECT c.*, coalesce(last_value({good}) {near.format("UNBOUNDED PRECEDING AND 1 PRECEDING")}, 1) AS low, least(coalesce(first_value({good}) {near.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")}, 1 << 30), pages) AS high
  FROM c_{name}{r} c WHERE doc IN (SELECT doc FROM m_{name}{r} WHERE {ill})),
i_{name}{r + 1} AS MATERIALIZED (
  SELECT b.doc, b.ord, b.structure, b.title, coalesce(min(g.page), b.pi) AS pi, b.pages
  FROM b_{name}{r} b LEFT JOIN g ON NOT found AND g.doc = b.doc AND g.page BETWEEN low AND high AND {_found("g.text", "structure", "b.title")}
  GROUP BY b.doc, b.ord, b.structure, b.title, b.pi, b.pages)"""
    return out + f""",
e_{name} AS MATERIALIZED ({" UNION ALL ".join(_closed(name, r) for r in range(strategy.MOST_REPAIRS + 1))}),
left_{name} AS MATERIALIZED (SELECT * FROM m_{name}0 WHERE accuracy <= {strategy.MENDABLE})"""


def _closed(name: str, r: int) -> str:
    right = "" if r == strategy.MOST_REPAIRS else " AND wrong = 0"
    return f"""SELECT m.doc, '{name}' AS strategy, {r} AS repairs, accuracy, wrong, (SELECT string_agg(pi::VARCHAR, ',' ORDER BY ord) FROM i_{name}{r} i WHERE i.doc = m.doc) AS entries
  FROM m_{name}{r} m WHERE {f"accuracy > {strategy.MENDABLE}" if r == 0 else "true"}{right}"""


_NAMES = list(_SHIFTS)
_ALL = ",".join(_rounds(name, f"left_{_NAMES[k - 1]}" if k else "n") for k, name in enumerate(_NAMES))
_CHOSEN = f"""WITH {v.PAGES}, g AS MATERIALIZED (
  SELECT doc, page, title, page || '. ' || title || chr(10) || text AS text
  FROM (SELECT doc_id AS doc, page_num AS page, coalesce(nullif(regexp_extract(text, '[A-Za-z]+'), ''), 'Part') AS title, text FROM pages_v)),
n AS MATERIALIZED (SELECT doc, max(page) AS pages FROM g GROUP BY doc), {_ALL}"""


def _outcome(spark, sf_dir):
    return strategy.chosen({name: _build(name) for name in _SHIFTS}, _pages(spark, sf_dir), toc.appears_on_page)


@query(
    f"""{_CHOSEN}
SELECT doc, strategy, repairs, round(accuracy, 9) AS accuracy, wrong::BIGINT AS wrong, entries FROM ({" UNION ALL ".join(f"SELECT * FROM e_{name}" for name in _NAMES)})
UNION ALL SELECT doc, NULL, 0, round(accuracy, 9), wrong::BIGINT, NULL FROM left_{_NAMES[-1]}"""
)
def index_strategies(spark, sf_dir):
    """Which strategy each document ends with, after how many repairs, and the pages of its entries in order."""
    outcome = strategy.chosen({name: _build(name) for name in _SHIFTS}, _pages(spark, sf_dir), toc.appears_on_page)
    rows = outcome.index.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "physical_index"))).alias("e"))
    entries = rows.select("doc", F.array_join(F.transform("e", lambda e: e["physical_index"].cast("string")), ",").alias("entries"))
    return outcome.states.select("doc", "strategy", "repairs", F.round("accuracy", 9).alias("accuracy"), "wrong").join(entries, "doc", "left")


# A piece of each document's first page is its title, with some characters changed: one in ten, or every fourth for every third document.
_PIECE = "substring(text, 20, 24)"
_TITLES = f"""
SELECT doc_id AS doc, 1::BIGINT AS ord, array_to_string(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN i % (CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 10 END) = 3 THEN '#' ELSE p[i] END), '') AS title
FROM (SELECT doc_id, {_PIECE} AS p FROM pages_v WHERE page_num = 1) WHERE length(p) > 0"""

@query(
    f"""
WITH {v.PAGES}, t AS ({_TITLES}), h AS (SELECT doc_id, page_num, lower(left(text, length(text) // 2 + 500)) AS head FROM pages_v),
p AS (SELECT doc, ord, page_num AS page, lower(trim(title, ' ')) AS title, head FROM t JOIN h ON doc_id = doc WHERE title <> '' AND head <> ''),
{v.partial_ratios("doc, ord, page", "SELECT * FROM p WHERE trim(title, ' ') <> ''")}
SELECT doc, ord, page, round(ratio, 3) AS ratio FROM ratios_v WHERE ratio >= 85"""
)
def titles_on_pages(spark, sf_dir):
    """Where documents hold pieces of their first pages, roughly."""
    pages = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text")
    piece = pages.filter("page = 1").select("doc", F.substring("text", 20, 24).alias("p")).filter("p <> ''")
    gap = F.when(F.col("doc") % 3 == 0, 4).otherwise(10)
    changed = F.array_join(F.transform(F.sequence(F.lit(1), F.length("p")), lambda i: F.when(i % gap == 3, "#").otherwise(F.substring("p", i, F.lit(1)))), "")
    found = titles.titles_on_pages(piece.select("doc", F.lit(1).cast("long").alias("ord"), changed.alias("title")), pages)
    return found.withColumn("ratio", F.round("ratio", 3))


def _reader(prompt: str) -> str:
    """Stands for a model: what a prompt says, turned around; it refuses empty ones."""
    if not prompt.strip():
        raise ValueError("nothing to read")
    return prompt[::-1]


@query(
    """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'known' WHEN trim(line, ' ') <> '' THEN reverse(line) END AS reply, CASE WHEN lang IS DISTINCT FROM 'en' AND trim(line, ' ') = '' THEN 'ValueError: nothing to read' END AS error
FROM (SELECT doc_id, line, CASE WHEN line IN (SELECT left(string_split(text, chr(10))[1], 40) FROM documents WHERE text IS NOT NULL AND lang = 'en') THEN 'en' ELSE 'xx' END AS lang
  FROM (SELECT doc_id, left(string_split(text, chr(10))[1], 40) AS line FROM documents WHERE text IS NOT NULL))"""
)
def model_replies(spark, sf_dir):
    """Replies to each document's first line; those to English ones are known from a run before."""
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    rows = docs.select("doc_id", "lang", F.left(F.split("text", "\n").getItem(0), F.lit(40)).alias("prompt"))
    known = rows.filter("lang = 'en'").select(models.key(F.col("prompt")).alias("prompt_key"), F.lit("known").alias("reply")).distinct()
    return models.asked(rows, "prompt", _reader, known, models.Limits(pause=0)).select("doc_id", "reply", "error")
