"""Queries over bookmarks, front matter, model replies, web pages, evidence, turns, files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafspan.functions import replies as rp
from leafspan.functions import text as tx
from leafspan.operators import outline, ranges, state
from leafspan.plans import inputs as v
from leafspan.plans import session_queries as sq
from leafspan.plans import toc_queries as tq
from leafspan.registry import query

_MARKS = """m AS (
  SELECT s_nationkey::BIGINT AS doc, s_suppkey AS ord, 1 + (s_suppkey * 7) % 4 AS level, CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey % 9 || '.' || s_suppkey % 4 || ') ' || s_name
    WHEN s_suppkey % 11 = 0 THEN ' Preface ' ELSE s_name || ' ' || s_suppkey % 3 END AS title, s_suppkey // 20 + 1 AS page FROM supplier),
i AS (SELECT *, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY doc ORDER BY ord)),
l AS (SELECT *, least(min(level - i) OVER (PARTITION BY doc ORDER BY ord) + i, i) AS l FROM i)"""


def _numbers() -> str:
    groups = ", ".join(f"sum((l < {k})::INTEGER) OVER (PARTITION BY doc ORDER BY ord) AS g{k}" for k in range(1, 5))
    counts = ", ".join(f"sum((l = {k})::INTEGER) OVER (PARTITION BY doc, g{k} ORDER BY ord) AS c{k}" for k in range(1, 5))
    made = ", ".join(f"CASE WHEN l >= {k} AND c{k} > 0 THEN c{k}::VARCHAR END" for k in range(1, 5))
    return f"g AS (SELECT *, {groups} FROM l), c AS (SELECT *, {counts} FROM g), n AS (SELECT *, concat_ws('.', {made}) AS made, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM c)"


@query(
    f"""
WITH {_MARKS}, {_numbers()}, e AS (SELECT *, regexp_matches(t, '^\\d+(\\.\\d+)*[.)]?\\s*') AS x FROM n),
f AS (SELECT *, first_value(CASE WHEN x THEN page END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM e),
o AS (SELECT doc, ord, page AS physical_index, CASE WHEN x THEN regexp_extract(t, '^(\\d+(\\.\\d+)*)', 1) WHEN lower(t) <> 'preface' AND page >= start THEN made END AS structure,
  CASE WHEN x THEN trim(regexp_replace(t, '^\\d+(\\.\\d+)*[.)]?\\s*', '')) ELSE t END AS title FROM f),
d AS (SELECT doc, structure, physical_index, arg_min(title, ord) AS title FROM o GROUP BY doc, structure, lower(title), physical_index)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY physical_index, coalesce(structure, ''), title) AS ord, structure, title, physical_index FROM d"""
)
def bookmark_outline(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_name")
    text = lambda c: c.cast("string")
    title = (
        F.when(k % 6 == 0, F.concat(text(k % 9), F.lit("."), text(k % 4), F.lit(") "), name))
        .when(k % 11 == 0, F.lit(" Preface "))
        .otherwise(F.concat(name, F.lit(" "), text(k % 3)))
    )
    marks = v.read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("long").alias("doc"), k.alias("ord"), (1 + k * 7 % 4).alias("level"), title.alias("title"), (F.floor(k / 20) + 1).alias("page")
    )
    return outline.from_bookmarks(marks)


def _front_pages(spark, sf_dir):
    """Made front matter: every document gets an abstract, a table of contents over some pages and a first section."""
    d = v.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc"), "n_name")
    entry = F.concat(F.col("n_name"), F.lit(" ........ 7"))
    many = F.array_join(F.array_repeat(entry, 6), "\n")
    plain = lambda *x: F.array_join(F.array(*x), "\n")
    pages = F.array(
        plain(F.lit("Memo"), F.lit("  Abstract"), F.col("n_name"), F.lit("Copyright Notice"), F.lit("all")),
        plain(F.lit("x"), F.lit("Table of Contents"), many),
        F.when(F.col("doc") % 2 == 0, many).otherwise(F.lit("nothing here")),
        F.when(F.col("doc") % 3 == 0, plain(many, F.lit("1. Introduction"), F.lit("text"))).otherwise(plain(F.lit("1. Introduction"), F.lit("text"))),
    )
    rows = d.select("doc", F.posexplode(pages).alias("pos", "text")).select("doc", (F.col("pos") + 1).cast("long").alias("page"), "text")
    firsts = d.select("doc", F.lit(4).cast("long").alias("first_page"), F.lit("1").alias("structure"), F.lit("Introduction").alias("title"))
    return rows, firsts


@query(
    """
WITH d AS (SELECT n_nationkey::BIGINT AS doc FROM nation)
SELECT doc, 'front_abstract' AS node_id, 'Abstract' AS title, 1::BIGINT AS start_index, 1::BIGINT AS end_index, 1::BIGINT AS start_line, 2::BIGINT AS end_line, false AS toc_span FROM d
UNION ALL SELECT doc, 'front_copyright', 'Copyright Notice', 1, 1, 3, 4, false FROM d
UNION ALL SELECT doc, 'front_toc', 'Table of Contents', 2, CASE WHEN doc % 2 = 1 THEN 2 WHEN doc % 3 = 0 THEN 4 ELSE 3 END, 1, CASE WHEN doc % 2 = 1 THEN 7 ELSE 5 END, true FROM d"""
)
def front_matter(spark, sf_dir):
    return outline.front_matter(*_front_pages(spark, sf_dir))


def _levels(most: int = 5) -> str:
    """The levels of headings below one node per document, each with ends from the next of its parent."""
    out = [
        "found_v AS MATERIALIZED (SELECT doc, structure, arg_min(title, physical_index) AS title, min(physical_index) AS start_index, "
        "regexp_extract(structure, '^(.*)\\.\\d+$', 1) AS parent FROM (SELECT doc, structure, title, page AS physical_index FROM lines_v WHERE contains(structure, '.')) GROUP BY doc, structure)",
        "level_0 AS (SELECT doc, doc::VARCHAR AS structure, 'top' AS title, 0::BIGINT AS start_index, max(page) AS end_index FROM lines_v GROUP BY doc)",
    ]
    for k in range(1, most + 1):
        out.append(
            f"level_{k} AS MATERIALIZED (SELECT f.doc, f.structure, f.title, f.start_index, greatest(f.start_index, coalesce(lead(f.start_index) OVER "
            f"(PARTITION BY f.doc, f.parent ORDER BY f.start_index, length(f.structure), f.structure), u.end_index)) AS end_index "
            f"FROM found_v f JOIN level_{k - 1} u ON u.doc = f.doc AND u.structure = f.parent WHERE f.start_index BETWEEN u.start_index AND u.end_index)"
        )
    return ", ".join(out)


@query(
    f"""
WITH {tq._TOC}, {tq._LINES}, {_levels()}
"""
    + " UNION ALL ".join(f"SELECT *, {k} AS level FROM level_{k}" for k in range(6))
)
def refined_outline(spark, sf_dir):
    pages = tq._paged(spark, sf_dir)
    last = pages.groupBy("doc").agg(F.max("physical_index").alias("end_index"))
    nodes = last.select(
        "doc", F.col("doc").cast("string").alias("structure"), F.lit("top").alias("title"), F.lit(0).cast("long").alias("start_index"), "end_index"
    )
    return outline.refined(nodes, pages)


# Replies about each document, in turn: fenced and broken ones, trailing commas, none at all. # stands for its id, @ for its first word.
_REPLIES = {
    'Here:\n```json\n{"id": #,\n "b": None, "w": "@"}\n``` done': '{"id": #, "b": null, "w": "@"}',
    '{"w": "@", }': "{}",
    '{"w": ["@",#,],"b":3,}': '{"w": ["@",#],"b":3}',
    "@ and no json": "{}",
    '```json {"w": "@"}```': '{"w": "@"}',
    '{"w": None, "d": #}': '{"w": null, "d": #}',
    "[1, #]": "[1, #]",
    "": "{}",
}
_REPLY_OUT = ", ".join(f"'{x}'" for x in _REPLIES.values())


@query(
    f"""
SELECT doc_id, replace(replace([{_REPLY_OUT}][doc_id % {len(_REPLIES)} + 1], '#', doc_id::VARCHAR), '@', regexp_extract(text, '[a-z]+')) AS json FROM documents WHERE text IS NOT NULL"""
)
def reply_json(spark, sf_dir):
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    form = F.get(F.array(*map(F.lit, _REPLIES)), (F.col("doc_id") % len(_REPLIES)).cast("int"))
    reply = F.replace(F.replace(form, F.lit("#"), F.col("doc_id").cast("string")), F.lit("@"), F.regexp_extract("text", "[a-z]+", 0))
    return docs.select("doc_id", rp.json_text(reply).alias("json"))


_TAGGED = "'<physical_index_' || k || '>a' || chr(10) || 'b<physical_index_' || k || '>' || CASE WHEN k % 2 = 0 THEN 'x<physical_index_' || (k + 1) || '>c<physical_index_' || (k + 1) || '>' ELSE '' END"


@query(
    f"""
SELECT k, tagged, regexp_extract(tagged, '<physical_index_(\\d+)>', 1)::BIGINT AS first, regexp_extract_all(tagged, '<physical_index_(\\d+)>', 1)[-1]::BIGINT AS last,
  substr(tagged, 2 * length('<physical_index_' || k || '>') + 4) AS rest, k AS number, CASE WHEN k % 2 = 1 THEN NULL ELSE k END AS whole
FROM (SELECT k, {_TAGGED} AS tagged FROM (SELECT n_nationkey::BIGINT AS k FROM nation))"""
)
def index_tags(spark, sf_dir):
    k = F.col("k")
    tag = lambda n: F.concat(F.lit("<physical_index_"), n.cast("string"), F.lit(">"))
    text = F.concat(
        tag(k), F.lit("a\nb"), tag(k), F.when(k % 2 == 0, F.concat(F.lit("x"), tag(k + 1), F.lit("c"), tag(k + 1))).otherwise(F.lit(""))
    )
    rows = v.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")).withColumn("tagged", text)
    t = F.col("tagged")
    whole = F.when(k % 2 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.lit("iv"))
    return rows.select(
        "k",
        "tagged",
        rp.first_tag(t).alias("first"),
        rp.last_tag(t).alias("last"),
        rp.without_first_page(t).alias("rest"),
        rp.tagged_index(F.concat(F.lit("<physical_index_"), k.cast("string"), F.lit(">"))).alias("number"),
        rp.whole_number(whole).alias("whole"),
    )


@query(
    """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary,
  CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '...[truncated]' ELSE text END AS page,
  CASE WHEN length(text) > 20000 THEN left(text, 2000) || chr(10) || '...[truncated for stream]|' || left(text, 2000) || chr(10) || '...[truncated for stream]'
    ELSE text || '|' || text || '|' || text END AS streamed FROM documents WHERE text IS NOT NULL"""
)
def clipped_results(spark, sf_dir):
    t = F.col("text")
    rows = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    streamed = F.array_join(rp.stream_result(F.array(t, t, t), F.length(t)), "|")
    return rows.select("doc_id", rp.result_summary(t).alias("summary"), rp.page_result(t).alias("page"), streamed.alias("streamed"))


@query(r"SELECT doc_id, regexp_replace(text || ' ......... 12', '\.{5,}', ': ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def contents_without_leaders(spark, sf_dir):
    rows = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", tx.without_leaders(F.concat("text", F.lit(" ......... 12"))).alias("text"))


@query(
    r"""
SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title, len(p)::BIGINT AS n_lines,
  array_to_string(list_transform(p, lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), chr(10)) AS text
FROM (SELECT *, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS p FROM pages)"""
)
def web_pages(spark, sf_dir):
    from leafspan.sources.files import parsed_html

    return parsed_html(v.read(spark, sf_dir, "pages"))


# Evidence: each citation of an answer is an item; the turn that found it uses it.
_EVIDENCE = f"""{v.ANSWERS}, e AS (
  SELECT doc_id, unnest(range(1, len(p) + 1)) AS seq, unnest(d) AS source_doc, unnest(p)::BIGINT AS source_page
  FROM (SELECT doc_id, regexp_extract_all(answer, '{tx.CITE.replace("'", "''")}', 1) AS d, regexp_extract_all(answer, '{tx.CITE.replace("'", "''")}', 2) AS p FROM answers_v)),
ev AS (SELECT *, 'ev_' || lpad((row_number() OVER (ORDER BY doc_id, seq) + 100)::VARCHAR, 6, '0') AS evidence_id FROM e)"""


def _evidence(spark, sf_dir):
    rows = v.answers(spark, sf_dir).select("doc_id", F.posexplode(tx.citations(F.col("answer"))).alias("seq", "c"))
    rows = rows.select("doc_id", (F.col("seq") + 1).cast("long").alias("seq"), F.col("c.doc_name").alias("source_doc"), F.col("c.page").cast("long").alias("source_page"))
    last = spark.range(1).select(F.lit(100).cast("long").alias("last"))
    return state.numbered_from(rows, last, ["doc_id", "seq"], "ev", 6).withColumnRenamed("new_id", "evidence_id")


@query(f"WITH {_EVIDENCE} SELECT doc_id, seq, source_doc, source_page, evidence_id FROM ev")
def evidence_items(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(
    f"WITH {_EVIDENCE} SELECT source_doc, source_page, count(*) AS n, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence_ids, "
    "string_agg('turn_' || doc_id, ',' ORDER BY evidence_id) AS used_in_turns FROM ev GROUP BY ALL"
)
def evidence_by_source(spark, sf_dir):
    item = F.struct("evidence_id", F.concat(F.lit("turn_"), F.col("doc_id").cast("string")).alias("turn"))
    rows = _evidence(spark, sf_dir).groupBy("source_doc", "source_page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("i"))
    return rows.select(
        "source_doc", "source_page", "n", F.array_join("i.evidence_id", ",").alias("evidence_ids"), F.array_join("i.turn", ",").alias("used_in_turns")
    )


@query(
    """
WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS session_id, 'turn_' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR, 4, '0') AS turn_id, text AS user_query,
  CASE WHEN next_role = 'assistant' THEN 'completed' ELSE 'active' END AS status, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM t WHERE role = 'user'"""
)
def turn_records(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = v.read(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    rows = rows.filter("role = 'user'")
    done = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    return rows.select(
        F.col("conv_id").alias("session_id"),
        tx.numbered("turn_", F.row_number().over(w), 4).alias("turn_id"),
        F.col("text").alias("user_query"),
        F.when(done, F.lit("completed")).otherwise(F.lit("active")).alias("status"),
        F.when(done, F.col("next_text")).alias("answer"),
    )


def _folder(spark, name: str) -> str:
    from leafspan.sources.files import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""
WITH {v.PAGES}
SELECT doc_id AS doc, (page_num - 1) // 4 AS bucket, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars, min(page_num) || '-' || max(page_num) AS chunk_id
FROM pages_v GROUP BY ALL"""
)
def written_page_windows(spark, sf_dir):
    from leafspan.sources import files

    pages = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text")
    path = _folder(spark, "pages")
    files.write_pages(pages, path, 4)
    back = files.read_pages(spark, path)
    return back.groupBy("doc", F.col("bucket").cast("long").alias("bucket")).agg(
        F.count("*").alias("n_pages"),
        F.sum(F.length("text")).alias("n_chars"),
        F.concat_ws("-", F.min("page").cast("string"), F.max("page").cast("string")).alias("chunk_id"),
    )


@query(
    f"""
WITH {sq._PARTS}
SELECT doc, count(*) AS total_parts, string_agg('part_' || lpad(part::VARCHAR, 4, '0') || '.json', ',' ORDER BY part) AS files FROM (SELECT DISTINCT doc, part FROM parts_v) GROUP BY doc"""
)
def written_parts(spark, sf_dir):
    from leafspan.operators import parts
    from leafspan.plans.session_queries import _part_nodes
    from leafspan.sources import files

    path = _folder(spark, "parts")
    files.write_parts(parts.tree_parts(_part_nodes(spark, sf_dir), most=2000), path)
    return files.read_manifest(spark, path)


@query("SELECT doc_id, source || '.pdf' AS doc_name, n_chars AS total_pages FROM documents")
def session_log_round_trip(spark, sf_dir):
    from leafspan.sources import files

    rows = v.read(spark, sf_dir, "documents")
    rows = rows.select("doc_id", F.concat("source", F.lit(".pdf")).alias("doc_name"), F.col("n_chars").alias("total_pages"))
    path = _folder(spark, "log")
    files.append_json(rows, path)
    return files.read_json(spark, path, rows.schema)


@query(
    f"""
WITH {v.CALLS}
SELECT session_id, seq, tool, CASE WHEN tool IN ('view', 'click') THEN NULL ELSE 'Unknown tool: ' || tool END AS error,
  CASE tool WHEN 'view' THEN 'page ' || page WHEN 'click' THEN 'part ' || page % 3 END AS result FROM calls_v"""
)
def tool_dispatch(spark, sf_dir):
    from leafspan.operators.tools import Tools

    tools = Tools()
    tools.add("view", lambda page: F.concat(F.lit("page "), page.cast("string")))
    tools.add("click", lambda page: F.concat(F.lit("part "), (page % 3).cast("string")))
    out = tools.run(v.tool_calls(spark, sf_dir), "tool", "page")
    return out.select("session_id", "seq", "tool", "error", "result")


@query(
    f"""
WITH {v.CALLS}
SELECT session_id, count(DISTINCT page) AS n_pages, count(*) AS total_reads FROM calls_v WHERE tool = 'view' GROUP BY session_id"""
)
def streamed_read_status(spark, sf_dir):
    from leafspan.streaming.reading import read_status_stream

    return read_status_stream(spark, sf_dir, _folder(spark, "stream"))


@query(
    """
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL"""
)
def streamed_daily_tools(spark, sf_dir):
    from leafspan.streaming.reading import daily_tools_stream

    return daily_tools_stream(spark, sf_dir, _folder(spark, "days"))


@query()
def ingested_documents(spark, sf_dir):
    from leafspan.operators import ingest

    docs = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text")
    return ingest.ingest(docs, _folder(spark, "library")).report()


@query(
    f"""
WITH {v.PAGES}
SELECT doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS batch, max(page_num) AS total_pages, count(*) AS n_pages
FROM pages_v GROUP BY ALL"""
)
def ingested_in_two_runs(spark, sf_dir):
    """All documents in a library: those of even ids from a first run, the others added by a run over all."""
    from leafspan.operators import ingest

    docs = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text")
    path = _folder(spark, "library")
    ingest.ingest(docs.filter("doc % 2 = 0"), path)
    library = ingest.ingest(docs, path)
    held = library.table("pages").groupBy("doc").agg(F.count("*").alias("n_pages"))
    return library.table("registry").join(library.batches("registry"), "doc").join(held, "doc").select("doc", "batch", "total_pages", "n_pages")


def _page_reader(messages: list[dict]) -> dict:
    """A stand-in for a model: reads one page, then answers with how it begins; every fifth question is never done."""
    number = int(messages[1]["content"].split("\n")[0].rsplit(" ", 1)[-1])
    page = 1 + number % 3
    found = [m["content"] for m in messages if m["role"] == "tool"]
    if found and number % 5:
        return {"text": f'{found[-1][:20]} <cite doc="{number}" page="{page}"/>'}
    return {"text": "", "calls": [{"tool": "page", "argument": f"{number}:{page}"}]}


@query(
    f"""
WITH {v.PAGES}, q AS (SELECT item_id::BIGINT AS question_id, 1 + item_id::BIGINT % 3 AS page FROM benchmark),
r AS (SELECT question_id, q.page, p.text FROM q LEFT JOIN pages_v p ON p.doc_id = question_id AND p.page_num = q.page)
SELECT question_id, CASE WHEN question_id % 5 = 0 THEN '[达到最大轮次限制]' ELSE trim(left(coalesce(text, 'Error: no such page'), 20) || ' <cite doc="' || question_id || '" page="' || page || '"/>', ' ' || chr(10) || chr(9) || chr(13)) END AS answer,
  CASE WHEN question_id % 5 = 0 THEN 3 ELSE 2 END::BIGINT AS total_turns, CASE WHEN question_id % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS n_calls, CASE WHEN text IS NULL THEN '' ELSE page::VARCHAR END AS pages FROM r"""
)
def questions_in_turns(spark, sf_dir):
    from leafspan.operators import dialog

    items = v.read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("question_id"), "text")
    start = dialog.opening(F.lit("What is there?"), F.col("question_id").cast("string"), "Answer from the pages.")
    pages = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("_doc"), F.col("page_num").alias("_page"), "text")

    def run(calls):
        asked = calls.withColumn("_doc", F.split_part("argument", F.lit(":"), F.lit(1)).cast("long")).withColumn("_page", F.split_part("argument", F.lit(":"), F.lit(2)).cast("long"))
        found = asked.join(pages, ["_doc", "_page"], "left")
        read = F.when(F.col("text").isNotNull(), F.array("_page"))
        return found.select(*calls.columns, F.col("text").alias("result"), F.when(F.col("text").isNull(), F.lit("no such page")).alias("error"), read.alias("pages"))

    out = dialog.answered(items.select("question_id", start.alias("messages")), _page_reader, run, turns=3)
    return out.select("question_id", "answer", "total_turns", F.size("trace").cast("long").alias("n_calls"), F.array_join(F.col("pages_retrieved").cast("array<string>"), ",").alias("pages"))
