"""Queries over whole texts, line slices, citation contexts, relevance, names and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspan.functions import fuzzy
from leafspan.functions import replies as rp
from leafspan.functions import text as tx
from leafspan.operators import ranges, state, tree
from leafspan.plans import inputs as v
from leafspan.plans import session_queries as sq
from leafspan.plans import toc_queries as tq
from leafspan.registry import query

_CITE = tx.CITE.replace("'", "''")


@query("SELECT doc_id, text, (len(string_split(text, chr(10))) + 4)::BIGINT // 5 AS n_pages FROM documents WHERE text IS NOT NULL")
def whole_texts(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).groupBy("doc_id")
    rows = pages.agg(F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("p"), F.count("*").alias("n_pages"))
    return rows.select("doc_id", F.array_join("p.text", "\n").alias("text"), "n_pages")


@query(
    f"""
WITH {v.ANSWERS}, p AS (SELECT doc_id, answer, regexp_split_to_array(answer, '{_CITE}') AS pieces, regexp_extract_all(answer, '{_CITE}') AS tags FROM answers_v),
k AS (SELECT doc_id, i AS seq, right(array_to_string(list_transform(pieces[1:i], lambda x, j: x || CASE WHEN j < i THEN tags[j] ELSE '' END), ''), 500) AS region
  FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM p)),
c AS (SELECT *, CASE WHEN regexp_matches(region, '{tx.BOUNDARY}') THEN regexp_extract(region, '(?s)^.*(?:{tx.BOUNDARY})(.*)$', 1) ELSE right(region, 200) END AS clause FROM k)
SELECT doc_id, seq, trim(regexp_replace(right(trim(clause, ' ' || chr(10)), 200), '{_CITE}', '', 'g'), ' ' || chr(10)) AS context FROM c"""
)
def citation_contexts(spark, sf_dir):
    rows = v.answers(spark, sf_dir).select("doc_id", F.posexplode(tx.citation_contexts(F.col("answer"))).alias("i", "context"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("seq"), "context")


@query(
    f"""
WITH {tq._NODES}, s AS (SELECT *, (doc % 3)::BIGINT AS a, CASE WHEN doc % 4 = 0 THEN NULL ELSE 1 END AS b FROM nodes_v),
l AS (SELECT doc, node_id, page_num, string_split(text, chr(10)) AS t, CASE WHEN page_num = start_index THEN a ELSE 0 END AS x, CASE WHEN page_num = end_index AND b IS NOT NULL THEN b ELSE 1000 END AS y
  FROM s JOIN pages_v ON doc_id = doc AND page_num BETWEEN start_index AND end_index),
p AS (SELECT doc, node_id, page_num, trim(array_to_string(t[x + 1:y + 1], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS part FROM l)
SELECT doc, node_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY page_num) FILTER (WHERE part <> ''), '') AS text FROM p GROUP BY ALL"""
)
def sliced_node_texts(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text")
    nodes = tq._nodes(spark, sf_dir).withColumns(
        {"start_line": (F.col("doc") % 3).cast("int"), "end_line": F.when(F.col("doc") % 4 != 0, F.lit(1))}
    )
    return ranges.sliced_texts(nodes, pages, ["doc", "node_id"])


@query(
    """
WITH n AS (SELECT doc_id % 20 AS session_id, 'n' || doc_id AS node_id, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS summary,
  doc_id % 7 AS start_index, doc_id % 7 + 2 AS end_index FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(summary, '')), '[a-z0-9]{2,}')), ['the', 'of', 'en', 'la', 'der']))::BIGINT AS score FROM n)
SELECT session_id, node_id, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, start_index, end_index, node_id) AS place FROM t"""
)
def relevant_nodes(spark, sf_dir):
    k = F.col("doc_id")
    rows = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        (k % 20).alias("session_id"),
        F.concat(F.lit("n"), k.cast("string")).alias("node_id"),
        F.split("text", "\n").getItem(0).alias("title"),
        F.when(k % 3 != 0, F.col("text")).alias("summary"),
        (k % 7).alias("start_index"),
        (k % 7 + 2).alias("end_index"),
    )
    return state.by_relevance(rows, "the of en LA der").select("session_id", "node_id", "score", "place")


@query(
    """
WITH c AS (SELECT lower(n_name) || '.pdf' AS file_name, 'a/' || n_name AS path, 1 AS priority FROM nation WHERE n_name LIKE '%A'
  UNION ALL SELECT n_name || '.pdf', 'b/' || n_name, 2 FROM nation WHERE n_name LIKE '%I%' UNION ALL SELECT n_name || '.PDF', 'c/' || n_name, 2 FROM nation WHERE n_name LIKE '%N'),
r AS (SELECT lower(file_name) AS k, path, rank() OVER (PARTITION BY lower(file_name) ORDER BY priority) AS r FROM c),
f AS (SELECT k, min(path) AS path, count(DISTINCT path) AS n FROM r WHERE r = 1 GROUP BY k)
SELECT n_name AS name, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'ambiguous' END AS error
FROM nation LEFT JOIN f ON k = lower(n_name) || '.pdf'"""
)
def resolved_names(spark, sf_dir):
    n, name = v.read(spark, sf_dir, "nation"), F.col("n_name")

    def candidates(where, file_name, folder, priority):
        return n.filter(where).select(file_name.alias("file_name"), F.concat(F.lit(folder), name).alias("path"), F.lit(priority).alias("priority"))

    every = (
        candidates(name.like("%A"), F.concat(F.lower(name), F.lit(".pdf")), "a/", 1)
        .unionAll(candidates(name.like("%I%"), F.concat(name, F.lit(".pdf")), "b/", 2))
        .unionAll(candidates(name.like("%N"), F.concat(name, F.lit(".PDF")), "c/", 2))
    )
    return state.resolved(n.select(name.alias("name")), every)


@query(
    """
SELECT event_id, 'sess_' || strftime(ts, '%Y%m%d_%H%M%S') AS session_id, 'log' || event_id || '.json' AS file,
  CASE WHEN event_id % 2 = 0 THEN 'x/' || event_id ELSE 'other/data/' || event_id END AS path,
  concat_ws(chr(10), event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id::VARCHAR END) AS retrieval_text FROM events"""
)
def session_identifiers(spark, sf_dir):
    e = F.col("event_id")
    text = e.cast("string")
    path = F.when(e % 2 == 0, F.concat(F.lit("data/x/"), text)).otherwise(F.concat(F.lit("other/data/"), text))
    file = F.concat(F.lit("a/b/log"), text, F.when(e % 2 == 0, F.lit(".json")).otherwise(F.lit("")))
    return v.read(spark, sf_dir, "events").select(
        "event_id",
        tx.session_id(F.col("ts")).alias("session_id"),
        tx.session_name(file).alias("file"),
        tx.relative_path(path, "data").alias("path"),
        tx.retrieval_text(F.col("event_type"), F.when(e % 3 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))).alias("retrieval_text"),
    )


@query(
    f"""
WITH {sq._ROUTED}
SELECT session_id, string_agg(page::VARCHAR, ',' ORDER BY seq) AS visited_parts FROM (SELECT session_id, page, min(seq) AS seq FROM routed_v WHERE kind = 'structure' GROUP BY ALL) GROUP BY session_id"""
)
def visited_parts(spark, sf_dir):
    out = state.visited_parts(sq._routed(spark, sf_dir).filter("kind = 'structure'"))
    return out.withColumn("visited_parts", F.array_join(F.col("visited_parts").cast("array<string>"), ","))


@query(
    f"""
WITH {v.HEADINGS}
SELECT ord, title, ord % 5 = 0 OR title = 'ASIA' AS is_contents FROM headings_v"""
)
def contents_spans(spark, sf_dir):
    title = F.when(F.col("title") == "ASIA", F.lit(" Table of Contents ")).otherwise(F.col("title"))
    rows = v.headings(spark, sf_dir).select("ord", "title", tree.is_contents_span(F.col("ord") % 5 == 0, title).alias("is_contents"), F.lit("").alias("text"))
    return tree.without_text(rows)


@query(
    f"""
WITH {tq._TOC}, {tq._LINES}, q AS (SELECT doc AS pd, page AS pp, string_agg(line, chr(10) ORDER BY ord) AS text FROM lines_v GROUP BY ALL),
p AS (SELECT ord, lower('x' || title) AS title, lower(left(text, length(text) // 2 + 500)) AS head FROM lines_v JOIN q ON pd = doc AND pp = page),
{v.partial_ratios("ord", "SELECT * FROM p")}
SELECT ord, 'x' || title AS title, round(ratio, 3) AS ratio, ratio >= 85 AS found FROM ratios_v JOIN lines_v USING (ord)"""
)
def fuzzy_titles(spark, sf_dir):
    pages = tq._paged(spark, sf_dir).withColumnRenamed("physical_index", "page")
    rows = tq._lines(spark, sf_dir).join(pages, ["doc", "page"]).withColumn("title", F.concat(F.lit("x"), F.col("title")))
    ratio = fuzzy.title_ratio(F.col("title"), F.col("text"))
    return rows.select("ord", "title", F.round(ratio, 3).alias("ratio"), (ratio >= 85).alias("found"))


@query(f"WITH {v.PAGES} SELECT doc_id AS doc, page_num AS page, text, false AS is_cached FROM pages_v")
def page_cache_flags(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "text")
    return state.cached_flags(pages)


@query(
    f"""
WITH {sq._ROUTED}, k AS (SELECT session_id::VARCHAR AS doc_name, count(DISTINCT page) AS n_pages, count(*) AS total_reads FROM routed_v WHERE kind = 'content' GROUP BY ALL),
d AS (SELECT DISTINCT source AS doc_name FROM documents UNION SELECT DISTINCT user_id::VARCHAR FROM events)
SELECT doc_name, coalesce(n_pages, 0) AS n_pages, coalesce(total_reads, 0) AS total_reads FROM d LEFT JOIN k USING (doc_name)"""
)
def document_states(spark, sf_dir):
    read = state.read_pages(sq._routed(spark, sf_dir).filter("kind = 'content'"))
    known = read.select(F.col("session_id").cast("string").alias("doc_name"), F.array().cast("array<long>").alias("visited_parts"), "read_pages", "total_reads")
    names = v.read(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"))
    names = names.unionAll(v.read(spark, sf_dir, "events").select(F.col("user_id").cast("string")))
    return state.with_initial(known, names).select("doc_name", F.size("read_pages").cast("long").alias("n_pages"), "total_reads")


@query(
    """
SELECT doc_id::VARCHAR AS id, source AS doc_name, text AS query, 'text' AS type, 0::BIGINT AS n_expected, 0::BIGINT AS n_points,
  CASE WHEN concat_ws(', ', CASE WHEN source IS NULL THEN 'doc_name' END, CASE WHEN text IS NULL THEN 'query' END) <> ''
    THEN 'missing: ' || concat_ws(', ', CASE WHEN source IS NULL THEN 'doc_name' END, CASE WHEN text IS NULL THEN 'query' END) END AS problems FROM documents"""
)
def completed_records(spark, sf_dir):
    from leafspan import records

    rows = v.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc_name"), F.col("text").alias("query"), F.lit("text").alias("type"))
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("expected_pages", "n_expected"), ("key_points", "n_points"))]
    return records.completed(rows, "test_case").select("id", "doc_name", "query", "type", *sizes, "problems")


@query(
    """
SELECT event_id, 'event: message' || chr(10) || 'data: {"type":"' || event_type || '","user":' || user_id || '}' || chr(10) || chr(10) AS wire,
  '{"a":"' || repeat('x', least(event_id % 90, 40)::INTEGER) || CASE WHEN event_id % 90 > 40 THEN '...' ELSE '' END || '","' || repeat('n', 50) || '":' || event_id || '}' AS shortened,
  CASE WHEN event_id % 2 = 0 THEN props ELSE '{"message":"' || event_type || '"}' END AS log_entry FROM events"""
)
def event_messages(spark, sf_dir):
    e = F.col("event_id")
    value = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), (e % 90).cast("int")), F.lit('","' + "n" * 50 + '":'), e.cast("string"), F.lit("}"))
    return v.read(spark, sf_dir, "events").select(
        "event_id",
        rp.event_text(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("wire"),
        rp.shortened(value).alias("shortened"),
        rp.log_entry(F.when(e % 2 == 0, F.col("props")).otherwise(F.col("event_type"))).alias("log_entry"),
    )


@query(
    """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN source || '_7' || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END ELSE source || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END END AS kept_as,
  CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '9' END AS max_limit, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS n_options FROM documents"""
)
def upload_requests(spark, sf_dir):
    k, text = F.col("doc_id"), F.col("doc_id").cast("string")
    name = F.concat(F.lit("a/b/"), "source", F.when(k % 5 == 0, F.lit(".txt")).when(k % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".pdf")))
    own = F.when(k % 2 == 0, F.concat(F.lit('"structure_chunk_max_limit": '), text, F.lit(", "))).otherwise(F.lit(""))
    more = F.when(k % 4 == 0, F.lit('"if_add_node_id": "yes", ')).otherwise(F.lit(""))
    options = rp.process_options(F.concat(F.lit("{"), own, more, F.lit('"unknown": 1, "toc_check_pages": null, "structure_max_limit": 9}')))
    return v.read(spark, sf_dir, "documents").select(
        "doc_id",
        rp.upload_name(name, k % 3 == 0, F.lit("7")).alias("kept_as"),
        F.element_at(options, F.lit("structure_max_limit")).alias("max_limit"),
        F.size(options).cast("long").alias("n_options"),
    )


@query(
    """
WITH e AS (SELECT user_id AS topic_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'turn' WHEN 'click' THEN 'update' ELSE 'create' END AS kind FROM events),
m AS (SELECT *, max(seq) FILTER (WHERE kind = 'create') OVER (PARTITION BY topic_id) AS made FROM e)
SELECT topic_id, string_agg('t' || seq, ',' ORDER BY seq) FILTER (WHERE kind <> 'update') AS turns, 'n' || max(seq) FILTER (WHERE kind <> 'turn') AS nodes,
  CASE WHEN max(seq) FILTER (WHERE kind <> 'turn') % 2 = 0 THEN '' ELSE 'g' END AS gaps FROM m WHERE seq >= made GROUP BY topic_id"""
)
def topic_snapshots(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "turn").when(F.col("event_type") == "click", "update").otherwise("create")
    id_of = lambda letter: F.concat(F.lit(letter), e.cast("string"))
    events = v.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("topic_id"),
        e.alias("seq"),
        kind.alias("kind"),
        id_of("t").alias("turn_id"),
        F.array(id_of("n")).alias("node_ids"),
        F.array().cast("array<string>").alias("evidence_ids"),
        F.when(e % 2 != 0, F.array(F.lit("g"))).alias("open_gaps"),
    )
    joined = lambda c: F.array_join(c, ",")
    return state.topics(events).select("topic_id", joined("related_turn_ids").alias("turns"), joined("related_node_ids").alias("nodes"), joined("open_gaps").alias("gaps"))
