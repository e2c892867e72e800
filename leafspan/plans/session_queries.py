"""Queries over ranking, evaluation, reading state, conversations and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafspan.functions import text as tx
from leafspan.operators import conversations as cv
from leafspan.operators import evaluation as ev
from leafspan.operators import parts, retrieve, state, tree
from leafspan.plans import inputs as v
from leafspan.plans.toc_queries import _toc
from leafspan.plans import toc_queries as tq
from leafspan.registry import query

_T = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}') || regexp_extract_all({0}, '[一-鿿]'))"
_SCORES = f"""
sec AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10))[1] AS title, text, {_T.format("string_split(text, chr(10))[1]")} AS tt, {_T.format("left(text, 12000)")} AS xt FROM documents WHERE text IS NOT NULL),
ask AS MATERIALIZED (SELECT item_id, text, {_T.format("text")} AS qt FROM benchmark),
sc AS MATERIALIZED (
  SELECT item_id, doc_id, 2 * len(list_intersect(qt, tt)) + len(list_intersect(qt, xt))
    + CASE WHEN contains(lower(title), lower(trim(ask.text))) THEN 3 ELSE 0 END + CASE WHEN contains(lower(sec.text), lower(trim(ask.text))) THEN 2 ELSE 0 END AS score
  FROM ask, sec)"""


def _sections(spark, sf_dir):
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    title = F.split("text", "\n").getItem(0)
    return docs.select(F.col("doc_id").alias("section_id"), F.col("doc_id").alias("ord"), title.alias("title"), "text")


def _questions(spark, sf_dir):
    return v.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query(
    f"""WITH {_SCORES}
SELECT item_id AS question_id, r AS rank, doc_id AS section_id, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 5"""
)
def top_sections(spark, sf_dir):
    return retrieve.top_sections(_sections(spark, sf_dir), _questions(spark, sf_dir))


@query(
    f"""WITH {_SCORES}
SELECT item_id AS question_id, string_agg('[Section ' || r || '] title: ' || title || chr(10) || 'pages: 1-2' || chr(10) || 'text:' || chr(10) || left(text, 3000), chr(10) || chr(10) ORDER BY r) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc) JOIN sec USING (doc_id) WHERE r <= 5 GROUP BY 1"""
)
def answer_context(spark, sf_dir):
    sections = _sections(spark, sf_dir).withColumn("start_index", F.lit(1)).withColumn("end_index", F.lit(2))
    return retrieve.answer_context(retrieve.top_sections(sections, _questions(spark, sf_dir)), sections)


@query(
    """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id, label, list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS p FROM embeddings, q),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, vec_id) <= 50)
SELECT query_id, label::BIGINT AS node_id, count(*) AS n, round(sum(p) / sqrt(count(*) + 1), 6) AS value FROM b GROUP BY ALL"""
)
def node_values(spark, sf_dir):
    chunks = v.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("node_id"), "embedding")
    out = retrieve.node_values(chunks, chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"))
    return out.withColumn("value", F.round("value", 6))


# Evaluation cases: a document's answer, with reads that depend on its id.
_CASES = f"""{v.ANSWERS}, cases AS MATERIALIZED (
  SELECT doc_id AS id, answer, CASE WHEN doc_id % 6 = 0 THEN [] ELSE ['LET ME', 'and more', 'zzz'] END AS kp,
    CASE WHEN doc_id % 10 = 0 THEN [] ELSE [1 + doc_id % 4, 3, 3] END::BIGINT[] AS expected,
    list_transform(regexp_extract_all(answer, '{tx.CITE.replace("'", "''")}', 2), lambda x: x::BIGINT) AS cited,
    list_distinct(range(1, 2 + doc_id % 6)) AS retrieved, range(1, 2 + doc_id % 6) || CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [] END AS requested,
    (doc_id % 4)::BIGINT AS turns FROM answers_v),
share AS MATERIALIZED (
  SELECT id, len(list_filter(kp, lambda k: contains(lower(answer), lower(k))))::BIGINT AS key_points_covered, len(kp)::BIGINT AS key_points_total, len(cited)::BIGINT AS citation_count,
    CASE WHEN len(cited) = 0 THEN 1.0 ELSE len(list_filter(cited, lambda p: list_contains(retrieved, p))) / len(cited) END::DOUBLE AS citation_valid_rate,
    CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_filter(expected, lambda p: list_contains(retrieved, p))) / len(expected) END::DOUBLE AS pages_hit_rate,
    CASE WHEN len(requested) = 0 THEN 0.0 ELSE 1 - len(list_distinct(requested)) / len(requested) END::DOUBLE AS duplicate_read_rate,
    CASE WHEN turns <= 0 THEN 0.0 ELSE len(list_distinct(requested)) / turns END::DOUBLE AS avg_pages_per_turn, turns AS total_turns FROM cases)"""


def _scored(spark, sf_dir):
    k = F.col("doc_id")
    read = F.sequence(F.lit(1), (1 + k % 6).cast("int"))
    rows = v.answers(spark, sf_dir).select(
        k.alias("id"),
        "answer",
        F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("LET ME"), F.lit("and more"), F.lit("zzz"))).alias("key_points"),
        F.when(k % 10 == 0, F.array().cast("array<int>")).otherwise(F.array((1 + k % 4).cast("int"), F.lit(3), F.lit(3))).alias("expected_pages"),
        F.transform(tx.citations(F.col("answer")), lambda c: c["page"]).alias("cited_pages"),
        read.alias("pages_retrieved"),
        F.when(k % 2 == 0, F.concat(read, F.array(F.lit(1), F.lit(2)))).otherwise(read).alias("all_pages_requested"),
        (k % 4).alias("total_turns"),
    )
    return ev.scored(rows)


def _rounded(df, names):
    for c in names:
        df = df.withColumn(c, F.round(c, 6))
    return df


_RATES = ["citation_valid_rate", "pages_hit_rate", "duplicate_read_rate", "avg_pages_per_turn"]


@query(f"WITH {_CASES} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _RATES)}) FROM share")
def evaluation_cases(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir), _RATES)


@query(
    f"""WITH {_CASES}
SELECT count(*) AS cases, round(avg(CASE WHEN key_points_total > 0 THEN key_points_covered / key_points_total ELSE 1.0 END) * 100, 6) AS key_points_coverage,
  round(avg(citation_valid_rate) * 100, 6) AS citation_validity, round(avg(pages_hit_rate) * 100, 6) AS page_hit_rate,
  round(avg(duplicate_read_rate) * 100, 6) AS duplicate_read_rate, round(avg(avg_pages_per_turn), 6) AS pages_per_turn, round(avg(total_turns), 6) AS turns FROM share"""
)
def evaluation_summary(spark, sf_dir):
    out = ev.summary(_scored(spark, sf_dir))
    return _rounded(out, [c for c in out.columns if c != "cases"])


@query(
    f"""
WITH {v.ANSWERS}, c AS (SELECT doc_id, unnest(regexp_extract_all(answer, '{tx.CITE.replace("'", "''")}', 2))::BIGINT AS page FROM answers_v)
SELECT doc_id AS answer_id, page FROM c WHERE page > 1 + doc_id % 6"""
)
def unretrieved_citations(spark, sf_dir):
    rows = v.answers(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), F.explode(tx.citations(F.col("answer"))).alias("c"))
    cited = rows.select("answer_id", F.col("c.page").cast("long").alias("page"))
    read = v.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("answer_id"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("doc_id") % 6)).alias("page")
    )
    return ev.unretrieved(cited, read)


# Reading state from events: views read pages, clicks see parts of the structure.
_ROUTED = f"""{v.CALLS}, routed_v AS MATERIALIZED (
  SELECT *, CASE tool WHEN 'view' THEN 'content' WHEN 'click' THEN 'structure' END AS kind, (seq + 4) // 5 AS turn FROM calls_v WHERE tool IN ('view', 'click'))"""


def _routed(spark, sf_dir):
    calls = state.routed(v.tool_calls(spark, sf_dir), {"view": "content", "click": "structure"})
    return calls.withColumn("turn", F.floor((F.col("seq") + 4) / 5))


@query(f"WITH {_ROUTED} SELECT session_id, seq, tool, page, kind, turn FROM routed_v")
def routed_tool_calls(spark, sf_dir):
    return _routed(spark, sf_dir)


@query(
    f"""
WITH {_ROUTED}, f AS (SELECT session_id, page, min(seq) AS seq, count(*) AS n FROM routed_v WHERE kind = 'content' GROUP BY ALL),
i AS (SELECT session_id, page, page - row_number() OVER (PARTITION BY session_id ORDER BY page) AS run FROM f),
r AS (SELECT session_id, min(page) AS a, max(page) AS b FROM i GROUP BY session_id, run),
t AS (SELECT session_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1)
SELECT session_id, string_agg(page::VARCHAR, ',' ORDER BY seq) AS read_pages, sum(n)::BIGINT AS total_reads, any_value(ranges) AS ranges, count(*) AS n_pages
FROM f JOIN t USING (session_id) GROUP BY session_id"""
)
def read_pages(spark, sf_dir):
    out = state.read_pages(_routed(spark, sf_dir).filter("kind = 'content'"))
    return out.withColumn("read_pages", F.array_join(F.col("read_pages").cast("array<string>"), ","))


@query(
    f"""
WITH {_ROUTED}
SELECT session_id, turn, coalesce(string_agg(page::VARCHAR, ',' ORDER BY seq) FILTER (WHERE kind = 'structure'), '') AS parts_seen,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY seq) FILTER (WHERE kind = 'content'), '') AS pages_read FROM routed_v GROUP BY ALL"""
)
def retrieval_traces(spark, sf_dir):
    return state.traces(_routed(spark, sf_dir))


_SESSION_NODES = """sn AS (SELECT session_id, 'n' || k AS node_id, k * 12 AS start_index, k * 12 + 15 AS end_index FROM (SELECT DISTINCT session_id FROM calls_v), (SELECT unnest(range(0, 8)) AS k))"""


def _session_nodes(spark, sf_dir):
    sessions = v.tool_calls(spark, sf_dir).select("session_id").distinct()
    rows = sessions.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    return rows.select(
        "session_id", F.concat(F.lit("n"), F.col("k").cast("string")).alias("node_id"), (F.col("k") * 12).alias("start_index"), (F.col("k") * 12 + 15).alias("end_index")
    )


_STATUS = f"""{_ROUTED}, {_SESSION_NODES}, st AS (
  SELECT session_id, node_id, start_index, end_index, count(DISTINCT seq) AS read_count FROM sn LEFT JOIN (SELECT session_id AS s, seq, page FROM routed_v WHERE kind = 'content')
    ON s = session_id AND page BETWEEN start_index AND end_index GROUP BY ALL)"""


@query(
    f"WITH {_STATUS} SELECT session_id, node_id, start_index, end_index, read_count, "
    "['discovered', 'reading', 'read_complete'][least(read_count, 2) + 1] AS status FROM st"
)
def node_read_status(spark, sf_dir):
    return state.read_status(_session_nodes(spark, sf_dir), _routed(spark, sf_dir).filter("kind = 'content'"))


_NODE_EVENTS = """ne AS MATERIALIZED (
  SELECT user_id % 7 AS doc, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'k' || (event_id % 23) END AS node_id, event_id AS seq, 't' || (event_id % 3) AS title,
    event_id % 10 AS start_index, event_id % 10 + 4 AS end_index, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 's' || event_id END AS summary, event_id % 3 = 1 AS is_skeleton,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE 'a/b' END AS parent_path, 'turn_' || (event_id // 9) AS turn_id FROM events),
nk AS MATERIALIZED (SELECT * REPLACE (coalesce(node_id, 'tmp_' || left(sha1(doc || '|' || title || '|' || start_index || '|' || end_index || '|' || parent_path), 12)) AS node_id), node_id IS NULL AS prov FROM ne),
nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc, node_id ORDER BY seq) AS r FROM nk)"""


@query(
    f"""
WITH {_NODE_EVENTS}
SELECT doc, node_id, arg_max(title, seq) AS title, arg_max(start_index, seq) AS start_index, arg_max(end_index, seq) AS end_index, arg_max(parent_path, seq) AS parent_path,
  arg_max(is_skeleton, seq) AS is_skeleton_latest, arg_min(turn_id, seq) AS first_seen_turn_id, arg_max(turn_id, seq) AS last_seen_turn_id, arg_min(prov, seq) AS is_provisional_id,
  nullif(arg_max(coalesce(summary, '-'), seq) FILTER (WHERE NOT is_skeleton OR r = 1), '-') AS summary
FROM nn GROUP BY doc, node_id"""
)
def node_upserts(spark, sf_dir):
    e = F.col("event_id")
    rows = v.read(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("doc"),
        F.when(e % 5 != 0, F.concat(F.lit("k"), (e % 23).cast("string"))).alias("node_id"),
        e.alias("seq"),
        F.concat(F.lit("t"), (e % 3).cast("string")).alias("title"),
        (e % 10).alias("start_index"),
        (e % 10 + 4).alias("end_index"),
        F.when(e % 4 != 0, F.concat(F.lit("s"), e.cast("string"))).alias("summary"),
        (e % 3 == 1).alias("is_skeleton"),
        F.when(e % 2 == 0, F.lit("")).otherwise(F.lit("a/b")).alias("parent_path"),
        F.concat(F.lit("turn_"), F.floor(e / 9).cast("string")).alias("turn_id"),
    )
    return state.upserted(rows)


@query(
    """
WITH s AS (SELECT s_suppkey, s_name FROM supplier), l AS (
  SELECT coalesce(max(try_cast(nullif(regexp_extract(n, '^turn_(\\d+)$', 1), '') AS BIGINT)), 0) AS last FROM (SELECT 'turn_' || lpad((s_suppkey * 3)::VARCHAR, 4, '0') AS n FROM s))
SELECT s_suppkey, 'turn_' || lpad((row_number() OVER (ORDER BY s_suppkey) + last)::VARCHAR, 4, '0') AS new_id FROM s, l"""
)
def sequence_numbers(spark, sf_dir):
    rows = v.read(spark, sf_dir, "supplier").select("s_suppkey")
    last = state.last_number(rows.select(tx.numbered("turn_", F.col("s_suppkey") * 3, 4).alias("name")), "name", "turn")
    return state.numbered_from(rows, last, ["s_suppkey"], "turn", 4)


# Registries: all nations are registered statically and again at run time, some of either without folders or pages.
_REGISTRY = """
st AS (SELECT n_name AS doc_name, 'c/' || n_name AS chunks_dir, 'd/' || n_name AS content_dir, (n_nationkey % 4)::VARCHAR AS total_pages FROM nation),
rt AS (SELECT n_name AS doc_name, CASE WHEN n_nationkey % 6 = 0 THEN ' ' ELSE 'r/' || n_name END AS chunks_dir, 'd/' || n_name AS content_dir, CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE n_nationkey::VARCHAR END AS total_pages FROM nation),
ok AS (SELECT *, 1 AS o FROM rt WHERE trim(chunks_dir) <> '' AND trim(content_dir) <> '' AND try_cast(total_pages AS INTEGER) > 0 UNION ALL SELECT *, 2 FROM st WHERE try_cast(total_pages AS INTEGER) > 0)"""


def _registry(spark, sf_dir):
    n, key = v.read(spark, sf_dir, "nation"), F.col("n_nationkey")
    path = lambda p: F.concat(F.lit(p), "n_name")
    static = n.select(
        F.col("n_name").alias("doc_name"), path("c/").alias("chunks_dir"), path("d/").alias("content_dir"), (key % 4).cast("string").alias("total_pages")
    )
    runtime = n.select(
        F.col("n_name").alias("doc_name"),
        F.when(key % 6 == 0, F.lit(" ")).otherwise(path("r/")).alias("chunks_dir"),
        path("d/").alias("content_dir"),
        F.when(key % 5 == 0, F.lit("x")).otherwise(key.cast("string")).alias("total_pages"),
    )
    return state.merged(state.usable(static), state.usable(runtime), "doc_name")


@query(
    f"WITH {_REGISTRY} SELECT doc_name, chunks_dir, content_dir, total_pages::BIGINT AS total_pages "
    "FROM (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY o) AS r FROM ok) WHERE r = 1"
)
def document_registry(spark, sf_dir):
    return _registry(spark, sf_dir).withColumn("total_pages", F.col("total_pages").cast("long"))


@query(
    f"WITH {_REGISTRY} SELECT doc_name, doc_name IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0) "
    "AND doc_name IN (SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0) AS processed "
    "FROM (SELECT DISTINCT doc_name FROM ok)"
)
def processed_documents(spark, sf_dir):
    n = v.read(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_name"), "n_nationkey")
    rich = n.join(v.read(spark, sf_dir, "supplier").filter("s_acctbal > 0"), F.col("s_nationkey") == F.col("n_nationkey"))
    poor = n.join(v.read(spark, sf_dir, "customer").filter("c_acctbal < 0"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = state.processed(_registry(spark, sf_dir), rich, poor, n)
    return out.select("doc_name", "processed")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_registrations(spark, sf_dir):
    rows = v.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return state.last_wins(rows, ["user_id"], "event_id")


@query(
    """
WITH t AS (SELECT doc_id, 'quality ' || quality AS summary FROM labels), m AS (
  SELECT doc_id, lang AS summary, 2 AS seq FROM documents UNION ALL SELECT doc_id, source, 1 FROM documents)
SELECT * FROM t UNION ALL SELECT doc_id, arg_min(summary, seq) FROM m WHERE doc_id NOT IN (SELECT doc_id FROM t) GROUP BY doc_id"""
)
def first_page_summaries(spark, sf_dir):
    table = v.read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"))
    docs = v.read(spark, sf_dir, "documents")
    more = docs.select("doc_id", F.col("lang").alias("summary"), F.lit(2).alias("seq")).unionAll(docs.select("doc_id", "source", F.lit(1)))
    return state.first_wins(table, more, ["doc_id"], "seq")


# Session logs: a message of a user is a session; some have no conversation or time.
_SESSIONS = """sl AS MATERIALIZED (
  SELECT conv_id || '_' || lpad(turn::VARCHAR, 3, '0') AS id, CASE WHEN turn % 5 = 0 THEN '' ELSE '2024' || lpad((1000 - turn)::VARCHAR, 4, '0') END AS timestamp,
    CASE WHEN conv_id % 4 = 0 THEN '  ' ELSE ' c' || conv_id % 40 || ' ' END AS context_session_id, text AS query, 'd' || conv_id % 3 AS doc_name, CASE WHEN turn % 3 = 0 THEN 'T' || turn ELSE ' ' END AS title,
    CASE WHEN turn % 2 = 0 THEN turn END AS total_turns FROM conversations WHERE role = 'user'),
sc AS MATERIALIZED (SELECT * REPLACE (coalesce(nullif(timestamp, ''), id) AS timestamp), coalesce(nullif(trim(context_session_id), ''), id) AS conversation_id FROM sl)"""


def _sessions(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    return v.read(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat(conv.cast("string"), F.lit("_"), F.lpad(turn.cast("string"), 3, "0")).alias("id"),
        F.when(turn % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("2024"), F.lpad((1000 - turn).cast("string"), 4, "0"))).alias("timestamp"),
        F.when(conv % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" c"), (conv % 40).cast("string"), F.lit(" "))).alias("context_session_id"),
        F.col("text").alias("query"),
        F.concat(F.lit("d"), (conv % 3).cast("string")).alias("doc_name"),
        F.when(turn % 3 == 0, F.concat(F.lit("T"), turn.cast("string"))).otherwise(F.lit(" ")).alias("title"),
        F.when(turn % 2 == 0, turn).alias("total_turns"),
        F.lit(None).cast("string").alias("answer"),
    )


@query(
    f"""
WITH {_SESSIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, id) AS r FROM sc)
SELECT conversation_id, max(timestamp) AS timestamp, arg_max(coalesce(query, ''), r) AS query, arg_max(doc_name, r) AS doc_name, arg_max(coalesce(total_turns, 0), r) AS total_turns,
  coalesce(arg_max(trim(title), r) FILTER (WHERE trim(title) <> ''), '') AS title, count(*) AS entry_count, string_agg(id, ',' ORDER BY r) AS session_ids FROM o GROUP BY 1"""
)
def conversation_summaries(spark, sf_dir):
    return cv.summaries(_sessions(spark, sf_dir))


@query(
    f"""
WITH {_SESSIONS}
SELECT row_number() OVER (ORDER BY timestamp, id) AS seq, id, timestamp, doc_name, coalesce(query, '') AS query, title, '' AS answer, coalesce(total_turns, 0) AS total_turns
FROM sc WHERE conversation_id = 'c1'"""
)
def conversation_entries(spark, sf_dir):
    return cv.entries(_sessions(spark, sf_dir), "c1")


@query(f"WITH {_SESSIONS} SELECT id, conversation_id, CASE WHEN conversation_id = 'c1' THEN 'New' ELSE title END AS title FROM sc")
def renamed_conversation(spark, sf_dir):
    return cv.renamed(_sessions(spark, sf_dir), "c1", "New").select("id", "conversation_id", "title")


@query(f"WITH {_SESSIONS} SELECT conversation_id, count(*) AS n FROM sc WHERE conversation_id <> 'c1' GROUP BY 1")
def deleted_conversation(spark, sf_dir):
    return cv.without(_sessions(spark, sf_dir), "c1").groupBy("conversation_id").agg(F.count("*").alias("n"))


@query(
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations)
SELECT conv_id AS conversation_id, turn AS seq, role, CASE WHEN length(t) > 4000 THEN left(t, 4000) || chr(10) || '...[history truncated]' ELSE t END AS content
FROM r WHERE r <= 8 AND role IN ('user', 'assistant') AND t <> ''"""
)
def message_history(spark, sf_dir):
    rows = v.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return cv.history(rows)


@query(
    """
SELECT conv_id AS conversation_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system, count(*) FILTER (WHERE role <> 'system') AS others
FROM conversations GROUP BY 1"""
)
def system_messages(spark, sf_dir):
    rows = v.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return cv.system_text(rows)


@query(
    r"""
SELECT doc_id, CASE WHEN length(text) < 2 THEN '' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN left(text, length(text) // 2)
  ELSE left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), length(text) // 2) END AS summary
FROM documents WHERE text IS NOT NULL"""
)
def prefix_summaries(spark, sf_dir):
    # the given texts have no blank lines, so that each is one paragraph
    docs = v.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", parts.prefix_summary(F.col("text")).alias("summary"))


@query(
    f"""
WITH RECURSIVE {v.PAGES}, p AS MATERIALIZED (
  SELECT doc_id AS doc, page_num AS page, row_number() OVER w - 1 AS i, n, coalesce(lag(n) OVER w, 0) AS prior
  FROM (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))::BIGINT AS n FROM pages_v) WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
a AS MATERIALIZED (SELECT doc, CASE WHEN sum(n) <= 400 THEN 1e18 ELSE ceil((sum(n) / ceil(sum(n) / 400) + 400) / 2) END AS aim FROM p GROUP BY doc),
f(doc, i, b, held, g) AS (
  SELECT doc, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM a
  UNION ALL
  SELECT f.doc, f.i + 1, CASE WHEN held + n > aim THEN greatest(f.i - 1, 0) ELSE b END, CASE WHEN held + n > aim THEN prior + n ELSE held + n END, g + (held + n > aim)::BIGINT
  FROM f JOIN p ON p.doc = f.doc AND p.i = f.i JOIN a ON a.doc = f.doc),
g AS (SELECT doc, g, max(b) AS b, max(i) AS e FROM f GROUP BY doc, g)
SELECT g.doc, g AS group_no, CASE WHEN e > b THEN x.page END AS first_page, CASE WHEN e > b THEN y.page END AS last_page, e - b AS n_pages
FROM g LEFT JOIN p x ON x.doc = g.doc AND x.i = b LEFT JOIN p y ON y.doc = g.doc AND y.i = e - 1"""
)
def page_groups(spark, sf_dir):
    pages = v.doc_pages(spark, sf_dir).select(
        F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), tx.token_count(F.col("text")).alias("n_tokens")
    )
    return parts.page_groups(pages, most=400)


def _part_nodes(spark, sf_dir, whole: bool = False):
    sets = tree.nested_sets(tq._walked(spark, sf_dir, whole))
    return sets.select(
        "doc",
        (F.col("first") + 1).alias("ord"),
        F.col("ord").cast("string").alias("node_id"),
        F.col("path").cast("array<string>").alias("path"),
        "title",
        F.lit("s").alias("summary"),
        F.col("physical_index").alias("start_index"),
        F.lit(None).cast("long").alias("end_index"),
    )


# A node's size as JSON, whole and as a skeleton; the fold goes by the walk's order and remembers the nodes of the open part.
_SIZES = """length('{"node_id": "' || ord || '", "title": "' || title || '", "summary": "s", "is_skeleton": false, "start_index": ' || physical_index || '}') AS size,
    length('{"node_id": "' || ord || '", "title": "' || title || '", "is_skeleton": true, "start_index": ' || physical_index || '}') AS bare"""
_PARTS = f"""{tq._WALK}, sized_v AS MATERIALIZED (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY path) AS i, ord, path,
    {_SIZES} FROM walk_v),
above_v AS MATERIALIZED (
  SELECT n.doc, n.i, n.ord, n.size, coalesce(list({{'o': a.ord, 'b': a.bare}} ORDER BY len(a.path)) FILTER (WHERE a.ord IS NOT NULL), []) AS above
  FROM sized_v n LEFT JOIN sized_v a ON a.doc = n.doc AND list_contains(n.path, a.ord) AND a.ord <> n.ord GROUP BY ALL),
fold_v AS MATERIALIZED (
  WITH RECURSIVE f(doc, i, ord, part, held, there, missing) AS (
    SELECT DISTINCT doc, 0::BIGINT, 0::BIGINT, 1::BIGINT, 0::HUGEINT, []::BIGINT[], []::BIGINT[] FROM sized_v
    UNION ALL
    SELECT doc, i, ord, part, held + size + coalesce(list_sum(list_transform(more, lambda x: x.b)), 0), list_concat(there, list_transform(more, lambda x: x.o), [ord]), list_transform(more, lambda x: x.o)
    FROM (SELECT *, list_filter(above, lambda x: NOT list_contains(there, x.o)) AS more FROM (
      SELECT n.doc, n.i, n.ord, n.size, n.above, part + (len(there) > 0 AND held + size > 2000)::BIGINT AS part, CASE WHEN len(there) > 0 AND held + size > 2000 THEN 0 ELSE held END AS held,
        CASE WHEN len(there) > 0 AND held + size > 2000 THEN [] ELSE there END AS there
      FROM f JOIN above_v n ON n.doc = f.doc AND n.i = f.i + 1)))
  SELECT * FROM f WHERE i > 0),
parts_v AS MATERIALIZED (
  SELECT o.doc, part, row_number() OVER (PARTITION BY o.doc ORDER BY o.i, k) AS place, o.ord::VARCHAR AS node_id, array_to_string(path[:-2], '/') AS parent_path, is_skeleton
  FROM (SELECT doc, i, part, unnest(missing) AS ord, unnest(range(len(missing))) AS k, true AS is_skeleton FROM fold_v UNION ALL SELECT doc, i, part, ord, 1000000, false FROM fold_v) o
  JOIN sized_v s ON s.ord = o.ord),
envelopes_v AS MATERIALIZED (
  SELECT p.doc, part, count(*) AS n_nodes, total AS total_parts FROM parts_v p JOIN (SELECT doc, max(part) AS total FROM parts_v GROUP BY doc) t ON t.doc = p.doc GROUP BY ALL)"""


# The same over all headings as one document.
_PARTS_WHOLE = f"""{tq._WALK_WHOLE}, sized_v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY path) AS i, ord, path,
    {_SIZES} FROM walk_v),
above_v AS MATERIALIZED (
  SELECT n.i, n.ord, n.size, coalesce(list({{'o': a.ord, 'b': a.bare}} ORDER BY len(a.path)) FILTER (WHERE a.ord IS NOT NULL), []) AS above
  FROM sized_v n LEFT JOIN sized_v a ON list_contains(n.path, a.ord) AND a.ord <> n.ord GROUP BY ALL),
fold_v AS MATERIALIZED (
  WITH RECURSIVE f(i, ord, part, held, there, missing) AS (
    SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT, 0::HUGEINT, []::BIGINT[], []::BIGINT[]
    UNION ALL
    SELECT i, ord, part, held + size + coalesce(list_sum(list_transform(more, lambda x: x.b)), 0), list_concat(there, list_transform(more, lambda x: x.o), [ord]), list_transform(more, lambda x: x.o)
    FROM (SELECT *, list_filter(above, lambda x: NOT list_contains(there, x.o)) AS more FROM (
      SELECT n.i, n.ord, n.size, n.above, part + (len(there) > 0 AND held + size > 2000)::BIGINT AS part, CASE WHEN len(there) > 0 AND held + size > 2000 THEN 0 ELSE held END AS held,
        CASE WHEN len(there) > 0 AND held + size > 2000 THEN [] ELSE there END AS there
      FROM f JOIN above_v n ON n.i = f.i + 1)))
  SELECT * FROM f WHERE i > 0),
parts_v AS MATERIALIZED (
  SELECT 1::BIGINT AS doc, part, row_number() OVER (ORDER BY o.i, k) AS place, o.ord::VARCHAR AS node_id, array_to_string(path[:-2], '/') AS parent_path, is_skeleton
  FROM (SELECT i, part, unnest(missing) AS ord, unnest(range(len(missing))) AS k, true AS is_skeleton FROM fold_v UNION ALL SELECT i, part, ord, 1000000, false FROM fold_v) o
  JOIN sized_v s ON s.ord = o.ord),
envelopes_v AS MATERIALIZED (
  SELECT doc, part, count(*) AS n_nodes, (SELECT max(part) FROM parts_v) AS total_parts FROM parts_v GROUP BY doc, part)"""


@query(f"WITH {_PARTS_WHOLE} SELECT * FROM parts_v")
def tree_parts(spark, sf_dir):
    return parts.tree_parts(_part_nodes(spark, sf_dir, whole=True), most=2000)


@query(
    f"""
WITH {_PARTS}
SELECT doc, part, total_parts, part < total_parts AS has_more, n_nodes, 'part_' || lpad(part::VARCHAR, 4, '0') || '.json' AS file,
  concat_ws('; ', CASE WHEN part < total_parts THEN 'Request next part with part: ' || (part + 1) END, CASE WHEN part < total_parts THEN 'Jump to last part with part: ' || total_parts END,
    CASE WHEN part > 1 THEN 'Request previous part with part: ' || (part - 1) END, 'Proceed to get_page_content() for specific sections') AS options,
  'Showing part ' || part || ' of ' || total_parts || '.' AS summary FROM envelopes_v"""
)
def part_envelopes(spark, sf_dir):
    return parts.part_envelopes(parts.tree_parts(_part_nodes(spark, sf_dir), most=2000))


@query(
    f"""
WITH {_PARTS}
SELECT r.doc, r.part, n_nodes, e.part < total_parts AS has_more,
  CASE WHEN t.total IS NULL THEN 'unknown document' WHEN e.part IS NULL THEN 'Part ' || r.part || ' out of range' END AS error,
  CASE WHEN t.total IS NOT NULL AND e.part IS NULL THEN '1-' || t.total END AS valid_range
FROM (SELECT r_regionkey::BIGINT + 1 + 5 * (x // 4) AS doc, [1, 2, 0, 999, 1][x + 1]::BIGINT AS part FROM region, range(5) q(x)) r
  LEFT JOIN (SELECT doc, max(part) AS total FROM parts_v GROUP BY doc) t ON t.doc = r.doc LEFT JOIN envelopes_v e ON e.doc = r.doc AND e.part = r.part"""
)
def part_requests(spark, sf_dir):
    envelopes = parts.part_envelopes(parts.tree_parts(_part_nodes(spark, sf_dir), most=2000))
    own = F.posexplode(F.array(*(F.lit(n).cast("long") for n in (1, 2, 0, 999, 1)))).alias("x", "part")
    asked = v.read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("r"), own)
    asked = asked.select((F.col("r") + F.when(F.col("x") == 4, 5).otherwise(0)).alias("doc"), "part")  # the last ones ask for documents that there are not
    return parts.part_request(envelopes, asked)


@query(
    f"""
WITH {tq._TOC}
SELECT ord, length('{{"node_id": "' || ord || '", "title": "' || title || '", "is_skeleton": false' || CASE WHEN ord % 3 <> 0 THEN ', "start_index": ' || physical_index ELSE '' END || '}}')::BIGINT AS size FROM toc_v"""
)
def payload_sizes(spark, sf_dir):
    start = F.when(F.col("ord") % 3 != 0, F.col("physical_index"))
    payload = F.struct(F.col("ord").cast("string").alias("node_id"), "title", F.lit(False).alias("is_skeleton"), start.alias("start_index"))
    fields = F.lit(3) + start.isNotNull().cast("int")
    return _toc(spark, sf_dir).select("ord", parts.payload_size(payload, fields).cast("long").alias("size"))


@query(
    f"""
WITH {_STATUS}, f AS (SELECT session_id, page FROM routed_v WHERE kind = 'content' GROUP BY ALL),
i AS (SELECT session_id, page, page - row_number() OVER (PARTITION BY session_id ORDER BY page) AS run FROM f),
r AS (SELECT session_id, min(page) AS a, max(page) AS b FROM i GROUP BY session_id, run),
t AS (SELECT session_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1),
d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY read_count = 0 DESC, start_index DESC) AS nth_to_go FROM st),
c AS (SELECT session_id, gone, count(*) FILTER (WHERE nth_to_go > gone) AS n_nodes,
    string_agg('- ' || node_id || ' (pp.' || start_index || '-' || end_index || '): read', chr(10) ORDER BY start_index) FILTER (WHERE nth_to_go > gone AND read_count > 0) AS were_read,
    string_agg('- ' || node_id || ' (pp.' || start_index || '-' || end_index || '): read', chr(10) ORDER BY start_index) FILTER (WHERE nth_to_go > gone AND read_count = 0) AS were_found
  FROM d, (SELECT unnest(range(0, 9)) AS gone) GROUP BY ALL),
x AS (SELECT session_id, gone, n_nodes, concat_ws(chr(10) || chr(10), '{parts.READ_HEADING}' || chr(10) || chr(10) || were_read,
    '{parts.FOUND_HEADING}' || chr(10) || chr(10) || replace(were_found, ': read', ''), '{parts.PAGES_LABEL}' || ranges) AS told FROM c LEFT JOIN t USING (session_id)),
y AS (SELECT * FROM x WHERE length(told) <= 150 OR n_nodes = 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY gone) = 1)
SELECT session_id, n_nodes, length(told) AS total_chars, CASE WHEN length(told) <= 150 THEN told ELSE '' END AS summary FROM y"""
)
def context_summaries(spark, sf_dir):
    calls = _routed(spark, sf_dir)
    nodes = state.read_status(_session_nodes(spark, sf_dir), calls.filter("kind = 'content'"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("start_index", "end_index", "node_id"))
    nodes = nodes.select("session_id", place.alias("place"), F.col("node_id").alias("title"), F.lit("read").alias("summary"), "start_index", "end_index", "status")
    pages = state.read_pages(calls.filter("kind = 'content'"))
    seen = calls.filter("kind = 'structure'").groupBy("session_id").agg(F.array_sort(F.collect_set("page")).alias("visited_parts"))
    known = pages.select("session_id", "ranges").join(seen, "session_id", "left")
    return parts.context_summaries(nodes, known, budget=150)
