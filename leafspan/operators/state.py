"""Reading state of sessions, as folds over ordered events.

Events carry an explicit ``seq``; every fold is a keyed aggregation with a
deterministic order, so that the same functions serve batches and the tables
that a stream appends to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as tx
from leafspan.functions.pages import ranges_text
from leafspan.sources.files import saved

STATUS = ["discovered", "reading", "read_complete"]


def with_node_ids(events: DataFrame) -> DataFrame:
    """Node events whose missing ids are replaced by provisional ones made of their place."""
    missing = F.coalesce(F.col("node_id"), F.lit("")) == ""
    text = lambda c: F.col(c).cast("string")
    made = tx.provisional_id(text("doc"), F.col("title"), text("start_index"), text("end_index"), F.col("parent_path"))
    return events.withColumn("is_provisional", missing).withColumn("node_id", F.when(missing, made).otherwise(F.col("node_id")))


def upserted(events: DataFrame) -> DataFrame:
    """Node states from events (doc, node_id, seq, title, start_index, end_index, summary, is_skeleton, parent_path, turn_id).

    The last event places a node. Its summary comes from its first event or a
    later full one (also if that one's is null), never from a later skeleton.
    """
    key = ["doc", "node_id"]
    first = Window.partitionBy(*key).orderBy("seq")
    numbered = with_node_ids(events).withColumn("_n", F.row_number().over(first))
    counts = ~F.col("is_skeleton") | (F.col("_n") == 1)
    last = lambda c: F.max_by(c, "seq").alias(c)
    return (
        numbered.groupBy(*key)
        .agg(
            *(last(c) for c in ("title", "start_index", "end_index", "parent_path")),
            F.max_by(F.struct("summary"), F.when(counts, F.col("seq"))).alias("s"),
            F.max_by("is_skeleton", "seq").alias("is_skeleton_latest"),
            F.min_by("turn_id", "seq").alias("first_seen_turn_id"),
            F.max_by("turn_id", "seq").alias("last_seen_turn_id"),
            F.min_by("is_provisional", "seq").alias("is_provisional_id"),
        )
        .withColumn("summary", F.col("s.summary"))
        .drop("s")
    )


def read_status(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """``nodes`` (session_id, node_id, start_index, end_index) with read_count and status.

    Each call (session_id, seq, page per row) advances every node that covers one
    of its pages by one, however many of its pages those are.
    """
    listed = nodes.filter("start_index <= end_index").select(
        "session_id", "node_id", F.explode(F.sequence("start_index", "end_index")).alias("page")
    )
    hits = listed.join(calls.select("session_id", "seq", "page"), ["session_id", "page"])
    counts = hits.groupBy("session_id", "node_id").agg(F.countDistinct("seq").alias("_n"))
    count = F.coalesce("_n", F.lit(0)).cast("long")
    status = F.get(F.array(*map(F.lit, STATUS)), F.least(count, F.lit(2)).cast("int"))
    return nodes.join(counts, ["session_id", "node_id"], "left").withColumn("read_count", count).withColumn("status", status).drop("_n")


def read_pages(calls: DataFrame) -> DataFrame:
    """Per session: pages in the order they were first read, all reads, and the pages as ranges."""
    first = calls.groupBy("session_id", "page").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    grouped = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "page"))).alias("p"), F.sum("n").alias("total_reads"))
    pages = F.col("p.page")
    return grouped.select(
        "session_id", pages.alias("read_pages"), "total_reads", ranges_text(pages).alias("ranges"), F.size(pages).cast("long").alias("n_pages")
    )


def routed(calls: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Tool calls with the kind of state update that their tool stands for; calls of unknown tools are left out."""
    kind = F.lit(None).cast("string")
    for tool, name in routes.items():
        kind = F.when(F.col("tool") == tool, F.lit(name)).otherwise(kind)
    return calls.withColumn("kind", kind).filter("kind IS NOT NULL")


def traces(calls: DataFrame) -> DataFrame:
    """(session_id, turn, parts_seen, pages_read): what each turn's calls saw, in order and with repeats."""
    seen = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("seq", "page"))))
    grouped = calls.groupBy("session_id", "turn").agg(seen("structure").alias("s"), seen("content").alias("c"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x["page"].cast("string")), ",")
    return grouped.select("session_id", "turn", join("s").alias("parts_seen"), join("c").alias("pages_read"))


def last_number(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row (last): the largest number among names like prefix_0007; 0 if there are none."""
    number = F.regexp_extract(column, f"^{prefix}_(\\d+)$", 1).try_cast("long")
    return names.agg(F.coalesce(F.max(number), F.lit(0)).cast("long").alias("last"))


def numbered_from(rows: DataFrame, last: DataFrame, order: list[str], prefix: str, width: int) -> DataFrame:
    """``rows`` with ids that go on after the last number in use, in the order of some columns.

    Rows are dealt by ranges of these columns and numbered within each, after those of the ranges before.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = saved(ranged, "numbered")
    part, start = F.shiftright("_at", 33), last.first()["last"] + 1
    before = []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per range
        before += [F.lit(r["part"]).cast("long"), F.lit(start).cast("long")]
        start += r["count"]
    first = F.element_at(F.create_map(*before), part) if before else F.lit(0).cast("long")
    n = first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("new_id", tx.numbered(f"{prefix}_", n, width)).drop("_at")


def first_wins(table: DataFrame, more: DataFrame, key: list[str], order: str) -> DataFrame:
    """``table`` and those rows of ``more`` whose key it lacks; of several with a key the first by ``order``."""
    one = Window.partitionBy(*key).orderBy(order)
    new = more.join(table, key, "left_anti").withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r")
    return table.unionByName(new.select(*table.columns))


def last_wins(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    names = [c for c in events.columns if c not in key]
    rows = events.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_r"))
    return rows.select(*key, "_r.*").select(*events.columns)


def merged(static: DataFrame, runtime: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key; where both have one, the runtime's."""
    return runtime.unionByName(static.join(runtime.select(key), key, "left_anti"))


def usable(entries: DataFrame) -> DataFrame:
    """Registry entries with folders and a positive whole number of pages."""
    pages = F.col("total_pages").try_cast("int")
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return entries.filter(filled("chunks_dir") & filled("content_dir") & (pages > 0)).withColumn("total_pages", pages)


def processed(registry: DataFrame, manifests: DataFrame, parts: DataFrame, contents: DataFrame) -> DataFrame:
    """``registry`` with processed: whether a document has a manifest, a part and a content window."""
    out = registry
    for name, table in (("_m", manifests), ("_p", parts), ("_c", contents)):
        out = out.join(table.select("doc_name").distinct().withColumn(name, F.lit(True)), "doc_name", "left")
    has = F.col("_m").isNotNull() & F.col("_p").isNotNull() & F.col("_c").isNotNull()
    return out.withColumn("processed", has).drop("_m", "_p", "_c")


def visited_parts(calls: DataFrame) -> DataFrame:
    """(session_id, visited_parts): the parts of each session's structure calls in the order they were first seen."""
    first = calls.groupBy("session_id", "page").agg(F.min("seq").alias("seq"))
    grouped = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "page"))).alias("p"))
    return grouped.select("session_id", F.col("p.page").alias("visited_parts"))


def by_relevance(nodes: DataFrame, query: str) -> DataFrame:
    """``nodes`` (session_id, node_id, title, summary, start_index, end_index) with place: those that share most words with the query first."""
    words = tx.retrieval_tokens(F.lit(query))
    own = tx.retrieval_tokens(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))))
    score = F.size(F.array_intersect(own, words))
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "start_index", "end_index", "node_id")
    return nodes.withColumn("score", score.cast("long")).withColumn("place", F.row_number().over(order).cast("long"))


def resolved(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, path, error): each name's path among candidates (file_name, path, priority), compared without case.

    The lowest priority wins; several paths of that priority are an error, and so is none.
    """
    key = F.lower(tx.document_name(F.col("name")))
    best = Window.partitionBy("k").orderBy("priority")
    ranked = candidates.withColumn("k", F.lower("file_name")).withColumn("r", F.rank().over(best)).filter("r = 1")
    found = ranked.groupBy("k").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n"))
    out = names.withColumn("k", key).join(found, "k", "left")
    error = F.when(F.col("n").isNull(), F.lit("not found")).when(F.col("n") > 1, F.lit("ambiguous"))
    return out.select("name", F.when(F.col("n") == 1, F.col("path")).alias("path"), error.alias("error"))


def with_initial(states: DataFrame, docs: DataFrame) -> DataFrame:
    """``states`` (doc_name, visited_parts, read_pages, total_reads) and an empty state for each of ``docs`` (doc_name) without one."""
    new = docs.select("doc_name").distinct().join(states, "doc_name", "left_anti")
    none = F.array().cast("array<long>")
    new = new.select("doc_name", none.alias("visited_parts"), none.alias("read_pages"), F.lit(0).cast("long").alias("total_reads"))
    return states.select("doc_name", "visited_parts", "read_pages", "total_reads").unionByName(new)


def topics(events: DataFrame) -> DataFrame:
    """(topic_id, related_turn_ids, related_node_ids, core_evidence_ids, open_gaps) after all of a topic's events.

    ``events`` has topic_id, seq, kind (create, turn, update), turn_id and the lists node_ids, evidence_ids, open_gaps.
    The last creation starts a topic anew; events before it, and of topics never created, count for nothing. Turns
    are appended, repeats included; an update replaces the three lists.
    """
    of = Window.partitionBy("topic_id")
    rows = events.withColumn("_made", F.max(F.when(F.col("kind") == "create", F.col("seq"))).over(of)).filter("seq >= _made")
    turns = F.array_sort(F.collect_list(F.when(F.col("kind") != "update", F.struct("seq", "turn_id"))))
    told = F.when(F.col("kind") != "turn", F.col("seq"))
    last = lambda c: F.max_by(F.coalesce(c, F.array().cast("array<string>")), told)
    return rows.groupBy("topic_id").agg(
        F.transform(turns, lambda x: x["turn_id"]).alias("related_turn_ids"),
        last("node_ids").alias("related_node_ids"),
        last("evidence_ids").alias("core_evidence_ids"),
        last("open_gaps").alias("open_gaps"),
    )


def cached_flags(pages: DataFrame) -> DataFrame:
    """Pages as they are, none of them from a cache."""
    return pages.withColumn("is_cached", F.lit(False))
