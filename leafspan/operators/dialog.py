"""Questions answered in turns by a model that may call tools, all questions of a table at once.

A model is a function from a question's messages to a reply: a text, or calls of
tools. Each turn asks it for all open questions by Arrow batches, runs all calls as one
plan, and writes the state, so that a lost executor costs no more than its turn's share.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as tx
from leafspan.functions.pages import page_list
from leafspan.operators import models
from leafspan.sources.files import saved

MOST_TURNS = 15
#: Fixed value: the answer of a question that is still open after the last turn.
OUT_OF_TURNS = "[达到最大轮次限制]"
SUMMARY = 200

MESSAGE = "struct<role: string, content: string, tool: string>"
_CALL = "struct<tool: string, argument: string>"
_TRACE = "struct<turn: long, tool: string, argument: string, summary: string>"
#: A model: messages (role, content, tool) to {"text": ..., "calls": [{"tool": ..., "argument": ...}]}.
Model = Callable[[list[dict]], dict]


def opening(question: Column, doc_name: Column, system: str, history: Column | None = None) -> Column:
    """The messages that a question starts with: the system's, what was said before, the user's."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("tool"))
    asked = F.concat(F.lit("Target document: "), doc_name, F.lit("\nUser question: "), tx.with_table_hint(question))
    before = F.array().cast(f"array<{MESSAGE}>") if history is None else history
    return F.concat(F.array(message("system", F.lit(system))), before, F.array(message("user", asked)))


def _replies(model: Model, limits: models.Limits):
    def ask(batches):
        for batch in batches:
            texts, calls, errors = [], [], []
            for reply, error in models.all_replied(model, batch.column("messages").to_pylist(), limits):
                reply = reply or {}
                texts.append(reply.get("text"))
                listed = ((c.get("tool"), c.get("argument")) for c in reply.get("calls") or [])
                calls.append([{"tool": t, "argument": a if a is None or isinstance(a, str) else json.dumps(a, ensure_ascii=False)} for t, a in listed])
                errors.append(error)
            kinds = pa.list_(pa.struct([("tool", pa.string()), ("argument", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(texts, pa.string()), pa.array(calls, kinds), pa.array(errors, pa.string())],
                names=["_key", "text", "calls", "error"],
            )

    return ask


def answered(questions: DataFrame, model: Model, run: Callable[[DataFrame], DataFrame], turns: int = MOST_TURNS, limits: models.Limits = models.Limits()) -> DataFrame:  # noqa: B008
    """(question_id, answer, answer_clean, citations, trace, pages_retrieved, all_pages_requested, total_turns, messages, error).

    ``questions`` has question_id (long, one row each) and messages (``opening``). ``run`` adds result, error
    (strings) and pages (array<long>: the pages that the call brought) to calls (question_id, turn, nth, tool, argument). A
    reply without calls is the answer; a model that fails ends its question with the error. Results
    go back as messages, clipped like page texts. Questions with the same messages are asked once. A turn
    only reads and writes questions that are still open.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    state = questions.select(
        F.col("question_id").cast("long").alias("question_id"),
        F.col("messages").cast(f"array<{MESSAGE}>").alias("messages"),
        none("long").alias("requested"),
        none(_TRACE).alias("trace"),
        F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("string").alias("error"),
        F.lit(0).cast("long").alias("turns"),
    )
    state, closed = saved(state, "dialog"), []
    for turn in range(1, turns + 1):
        if state.isEmpty():
            break
        keyed = state.select("question_id", models.key(F.col("messages")).alias("_key"), "messages")
        told = keyed.dropDuplicates(["_key"]).select("_key", "messages").mapInArrow(_replies(model, limits), f"_key string, text string, calls array<{_CALL}>, error string")
        asked = saved(keyed.select("question_id", "_key").join(saved(told, "replies"), "_key").drop("_key"), "replies")
        calls = asked.select("question_id", F.lit(turn).cast("long").alias("turn"), F.posexplode("calls").alias("nth", "c")).select("question_id", "turn", "nth", "c.*")
        done = run(calls)
        result = F.coalesce("result", F.concat(F.lit("Error: "), F.col("error")), F.lit(""))
        one = F.struct(
            "nth",
            F.struct(F.lit("tool").alias("role"), tx.clipped(result).alias("content"), F.col("tool").alias("tool")).alias("message"),
            F.struct("turn", "tool", "argument", F.left(result, F.lit(SUMMARY)).alias("summary")).alias("call"),
            F.coalesce("pages", none("long")).alias("pages"),
        )
        results = done.select("question_id", one.alias("r")).groupBy("question_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
        said = asked.withColumnRenamed("error", "failed").join(results, "question_id", "left")
        said = said.select("question_id", "text", "failed", F.coalesce("r", F.array()).alias("r"), F.size("calls").alias("n_calls"), F.col("calls.tool").alias("called"))
        after = state.join(said, "question_id", "left")
        message = F.struct(F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("content"), F.array_join("called", ",").alias("tool"))
        more = F.col("failed").isNull() & (F.col("n_calls") > 0)
        state = after.select(
            "question_id",
            F.when(more, F.concat("messages", F.array(message), F.col("r.message"))).otherwise(F.col("messages")).alias("messages"),
            F.when(more, F.concat("requested", F.flatten("r.pages"))).otherwise(F.col("requested")).alias("requested"),
            F.when(more, F.concat("trace", F.col("r.call"))).otherwise(F.col("trace")).alias("trace"),
            F.when(F.col("failed").isNull() & (F.col("n_calls") == 0), F.coalesce("text", F.lit(""))).otherwise(F.col("answer")).alias("answer"),
            F.coalesce("error", "failed").alias("error"),
            F.lit(turn).cast("long").alias("turns"),
        )
        state = saved(state, "dialog")
        is_open = "answer IS NULL AND error IS NULL"
        closed.append(state.filter(f"NOT ({is_open})"))
        state = state.filter(is_open)
    state = reduce(DataFrame.unionByName, closed, state)
    answer = F.when(F.col("error").isNull(), tx.without_invitation(F.coalesce("answer", F.lit(OUT_OF_TURNS))))
    return state.withColumn("answer", answer).select(
        "question_id",
        "answer",
        tx.without_citations(F.col("answer")).alias("answer_clean"),
        tx.citations(F.col("answer")).alias("citations"),
        "trace",
        F.array_sort(F.array_distinct("requested")).alias("pages_retrieved"),
        F.col("requested").alias("all_pages_requested"),
        F.col("turns").alias("total_turns"),
        "messages",
        "error",
    )


def over_library(library) -> Callable[[DataFrame], DataFrame]:
    """The tools of a library of ingested documents, for ``answered``.

    get_page_content takes {"doc": ..., "pages": "7-9"} and brings these pages' texts; get_document_structure takes
    {"doc": ..., "part": 1} and brings that part's nodes. All calls of a turn are two joins with the library's tables.
    """
    pages, parts = library.table("pages"), library.table("parts")

    def run(calls: DataFrame) -> DataFrame:
        keys = ["question_id", "turn", "nth"]
        field = lambda name: F.get_json_object("argument", f"$.{name}")
        asked = calls.select("*", field("doc").alias("_doc"), field("pages").alias("_pages"), F.coalesce(field("part").try_cast("long"), F.lit(1)).alias("_part"))
        content = asked.filter("tool = 'get_page_content'").select(*keys, "_doc", F.explode(page_list(F.col("_pages")).cast("array<long>")).alias("_page"))
        rows = pages.select(F.col("doc").cast("string").alias("_doc"), F.col("page").cast("long").alias("_page"), "text")
        text = F.struct("_page", F.concat(F.lit("[Page "), F.col("_page").cast("string"), F.lit("]\n"), F.col("text")).alias("t"))
        texts = content.join(rows, ["_doc", "_page"]).groupBy(*keys).agg(F.array_sort(F.collect_set(text)).alias("p"))
        texts = texts.select(*keys, F.array_join("p.t", "\n\n").alias("result"), F.col("p._page").alias("pages"))
        wanted = asked.filter("tool = 'get_document_structure'").select(*keys, "_doc", "_part")
        nodes = parts.select(F.col("doc").cast("string").alias("_doc"), F.col("part").alias("_part"), F.struct("place", F.to_json(F.struct("node_id", "parent_path", "is_skeleton")).alias("j")).alias("n"))
        outlines = wanted.join(nodes, ["_doc", "_part"]).groupBy(*keys).agg(F.array_sort(F.collect_list("n")).alias("n"))
        outlines = outlines.select(*keys, F.array_join("n.j", "\n").alias("result"), F.array().cast("array<long>").alias("pages"))
        known = F.col("tool").isin("get_page_content", "get_document_structure")
        error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unknown tool: "), F.coalesce("tool", F.lit("")))).when(F.col("result").isNull(), F.lit("no such document, page or part"))
        return calls.join(texts.unionByName(outlines), keys, "left").withColumn("error", error)

    return run
