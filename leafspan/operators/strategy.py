"""Choosing an index for each document: strategies in turn, kept or mended by how many of their entries are where they say.

Every document has a state of its own. A round works on the documents that are still open: those whose index is
right or mended enough are closed, those whose index is mostly right are mended, the others wait
for the next strategy. The driver only sees whether any document is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.operators import toc
from leafspan.sources.files import FEW, saved

MENDABLE = 0.6
MOST_REPAIRS = 3
INDEX = ["doc", "ord", "structure", "title", "physical_index"]
Found = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Outcome:
    """``index``: the kept entries (INDEX and strategy); ``states``: doc, strategy (null where all were too wrong), repairs, accuracy, wrong."""

    index: DataFrame
    states: DataFrame


def checked(index: DataFrame, pages: DataFrame, found: Found = toc.found_on_page) -> DataFrame:
    """``index`` (doc, ord, structure, title, physical_index) with found: whether the entry is on its page."""
    own = pages.select("doc", F.col("page").alias("physical_index"), F.col("text").alias("_text"))
    is_found = found(F.col("_text"), F.col("structure"), F.col("title"))
    return index.join(own, ["doc", "physical_index"], "left").withColumn("found", F.coalesce(is_found, F.lit(False))).drop("_text")


def _of(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The pages of ``docs``: texts stay where they are for up to FEW documents; beyond that they are dealt by document once and written."""
    ids = docs.select("doc")
    if ids.limit(FEW + 1).count() <= FEW:
        return pages.join(F.broadcast(ids), "doc", "left_semi")
    return saved(pages.join(ids, "doc", "left_semi"), "pages-of-documents")


def repaired(index: DataFrame, pages: DataFrame, found: Found = toc.found_on_page) -> DataFrame:
    """A checked index (INDEX, pages, found) with entries that are not on their page moved to the first page between their good neighbours that holds them.

    Only pages between the neighbours are joined, by document and page; the result is written, so that rounds do not pile up.
    """
    bounded = toc.neighbours(index, "found", low=1, high=1 << 30)
    wrong = bounded.filter("NOT found").withColumn("after", F.least("after", "pages")).filter("before <= after")
    wrong = wrong.select("doc", "ord", "structure", "title", F.explode(F.sequence("before", "after")).alias("page"))
    near = wrong.join(pages.select("doc", "page", "text"), ["doc", "page"])
    held = near.filter(found(F.col("text"), F.col("structure"), F.col("title")))
    moved = held.groupBy("doc", "ord").agg(F.min("page").alias("_page"))
    out = index.join(moved, ["doc", "ord"], "left").withColumn("physical_index", F.coalesce("_page", "physical_index"))
    return saved(out.withColumn("found", F.col("found") | F.col("_page").isNotNull()).select(*index.columns), "repaired")


def _measured(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, pages, accuracy, wrong) for each of ``docs`` (doc, pages) by its checked index; 0 for documents without entries."""
    return saved(docs.join(toc.accuracies(index, docs), "doc", "left").na.fill({"accuracy": 0.0, "wrong": 0}), "index-states")


def chosen(strategies: dict[str, Callable[[DataFrame], DataFrame]], pages: DataFrame, found: Found = toc.found_on_page) -> Outcome:
    """For each document of ``pages`` (doc, page, text) the index of the first strategy that fits it.

    A strategy gets the pages of the documents that are still open and returns their entries (INDEX). Entries without a page, or
    past the document's last one, go. An index all of whose entries are on their pages is kept; one of which
    more than MENDABLE are is mended up to MOST_REPAIRS times and kept; else the next strategy has its turn.
    """
    left = saved(pages.groupBy("doc").agg(F.max("page").alias("pages")), "open-documents").withColumn("accuracy", F.lit(0.0)).withColumn("wrong", F.lit(0).cast("long"))
    own, kept, states = pages, [], []
    for name, build in strategies.items():
        if left.isEmpty():
            break
        docs = left.select("doc", "pages")
        own = _of(pages, docs) if kept else pages
        index = toc.within_document(build(own).join(docs, "doc"), "pages").filter("physical_index IS NOT NULL")
        index = saved(checked(index.select(*INDEX, "pages"), own, found), "checked")
        state = _measured(index, docs)
        left = state.filter(F.col("accuracy") <= MENDABLE)
        state = state.filter(F.col("accuracy") > MENDABLE)
        for repairs in range(MOST_REPAIRS + 1):
            again = F.col("wrong") > 0 if repairs < MOST_REPAIRS else F.lit(False)
            closed, ill = state.filter(~again), state.filter(again)
            states.append(closed.select("doc", F.lit(name).alias("strategy"), F.lit(repairs).alias("repairs"), "accuracy", "wrong"))
            kept.append(index.select(*INDEX).join(closed.select("doc"), "doc", "left_semi").withColumn("strategy", F.lit(name)))
            if ill.isEmpty():
                break
            docs = ill.select("doc", "pages")
            index = repaired(index.join(docs.select("doc"), "doc", "left_semi"), _of(own, docs), found)
            state = _measured(index, docs)
    states.append(left.select("doc", F.lit(None).cast("string").alias("strategy"), F.lit(0).alias("repairs"), "accuracy", "wrong"))
    if not kept:
        raise ValueError("there are no strategies or no pages")
    return Outcome(reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, states))
