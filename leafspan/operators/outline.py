"""Outlines from bookmarks, front matter and headings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as tx
from leafspan.operators import toc

# Titles that get no number, and the ids of front nodes.
FRONT_TITLES = ["abstract", "status of this memo", "copyright notice", "table of contents", "contents", "toc", "foreword", "preface"]
FRONT_IDS = {
    "Abstract": "front_abstract",
    "Status of This Memo": "front_status",
    "Copyright Notice": "front_copyright",
    "Table of Contents": "front_toc",
}


def _level_numbers(table: pa.Table) -> pa.Table:
    """One document's bookmarks with made: the count of each level since the last bookmark above it, joined by dots."""
    table = table.sort_by("ord")
    counts: list[int] = []
    made = []
    for level in table.column("level").to_pylist():
        level = min(level, len(counts) + 1)
        counts = counts[:level] + [0] * (level - len(counts))
        counts[-1] += 1
        made.append(".".join(map(str, counts)))
    return table.append_column("made", pa.array(made, pa.string()))


def from_bookmarks(marks: DataFrame) -> DataFrame:
    """(doc, ord, structure, title, physical_index) from bookmarks (doc, ord, level, title, page).

    A level may exceed the one before by one at most. Numbers count the bookmarks of a level since the
    last one above it, for as many levels as there are. A number in a title wins; made numbers apply from the page of
    the first numbered title on, not to front titles. Of equal entries one stays.
    """
    order = Window.partitionBy("doc").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.filter("level > 0 AND page > 0").select("doc", "ord", F.col("level").cast("long").alias("level"), "title", "page")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", made string"
    rows = rows.groupBy("doc").applyInArrow(_level_numbers, schema)
    own = r"^\s*(\d+(\.\d+)*)[.)]?\s*(.*)$"
    text = tx.squeezed(F.coalesce("title", F.lit("")))
    rows = rows.select("doc", "ord", "page", text.alias("text"), "made").filter("text <> ''")
    explicit = F.col("text").rlike(own)
    start = F.first(F.when(explicit, F.col("page")), ignorenulls=True).over(upto)
    front = F.lower(F.trim("text", F.lit(tx.FRONT_PUNCTUATION))).isin(FRONT_TITLES)
    rest = F.trim(F.regexp_extract("text", own, 3))
    rows = rows.select(
        "doc",
        "ord",
        F.when(explicit, F.regexp_extract("text", own, 1)).when(~front & (F.col("page") >= start), F.col("made")).alias("structure"),
        F.when(explicit & (rest != ""), rest).otherwise(F.col("text")).alias("title"),
        F.col("page").alias("physical_index"),
    )
    first = rows.groupBy("doc", "structure", F.lower("title").alias("_t"), "physical_index").agg(F.min_by("title", "ord").alias("title"))
    place = Window.partitionBy("doc").orderBy("physical_index", F.coalesce("structure", F.lit("")), "title")
    return first.select("doc", F.row_number().over(place).cast("long").alias("ord"), "structure", "title", "physical_index")


def front_matter(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """Front-matter nodes (doc, node_id, title, start_index, end_index, start_line, end_line, toc_span).

    ``pages`` has doc, page, text; ``firsts`` has doc, first_page, structure, title of
    the first body section. The first line of each canonical heading counts. A node
    ends before the next one on its page, else with the page. A table of contents goes
    on over the contents pages that follow, up to the first body heading.
    """
    bounded = pages.join(firsts.filter("first_page > 1"), "doc").filter("page <= first_page")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    sized = bounded.withColumn("n_lines", F.size(lines)).withColumn("contents", tx.is_contents_page(F.col("text")))
    listed = sized.select("doc", "page", "n_lines", F.posexplode(lines).alias("line", "raw"))
    hits = listed.withColumn("heading", tx.front_heading(F.col("raw"), F.col("line"))).filter("heading IS NOT NULL")
    first = hits.groupBy("doc", "heading").agg(F.min(F.struct("page", "line", "n_lines")).alias("m")).select("doc", "heading", "m.*")
    following = Window.partitionBy("doc", "page").orderBy("line")
    first = first.withColumn("next_line", F.lead("line").over(following))
    # contents pages that follow without a gap
    flags = sized.select("doc", F.col("page").alias("p"), "n_lines", "contents")
    after = first.filter("heading = 'Table of Contents'").select("doc", F.col("page").alias("toc_page")).join(flags, "doc").filter("p > toc_page")
    gap = after.filter("NOT contents").groupBy("doc").agg(F.min("p").alias("gap"))
    run = after.join(gap, "doc", "left").filter("contents AND (gap IS NULL OR p < gap)")
    run = run.groupBy("doc").agg(F.max("p").alias("toc_end"), F.max_by("n_lines", "p").alias("toc_lines"))
    body = sized.filter("page = first_page").select(
        "doc", F.col("first_page"), toc.heading_line(F.col("text"), F.col("structure"), F.col("title")).alias("stop")
    )
    out = first.join(run, "doc", "left").join(body, "doc", "left")
    is_toc = F.col("heading") == "Table of Contents"
    end_page = F.when(is_toc, F.coalesce("toc_end", "page")).otherwise(F.col("page"))
    own_end = F.when(F.col("next_line").isNotNull(), F.greatest(F.col("line"), F.col("next_line") - 1)).otherwise(
        F.greatest(F.col("line"), F.col("n_lines") - 1)
    )
    toc_stop = F.when((end_page == F.col("first_page")) & F.col("stop").isNotNull(), F.col("stop") - 1)
    toc_end_line = F.coalesce(toc_stop, F.greatest(F.lit(0), F.coalesce("toc_lines", "n_lines") - 1))
    ids = F.lit(None).cast("string")
    for name, node in FRONT_IDS.items():
        ids = F.when(F.col("heading") == name, F.lit(node)).otherwise(ids)
    return out.select(
        "doc",
        ids.alias("node_id"),
        F.col("heading").alias("title"),
        F.col("page").alias("start_index"),
        end_page.alias("end_index"),
        F.col("line").cast("long").alias("start_line"),
        F.when(is_toc, toc_end_line).otherwise(own_end).cast("long").alias("end_line"),
        is_toc.alias("toc_span"),
    )


def refined(nodes: DataFrame, pages: DataFrame, levels: int = 5) -> DataFrame:
    """``nodes`` (doc, structure, title, start_index, end_index) and the numbered headings found below them, level by level.

    A heading belongs below a node if its number starts with the node's and its
    page lies in the node's range. Each level takes the headings one number deeper than
    their nodes; the loop ends when a level finds none, after at most ``levels``.
    """
    found = toc.heading_lines(pages).select("doc", "physical_index", "structure", "title")
    found = found.groupBy("doc", "structure").agg(F.min(F.struct("physical_index", "title")).alias("m"))
    found = found.select("doc", "structure", F.col("m.physical_index").alias("start_index"), F.col("m.title").alias("title"))
    up = F.regexp_extract("structure", r"^(.*)\.\d+$", 1)
    found = found.withColumn("parent", up)
    out = level = nodes.select("doc", "structure", "title", "start_index", "end_index", F.lit(0).alias("level"))
    for depth in range(1, levels + 1):
        over = level.select("doc", F.col("structure").alias("parent"), F.col("start_index").alias("low"), F.col("end_index").alias("high"))
        below = found.join(over, ["doc", "parent"]).filter("start_index BETWEEN low AND high")
        order = Window.partitionBy("doc", "parent").orderBy("start_index", F.length("structure"), "structure")
        end = F.greatest(F.col("start_index"), F.coalesce(F.lead("start_index").over(order), F.col("high")))
        level = below.select("doc", "structure", "title", "start_index", end.alias("end_index"), F.lit(depth).alias("level"))
        level = level.join(out.select("doc", "structure"), ["doc", "structure"], "left_anti").select(*out.columns)
        if level.isEmpty():
            break
        out = out.unionAll(level)
    return out


def starts_of(items: DataFrame, pages: DataFrame, judge=None) -> DataFrame:
    """``items`` (doc, structure, title, physical_index, start_line, end_line, toc_span) with starts_page.

    No page: no. Anchors and contents spans: yes. Else the rule on the page's first
    lines; where that fails, ``judge`` (a function of title and text columns), if given.
    """
    own = pages.select("doc", F.col("page").alias("physical_index"), F.col("text").alias("_text"))
    rows = items.join(own, ["doc", "physical_index"], "left")
    anchor = (F.col("structure").isNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()) | F.coalesce("toc_span", F.lit(False))
    rule = toc.starts_page(F.col("_text"), F.coalesce("structure", F.lit("")), F.col("title"))
    more = judge(F.col("title"), F.col("_text")) if judge else F.lit(False)
    starts = F.when(F.col("physical_index").isNull(), False).when(anchor, True).when(F.col("_text").isNull(), False).otherwise(rule | more)
    return rows.withColumn("starts_page", starts).drop("_text")
