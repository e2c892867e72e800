"""Tables of contents: page offsets, page ranges, neighbours, coverage, headings in pages.

A table of contents has a row per entry with an explicit order ``ord`` within its
document ``doc``. Rows stay flat; everything is a window or a join per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import fuzzy
from leafspan.functions import text as tx
from leafspan.sources.files import saved

#: Page numbers of a block, and pairs whose differences are held at once.
PAGES = 32768
AT_ONCE = 1 << 20
#: Entries of one title that are dealt out when they meet others.
CROWD = 256


def title_pairs(by_page: DataFrame, by_index: DataFrame, first_index: int) -> DataFrame:
    """(title, page, physical_index, ord): entries of equal title from both lists; null titles are equal.

    Entries of a title that many have are dealt out, each share meets the title's entries of the other list.
    """
    left = by_page.select("title", "page", "ord")
    right = by_index.filter(F.col("physical_index") >= first_index).select(F.col("title").alias("_title"), "physical_index")
    crowds = left.groupBy("title").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("shares")).filter("shares > 1").select(F.col("title").alias("_t"), "shares")
    dealt = lambda t, c: t.join(crowds, F.col(c).eqNullSafe(F.col("_t")), "left").drop("_t").withColumn("shares", F.coalesce("shares", F.lit(1)))
    left = dealt(left, "title").withColumn("_share", F.pmod(F.xxhash64("page", "ord"), F.col("shares")).cast("int")).drop("shares")
    right = dealt(right, "_title").withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return left.join(right, F.col("title").eqNullSafe(F.col("_title")) & (F.col("_share") == F.col("_own"))).select("title", "page", "physical_index", "ord")


def _first_met(counted: DataFrame) -> DataFrame:
    """One row (offset): of the differences (offset, n, first) the most frequent; of equals the one met first, by ord, then physical_index."""
    met = F.struct("n", (-F.col("first.ord")).alias("a"), (-F.col("first.physical_index")).alias("b"))
    return counted.agg(F.max_by("offset", met).alias("offset"))


def page_offset(pairs: DataFrame) -> DataFrame:
    """One row (offset): the most frequent physical_index - page; of equals the one met first, by ord, then physical_index. Null without pairs."""
    difference = (F.col("physical_index") - F.col("page")).alias("offset")
    counted = pairs.filter("physical_index IS NOT NULL AND page IS NOT NULL").groupBy(difference).agg(
        F.count("*").alias("n"), F.min(F.struct("ord", "physical_index")).alias("first")
    )
    return _first_met(counted)


def _differences(batches):
    """For each row of two lists, entries (page, n, ord) and (physical_index, n), how often each difference occurs and where it is met first."""
    schema = pa.schema([(c, pa.int64()) for c in ("offset", "n", "ord", "physical_index")])
    for batch in batches:
        columns = []
        for side, names in (("a", ("page", "n", "ord")), ("b", ("physical_index", "n"))):
            lists = batch.column(side)
            columns.append((lists.offsets.to_numpy(), [lists.values.field(c).to_numpy() for c in names]))
        (ends_a, a), (ends_b, b) = columns
        made, held = [], 0
        for k in range(batch.num_rows):
            page, n, order = (c[ends_a[k]:ends_a[k + 1]] for c in a)
            index, m = (c[ends_b[k]:ends_b[k + 1]] for c in b)
            by_order, by_index = np.argsort(order, kind="stable"), np.argsort(index)
            page, n, order, index, m = page[by_order], n[by_order], order[by_order], index[by_index], m[by_index]
            low, size = index[0] - page.max(), int(index[-1] - page.min() - index[0] + page.max()) + 1
            count, first = np.zeros(size, np.int64), np.full(size, -1, np.int64)
            step = max(1, AT_ONCE // len(index))
            for i in range(0, len(page), step):  # pairs in the order they are met
                d = (index[None, :] - page[i:i + step, None] - low).ravel()
                np.add.at(count, d, np.outer(n[i:i + step], m).ravel())
                new = np.flatnonzero(first[d] < 0)[::-1]
                first[d[new]] = new + i * len(index)  # the last one written is the first one met
            found = np.flatnonzero(count)
            at = first[found]
            made.append((found + low, count[found], order[at // len(index)], index[at % len(index)]))
            held += len(found)
            if held >= AT_ONCE or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], schema=schema)
                made, held = [], 0


def title_offset(by_page: DataFrame, by_index: DataFrame, first_index: int) -> DataFrame:
    """``page_offset`` of ``title_pairs``, without making the pairs.

    Equal entries are counted once. Each title's pages are kept in blocks of PAGES numbers; where two blocks
    of a title meet, the differences, at most 2 * PAGES, are counted in place.
    """
    title = F.struct(F.coalesce("title", F.lit("")).alias("text"), F.col("title").isNull().alias("none")).alias("title")
    block = lambda c: F.floor(F.col(c) / PAGES).alias("block")
    a = by_page.filter("page IS NOT NULL").groupBy(title, F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"), F.min("ord").cast("long").alias("ord"))
    b = by_index.filter(F.col("physical_index") >= first_index).groupBy(title, F.col("physical_index").cast("long").alias("physical_index")).agg(F.count("*").alias("n"))
    a = a.groupBy("title", block("page")).agg(F.collect_list(F.struct("page", "n", "ord")).alias("a"))
    b = b.groupBy("title", block("physical_index")).agg(F.collect_list(F.struct("physical_index", "n")).alias("b"))
    cells = a.join(b.withColumnRenamed("block", "_block"), "title").repartition("title", "block", "_block").select("a", "b")
    counted = saved(cells.mapInArrow(_differences, "offset long, n long, ord long, physical_index long"), "differences")
    return _first_met(counted.groupBy("offset").agg(F.sum("n").alias("n"), F.min(F.struct("ord", "physical_index")).alias("first")))


def with_offset(toc: DataFrame, offset: DataFrame) -> DataFrame:
    """physical_index = page + offset where an entry has a page; ``offset`` is one row."""
    return toc.crossJoin(F.broadcast(offset)).withColumn("physical_index", F.coalesce(F.col("page") + F.col("offset"), F.col("physical_index")))


def page_ranges(toc: DataFrame, last_page: int | None = None) -> DataFrame:
    """``toc`` with start_index and end_index.

    An entry ends on the page before the next one if that starts its page, else
    on the next one's page, never before its own start; the last one ends with
    the document (column ``pages`` or ``last_page``).
    """
    end_of_doc = F.lit(last_page) if last_page is not None else F.col("pages")
    order = Window.partitionBy("doc").orderBy("ord")
    following, starts = F.lead("physical_index").over(order), F.lead("starts_page").over(order)
    is_last = F.lead(F.lit(1)).over(order).isNull()
    own = F.col("physical_index")
    end = (
        F.when(is_last, F.when(own.isNull(), end_of_doc).otherwise(F.greatest(own, end_of_doc)))
        .when(following.isNull(), F.coalesce(own, end_of_doc))
        .when(starts, F.greatest(F.coalesce(own, F.lit(1)), following - 1))
        .otherwise(following)
    )
    return toc.withColumn("start_index", own).withColumn("end_index", end.cast("long"))


def neighbours(toc: DataFrame, good: str, low: int = 0, high: int = -1) -> DataFrame:
    """``toc`` with before and after: the physical_index of the nearest good entry on either side."""
    order = Window.partitionBy("doc").orderBy("ord")
    value = F.when(F.col(good), F.col("physical_index"))
    before = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return toc.withColumn("before", F.coalesce(before, F.lit(low))).withColumn("after", F.coalesce(after, F.lit(high)))


def within_document(toc: DataFrame, pages: str, first: int = 1) -> DataFrame:
    """physical_index becomes null where it lies past the document's last page."""
    return toc.withColumn(
        "physical_index", F.when(F.col("physical_index") <= F.col(pages) + first - 1, F.col("physical_index"))
    )


def first_body_section(toc: DataFrame) -> DataFrame:
    """(doc, page, structure, title): per document the numbered entry with the smallest page, the first of equals."""
    body = toc.filter(F.trim("structure").rlike(r"^[1-9]\d*(\.\d+)*$") & (F.col("physical_index") >= 1))
    first = body.groupBy("doc").agg(F.min(F.struct("physical_index", "ord", "structure", "title")).alias("m"))
    structure = F.trim("m.structure")
    return first.select(
        "doc",
        F.col("m.physical_index").alias("page"),
        structure.alias("structure"),
        tx.section_title(F.col("m.title"), structure).alias("title"),
    )


def front_gaps(nodes: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, gap): pages before the first body page (firsts: doc, first_page) that no front node covers."""
    wanted = firsts.filter("first_page > 1").select("doc", F.explode(F.sequence(F.lit(1), F.col("first_page").cast("int") - 1)).alias("gap"))
    low, high = F.least("start_index", "end_index"), F.greatest("start_index", "end_index")
    spans = nodes.filter("start_index IS NOT NULL AND end_index IS NOT NULL").select("doc", low.alias("low"), high.alias("high"))
    # ranges are cut to the wanted pages before they are listed
    covered = (
        spans.join(firsts, "doc")
        .select("doc", F.greatest(F.col("low"), F.lit(1)).alias("low"), F.least(F.col("high"), F.col("first_page") - 1).alias("high"))
        .filter("low <= high")
        .select("doc", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("gap"))
    )
    return wanted.join(covered, ["doc", "gap"], "left_anti")


def heading_lines(pages: DataFrame, parent: str | None = None, max_lines: int = 0) -> DataFrame:
    """(doc, physical_index, structure, title, ord) of numbered headings (2 to 10 levels) in (doc, physical_index, text).

    The first heading of a number on a page counts; with ``parent`` only it and numbers below it.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]", -1)
    if max_lines > 0:
        lines = F.slice(lines, 1, max_lines)
    rows = pages.select("doc", "physical_index", F.posexplode(lines).alias("line", "raw")).filter(F.col("raw").rlike(tx.NUMBERED_HEADING))
    part = lambda k: F.regexp_extract("raw", tx.NUMBERED_HEADING, k)
    rows = rows.select("doc", "physical_index", "line", part(1).alias("structure"), tx.heading_title(part(3)).alias("title")).filter("title <> ''")
    if parent:
        rows = rows.filter((F.col("structure") == parent) | F.col("structure").startswith(parent + "."))
    first = rows.groupBy("doc", "physical_index", "structure").agg(F.min_by("title", "line").alias("title"))
    depth = F.size(F.split("structure", r"\."))
    order = Window.partitionBy("doc").orderBy("physical_index", depth, "structure")
    return first.withColumn("ord", F.row_number().over(order).cast("long"))


def heading_line(text, structure, title=None):
    """0-based line of a section's heading: number and title, else the number alone outside a contents entry; null if none."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def first(test):
        place = F.array_position(F.transform(lines, test), True)
        return F.when(place > 0, place - 1)

    number = F.concat(F.lit(r"^\s*"), tx.quoted(structure), F.lit(r"\.\s+"))
    loose = first(
        lambda x: F.regexp_like(x, F.concat(number, F.lit(r"\S+"))) & ~x.rlike(r"\.{3,}\s*\d+\s*$")
    )
    if title is None:
        return F.when(structure != "", loose)
    strict = first(lambda x: F.regexp_like(x, F.concat(F.lit("(?i)"), number, tx.quoted(F.trim(title)), F.lit(r"\b"))))
    return F.when(structure != "", F.coalesce(F.when(title != "", strict), loose))


def starts_page(text, structure, title, top: int = 30):
    """Whether one of the first lines starts with the number or holds the title (case and spacing aside)."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n", -1), 1, top)
    plain = lambda x: F.lower(tx.squeezed(x))
    number = F.exists(lines, lambda x: F.regexp_like(x, F.concat(F.lit(r"^\s*"), tx.quoted(F.trim(structure)), F.lit(r"\b"))))
    named = F.exists(lines, lambda x: plain(x).contains(plain(title)))
    return F.coalesce((structure != "") & number, F.lit(False)) | F.coalesce((F.trim(title) != "") & named, F.lit(False))


def appears_on_page(text, structure, title):
    """Whether a page holds number and title together, or, for numbers of three levels or more, the number starting a line."""
    number = tx.quoted(structure)
    both = F.regexp_like(text, F.concat(F.lit("(?i)"), number, F.lit(r"\.?\s*"), tx.quoted(F.trim(title))))
    deep = (F.size(F.split(structure, r"\.")) >= 3) & F.regexp_like(text, F.concat(F.lit(r"(^|\n)\s*"), number, F.lit(r"\.?\s")))
    return F.coalesce(both | deep, F.lit(False))


def found_on_page(text, structure, title, least: float = 85.0):
    """Whether an entry appears on a page, or its title is found roughly in the page's first part.

    The rough search runs only where the exact one fails. A missing page or title is not found.
    """
    exact = appears_on_page(text, structure, title)
    rough = fuzzy.title_ratio(F.trim(title), F.when(~exact, text))
    return exact | F.coalesce(rough >= least, F.lit(False))


def contents_run(pages: DataFrame, within: int = 20) -> DataFrame:
    """(doc, physical_index): the first run of consecutive contents pages that starts within the first pages."""
    flagged = pages.select("doc", "physical_index", tx.is_contents_page(F.col("text")).alias("hit")).filter("hit")
    order = Window.partitionBy("doc").orderBy("physical_index")
    runs = flagged.withColumn("run", F.col("physical_index") - F.row_number().over(order))
    first = runs.groupBy("doc").agg(F.min("run").alias("run"), F.min("physical_index").alias("start")).filter(F.col("start") <= within)
    return runs.join(first.select("doc", "run"), ["doc", "run"]).select("doc", "physical_index")


def with_preface(toc: DataFrame) -> DataFrame:
    """A Preface entry before the first one of documents that do not start on page 1."""
    first = toc.groupBy("doc").agg(F.min_by("physical_index", "ord").alias("first"), F.min("ord").alias("ord")).filter("first > 1")
    row = first.select("doc", (F.col("ord") - 1).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).cast("long").alias("physical_index"))
    return toc.select("doc", "ord", "structure", "title", "physical_index").unionByName(row)


def accuracy(checked: DataFrame, pages: int) -> DataFrame:
    """One row (accuracy, wrong): the share of entries found on their page; 0 if entries end before half of the pages."""
    early = F.coalesce(F.max("physical_index"), F.lit(0)) < pages / 2
    share = F.avg(F.col("found").cast("double"))
    return checked.agg(
        F.when(early, F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("accuracy"),
        F.coalesce(F.sum((~F.col("found")).cast("long")), F.lit(0)).alias("wrong"),
    )


def accuracies(checked: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, accuracy, wrong) as in ``accuracy``, for each document of ``docs`` (doc, pages) with entries."""
    sums = checked.groupBy("doc").agg(
        F.max("physical_index").alias("_last"), F.avg(F.col("found").cast("double")).alias("_share"), F.sum((~F.col("found")).cast("long")).alias("wrong")
    )
    early = F.coalesce("_last", F.lit(0)) < F.col("pages") / 2
    return sums.join(docs.select("doc", "pages"), "doc").select("doc", F.when(early, F.lit(0.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("accuracy"), "wrong")
