"""Heading trees as rows: parents, depth-first order, paths, leaves, ranges of descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.sources.files import saved


def number(structure):
    """A section number with only digits and single inner dots; null if nothing is left."""
    digits = F.regexp_replace(F.regexp_replace(structure, "．", "."), "[^0-9.]", "")
    return F.nullif(F.trim(F.regexp_replace(digits, r"\.+", "."), F.lit(".")), F.lit(""))


def parents(toc: DataFrame) -> DataFrame:
    """``toc`` (doc, ord, structure, title) with full_title and parent_ord, null for roots.

    The parent is the entry whose number is the longest proper prefix there is; of
    several with that number the latest before the entry, else the first one. An equi-join of
    each entry's prefixes with the different numbers replaces any search; where many entries have a number, the
    latest before is found in their order, so that entries do not meet all of them.
    """
    rows = saved(toc.withColumn("structure", number(F.col("structure"))), "headings")
    parts = F.split("structure", r"\.")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    asked = rows.filter("structure IS NOT NULL").select("doc", "ord", F.explode(depths).alias("depth"), parts.alias("parts"))
    asked = asked.select("doc", "ord", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), ".").alias("prefix"))
    known = rows.filter("structure IS NOT NULL").select("doc", F.col("structure").alias("prefix"), "ord")
    first = known.groupBy("doc", "prefix").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    met = asked.join(first, ["doc", "prefix"])
    same = known.join(first.filter("n > 1").select("doc", "prefix"), ["doc", "prefix"])
    both = met.filter("n > 1").select("doc", "prefix", "ord", "depth", "first", F.lit(None).cast("long").alias("own"))
    both = both.unionByName(same.withColumn("own", F.col("ord")), allowMissingColumns=True)
    before = Window.partitionBy("doc", "prefix").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    latest = both.withColumn("before", F.last("own", ignorenulls=True).over(before)).filter("depth IS NOT NULL")
    candidates = met.filter("n = 1").select("doc", "ord", "depth", F.col("first").alias("parent"))
    candidates = candidates.unionAll(latest.select("doc", "ord", "depth", F.coalesce("before", "first")))
    found = candidates.groupBy("doc", "ord").agg(F.max_by("parent", "depth").alias("parent_ord"))
    title = F.trim(F.coalesce("title", F.lit("")))
    full = F.trim(F.concat_ws(" ", "structure", title))
    return rows.join(found, ["doc", "ord"], "left").withColumn("full_title", full)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc, ord, up): each entry's way from its root down to itself, as an array of (ord, title).

    Pointers double: every round joins each open entry with the one its pointer has reached, whose way is as long, so that a tree of
    depth d takes log2(d) rounds, over all documents at once. Entries that no root reaches are left out.
    """
    own = F.array(F.struct("ord", F.coalesce("title", F.lit("")).alias("title")))
    ways = saved(nodes.select("doc", "ord", F.col("parent_ord").cast("long").alias("top"), own.alias("up")), "ways")
    left, before = ways.filter("top IS NOT NULL").count(), None
    while left and left != before:  # the number of open entries falls in every round, but for entries in circles
        reached = ways.select("doc", F.col("ord").alias("top"), F.col("top").alias("_top"), F.col("up").alias("_up"))
        longer = ways.filter("top IS NOT NULL").join(reached, ["doc", "top"])
        longer = longer.select("doc", "ord", F.col("_top").alias("top"), F.concat("_up", "up").alias("up"))
        ways = saved(ways.filter("top IS NULL").unionByName(longer), "ways")
        left, before = ways.filter("top IS NOT NULL").count(), left
    return ways.filter("top IS NULL").select("doc", "ord", "up")


def walked(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc, ord, parent_ord, title, ...) with depth, path (ords from the root) and parent_path (titles joined by '/').

    Entries that no root reaches are left out. No document is handled as a whole anywhere.
    """
    titles = F.transform(F.slice("up", F.lit(1), F.size("up") - 1), lambda u: u["title"])
    over = F.aggregate(titles, F.lit(""), lambda x, t: F.when(x == "", t).otherwise(F.concat(x, F.lit("/"), t)))
    ways = ancestors(nodes).select("doc", "ord", F.size("up").alias("depth"), F.transform("up", lambda u: u["ord"]).alias("path"), over.alias("parent_path"))
    return nodes.join(ways, ["doc", "ord"]).select(*nodes.columns, "depth", "path", "parent_path")


def nested_sets(walk: DataFrame) -> DataFrame:
    """``walk`` with first and last: entries numbered from 0 depth first, parents before children, siblings by ord; all below an entry lie between its two numbers.

    An entry comes after its parent and all that is below its earlier siblings; its number is the sum of
    these steps along its path. Sizes and sums are aggregates over paths, only siblings are ordered.
    """
    steps = walk.select("doc", F.col("ord").alias("_own"), F.explode("path").alias("ord"))
    sizes = steps.groupBy("doc", "ord").agg(F.count("*").alias("size"))
    siblings = Window.partitionBy("doc", "parent_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    sized = walk.select("doc", "ord", "parent_ord").join(sizes, ["doc", "ord"])
    step = F.coalesce(F.sum("size").over(siblings), F.lit(0)) + F.col("parent_ord").isNotNull().cast("long")
    sized = saved(sized.select("doc", "ord", "size", step.alias("step")), "steps")
    first = steps.join(sized.select("doc", "ord", "step"), ["doc", "ord"]).groupBy("doc", F.col("_own").alias("ord")).agg(F.sum("step").alias("first"))
    both = first.join(sized.select("doc", "ord", "size"), ["doc", "ord"]).select("doc", "ord", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    return walk.join(both, ["doc", "ord"]).select(*walk.columns, "first", "last")


def preorder(walk: DataFrame) -> DataFrame:
    """``walk`` with node_id: entries numbered from 0000 depth first, parents before children, siblings by ord."""
    number = F.col("first").cast("string")
    return nested_sets(walk).withColumn("node_id", F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).drop("first", "last")


def below(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, asked, ord): all entries of the subtrees of ``asked`` (doc, ord), by ranges of numbers. ``sets`` comes from nested_sets."""
    roots = sets.join(asked.select("doc", "ord"), ["doc", "ord"], "left_semi").select("doc", F.col("ord").alias("asked"), F.col("first").alias("_low"), F.col("last").alias("_high"))
    return sets.join(roots, "doc").filter(F.col("first").between(F.col("_low"), F.col("_high"))).select("doc", "asked", "ord")


def leaves(nodes: DataFrame) -> DataFrame:
    """Entries without children."""
    inner = nodes.filter("parent_ord IS NOT NULL").select("doc", F.col("parent_ord").alias("ord")).distinct()
    return nodes.join(inner, ["doc", "ord"], "left_anti")


def by_position(nodes: DataFrame) -> DataFrame:
    """``nodes`` with place among siblings by start, line and id; missing starts come last."""
    far = F.lit(10**9)
    order = Window.partitionBy("doc", "parent_ord").orderBy(
        F.coalesce("start_index", far), F.coalesce("start_line", F.lit(0)), F.coalesce("node_id", "title", F.lit(""))
    )
    return nodes.withColumn("place", F.row_number().over(order).cast("long"))


def covering_ranges(walk: DataFrame) -> DataFrame:
    """(doc, ord, low, high): the smallest start and largest end among an entry and all entries below it."""
    spread = walk.select("doc", F.explode("path").alias("ord"), "start_index", "end_index")
    return spread.groupBy("doc", "ord").agg(F.min("start_index").alias("low"), F.max("end_index").alias("high"))


def under_front_root(nodes: DataFrame, front: str, need_root: str) -> DataFrame:
    """Front roots of documents that need it are moved below an added root (ord 0, 'Front Matter')."""
    root = (
        nodes.filter(F.col(need_root))
        .groupBy("doc")
        .agg(F.min("first_page").alias("first_page"))
        .select("doc", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("long").alias("parent_ord"), F.lit("Front Matter").alias("title"),
                F.lit(1).cast("long").alias("start_index"), F.greatest(F.col("first_page") - 1, F.lit(1)).cast("long").alias("end_index"))
    )
    moved = nodes.withColumn("parent_ord", F.when(F.col(front) & F.col(need_root) & F.col("parent_ord").isNull(), F.lit(0)).otherwise(F.col("parent_ord")).cast("long"))
    return moved.select("doc", "ord", "parent_ord", "title", "start_index", "end_index").unionByName(root)


def described(nodes: DataFrame, columns: tuple[str, ...] = ("title", "node_id", "summary", "prefix_summary")) -> DataFrame:
    """Only the named columns that there are, in this order."""
    return nodes.select(*(c for c in columns if c in nodes.columns))


def without_text(nodes: DataFrame, dropped: tuple[str, ...] = ("text", "page_number", "start", "end")) -> DataFrame:
    """``nodes`` without texts and working columns."""
    return nodes.drop(*dropped)


def is_contents_span(toc_span, title):
    """Whether a node is marked as, or named like, a table of contents."""
    return F.coalesce(toc_span, F.lit(False)) | (F.lower(F.trim(F.coalesce(title, F.lit("")))) == "table of contents")
