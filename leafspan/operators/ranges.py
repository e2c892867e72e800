"""Pages and page ranges: which nodes cover which pages, and the texts of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as tx


def covering(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes (doc, start_index, end_index, ...) whose range holds one of the pages (doc, page); each once.

    Ranges are listed page by page and joined on equality, so that the join is
    dealt out by (doc, page) whatever the lengths.
    """
    key = [c for c in nodes.columns]
    listed = nodes.filter("start_index <= end_index").withColumn("page", F.explode(F.sequence("start_index", "end_index")))
    return listed.join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_semi").select(*key).distinct()


def texts(nodes: DataFrame, pages: DataFrame, key: list[str], tagged: bool = False) -> DataFrame:
    """(key..., text): the pages of each node's range in order, joined; tagged with their numbers if asked."""
    n = F.col("page").cast("string")
    body = F.concat(F.lit("<physical_index_"), n, F.lit(">\n"), "text", F.lit("\n<physical_index_"), n, F.lit(">\n")) if tagged else F.col("text")
    listed = nodes.filter("start_index <= end_index").select("doc", *key, F.explode(F.sequence("start_index", "end_index")).alias("page"))
    parts = listed.join(pages.select("doc", "page", "text"), ["doc", "page"]).withColumn("part", body)
    grouped = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page", "part"))).alias("p"))
    return grouped.select(*key, F.array_join("p.part", "").alias("text"))


def windows(pages: DataFrame, size: int) -> DataFrame:
    """(doc, chunk_id 'a-b', start_page, end_page, n_pages): pages in windows of ``size``, the last one as long as it is."""
    if size <= 0:
        raise ValueError("size must be positive")
    bucket = F.floor((F.col("page") - 1) / size)
    out = pages.groupBy("doc", bucket.alias("bucket")).agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_pages")
    )
    return out.withColumn("chunk_id", F.concat_ws("-", F.col("start_page").cast("string"), F.col("end_page").cast("string"))).drop("bucket")


def contents(requests: DataFrame, pages: DataFrame, clip) -> DataFrame:
    """(request, place, page, text): the pages of each request's list in its order, with a note for pages that are missing."""
    asked = requests.select("request", "doc", F.posexplode("pages").alias("place", "page"))
    found = asked.join(pages.select("doc", "page", F.col("text").alias("_text")), ["doc", "page"], "left")
    missing = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(" data not found in content files]"))
    return found.select("request", F.col("place").cast("long").alias("place"), "page", F.coalesce(clip(F.col("_text")), missing).alias("text"))


def sliced_texts(nodes: DataFrame, pages: DataFrame, key: list[str], tagged: bool = False) -> DataFrame:
    """(key..., text): the lines of each node: its first page from start_line, its last to end_line, whole pages between.

    Parts are trimmed, blank ones left out, the rest joined by blank lines; lines count from 0, a missing
    start_line is the first line and a missing end_line the last.
    """
    listed = nodes.filter("start_index <= end_index").select(
        "doc", *key, "start_index", "end_index", "start_line", "end_line", F.explode(F.sequence("start_index", "end_index")).alias("page")
    )
    rows = listed.join(pages.select("doc", "page", "text"), ["doc", "page"])
    low = F.when(F.col("page") == F.col("start_index"), F.coalesce("start_line", F.lit(0))).otherwise(F.lit(0))
    high = F.when(F.col("page") == F.col("end_index"), F.coalesce("end_line", F.lit(1 << 30))).otherwise(F.lit(1 << 30))
    body = tx.lines_between(F.col("text"), low.cast("int"), high.cast("int"))
    n = F.col("page").cast("string")
    part = F.concat(F.lit("<physical_index_"), n, F.lit(">\n"), body, F.lit("\n<physical_index_"), n, F.lit(">")) if tagged else body
    parts = rows.withColumn("part", F.when(body != "", part)).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("page", "part")))).alias("p")
    )
    return parts.select(*key, F.array_join("p.part", "\n\n").alias("text"))
