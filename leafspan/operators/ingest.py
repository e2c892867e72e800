"""From pages to a library of documents: outline, parts, page windows, registry.

A step is built for the documents that its table lacks. Each build adds the rows of its
documents under a name of its own and notes them under a new batch number; a document's rows are those of its last batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.functions import text as tx
from leafspan.operators import parts, toc, tree
from leafspan.sources import files

STEPS = ["index", "parts", "pages", "registry"]


EVENT = "run string, seq long, at timestamp, step string, state string, batch long"


@dataclass
class Library:
    """Tables of steps below ``path``. Beside each stands a small table of builds (doc, batch, build), the only one that tells which rows count; rows of
    a build that broke off are not named there. What happens is written to a table of events, which streaming.progress reads live.
    """

    spark: SparkSession
    path: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    told: int = 0

    def builds(self, step: str) -> DataFrame:
        """(doc, batch, build): the last batch of each document."""
        rows = self.spark.read.parquet(f"{self.path}/builds/{step}")
        return rows.groupBy("doc").agg(F.max(F.struct("batch", "build")).alias("b")).select("doc", "b.*")

    def batches(self, step: str) -> DataFrame:
        """(doc, batch): the batch that holds each document's rows."""
        return self.builds(step).select("doc", "batch")

    def table(self, step: str) -> DataFrame:
        """The rows of all named builds, but for documents that were built anew later; these alone are joined by document."""
        rows, named = self.spark.read.parquet(f"{self.path}/{step}"), self.spark.read.parquet(f"{self.path}/builds/{step}")
        again = named.groupBy("doc").agg(F.max(F.struct("batch", "build")).alias("b"), F.collect_set("build").alias("all")).filter(F.size("all") > 1)
        stale = again.select("doc", F.explode(F.array_except("all", F.array("b.build"))).alias("build"))
        kept = rows.join(F.broadcast(named.select("build").distinct()), "build", "left_semi")
        return kept.join(files.small(stale), ["doc", "build"], "left_anti").drop("build")

    def has(self, step: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/builds/{step}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def lacking(self, step: str, docs: DataFrame) -> DataFrame:
        """Those of ``docs`` (doc) that the step's table has no rows of."""
        return docs.join(self.builds(step), "doc", "left_anti") if self.has(step) else docs

    def tell(self, step: str, state: str, batch: int | None = None) -> None:
        """Adds an event: a file of its own, so that streams find it at once."""
        self.told += 1
        row = (self.run, self.told, datetime.now(UTC), step, state, batch)
        self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    def events(self) -> DataFrame:
        """All events (EVENT) of all runs."""
        return self.spark.read.schema(EVENT).parquet(f"{self.path}/events")

    def step(self, name: str, build, docs: DataFrame) -> None:
        """Adds the rows that ``build`` makes for ``docs`` (doc) to a step's table; nothing if there are none."""
        if self.has(name) and docs.isEmpty():
            self.tell(name, "skipped")
            return
        batch, own = 1, uuid.uuid4().hex
        if self.has(name):
            batch += self.spark.read.parquet(f"{self.path}/builds/{name}").agg(F.max("batch")).first()[0] or 0
        self.tell(name, "start", batch)
        build(docs).withColumn("build", F.lit(own)).write.mode("append").parquet(f"{self.path}/{name}")
        docs.select("doc", F.lit(batch).alias("batch"), F.lit(own).alias("build")).write.mode("append").parquet(f"{self.path}/builds/{name}")
        self.tell(name, "built", batch)

    def report(self) -> DataFrame:
        """(doc, total_pages, n_nodes, n_parts) of each registered document."""
        nodes = self.table("index").groupBy("doc").agg(F.count("*").alias("n_nodes"))
        made = self.table("parts").groupBy("doc").agg(F.max("part").alias("n_parts"))
        return self.table("registry").join(nodes, "doc", "left").join(made, "doc", "left").select("doc", "total_pages", "n_nodes", "n_parts")


def outline(pages: DataFrame) -> DataFrame:
    """(doc, ord, parent_ord, path, node_id, title, summary, start_index, end_index) by rule.

    Numbered headings make the tree; a document without any gets an entry per page,
    titled with the page's first line.
    """
    found = toc.heading_lines(pages.select("doc", F.col("page").alias("physical_index"), "text")).select("doc", "ord", "structure", "title", "physical_index")
    found = files.saved(found, "headings")
    # texts are read once more, for the short beginnings of pages
    starts = [F.left(F.split("text", "\n").getItem(0), F.lit(80)).alias("title"), F.left(parts.prefix_summary(F.col("text")), F.lit(200)).alias("summary")]
    starts = files.saved(pages.select("doc", F.col("page").alias("start_index"), *starts), "page-starts")
    plain = starts.join(found.select("doc").distinct(), "doc", "left_anti").select(
        "doc", F.col("start_index").alias("ord"), F.lit(None).cast("string").alias("structure"), "title", F.col("start_index").alias("physical_index")
    )
    last = starts.groupBy("doc").agg(F.max("start_index").alias("pages"))
    rows = found.unionByName(plain).join(last, "doc").withColumn("starts_page", F.lit(True))
    ranged = toc.page_ranges(rows).select("doc", "ord", "structure", "title", "start_index", "end_index")
    nodes = files.saved(tree.parents(ranged).select("doc", "ord", "parent_ord", "title", "start_index", "end_index"), "nodes")
    walked = tree.preorder(files.saved(tree.walked(nodes), "walk"))
    return walked.join(starts.drop("title"), ["doc", "start_index"], "left").select(
        "doc", F.col("node_id").cast("long").alias("ord"), "path", "node_id", "title", "summary", "start_index", "end_index"
    )


def ingest(pages: DataFrame, path: str, force: frozenset[str] = frozenset(), part_chars: int = parts.PART_CHARS) -> Library:
    """Adds the documents of pages (doc, page, text) to a library; what a document already has stays as it is. Pages without a document are left out.

    ``force`` names steps that are built anew for all documents of ``pages``. The index and the parts made of it
    are rebuilt together.
    """
    library = Library(pages.sparkSession, path)
    docs = files.saved(pages.select("doc").distinct(), "documents")
    wanted = lambda step, forced=False: files.saved(docs if forced or step in force else library.lacking(step, docs), "lacking")
    both = bool(force & {"index", "parts"})
    unsplit = wanted("parts", both)
    unindexed = files.saved(library.lacking("index", docs).unionAll(unsplit).distinct(), "lacking")
    unpaged, unregistered = wanted("pages"), wanted("registry")
    of = lambda table, some: table.join(some, "doc", "left_semi")
    library.step("index", lambda some: outline(of(pages, some)), unindexed)
    by_id = library.table("index").withColumn("path", F.col("path").cast("array<string>"))
    library.step("parts", lambda some: parts.tree_parts(of(by_id, some), part_chars), unindexed)
    bucket = F.floor((F.col("page") - 1) / 20).cast("int")
    library.step("pages", lambda some: of(pages, some).select("doc", "page", "text", bucket.alias("bucket")), unpaged)
    sizes = [F.max("page").alias("total_pages"), F.sum(tx.token_count(F.col("text"))).alias("n_tokens")]
    library.step("registry", lambda some: of(library.table("pages"), some).groupBy("doc").agg(*sizes), unregistered)
    return library


__all__ = ["Library", "STEPS", "files", "ingest", "outline"]
