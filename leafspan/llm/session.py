"""Small helpers shared by the operators: settings, sizes and shared storage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that a Python worker is handed at a time.
BATCH_ROWS = 512

#: Tables of ids and numbers of up to so many rows (some 16 MB) are broadcast, longer ones joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Keys of fewer rows are never called common.
LEAST_HOT = 1000

#: The word of the contracts that split on ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is absent, as in tests on one machine, a temporary
    folder of the application takes its place.
    """
    name = "spark.checkpoint.dir"
    found = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError(f"set {name} to a folder that all executors share")
    return _own_folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="leafspan-"))


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_small(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table`` (a row per key, ``n``: how many of ``rows`` hold it) without tasks that get all rows of a common key.

    Keys that more than ``many`` rows hold are broadcast; as there are at most all / many
    of them, they are no more than BROADCAST_ROWS. Both tables are read more than once.
    """
    many = max(LEAST_HOT, (table.agg(F.sum(n)).first()[0] or 0) // BROADCAST_ROWS + 1)
    marked = rows.join(F.broadcast(table.filter(F.col(n) > many).withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.filter("_hot IS NULL").select(rows.columns).join(table.filter(F.col(n) <= many), key)
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that operators have left in the shared folder; results that were not written yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/leafspan")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to BATCH_ROWS where the setting is higher: texts are long, and workers hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def unsorted_writes(spark: SparkSession):
    """Rows that are written by folder are not sorted by it first: a task has files of a few folders open instead."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column (0 for an empty table); one pass, one long to the driver."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts of ASCII alone go by the quicker ``lower``."""
    letters = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(letters)


def set_aside(docs: DataFrame, *needed: str):
    """(``docs`` with all columns but ``needed`` renamed out of the way, a function that restores names and order)."""
    others = {c: f"other_{i}__" for i, c in enumerate(docs.columns) if c not in needed}

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))

    return docs.toDF(*(others.get(c, c) for c in docs.columns)), restored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
