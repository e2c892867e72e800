"""Sources and sinks of paged documents. All reading and writing is Spark's, so that any store it knows will do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspan.sources import pdf

def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of ``paths`` that is there, in any store Spark knows; if none is, the first one."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return name
    return paths[0]


PAGES = "doc long, page long, text string, bucket int"


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir, or, where it is not set on one machine, below a temporary one."""
    name = "spark.checkpoint.dir"
    found = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError(f"set {name} to a folder that all executors share")
        found = _own_folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="leafspan-"))
    return found.rstrip("/") + "/leafspan"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for plans that need it more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of so many rows of ids, short words and numbers are broadcast.
FEW = 500_000


def small(table: DataFrame, rows: int = FEW) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``rows`` rows, of bounded size; else it is joined by a shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def write_pages(pages: DataFrame, path: str, size: int = 20) -> None:
    """Pages (doc, page, text) in windows of ``size``, one folder per window number, so that a read of a page opens one."""
    if size <= 0:
        raise ValueError("size must be positive")
    bucket = F.floor((F.col("page") - 1) / size).cast("int")
    pages.withColumn("bucket", bucket).repartition("bucket", "doc").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def pages_wanted(spark: SparkSession, path: str, wanted: DataFrame, size: int = 20) -> DataFrame:
    """Rows of ``wanted`` (doc, page) with their text: joined on the window too, which lets Spark skip all other windows."""
    asked = wanted.withColumn("bucket", F.floor((F.col("page") - 1) / size).cast("int"))
    return asked.join(read_pages(spark, path), ["doc", "page", "bucket"], "left").drop("bucket")


def write_parts(parts: DataFrame, path: str) -> None:
    """Parts of trees, one folder per document and part."""
    parts.write.mode("overwrite").partitionBy("doc", "part").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc, total_parts, files) of written parts, from the folders' names alone."""
    parts = spark.read.schema("doc long, part long, node_id string").json(path).select("doc", "part").distinct()
    name = F.concat(F.lit("part_"), F.lpad(F.col("part").cast("string"), 4, "0"), F.lit(".json"))
    return parts.groupBy("doc").agg(F.count("*").alias("total_parts"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("files"))


def append_json(rows: DataFrame, path: str) -> None:
    """Appends rows; a failed write leaves none of them."""
    rows.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON rows by a declared schema. A record that does not parse is an error; ``broken_json`` lists such records."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, record): the lines below ``path`` that do not parse by the schema."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields.fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))
    parsed = F.from_json("record", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.filter(F.trim("record") != "").withColumn("_p", parsed).filter("_p._broken IS NOT NULL").select("file", "record")


NODE = "node_id string, title string, display_title string, raw_title string, full_title string, summary string, start_index string, end_index string"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, depth, path, node_id, title, summary, start_index, end_index) from index files of nested nodes.

    Children are the lists ``children`` and ``nodes`` one after the other; a title falls back over its
    variants; positions that are no whole numbers are null. Levels are unnested one at a time, as deep
    as they go; each is written before the next one, so that files are parsed once.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    get = lambda c, name, kind="string": F.try_variant_get(c, f"$.{name}", kind)

    def listed(c):
        empty = F.array().cast("array<variant>")
        return F.concat(*(F.coalesce(F.try_variant_get(c, f"$.{k}", "array<variant>"), empty) for k in ("children", "nodes")))

    top = F.posexplode(F.try_variant_get("v", "$.structure", "array<variant>")).alias("i", "n")
    level = saved(raw.select(get(F.col("v"), "doc_name").alias("doc_name"), top, F.array().cast("array<int>").alias("path")), "nodes")
    out, depth = None, 1
    while True:
        rows = level.select("doc_name", F.lit(depth).alias("depth"), F.concat("path", F.array("i")).alias("path"), "n")
        n = F.col("n")
        title = F.coalesce(*(F.nullif(get(n, k), F.lit("")) for k in ("title", "display_title", "raw_title", "full_title")), F.lit(""))
        plain = rows.select("doc_name", "depth", "path", get(n, "node_id").alias("node_id"), title.alias("title"), get(n, "summary").alias("summary"), get(n, "start_index", "long").alias("start_index"), get(n, "end_index", "long").alias("end_index"))
        out = plain if out is None else out.unionAll(plain)
        level = saved(rows.select("doc_name", "path", F.posexplode(listed(n)).alias("i", "n")), "nodes")
        if level.isEmpty():
            return out
        depth += 1


def parsed_html(pages: DataFrame) -> DataFrame:
    """(page_id, title, n_lines, text) of web pages (page_id, html): the first heading, and paragraphs as lines."""
    bare = lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))
    lines = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), bare)
    return pages.select(
        "page_id",
        F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("title"),
        F.size(lines).cast("long").alias("n_lines"),
        F.array_join(lines, "\n").alias("text"),
    )


Parser = Callable[[bytes], Iterable[tuple[str, list[str], list[bytes]]]]


def text_pages(content: bytes) -> Iterable[tuple[str, list[str], list[bytes]]]:
    """Pages of a plain text, cut at form feeds; no tables or images."""
    for page in content.decode(errors="replace").split("\f"):
        yield page, [], []


def parsed_files(spark: SparkSession, path: str, parser: Parser = text_pages, pattern: str = "*") -> DataFrame:
    """(doc_name, page, text, tables, images) of the files below ``path``, by any parser of one file's bytes.

    A file that the parser rejects gives one row with its error and no page.
    """

    def parse(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = row["path"].rsplit("/", 1)[-1]
                try:
                    found = [(name, i + 1, t or "", list(tables or []), [f"page_{i + 1}_img_{k + 1}" for k in range(len(images or []))], None) for i, (t, tables, images) in enumerate(parser(row["content"]))]
                except Exception as error:  # noqa: BLE001
                    found = [(name, None, None, [], [], f"{type(error).__name__}: {error}")]
                for f in found:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True))], schema=schema)

    schema = pa.schema([("doc_name", pa.string()), ("page", pa.int64()), ("text", pa.string()), ("tables", pa.list_(pa.string())), ("images", pa.list_(pa.string())), ("error", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(parse, "doc_name string, page long, text string, tables array<string>, images array<string>, error string")


def _of_files(spark: SparkSession, path: str, pattern: str, schema: pa.Schema, ddl: str, rows) -> DataFrame:
    """A row for each that ``rows`` makes of a file's name and bytes; a file that it rejects gives one row with its error."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = row["path"].rsplit("/", 1)[-1]
                try:
                    found = [(*r, None) for r in rows(name, row["content"])]
                except Exception as error:  # noqa: BLE001
                    found = [(name, *[None] * (len(schema) - 2), f"{type(error).__name__}: {error}")]
                for f in found:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True))], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(read, ddl)


def file_images(spark: SparkSession, path: str, parser: Parser, pattern: str = "*") -> DataFrame:
    """(doc_name, page, image, content, error): the bytes of the images that ``parsed_files`` names."""
    schema = pa.schema([("doc_name", pa.string()), ("page", pa.int64()), ("image", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def rows(name, content):
        for i, (_, _, images) in enumerate(parser(content)):
            for k, image in enumerate(images or []):
                yield name, i + 1, f"page_{i + 1}_img_{k + 1}", image

    return _of_files(spark, path, pattern, schema, "doc_name string, page long, image string, content binary, error string", rows)


def pdf_bookmarks(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_name, ord, level, title, page, error) of the bookmarks of PDF files, as ``outline.from_bookmarks`` takes them."""
    schema = pa.schema([("doc_name", pa.string()), ("ord", pa.int64()), ("level", pa.int64()), ("title", pa.string()), ("page", pa.int64()), ("error", pa.string())])

    def rows(name, content):
        for i, (level, title, page) in enumerate(pdf.Pdf(content).bookmarks()):
            yield name, i + 1, level, title, page

    return _of_files(spark, path, pattern, schema, "doc_name string, ord long, level long, title string, page long, error string", rows)


def pdf_titles(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_name, title, total_pages, error) of PDF files; a file without a title goes by Untitled."""
    schema = pa.schema([("doc_name", pa.string()), ("title", pa.string()), ("total_pages", pa.int64()), ("error", pa.string())])

    def rows(name, content):
        found = pdf.Pdf(content)
        yield name, found.title() or "Untitled", len(found.pages())

    return _of_files(spark, path, pattern, schema, "doc_name string, title string, total_pages long, error string", rows)
