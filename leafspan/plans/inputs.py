"""The engine's tables as views of the given ones, for Spark and as DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of a document's text that make one page.
LINES_PER_PAGE = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, page_num, text): the lines of each text in pages of ``lines_per_page`` lines."""
    lines = F.split("text", "\n", -1)
    page = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines_per_page).cast("int")),
        lambda i: F.array_join(F.slice(F.col("lines"), i * lines_per_page + 1, lines_per_page), "\n"),
    )
    return (
        docs.filter("text IS NOT NULL")
        .select("doc_id", lines.alias("lines"))
        .select("doc_id", F.posexplode(page).alias("pos", "text"))
        .select("doc_id", (F.col("pos") + 1).cast("long").alias("page_num"), "text")
    )


PAGES = r"""
pages_v AS MATERIALIZED (
  SELECT doc_id, page_num, array_to_string(lines[(page_num - 1) * 5 + 1:page_num * 5], chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines,
          unnest(range(1, ((len(string_split(text, chr(10))) - 1) // 5 + 2)::BIGINT)) AS page_num
        FROM documents WHERE text IS NOT NULL))"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(read(spark, sf_dir, "documents").select("doc_id", "text"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat table of contents (ord, structure, title, physical_index, starts_page) from region, nation and supplier."""
    region = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("a"), F.col("r_regionkey").alias("r"), "r_name")
    nation = read(spark, sf_dir, "nation").select(
        F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("b"), "n_nationkey", "n_regionkey", "n_name"
    )
    supplier = read(spark, sf_dir, "supplier").select(
        F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("c"), "s_nationkey", "s_name"
    )
    zero = F.lit(0)
    two = region.join(nation, F.col("r") == F.col("n_regionkey"))
    three = two.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"))
    rows = (
        region.select("a", zero.alias("b"), zero.alias("c"), F.col("r_name").alias("title"))
        .unionAll(two.select("a", "b", zero.alias("c"), F.col("n_name").alias("title")))
        .unionAll(three.select("a", "b", "c", F.col("s_name").alias("title")))
    )
    number = F.concat_ws(".", F.col("a"), F.when(F.col("b") > 0, F.col("b")), F.when(F.col("c") > 0, F.col("c")))
    # numbered within each region, after all entries of the regions before it, which are as few as regions
    within = F.row_number().over(Window.partitionBy("a").orderBy("b", "c")).cast("long")
    sizes = rows.groupBy("a").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(F.broadcast(sizes.alias("y")), F.col("y.a") < F.col("x.a"), "left").groupBy("x.a").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    rows = rows.withColumn("_k", within).join(F.broadcast(before), "a").select(number.alias("structure"), "title", (F.col("_k") + F.col("before")).alias("ord"))
    return rows.select(
        "ord",
        "structure",
        "title",
        F.floor(F.col("ord") * 3 / 2).cast("long").alias("physical_index"),
        (F.col("ord") % 2 == 0).alias("starts_page"),
    )


HEADINGS = r"""
headings_v AS MATERIALIZED (
  SELECT ord, structure, title, (ord * 3) // 2 AS physical_index, ord % 2 = 0 AS starts_page FROM (
    SELECT row_number() OVER (ORDER BY a, b, c) AS ord,
      concat_ws('.', a::VARCHAR, CASE WHEN b > 0 THEN b::VARCHAR END, CASE WHEN c > 0 THEN c::VARCHAR END) AS structure, title
    FROM (
      SELECT r_regionkey + 1 AS a, 0 AS b, 0 AS c, r_name AS title FROM region
      UNION ALL
      SELECT n_regionkey + 1, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0, n_name FROM nation
      UNION ALL
      SELECT n_regionkey + 1, b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), s_name
      FROM supplier JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)
        ON n_nationkey = s_nationkey)))"""


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, tool, page) from events: seq numbers a user's events by time, page is the property k."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("event_type").alias("tool"),
        F.get_json_object("props", "$.k").cast("long").alias("page"),
    )


CALLS = r"""
calls_v AS MATERIALIZED (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS tool,
    json_extract_string(props, '$.k')::BIGINT AS page FROM events)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, answer): a document's text with citations of pages that depend on its id, and sometimes an invitation."""
    k = F.col("doc_id")
    tag = lambda page: F.concat(F.lit('<cite doc="'), F.col("source"), F.lit('" page="'), page.cast("string"), F.lit('"/>'))
    return (
        read(spark, sf_dir, "documents")
        .filter("text IS NOT NULL")
        .select(
            "doc_id",
            F.concat(
                "text",
                F.lit(" "),
                tag(k % 7 + 1),
                F.lit(" and more."),
                F.when(k % 3 == 0, F.concat(F.lit(" Also "), tag(k % 5 + 3))).otherwise(F.lit("")),
                F.when(k % 2 == 0, F.lit("\n\nLet me know if table 12 helps.")).otherwise(F.lit("")),
            ).alias("answer"),
        )
    )


ANSWERS = r"""
answers_v AS MATERIALIZED (
  SELECT doc_id, text || ' ' || '<cite doc="' || source || '" page="' || (doc_id % 7 + 1) || '"/>' || ' and more.'
    || CASE WHEN doc_id % 3 = 0 THEN ' Also <cite doc="' || source || '" page="' || (doc_id % 5 + 3) || '"/>' ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Let me know if table 12 helps.' ELSE '' END AS answer
  FROM documents WHERE text IS NOT NULL)"""


def partial_ratios(keys: str, pairs: str) -> str:
    """Views of a statement, the last of them ratios_v (keys, ratio): how well each pair's ``title`` is found in its ``head``.

    The shorter text s is held against every stretch of the longer one that is no longer than s; their longest common subsequence comes from bit rows.
    """
    common = """length(s) - bit_count(list_reduce(string_split(w, ''), lambda x, c: ((x + (x & coalesce(m[c], 0::HUGEINT))) | (x - (x & coalesce(m[c], 0::HUGEINT)))) & f, f))"""
    bits = "list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN s[i] = c THEN 1::HUGEINT << (i - 1)::HUGEINT ELSE 0::HUGEINT END))::HUGEINT"
    return f"""
shorter_v AS (SELECT {keys}, CASE WHEN length(title) > length(head) THEN head ELSE title END AS s, CASE WHEN length(title) > length(head) THEN title ELSE head END AS l FROM ({pairs})),
masks_v AS (SELECT *, (1::HUGEINT << length(s)::HUGEINT) - 1 AS f, map_from_entries(list_transform(list_distinct(string_split(s, '')), lambda c: {{'k': c, 'v': {bits}}})) AS m FROM shorter_v),
stretches_v AS (SELECT {keys}, s, f, m, substring(l, greatest(k, 0) + 1, k + length(s) - greatest(k, 0)) AS w FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS k FROM masks_v)),
ratios_v AS (SELECT {keys}, max(200.0 * ({common}) / (length(s) + length(w))) AS ratio FROM stretches_v GROUP BY ALL)"""
