"""Quality of recorded answers: key points, citations, page hits, repeated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_rate(pages: Column) -> Column:
    """The share of requested pages that had been requested before; 0 for none."""
    n = F.size(pages)
    return F.when(n > 0, 1 - F.size(F.array_distinct(pages)) / n).otherwise(F.lit(0.0))


def pages_per_turn(pages: Column, turns: Column) -> Column:
    return F.when(turns > 0, F.size(F.array_distinct(pages)) / turns).otherwise(F.lit(0.0))


def share_in(wanted: Column, among: Column) -> Column:
    """The share of entries (repeats counted) that lie among others; 1 for no entries."""
    hits = F.size(F.filter(wanted, lambda p: F.array_contains(among, p)))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(F.lit(1.0))


def scored(cases: DataFrame) -> DataFrame:
    """Metrics per case (id, answer, key_points, expected_pages, cited_pages, pages_retrieved, all_pages_requested, total_turns)."""
    covered = F.size(F.filter("key_points", lambda k: F.contains(F.lower("answer"), F.lower(k))))
    return cases.select(
        "id",
        covered.cast("long").alias("key_points_covered"),
        F.size("key_points").cast("long").alias("key_points_total"),
        F.size("cited_pages").cast("long").alias("citation_count"),
        share_in(F.col("cited_pages"), F.col("pages_retrieved")).alias("citation_valid_rate"),
        share_in(F.col("expected_pages"), F.col("pages_retrieved")).alias("pages_hit_rate"),
        duplicate_rate(F.col("all_pages_requested")).alias("duplicate_read_rate"),
        pages_per_turn(F.col("all_pages_requested"), F.col("total_turns")).alias("avg_pages_per_turn"),
        "total_turns",
    )


def evaluated(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Metrics of test cases (id, key_points, expected_pages) with their recorded answers (id and the fields of an answer); a case without one scores as empty."""
    own = answers.select("id", "answer", F.transform("citations", lambda c: c["page"]).alias("cited_pages"), "pages_retrieved", "all_pages_requested", "total_turns")
    rows = cases.select("id", "key_points", "expected_pages").join(own, "id", "left")
    none = F.array().cast("array<long>")
    lists = {c: F.coalesce(c, none) for c in ("cited_pages", "pages_retrieved", "all_pages_requested")}
    return scored(rows.withColumns(lists | {"answer": F.coalesce("answer", F.lit("")), "total_turns": F.coalesce("total_turns", F.lit(0).cast("long"))}))


def summary(results: DataFrame) -> DataFrame:
    """One row of unweighted means over cases, in hundredths but for turns and pages; no row without cases."""
    total = F.col("key_points_total")
    coverage = F.when(total > 0, F.col("key_points_covered") / total).otherwise(F.lit(1.0))
    return results.agg(
        F.count("*").alias("cases"),
        (F.avg(coverage) * 100).alias("key_points_coverage"),
        (F.avg("citation_valid_rate") * 100).alias("citation_validity"),
        (F.avg("pages_hit_rate") * 100).alias("page_hit_rate"),
        (F.avg("duplicate_read_rate") * 100).alias("duplicate_read_rate"),
        F.avg("avg_pages_per_turn").alias("pages_per_turn"),
        F.avg("total_turns").alias("turns"),
    ).filter("cases > 0")


def unretrieved(citations: DataFrame, retrieved: DataFrame, same_doc: bool = False) -> DataFrame:
    """Citations (answer_id, doc_name, page) of pages that their answer never retrieved; repeats stay.

    Only pages are compared unless ``same_doc`` is set.
    """
    key = ["answer_id", "page"] + (["doc_name"] if same_doc else [])
    return citations.join(retrieved.select(*key).distinct(), key, "left_anti")
