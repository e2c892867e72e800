"""The operators' queries: each applies its operator to the whole of its table.

The operators keep their own interfaces; the queries derive the contracts'
columns from their outputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.session import documents


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.near_dedup import near_duplicate_classes

    return near_duplicate_classes(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.lm_score import scores

    return scores(documents(spark, sf_dir))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.shards import shards

    return shards(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm import pii

    return pii.digest(pii.spans(documents(spark, sf_dir)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.substring_dedup import repeated_passages

    return repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.language_id import languages

    return languages(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judged(documents(spark, sf_dir), labels, ["doc_id"]).select("doc_id", *names, "base_failed", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm import token_files

    docs = documents(spark, sf_dir)
    return token_files.read_back(token_files.write(docs), docs)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm import decontaminate

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.contamination(documents(spark, sf_dir), items))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.mixture import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def planted_runs(doc_id: int | None, n: int) -> np.ndarray | None:
    """op11's damage: which word of a text of n words is read at each place; None where the text stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g, at = h // 10, np.arange(n)
    a = g % n
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.periodic import periodic_runs

    runs = periodic_runs(documents(spark, sf_dir), planted_runs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """op12's damage to turns, by what crc32 of conv_id and turn leaves modulo 20."""
    space = F.lit(" ")
    k = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("_", "times")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm.conversation_repair import audits

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = audits(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafspan.llm import licenses

    return licenses.digest(licenses.licenses(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from leafspan.llm import oracles

    return {name: sql for name, sql in vars(oracles).items() if name.startswith("op") and isinstance(sql, str)}
