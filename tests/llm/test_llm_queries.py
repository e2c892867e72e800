"""The registered queries: their columns, a row per document, and their DuckDB statements where there are some."""

from __future__ import annotations

import brute
import pytest
from leafspan.llm import queries
from oracle_check import compare, connection

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    2: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    3: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    4: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    5: "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    6: "doc_id bigint, held_out boolean, lang_pred string, score double",
    7: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    8: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    9: "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    10: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    11: "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    12: "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    13: "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
}
BY_NUMBER = {int(n[2:].split("_")[0]): n for n in queries.queries()}


def test_every_operator_has_one_query():
    assert sorted(BY_NUMBER) == list(range(1, 14)) and len(queries.queries()) == 13


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns_and_rows(spark, number):
    out = queries.queries()[BY_NUMBER[number]](spark, SF).cache()
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[number]
    source, key = ("conversations", "conv_id") if number == 12 else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SF}/{source}.parquet").select(key)
    ids = sorted(r[0] for r in (rows.distinct() if number == 12 else rows).collect())
    assert sorted(r[key] for r in out.collect()) == ids


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_statements(spark, name):
    sql = queries.oracle_sql()[name]
    assert compare(spark, connection(SF), SF, queries.queries()[name], sql) == ""


def test_held_out_languages(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.op6_language_id(spark, SF).collect() if r["held_out"]]
    assert rows and all(brute.crc(r["doc_id"]) % 5 == 0 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
