"""Queries against their statements on tables made larger than the given ones, and the steps that bound them."""

from __future__ import annotations

import random
import re
import shutil
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare
from pyspark.sql import Row

from leafspan import registry
from leafspan.operators import ingest, retrieve, toc, tree
from leafspan.plans import toc_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def headings(path, suppliers: str):
    """A folder with the given regions and nations and made suppliers, and a connection to its tables."""
    con = duckdb.connect()
    for name in ("region", "nation"):
        shutil.copy(f"{SF}/{name}.parquet", path)
    con.execute(f"COPY ({suppliers}) TO '{path}/supplier.parquet' (FORMAT parquet)")
    for name in ("region", "nation", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def supplier(number: int, nation: str) -> str:
    return f"SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, ({nation})::INTEGER AS s_nationkey, 0.0 AS s_acctbal FROM range({number}) t(i)"


@pytest.mark.parametrize("name", ["tree_preorder"])
def test_more_than_ten_thousand_headings(spark, tmp_path, name):
    con = headings(tmp_path, supplier(10_200, "CASE WHEN i % 100 = 0 THEN i // 100 % 25 ELSE 4 END"))
    assert compare(spark, con, str(tmp_path), QUERIES[name], SQL[name]) == ""


def test_trees_over_all_headings(spark, tmp_path):
    """tree_parents and the queries that follow it search all headings, not those of one region."""
    headings(tmp_path, supplier(300, "i % 25"))
    run = lambda name: [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
    rows = sorted((r.asDict() for r in toc_queries._toc(spark, str(tmp_path)).collect()), key=lambda r: r["ord"])
    rows = [r for r in rows if not r["title"].startswith("I")]
    for r in rows:
        k = r["ord"]
        raw = "" if k % 17 == 0 else "1.1" if k % 13 == 0 else f"{r['structure']}.4" if k % 11 == 0 else r["structure"]
        r["number"] = re.sub(r"\.+", ".", raw).strip(".") or None
    parent = {}
    for r in rows:
        above = [q for q in rows if r["number"] and q["number"] and r["number"].startswith(q["number"] + ".")]
        order = lambda q: (-len(q["number"]), q["ord"] >= r["ord"], -q["ord"] if q["ord"] < r["ord"] else q["ord"])  # noqa: B023, E731
        parent[r["ord"]] = min(above, key=order)["ord"] if above else None
    assert {r["ord"]: r["parent_ord"] for r in run("tree_parents")} == parent
    region = {r["ord"]: r["structure"].split(".")[0] for r in rows}
    assert any(p and region[p] != region[k] for k, p in parent.items())
    ways, page = {}, {r["ord"]: r["physical_index"] for r in rows}
    for k in parent:
        ways[k], up = [k], parent[k]
        while up:
            ways[k], up = [up, *ways[k]], parent[up]
    covered = {k: [page[o] for o, way in ways.items() if k in way] for k in parent}
    assert {r["ord"]: (r["low"], r["high"]) for r in run("tree_covering_ranges")} == {k: (min(c), max(c) + 3) for k, c in covered.items()}
    siblings = {}
    for k, p in parent.items():
        siblings.setdefault(p, []).append(k)
    places = {}
    for r in run("tree_by_position"):
        places.setdefault(parent[r["ord"]], []).append(r["place"])
    assert {p: sorted(x) for p, x in places.items()} == {p: list(range(1, len(x) + 1)) for p, x in siblings.items()}
    parts = run("tree_parts")
    assert {r["doc"] for r in parts} == {1} and sorted(r["place"] for r in parts) == list(range(1, len(parts) + 1))
    told = [int(r["node_id"]) for r in sorted(parts, key=lambda r: r["place"]) if not r["is_skeleton"]]
    assert told == sorted(parent, key=lambda k: ways[k])


def test_parents_among_many_of_a_number(spark):
    """Of many entries of a number, the latest before is the parent."""
    rows = [(1, k, "1.1" if k % 2 else f"1.1.{k}", f"t{k}") for k in range(1, 2001)]
    found = tree.parents(spark.createDataFrame(rows, "doc long, ord long, structure string, title string"))
    assert {r["ord"]: r["parent_ord"] for r in found.collect()} == {k: None if k % 2 else k - 1 for k in range(1, 2001)}


def test_offsets_make_no_pairs(spark, tmp_path, monkeypatch):
    """The offset is counted in blocks: pairs of all untitled entries are never made."""

    def made(*_):
        raise AssertionError("pairs are made")

    con = headings(tmp_path, supplier(1500, "i % 25"))
    monkeypatch.setattr(toc, "title_pairs", made)
    for name in ("toc_page_offset", "toc_with_offset"):
        assert compare(spark, con, str(tmp_path), QUERIES[name], SQL[name]) == ""


def test_title_offset_over_blocks(spark, monkeypatch):
    dice = random.Random(3)
    for size in (60, 5):
        a = [(dice.choice([None, "a", "b"]), dice.choice([None, *range(-size, size)]), k) for k in range(50)]
        b = [(dice.choice([None, "a", "c"]), dice.choice([None, *range(size)])) for _ in range(40)]
        pairs = [(i - p, o, i) for t, p, o in a for u, i in b if t == u and p is not None and i is not None and i >= 2]
        count = Counter(d for d, *_ in pairs)
        want = min(pairs, key=lambda x: (-count[x[0]], *x[1:]))[0]
        lists = spark.createDataFrame(a, "title string, page long, ord long"), spark.createDataFrame(b, "title string, physical_index long")
        monkeypatch.setattr(toc, "PAGES", 16)
        assert toc.title_offset(*lists, 2).first()[0] == toc.page_offset(toc.title_pairs(*lists, 2)).first()[0] == want
        monkeypatch.setattr(toc, "CROWD", 4)
        assert sorted(toc.title_pairs(*lists, 2).collect(), key=repr) == sorted(((t, p, i, o) for t, p, o in a for u, i in b if t == u and i is not None and i >= 2), key=lambda r: repr(Row(title=r[0], page=r[1], physical_index=r[2], ord=r[3])))
    assert toc.title_offset(lists[0].limit(0), lists[1], 2).first()[0] is None


def test_products_in_little_memory():
    """A cell's products are held a few queries at a time; equal ones go by chunk."""
    dice = np.random.default_rng(5)
    two = dice.integers(-1, 2, (4096, 4)).astype(np.float32)
    one = dice.integers(-1, 2, (4096, 4)).astype(np.float32)
    ids = dice.permutation(len(two))
    asked = pa.table({"query_id": np.arange(len(one)), "asked": pa.array(list(one))})
    chunks = pa.table({"chunk_id": ids, "node_id": ids % 7, "met": pa.array(list(two))})
    tracemalloc.start()
    try:
        got = retrieve._best_products(50)(None, asked, chunks)
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()
    got = got.to_pydict()
    for q in (0, 77, 4095):
        worth = one[q].astype(float) @ two.T.astype(float)
        best = sorted(range(len(two)), key=lambda i: (-worth[i], ids[i]))[:50]
        assert [c for c, i in zip(got["chunk_id"], got["query_id"], strict=True) if i == q] == [ids[i] for i in best]
    assert len(got["query_id"]) == 4096 * 50 and all(n == c % 7 for n, c in zip(got["node_id"], got["chunk_id"], strict=True))


def test_libraries_are_read_without_joining_all_documents(spark, tmp_path, monkeypatch):
    """Only documents that were built anew are joined when a table is read."""
    pages = spark.createDataFrame([(d, p, f"1.1 A{d}\ntext {p}") for d in (1, 2, 3) for p in (1, 2)], "doc long, page long, text string")
    library = ingest.ingest(pages, str(tmp_path / "library"))
    joined = []
    monkeypatch.setattr(ingest.files, "small", lambda t: joined.append(t.count()) or t)
    assert library.table("pages").count() == 6 and joined == [0]
    again = ingest.ingest(pages.filter("doc = 2"), str(tmp_path / "library"), force=frozenset({"pages"}))
    joined.clear()
    assert again.table("pages").count() == 6 and joined == [1]


def test_shares_of_sections_grow_with_pairs(spark, monkeypatch):
    """A task meets a bounded number of pairs of a question and a section."""
    listed = spark.createDataFrame([(k, 0, ["ab"], ["cd"], ["ef"]) for k in range(50)], "section_id long, block int, t array<string>, x array<string>, later array<string>")
    lists = spark.createDataFrame([(q, 0, "ab", 1, 1, 1, 0, 0) for q in range(4)], "question_id long, block int, word string, n int, n_met long, essential long, rest int, least long")
    dealt, deal = [], type(listed).repartition
    monkeypatch.setattr(type(listed), "repartition", lambda df, *how: dealt.append(how) or deal(df, *how))
    monkeypatch.setattr(retrieve, "PAIRS", 10)
    assert retrieve._candidates(listed, lists).count() == 200 and dealt[0][0] == 20
