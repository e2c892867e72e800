"""Folds and expressions on hand-made cases."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafspan import records
from leafspan.functions import pages as pg
from leafspan.functions import replies as rp
from leafspan.functions import text as tx
from leafspan.operators import conversations, dialog, evaluation, ingest, models, outline, parts, ranges, retrieve, state, toc, tools, tree
from leafspan.sources import files

quick = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def groups_of(tokens, most, overlap=1):
    """Plain version: groups as lists of 0-based pages."""
    total = sum(tokens)
    if total <= most:
        return [list(range(len(tokens)))]
    count = -(-total // most)
    aim = -(-(total / count + most) // 2)
    out, now = [], []
    for i, n in enumerate(tokens):
        if sum(tokens[p] for p in now) + n > aim:
            out.append(now)
            now = list(range(max(i - overlap, 0), i))
        now = [*now, i]
    return [*out, now]


@pytest.mark.parametrize("most,overlap", [(10, 1), (25, 1), (25, 0), (40, 2)])
def test_page_groups(spark, most, overlap):
    rng = random.Random(most + overlap)
    docs = {d: [rng.randrange(1, 14) for _ in range(rng.randrange(1, 20))] for d in range(12)} | {99: [60, 1, 1]}
    rows = [(d, p + 1, n) for d, t in docs.items() for p, n in enumerate(t)]
    got = {}
    for r in parts.page_groups(spark.createDataFrame(rows, "doc long, page long, n_tokens long"), most, overlap).collect():
        got.setdefault(r["doc"], []).append((r["group_no"], r["first_page"], r["last_page"], r["n_pages"]))
    for d, t in docs.items():
        want = [(k + 1, g[0] + 1 if g else None, g[-1] + 1 if g else None, len(g)) for k, g in enumerate(groups_of(t, most, overlap))]
        assert sorted(got[d]) == want


NODE = "doc long, ord long, node_id string, path array<string>, title string, summary string, start_index long, end_index long"


def test_tree_parts(spark):
    def node(i, *path):
        return (1, i, path[-1], list(path), "T" * 20, "S" * 30, None, None)

    nodes = [node(0, "a"), node(1, "a", "b"), node(2, "a", "b", "c"), node(3, "a", "d"), node(4, "e")]
    full = parts._size({"node_id": "a", "title": "T" * 20, "summary": "S" * 30, "is_skeleton": False})
    got = parts.tree_parts(spark.createDataFrame(nodes, NODE), most=2 * full).orderBy("part", "place").collect()
    listed = [(r["part"], r["node_id"], r["parent_path"], r["is_skeleton"]) for r in got]
    assert listed == [
        (1, "a", "", False),
        (1, "b", "a", False),
        (2, "a", "", True),
        (2, "b", "a", True),
        (2, "c", "a/b", False),
        (3, "a", "", True),
        (3, "d", "a", False),
        (4, "e", "", False),
    ]
    whole = parts.tree_parts(spark.createDataFrame(nodes, NODE), most=10**6)
    assert whole.filter("is_skeleton").count() == 0 and whole.agg(F.max("part")).first()[0] == 1
    single = parts.tree_parts(spark.createDataFrame(nodes, NODE), most=1)
    assert single.filter("NOT is_skeleton").count() == 5
    with pytest.raises(ValueError):
        parts.tree_parts(spark.createDataFrame(nodes, NODE), most=0)


def test_context_summaries(spark):
    schema = "session_id long, place long, title string, summary string, start_index long, end_index long, status string"
    nodes = spark.createDataFrame(
        [(1, 1, "A", "aaa", 1, 2, "read_complete"), (1, 2, "B", None, 3, 4, "discovered"), (1, 3, "C", "c" * 40, 5, 6, "reading"), (1, 4, "D", None, 0, 0, "discovered")],
        schema,
    )
    known = spark.createDataFrame([(1, [1], "1-2")], "session_id long, visited_parts array<long>, ranges string")
    whole = parts.context_summaries(nodes, known, 4000).first()
    assert whole["summary"] == (
        "## 已读节点\n\n- A (pp.1-2): aaa\n- C (pp.5-6): " + "c" * 40 + "\n\n## 文档目录\n\n- B (pp.3-4)\n\n已读页面: 1-2"
    )
    assert (whole["n_nodes"], whole["total_chars"]) == (3, len(whole["summary"]))
    # what is only discovered goes first, then the last one
    assert "B (" not in parts.context_summaries(nodes, known, whole["total_chars"] - 1).first()["summary"]
    assert parts.context_summaries(nodes, known, 50).first()["n_nodes"] == 1
    assert parts.context_summaries(nodes, known, 0).first()["summary"] == ""


def prefix(text):
    limit, out = len(text) // 2, ""
    own = [p.strip() for p in text.split("\n\n") if p.strip()]
    if not limit:
        return ""
    if not own:
        return text[:limit]
    for p in own:
        longer = f"{out}\n\n{p}" if out else p
        if len(longer) > limit:
            return out or p[:limit]
        out = longer
    return out


@quick
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=8))
def test_prefix_summary(spark, texts):
    got = values(spark, [(t,) for t in texts], "t string", "t", parts.prefix_summary(F.col("t")))
    assert got == [(t, prefix(t)) for t in texts]


@quick
@given(st.lists(st.text("a\n", max_size=60), min_size=1, max_size=8))
def test_clipped(spark, texts):
    def plain(t, limit=20):
        if len(t) <= limit:
            return t
        cut = max(t.rfind("\n\n", 0, limit), -1)
        cut = cut if cut >= 0 else t.rfind("\n", 0, limit)
        cut = cut if cut >= 0 else limit
        return t[:cut] + tx.CLIP_NOTE[0] + str(len(t)) + tx.CLIP_NOTE[1] + str(cut) + tx.CLIP_NOTE[2]

    assert values(spark, [(t,) for t in texts], "t string", "t", tx.clipped(F.col("t"), 20)) == [(t, plain(t)) for t in texts]


@quick
@given(st.lists(st.lists(st.integers(1, 30), max_size=12), min_size=1, max_size=6))
def test_ranges_text(spark, lists):
    def plain(p):
        p, out = sorted(set(p)), []
        for x in p:
            if out and out[-1][1] == x - 1:
                out[-1][1] = x
            else:
                out.append([x, x])
        return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in out)

    got = values(spark, [(p,) for p in lists], "p array<int>", "p", pg.ranges_text(F.col("p")))
    assert [g[1] for g in got] == [plain(p) for p in lists]


def test_page_specs(spark):
    cases = {"7": [7], "7-9": [7, 8, 9], "9,7,7": [7, 7, 9], "": None, "7,": None, "11-7": None, "7,9-11": None, "-5": None, "x": None}
    got = dict(values(spark, [(s,) for s in cases], "s string", "s", pg.page_list(F.col("s"))))
    assert got == cases
    loose = {"9, 7,x,7": [9, 7, 7], "": [], "11-7": [], None: [], "3-4": [3, 4]}
    assert dict(values(spark, [(s,) for s in loose], "s string", "s", pg.lenient_page_list(F.col("s")))) == loose


def test_evaluation_of_nothing(spark):
    none = "array<int>"
    schema = f"id long, answer string, key_points array<string>, expected_pages {none}, cited_pages {none}, pages_retrieved {none}, all_pages_requested {none}, total_turns long"
    r = evaluation.scored(spark.createDataFrame([(1, "x", [], [], [], [], [], 0)], schema)).first()
    assert (r["citation_valid_rate"], r["pages_hit_rate"], r["duplicate_read_rate"], r["avg_pages_per_turn"]) == (1.0, 1.0, 0.0, 0.0)
    r = evaluation.scored(spark.createDataFrame([(1, "Point A b", ["point a", "z"], [1, 3], [1, 9], [1, 2], [1, 2, 1, 2], 2)], schema)).first()
    assert tuple(r)[1:8] == (1, 2, 2, 0.5, 0.5, 0.5, 1.0)
    assert evaluation.summary(evaluation.scored(spark.createDataFrame([], schema))).count() == 0


def test_unretrieved_by_document(spark):
    cited = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, "a")], "answer_id long, page long, doc_name string")
    read = spark.createDataFrame([(1, 5, "a")], "answer_id long, page long, doc_name string")
    assert evaluation.unretrieved(cited, read).count() == 1
    assert evaluation.unretrieved(cited, read, same_doc=True).count() == 2


def test_page_offset_ties(spark):
    rows = [("a", 1, 4, 1), ("b", 2, 4, 2), ("c", 3, 5, 3), ("d", 4, 7, 4)]
    pairs = spark.createDataFrame(rows, "title string, page long, physical_index long, ord long")
    assert toc.page_offset(pairs).first()[0] == 3  # met before 2, as often
    assert toc.page_offset(pairs.limit(0)).first()[0] is None


def test_parents(spark):
    rows = [(1, 1, "1", "a"), (1, 2, "1.1.1", "b"), (1, 3, "1.1", "c"), (1, 4, "1.1.2", "d"), (1, 5, None, "e"), (1, 6, "2.1", "f"), (1, 7, " 1..1.3. ", "g")]
    got = {r["ord"]: (r["structure"], r["parent_ord"]) for r in tree.parents(spark.createDataFrame(rows, "doc long, ord long, structure string, title string")).collect()}
    assert got == {1: ("1", None), 2: ("1.1.1", 3), 3: ("1.1", 1), 4: ("1.1.2", 3), 5: (None, None), 6: ("2.1", None), 7: ("1.1.3", 3)}


def test_bookmark_levels(spark):
    marks = [(1, 3, "A", 1), (2, 3, "B", 2), (3, 1, "2. C", 3), (4, 2, "D", 4), (5, 2, "d", 4), (6, 2, "D", 4), (7, 1, "Preface", 5), (8, 4, "E", 6), (9, 1, " ", 6), (10, 0, "x", 1)]
    rows = spark.createDataFrame([(1, *m) for m in marks], "doc long, ord long, level long, title string, page long")
    got = [(r["structure"], r["title"], r["physical_index"]) for r in outline.from_bookmarks(rows).orderBy("ord").collect()]
    assert got == [(None, "A", 1), (None, "B", 2), ("2", "C", 3), ("2.1", "D", 4), ("2.2", "d", 4), ("2.3", "D", 4), (None, "Preface", 5), ("3.1", "E", 6)]


def test_node_upserts_keep_summaries(spark):
    schema = "doc long, node_id string, seq long, title string, start_index long, end_index long, summary string, is_skeleton boolean, parent_path string, turn_id string"

    def event(seq, summary, skeleton, node="n"):
        return (1, node, seq, f"t{seq}", 1, 2, summary, skeleton, "", f"turn{seq}")

    one = lambda *events: state.upserted(spark.createDataFrame(list(events), schema)).first()
    assert one(event(1, "first", True), event(2, "later", True))["summary"] == "first"
    assert one(event(1, "first", True), event(2, "full", False), event(3, "x", True))["summary"] == "full"
    gone = one(event(1, "first", True), event(2, None, False))
    assert gone["summary"] is None and (gone["title"], gone["first_seen_turn_id"], gone["last_seen_turn_id"]) == ("t2", "turn1", "turn2")
    made = one(event(1, "s", False, node=None))
    assert made["node_id"].startswith("tmp_") and len(made["node_id"]) == 16 and made["is_provisional_id"]


def test_status_counts_calls(spark):
    nodes = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 6, 10), (1, "c", 20, 30)], "session_id long, node_id string, start_index long, end_index long")
    calls = spark.createDataFrame([(1, 1, 4), (1, 1, 5), (1, 1, 6), (1, 2, 6)], "session_id long, seq long, page long")
    got = {r["node_id"]: (r["read_count"], r["status"]) for r in state.read_status(nodes, calls).collect()}
    assert got == {"a": (1, "reading"), "b": (2, "read_complete"), "c": (0, "discovered")}


def test_unmatched_questions_get_the_first_sections(spark):
    sections = spark.createDataFrame([(i, i, f"title {i}", "some words") for i in range(8)], "section_id long, ord long, title string, text string")
    asked = spark.createDataFrame([(1, "zzz qqq"), (2, "title 3"), (3, "some words"), (4, "itl"), (5, "e 5"), (6, "ome wor"), (7, " ")], "question_id long, text string")
    got = {}
    for r in retrieve.top_sections(sections, asked, 2).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["section_id"], r["score"]))
    assert got[1] == [(0, 0), (1, 0)] and got[3] == [(0, 4), (1, 4)]
    assert got[2][0] == (3, 5)  # the word twice and the phrase in the title
    assert got[4] == [(0, 3), (1, 3)] and got[5][0] == (5, 3) and got[6] == [(0, 2), (1, 2)] and got[7] == [(0, 0), (1, 0)]


def test_history_cuts_before_it_filters(spark):
    rows = [(1, i, "user" if i % 2 else "tool", "x" if i != 9 else "  ") for i in range(12)]
    got = conversations.history(spark.createDataFrame(rows, "conversation_id long, seq long, role string, content string"))
    assert sorted(r["seq"] for r in got.collect()) == [5, 7, 11]


def test_tools_and_models(spark):
    calls = spark.createDataFrame([("double", 2), ("nope", 3), (None, 4)], "tool string, n long")
    box = tools.Tools()
    box.add("double", lambda n: (n * 2).cast("string"))
    got = [(r["result"], r["error"]) for r in box.run(calls, "tool", "n").collect()]
    assert got == [("4", None), (None, "Unknown tool: nope"), (None, "Unknown tool: ")]

    def model(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    asked = models.asked(spark.createDataFrame([("a",), ("bad",)], "p string"), "p", model, limits=models.Limits(pause=0))
    assert sorted((r["p"], r["reply"], r["error"]) for r in asked.collect()) == [("a", "A", None), ("bad", None, "ValueError: no")]
    log = [(1, 1, "user", "q", None), (1, 2, "assistant", "", "view"), (1, 3, "assistant", "done", None), (2, 1, "assistant", "", "view")]
    messages = spark.createDataFrame(log, "session_id long, seq long, role string, content string, tool string")
    got = {r["session_id"]: (r["turns"], r["answer"], r["tools"]) for r in tools.replayed(messages).collect()}
    assert got == {1: (2, "done", "view"), 2: (1, None, "view")}


def test_reply_json(spark):
    cases = {'x ```json {"a": None} ``` y': '{"a": null}', '{"a":[1,],}': '{"a":[1]}', "none": "{}", "": "{}"}
    got = dict(values(spark, [(c,) for c in cases], "t string", "t", rp.json_text(F.col("t"))))
    assert got == cases


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, p, f"p{p}") for p in range(1, 48)], "doc long, page long, text string")
    files.write_pages(pages, f"{tmp_path}/pages", 20)
    wanted = spark.createDataFrame([(1, 3), (1, 45), (1, 99)], "doc long, page long")
    got = {r["page"]: r["text"] for r in files.pages_wanted(spark, f"{tmp_path}/pages", wanted).collect()}
    assert got == {3: "p3", 45: "p45", 99: None}
    plan = files.read_pages(spark, f"{tmp_path}/pages").filter("bucket = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\x0ctwo")
    (tmp_path / "in" / "b.txt").write_bytes(b"bad")

    def parser(content):
        if content == b"bad":
            raise ValueError("no pages")
        return files.text_pages(content)

    rows = files.parsed_files(spark, f"file://{tmp_path}/in", parser).orderBy("doc_name", "page").collect()
    assert [(r["doc_name"], r["page"], r["text"], r["error"]) for r in rows] == [("a.txt", 1, "one", None), ("a.txt", 2, "two", None), ("b.txt", None, None, "ValueError: no pages")]
    index = '{"doc_name": "d", "structure": [{"node_id": "1", "raw_title": "A", "start_index": 3, "end_index": "x", "nodes": [{"node_id": "1.1", "title": "B", "children": [{"title": "C"}]}]}]}'
    (tmp_path / "index.json").write_text(index)
    rows = files.read_index(spark, f"file://{tmp_path}/index.json").orderBy("depth").collect()
    assert [(r["depth"], r["title"], r["node_id"], r["start_index"], r["end_index"]) for r in rows] == [(1, "A", "1", 3, None), (2, "B", "1.1", None, None), (3, "C", None, None, None)]


def test_ingest_skips_finished_steps(spark, tmp_path):
    text = "1.1 First\nwords here\n1.2 Second\nmore"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "1.2.1 Third ..... 9\nend"), (2, 1, "plain page")], "doc long, page long, text string")
    library = ingest.ingest(pages, f"file://{tmp_path}/lib")
    told = lambda lib: [(r["step"], r["state"]) for r in lib.events().filter(F.col("run") == lib.run).orderBy("seq").collect()]
    assert [e for e in told(library) if e[1] == "built"] == [(s, "built") for s in ingest.STEPS]
    assert sorted(tuple(r) for r in library.report().collect()) == [(1, 2, 3, 1), (2, 1, 1, 1)]
    titles = {(r["doc"], r["node_id"]): (r["title"], len(r["path"])) for r in library.table("index").collect()}
    assert titles == {(1, "0000"): ("First", 1), (1, "0001"): ("Second", 1), (1, "0002"): ("Third", 2), (2, "0000"): ("plain page", 1)}
    again = ingest.ingest(pages, f"file://{tmp_path}/lib")
    assert all(e[1] == "skipped" for e in told(again))
    forced = ingest.ingest(pages, f"file://{tmp_path}/lib", force=frozenset({"parts"}))
    assert {e[0] for e in told(forced) if e[1] == "built"} == {"index", "parts"}


def test_ingest_adds_new_documents(spark, tmp_path):
    schema = "doc long, page long, text string"
    first = spark.createDataFrame([(1, 1, "1.1 First\nwords"), (1, 2, "more")], schema)
    second = spark.createDataFrame([(2, 1, "plain page"), (None, 1, "no id")], schema)
    path = f"file://{tmp_path}/lib"
    ingest.ingest(first, path)
    library = ingest.ingest(first.unionAll(second.filter("doc = 2")), path)
    assert all(("built" if s else "skipped") in {r["state"] for r in library.events().filter((F.col("run") == library.run) & (F.col("step") == s)).collect()} for s in ingest.STEPS)
    assert sorted(tuple(r) for r in library.report().collect()) == [(1, 2, 1, 1), (2, 1, 1, 1)]
    for step in ingest.STEPS:  # the first document's rows are those of the first run
        assert sorted(tuple(r) for r in library.batches(step).collect()) == [(1, 1), (2, 2)]
    changed = spark.createDataFrame([(1, 1, "1.1 First\n1.2 Second")], schema)
    forced = ingest.ingest(changed, path, force=frozenset(ingest.STEPS))
    assert sorted(tuple(r) for r in forced.report().collect()) == [(1, 1, 2, 1), (2, 1, 1, 1)]
    assert ingest.ingest(first.limit(0), f"file://{tmp_path}/none").report().count() == 0


def test_index_files_of_any_depth(spark, tmp_path):
    node = {"title": "level 41"}
    for level in range(40, 0, -1):
        node = {"title": f"level {level}", "nodes": [node]}
    (tmp_path / "deep.json").write_text(json.dumps({"doc_name": "d", "structure": [node]}))
    rows = files.read_index(spark, f"file://{tmp_path}/deep.json").collect()
    assert sorted((r["depth"], r["title"], len(r["path"])) for r in rows) == [(k, f"level {k}", k) for k in range(1, 42)]


def test_broken_logs_are_reported(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": \n{"id": "c", "n": 3}\n')
    schema = "id string, n long"
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_json(spark, f"file://{tmp_path}/log.json", schema).collect()
    assert [tuple(r) for r in files.broken_json(spark, f"file://{tmp_path}/log.json", schema).collect()] == [("log.json", '{"id": "b", "n": ')]
    (tmp_path / "log.json").write_text('{"id": "a", "n": 1}\n')
    assert files.read_json(spark, f"file://{tmp_path}/log.json", schema).count() == 1
    assert files.broken_json(spark, f"file://{tmp_path}/log.json", schema).count() == 0


def test_bookmarks_of_any_depth(spark):
    marks = [(1, k, k, f"T{k}", k) for k in range(1, 16)] + [(1, 16, 15, "U", 20), (1, 17, 1, "1. Z", 1)]
    rows = spark.createDataFrame(marks, "doc long, ord long, level long, title string, page long")
    got = {r["title"]: r["structure"] for r in outline.from_bookmarks(rows.unionAll(rows.withColumn("doc", F.lit(None).cast("long")))).collect()}
    assert got["U"] is None  # no numbered title before it
    numbered = rows.withColumn("title", F.when(F.col("ord") == 1, "1 T1").otherwise(F.col("title")))
    got = {r["title"]: r["structure"] for r in outline.from_bookmarks(numbered).collect()}
    assert got["T15"] == ".".join(["1"] * 15) and got["U"] == ".".join(["1"] * 14 + ["2"])
    assert outline.from_bookmarks(rows.limit(0)).count() == 0


def test_titles_are_found_roughly(spark):
    text = "3.2 Data  Transfer Phases\nwords " + "x" * 3000 + " Closing remarks"
    rows = [("3.2", "Data Transfer Phase", text), ("3.2", "Closing remarks", text), ("9", None, text), ("9", "Data", None), ("9.9.9", "Other things", "a\n9.9.9 b")]
    df = spark.createDataFrame(rows, "structure string, title string, text string")
    assert [r[0] for r in df.select(toc.found_on_page(F.col("text"), F.col("structure"), F.col("title"))).collect()] == [True, False, False, False, True]


def test_windows_and_missing_pages(spark):
    pages = spark.createDataFrame([(1, p, "t") for p in range(1, 8)], "doc long, page long, text string")
    got = sorted((r["chunk_id"], r["n_pages"]) for r in ranges.windows(pages, 3).collect())
    assert got == [("1-3", 3), ("4-6", 3), ("7-7", 1)]
    with pytest.raises(ValueError):
        ranges.windows(pages, 0)


def test_starts_of(spark):
    items = [(1, "1", "Intro", 1, None, None, None), (1, "2", "Nope", 1, None, None, None), (1, None, "Abstract", 1, 0, 3, None), (1, "9", "x", None, None, None, None), (1, "9", "x", 50, None, None, True), (1, "9", "x", 50, None, None, None)]
    schema = "doc long, structure string, title string, physical_index long, start_line long, end_line long, toc_span boolean"
    pages = spark.createDataFrame([(1, 1, "1 intro\nwords")], "doc long, page long, text string")
    got = sorted((r["title"], str(r["physical_index"]), str(r["toc_span"]), r["starts_page"]) for r in outline.starts_of(spark.createDataFrame(items, schema), pages).collect())
    assert got == [("Abstract", "1", "None", True), ("Intro", "1", "None", True), ("Nope", "1", "None", False), ("x", "50", "None", False), ("x", "50", "True", True), ("x", "None", "None", False)]


def test_partial_ratio():
    from leafspan.functions.fuzzy import partial_ratio

    def plain(a, b):
        import difflib

        if len(a) > len(b):
            a, b = b, a
        best = 0.0
        for start in range(1 - len(a), len(b)):
            part = b[max(start, 0) : start + len(a)]
            row = [0] * (len(part) + 1)
            for c in a:
                old = row[:]
                for j, d in enumerate(part):
                    row[j + 1] = old[j] + 1 if c == d else max(old[j + 1], row[j])
            best = max(best, 200.0 * row[-1] / (len(a) + len(part)))
        assert difflib.SequenceMatcher(None, a, b).ratio() >= 0
        return best

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcx ") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        assert partial_ratio(a, b) == pytest.approx(plain(a, b)), (a, b)
    assert partial_ratio("intro", "an introduction") == 100.0 and partial_ratio("", "a") == 0.0


def test_strategies(spark):
    """Five documents that end with different strategies and repairs, or with none."""
    from leafspan.operators import strategy

    text = lambda d, p: f"{p}.1 Part{p}\nx"
    pages = spark.createDataFrame([(d, p, text(d, p)) for d in range(1, 6) for p in range(1, 11)], "doc long, page long, text string")
    asked = []

    def index(shift):
        def build(own):
            asked.append(sorted(r[0] for r in own.select("doc").distinct().collect()))
            rows = own.select("doc", F.col("page").alias("ord"), F.concat("page", F.lit(".1")).alias("structure"), F.concat(F.lit("Part"), "page").alias("title"), "page")
            return rows.select("doc", "ord", "structure", "title", (F.col("page") + shift(F.col("doc"), F.col("page"))).alias("physical_index"))

        return build

    wrong = F.lit(1)
    first = index(lambda d, p: F.when(d == 1, 0).when(d == 2, p.isin(4, 7).cast("int")).otherwise(wrong))
    second = index(lambda d, p: F.when(d == 3, 0).when(d == 5, -(p - 1)).otherwise(wrong))
    third = index(lambda d, p: F.when(d == 4, (p == 9).cast("int")).otherwise(wrong))
    out = strategy.chosen({"first": first, "second": second, "third": third}, pages)
    states = {r["doc"]: (r["strategy"], r["repairs"], r["accuracy"]) for r in out.states.collect()}
    assert states == {1: ("first", 0, 1.0), 2: ("first", 1, 1.0), 3: ("second", 0, 1.0), 4: ("third", 1, 1.0), 5: (None, 0, 0.0)}
    assert asked == [[1, 2, 3, 4, 5], [3, 4, 5], [4, 5]]
    rows = out.index.collect()
    assert sorted((r["doc"], r["physical_index"]) for r in rows) == [(d, p) for d in range(1, 5) for p in range(1, 11)]
    assert all(r["ord"] == r["physical_index"] and r["strategy"] == states[r["doc"]][0] for r in rows)


def test_settings(monkeypatch):
    from leafspan import config

    assert config.settings({"provider": "a"}, {"a": "m"}, max_turns=3) == config.Settings(provider="a", model="m", max_turns=3)
    with pytest.raises(ValueError):
        config.settings({"nope": 1})
    monkeypatch.setenv("LEAFSPAN_TEST", "yes")
    assert config.resolved(None, "LEAFSPAN_TEST", False) is True and config.resolved(None, "LEAFSPAN_TEST", 5) == 5
    assert config.resolved(2, "LEAFSPAN_TEST", 5) == 2 and config.resolved(None, "LEAFSPAN_NONE", 5) == 5


def test_records_are_completed(spark):
    rows = spark.createDataFrame([("a", None)], "answer string, citations array<struct<doc_name: string, page: long, context: string>>")
    got = records.completed(rows, "answer").first()
    assert (got["answer"], got["answer_clean"], got["citations"], got["total_turns"], got["context_session_id"], got["problems"]) == ("a", "", [], 0, None, None)
    with pytest.raises(ValueError, match="protocol_name"):
        records.completed(rows, "protocol")
    assert all(set(records.REQUIRED[k]) <= set(records.schema(k).names) for k in records.RECORDS)
    reply = records.completed(spark.createDataFrame([(True,)], "has_tool_calls boolean"), "model_reply").first()
    assert reply["usage"]["prompt_tokens"] == 0 and reply["text"] is None


def test_evaluation_from_files(spark, tmp_path, capsys):
    from leafspan.__main__ import main

    (tmp_path / "cases.json").write_text('{"id": "1", "doc_name": "d", "query": "q", "type": "t", "key_points": ["ab", "zz"], "expected_pages": [1, 2]}\n{"id": "2", "doc_name": "d", "query": "q", "type": "t"}\n')
    (tmp_path / "answers.json").write_text('{"id": "1", "answer": "AB c", "citations": [{"doc_name": "d", "page": 1}], "pages_retrieved": [1], "all_pages_requested": [1, 1], "total_turns": 2}\n')
    cases, answers = (files.read_json(spark, f"file://{tmp_path}/{n}.json", s) for n, s in (("cases", records.schema("test_case")), ("answers", records.schema("answer").add("id", "string"))))
    got = {r["id"]: r for r in evaluation.evaluated(records.completed(cases, "test_case"), answers).collect()}
    assert (got["1"]["key_points_covered"], got["1"]["citation_valid_rate"], got["1"]["pages_hit_rate"], got["1"]["duplicate_read_rate"]) == (1, 1.0, 0.5, 0.5)
    assert (got["2"]["key_points_total"], got["2"]["pages_hit_rate"], got["2"]["total_turns"]) == (0, 1.0, 0)
    assert main(["evaluate", f"file://{tmp_path}/cases.json", f"file://{tmp_path}/answers.json"]) == 0 and "key_points_coverage" in capsys.readouterr().out
    assert files.first_existing(spark, [f"file://{tmp_path}/none", f"file://{tmp_path}/cases.json"]).endswith("cases.json")
    assert files.first_existing(spark, ["file:///nowhere/a", "file:///nowhere/b"]) == "file:///nowhere/a"


def test_numbers_go_on_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x long").repartition(5)
    got = state.numbered_from(rows, spark.createDataFrame([(41,)], "last long"), ["x"], "ev", 6).collect()
    assert {r["x"]: r["new_id"] for r in got} == {k: f"ev_{42 + k:06}" for k in range(1000)}
    assert state.numbered_from(rows.limit(0), spark.createDataFrame([(0,)], "last long"), ["x"], "ev", 6).count() == 0


def test_tokens_by_a_tokenizer(spark):
    df = spark.createDataFrame([("a b  c",), (None,), ("",), ("it's",)], "t string")
    assert [r[0] for r in df.select(tx.token_count(F.col("t"), str.split)).collect()] == [3, 0, 0, 1]
    assert [r[0] for r in df.select(tx.token_count(F.col("t"))).collect()] == [3, 0, 0, 3]


def test_questions_in_turns(spark):
    def model(messages):
        text = messages[-1]["content"]
        if text.endswith("bad"):
            raise ValueError("no model")
        if text.endswith("two"):
            return {"text": "looking", "calls": [{"tool": "page", "argument": {"p": 1}}, {"tool": "nope", "argument": None}]}
        if messages[-1]["role"] == "tool":
            return {"text": 'It is <cite doc="d" page="1"/>.\n\nLet me know if you need more.', "calls": []}
        return {"text": "plain"}

    def run(calls):
        page = F.col("tool") == "page"
        return calls.select("*", F.when(page, F.lit("page text")).alias("result"), F.when(~page, F.lit("unknown")).alias("error"), F.when(page, F.array(F.lit(1).cast("long"))).alias("pages"))

    asked = spark.createDataFrame([(1, "one"), (2, "two"), (3, "bad")], "question_id long, q string")
    asked = asked.select("question_id", dialog.opening(F.col("q"), F.lit("d"), "sys").alias("messages"))
    got = {r["question_id"]: r for r in dialog.answered(asked, model, run, limits=models.Limits(tries=2, pause=0)).collect()}
    assert (got[1]["answer"], got[1]["total_turns"], got[1]["trace"], got[1]["error"]) == ("plain", 1, [], None)
    two = got[2]
    assert two["answer"] == 'It is <cite doc="d" page="1"/>.' and two["answer_clean"] == "It is ." and two["total_turns"] == 2
    assert [(t["turn"], t["tool"], t["argument"], t["summary"]) for t in two["trace"]] == [(1, "page", '{"p": 1}', "page text"), (1, "nope", None, "Error: unknown")]
    assert [m["role"] for m in two["messages"]] == ["system", "user", "assistant", "tool", "tool"] and two["pages_retrieved"] == [1]
    assert (got[3]["answer"], got[3]["error"], got[3]["total_turns"]) == (None, "ValueError: no model", 1)
    endless = dialog.answered(asked.filter("question_id = 2"), lambda m: {"calls": [{"tool": "page", "argument": "1"}]}, run, turns=2).first()
    assert (endless["answer"], endless["total_turns"], endless["all_pages_requested"]) == (dialog.OUT_OF_TURNS, 2, [1, 1])
    assert dialog.answered(asked.limit(0), model, run).count() == 0


def test_top_sections_by_brute_force(spark):
    """Random sections of very different sizes: the best k and their scores, ties by order, with and without phrases."""
    import re

    from leafspan.operators import retrieve

    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(n))
    sections = [(i, i, pick(rng.choice([0, 2, 5, 20])), pick(rng.choice([0, 1, 5, 30, 200]))) for i in range(300)]
    sections += [(300, 300, None, None), (301, 301, "", ""), (302, 302, "w1", pick(5000) + " w59 zz end")]
    questions = [(i, pick(rng.choice([1, 3, 10, 25]))) for i in range(30)] + [(30, "nowhere at all"), (31, ""), (32, sections[7][3] or "w1"), (33, "w59 zz end"), (34, " ".join(sections[9][3].split()[1:]) or "w2")]
    find = lambda t: set(re.findall("[a-z0-9]{2,}", (t or "").lower()))
    s = spark.createDataFrame(sections, "section_id long, ord long, title string, text string")
    q = spark.createDataFrame(questions, "question_id long, text string")
    for k in (1, 5):
        want = []
        for n, asked in questions:
            scored = []
            for i, _, title, text in sections:
                own, phrase = find(asked), asked.strip().lower()
                score = 2 * len(own & find(title)) + len(own & find((text or "")[: retrieve.TEXT_LIMIT]))
                if phrase:
                    score += 3 * (phrase in (title or "").lower()) + 2 * (phrase in (text or "").lower())
                scored.append((-score, i))
            scored.sort()
            best = [x for x in scored if x[0] < 0][:k] or [(0, i) for i in range(k)]
            want += [(n, r + 1, i, -m) for r, (m, i) in enumerate(best)]
        got = [tuple(r) for r in retrieve.top_sections(s, q, k).orderBy("question_id", "rank").collect()]
        assert got == sorted(want)


def test_few_pairs_are_scored(spark, monkeypatch):
    """On a thousand sections and forty questions, less than a tenth of all pairs is written."""
    from leafspan.operators import retrieve
    from leafspan.plans import session_queries as sq

    written = {}
    plain = retrieve.saved
    monkeypatch.setattr(retrieve, "saved", lambda df, name: written.setdefault(name, plain(df, name)))
    sections, questions = (f(spark, "/root/testdata/sf0.01") for f in (sq._sections, sq._questions))
    retrieve.likely_scores(sections, questions, 5)
    every = sections.count() * questions.count()
    assert written["pairs"].count() + retrieve.FIRST * questions.count() < every / 10
    assert written["scored"].count() == written["pairs"].count()


def test_titles_by_character_pairs(spark):
    """Pages that hold a title roughly are all found, and few of the other pairs are verified."""
    from leafspan.functions.fuzzy import partial_ratio, places
    from leafspan.operators import titles

    rng = random.Random(4)
    syllables = ["the", "ing", "ké", "tion"] + ["".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.choice([2, 3]))) for _ in range(150)]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    pages = [(d, p, prose(60)) for d in (1, 2) for p in range(40)] + [(1, 90, "short"), (1, 91, ""), (1, 92, None), (1, 93, "x"), (2, 94, "Tion")]
    asked = []
    for d in (1, 2):
        for k in range(25):
            text = next(x for y, p, x in pages if y == d and p == k)
            size = rng.choice([1, 2, 3, 4, 8, 15, 30, 60])
            at = rng.randrange(100)
            piece = list(text[at : at + size])
            for _ in range(size // rng.choice([5, 8, 12])):
                where = rng.randrange(len(piece))
                piece[where : where + 1] = rng.choice([[], ["Q"], [piece[where], "z"]])
            asked.append((d, k, "".join(piece)))
    asked += [(1, 100, "short story"), (1, 101, ""), (1, 102, None), (3, 1, "the"), (2, 103, "Action")]
    t = spark.createDataFrame(asked, "doc long, ord long, title string")
    s = spark.createDataFrame(pages, "doc long, page long, text string")
    want, every, kept = {}, 0, 0
    for d, k, title in asked:
        for y, p, text in pages:
            if d == y and (title or "").strip() and text:
                head = text[: len(text) // 2 + 500].lower()
                ratio = partial_ratio(title.strip().lower(), head)
                if len(title) >= 15 and len(head) >= 60:
                    every, kept = every + 1, kept + (places(title.strip().lower(), head, 85.0) is not None)
                if ratio >= 85:
                    want[d, k, p] = ratio
    got = {(r["doc"], r["ord"], r["page"]): r["ratio"] for r in titles.titles_on_pages(t, s).collect()}
    assert got == pytest.approx(want) and len(want) > 50
    assert kept - len(want) < every / 20


def test_trees_by_pointer_doubling(spark):
    """Random forests, a long chain, a wide star and a circle: ways, numbers and subtrees against plain walks."""
    from leafspan.operators import tree

    rng = random.Random(5)
    rows = []
    for doc in range(6):
        ids = rng.sample(range(1000), 60)
        for i, o in enumerate(ids):
            rows.append((doc, o, None if i < 3 else ids[rng.randrange(i)], rng.choice(["", "a", "b c", None])))
    rows += [(10, i, i - 1 if i else None, f"t{i}") for i in range(70)]
    rows += [(11, i, 0 if i else None, "s") for i in range(300)]
    rows += [(12, 1, 2, "x"), (12, 2, 1, "y"), (12, 3, None, "z"), (12, 4, 99, "w"), (12, 5, 4, "v")]
    nodes = spark.createDataFrame(rows, "doc long, ord long, parent_ord long, title string")
    walk = tree.walked(nodes)
    sets = tree.nested_sets(walk)
    got = {(r["doc"], r["ord"]): (r["path"], r["parent_path"], r["depth"], r["first"], r["last"]) for r in sets.collect()}
    want = {}
    for doc in {r[0] for r in rows}:
        below = {}
        for _, o, up, title in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1]):
            below.setdefault(up, []).append((o, title or ""))
        number = 0

        def visit(o, title, path, over):
            nonlocal number
            own, number = number, number + 1
            for k, t in below.get(o, []):
                visit(k, t, [*path, k], f"{over}/{title}" if over else title)
            want[doc, o] = (path, over, len(path), own, number - 1)

        for o, title in below.get(None, []):
            visit(o, title, [o], "")
    assert got == want
    found = {tuple(r) for r in tree.below(sets, nodes.filter("ord % 3 = 0").select("doc", "ord")).collect()}
    assert found == {(d, a, o) for (d, o), (path, *_) in want.items() for a in path if a % 3 == 0}
    assert {r["node_id"] for r in tree.preorder(walk).filter("doc = 11").collect()} == {f"{i:04}" for i in range(300)}
    assert "Python" not in sets._jdf.queryExecution().executedPlan().toString() and "FlatMapGroups" not in walk._jdf.queryExecution().executedPlan().toString()


def test_equal_prompts_are_asked_once(spark, tmp_path):
    """Each call leaves a file: ten different prompts of a thousand rows, four of them known, one that fails at first and one that always does."""
    def model(prompt):
        import os
        import uuid

        with open(f"{tmp_path}/{prompt}-{uuid.uuid4().hex}", "w"):
            pass
        calls = sum(name.startswith(f"{prompt}-") for name in os.listdir(tmp_path))
        if prompt == "p9" or (prompt == "p8" and calls < 3):
            raise ValueError("busy")
        return prompt.upper()

    rows = spark.range(1000).select("id", F.concat(F.lit("p"), F.col("id") % 10).alias("prompt")).repartition(7)
    known = models.replies(rows.filter("id % 10 < 4"), "prompt", lambda p: f"old {p}")
    limits = models.Limits(at_once=3, tries=3, pause=0.01)
    got = {r["id"]: (r["reply"], r["error"]) for r in models.asked(rows, "prompt", model, known.select("prompt_key", "reply"), limits).collect()}
    assert got == {i: (f"old p{i % 10}" if i % 10 < 4 else None if i % 10 == 9 else f"P{i % 10}", "ValueError: busy" if i % 10 == 9 else None) for i in range(1000)}
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert {p: calls.count(p) for p in set(calls)} == {"p4": 1, "p5": 1, "p6": 1, "p7": 1, "p8": 3, "p9": 3}
    assert models.replied(model, "p9", models.Limits(tries=0)) == (None, "ValueError: busy")
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, prompt string")
    assert [r["reply"] for r in models.asked(nulls, "prompt", lambda p: str(p)).collect()] == ["None", "None"]


def test_questions_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from leafspan.__main__ import main

    pages = spark.createDataFrame([(d, p, f"{p}.1 Part\npage {p} of {d}") for d in (1, 2) for p in range(1, 5)], "doc long, page long, text string")
    library = ingest.ingest(pages, f"file://{tmp_path}/library")
    (tmp_path / "questions.json").write_text("\n".join(json.dumps({"question_id": i, "doc": d, "question": q}) for i, d, q in [(1, "1", "pages"), (2, "2", "outline"), (3, "9", "pages"), (4, "1", "other")]))
    (tmp_path / "my_model.py").write_text("""
def reply(messages):
    last = messages[-1]
    if last["role"] == "tool":
        return {"text": "I saw: " + last["content"][:40].replace("\\n", " ")}
    doc = last["content"].split("\\n")[0].split(": ")[1]
    calls = {"pages": ("get_page_content", {"doc": doc, "pages": "2-3"}), "outline": ("get_document_structure", {"doc": doc}), "other": ("nope", {})}
    tool, argument = calls[last["content"].split()[-1]]
    return {"text": "", "calls": [{"tool": tool, "argument": argument}]}
""")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}")
    spark.sparkContext.addPyFile(f"{tmp_path}/my_model.py")
    assert main(["ask", f"file://{tmp_path}/library", f"file://{tmp_path}/questions.json", "my_model:reply"]) == 0
    out = capsys.readouterr().out
    assert "I saw: [Page 2] 2.1 Part page 2 of 1" in out and "[2, 3]" in out and 'I saw: {"node_id":' in out
    assert "I saw: Error: no such document" in out and "I saw: Error: Unknown tool: nope" in out
    assert main(["ask", "x", "y"]) == 2
    assert library.table("registry").count() == 2
