"""Budgeted folds: token groups of pages, parts of a tree, prefix summaries, context summaries.

A group closes when the next item would overflow it, so that each decision
depends on all before it. Where no expression can say that, one document is
folded at a time over Arrow tables; documents are independent of one another.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_TOKENS = 20000
PART_CHARS = 30000


def page_groups(pages: DataFrame, most: int = MODEL_TOKENS, overlap: int = 1) -> DataFrame:
    """(doc, group_no, first_page, last_page, n_pages): consecutive pages in groups of about equal tokens.

    ``pages`` has doc, page, n_tokens. Documents within ``most`` tokens are one
    group; others aim at the mean of an equal share and ``most``. A new group
    starts with the last ``overlap`` pages of the one before. If the first page is
    over the aim, the first group is empty (no pages).
    """
    schema = pa.schema([("doc", pa.int64()), ("group_no", pa.int64()), ("first_page", pa.int64()), ("last_page", pa.int64()), ("n_pages", pa.int64())])

    def fold(table):
        rows = sorted(zip(table.column("page").to_pylist(), table.column("n_tokens").to_pylist(), strict=True))
        total = sum(n for _, n in rows)
        groups, begin, held = [], 0, 0
        if total > most:
            share = total / math.ceil(total / most)
            aim = math.ceil((share + most) / 2)
            for i, (_, n) in enumerate(rows):
                if held + n > aim:
                    groups.append((begin, i))
                    begin = max(i - overlap, 0)
                    held = sum(m for _, m in rows[begin:i])
                held += n
        groups.append((begin, len(rows)))
        doc = table.column("doc")[0].as_py()
        out = [
            (doc, k + 1, rows[a][0] if b > a else None, rows[b - 1][0] if b > a else None, b - a) for k, (a, b) in enumerate(groups)
        ]
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return pages.select("doc", "page", "n_tokens").groupBy("doc").applyInArrow(
        fold, "doc long, group_no long, first_page long, last_page long, n_pages long"
    )


def payload_size(payload: Column, fields: Column) -> Column:
    """The length of a struct's JSON text with a space after each comma and colon; ``fields`` counts those that are not null."""
    return F.length(F.to_json(payload)) + 2 * fields - 1


def _size(payload: dict) -> int:
    return len(json.dumps(payload, ensure_ascii=False))


def tree_parts(nodes: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """(doc, part, place, node_id, parent_path, is_skeleton): a tree in parts of about ``most`` characters of JSON.

    ``nodes`` has doc, ord, node_id, path (ids from the root to the node), title,
    summary, start_index, end_index; ord is the depth-first order. A node that would overflow
    its part opens the next one, where ancestors that are missing come first as
    skeletons without summaries; those count, too. A single node may be larger
    than ``most``.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    schema = pa.schema(
        [("doc", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("node_id", pa.string()), ("parent_path", pa.string()), ("is_skeleton", pa.bool_())]
    )

    def size(node, skeleton):
        node_id, title, summary, start, end = node
        out = {"node_id": node_id, "title": title}
        if not skeleton:
            out["summary"] = summary
        out["is_skeleton"] = skeleton
        return _size(out | {k: x for k, x in (("start_index", start), ("end_index", end)) if x is not None})

    def fold(batches):
        now, begun = None, False
        for batch in batches:
            out = []
            for doc, path, *node in zip(*(batch.column(c).to_pylist() for c in ("doc", "path", "node_id", "title", "summary", "start_index", "end_index")), strict=True):
                if not begun or doc != now:
                    now, begun, way, part, place, held, there = doc, True, [], 1, 0, 0, set()
                path, own = tuple(path), size(node, False)
                del way[len(path) - 1:]
                if tuple(p[-1] for p, _ in way) != path[:-1]:
                    raise ValueError(f"node {node[0]!r} does not come after its ancestors, depth first")
                if there and held + own > most:
                    part, held, there = part + 1, 0, set()
                for above, known in way:
                    if above not in there:
                        there.add(above)
                        held += size(known, True)
                        place += 1
                        out.append((doc, part, place, known[0], "/".join(above[:-1]), True))
                there.add(path)
                way.append((path, node))
                held, place = held + own, place + 1
                out.append((doc, part, place, node[0], "/".join(path[:-1]), False))
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    names = ["doc", "ord", "node_id", "path", "title", "summary", "start_index", "end_index"]
    # documents follow one another in a partition: a fold keeps the way to the last node and the open part
    dealt = nodes.select(*names).repartition("doc").sortWithinPartitions("doc", "ord")
    return dealt.mapInArrow(fold, "doc long, part long, place long, node_id string, parent_path string, is_skeleton boolean")


def part_envelopes(parts: DataFrame) -> DataFrame:
    """(doc, part, total_parts, has_more, n_nodes, file, options, summary): what a reader of one part is told."""
    sizes = parts.groupBy("doc", "part").agg(F.count("*").alias("n_nodes"))
    totals = parts.groupBy("doc").agg(F.max("part").alias("total_parts"))
    text = lambda c: c.cast("string")
    part, total = F.col("part"), F.col("total_parts")
    # The wording of options and summary.
    options = F.array(
        F.when(part < total, F.concat(F.lit("Request next part with part: "), text(part + 1))),
        F.when(part < total, F.concat(F.lit("Jump to last part with part: "), text(total))),
        F.when(part > 1, F.concat(F.lit("Request previous part with part: "), text(part - 1))),
        F.lit("Proceed to get_page_content() for specific sections"),
    )
    return sizes.join(totals, "doc").select(
        "doc",
        "part",
        "total_parts",
        (part < total).alias("has_more"),
        "n_nodes",
        F.concat(F.lit("part_"), F.lpad(text(part), 4, "0"), F.lit(".json")).alias("file"),
        F.array_join(F.filter(options, lambda x: x.isNotNull()), "; ").alias("options"),
        F.concat(F.lit("Showing part "), text(part), F.lit(" of "), text(total), F.lit(".")).alias("summary"),
    )


def part_request(envelopes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (doc, part) with the part's envelope, or an error and the valid range."""
    totals = envelopes.groupBy("doc").agg(F.max("total_parts").alias("_total"))
    out = requests.join(totals, "doc", "left").join(envelopes.select("doc", "part", "n_nodes", "has_more"), ["doc", "part"], "left")
    known = F.col("_total").isNotNull()
    bad = ~F.col("part").between(1, F.col("_total"))
    return out.select(
        "doc",
        "part",
        "n_nodes",
        "has_more",
        F.when(~known, F.lit("unknown document")).when(bad, F.concat(F.lit("Part "), F.col("part").cast("string"), F.lit(" out of range"))).alias("error"),
        F.when(bad, F.concat(F.lit("1-"), F.col("_total").cast("string"))).alias("valid_range"),
    )


def prefix_summary(text: Column) -> Column:
    """Leading paragraphs that fit in half of a text; if the first one does not fit, its beginning."""
    limit = F.floor(F.length(text) / 2).cast("int")
    bare = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n", -1), bare), lambda p: p != "")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(s, p):
        longer = F.when(s["text"] == "", p).otherwise(F.concat(s["text"], F.lit("\n\n"), p))
        fits = F.length(longer) <= limit
        cut = F.when(s["text"] == "", F.left(p, limit)).otherwise(s["text"])
        return F.when(s["full"], s).otherwise(
            F.struct(F.when(fits, longer).otherwise(cut).alias("text"), (~fits).alias("full"))
        )

    summed = F.aggregate(paragraphs, start, step)["text"]
    return F.when(F.coalesce(limit, F.lit(0)) <= 0, F.lit("")).when(F.size(paragraphs) == 0, F.left(text, limit)).otherwise(summed)


# Headings of the rendered summary.
READ_HEADING, FOUND_HEADING, PAGES_LABEL = "## 已读节点", "## 文档目录", "已读页面: "


def rendered(nodes: list[dict], parts: list[int], pages: str) -> str:
    """A summary as text: nodes read with their summaries, nodes found, pages read."""
    if not (nodes or parts or pages):
        return ""
    place = lambda n: f"- {n['title']} (pp.{n['start_index']}-{n['end_index']})"
    read = [n for n in nodes if n["status"] != "discovered"]
    found = [n for n in nodes if n["status"] == "discovered"]
    blocks = []
    if read:
        told = [place(n) + (f": {n['summary'].strip()}" if (n["summary"] or "").strip() else "") for n in read]
        blocks.append("\n".join([READ_HEADING, "", *told]))
    if found:
        blocks.append("\n".join([FOUND_HEADING, "", *map(place, found)]))
    if pages:
        blocks.append(PAGES_LABEL + pages)
    return "\n\n".join(blocks)


def context_summaries(nodes: DataFrame, state: DataFrame, budget: int = 4000) -> DataFrame:
    """(session_id, n_nodes, total_chars, summary) within ``budget`` characters.

    ``nodes`` has session_id, place (their order: best first), title, summary, start_index,
    end_index, status; ``state`` has session_id, visited_parts, ranges. Nodes are dropped
    from the end, those only discovered first, until the text fits; nothing
    fits a budget of 0. Lengths depend on which headings stay, so each session is folded whole.
    """
    schema = pa.schema([("session_id", pa.int64()), ("n_nodes", pa.int64()), ("total_chars", pa.int64()), ("summary", pa.string())])

    def fold(key, own, state):
        kept = sorted(own.to_pylist(), key=lambda n: n["place"])
        told = state.to_pylist()[0] if state.num_rows else {"visited_parts": [], "ranges": ""}
        parts, pages = told["visited_parts"] or [], told["ranges"] or ""
        kept = [n for n in kept if not n["start_index"] == n["end_index"] == 0] if budget > 0 else []
        while kept and len(rendered(kept, parts, pages)) > budget:
            found = [i for i, n in enumerate(kept) if n["status"] == "discovered"]
            kept.pop(found[-1] if found else -1)
        text = rendered(kept, parts, pages)
        row = {"session_id": key[0].as_py(), "n_nodes": len(kept), "total_chars": len(text), "summary": text if len(text) <= budget else ""}
        return pa.Table.from_pylist([row], schema=schema)

    names = ["session_id", "place", "title", "summary", "start_index", "end_index", "status"]
    return (
        nodes.select(*names)
        .groupBy("session_id")
        .cogroup(state.select("session_id", "visited_parts", "ranges").groupBy("session_id"))
        .applyInArrow(fold, "session_id long, n_nodes long, total_chars long, summary string")
    )
