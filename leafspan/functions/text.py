"""Column functions over text: clipping, headings, names, retrieval tokens, citations.

All but a tokenizer of the caller are built-in expressions, so that they stay in generated code and can be used
in any DataFrame or SQL plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sized

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's results: limits, patterns and wording.
PAGE_TEXT_LIMIT = 4000
CLIP_NOTE = ("\n\n[内容已截断，共 ", " 字符，已显示前 ", " 字符]")
CITE = r'<cite\s+doc="([^"]+)"\s+page="(\d+)"\s*/>'
BOUNDARY = r"\n|。|\.\s|；|;\s|- \*\*"
TABLE_REFERENCE = r"(?i)(\btable|表)\s*#?\s*(\d{1,4})"
PAGE_REFERENCE = r"(?i)(第\s*\d+\s*页|\bpage\s*\d+\b)"
INVITATION = (
    r"(?is)(如果你|如需|需要的话|我可以继续|你还可以|你可以继续|欢迎继续提问|"
    r"if you (want|need|would like)|i can continue|feel free to ask|let me know if)"
)
TABLE_HINT = (
    "\n\n[Disambiguation: references like '表149' / 'Table 149' are table IDs, "
    "not page numbers, unless the user explicitly says '第149页' or 'page 149'. "
    "Locate the table first, then use its actual source page(s).]"
)
FRONT_ALIASES = {
    "abstract": "Abstract",
    "status of this memo": "Status of This Memo",
    "copyright notice": "Copyright Notice",
    "table of contents": "Table of Contents",
    "contents": "Table of Contents",
    "toc": "Table of Contents",
}
FRONT_PUNCTUATION = " \t\r\n-_:;,.()[]{}<>"
NUMBERED_HEADING = r"^\s*(\d+(\.\d+){1,9})\.?\s+(.+?)\s*$"
TOKEN = r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"


def _last(text: Column, sought: str) -> Column:
    """0-based place of the last occurrence; -1 if there is none."""
    back = F.locate(sought[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - (len(sought) - 1)).otherwise(F.lit(-1))


def clipped(text: Column, limit: int = PAGE_TEXT_LIMIT) -> Column:
    """Texts over ``limit`` end at the last blank line before it, else the last line end, else there, with a note."""
    head = F.left(text, F.lit(limit))
    blank, line = _last(head, "\n\n"), _last(head, "\n")
    cut = F.when(blank >= 0, blank).when(line >= 0, line).otherwise(F.lit(limit))
    note = F.concat(
        F.lit(CLIP_NOTE[0]), F.length(text).cast("string"), F.lit(CLIP_NOTE[1]), cut.cast("string"), F.lit(CLIP_NOTE[2])
    )
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, cut), note))


def clip(text: Column, limit: int, note: str) -> Column:
    """Texts over ``limit`` are cut there and end with ``note``."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(note))).otherwise(text)


def retrieval_tokens(text: Column) -> Column:
    """Distinct runs of two or more ASCII letters and digits (lower-cased), and single CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_union(words, F.regexp_extract_all(text, F.lit("[一-鿿]"), F.lit(0)))


def token_count(text: Column, encode: Callable[[str], Sized] | None = None) -> Column:
    """Tokens of a text: by a tokenizer's ``encode`` in Arrow batches, else a tokenizer-free count of words and marks, for budgets. Null has none."""
    if encode is None:
        return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")

    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: len(encode(x)), na_action="ignore").fillna(0).astype("int64")

    return F.pandas_udf(counted, "long")(text)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def heading_title(raw: Column) -> Column:
    """A heading without dot leader, page number and leading punctuation."""
    out = F.trim(F.regexp_replace(squeezed(F.coalesce(raw, F.lit(""))), r"\.{3,}\s*\d+\s*$", ""))
    out = F.trim(F.regexp_replace(out, r"\s+\d+\s*$", ""))
    return F.trim(F.regexp_replace(out, r"^[.\-:;,)]+", ""))


def front_text(line: Column) -> Column:
    """A line as front-matter headings are compared: no leader, page number or outer punctuation, lower case."""
    out = F.trim(F.regexp_replace(squeezed(F.coalesce(line, F.lit(""))), r"\.{2,}\s*\d+\s*$", ""))
    out = F.trim(F.regexp_replace(out, r"\s+\d+\s*$", ""))
    return F.lower(squeezed(F.trim(out, F.lit(FRONT_PUNCTUATION))))


def front_heading(line: Column, index: Column | None = None, toc_lines: int = 40) -> Column:
    """The canonical front-matter heading that a line is, or null; a contents heading only in the first lines."""
    found = F.lit(None).cast("string")
    key = front_text(line)
    for alias, name in FRONT_ALIASES.items():
        found = F.when(key == alias, F.lit(name)).otherwise(found)
    if index is None:
        return found
    return F.when((found == "Table of Contents") & (index >= max(toc_lines, 1)), F.lit(None)).otherwise(found)


def is_contents_page(text: Column) -> Column:
    """Whether five lines at least look like entries of a table of contents."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != "")
    entry = F.filter(lines, lambda x: x.rlike(r"\.{3,}\s*\d+\s*$") | ((F.length(x) > 25) & x.rlike(r"\s\d+\s*$")))
    return F.size(entry) >= 5


def quoted(text: Column) -> Column:
    """A text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-/])", r"\\$1")


def section_title(title: Column, structure: Column) -> Column:
    """A title without the number that it starts with; null for a blank one."""
    title = F.trim(F.coalesce(title, F.lit("")))
    bare = F.trim(F.regexp_replace(title, F.concat(F.lit(r"^\s*"), quoted(structure), F.lit(r"(\s*\.\s*|\s+)")), F.lit("")))
    return F.when(title == "", F.lit(None)).otherwise(F.coalesce(F.nullif(bare, F.lit("")), title))


def without_leaders(text: Column) -> Column:
    """Dot leaders become ': '."""
    return F.regexp_replace(text, r"\.{5,}", ": ")


def citations(answer: Column) -> Column:
    """(doc_name, page) of each citation tag, in order."""
    docs = F.regexp_extract_all(answer, F.lit(CITE), F.lit(1))
    pages = F.regexp_extract_all(answer, F.lit(CITE), F.lit(2))
    return F.zip_with(docs, pages, lambda d, p: F.struct(d.alias("doc_name"), p.cast("int").alias("page")))


def citation_contexts(answer: Column, longest: int = 200, back: int = 500) -> Column:
    """For each citation tag, in order, the clause before it: from the last boundary in the ``back`` characters
    before the tag, or their end; at most ``longest`` characters, without other tags."""
    pieces, tags = F.split(answer, CITE, -1), F.regexp_extract_all(answer, F.lit(CITE), F.lit(0))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def before(_, i):
        parts = F.zip_with(F.slice(pieces, F.lit(1), i + 1), F.slice(tags, F.lit(1), i), lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        region = F.right(F.array_join(parts, ""), F.lit(back))
        clause = F.when(region.rlike(BOUNDARY), F.regexp_extract(region, r"(?s)^.*(" + BOUNDARY + r")(.*)$", 2)).otherwise(
            F.right(region, F.lit(longest))
        )
        return bare(F.regexp_replace(F.right(bare(clause), F.lit(longest)), CITE, ""))

    return F.transform(tags, before)


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, CITE, "")


def without_invitation(answer: Column) -> Column:
    """An answer without closing paragraphs that invite further questions; one that is nothing else stays."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    parts = F.split(text, r"\n\s*\n")
    stays = F.transform(parts, lambda p, i: F.when((F.trim(p) != "") & ~p.rlike(INVITATION), i + 1).otherwise(F.lit(0)))
    last = F.array_max(stays)
    kept = F.array_join(F.filter(F.slice(parts, F.lit(1), last), lambda p: F.trim(p) != ""), "\n\n")
    return F.when((last == F.size(parts)) | (last == 0), text).otherwise(F.regexp_replace(kept, r"^\s+|\s+$", ""))


def with_table_hint(query: Column) -> Column:
    """A query that names a table but no page gets a hint."""
    hint = query.rlike(TABLE_REFERENCE) & ~query.rlike(PAGE_REFERENCE)
    return F.when(hint, F.concat(query, F.lit(TABLE_HINT))).otherwise(query)


def retrieval_text(*parts: Column) -> Column:
    """The parts that are not empty, a line each."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def relative_path(path: Column, base: str) -> Column:
    """A path below ``base`` without it; any other path as it is."""
    prefix = base.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def session_name(identifier: Column) -> Column:
    """A session's file name: folders and a .json ending are dropped and .json put at the end."""
    return F.concat(F.regexp_replace(base_name(identifier), r"\.json$", ""), F.lit(".json"))


def session_id(at: Column) -> Column:
    """sess_ and the time, to the second."""
    return F.concat(F.lit("sess_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_stem(path: Column) -> Column:
    """A file name's stem with anything but letters, digits, '-' and '_' replaced; 'document' if nothing is left."""
    stem = F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")
    return F.coalesce(F.nullif(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_"), F.lit("")), F.lit("document"))


def document_name(path: Column) -> Column:
    """The file name, ending in .pdf."""
    name = base_name(F.trim(path))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def cell(value: Column) -> Column:
    """A table cell for a markdown row."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n?", "\n")
    return F.trim(F.replace(F.replace(out, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|")))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a markdown table; short rows are padded, no rows give ''."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    full = F.transform(
        rows, lambda r: line(F.concat(F.transform(r, lambda c: cell(c)), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    )
    rule = line(F.array_repeat(F.lit("---"), width.cast("int")))
    table = F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, F.lit("")).otherwise(table)


def numbered(prefix: str, number: Column, width: int) -> Column:
    """Identifiers like turn_0007."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def provisional_id(*parts: Column) -> Column:
    """'tmp_' and the first 12 hex digits of the SHA-1 of the parts joined by '|'."""
    return F.concat(F.lit("tmp_"), F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(12)))


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (0-based, inclusive, clamped), trimmed; '' if there are none."""
    lines = F.split(text, "\n", -1)
    a, b = F.greatest(first, F.lit(0)), F.least(last, F.size(lines) - 1)
    inside = F.when(a > b, F.lit("")).otherwise(F.array_join(F.slice(lines, a + 1, F.greatest(b - a + 1, F.lit(0))), "\n"))
    return F.regexp_replace(inside, r"^\s+|\s+$", "")
