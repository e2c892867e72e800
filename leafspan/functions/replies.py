"""Column functions over model replies and tagged texts: JSON, index tags, clipped results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafspan.functions.text import clip

SUMMARY_CHARS, PAGE_CHARS, STREAM_CHARS, STREAM_TEXT = 200, 8000, 20000, 2000
TAG = r"<physical_index_(\d+)>"


def fenced(reply: Column) -> Column:
    """What a reply holds between ```json and the last ```, else all of it; trimmed."""
    body = F.regexp_replace(reply, r"(?s)^.*?```json", "")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""), r"^\s+|\s+$", "")


def json_text(reply: Column) -> Column:
    """A reply's JSON on one line: None becomes null, then, if it is not valid, trailing commas go; '{}' if that fails."""
    flat = F.trim(F.regexp_replace(F.replace(fenced(reply), F.lit("None"), F.lit("null")), r"\s+", " "))
    bare = F.replace(F.replace(flat, F.lit(",]"), F.lit("]")), F.lit(",}"), F.lit("}"))
    return F.when(F.try_parse_json(flat).isNotNull(), flat).when(F.try_parse_json(bare).isNotNull(), bare).otherwise(F.lit("{}"))


def tagged_index(value: Column) -> Column:
    """The number of a tag like <physical_index_7> or physical_index_7; null for anything else."""
    return F.nullif(F.regexp_extract(value, r"^\s*<?physical_index_(\d+)>?\s*$", 1), F.lit("")).try_cast("long")


def whole_number(value: Column) -> Column:
    return F.trim(value).try_cast("long")


def first_tag(text: Column) -> Column:
    """The first tagged page number, or -1."""
    return F.coalesce(F.nullif(F.regexp_extract(text, TAG, 1), F.lit("")).try_cast("long"), F.lit(-1))


def last_tag(text: Column) -> Column:
    """The last tagged page number, or -1."""
    every = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    return F.coalesce(F.try_element_at(every, F.lit(-1)).try_cast("long"), F.lit(-1))


def without_first_page(text: Column) -> Column:
    """A text without its first tagged page."""
    return F.regexp_replace(text, r"(?s)\A(.*?)<physical_index_(\d+)>.*?<physical_index_\2>", "$1")


def result_summary(text: Column) -> Column:
    return clip(text, SUMMARY_CHARS, "...")


def page_result(text: Column) -> Column:
    return clip(text, PAGE_CHARS, "\n...[truncated]")


def stream_result(pages: Column, size: Column) -> Column:
    """Page texts of a progress event: over the limit only the first two, each clipped."""
    few = F.transform(F.slice(pages, 1, 2), lambda t: clip(t, STREAM_TEXT, "\n...[truncated for stream]"))
    return F.when(size > STREAM_CHARS, few).otherwise(pages)


# The options of a processing request, and the name that one of them also goes by.
PROCESS_OPTIONS = [
    "toc_check_pages",
    "max_pages_per_node",
    "max_tokens_per_node",
    "if_add_node_id",
    "if_add_node_summary",
    "if_add_node_text",
    "if_add_doc_description",
    "structure_max_limit",
    "structure_chunk_max_limit",
    "content_chunk_size",
]
LIMIT, LIMIT_ALIAS = "structure_max_limit", "structure_chunk_max_limit"


def event_text(payload: Column) -> Column:
    """A struct as the text of a server-sent event."""
    return F.concat(F.lit("event: message\ndata: "), F.to_json(payload), F.lit("\n\n"))


def process_options(payload: Column) -> Column:
    """The known options of a JSON request that are set (option -> value as text); an alias wins over the name it stands for."""
    value = {name: F.get_json_object(payload, f"$.{name}") for name in PROCESS_OPTIONS}
    value[LIMIT] = F.coalesce(value.pop(LIMIT_ALIAS), value[LIMIT])
    every = F.map_from_arrays(F.array(*map(F.lit, value)), F.array(*value.values()))
    return F.map_filter(every, lambda _, x: x.isNotNull())


def shortened(json_text: Column, most: int = 40) -> Column:
    """JSON with string values of more than ``most`` characters cut there and dotted; names stay."""
    one = r'(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\.)'
    return F.regexp_replace(json_text, rf'"({one}{{{most}}}){one}+"(?!\s*:)', '"$1..."')


def log_entry(message: Column) -> Column:
    """A log line: a message that is a JSON object as it is, any other as {"message": ...}."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(message)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, message).otherwise(F.to_json(F.struct(F.coalesce(message, F.lit("")).alias("message"))))


def upload_name(file_name: Column, taken: Column, stamp: Column) -> Column:
    """The name under which an uploaded PDF file is kept: its base name, with a time stamp if that is taken; null for other files."""
    name = F.coalesce(F.nullif(F.regexp_extract(file_name, r"([^/]*)$", 1), F.lit("")), F.lit("uploaded.pdf"))
    stamped = F.concat(F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 1), F.lit("_"), stamp, F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 2))
    return F.when(F.lower(name).endswith(".pdf"), F.when(taken, stamped).otherwise(name))
