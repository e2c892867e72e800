"""Record types of questions, answers, evaluation and protocols, as schemas with defaults for what a record leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CITATION = "struct<doc_name: string, page: long, context: string>"
_CALL = "struct<turn: long, tool: string, arguments: string, result_summary: string>"
_STATE = "struct<name: string, description: string, is_initial: boolean, is_final: boolean>"
_STEP = "struct<from_state: string, to_state: string, event: string, condition: string, actions: array<string>>"
_MACHINE = f"struct<name: string, states: array<{_STATE}>, transitions: array<{_STEP}>, source_pages: array<long>>"
_FIELD = "struct<name: string, type: string, size_bits: long, description: string>"
_MESSAGE = f"struct<name: string, fields: array<{_FIELD}>, source_pages: array<long>>"

# The fields of each record type. Arguments, raw messages and constants are JSON texts.
RECORDS = {
    "citation": "doc_name string, page long, context string",
    "tool_call_record": "turn long, tool string, arguments string, result_summary string",
    "token_usage": "prompt_tokens long, completion_tokens long",
    "tool_call": "name string, arguments string, id string",
    "model_reply": "has_tool_calls boolean, tool_calls array<struct<name: string, arguments: string, id: string>>, text string, "
    "usage struct<prompt_tokens: long, completion_tokens: long>, raw_message string",
    "answer": f"answer string, answer_clean string, citations array<{_CITATION}>, trace array<{_CALL}>, pages_retrieved array<long>, "
    "all_pages_requested array<long>, total_turns long, context_session_id string",
    "test_case": "id string, doc_name string, query string, type string, expected_pages array<long>, key_points array<string>",
    "result": "id string, query string, key_points_covered long, key_points_total long, citation_count long, citation_valid_rate double, "
    "total_turns long, pages_hit_rate double, duplicate_read_rate double, avg_pages_per_turn double, answer string",
    "protocol": f"protocol_name string, state_machines array<{_MACHINE}>, messages array<{_MESSAGE}>, constants string, source_document string",
}
REQUIRED = {
    "citation": ["doc_name", "page"],
    "tool_call_record": ["turn", "tool", "arguments"],
    "token_usage": [],
    "tool_call": ["name", "arguments", "id"],
    "model_reply": [],
    "answer": ["answer"],
    "test_case": ["id", "doc_name", "query", "type"],
    "result": ["id", "query", "key_points_covered", "key_points_total", "citation_count", "citation_valid_rate", "total_turns", "pages_hit_rate", "answer"],
    "protocol": ["protocol_name"],
}
#: Fields that stay null where a record leaves them out.
OPTIONAL = {"text", "context_session_id"}


def schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL(RECORDS[kind])


def _default(kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(_default(f.dataType).alias(f.name) for f in kind))
    return F.lit({"string": "", "boolean": False}.get(kind.typeName(), 0)).cast(kind)


def completed(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the columns of a record type: what is missing or null becomes its default.

    A required field that is no column is an error (ValueError); where it is null, ``problems`` tells so.
    """
    missing = [c for c in REQUIRED[kind] if c not in rows.columns]
    if missing:
        raise ValueError(f"{kind} lacks {', '.join(missing)}")
    out = []
    for f in schema(kind):
        own = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((own if f.name in OPTIONAL or f.name in REQUIRED[kind] else F.coalesce(own, _default(f.dataType))).alias(f.name))
    lacking = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[kind]))
    return rows.select(*out, F.when(lacking != "", F.concat(F.lit("missing: "), lacking)).alias("problems"))
