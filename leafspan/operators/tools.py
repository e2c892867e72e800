"""Tools by name.

A tool is a function from argument columns to a result column, so that calls of
many rows run in one plan; unknown tools and failures are values, not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tools:
    def __init__(self):
        self._tools: dict[str, Callable[..., Column]] = {}

    def add(self, name: str, tool: Callable[..., Column]) -> None:
        self._tools[name] = tool

    def names(self) -> list[str]:
        return sorted(self._tools)

    def run(self, calls: DataFrame, name: str, *arguments: str) -> DataFrame:
        """``calls`` with result and error: each row's tool applied to its arguments."""
        result, known = F.lit(None).cast("string"), F.lit(False)
        for tool, f in self._tools.items():
            result = F.when(F.col(name) == tool, f(*map(F.col, arguments))).otherwise(result)
            known = known | (F.col(name) == tool)
        error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unknown tool: "), F.coalesce(F.col(name), F.lit(""))))
        return calls.withColumn("result", result).withColumn("error", error)


def schemas(specs: list[dict]) -> list[dict]:
    """Tool descriptions with the arguments' schema beside the name."""
    return [{"name": s["function"]["name"], "description": s["function"]["description"], "input_schema": s["function"]["parameters"]} for s in specs]


def replayed(messages: DataFrame) -> DataFrame:
    """(session_id, turns, answer, tools): recorded agent messages (session_id, seq, role, content, tool) as outcomes.

    The last assistant message without a tool is the answer; without one the
    session ran into its limit of turns.
    """
    final = F.when((F.col("role") == "assistant") & F.col("tool").isNull(), F.col("seq"))
    tools = F.array_sort(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("seq", "tool"))))
    return messages.groupBy("session_id").agg(
        F.count(F.when(F.col("role") == "assistant", 1)).alias("turns"),
        F.max_by("content", final).alias("answer"),
        F.array_join(F.transform(tools, lambda x: x["tool"]), ",").alias("tools"),
    )
