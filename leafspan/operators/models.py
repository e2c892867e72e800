"""Calls of models at scale: every different prompt is asked once, known replies are not asked for again.

A model is any function from a prompt to a reply; the library calls none by itself. Prompts are
told apart by the digest of their JSON form. A task has a bounded number of calls on their way at once, a call that fails
is tried again after pauses that grow, and replies are written, so that a lost executor costs no more than its task's share.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.sources.files import saved


@dataclass(frozen=True)
class Limits:
    """Calls on their way at once in a task, tries per prompt, and the pause in seconds before the second try, which doubles up to ``longest``."""

    at_once: int = 8
    tries: int = 3
    pause: float = 0.5
    longest: float = 30.0


def replied(model: Callable, prompt, limits: Limits) -> tuple[object, str | None]:
    """(reply, None), or (None, error) when all tries failed."""
    error = None
    for i in range(max(1, limits.tries)):
        if i:
            time.sleep(min(limits.pause * 2 ** (i - 1), limits.longest) * random.uniform(0.5, 1))
        try:
            return model(prompt), None
        except Exception as failure:  # noqa: BLE001
            error = f"{type(failure).__name__}: {failure}"
    return None, error


def all_replied(model: Callable, prompts: Iterable, limits: Limits) -> Iterator[tuple[object, str | None]]:
    """replied() for all prompts in order, ``at_once`` at a time."""
    with ThreadPoolExecutor(max(1, limits.at_once)) as pool:
        yield from pool.map(lambda prompt: replied(model, prompt, limits), prompts)


def key(prompt: Column) -> Column:
    """The digest by which prompts are told apart; a null prompt has one, too."""
    return F.sha2(F.coalesce(F.to_json(F.struct(prompt.alias("p"))), F.lit("")), 256)


def replies(rows: DataFrame, prompt: str, model: Callable[[str], str], known: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(prompt_key, reply, error) of the different prompts of ``rows`` that ``known`` (prompt_key, reply) lacks; written once."""
    asked = rows.select(key(F.col(prompt)).alias("prompt_key"), F.col(prompt).alias("prompt")).dropDuplicates(["prompt_key"])
    if known is not None:
        asked = asked.join(known.select("prompt_key"), "prompt_key", "left_anti")

    def ask(batches):
        for batch in batches:
            found = list(all_replied(model, batch.column("prompt").to_pylist(), limits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("prompt_key"), pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())],
                names=["prompt_key", "reply", "error"],
            )

    return saved(asked.mapInArrow(ask, "prompt_key string, reply string, error string"), "replies")


def asked(rows: DataFrame, prompt: str, model: Callable[[str], str], known: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``rows`` with reply and error of a model for the column ``prompt``.

    Equal prompts are asked once; ``known`` holds replies (prompt_key, reply) of earlier runs, which are not asked for. Failures become errors,
    which are not kept as known replies.
    """
    new = replies(rows, prompt, model, known, limits)
    every = new if known is None else new.unionByName(known.select("prompt_key", "reply", F.lit(None).cast("string").alias("error")))
    return rows.withColumn("_key", key(F.col(prompt))).join(every.withColumnRenamed("prompt_key", "_key"), "_key", "left").drop("_key")
