"""Packed exchange of hashed keys between chunks of a corpus and the owners of key ranges.

A chunk is a bounded share of the documents. It sends each owner its distinct
keys as one binary row, and gets back a binary row per owner. This costs a few
bytes a key instead of a shuffled row a key, and a key that is very common
costs a chunk no more than a rare one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.llm.session import total_bytes

LEAST_CHUNK, MOST_CHUNK = 4 << 20, 64 << 20
#: Keys that one owner should meet at most on average, and bytes of text a word takes at least on average.
OWNER_KEYS, WORD_BYTES = 1 << 21, 6


def layout(docs: DataFrame) -> tuple[int, int, int]:
    """(chunks, log2 of owners, bytes of all texts). Chunks grow from 4 to 64 MB with the corpus."""
    size = total_bytes(docs)
    chunk = min(max(size // 256, LEAST_CHUNK), MOST_CHUNK)
    owners = max(size / WORD_BYTES / OWNER_KEYS, 8)
    return max(size // chunk + 1, 8), min(math.ceil(math.log2(owners)), 24), size


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, doc_id, text, and further columns of ``docs``), dealt out by chunk.

    The chunk comes from doc_id and the text's length, so that rows of one id do
    not have to meet in one chunk.
    """
    n = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")
    return docs.select(n.alias("chunk"), *docs.columns).repartition(chunks, "chunk")


def split_by_owner(keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Sorted 64-bit keys cut by their top ``bits``: (owner, keys) for owners with keys."""
    if not len(keys):
        return []
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    marks = np.append(np.searchsorted(keys, edges), len(keys))
    return [(i, keys[marks[i] : marks[i + 1]]) for i in np.flatnonzero(np.diff(marks))]


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batches(schema: pa.Schema, rows: list[tuple], at_once: int = 64):
    """Record batches of a few rows each: binary rows can be large."""
    for i in range(0, len(rows), at_once):
        yield from table(schema, rows[i : i + at_once]).to_batches()
