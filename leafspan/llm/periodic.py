"""Runs: stretches of a text that repeat a short sequence of words again and again.

Method: block matching. A run of period q and of at least four periods holds, for the
scale s = the greatest power of two up to (3q + 1) / 2, a block of s words that begins at a
multiple of s and occurs again q words further on. So for each scale the aligned
blocks are the keys (sequences of word numbers) of an automaton that reads the text, and
an occurrence counts if its distance from the block belongs to the scale. From there
equality at that distance is extended word by word in both directions.

Blocks are keys only if each pair of neighbouring words in them occurs again within the scale's
greatest distance, and if they do not lie, with that distance, within a run that a smaller
scale has found: by the theorem of Fine and Wilf such a block can only lead to that run again.
Texts are read in segments that grow with the scale alone, so that an automaton
is no larger for a longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafspan.llm import textnum as tn
from leafspan.llm.session import small_batches

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a text that one automaton handles, or four blocks if those are more.
SEGMENT = 1 << 16
#: Words of a block that make up its key; what follows is compared by the extension.
MOST_KEY = 1 << 16

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, n_kept long, collapsed_sha256 string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def distances(scale: int) -> tuple[int, int]:
    """The least and the greatest period whose blocks have ``scale`` words."""
    return (2 * scale + 1) // 3, (4 * scale - 2) // 3


def _numbers(words: tn.Words) -> np.ndarray:
    """A number per word; equal words of the piece have the same one."""
    size = words.end - words.first
    data = words.data[tn.ranges(words.first, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return found.dictionary_encode().indices.to_numpy()


def _next_pair(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many words further on the pair of a word and its right neighbour begins again in the same text; a huge number if it does not."""
    n = len(ids)
    far = np.full(n, 1 << 40, np.int64)
    if n < 3:
        return far
    pair = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    order = np.argsort(pair, kind="stable")
    a, b = order[:-1], order[1:]
    again = (pair[a] == pair[b]) & (doc[a] == doc[b])
    far[a[again]] = (b - a)[again]
    return far


def _blocks(far: np.ndarray, start: np.ndarray, count: np.ndarray, scale: int) -> np.ndarray:
    """First words of the aligned blocks (from each text's first word on) whose pairs all occur again soon enough."""
    bad = np.concatenate([[0], np.cumsum(far > distances(scale)[1])])
    per_doc = count // scale
    at = tn.ranges(np.zeros(len(start), np.int64), per_doc) * scale + np.repeat(start, per_doc)
    return at[bad[at + scale - 1] == bad[at]]


def _extended(ids: np.ndarray, at: int, to: int, q: int) -> tuple[int, int]:
    """The longest stretch around [at, to) whose words equal those q further on."""
    step = 64
    while at:
        low = max(at - step, 0)
        differs = np.flatnonzero(ids[low:at] != ids[low + q : at + q])
        if len(differs):
            at = low + int(differs[-1]) + 1
            break
        at, step = low, step * 2
    step, last = 64, len(ids) - q
    while to < last:
        high = min(to + step, last)
        differs = np.flatnonzero(ids[to:high] != ids[to + q : high + q])
        if len(differs):
            to += int(differs[0])
            break
        to, step = high, step * 2
    return at, to


def _seeds(ids: np.ndarray, blocks: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(distance, block) of occurrences of ``blocks`` at distances that fit the scale; segment by segment."""
    least, most = distances(scale)
    key = min(scale, MOST_KEY)
    part = blocks // max(SEGMENT, 4 * scale)
    found = []
    for own in np.split(blocks, np.flatnonzero(np.diff(part)) + 1):
        low = int(own[0])
        text = ids[low : int(own[-1]) + key + most].tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        number: dict[tuple, int] = {}
        of_block = {}
        for b in (own - low).tolist():
            word = tuple(text[b : b + key])
            of_block[b] = number.setdefault(word, len(number))
            if of_block[b] == len(number) - 1:
                automaton.add_word(word, of_block[b])
        automaton.make_automaton()
        shift = -low % scale  # the first multiple of scale in the segment
        for end, word in automaton.iter(tuple(text)):
            at = end - key + 1
            b = (at - least - shift) // scale * scale + shift  # the only aligned block that can be near enough
            if at - b <= most and of_block.get(b) == word:
                found.append((at - b, b + low))
    return sorted(found)


def _runs(ids: np.ndarray, blocks_of: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text by start, then period; blocks_of: scales from small to large with their blocks."""
    found: dict[tuple[int, int], int] = {}
    inside = np.zeros(len(ids), np.int64)  # the greatest end of the runs that hold a word
    for scale, blocks in blocks_of:
        most = distances(scale)[1]
        if found:
            blocks = blocks[inside[blocks] < np.minimum(blocks + scale + most, len(ids))]
        if not len(blocks):
            continue
        new, reached, last = [], 0, 0
        for q, b in _seeds(ids, blocks, scale):
            if q != last:
                last, reached = q, 0
            if b < reached or inside[b] >= b + q + scale:
                continue
            at, to = _extended(ids, b, b + min(scale, MOST_KEY), q)
            reached, end = to, to + q
            if end - at >= max(LEAST_WORDS, LEAST_PERIODS * q) and (at, end) not in found:
                found[at, end] = q
                new.append((at, end))
        for at, end in new:
            np.maximum(inside[at:end], end, out=inside[at:end])
    return sorted((at, end - at, q) for (at, end), q in found.items())


def _columns(rows: pa.RecordBatch, words: tn.Words, reordered: Callable[[int | None, int], np.ndarray | None] | None):
    """RESULT's columns for a piece of texts."""
    ids = _numbers(words).astype(np.int64) if len(words.first) else np.zeros(0, np.int64)
    start, count = words.start_of_doc, words.count
    orders: dict[int, np.ndarray] = {}
    doc_ids = rows.column("doc_id").to_pylist()
    if reordered:
        for i, (doc, n) in enumerate(zip(doc_ids, count.tolist(), strict=True)):
            order = reordered(doc, n) if n else None
            if order is not None:
                orders[i] = order
                ids[start[i] : start[i] + n] = ids[start[i] : start[i] + n][order]
    far = _next_pair(ids, words.doc)
    blocks_of: dict[int, list] = {}
    scale = 2
    while distances(scale)[0] * LEAST_PERIODS <= int(count.max(initial=0)):
        blocks = _blocks(far, start, count, scale)
        owner = words.doc[blocks]
        for own in np.split(blocks, np.flatnonzero(np.diff(owner)) + 1) if len(blocks) else []:
            i = int(words.doc[own[0]])
            blocks_of.setdefault(i, []).append((scale, own - start[i]))
        scale *= 2
    raw = words.data.tobytes()
    runs, kept, shas = [], [], []
    for i, n in enumerate(count.tolist()):
        own = _runs(ids[start[i] : start[i] + n], blocks_of[i]) if i in blocks_of else []
        body = raw[words.offsets[i] : words.offsets[i + 1]].split()
        if i in orders:
            body = [body[j] for j in orders[i].tolist()]
        if own:
            body = [body[j] for j in np.flatnonzero(~_dropped(own, n)).tolist()]
        runs.append([{"start": a, "length": length, "period": q} for a, length, q in own])
        kept.append(len(body))
        shas.append(hashlib.sha256(b" ".join(body)).hexdigest())
    return [pa.array(doc_ids, pa.int64()), pa.array(count, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.int64()), pa.array(shas, pa.string())]


def _dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words lie in a run, after its first period."""
    turns = np.zeros(n + 1, np.int64)
    for a, length, q in runs:
        turns[a + q] += 1
        turns[a + length] -= 1
    return np.cumsum(turns)[:-1] > 0


def periodic_runs(docs: DataFrame, reordered: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, n_kept, collapsed_sha256), a row per row of ``docs`` (doc_id, text).

    Words are stretches of bytes other than ASCII white space. ``runs`` are all stretches of words
    with smallest period q (words q apart are equal) of at least 6 words and of at least 4 q that no neighbouring word extends, by start, then
    period; they may overlap. n_kept counts the words that no run holds after its first period, and collapsed_sha256 is the
    digest of these, joined by one space. ``reordered(doc_id, n)`` may give the places of the words to be read instead.
    Null and empty texts have no words and no runs; repeated rows and null ids are rows like others; other columns are not read;
    an empty table gives an empty result. There is no shuffle, and a text is handled whole by one task.
    """
    small_batches(docs.sparkSession)

    @tn.tidied
    def found(batches):
        for rows, words in tn.runs(batches):
            columns = _columns(rows, words, reordered)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "n_kept", "collapsed_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(found, RESULT)


def without_repetition(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of rows that have runs replaced by their remaining words, joined by one space; other texts stay as they are.

    All columns stay as they are but ``text``; see periodic_runs for odd rows.
    """
    small_batches(docs.sparkSession)

    @tn.tidied
    def collapsed(batches):
        for rows, words in tn.runs(batches):
            runs, texts = _columns(rows.select(["text"]).add_column(0, "doc_id", pa.nulls(rows.num_rows, pa.int64())), words, None)[2].to_pylist(), rows.column("text").to_pylist()
            for i, own in enumerate(runs):
                if own:
                    body = texts[i].encode().split()
                    gone = _dropped([(r["start"], r["length"], r["period"]) for r in own], len(body))
                    texts[i] = b" ".join(w for w, d in zip(body, gone.tolist(), strict=True) if not d).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in rows.schema.names], schema=rows.schema.set(rows.schema.get_field_index("text"), pa.field("text", pa.string())))

    return docs.mapInArrow(collapsed, docs.schema)
