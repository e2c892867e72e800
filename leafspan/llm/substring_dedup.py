"""Removal of long word sequences that occur more than once.

Method: fixed-block anchors. Any window of WINDOW words holds a whole block of
ANCHOR = (WINDOW + 1) / 2 words that starts at a multiple of ANCHOR in its
document. Those non-overlapping blocks are the index; every rolling window of
ANCHOR words probes it. A block found at a second place is a live anchor; the
hits are extended to all windows of WINDOW words around them, which are then
compared whole (by a 64-bit number plus the bits that chose its owner, from
independent hashes). Overlapping repeated windows unite to maximal repeats.

Texts are dealt out once by chunk. Probes travel as sorted 32-bit numbers per
(chunk, owner); a false agreement there only adds a window to be compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafspan.llm import exchange as ex
from leafspan.llm import textnum as tn
from leafspan.llm.session import small_batches

WINDOW = 35

_SENT = pa.schema([("owner", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary())])
_BACK = pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("keys", pa.binary())])
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>"


def _pieces(texts: pa.ChunkedArray):
    data, offsets = tn.texts(texts)
    for a, b in tn.pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        yield part, tn.Words(part, offsets[a : b + 1] - offsets[a], tn.SPACE_WORDS)


def _counted(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted keys, each once if it occurs once and twice if it occurs more often."""
    keys = np.concatenate(parts) if parts else np.zeros(0, tn.U)
    keys.sort()
    if len(keys) < 3:
        return keys
    return keys[np.concatenate([[True, True], keys[2:] != keys[:-2]])]


def _distinct(keys: np.ndarray) -> np.ndarray:
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _inside(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def _low(owner_keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the owner's."""
    return ((owner_keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _probes(chunk: int, texts, anchor: int, bits: int):
    rolling, blocks = [], []
    for _, words in _pieces(texts):
        at = tn.window_starts(words.count, words.start_of_doc, anchor)
        if len(at):
            h = tn.window_hashes(words.hashes(tn.EXACT), anchor)[at]
            rolling.append(h)
            blocks.append(h[(at - words.start_of_doc[words.doc[at]]) % anchor == 0])
    out = []
    for kind, keys in ((0, _counted(rolling)), (1, _distinct(_counted(blocks)))):
        out += [(o, chunk, kind, _low(k, bits).tobytes()) for o, k in ex.split_by_owner(keys, bits)]
    return ex.table(_SENT, out)


def _join_payloads(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32)


def _live(table: pa.Table) -> pa.Table:
    """Of the probes that met at one owner: those that equal a block and occur at two places."""
    rows = table.to_pylist()
    rolling = [(r["chunk"], np.frombuffer(r["keys"], np.uint32)) for r in rows if r["kind"] == 0]
    blocks = [np.frombuffer(r["keys"], np.uint32) for r in rows if r["kind"] == 1]
    if not blocks or not rolling:
        return ex.table(_BACK, [])
    every = np.sort(np.concatenate([k for _, k in rolling]))
    twice = _distinct(every[1:][every[1:] == every[:-1]])
    live = twice[_inside(twice, np.sort(np.concatenate(blocks)))]
    out = []
    for chunk, keys in rolling:
        own = _distinct(keys)
        own = own[_inside(own, live)]
        if len(own):
            out.append((chunk, rows[0]["owner"], own.tobytes()))
    return ex.table(_BACK, out)


def _keys_of(back: pa.Table, bits: int) -> np.ndarray:
    """What came back to a chunk, as sorted (owner, 32 bits) numbers."""
    parts = [
        np.frombuffer(k, np.uint32).astype(tn.U) | np.uint64(o << 32)
        for o, k in zip(back.column("owner").to_pylist(), back.column("keys").to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, tn.U)


def _windows(words: tn.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, owner's number, 64-bit number) of each window of one text."""
    at = tn.window_starts(words.count, words.start_of_doc, window)
    h = words.hashes(tn.EXACT)
    return at, tn.window_hashes(h, window, seed=1)[at] if len(at) else at, tn.window_hashes(h, window, seed=2)[at] if len(at) else at


def _extended(chunk: int, texts, live: np.ndarray, anchor: int, window: int, bits: int):
    """Numbers of all windows around a live anchor, by owner."""
    one, two = [], []
    for _, words in _pieces(texts) if len(live) else ():
        at = tn.window_starts(words.count, words.start_of_doc, anchor)
        if not len(at):
            continue
        h = tn.window_hashes(words.hashes(tn.EXACT), anchor)[at]
        sums = np.zeros(len(words.first) + 1, np.int64)
        sums[at[_inside(h >> np.uint64(32 - bits), live)] + 1] = 1
        np.cumsum(sums, out=sums)
        start, a, b = _windows(words, window)
        if len(start):
            near = sums[start + window - anchor + 1] > sums[start]
            one.append(a[near])
            two.append(b[near])
    if not one:
        return ex.table(_SENT, [])
    a, b = np.concatenate(one), np.concatenate(two)
    owner = (a >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
    order = np.lexsort((b, owner))
    owner, b = owner[order], b[order]
    if len(b) > 2:
        keep = np.concatenate([[True, True], (b[2:] != b[:-2]) | (owner[2:] != owner[:-2])])
        owner, b = owner[keep], b[keep]
    marks = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else [0]
    return ex.table(
        _SENT, [(int(owner[i]), chunk, 0, b[i:j].tobytes()) for i, j in zip(marks[:-1], marks[1:], strict=True)]
    )


def _repeated(table: pa.Table) -> pa.Table:
    rows = [(r["chunk"], r["owner"], np.frombuffer(r["keys"], tn.U)) for r in table.to_pylist()]
    every = np.sort(np.concatenate([k for *_, k in rows]))
    twice = _distinct(every[1:][every[1:] == every[:-1]])
    out = []
    for chunk, owner, keys in rows:
        own = _distinct(keys)
        own = own[_inside(own, twice)]
        if len(own):
            out.append((chunk, owner, own.tobytes()))
    return ex.table(_BACK, out)


def _removed(docs: pa.Table, back: pa.Table, window: int) -> pa.Table:
    parts = [np.frombuffer(k, tn.U) for k in back.column("keys").to_pylist()]
    repeated = _distinct(np.sort(np.concatenate(parts))) if parts else np.zeros(0, tn.U)
    n_words, n_removed, shas, spans = [], [], [], []
    for data, words in _pieces(docs.column("text")):
        covered = np.zeros(len(words.first) + 1, np.int32)
        if len(repeated):
            start, _, b = _windows(words, window)
            if len(start):
                hit = start[_inside(b, repeated)]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + window, -1)
                np.cumsum(covered, out=covered)
        gone = covered[:-1] > 0
        raw = data.tobytes()
        for i, (a, n) in enumerate(zip(words.start_of_doc.tolist(), words.count.tolist(), strict=True)):
            own = gone[a : a + n]
            removed = int(own.sum())
            body = raw[words.offsets[i] : words.offsets[i + 1]].split()
            edges = []
            if removed:
                turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                edges = turns.reshape(-1, 2).tolist()
                kept, last = [], 0
                for x, y in edges:
                    kept += body[last:x]
                    last = y
                body = kept + body[last:]
            n_words.append(n)
            n_removed.append(removed)
            shas.append(hashlib.sha256(b" ".join(body)).hexdigest())
            spans.append([{"start": x, "end": y} for x, y in edges])
    return pa.Table.from_arrays(
        [docs.column("doc_id").combine_chunks(), *(pa.array(x, f.type) for x, f in zip((n_words, n_removed, shas, spans), list(_OUT)[1:], strict=True))],
        schema=_OUT,
    )


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): what is left after removing repeated windows.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space) and repeats, the word spans [start, end) that go. Words are runs
    of bytes other than ASCII white space, taken as they are. A null text has no
    words; a text of fewer than ``window`` words loses none; equal rows count as
    two places. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    anchor = (window + 1) // 2
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    chunks, bits, _ = ex.layout(docs)
    dealt = ex.chunked(docs, chunks)

    def probes(key, table):
        return _probes(key[0].as_py(), table.column("text"), anchor, bits)

    def extended(key, table, back):
        return _extended(key[0].as_py(), table.column("text"), _keys_of(back, bits), anchor, window, bits)

    def removed(key, table, back):
        return _removed(table, back, window)

    sent, returned = "owner int, chunk int, kind byte, keys binary", "chunk int, owner int, keys binary"
    live = dealt.groupBy("chunk").applyInArrow(probes, sent).groupBy("owner").applyInArrow(_live, returned)
    around = dealt.groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(extended, sent)
    back = around.groupBy("owner").applyInArrow(_repeated, returned)
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(removed, RESULT)
