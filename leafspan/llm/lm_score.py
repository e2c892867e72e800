"""Language-model scores from a log-frequency Bloom filter.

Method (Talbot and Osborne 2007): the count c of an n-gram is quantised to the
level 1 + floor(log2 c); the filter holds the n-gram joined with each level from
1 to its own. A count is read by probing level 1, 2, ... until the first miss,
so that a false hit overstates a count by a level with a probability that falls
off exponentially. The filter holds all training words and all training word
pairs (each text starts and finishes with the same mark), those that occur once
at level 1.

Score: the sum over tokens of log10 P(w | h),
P(w | h) = (c(h, w) + PULL * P(w)) / (c(h) + PULL), P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
where c are quantised counts (the mean of a level), c(h, w) at most c(h).

The filter is cut into segments by key; each is built by the owner of its key
range. If all segments fit BROADCAST_LIMIT they are broadcast; beyond it, the
chunks send their distinct keys to the owners, which probe their own segments.
Both ways give the same levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.llm import exchange as ex
from leafspan.llm import textnum as tn
from leafspan.llm.session import saved, small_batches

PULL = 8.0
BITS_PER_ENTRY, PROBES = 12, 6
MOST_LEVELS = 40
#: Bytes of all segments up to which they are broadcast; a worker for each core holds a copy.
BROADCAST_LIMIT = 8 << 20
#: Bytes of text whose words and pairs are counted together before they are sent.
GATHER = 16 << 20
#: Keys that enter a segment together.
BUILT = 1 << 18

END = np.uint64(0x1D8E4E27C47D124F)
_WORD, _PAIR = 0, 1
_COUNTS = pa.schema([("owner", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASK = pa.schema([("owner", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("kind", pa.int8()), ("owner", pa.int32()), ("values", pa.binary())])
#: The count that stands for each level: the middle of [2^(q-1), 2^q).
LEVEL_COUNT = np.concatenate([[0.0, 1.0], 1.5 * 2.0 ** np.arange(1, MOST_LEVELS + 24)])
LEVEL_COUNT[2] = 2.4

RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def tokens(words: tn.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with one end per text, text of each, the token before each; a text's first follows an end)."""
    n = len(words.count)
    size = words.count + 1
    last = np.cumsum(size) - 1
    out = np.full(int(size.sum()), END, tn.U)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = words.hashes()
    before = np.concatenate([[END], out[:-1]]) if len(out) else out
    return out, np.repeat(np.arange(n), size), before


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tn.mix(before * np.uint64(0x9E3779B97F4A7C15) + token, 11)


def _tally(keys: list[np.ndarray], counts: list[np.ndarray] | None = None):
    keys = np.concatenate(keys) if keys else np.zeros(0, tn.U)
    if counts is None:
        keys = np.sort(keys)
        marks = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[marks], np.diff(np.append(marks, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate(counts)[order] if len(order) else np.zeros(0, np.int64)
    marks = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[marks], np.add.reduceat(counts, marks) if len(marks) else counts


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    """A pair travels as the 32 bits after its owner's."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _gathered(words: list[np.ndarray], pairs: list[np.ndarray], bits: int):
    rows = []
    for kind, keys in ((_WORD, words), (_PAIR, pairs)):
        keys, counts = _tally(keys)
        counts = counts.astype(np.uint32)
        at = 0
        for owner, own in ex.split_by_owner(keys, bits):
            n = counts[at : at + len(own)]
            at += len(own)
            payload = own if kind == _WORD else _low(own, bits)
            many = np.flatnonzero(n > 1).astype(np.uint32)  # most pairs occur once
            rows.append((int(owner), kind, payload.tobytes(), np.concatenate([many, n[many]]).tobytes()))
    yield from ex.batches(_COUNTS, rows)


def _counter(bits: int):
    @tn.tidied
    def count(batches):
        words, pairs, held = [], [], 0
        for _, run in tn.runs(batches):
            token, _, before = tokens(run)
            words.append(token)
            pairs.append(pair_keys(before, token))
            held += len(run.data)
            if held >= GATHER:
                yield from _gathered(words, pairs, bits)
                words, pairs, held = [], [], 0
        if words:
            yield from _gathered(words, pairs, bits)

    return count


def _counts_of(keys: np.ndarray, packed: bytes) -> np.ndarray:
    many = np.frombuffer(packed, np.uint32)
    n = np.ones(len(keys), np.int64)
    n[many[: len(many) // 2]] = many[len(many) // 2 :]
    return n


class Filter:
    """One segment: a bit array probed at PROBES places per (key, level)."""

    def __init__(self, data: np.ndarray):
        self.bits = data  # uint8, 8 * len(data) places

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        levels = np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)
        size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
        there = np.zeros(size, bool)
        for start in range(0, len(keys), BUILT):
            block, own = keys[start : start + BUILT], levels[start : start + BUILT]
            for level in range(1, int(own.max(initial=0)) + 1):
                block, own = block[own >= level], own[own >= level]
                a = tn.mix(block, 2 * level + 101)
                b = tn.mix(block, 2 * level + 102) | np.uint64(1)
                for k in range(PROBES):
                    there[((a + np.uint64(k) * b) >> np.uint64(16)) % np.uint64(size)] = True
        return cls(np.packbits(there, bitorder="little"))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        left = np.arange(len(keys))
        size = 8 * len(self.bits)
        for level in range(1, MOST_LEVELS + 20):
            if not len(left):
                break
            own = keys[left]
            a = tn.mix(own, 2 * level + 101)
            b = tn.mix(own, 2 * level + 102) | np.uint64(1)
            for k in range(PROBES):
                at = ((a + np.uint64(k) * b) >> np.uint64(16)) % np.uint64(size)
                there = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                left, a, b = left[there], a[there], b[there]
            out[left] = level
        return out


def filter_key(kind: int, keys: np.ndarray) -> np.ndarray:
    return tn.mix(keys.astype(tn.U), 77 + kind)


def _built(table: pa.Table) -> pa.Table:
    """One owner's segment and its words' exact counts."""
    schema = pa.schema([("owner", pa.int32()), ("segment", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
    found, every = {}, table.to_pylist()
    for kind, item in ((_WORD, tn.U), (_PAIR, np.uint32)):
        rows = [r for r in every if r["kind"] == kind]
        keys = [np.frombuffer(r["keys"], item) for r in rows]
        counts = [_counts_of(k, r["counts"]) for k, r in zip(keys, rows, strict=True)]
        found[kind] = _tally([k.astype(tn.U) for k in keys], counts)
    del every, rows, keys, counts
    words, n_words = found[_WORD]
    pairs, n_pairs = found[_PAIR]
    segment = Filter.build(np.concatenate([filter_key(_WORD, words), filter_key(_PAIR, pairs)]), np.concatenate([n_words, n_pairs]))
    return ex.table(
        schema,
        [(table.column("owner")[0].as_py(), segment.bits.tobytes(), words.tobytes(), n_words.astype(np.int64).tobytes(), int(n_words.sum()), len(words))],
    )


def _distinct_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words, pairs = [], []
    for run in _runs(table):
        token, _, before = tokens(run)
        words.append(_tally([token])[0])
        pairs.append(_tally([pair_keys(before, token)])[0])
    return _tally(words)[0], _tally(pairs)[0]


def _runs(table: pa.Table):
    data, offsets = tn.texts(table.column("text"))
    for a, b in tn.pieces(offsets):
        yield tn.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tn.SPACE_WORDS)


def _levels_by_segment(filters: dict[int, Filter], kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """Levels of sorted keys from the broadcast segments."""
    out = []
    for owner, own in ex.split_by_owner(keys, bits):
        own = filter_key(kind, own if kind == _WORD else _low(own, bits))
        out.append(filters[owner].levels(own) if owner in filters else np.zeros(len(own), np.uint8))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _scored(table: pa.Table, exact: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray, words, pairs, n: int, v: int):
    """Rows of the result for a chunk: counts and levels are those of its sorted distinct keys."""
    total = n + 0.1 * (v + 1)
    base_log = np.log10((exact + 0.1) / total)
    count = LEVEL_COUNT[word_level]
    alone = (count + 0.1) / total
    pair_count = LEVEL_COUNT[pair_level]
    n_tokens, known, base, score = [], [], [], []
    for run in _runs(table):
        token, doc, before = tokens(run)
        docs = len(run.count)
        first = run.start_of_doc + np.arange(docs)
        at, prior = np.searchsorted(words, token), np.searchsorted(words, before)
        both = np.minimum(pair_count[np.searchsorted(pairs, pair_keys(before, token))], count[prior])
        p = (both + PULL * alone[at]) / (count[prior] + PULL)
        n_tokens.append(run.count + 1)
        known.append(np.add.reduceat((exact[at] > 0).astype(np.int64), first))
        base.append(np.add.reduceat(base_log[at], first))
        score.append(np.add.reduceat(np.log10(np.minimum(p, 1.0)), first))
    rows = table.num_rows
    join = lambda x: np.concatenate(x) if x else np.zeros(0)
    return pa.Table.from_arrays(
        [
            table.column("doc_id").combine_chunks(),
            table.column("held_out").combine_chunks(),
            pa.array(join(n_tokens), pa.int64()),
            pa.array(join(known), pa.int64()),
            pa.array(np.full(rows, n), pa.int64()),
            pa.array(join(base), pa.float64()),
            pa.array(join(score), pa.float64()),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def held_out() -> F.Column:
    """crc32 of the id as text, modulo 10, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


def scores(docs: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Scores of all texts of ``docs`` (doc_id, text) under a model of those that are not held out.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that
    occur in training), train_tokens, base_score (add-0.1 unigrams) and score
    (the filter's). A null text is an empty one: its only token is the end.
    Repeated rows are learnt and scored as often as they occur. Without training
    rows all counts are 0. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    chunks, bits, _ = ex.layout(docs)
    train = docs.filter(~held_out()).select("text")
    counts = train.mapInArrow(_counter(bits), "owner int, kind byte, keys binary, counts binary")
    model = counts.groupBy("owner").applyInArrow(
        _built, "owner int, segment binary, words binary, counts binary, n long, v long"
    )
    model = saved(model, "lm")
    n, v, size = model.agg(F.sum("n"), F.sum("v"), F.sum(F.length("segment"))).first()
    n, v, size = n or 0, v or 0, size or 0

    dealt = ex.chunked(docs.withColumn("held_out", held_out()), chunks)
    whole = size <= broadcast_limit
    kinds = [_WORD] if whole else [_WORD, _PAIR]

    def ask(key, table):
        found = _distinct_keys(table)
        return ex.table(
            _ASK,
            [
                (int(owner), key[0].as_py(), kind, (own if kind == _WORD else _low(own, bits)).tobytes())
                for kind in kinds
                for owner, own in ex.split_by_owner(found[kind], bits)
            ],
        )

    def answer(key, asked, built):
        rows, out = asked.to_pylist(), []
        if built.num_rows:
            keys = np.frombuffer(built.column("words")[0].as_py(), tn.U)
            exact = np.frombuffer(built.column("counts")[0].as_py(), np.int64)
            segment = None if whole else Filter(np.frombuffer(built.column("segment")[0].as_py(), np.uint8))
        for r in rows:
            own = np.frombuffer(r["keys"], tn.U if r["kind"] == _WORD else np.uint32)
            values, level = np.zeros(len(own), np.int64), np.zeros(len(own), np.uint8)
            if built.num_rows:
                if r["kind"] == _WORD and len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    values = np.where(keys[at] == own, exact[at], 0)
                if segment:
                    level = segment.levels(filter_key(r["kind"], own))
            if r["kind"] == _WORD:
                out.append((r["chunk"], _WORD, r["owner"], values.tobytes()))
            if not whole:
                out.append((r["chunk"], r["kind"] + 2, r["owner"], level.tobytes()))
        return ex.table(_ANSWER, out)

    shared = None
    if whole:
        segments = {r["owner"]: r["segment"] for r in model.select("owner", "segment").toLocalIterator()}
        shared = spark.sparkContext.broadcast({k: bytes(x) for k, x in segments.items()})

    def score(key, table, answers):
        rows = sorted(answers.to_pylist(), key=lambda r: r["owner"])
        part = lambda kind, item: np.concatenate([np.zeros(0, item), *(np.frombuffer(r["values"], item) for r in rows if r["kind"] == kind)])
        words, pairs = _distinct_keys(table)
        if whole:
            filters = {k: Filter(np.frombuffer(x, np.uint8)) for k, x in shared.value.items()}
            levels = [_levels_by_segment(filters, kind, keys, bits) for kind, keys in ((_WORD, words), (_PAIR, pairs))]
        else:
            levels = [part(kind + 2, np.uint8) for kind in (_WORD, _PAIR)]
        return _scored(table, part(_WORD, np.int64), *levels, words, pairs, n, v)

    asked = dealt.groupBy("chunk").applyInArrow(ask, "owner int, chunk int, kind byte, keys binary")
    wanted = model.select("owner", F.lit(b"").alias("segment") if whole else "segment", "words", "counts")
    answers = asked.groupBy("owner").cogroup(wanted.groupBy("owner")).applyInArrow(
        answer, "chunk int, kind byte, owner int, values binary"
    )
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, RESULT)
