"""Languages of documents as mixtures, by expectation-maximisation.

Method: each learned language has a distribution over hashed character triples
(of UTF-8 bytes, A-Z lower-cased, with the word's borders). A word's likelihood in
a language is the product over its triples. Expectation-maximisation over a
document's words gives the languages' proportions; among the best 1, 2, ...
languages the set with the lowest -2 log L + PENALTY * size * log(words) is selected.
Sets of up to ALWAYS languages are weighed in any case, and larger ones as long as the
last language lowered that cost.
The prediction is the language of that set with the largest proportion.

Learning counts all triples of all training documents (as many numbers as
languages times BUCKETS, whatever the corpus). The table of log probabilities is
broadcast; it takes 128 KB a language. Texts are handled in runs that are the shorter the more
languages there are, and each different word of a run is looked up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.llm import textnum as tn
from leafspan.llm.session import small_batches

BUCKETS = 1 << 15
ALPHA = 0.5
ITERATIONS = 12
ALWAYS = 3
PENALTY = 2.0
#: The least log likelihood of a word in a language, beside its best one.
LEAST_LOG = -69.0
#: Bytes of text handled at a time are halved, and so on, from this many languages on.
MANY = 32
UNDETERMINED = "und"


def _triples(words: tn.Words) -> np.ndarray:
    """The bucket of each byte's triple: the byte, the one before and the one after it within the word."""
    fold = tn._fold[words.data].astype(np.uint32)
    before = np.concatenate([[np.uint32(0)], fold[:-1]]) if len(fold) else fold
    after = np.concatenate([fold[1:], [np.uint32(0)]]) if len(fold) else fold
    before[words.first] = 1
    after[words.end - 1] = 1
    code = (before << np.uint32(16)) | (fold << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32)


@tn.tidied
def _tallies(batches):
    """Rows (lang, bucket, n) of a task's triples; the tables of up to MANY languages are held at a time."""
    counts: dict[str, np.ndarray] = {}

    def told():
        for lang, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(c[some])],
                names=["lang", "bucket", "n"],
            )
        counts.clear()

    for rows, words in tn.runs(batches):
        if not len(words.first):
            continue
        bucket, inside = _triples(words), tn.SPACE_WORDS[words.data]
        langs = rows.column("lang").dictionary_encode()
        own = np.repeat(langs.indices.to_numpy(), np.diff(words.offsets))[inside]
        bucket = bucket[inside]
        order = np.argsort(own, kind="stable") if len(langs.dictionary) > 1 else slice(None)
        own, bucket = own[order], bucket[order]
        borders = np.searchsorted(own, np.arange(len(langs.dictionary) + 1))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            if lang not in counts:
                if len(counts) >= MANY:
                    yield from told()
                counts[lang] = np.zeros(BUCKETS, np.int64)
            counts[lang] += np.bincount(bucket[borders[i] : borders[i + 1]], minlength=BUCKETS)
    yield from told()


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (BUCKETS x languages) from rows with text and lang."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    counts = np.full((BUCKETS, len(languages)), ALPHA, np.float32)
    if languages:
        sums = rows.mapInArrow(_tallies, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        found = sums.toArrow()  # at most languages * BUCKETS rows of numbers
        at = pc.index_in(found.column("lang"), value_set=pa.array(languages, found.column("lang").type)).to_numpy()
        counts[found.column("bucket").to_numpy(), at] += found.column("n").to_numpy()
    return languages, np.log(counts / counts.sum(axis=0, keepdims=True, dtype=np.float64)).astype(np.float32)


def _em(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray):
    """Proportions (languages x texts) and log likelihoods.

    like: languages x different words of each text, scaled to a largest of 1; weight: how often each word
    occurs; doc, first: the text of each word, and where a text's words begin; allowed: languages x texts.
    """
    count = np.add.reduceat(weight, first)
    share = (allowed / allowed.sum(axis=0)).astype(np.float32)
    for _ in range(ITERATIONS):
        part = like * np.take(share, doc, axis=1)
        part *= weight / part.sum(axis=0)
        share = np.add.reduceat(part, first, axis=1) / count
    total = np.log((like * np.take(share, doc, axis=1)).sum(axis=0).astype(np.float64)) * weight
    return share, np.add.reduceat(total, first)


def _word_logs(words: tn.Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logs, word, text, weight): log likelihoods of different words (languages x words, largest 0), and each text's different words with counts."""
    _, place, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    size = words.end[place] - words.first[place]
    data = words.data[tn.ranges(words.first[place], size)]
    ends = np.cumsum(size)
    own = tn.Words.__new__(tn.Words)
    own.data, own.first, own.end = data, ends - size, ends
    sums = np.add.reduceat(table[_triples(own)], own.first, axis=0, dtype=np.float64).T
    logs = np.maximum(sums - sums.max(axis=0), LEAST_LOG)
    code, weight = np.unique(words.doc * len(place) + inverse, return_counts=True)
    return np.ascontiguousarray(logs), code % len(place), code // len(place), weight.astype(np.float32)


def mixtures(words: tn.Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(selected proportions, proportions over all languages), texts x languages; texts without words get zeros."""
    docs, n = len(words.count), table.shape[1]
    selected, overall = np.zeros((docs, n)), np.zeros((docs, n))
    some = np.flatnonzero(words.count)
    if not len(some) or not n:
        return selected, overall
    logs, word, text, weight = _word_logs(words, table)
    doc = np.searchsorted(some, text)
    first = np.searchsorted(doc, np.arange(len(some)))
    count = words.count[some]
    logs = np.take(logs, word, axis=1)
    like = np.exp(logs).astype(np.float32)
    full, _ = _em(like, weight, doc, first, np.ones((n, len(some))))
    single = np.add.reduceat(logs * weight, first, axis=1)
    order = np.argsort(-full, axis=0, kind="stable")
    top = single.argmax(axis=0)
    chosen = np.zeros_like(full)
    chosen[top, np.arange(len(some))] = 1
    cost = -2 * single.max(axis=0) + PENALTY * np.log(count)
    left, last = np.arange(len(some)), cost.copy()  # the texts that go on, and their costs one language before
    for size in range(2, n + 1):
        allowed = np.zeros((n, len(left)))
        np.put_along_axis(allowed, order[:size, left], 1.0, axis=0)
        share, fit = _em(like, weight, doc, first, allowed)
        now = -2 * fit + PENALTY * size * np.log(count)
        better = now < cost[left]
        chosen[:, left[better]], cost[left[better]] = share[:, better], now[better]
        if size >= ALWAYS:
            fell = now < last
            if not fell.any():
                break
            stays = fell[doc]
            like, weight, left, count, now = like[:, stays], weight[stays], left[fell], count[fell], now[fell]
            doc = (np.cumsum(fell) - 1)[doc[stays]]
            first = np.searchsorted(doc, np.arange(len(left)))
        last = now
    selected[some], overall[some] = chosen.T, full.T
    return selected, overall


def held_out():
    """crc32 of the id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, proportions), a row per row of ``docs``.

    Learns from text and lang of rows that are not held out and have both;
    predicts from the text alone. lang_pred is 'und' with score 0 for a null text, a text without
    letters, or when nothing was learned; score is the share of the predicted
    language among all; of equal ones the first by code point is predicted. proportions maps the selected languages to their shares.
    Repeated rows are learned as often as they occur. Columns other than doc_id, text and lang
    are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    names, table = learned(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    @tn.tidied
    def predict(batches):
        names, table = shared.value
        for rows, words in tn.runs(batches, limit=max(tn.PIECE * MANY // max(len(names), MANY), 1 << 14)):
            chosen, overall = mixtures(words, table)
            has = np.array(rows.column("letters").to_pylist(), bool)
            best = chosen.argmax(axis=1) if len(names) else np.zeros(len(has), int)
            ok = has & (chosen.sum(axis=1) > 0) if len(names) else np.zeros(len(has), bool)
            score = [float(min(max(overall[i, best[i]], 0.0), 1.0)) if ok[i] else 0.0 for i in range(len(has))]
            shares = [[(names[j], float(chosen[i, j])) for j in np.flatnonzero(chosen[i] > 0.001)] if ok[i] else [] for i in range(len(has))]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("held_out"),
                    pa.array([names[best[i]] if ok[i] else UNDETERMINED for i in range(len(has))], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(shares, pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "proportions"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = docs.select("doc_id", held_out().alias("held_out"), letters.alias("letters"), "text")
    return asked.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")
