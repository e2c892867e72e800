"""Quality rules: a learned decision list over text statistics.

Method: sequential covering (as in RIPPER, Cohen 1995). Labelled documents are
split into a growing and a pruning part. A rule for bad documents starts empty
and takes the threshold condition with the best information gain until it
covers no good document of the growing part; conditions are then dropped from
its end while that does not lower (bad - good) / (bad + good) on the pruning part.
Covered documents go, and the next rule is grown, until a rule is wrong too often.
The list is emitted as an ordered CASE expression over the statistics.

Statistics are taken of whole texts. The rules are fitted on at most MOST_LABELLED labelled rows
(those with the smallest hashes of their ids), brought to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.llm import textnum as tn
from leafspan.llm.session import small_batches

#: The bound of the sample of labelled rows that the rules are fitted on.
MOST_LABELLED = 50_000
LEAST_PRECISION = 0.9
LEAST_COVERED = 3
#: Fixed value: the symbols of the base statistic.
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_marks", "n_pipes"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _MARK, _PIPE = _table(SYMBOLS), _table(b"!?"), _table(b"|")
_UPPER, _LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 256)]))


def statistics(words: tn.Words) -> dict[str, np.ndarray]:
    data, offsets, docs = words.data, words.offsets, len(words.count)
    out = {"n_words": words.count.astype(np.int64)}
    starts_char = (data & 0xC0) != 0x80
    out["word_chars"] = _per_text(starts_char & tn.SPACE_WORDS[data], offsets)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK), ("n_pipes", _PIPE)):
        out[name] = _per_text(kind[data], offsets)

    # lines with a word: runs of bytes other than \n
    lines = tn.Words(data, offsets, _NOT_BREAK)
    has = np.searchsorted(words.first, lines.end) > np.searchsorted(words.first, lines.first)
    h = lines.hashes(tn.EXACT)[has]
    doc = lines.doc[has]
    out["n_lines"] = np.bincount(doc, minlength=docs)
    key = np.unique(tn.mix(h + doc.astype(tn.U) * np.uint64(0x9E3779B97F4A7C15), 5), return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[key], minlength=docs)

    w = words.hashes(tn.EXACT)
    at = tn.window_starts(words.count, words.start_of_doc, 3)
    covered = np.zeros(len(w) + 1, np.int64)
    if len(at):
        g = tn.mix(tn.window_hashes(w, 3)[at] + words.doc[at].astype(tn.U) * np.uint64(0x9E3779B97F4A7C15), 7)
        order = np.argsort(g)
        same = g[order][1:] == g[order][:-1]
        again = np.zeros(len(g), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + 3, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(covered[:-1]) > 0], minlength=docs)
    return {k: v.astype(np.int64) for k, v in out.items()}


_NOT_BREAK = tn.classes([10])


def _measured(names: list[str], text: str):
    @tn.tidied
    def measure(batches):
        for rows, words in tn.runs(batches, column=text):
            found = statistics(words)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in names), *(pa.array(found[c]) for c in BASE + MORE)], names=[*names, *BASE, *MORE]
            )

    return measure


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of each row, named _c0, _c1, ..., with the statistics of its text."""
    small_batches(docs.sparkSession)
    types = dict(docs.dtypes)
    inner = {c: f"_c{i}" for i, c in enumerate(carry)}
    asked = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in inner.items()), *([] if "text" in inner else ["text"]))
    schema = ", ".join([*(f"{x} {types[c]}" for c, x in inner.items()), *(f"{c} long" for c in BASE + MORE)])
    return asked.mapInArrow(_measured(list(inner.values()), inner.get("text", "text")), schema)


#: What conditions test: shares of a text, so that rules hold for any length, and the number of words itself.
RATIOS: dict[str, tuple[str, str]] = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "words": ("n_words", ""),
}


def features(get) -> dict[str, Column]:
    one = F.lit(1)
    return {
        name: get(a) / (F.greatest(get(b), one) if b else one) for name, (a, b) in RATIOS.items()
    }


Condition = tuple[str, str, float]


def _holds(x: dict[str, np.ndarray], rule: list[Condition], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, side, cut in rule:
        out &= x[name] >= cut if side == ">=" else x[name] <= cut
    return out


def _best(x, bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The condition with the largest gain over the rows inside."""
    p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
    if not p0 or not n0:
        return None
    before = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name in RATIOS:
        v = x[name][inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[inside][order]
        edge = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edge):
            continue
        p, n = np.cumsum(b), np.cumsum(~b)
        for side, pos, neg in ((">=", p[-1] - p[edge - 1], n[-1] - n[edge - 1]), ("<=", p[edge - 1], n[edge - 1])):
            gain = pos * (np.log2(np.maximum(pos, 1e-9) / np.maximum(pos + neg, 1e-9)) - before)
            gain[pos < LEAST_COVERED] = -1
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], (name, side, float((v[edge[i]] + v[edge[i] - 1]) / 2))
    return found


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Rules for bad rows, in order. The rows' own order decides the split into growing and pruning parts."""
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left, rules = np.ones(n, bool), []
    while bad[left & grow].sum() >= LEAST_COVERED:
        rule, inside = [], left & grow
        while (~bad[inside]).any():
            condition = _best(x, bad, inside)
            if condition is None:
                break
            rule.append(condition)
            inside = left & grow & _holds(x, rule, n)
        if not rule:
            break

        def worth(r):
            c = left & ~grow & _holds(x, r, n)  # noqa: B023
            p, q = bad[c].sum(), (~bad[c]).sum()
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = left & _holds(x, rule, n)
        if covered.sum() < LEAST_COVERED or bad[covered].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fitted(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """The decision list from documents that pass the base test and have a label ``quality`` of 0 or 1."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")), "doc_id"  # at most MOST_LABELLED rows
    )
    stats = measured(rows, ["doc_id", "quality"]).withColumnsRenamed({"_c0": "doc_id", "_c1": "quality"})
    values = stats.filter(~base_failed()).select("quality", "doc_id", *(c.cast("double").alias(n) for n, c in features(F.col).items()))
    table = values.orderBy(F.xxhash64("doc_id"), "doc_id", *RATIOS).limit(MOST_LABELLED).toArrow()
    x = {name: table.column(name).to_numpy() for name in RATIOS}
    return decision_list(x, table.column("quality").to_numpy() == 0)


def verdict(rules: list[list[Condition]], get=F.col) -> Column:
    """The place of the first rule that holds, as an ordered CASE expression; null if none does."""
    value, out = features(get), None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for name, side, cut in rule:
            test = test & (value[name] >= cut if side == ">=" else value[name] <= cut)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judged(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """Each row's columns ``carry``, statistics, base_failed, rule (place of the first rule that holds) and kept.

    A null text has no words; texts of fewer than 50 words fail the base test.
    Without labels there are no rules, and the base test decides. Repeated rows
    are judged alike, null ids as any other. A document with several labels counts with the lowest. An empty
    table gives an empty result.
    """
    rules = fitted(docs, labels)
    stats = measured(docs, carry)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})


def of_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    names = docs.columns
    rules = fitted(docs, labels)
    stats = measured(docs, names)
    return stats.filter(~base_failed() & verdict(rules).isNull()).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
