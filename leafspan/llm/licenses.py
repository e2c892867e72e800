"""License scans by ordered signature rules.

Method: hundreds of hand-written expressions (license_rules) name a license's label each, with a form that gives their
priority. One automaton finds the keywords of all rules in a run of whole texts, and a rule is tried on a text
only if all of its keywords occur there. Of overlapping detections, one that lies within another of higher
priority, of equal priority and greater length, or of an earlier rule, is dropped.

The certain phrases (BASE) are places of whole words; their labels stay whatever the rules say.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.llm import textnum as tn
from leafspan.llm.license_rules import FORMS, Rule, rules
from leafspan.llm.session import small_batches

#: Phrases of whole words and their labels; fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased texts.
_WORDS = tn.classes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_BETWEEN = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

RESULT = (
    "doc_id long, n_words long, places array<struct<word:long,label:string>>, "
    "found array<struct<start:long,end:long,label:string,form:string,confidence:double>>"
)
_PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("form", pa.string()), ("confidence", pa.float64())])


@functools.cache
def _phrases() -> list[tuple[re.Pattern, str]]:
    return [(re.compile(_BETWEEN.join(w.encode() for w in phrase.split())), label) for phrase, label in BASE.items()]


@functools.cache
def _scanner() -> tuple[ahocorasick.Automaton, dict[int, list[tuple[int, int, Rule]]]]:
    """The keywords' automaton, and by each rule's longest keyword (all of its keywords as bits, its order, the rule)."""
    own = rules()
    number: dict[str, int] = {}
    by_keyword: dict[int, list[tuple[int, int, Rule]]] = {}
    for order, rule in enumerate(own):
        bits = 0
        for word in rule.keywords:
            bits |= 1 << number.setdefault(word, len(number))
        by_keyword.setdefault(number[rule.keywords[0]], []).append((bits, order, rule))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for word, n in number.items():
        automaton.add_word(word, n)
    automaton.make_automaton()
    return automaton, by_keyword


def _places(low: bytes, words: tn.Words) -> dict[int, list[tuple[int, str]]]:
    """(word's number, label) of the phrases' places, by text."""
    out: dict[int, list[tuple[int, str]]] = {}
    for pattern, label in _phrases():
        for m in pattern.finditer(low):
            a, b = np.searchsorted(words.first, m.start()), np.searchsorted(words.end, m.end())
            if a < len(words.first) and words.first[a] == m.start() and b < len(words.end) and words.end[b] == m.end() and words.doc[a] == words.doc[b]:
                i = int(words.doc[a])
                out.setdefault(i, []).append((int(a - words.start_of_doc[i]), label))
    return out


def _occurring(low: bytes, offsets: np.ndarray) -> dict[int, int]:
    """The keywords, as bits, that occur in each text with some."""
    automaton = _scanner()[0]
    hits = np.array(list(automaton.iter(low.decode("latin-1"))), np.int64).reshape(-1, 2)
    doc = np.searchsorted(offsets, hits[:, 0], "right") - 1
    out: dict[int, int] = {}
    for code in np.unique(doc << 16 | hits[:, 1]).tolist():
        out[code >> 16] = out.get(code >> 16, 0) | 1 << (code & 0xFFFF)
    return out


def _ranked(found: list[tuple[int, int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, -priority, order, rule) without those that lie within a stronger one."""
    kept: list[tuple[int, int, Rule]] = []
    cluster: list = []
    reach = -1
    for one in [*sorted(found, key=lambda x: x[:2]), None]:
        if one is None or one[0] >= reach:
            own: list[tuple[int, int, Rule]] = []
            for start, end, _, _, rule in sorted(cluster, key=lambda x: (x[2], x[0] - x[1], x[3], x[0])):
                if not any(a <= start and end <= b for a, b, _ in own):
                    own.append((start, end, rule))
            kept += sorted(own, key=lambda x: x[:2])
            cluster = []
        if one:
            cluster.append(one)
            reach = max(reach, one[1])
    return kept


def detections(low: str, bits: int) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in a lower-cased text whose keywords are ``bits``; code points, end exclusive."""
    by_keyword = _scanner()[1]
    found = []
    left = bits
    while left:
        n = (left & -left).bit_length() - 1
        left &= left - 1
        for needed, order, rule in by_keyword.get(n, ()):
            if needed & bits == needed:
                found += [(m.start(), m.end(), -rule.priority, order, rule) for m in rule.pattern.finditer(low)]
    return _ranked(found)


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, found), a row per row of ``docs`` (doc_id, text).

    Words are those of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. ``places`` are the certain phrases' (number of
    the first word, label) in order; ``found`` are the rules' detections that no stronger one holds: code points [start, end), label,
    form and confidence. Null and empty texts have neither; repeated rows and null ids are rows like others; other columns are not read;
    an empty table gives an empty result. There is no shuffle, and texts are read whole.
    """
    small_batches(docs.sparkSession)

    @tn.tidied
    def scanned(batches):
        for rows, words in tn.runs(batches, _WORDS):
            folded = tn._fold[words.data]
            low = folded.tobytes()
            places = _places(low, words)
            found = {i: detections(low[words.offsets[i] : words.offsets[i + 1]].decode(), bits) for i, bits in _occurring(low, words.offsets).items()}
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(words.count, pa.int64()),
                    pa.array([[{"word": w, "label": label} for w, label in sorted(places.get(i, ()))] for i in range(n)], pa.list_(_PLACE)),
                    pa.array([[{"start": a, "end": b, "label": r.label, "form": r.form, "confidence": r.confidence} for a, b, r in found.get(i, ())] for i in range(n)], pa.list_(_FOUND)),
                ],
                names=["doc_id", "n_words", "places", "found"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(scanned, RESULT)


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    The score is the probability that one detection at least is right: each form has its confidence, a certain
    phrase that of a name, and different labels count as independent of each other.
    """
    best = F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("found", lambda f: f["label"])))
    name = F.lit(FORMS["name"])

    def confidence(label):
        of_rules = F.array_max(F.transform(F.filter("found", lambda f: f["label"] == label), lambda f: f["confidence"]))
        sure = F.when(F.exists("places", lambda p: p["label"] == label), name).otherwise(0.0)
        return F.greatest(F.coalesce(of_rules, F.lit(0.0)), sure)

    missed = F.aggregate(best, F.lit(1.0), lambda left, label: left * (1 - confidence(label)))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(best), ",").alias("labels"),
        (1 - missed).alias("score"),
    )
