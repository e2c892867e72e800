"""Periodic runs, conversation repair and license scans against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import random

import brute
import pytest
from leafspan.llm import conversation_repair as cr
from leafspan.llm import license_rules, licenses, periodic, queries
from pyspark.sql import functions as F

# --- 11


def runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(w, own):
    return " ".join(x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in own))


def repeating(rng):
    w = []
    for _ in range(rng.randrange(7)):
        base = [f"w{rng.randrange(rng.choice([1, 2, 5, 40]))}" for _ in range(rng.choice([1, 2, 3, 4, 7, 11, 20]))]
        times = rng.choice([1, 3, 4, 5, 9])
        w += (base * times)[: rng.randrange(1, len(base) * times + 1)]
        w += w[-30:] * rng.choice([0, 0, 1, 4])
    return " ".join(w)


@pytest.fixture(scope="module")
def run_rows():
    rng = random.Random(3)
    rows = [repeating(rng) for _ in range(250)]
    rows += [None, "", " \n", "a", "a a a a a a", "a a a a a", "É é " * 9, "x\x0by\tz " * 40, "same", "same", "\x00 " * 7]
    return list(enumerate(rows)) + [(None, "b " * 8)]


@pytest.mark.parametrize(("segment", "key"), [(1 << 16, 1 << 16), (8, 2), (1, 4)])
def test_runs(spark, run_rows, monkeypatch, segment, key):
    monkeypatch.setattr(periodic, "SEGMENT", segment)
    monkeypatch.setattr(periodic, "MOST_KEY", key)
    if segment == 1 << 16:
        got = periodic.periodic_runs(brute.clashing(brute.docs(spark, run_rows))).collect()
        found = {r["doc_id"]: [(x["start"], x["length"], x["period"]) for x in r["runs"]] for r in got}
        rest = {r["doc_id"]: (r["n_words"], r["n_kept"], r["collapsed_sha256"]) for r in got}
        for i, text in run_rows:
            w = brute.words(text)
            left = collapsed(w, runs(w))
            assert rest[i] == (len(w), len(left.split()), hashlib.sha256(left.encode()).hexdigest())
    else:  # patched values stay on the driver
        import numpy as np
        import pyarrow as pa
        from leafspan.llm import textnum as tn

        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in run_rows], pa.int64()), pa.array([t for _, t in run_rows])], names=["doc_id", "text"])
        found = {}
        for rows, words in tn.runs([batch]):
            assert isinstance(words.count, np.ndarray)
            columns = periodic._columns(rows, words, None)
            found |= {i: [(x["start"], x["length"], x["period"]) for x in own] for i, own in zip(columns[0].to_pylist(), columns[2].to_pylist(), strict=True)}
    assert found == {i: runs(brute.words(t)) for i, t in run_rows}
    assert sum(map(len, found.values())) > 100


def test_long_text_with_long_periods(spark):
    rng = random.Random(8)
    base = [f"v{rng.randrange(50)}" for _ in range(20_000)]
    text = " ".join(["a"] * 50_000 + base * 5 + ["b", "c"] * 20_000)
    got = periodic.periodic_runs(brute.docs(spark, [(1, text)])).first()
    assert {(50_000, 100_000, 20_000), (0, 50_000, 1)} <= {(r["start"], r["length"], r["period"]) for r in got["runs"]}
    assert any(r["period"] == 2 and r["length"] == 40_000 for r in got["runs"]) and got["n_words"] == 190_000


def test_without_repetition(spark, run_rows):
    df = brute.clashing(brute.docs(spark, run_rows))
    out = periodic.without_repetition(df)
    assert out.dtypes == df.dtypes
    for r in out.collect():
        text = dict(run_rows)[r["doc_id"]]
        own = runs(brute.words(text))
        assert r["text"] == (collapsed(brute.words(text), own) if own else text) and r["shard"] == 7
    empty = brute.docs(spark, [])
    assert periodic.without_repetition(empty).count() == periodic.periodic_runs(empty).count() == 0


def test_planted_runs():
    damaged = 0
    for doc in range(300):
        h = brute.crc(doc)
        order = queries.planted_runs(doc, 47)
        assert (order is None) == (h % 10 != 0) and queries.planted_runs(doc, 0) is None
        if order is not None:
            g = h // 10
            a, damaged = g % 47, damaged + 1
            assert order.tolist() == [i if i < a else a + (i - a) % (1 + (47 - a) // (3 + g % 8)) for i in range(47)]
    assert damaged > 15 and queries.planted_runs(None, 5) is None


# --- 12


def conversation(rng):
    roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "tool", "", "system", None, "assistant"]])
    texts = ["Yes.", "No", "", " \t", "Why?", "So!", "and \n", None, "end. "]
    return [(rng.choice([None, *range(6)]) if rng.random() < 0.2 else t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 7))]


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) by trying all ways to keep, rename and delete, and all insertions."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
    numbers = [t for t, *_ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    ends = {"": (0, "", [])}
    for state, (cost, audit, lines) in {"s": (10, "II", ["user:", "assistant:"]), "u": (5, "I", ["assistant:"]), "a": (0, "", [])}.items():
        ends[state] = (cost, audit, lines)
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for state in ends:
            ways = [(ends[state][0] + 2, "D" + ends[state][1], ends[state][2])]
            if fault not in ("blank", "duplicate"):
                for inserted in range(3):
                    at, before = state, []
                    for _ in range(inserted):
                        at = "a" if at == "u" else "u"
                        before.append({"u": "user:", "a": "assistant:"}[at])
                    for to, name in (("s", "system"), ("u", "user"), ("a", "assistant")):
                        if (at, to) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                            continue
                        keep = role[:1] == to
                        if keep or to != "s":
                            cost, audit, lines = ends[to]
                            own = 5 * inserted + (0 if keep else 1) + 5 * (fault == "truncated")
                            ways.append((own + cost, "I" * inserted + ("K" if keep else "R") + audit, [*before, f"{role if keep else name}:{text}", *lines]))
            now[state] = min(ways, key=lambda x: x[:2])
        ends = now
    cost, audit, lines = ends[""]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


def enumerated(kinds, initials):
    """The least (cost, audit) of all edit strings of up to len + 3 letters."""
    found = []
    for n in range(len(kinds), len(kinds) + 4):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in audit) != len(kinds):
                continue
            role, i, cost = "", 0, 0
            for e in audit:
                if e == "I":
                    role, cost = cr.NEXT[role][-1], cost + 5
                    continue
                kind, initial = kinds[i], initials[i]
                i += 1
                if e == "D":
                    cost += 2
                elif kind == cr.GONE:
                    break
                else:
                    to = initial if e == "K" else cr.NEXT[role][-1]
                    if to not in tuple(cr.NEXT[role]):
                        break
                    role, cost = to, cost + (5 if kind == cr.CUT else 0) + (e == "R")
            else:
                if role in cr.LAST:
                    found.append((cost, "".join(audit)))
    return min(found)


def test_cheapest_edits_by_enumeration():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randrange(5)
        kinds, initials = [rng.randrange(3) for _ in range(n)], [rng.choice("suax") for _ in range(n)]
        assert list(cr.cheapest(kinds, initials).values()) == [enumerated(kinds, initials)]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(6)
    own = {i: conversation(rng) for i in range(200)}
    own[None] = [(0, "user", "Hi."), (1, "assistant", "Ho."), (1, "assistant", "Ho.")]
    own[500] = [(t, ["user", "assistant"][t % 2], rng.choice(["Yes.", f"It is {t}.", f"It is {t}", "", "?"])) for t in range(150)]
    own[501] = [(None, "user", "Same.")] * 60 + [(3, "assistant", "So.")]
    rows = [(c, *r) for c, rs in own.items() for r in rs]
    rng.shuffle(rows)
    return own, brute.clashing(spark.createDataFrame(rows, CONVERSATIONS)).repartition(5).cache()


def told(df):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_audits(talks):
    own, df = talks
    want = {c: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest()) for c, x in ((c, repair(rows)) for c, rows in own.items())}
    assert told(cr.audits(df)) == want


@pytest.mark.parametrize("rows", [3, 16])
def test_long_conversations_in_fragments(talks, monkeypatch, rows):
    own, df = talks
    df = df.filter("conv_id IS NULL OR conv_id > 170")
    whole, turns = told(cr.audits(df)), sorted(map(str, cr.repaired(df).collect()))
    monkeypatch.setattr(cr, "LONG_ROWS", rows)
    assert told(cr.audits(df)) == whole
    assert sorted(map(str, cr.repaired(df).collect())) == turns


def test_repaired(talks):
    own, df = talks
    got = {}
    for r in cr.repaired(df).orderBy("place").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, rows in own.items():
        assert "\n".join(got.get(c, [])) == repair(rows)[-1]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert cr.audits(empty).count() == cr.repaired(empty).count() == queries.damaged(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in [("assistant", "A. b! c?"), (None, None)]]
    got = sorted(map(str, queries.damaged(spark.createDataFrame(rows, CONVERSATIONS)).collect()))
    want = []
    for c, t, r, x in rows:
        k = brute.crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        r, x = "user" if k == 4 else r or " ", x or " "
        x = "" if k == 1 else x.replace(".", "").replace("!", "").replace("?", "") if k == 2 else x
        want += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    from pyspark.sql import Row

    make = Row("conv_id", "turn", "role", "text")
    assert got == sorted(str(make(*w)) for w in want)


# --- 13


def base(text):
    w = brute.ITEM_WORD.findall((text or "").translate(brute.LOWER))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), sorted(places)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU  General\nPublic License, version 3.",
    "x MIT License; MIT-License. admit license, mit licenses",
    "CC BY-SA 4.0 and (cc) by and CC0 1.0, accc by",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    'license = "BSD-3-Clause"',
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "see https://creativecommons.org/licenses/by-nc-sa/3.0/ for it",
    "mit freundlichen Grüßen, zlib is fast and apaches live here",
    "GNU General Public License",
    "ÀMIT License ÉCC BY",
    "gnu gnu general public license license mit",
    "cc", "by nc", "gnu general", "public license",
    None, "", " ", "MIT License", "MIT License",
]


def test_base_places(spark):
    rng = random.Random(2)
    texts = TEXTS + ["word " * 30_000 + "MIT License. " * 500 + "word"]
    texts += [" ".join(rng.choice("gnu general public license apache cc by mit Licence x".split()) for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "CC BY")]
    got = licenses.licenses(brute.clashing(brute.docs(spark, rows)))
    assert {r["doc_id"]: (r["n_words"], [(p["word"], p["label"]) for p in r["places"]]) for r in got.collect()} == {i: base(t) for i, t in rows}
    for r in licenses.digest(got).collect():
        n, places = base(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    empty = brute.docs(spark, [])
    assert licenses.digest(licenses.licenses(empty)).count() == 0


def found(text):
    low = text.lower()
    bits = licenses._occurring(low.encode(), __import__("numpy").array([0, len(low.encode())])).get(0, 0)
    return [(low[a:b], r.label, r.form) for a, b, r in licenses.detections(low, bits)]


def test_labels():
    labels = [{label for _, label, _ in found(t)} for t in TEXTS[:10]]
    assert labels == [{"apache-2.0"}, {"gpl-3.0"}, {"mit"}, {"cc-by-sa-4.0", "cc0-1.0", "cc-by"}, {"gpl-2.0"}, {"bsd-3-clause"}, {"lgpl-2.1"}, {"mit"}, {"cc-by-nc-sa-3.0"}, set()]
    assert found("licensed under the apache license, version 2.0")[0][2] == "grant"
    for line in license_rules._lines(license_rules.LICENSES):
        assert line[0] in {label for _, label, _ in found(f"Text. SPDX-License-Identifier: {line[0]} and more")} or line[0].startswith("llama")


def test_keywords_hide_nothing():
    """Rules find the same with and without their keywords, on sentences for every license."""
    rng = random.Random(1)
    every = license_rules.rules()
    assert len(every) >= 300
    names = [line[0] for line in license_rules._lines(license_rules.LICENSES)]
    texts = [" ".join(rng.sample([t.lower() for t in TEXTS if t], 5)) for _ in range(10)]
    for name in names:
        spaced = name.replace("-", " ")
        texts += [f"released under {name}", f"license: {spaced}", f"spdx-license-identifier: {name}", f"the {spaced} license", f"licensed under the terms of the {spaced} licence version {spaced[-3:]}"]
    texts += [text.replace(",?", ",") for *_, text in license_rules._lines(license_rules.SIGNATURES)]
    for text in texts:
        plain = [(m.start(), m.end(), -r.priority, i, r) for i, r in enumerate(every) for m in r.pattern.finditer(text)]
        want = sorted((text[a:b], r.label, r.form) for a, b, r in licenses._ranked(plain))
        assert sorted(found(text)) == want


def test_weaker_detections_within_stronger_ones_go(spark):
    got = licenses.licenses(brute.docs(spark, [(1, "Under: licensed under the MIT license. Also the Mozilla Public License 2.0 (see mozilla.org/MPL/2.0)")])).first()["found"]
    assert [(f["label"], f["form"]) for f in got] == [("mit", "grant"), ("mpl-2.0", "name"), ("mpl-2.0", "link")]
    assert all(not (a is not b and a["start"] <= b["start"] and b["end"] <= a["end"]) for a in got for b in got)


def test_plan_has_no_shuffle(spark):
    df = brute.docs(spark, [(1, "a")])
    for out in (licenses.digest(licenses.licenses(df)), periodic.periodic_runs(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.select(F.size("runs")).first()[0] == 0
