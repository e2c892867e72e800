"""Personal data: certain patterns, and candidates chosen by boosted trees.

Method: per kind, wide generators propose spans that may overlap. Each gets
format features (digits, groups, separators, brackets, whether it passes its kind's check) and
context features (a telling word before it, its neighbours). Boosted trees learn which features go
with personal data, and a threshold on their calibrated scores selects what is added. Certain spans always stay.

What the trees learn from:

* Right are certain spans, each rewritten in its own context as forms that the certain patterns miss but the
  generators propose.
* Wrong are the other proposals of the same texts, which touch no certain span: numbers of orders, versions and the like; and
  certain spans, as they are and rewritten, with the check of their kind broken.
* SEEDS made-up lines per kind take part like documents, so that a corpus of any size has a model.

Some of the other proposals are personal data in forms that the certain patterns miss; these are the ones to be found. They are taken to be no more
than MISSED times as frequent as certain spans in such a form and context would be. So scores are calibrated on
the documents that the trees have not learned from (the share of right spans, made monotonic), and a proposal is
added if its share is 1 / (1 + MISSED) or more. A form that is mostly of no one's data, where numbers
of that look are far more frequent than personal data with that context, is left alone.

All work on texts is Spark SQL. The trees learn from counts of feature
combinations over all documents; there are at most 2 * 4 * 4096 such combinations,
whatever the corpus's size, and the fitted trees run as CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.llm.session import saved

KINDS = ["email", "ip", "card", "phone"]

# The certain patterns. Possessive forms match the same and need
# neither stack nor retries; a match may not start inside a run that failed as a whole.
CERTAIN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[({]\x20?[aA][tT]\x20?[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:\.|[dD][oO][tT])\x20?[\])}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\x20\.\x20?|\[\.\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9])++",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried.
NEEDS = {"email": r"@|[\[({]\x20?[aA][tT]\x20?[\])}]", "ip": r"[0-9]\x20?\[?\.", "card": r"[0-9]", "phone": r"[0-9]"}
TELLING = {
    "email": r"(?i)mail|contact|write|courriel|correo",
    "ip": r"(?i)\bip\b|addr|host|server",
    "card": r"(?i)card|visa|credit|pay|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|fax|mobil",
}
CONTEXT = 24
FEATURES = {"digits": 4, "separators": 4, "brackets": 2, "groups": 4, "told": 2, "left": 2, "right": 2, "checked": 2}
#: Rewriting of certain spans: (pattern, replacement) in turn, for forms that the generators propose.
FORMS = {
    "email": [[("@", " [at] "), (r"\.", " [dot] ")], [("@", "(at)")], [(r"\.", "[.]")], [("@", "{at}"), (r"\.", "{dot}")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", " . ")]],
    "card": [[("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1.")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1/")]],
    "phone": [
        [(r"^\+", "")],
        [(r"^\+[0-9]{1,3}[\x20.-]?", "")],
        *([(r"^\+", ""), (r"[\x20()-]+", mark)] for mark in ".- "),
        *([(r"^\+[0-9]{1,3}[\x20().-]*", ""), (r"[\x20()-]+", mark)] for mark in "- "),
    ],
}
#: How many times as frequent as certain spans a form may be that the certain patterns miss.
MISSED = 5
SEEDS = 24
ROUNDS, RATE = 24, 0.3


def starts(lengths: Column) -> Column:
    """Sums of the entries before each entry, by blocks of 256, so that long arrays cost little more than their length."""
    size = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(size / 256).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * 256 + 1, 256), F.lit(0), lambda x, y: x + y),
    )
    before = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda x, y: x + y))
    return F.transform(
        lengths,
        lambda _, i: F.get(before, F.floor(i / 256).cast("int"))
        + F.aggregate(F.slice(lengths, F.floor(i / 256).cast("int") * 256 + 1, i % 256), F.lit(0), lambda x, y: x + y),
    )


def _found(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, with the lengths of what lies before each: (gap, match)."""
    return F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
    )


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _plausible(kind: str, span: Column, told: Column) -> Column:
    """Whether a proposal passes its kind's check. A phone number that is a bare run of digits needs a telling word."""
    match = span["match"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "[^0-9]+"), lambda x: x.cast("int") <= 255)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        planned = digits.rlike("^(1?[2-9][0-9]{2}[2-9][0-9]{6}|[2-9][0-9]{0,2}[0-9]{10})$")
        return planned & (match.rlike("[^0-9]") | (told == 1))
    return match.rlike("[^A-Za-z0-9-][A-Za-z]{2,}$")


def _broken(kind: str, match: Column) -> Column:
    """A span that fails its kind's check, else much like ``match``."""
    if kind == "ip":
        return F.regexp_replace(match, "^[0-9]+", "999")
    if kind == "card":
        return F.regexp_replace(F.concat(F.regexp_replace(match, ".$", ""), F.translate(F.right(match, F.lit(1)), "0123456789", "1234567890")), "^$", "0")
    if kind == "phone":
        return F.translate(match, "123456789", "000000000")
    return F.regexp_replace(match, "[A-Za-z0-9-]+$", "12")


def seeds() -> list[tuple[int, str]]:
    """Made-up lines, SEEDS per kind, half of them with a telling word."""
    lines = []
    for i in range(SEEDS):
        digits = f"4{i:03}{7919 * (i + 1):011}"
        double = [int(c) * (2 - k % 2) for k, c in enumerate(digits)]
        check = -sum(n - 9 * (n > 9) for n in double) % 10
        said = {
            "email": ("mail ", f"name{i}@host{i % 7}.example.com"),
            "ip": ("server ", f"{10 + i}.{3 * i}.{200 - i}.{i + 1}"),
            "card": ("card ", f"{digits}{check}"),
            "phone": ("call ", f"+1 (74{i % 10}) 555-38{i + 10}"),
        }
        lines += [(4 * i + k, f"some {said[kind][0] if i % 2 else ''}{said[kind][1]} words") for k, kind in enumerate(KINDS)]
    return lines


def _placed(zipped: Column, kind: int) -> Column:
    """(start, kind, end, match) in code points, for the (gap, match) pairs of a text."""
    pairs = F.filter(zipped, lambda x: x["match"].isNotNull())
    steps = F.transform(pairs, lambda x: x["gap"] + F.length(x["match"]))
    return F.transform(
        F.arrays_zip(pairs.alias("p"), starts(steps).alias("s")),
        lambda x: F.struct(
            (x["s"] + x["p"]["gap"]).alias("start"),
            F.lit(kind).alias("kind"),
            (x["s"] + x["p"]["gap"] + F.length(x["p"]["match"])).alias("end"),
            x["p"]["match"].alias("match"),
        ),
    )


_SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def _features(kind: str, text: Column, span: Column) -> dict[str, Column]:
    match, digits = span["match"], F.length(F.regexp_replace(span["match"], "[^0-9]", ""))
    edges = {"email": (1, 2, 4), "ip": (5, 7, 9), "card": (13, 15, 16), "phone": (9, 10, 11)}[kind]
    binned = sum(((digits > e).cast("int") for e in edges[1:]), (digits > edges[0]).cast("int"))
    space, other = match.contains(" "), match.rlike(r"[._/-]")
    groups = F.regexp_count(match, F.lit("[A-Za-z0-9]+"))
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    last, after = F.substring(text, span["start"], F.lit(1)), F.substring(text, span["end"] + 1, F.lit(1))
    told = before.rlike(TELLING[kind]).cast("int")
    values = [
        binned,
        space.cast("int") + 2 * other.cast("int"),
        match.rlike(r"[\[({]").cast("int"),
        F.least(F.greatest(groups - 2, F.lit(0)), F.lit(3)),
        told,
        ((span["start"] > 0) & last.rlike(r"[^\s(\"':,;]")).cast("int"),
        after.rlike(r"[^\s).\"',;:!?]").cast("int"),
        _plausible(kind, span, told).cast("int"),
    ]
    return {n: v.cast("int") for n, v in zip(FEATURES, values, strict=True)}


def proposals(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, made_up) without text, with ``base`` spans, ``proposed`` spans with their features, and ``rewritten`` certain spans with theirs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", "made_up", text.alias("text"))
    empty = F.from_json(F.lit("[]"), "array<struct<gap:int,match:string>>")
    for k in KINDS:
        gate = F.col("text").rlike(NEEDS[k])
        plus = F.contains(F.col("text"), F.lit("+")) if k == "phone" else F.col("text").contains("@") if k == "email" else gate
        out = out.withColumn(f"c_{k}", F.when(plus, _found(F.col("text"), CERTAIN[k])).otherwise(empty))
        out = out.withColumn(f"p_{k}", F.when(gate, _found(F.col("text"), PROPOSED[k])).otherwise(empty))
    for i, k in enumerate(KINDS):
        for c in ("c", "p"):
            some = F.exists(f"{c}_{k}", lambda x: x["match"].isNotNull())
            spans = F.when(some, _placed(F.col(f"{c}_{k}"), i)).otherwise(F.array().cast(_SPAN))
            out = out.withColumn(f"s{c}_{k}", spans)
    out = out.withColumn("base", F.array_sort(F.concat(*(_accepted(k) for k in KINDS))))
    return out.select(
        "doc_id",
        "made_up",
        "base",
        F.concat(*(_described(k) for k in KINDS)).alias("proposed"),
        F.concat(*(_rewritten(k) for k in KINDS)).alias("rewritten"),
    )


def _accepted(kind: str) -> Column:
    valid = F.filter(f"sc_{kind}", lambda x: _valid(kind, x["match"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _described(kind: str) -> Column:
    """A kind's proposals with enough digits: place, whether a certain span touches them, features."""
    least, most = {"card": (13, 19), "phone": (10, 19), "ip": (4, 99), "email": (0, 1 << 30)}[kind]
    wide = F.filter(f"sp_{kind}", lambda x: F.length(F.regexp_replace(x["match"], "[^0-9]", "")).between(least, most))

    def described(x: Column) -> Column:
        touched = F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.struct(
            x["start"].alias("start"),
            x["kind"].alias("kind"),
            x["end"].alias("end"),
            touched.alias("covered"),
            *(f.alias(n) for n, f in _features(kind, F.col("text"), x).items()),
        )

    return F.transform(wide, described)


def _rewritten(kind: str) -> Column:
    """Features of a kind's certain spans in other forms (right), and of these and the spans themselves with the check broken (not right)."""
    valid = F.filter(f"sc_{kind}", lambda x: _valid(kind, x["match"]))

    def forms(x: Column) -> Column:
        others = []
        for steps in FORMS[kind]:
            match = x["match"]
            for pattern, by in steps:
                match = F.regexp_replace(match, pattern, by)
            others.append(match)
        right = F.filter(F.array(*others), lambda m: m.rlike(f"^(?:{PROPOSED[kind]})$"))
        wrong = F.transform(F.concat(F.array(x["match"]), right), lambda m: _broken(kind, m))
        of = lambda matches, is_right: F.transform(
            matches, lambda m: F.struct(x["start"].alias("start"), x["end"].alias("end"), m.alias("match"), F.lit(is_right).alias("right"))
        )
        return F.concat(of(right, True), of(wrong, False))

    def described(x: Column) -> Column:
        features = (f.alias(n) for n, f in _features(kind, F.col("text"), x).items())
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["right"].alias("is_right"), *features)

    return F.transform(F.flatten(F.transform(valid, forms)), described)


class Trees:
    """Boosted trees of two levels over small whole-number features, fitted on weighted combinations."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], bins: list[int]):
        """rows: (features, right, wrong)."""
        self.trees: list[tuple] = []
        right, wrong = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.prior = math.log((right + 0.5) / (wrong + 0.5))
        score = [self.prior] * len(rows)
        for _ in range(ROUNDS):
            stats = []
            for (_, a, b), s in zip(rows, score, strict=True):
                p = 1 / (1 + math.exp(-s))
                stats.append((a - (a + b) * p, (a + b) * p * (1 - p)))
            tree = self._grown(rows, stats, list(range(len(rows))), bins, 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            score = [s + self._value(tree, r[0]) for s, r in zip(score, rows, strict=True)]

    def _grown(self, rows, stats, own, bins, depth):
        gain = lambda g, h: g * g / (h + 1.0)
        g, h = sum(stats[i][0] for i in own), sum(stats[i][1] for i in own)
        best, cut = 1e-6, None
        for f, n in enumerate(bins) if depth else ():
            sums = [[0.0, 0.0] for _ in range(n)]
            for i in own:
                s = sums[rows[i][0][f]]
                s[0] += stats[i][0]
                s[1] += stats[i][1]
            a = b = 0.0
            for t in range(n - 1):
                a, b = a + sums[t][0], b + sums[t][1]
                better = gain(a, b) + gain(g - a, h - b) - gain(g, h)
                if better > best:
                    best, cut = better, (f, t)
        if cut is None:
            return RATE * g / (h + 1.0)
        f, t = cut
        left, right = ([i for i in own if (rows[i][0][f] <= t) == side] for side in (True, False))
        return (f, t, self._grown(rows, stats, left, bins, depth - 1), self._grown(rows, stats, right, bins, depth - 1))

    def _value(self, tree, features) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, features) -> float:
        return self.prior + sum(self._value(t, features) for t in self.trees)

    def column(self, span: Column) -> Column:
        names = list(FEATURES)

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(span[names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        return sum((of(t) for t in self._joined()), F.lit(float(self.prior)))

    def _joined(self) -> list[tuple]:
        """Fewer trees of the same sum: those that ask the same questions become one."""

        def asked(tree):
            return (tree[0], tree[1], asked(tree[2]), asked(tree[3])) if isinstance(tree, tuple) else None

        def added(a, b):
            return (a[0], a[1], added(a[2], b[2]), added(a[3], b[3])) if isinstance(a, tuple) else a + b

        found: dict = {}
        for tree in self.trees:
            key = asked(tree)
            found[key] = added(found[key], tree) if key in found else tree
        return list(found.values())


def threshold(model: Trees, rows) -> float | None:
    """The lowest score whose calibrated share of right spans is 1 / (1 + MISSED) or more; None if there is none.

    rows: (features, right, wrong) of documents that the trees have not learned from. Neighbouring scores are
    pooled until shares rise with scores.
    """
    by_score: dict[float, list[float]] = {}
    for features, right, wrong in rows:
        own = by_score.setdefault(model.score(features), [0.0, 0.0])
        own[0] += right
        own[1] += wrong
    pools: list[tuple[float, float, float]] = []  # lowest score, right, wrong
    for score, (right, wrong) in sorted(by_score.items()):
        pools.append((score, right, wrong))
        while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
            (low, a, b), (_, c, d) = pools[-2:]
            pools[-2:] = [(low, a + c, b + d)]
    return next((low for low, right, wrong in pools if right and right * (1 + MISSED) >= right + wrong), None)


def _weighed(counts: list, kind: int, fold: int) -> list[tuple[tuple[int, ...], float, float]]:
    """(features, right, wrong) of a kind's combinations in one half."""
    return sorted((tuple(r[n] for n in FEATURES), float(r["n_right"]), float(r["n_wrong"])) for r in counts if r["kind"] == kind and r["fold"] == fold)


def fitted(found: DataFrame) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold per kind, from the counts of feature combinations: the trees learn from half of the documents, the threshold is set on the other half."""

    def labelled(spans: Column, right: Column, keep: Column) -> DataFrame:
        rows = every.select("fold", F.explode(spans).alias("s")).filter(keep)
        return rows.select("fold", "s.kind", *(F.col(f"s.{n}") for n in FEATURES), right.cast("long").alias("is_right"))

    own = F.array(F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))  # made-up lines are in both halves
    every = found.withColumn("fold", F.explode(F.when(F.col("made_up"), F.array(F.lit(0), F.lit(1))).otherwise(own)))
    rows = labelled(F.col("proposed"), F.lit(False), ~F.col("s.covered")).unionAll(labelled(F.col("rewritten"), F.col("s.is_right"), F.lit(True)))
    sums = [F.sum("is_right").alias("n_right"), F.sum(1 - F.col("is_right")).alias("n_wrong")]
    counts = rows.groupBy("fold", "kind", *FEATURES).agg(*sums).collect()  # at most 2 * len(KINDS) * 4096 rows
    models = {}
    for i, k in enumerate(KINDS):
        model = Trees(_weighed(counts, i, 0), list(FEATURES.values()))
        at = threshold(model, _weighed(counts, i, 1))
        if at is not None:
            models[k] = (model, at)
    return models


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): certain spans and all spans of each row, as arrays of (start, kind, end).

    Offsets count code points, the end is exclusive, and kind is a position in
    KINDS. Spans are sorted by start, then kind. A null or empty text has none.
    Repeated rows and null ids are treated as any other row; columns other than
    doc_id and text are not read; an empty table gives an empty result.
    """
    made_up = docs.sparkSession.createDataFrame([(*line, True) for line in seeds()], "doc_id long, text string, made_up boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("made_up"))
    found = saved(proposals(rows.unionAll(made_up)), "proposals")
    models = fitted(found)
    found = found.filter("NOT made_up")
    chosen = F.lit(False)
    if models:
        chosen = lambda x: F.coalesce(
            *(F.when(x["kind"] == KINDS.index(k), m.column(x) >= at - 1e-9) for k, (m, at) in models.items()), F.lit(False)
        )
        added = F.transform(
            F.filter("proposed", lambda x: ~x["covered"] & chosen(x)),
            lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
        )
        return found.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", added))).alias("spans"))
    return found.select("doc_id", "base", F.col("base").alias("spans"))


def joined(column: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span of ``found`` (sorted) replaced by its kind in brackets; of overlapping ones the first counts."""
    names = F.array(*map(F.lit, KINDS))
    state = F.aggregate(
        found,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                F.concat(s["done"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.get(names, x["kind"]), F.lit("]")).alias("done"),
                x["end"].alias("at"),
            ),
        ).otherwise(s),
    )
    return F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the certain spans' digest and all spans as text."""
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
