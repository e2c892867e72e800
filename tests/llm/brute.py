"""Brute-force versions of the operators, written for clearness only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPACE_WORD.findall(text or "")


def docs(spark, rows, schema=SCHEMA):
    """A documents table from (doc_id, text[, lang[, source]])."""
    full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def clashing(df):
    """``df`` with further columns whose names operators like to use themselves."""
    from pyspark.sql import functions as F

    names = "id copy key node size count chunk part bin cut target p held_out kept rank sum _u _copies _source _row shard slot quality n_words band component".split()
    return df.select("*", *(F.lit(7).alias(n) for n in names), F.lit(None).cast("string").alias("a b"))


def near_classes(rows):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {}
    for i, text in rows:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(rows, k=35):
    """A list of (doc_id, words, removed, digest of the rest) per row."""
    seen = Counter()
    for _, text in rows:
        w = words(text)
        seen.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(rows, items):
    """A list of (doc_id, words, hit, items) per row."""
    windows = defaultdict(set)
    for i, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for j in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[j : j + 13])].add(str(i))
    out = []
    for i, text in rows:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit[j : j + n] = [1] * n
                    found |= own
        out.append((i, len(w), sum(hit), sorted(found)))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def private(text):
    """Certain spans as 'kind:start:end' joined by commas."""
    found = []
    for k, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def added(text, certain, models, pii):
    """Spans that fitted ``models`` add to the ``certain`` ones (start, kind, end), by plain search and plain walks through the trees."""
    import regex

    out = []
    for k, kind in enumerate(PII):
        least, most = {"card": (13, 19), "phone": (10, 19), "ip": (4, 99), "email": (0, 1 << 30)}[kind]
        edges = {"email": (1, 2, 4), "ip": (5, 7, 9), "card": (13, 15, 16), "phone": (9, 10, 11)}[kind]
        for m in regex.finditer(pii.PROPOSED[kind], text or ""):
            digits, a, b = re.sub("[^0-9]", "", m[0]), m.start(), m.end()
            if not least <= len(digits) <= most or any(x < b and a < y for x, _, y in certain):
                continue
            told = bool(re.search(pii.TELLING[kind], text[max(0, a - pii.CONTEXT) : a]))
            if kind == "ip":
                good = all(int(x) <= 255 for x in re.split("[^0-9]+", m[0]))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and luhn(digits)
            elif kind == "phone":
                good = bool(re.fullmatch("1?[2-9][0-9]{2}[2-9][0-9]{6}|[2-9][0-9]{0,2}[0-9]{10}", digits)) and (told or digits != m[0])
            else:
                good = bool(re.search("[^A-Za-z0-9-][A-Za-z]{2,}$", m[0]))
            features = (
                sum(len(digits) > e for e in edges),
                (" " in m[0]) + 2 * bool(re.search("[._/-]", m[0])),
                int(bool(re.search(r"[\[({]", m[0]))),
                min(max(len(re.findall("[A-Za-z0-9]+", m[0])) - 2, 0), 3),
                int(told),
                int(a > 0 and bool(re.match(r"[^\s(\"':,;]", text[a - 1]))),
                int(bool(re.match(r"[^\s).\"',;:!?]", text[b : b + 1]))),
                int(good),
            )
            if kind in models and models[kind][0].score(features) >= models[kind][1] - 1e-9:
                out.append((a, k, b))
    return out


def mixture(text, table, bucket, iterations, penalty):
    """(index of the predicted language, its share among all, selected proportions) of a text; table: bucket -> log probabilities."""
    import math

    w = words((text or "").translate(LOWER))
    n = len(table[0])
    like = []
    for x in w:
        b = b"\x01" + x.encode() + b"\x01"
        logs = [sum(float(table[bucket(b[k - 1], b[k], b[k + 1])][j]) for k in range(1, len(b) - 1)) for j in range(n)]
        like.append([math.exp(max(v - max(logs), -69.0)) for v in logs])

    def em(allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(n)]
        for _ in range(iterations):
            sums = [0.0] * n
            for row in like:
                part = [a * b for a, b in zip(row, share, strict=True)]
                total = sum(part)
                sums = [s + p / total for s, p in zip(sums, part, strict=True)]
            share = [s / len(like) for s in sums]
        return share, sum(math.log(sum(a * b for a, b in zip(row, share, strict=True))) for row in like)

    full, _ = em(range(n))
    order = sorted(range(n), key=lambda j: -full[j])
    single = [sum(math.log(row[j]) for row in like) for j in range(n)]
    top = max(range(n), key=lambda j: single[j])
    best = last = -2 * single[top] + penalty * math.log(len(w))
    chosen = [float(j == top) for j in range(n)]
    for size in range(2, n + 1):
        share, fit = em(order[:size])
        cost = -2 * fit + penalty * size * math.log(len(w))
        if cost < best:
            best, chosen = cost, share
        if size >= 3 and cost >= last:
            break
        last = cost
    pick = max(range(n), key=lambda j: chosen[j])
    return pick, full[pick], chosen


def statistics(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = [0] * len(w)
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            again[k : k + 3] = [1] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, dup, sum(again)


def crc(x):
    return zlib.crc32(str(x).encode())
