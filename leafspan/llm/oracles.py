"""DuckDB statements that say what the queries return, for those that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

op1_minhash_near_dedup = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN n ON n.doc_id = d.doc_id
"""

op5_substring_dedup = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), h AS MATERIALIZED (
  SELECT doc_id, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' '))) AS h FROM w
), s AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS h FROM h
), t AS MATERIALIZED (SELECT h FROM s GROUP BY h HAVING count(*) > 1
), r AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM s WHERE h IN (SELECT h FROM t)) GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(p, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

_ITEM_WORDS = rf"regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

op9_decontamination = rf"""
WITH i AS MATERIALIZED (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark
), v AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' ')) END) AS t FROM i
), d AS MATERIALIZED (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents
), l AS MATERIALIZED (
  SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')) AS t FROM d, (SELECT DISTINCT n FROM v)
), o AS MATERIALIZED (
  SELECT doc_id, p, n, item_id FROM (SELECT doc_id, n, unnest(range(1, len(t) + 1)) AS p, unnest(t) AS t FROM l) JOIN v USING (n, t)
), h AS MATERIALIZED (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM o) GROUP BY doc_id
), m AS MATERIALIZED (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

#: crc32 of ``{0}``, a list of bytes: a table of 256 entries, made from the polynomial.
_CRC = """(SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295)"


op11_periodic_runs = rf"""
WITH crc AS MATERIALIZED {_CRC}, h AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc
), d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h)
), g AS MATERIALIZED (
  SELECT doc_id, i, hash(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d)
), e AS MATERIALIZED (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i JOIN d ON d.doc_id = a.doc_id AND 4 * (b.i - a.i) <= len(d.w)
), s AS MATERIALIZED (
  SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island
), r AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n_runs, max({{'l': length, 's': -start, 'p': -period}}) AS m, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM r GROUP BY doc_id
), k AS MATERIALIZED (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT d.doc_id, unnest(range(len(d.w))) AS i, unnest(d.w) AS word FROM d SEMI JOIN r ON r.doc_id = d.doc_id) p
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND p.i >= r.start + r.period AND p.i < r.start + r.length) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n_runs, 0) AS n_runs, (-m.s)::BIGINT AS start, m.l::BIGINT AS length, (-m.p)::BIGINT AS period, (1000 * m.l // -m.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(CASE WHEN n.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


def _place(initial: str, to: int, before: str = "") -> str:
    """A turn that takes ``initial`` after an insertion or none: the cheapest edits from there on, with its own."""
    name = {"s": "system", "u": "user", "a": "assistant"}[initial]
    after, insert = f"b[{to}]", [before + ":"] if before else []
    cost = f"CASE WHEN r.k = 2 OR (r.p <> '{initial}' AND '{initial}' = 's') THEN 1000000 WHEN r.p = '{initial}' THEN 0 ELSE 1 END + CASE WHEN r.k = 1 THEN 5 ELSE 0 END"
    return f"""{{'c': {after}.c + {cost} + {5 * len(insert)}, 'a': '{"I" * len(insert)}' || CASE WHEN r.p = '{initial}' THEN 'K' ELSE 'R' END || {after}.a,
      't': list_concat({insert!r}::VARCHAR[], list_concat([CASE WHEN r.p = '{initial}' THEN r.role ELSE '{name}' END || ':' || r.text], {after}.t))}}"""


def _best(state: int, *places: str) -> str:
    return "list_min([" + ", ".join([f"{{'c': b[{state}].c + 2, 'a': 'D' || b[{state}].a, 't': b[{state}].t}}", *places]) + "])"


_STATES = ", ".join(
    [
        _best(1, _place("s", 2), _place("u", 3), _place("a", 4, "user")),
        _best(2, _place("u", 3), _place("a", 4, "user")),
        _best(3, _place("a", 4), _place("u", 3, "assistant")),
        _best(4, _place("u", 3), _place("a", 4, "user")),
    ]
)

op12_conversation_repair = rf"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC}, x AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc)
), f AS MATERIALIZED (
  SELECT *, left(role, 1) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM x
), a AS MATERIALIZED (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY i) || p AS pair FROM f) GROUP BY conv_id
), s AS (
  SELECT conv_id, n AS i, [{{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 5, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}] AS b FROM a
  UNION ALL
  SELECT s.conv_id, s.i - 1, [{_STATES}] FROM s JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS k FROM f) r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.b[1].c, 0)::BIGINT AS cost, coalesce(s.b[1].a, '') AS audit, sha256(coalesce(array_to_string(s.b[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.i = 0
"""
