"""Benchmark passages in documents, by a prefix-filtered join.

Method: a benchmark item is cut into windows of its size (13 words; a shorter
item is one window). The tokens of a window are its words; ordered by how rare they
are over all documents, the rarest is the prefix that any text holding the
window must hold too. Occurrences of prefix words in documents meet the windows
that they stand for; the position within the window must leave room on both sides
(length and positional bounds), and the words around that place are then compared
with the whole window.

Everything is DataFrame operations. Documents are read three times (rarity,
prefix join, number of words), and none of their texts is shuffled: a word that a
bitmap of the prefixes lets through carries the words around it. Tables of the benchmark
and of what was found are broadcast if they are small (``_small`` measures them), and joined by shuffles else.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.llm.session import ascii_lower, saved, set_aside

WINDOW = 13
#: What separates words (ASCII characters other than digits and letters; texts are lower-cased first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts whose letters may be of either case.
ANY_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of the benchmark are broadcast up to this size, and joined by shuffles beyond it.
BROADCAST_BYTES = 32 << 20
#: The bitmap of prefix words has 2 to the power of these bits, at least and at most (512 KB).
LEAST_BITS, MOST_BITS = 12, 22
#: Hits must make up this share (1 / SHARE) of a document's words.
SHARE = 20

_FOUND = "array<struct<start:int,size:int,window_id:long>>"


def cut(text: Column) -> Column:
    """Lower-cased words of a text, with an empty one before or after them where separators begin or end it."""
    return F.split(ascii_lower(text), SEPARATORS, -1)


def words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.filter(cut(F.coalesce(text, F.lit(""))), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of each item."""
    own = items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def _small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if its strings and numbers take at most BROADCAST_BYTES."""
    size = table.select(sum((F.length(F.to_json(F.struct(c))) for c in table.columns), F.lit(0)).alias("n"))
    return F.broadcast(table) if (size.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_BYTES else table


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(token, window_id, words, offset): the rarest word of each distinct window and its place in it."""
    vocabulary = saved(windows.select(F.explode("words").alias("token")).distinct(), "vocabulary")
    seen = (
        docs.select(F.explode(cut(F.col("text"))).alias("token"))
        .filter(may_hold(vocabulary, F.col("token")))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .join(_small(vocabulary), "token", "left_semi")
    )
    placed = windows.select("window_id", "words", F.posexplode("words").alias("offset", "token"))
    rarest = Window.partitionBy("window_id").orderBy(F.coalesce("n", F.lit(0)), "token", "offset")
    return (
        placed.join(_small(saved(seen, "seen")), "token", "left")
        .withColumn("rank", F.row_number().over(rarest))
        .filter("rank = 1")
        .select("token", "window_id", "words", "offset")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with id and copy: rows of equal id and text share them, and share all results."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("copy", F.xxhash64("text"))


def may_hold(tokens: DataFrame, token: Column) -> Column:
    """Whether ``token`` may be one of ``tokens`` (token): a bitmap of hashes, wrong for few others."""
    count = tokens.count()
    bits = 1 << min(max(math.ceil(math.log2(max(count, 1))) + 4, LEAST_BITS), MOST_BITS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = tokens.select(place(F.col("token")).alias("p")).distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    filled = marks.groupBy(F.floor(F.col("p") / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # at most bits / 64 rows
    table = [0] * (bits // 64)
    for r in filled:
        table[r["at"]] = r["bits"]
    found = F.get(F.from_json(F.lit(json.dumps(table)), "array<bigint>"), F.shiftright(place(token), 6).cast("int"))
    return F.call_function("shiftright", found, (place(token) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, copy, found): the places (start, size, window_id) of whole windows, for rows of ``docs`` that hold any."""
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    windows = item_windows(items, window).select("words").distinct().withColumn("window_id", F.xxhash64("words"))
    needed = saved(prefixes(docs, windows), "prefixes")
    # outer: the optimizer would cut texts once more to test for words, were rows without any left out here
    placed = docs.select("id", "copy", cut(F.col("text")).alias("w")).select("id", "copy", "w", F.posexplode_outer("w").alias("pos", "token"))
    leading = (F.get("w", F.lit(0)) == "").cast("int").alias("leading")
    around = F.slice("w", F.greatest(F.col("pos") - window + 2, F.lit(1)), 2 * window - 1).alias("around")
    likely = placed.filter(may_hold(needed.select("token").distinct(), F.col("token")))
    likely = likely.select("id", "copy", "pos", "token", leading, around, F.least("pos", F.lit(window - 1)).alias("at"))
    whole = F.slice("around", F.col("at") - F.col("offset") + 1, F.size("words")) == F.col("words")
    met = likely.join(_small(needed), "token").filter(F.col("at") >= F.col("offset")).filter(whole)
    place = F.struct((F.col("pos") - F.col("offset") - F.col("leading")).alias("start"), F.size("words").alias("size"), "window_id")
    return met.select("id", "copy", place.alias("p")).groupBy("id", "copy").agg(F.collect_set("p").cast(_FOUND).alias("found"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, copy, doc_id, n_words, found): the places of whole windows in each row of ``docs``."""
    found = saved(matches(docs, items, window), "matches")
    return _counted(docs).join(_small(found), ["id", "copy"], "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))


def _counted(docs: DataFrame) -> DataFrame:
    """(id, copy, doc_id, n_words) of each row."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("id", "copy", "doc_id", F.split("text", ANY_SEPARATORS, -1).alias("w"))
    empty = sum((F.element_at("w", i) == "").cast("int") for i in (1, -1))
    return rows.select("id", "copy", "doc_id", F.coalesce(F.greatest(F.size("w") - empty, F.lit(0)), F.lit(0)).cast("long").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: id, copy, doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are
    not read. A null text has no words, and an item without words no window. A
    word counts once however many windows cover it. Equal rows get equal results;
    null ids are allowed. Empty tables give no rows or no hits.
    """
    found = saved(matches(docs, items, window), "matches")
    windows = item_windows(items, window).select(F.xxhash64("words").alias("window_id"), F.col("item_id").cast("string").alias("item"))
    named = (
        found.select("id", "copy", F.explode(F.array_distinct(F.transform("found", lambda x: x["window_id"]))).alias("window_id"))
        .join(_small(saved(windows, "windows")), "window_id")
        .groupBy("id", "copy")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    covered = F.array_distinct(
        F.flatten(F.transform("found", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
    )
    hit = found.select("id", "copy", F.size(covered).cast("long").alias("n_hit")).join(named, ["id", "copy"], "left")
    out = _counted(docs).join(_small(saved(hit, "hits")), ["id", "copy"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "id",
        "copy",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    plain, restored = set_aside(docs, "doc_id", "text")
    bad = saved(contamination(plain, items).filter("contaminated").select("id", "copy").distinct(), "contaminated")
    return restored(keyed(plain).join(_small(bad), ["id", "copy"], "left_anti"))
