"""K-d tree shards of near-equal bytes.

Method: the tree splits all rows at a weighted median of the widest metadata
dimension, again and again, until a leaf's share is the target number of bytes.
Dimensions: source, language, size and id, each scaled to [0, 1] over the whole table
(sources and languages by their rank among the distinct ones); the widest is the one with the longest range within a node. Weights are bytes.

Copies (equal texts) move as one unit with the metadata of their smallest id, so
that they meet in one shard. Only a unit above MOST_OF_SHARD of the target is cut
into parts by a hash of the id, since no shard could hold it evenly. The few units
above LEAST_HEAVY of the target are placed first, on the side of the median that
they lie on if it has room for them, and the light ones fill up what is left.

A median is found without sorting: one pass sums bytes per node, dimension and bin, which gives the
widest dimension and the bin that holds the half; that bin is cut into bins again
until it weighs little. Only sums per bin reach the driver. Ties of a dimension are
ordered by a hash, which takes the same cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.llm.session import join_hot, saved

SHARDS = 16
BINS = 2048
#: A median may be off by this share of its node.
SLACK = 0.0005
#: Shares of a shard's target: above the first a unit is cut, above the second it is placed by itself.
MOST_OF_SHARD, LEAST_HEAVY = 0.9, 0.0625
_TOP, _BEYOND = 1 << 40, 1 << 61
#: Bins of a dimension at least, however many nodes are cut at once.
LEAST_BINS = 64
#: Rows of one shard that are numbered together.
NUMBERED = 100_000


def _position(value: Column, low: Column, high: Column) -> Column:
    """A dimension scaled to [0, 1]; null and empty ranges lie at 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def _with_rank(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a text column replaced by its value's rank among the distinct ones (0, 1, ...); null comes last."""
    values = rows.select(name).filter(F.col(name).isNotNull()).distinct()
    placed = saved(values.repartitionByRange(name).sortWithinPartitions(name).withColumn("at", F.monotonically_increasing_id()), "ranks")
    block, starts, total = F.shiftright("at", 33), {}, 0
    for r in placed.groupBy(block.alias("block")).count().orderBy("block").collect():  # a row per partition
        starts[r["block"]], total = total, total + r["count"]
    if not total:
        return rows.withColumn(name, F.lit(0.0))
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair)), block)
    ranks = placed.select(name, (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("double").alias("rank"))
    ranked = rows.join(ranks, name, "left").withColumn(name, F.coalesce("rank", F.lit(float(total))))
    return ranked.select(rows.columns)


def _metadata(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` without its text; missing metadata columns count as null."""
    have = set(docs.columns)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    optional = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("copy"),
        optional("source").alias("source"),
        optional("lang").alias("lang"),
    )


def _units(rows: DataFrame, target: float) -> DataFrame:
    """(copy, text_crc32, parts, n, bytes, position per dimension): the movable units of n rows."""
    groups = rows.groupBy("copy", "text_crc32").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "source", "lang", "size")).alias("m"),
    )
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / (target * MOST_OF_SHARD))).cast("int")
    flat = groups.select(
        "copy",
        "text_crc32",
        parts.alias("parts"),
        "n",
        "bytes",
        "m.source",
        "m.lang",
        F.log2(F.col("m.size")).alias("size"),
        F.coalesce(F.col("m.doc_id"), F.lit(0)).cast("double").alias("id"),
    )
    return flat


DIMENSIONS = ["source", "lang", "size", "id"]


def _weighed(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Units and their parts with the exact bytes of each part."""
    hot = units.filter("parts > 1").select("copy", "text_crc32", "parts")
    part = F.pmod(F.xxhash64("doc_id", "copy"), F.col("parts")).cast("int")
    pieces = (
        rows.join(F.broadcast(hot), ["copy", "text_crc32"])  # fewer than 2 * count units are that large
        .groupBy("copy", "text_crc32", part.alias("part"))
        .agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    )
    pieces = pieces.join(units.drop("bytes", "n"), ["copy", "text_crc32"])
    single = units.filter("parts = 1").withColumn("part", F.lit(0)).withColumnRenamed("bytes", "weight")
    names = ["copy", "text_crc32", "parts", "part", "n", "weight", *DIMENSIONS]
    return single.select(names).unionAll(pieces.select(names))


def _ordered(dimension: Column) -> Column:
    """A whole number that follows the dimension (0 to 1) and then a hash of the unit, below 2**60."""
    tie = F.pmod(F.xxhash64("copy", "text_crc32", "part"), F.lit(1 << 20))
    return (F.round(dimension * (_TOP - 1)).cast("long") * (1 << 20)) + tie


def _listed(values: list[int], place: Column) -> Column:
    return F.get(F.array(*(F.lit(x).cast("long") for x in values)), place.cast("int"))


@dataclass
class Node:
    """A node of the tree: its run of shards, its heavy units, and the box (low, width) of each dimension's numbers that it lies in."""

    first: int
    end: int
    heavy: list[dict]
    box: list[tuple[int, int]]

    def halves(self, dimension: int, cut: int, middle: int, sides: tuple[list[dict], list[dict]]) -> list[Node]:
        low, width = self.box[dimension]
        left, right = list(self.box), list(self.box)
        left[dimension], right[dimension] = (low, max(cut - low, 1)), (min(cut, low + width - 1), max(low + width - cut, 1))
        return [Node(self.first, middle, sides[0], left), Node(middle, self.end, sides[1], right)]


def _binned(rows: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys`` and bin of rows (over, step, weight): the bytes in it, and the least and the largest number in it, counted from where the bins begin."""
    place = F.expr("over div step").alias("bin")
    return rows.groupBy(*keys, place).agg(F.sum("weight").alias("weight"), F.min("over").alias("least"), F.max("over").alias("most"))


def _histograms(units: DataFrame, nodes: list[Node]) -> list[list[dict[int, tuple[int, int, int]]]]:
    """The bins per node and dimension for the nodes that are to be split; one pass over the units."""
    split = [n.end - n.first > 1 for n in nodes]
    bins = max(LEAST_BINS, 16 * BINS // sum(split))
    steps = [[max(1, -(-width // bins)) for _, width in n.box] for n in nodes]
    pairs = F.array(*(F.struct(F.lit(d).alias("d"), F.col(f"key_{d}").alias("key")) for d in range(len(DIMENSIONS))))
    rows = units.filter(_listed(list(map(int, split)), F.col("node")) == 1).select("node", "weight", F.explode(pairs).alias("x"))
    place = F.col("node") * len(DIMENSIONS) + F.col("x.d")
    low = _listed([low for n in nodes for low, _ in n.box], place)
    step = _listed([x for own in steps for x in own], place)
    rows = rows.select("node", "x.d", "weight", (F.col("x.key") - low).alias("over"), step.alias("step"))
    sums = _binned(rows, "node", "d")
    found: list[list[dict[int, tuple[int, int, int]]]] = [[{} for _ in DIMENSIONS] for _ in nodes]
    for r in sums.collect():  # at most len(DIMENSIONS) * max(16 * BINS, LEAST_BINS * nodes) rows
        found[r["node"]][r["d"]][r["bin"]] = (r["weight"], r["least"], r["most"])
    return found


@dataclass
class Cut:
    """The search for the number that cuts a node: where it must lie (low, width), and the bytes of what lies there that go left."""

    dimension: int
    low: int
    width: int
    left: float
    slack: float
    at: int | None = None

    def narrow(self, bins: dict[int, tuple[int, int, int]]) -> None:
        """Goes on among the numbers of the bin that holds the last byte that goes left, or settles for one of its ends."""
        if self.left <= 0:
            self.at = self.low
            return
        for place in sorted(bins):
            own, least, most = bins[place]
            if own >= self.left:
                if least == most or own <= self.slack:
                    self.at = self.low + (least if self.left < own / 2 else most + 1)
                else:
                    self.low, self.width = self.low + least, most - least + 1
                return
            self.left -= own
        self.at = self.low + self.width  # all of it goes left


def _settled(units: DataFrame, cuts: dict[int, Cut], count: int) -> None:
    """Narrows all cuts that are open, a pass over their bins at a time."""
    while open_ := {k: c for k, c in cuts.items() if c.at is None}:
        steps = {k: max(1, -(-c.width // BINS)) for k, c in open_.items()}
        per = lambda f: _listed([f(k) if k in open_ else 0 for k in range(count)], F.col("node"))
        key = F.get(F.array(*(F.col(f"key_{d}") for d in range(len(DIMENSIONS)))), per(lambda k: open_[k].dimension).cast("int"))
        rows = units.filter(per(lambda k: 1) == 1).select("node", "weight", (key - per(lambda k: open_[k].low)).alias("over"), per(lambda k: open_[k].width).alias("width"), per(lambda k: steps[k]).alias("step"))
        sums = _binned(rows.filter("over >= 0 AND over < width"), "node")
        bins: dict[int, dict[int, tuple[int, int, int]]] = {k: {} for k in open_}
        for r in sums.collect():  # at most len(open_) * BINS rows
            bins[r["node"]][r["bin"]] = (r["weight"], r["least"], r["most"])
        for k, c in open_.items():
            c.narrow(bins[k])


def _sides(heavy: list[dict], key: str, left: float, right: float) -> tuple[list[dict], list[dict]]:
    """Heavy units for either side with ``left`` and ``right`` bytes: the largest first, each on its side of the middle if there is room."""
    sides, room = ([], []), [left, right]
    middle = sorted(h[key] for h in heavy)[int(len(heavy) * left / (left + right))] if heavy else 0
    for h in sorted(heavy, key=lambda h: (-h["weight"], h[key])):
        side = int(h[key] >= middle)
        if room[side] < h["weight"] and room[1 - side] > room[side]:
            side = 1 - side
        sides[side].append(h)
        room[side] -= h["weight"]
    return sides


def _leaves(units: DataFrame, total: int, count: int) -> DataFrame:
    """(copy, text_crc32, parts, part, n, shard) for all units (with weight and key_0, key_1, ...)."""
    spark = units.sparkSession
    name = ["copy", "text_crc32", "parts", "part", "n"]
    keys = [f"key_{d}" for d in range(len(DIMENSIONS))]
    is_heavy = F.col("weight") > LEAST_HEAVY * total / count
    heavy = [r.asDict() for r in units.filter(is_heavy).select(*name, "weight", *keys).collect()]  # at most count / LEAST_HEAVY
    units = units.filter(~is_heavy).withColumn("node", F.lit(0).cast("long"))
    nodes = [Node(0, count, heavy, [(0, 1 << 60)] * len(DIMENSIONS))]
    level = 0
    while any(n.end - n.first > 1 for n in nodes):
        found = _histograms(units, nodes)
        cuts, sides = {}, {}
        for k, n in enumerate(nodes):
            if n.end - n.first < 2:
                continue
            span = [max(x[2] for x in b.values()) - min(x[1] for x in b.values()) if b else 0 for b in found[k]]
            widest = span.index(max(span))
            light = sum(x[0] for x in found[k][widest].values())
            every = light + sum(h["weight"] for h in n.heavy)
            left = every * ((n.first + n.end) // 2 - n.first) / (n.end - n.first)
            sides[k] = _sides(n.heavy, keys[widest], left, every - left) if every else ([], [])
            cuts[k] = Cut(widest, *n.box[widest], left - sum(h["weight"] for h in sides[k][0]), SLACK * light)
            cuts[k].narrow(found[k][widest])
        _settled(units, cuts, len(nodes))
        after, base = [], []
        for k, n in enumerate(nodes):
            base.append(len(after))
            after += n.halves(cuts[k].dimension, cuts[k].at, (n.first + n.end) // 2, sides[k]) if k in cuts else [n]
        key = F.get(F.array(*keys), _listed([cuts[k].dimension if k in cuts else 0 for k in range(len(nodes))], F.col("node")).cast("int"))
        beyond = key >= _listed([cuts[k].at if k in cuts else _BEYOND for k in range(len(nodes))], F.col("node"))
        units = units.withColumn("node", _listed(base, F.col("node")) + beyond.cast("long"))
        nodes, level = after, level + 1
        if level % 4 == 0:  # plans do not grow with the tree
            units = saved(units, "units")
    placed = [(*(h[c] for c in name), n.first) for n in nodes for h in n.heavy]
    return units.select(*name, _listed([n.first for n in nodes], F.col("node")).cast("int").alias("shard")).unionAll(
        spark.createDataFrame(placed, "copy long, text_crc32 long, parts int, part int, n long, shard int")
    )


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """Each row's shard from 0 to ``count`` - 1 with near-equal bytes, and its slot there.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard,
    slot (0, 1, ... in each shard) and grown_shard (null: the law is not 'key').
    A null text has no bytes and the checksum of the empty text. Equal rows get slots of their own. Null ids are
    allowed. With fewer units than shards some shards stay empty; an empty table
    gives an empty result. Columns other than doc_id, text, source and lang are not read.
    """
    rows = saved(_with_rank(_with_rank(_metadata(docs), "source"), "lang"), "metadata")
    total = rows.agg(F.sum("size")).first()[0] or 0
    units = _units(rows, total / count)
    spans = units.agg(*(f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("low", F.min), ("high", F.max)))).first()
    scaled = [
        _position(F.col(c), F.lit(spans[f"low_{c}"]).cast("double"), F.lit(spans[f"high_{c}"]).cast("double")).alias(c) for c in DIMENSIONS
    ]
    scaled = _weighed(rows, units).select("copy", "text_crc32", "parts", "part", "n", "weight", *scaled)
    keys = [_ordered(F.col(c)).alias(f"key_{d}") for d, c in enumerate(DIMENSIONS)]
    units = saved(scaled.select("copy", "text_crc32", "parts", "part", "n", "weight", *keys), "units")
    where = _leaves(units, total, count)
    hot = units.filter("parts > 1").select("copy", "text_crc32", "parts").distinct()
    numbered = rows.join(F.broadcast(hot), ["copy", "text_crc32"], "left")  # few, as above
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "copy"), F.col("parts")).cast("int"), F.lit(0))
    placed = join_hot(numbered.withColumn("part", part), saved(where.drop("parts"), "where"), ["copy", "text_crc32", "part"])
    return _slots(placed.select("doc_id", "size", "text_crc32", "shard")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0: within hashed blocks, after the blocks before them."""
    placed = saved(placed, "placed")
    blocks = max(1, math.ceil(placed.count() / NUMBERED)) * 4
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    ranked = blocked.withColumn("rank", F.row_number().over(within))
    return ranked.join(starts, ["shard", "block"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long"))
