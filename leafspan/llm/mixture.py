"""Mixing sources to target weights by Pareto order sampling.

Method (Rosen 1997): a document gets the rank [u / (1 - u)] / odds, with u a uniform
number drawn from its id and odds its inclusion odds; a sample of fixed size is the
documents of the smallest ranks. A source whose target is f times its size takes
floor(f) whole copies of each document for certain; the rest of the target is
sampled. The odds of a document are in proportion to (size + 1) ** POWER, so that
long documents are likelier than short ones and one long document rarely decides where
the sample ends. The size of a sample is fixed in words: documents are taken in the
order of their ranks until the words taken come nearest to the rest of the target.
The rank at which that happens is the factor of the odds: a document is taken with
probability odds * rank / (1 + odds * rank) (``inclusion``).

Targets: sources in the order of their code points (null last) weigh 1, 2, 3, 1,
2, 3, ... and share all words; no target exceeds 3 times its source, and the
excess goes to the others by weight.

The place where the sample ends is found without sorting a source: words are
summed per source and bin of the rank, the bin where the target falls is known from
running sums over bins, and only rows of that bin are sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.llm.session import BROADCAST_ROWS, SPACE_WORD, saved, set_aside, with_small

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 20240917
#: Inclusion odds grow with this power of a document's length.
POWER = 1.0
#: Rows of a source's bin that are sorted together, about.
BIN_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A capped source keeps ``most`` times its size; the level of the others solves
    sum(min(cap, level * weight)) = all words, which one pass over the sources in
    the order of cap / weight gives.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    named = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = named.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    open_level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return levels.withColumn("open", open_level).select(
        "source",
        "source_size",
        F.when(F.col("capped") | F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight"))).alias("target"),
    )


def uniform(*key, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the key only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def odds(size: Column, power: float = POWER) -> Column:
    """Inclusion odds of a document of ``size`` words, up to its source's factor."""
    return F.pow(size + F.lit(1.0), F.lit(power))


def pareto_rank(u: Column, weight: Column) -> Column:
    """[u / (1 - u)] / odds"""
    return (u / (1 - u)) / weight


def inclusion(size: Column, cut: Column, power: float = POWER) -> Column:
    """The probability that a document of ``size`` words has a rank of at most ``cut``."""
    return odds(size, power) * cut / (1 + odds(size, power) * cut)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _nth: 0, 1, ... for the rows of one _key, so that equal rows get draws of their own.

    Only keys that occur again are numbered: within each of the parts that Spark reads, after the
    parts before, so that a key of very many rows does not meet in one task.
    """
    again = saved(rows.groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_again")), "again")
    if again.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    marked = rows.join(with_small(again, BROADCAST_ROWS), F.col("_key") == F.col("_again"), "left")
    once = marked.filter("_again IS NULL").drop("_again").withColumn("_nth", F.lit(0).cast("long"))
    placed = marked.filter("_again IS NOT NULL").drop("_again").withColumn("_part", F.spark_partition_id())
    placed = saved(placed, "repeated")
    upto = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_key", "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_key", "_part").orderBy("_key")
    placed = placed.withColumn("_nth", F.row_number().over(within) - 1).join(parts, ["_key", "_part"])
    placed = saved(placed.withColumn("_nth", (F.col("_nth") + F.col("_before")).cast("long")).drop("_part", "_before"), "numbered")
    return once.unionByName(placed)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text", F.lit(1), "source"))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, _size, _u) of rows (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    rows = _keyed(docs, seed).select("doc_id", "source", size.alias("_size"), "_key")
    return numbered(saved(rows, "sizes")).select("doc_id", "source", "_size", uniform("_key", "_nth").alias("_u"))


def _ranked(rows: DataFrame, goals: DataFrame, bins: int, power: float) -> DataFrame:
    """``rows`` (source, _size, _u) joined with their source's goals, with _rank and _own, its bin."""
    out = rows.join(with_small(goals, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_source")))
    out = out.withColumn("_rank", pareto_rank(F.col("_u"), odds(F.col("_size"), power)))
    scaled = F.col("_rank") * F.col("scale")
    return out.withColumn("_own", F.least(F.floor(scaled / (1 + scaled) * bins), F.lit(bins - 1)).cast("int"))


def cuts(rows: DataFrame, power: float = POWER) -> tuple[DataFrame, int]:
    """Per source (_source, source_size, target, certain, rest, scale, bin, cut), and the number of bins, from (source, _size, _u).

    The sample of a source are its rows of a bin below ``bin``, and those of ``bin`` whose rank is at most ``cut``.
    """
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.avg(odds(F.col("_size"), power)).alias("scale"))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a target of exactly k times its source must not fall below k by rounding
    factor = F.when(F.abs(factor - F.round(factor)) < 1e-9, F.round(factor)).otherwise(factor)
    goals = targets(sizes.drop("scale")).withColumn("certain", F.floor(factor).cast("int")).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    named = sizes.select(F.col("source").alias("_source"), "scale")
    goals = goals.join(named, F.col("source").eqNullSafe(F.col("_source")))
    goals = saved(goals.select("_source", "source_size", "target", "certain", "rest", "scale"), "targets")

    bins = max(64, min(1 << 20, math.ceil(rows.count() / BIN_ROWS)))
    placed = _ranked(rows, goals, bins, power).filter("rest > 0")
    upto = Window.partitionBy("source").orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = placed.groupBy("source", "_own").agg(F.sum("_size").alias("words"), F.first("rest").alias("rest"))
    ends = (
        filled.withColumn("sum", F.sum("words").over(upto))
        .filter("sum >= rest")
        .groupBy(F.col("source").alias("s"))
        .agg(F.min(F.struct(F.col("_own").alias("bin"), (F.col("sum") - F.col("words")).alias("before"))).alias("e"))
        .select("s", "e.*")
    )
    ends = saved(ends, "ends")
    last = placed.join(with_small(ends, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("s"))).filter("_own = bin")
    ordered = Window.partitionBy("source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("sum", F.col("before") + F.sum("_size").over(ordered))
    # the row that crosses the rest is taken if that comes nearer to it than leaving it out
    under = last.filter(2 * F.col("sum") - F.col("_size") < 2 * F.col("rest")).groupBy(F.col("source").alias("t")).agg(F.max("_rank").alias("cut"))
    ends = ends.join(under, F.col("s").eqNullSafe(F.col("t")), "left").select("s", "bin", "cut")
    return saved(goals.join(ends, F.col("_source").eqNullSafe(F.col("s")), "left").drop("s"), "cuts"), bins


def _with_copies(rows: DataFrame, goals: DataFrame, bins: int, power: float) -> DataFrame:
    """``rows`` with their goals and _copies: the certain ones, and one more for rows of the sample."""
    out = _ranked(rows, goals, bins, power)
    inside = (F.col("_own") < F.col("bin")) | ((F.col("_own") == F.col("bin")) & (F.col("_rank") <= F.col("cut")))
    return out.withColumn("_copies", F.col("certain") + ((F.col("rest") > 0) & F.coalesce(inside, F.lit(False))).cast("int"))


def mix(docs: DataFrame, seed: int = SEED, power: float = POWER) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, u, rank), a row per row of ``docs``.

    ``docs`` needs doc_id, text and source. size counts words (a null text has
    none), taken is copies * size. Null sources are one source. Equal rows are numbered and get draws
    of their own. A document without words is taken like any other,
    for nothing. The draw depends on doc_id, text, source, that number and ``seed`` alone. An empty
    table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = _drawn(docs, seed)
    goals, bins = cuts(rows, power)
    return _with_copies(rows, goals, bins, power).select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
        F.col("_u").alias("u"),
        F.col("_rank").alias("rank"),
    )


def mixed(docs: DataFrame, seed: int = SEED, power: float = POWER) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, with the columns of ``docs``."""
    plain, restored = set_aside(docs, "doc_id", "text", "source")
    cast = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")}
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    goals, bins = cuts(_drawn(plain.select(*(c.alias(n) for n, c in cast.items()), "text"), seed), power)
    rows = numbered(_keyed(plain.withColumns(cast), seed)).withColumn("_u", uniform("_key", "_nth")).withColumn("_size", size)
    taken = _with_copies(rows, goals, bins, power).filter("_copies > 0")
    out = restored(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema))
