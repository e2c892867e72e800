"""MinHash near-duplicate classes.

Method: Fast Similarity Sketching (Dahlgaard, Knudsen, Thorup 2017). In round r
each shingle is thrown into one of T bins with the value (r, hash); the
smallest value of a bin stands. After T such rounds, round T+j throws all
shingles into bin j, so that every coordinate fills, whatever the set's size.
Sketches are cut into BANDS bands; documents that share a band are candidates,
and a link needs 100 * |A n B| >= 75 * |A u B| on the full shingle sets.

A pair of similarity 0.75 shares none of 32 bands of 4 with probability below
6e-6. Candidates whose sketches agree in fewer than 60 of 128 coordinates are
put aside (a pair of 0.75 agrees in 96 +- 4.9, so this loses below 1e-11).

Groups are never expanded into pairs. Equal sets become one node. Each node is
confirmed against the best of its bands' smallest nodes, which links most copies
to their original at a cost linear in the nodes. What is left are nodes of bands that hold
several classes. Their shingles are ordered by how few of these nodes have them; two sets that are
similar enough share one among the first seventh of the smaller set and the first
quarter of the larger one (prefix filtering), so that texts that share a template but are not
similar enough mostly part here, where they only have shingles of their own. Nodes that
share such shingles make clusters, whose full sets are compared in blocks, each block pair as
one product of incidence matrices, of which a spanning forest of the links comes out.
Blocks within one class are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as kinds

from leafspan.llm import textnum as tn
from leafspan.llm.components import components
from leafspan.llm.session import BROADCAST_ROWS, join_hot, saved, set_aside, small_batches, with_small

T, BANDS, ROWS = 128, 32, 4
SHINGLE = 5
#: Coordinates of T that must agree before full sets are compared.
AGREE = 60
#: A link: SHARE_OF * |A n B| >= SHARE * |A u B|.
SHARE_OF, SHARE = 100, 75
#: Rows of a batch of shingles.
SHINGLES_AT_ONCE = 1 << 16
#: Nodes that are compared at a time.
BLOCK = 256
_DOC_BITS = np.uint64(8)

SKETCHED = "doc_id long, n_shingles long, set_key binary, sketch binary, bands array<long>"


def shingle_sets(words: tn.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 56-bit shingle) sorted and distinct, for at most 256 texts."""
    h = words.hashes()
    at = tn.window_starts(words.count, words.start_of_doc, k)
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    own, doc = [], []
    if len(at):
        own.append(tn.window_hashes(h, k)[at])
        doc.append(words.doc[at])
    for n in range(1, k):  # a text of fewer words is one shingle
        some = few[words.count[few] == n]
        if len(some):
            own.append(tn.window_hashes(h, n, seed=100 + n)[words.start_of_doc[some]])
            doc.append(some)
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, tn.U)
    key = np.concatenate(own) >> _DOC_BITS
    key |= np.concatenate(doc).astype(tn.U) << (np.uint64(64) - _DOC_BITS)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> (np.uint64(64) - _DOC_BITS)).astype(np.int64), key & np.uint64((1 << 56) - 1)


def sketch(doc: np.ndarray, shingle: np.ndarray, docs: int) -> np.ndarray:
    """docs x T coordinates; texts without shingles keep the largest number."""
    empty = np.uint64(2**64 - 1)
    out = np.full(docs * T, empty, tn.U)
    for r in range(2 * T):
        if not len(doc):
            break
        h = tn.mix(shingle, r)
        value = (h >> np.uint64(8)) | np.uint64(r << 56)
        if r < T:
            np.minimum.at(out, doc * T + (h & np.uint64(T - 1)).astype(np.int64), value)
        else:
            free = out[doc * T + r - T] >= np.uint64(r << 56)
            np.minimum.at(out, doc[free] * T + r - T, value[free])
        if r < 16 or r % 8 == 7:
            more = (out.reshape(docs, T) == empty).any(axis=1)[doc]
            doc, shingle = doc[more], shingle[more]
    return out.reshape(docs, T)


def _pieces(batches):
    for batch in batches:
        data, offsets = tn.texts(batch.column("text"))
        for a, b in tn.pieces(offsets):
            for c in range(a, b, 256):
                d = min(c + 256, b)
                yield (
                    batch.slice(c, d - c),
                    tn.Words(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c], tn.SPACE_WORDS),
                )


@tn.tidied
def _sketches(batches):
    for rows, words in _pieces(batches):
        n = rows.num_rows
        doc, shingle = shingle_sets(words)
        count = np.bincount(doc, minlength=n)
        coordinates = sketch(doc, shingle, n)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        key = np.zeros((n, 2), tn.U)
        some = np.flatnonzero(count)
        if len(some):
            for j in (0, 1):
                key[some, j] = np.add.reduceat(tn.mix(shingle, 300 + j), first[some])
        bands = np.zeros((n, BANDS), tn.U)
        for j in range(ROWS):
            bands = bands * np.uint64(0x9E3779B97F4A7C15) + coordinates[:, j::ROWS]
        bands = tn.mix(bands + np.arange(BANDS, dtype=tn.U), 400)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array(count, pa.int64()),
                tn.binary_rows(key, np.ones(n, np.int64), 16),
                tn.binary_rows((coordinates & np.uint64(255)).astype(np.uint8), np.ones(n, np.int64), T),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64))
                ),
            ],
            names=["doc_id", "n_shingles", "set_key", "sketch", "bands"],
        )


@tn.tidied
def _agreeing(batches):
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, T) for c in ("sa", "sb")
        )
        agree = (a == b).sum(axis=1)
        keep = agree >= AGREE
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("a").filter(pa.array(keep)),
                batch.column("b").filter(pa.array(keep)),
                pa.array(agree[keep], pa.int32()),
            ],
            names=["a", "b", "agree"],
        )


def _forest(adjacent: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller) of a spanning forest of the bipartite relation ``adjacent`` of nodes one x two."""
    i, j = np.flatnonzero(adjacent.any(axis=1)), np.flatnonzero(adjacent.any(axis=0))
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    adjacent, one, two = adjacent[np.ix_(i, j)], one[i], two[j]
    top = np.iinfo(np.int64).max
    a, b = one.copy(), two.copy()
    while True:
        b2 = np.minimum(b, np.where(adjacent, a[:, None], top).min(axis=0))
        a2 = np.minimum(a, np.where(adjacent, b2[None, :], top).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    node, least = np.concatenate([one, two]), np.concatenate([a, b])
    keep = node != least
    return node[keep], least[keep]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]):
    if found:
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        pairs = np.unique(np.stack([a, b]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _linked(table: pa.Table) -> pa.Table:
    """Forests of the exact links of one cell: within each cluster, or between a cluster's two blocks."""
    cluster, side, node, component = (table.column(c).to_numpy() for c in ("cluster", "side", "node", "component"))
    items = [np.frombuffer(x, tn.U) for x in table.column("items").to_pylist()]
    found = []
    for c in np.unique(cluster):
        own = np.flatnonzero(cluster == c)
        left, right = own[side[own] == 0], own[side[own] == 1]
        right = right if len(right) else left
        sizes = np.array([len(items[x]) for x in own])
        at = {x: k for k, x in enumerate(own)}
        every = np.concatenate([items[x] for x in own])
        who = np.repeat(np.arange(len(own)), sizes)
        value, place, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[place] > 1
        who, place = who[shared], (np.cumsum(times > 1) - 1)[place[shared]]
        order = np.argsort(place, kind="stable")
        who, place = who[order], place[order]
        i, j = np.array([at[x] for x in left]), np.array([at[x] for x in right])
        both = np.zeros((len(i), len(j)), np.float32)
        for low in range(0, int(place.max(initial=-1)) + 1, 4096):  # a slice of the shingles at a time
            x, y = np.searchsorted(place, [low, low + 4096])
            incidence = np.zeros((len(own), 4096), np.float32)
            incidence[who[x:y], place[x:y] - low] = 1
            both += incidence[i] @ incidence[j].T
        both = both.astype(np.int64)
        linked = SHARE_OF * both >= SHARE * (sizes[i][:, None] + sizes[j][None, :] - both)
        linked &= component[left][:, None] != component[right][None, :]
        found.append(_forest(linked, node[left], node[right]))
    return pa.Table.from_batches(list(_edges(found)), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _sets(docs: DataFrame, wanted: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., node, items) for the rows of ``wanted`` (carry..., node): items holds the node's shingles as 64-bit numbers."""
    rows = docs.select(F.col("doc_id").alias("node"), "text").join(with_small(wanted, BROADCAST_ROWS), "node")
    names = [*carry, "node"]

    @tn.tidied
    def pack(batches):
        for rows, words in _pieces(batches):
            doc, shingle = shingle_sets(words)
            count = np.bincount(doc, minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in names), tn.binary_rows(shingle, count, 8)], names=[*names, "items"]
            )

    return rows.mapInArrow(pack, ", ".join(f"{c} long" for c in names) + ", items binary")


@tn.tidied
def _overlaps(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True):
            x, y = np.frombuffer(x, tn.U), np.frombuffer(y, tn.U)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum()) if len(y) else 0
            keep.append(SHARE_OF * both >= SHARE * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Meant for many a per b, which are dealt to cells of some BLOCK."""
    of_b = saved(pairs.groupBy("b").agg(F.count("*").alias("n")), "counts")
    cell = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / BLOCK)).cast("long")
    dealt = saved(join_hot(pairs, of_b, "b").select("a", "b", cell.alias("cell")), "dealt")
    one = _sets(docs, dealt.select(F.col("a").alias("node"), "b", "cell"), ["b", "cell"])
    two = _sets(docs, dealt.select(F.col("b").alias("node"), "cell").distinct(), ["cell"])
    one = one.select(F.col("node").alias("a"), "b", "cell", F.col("items").alias("ia"))
    two = two.select(F.col("node").alias("b"), "cell", F.col("items").alias("ib"))
    return one.join(two, ["b", "cell"]).select("a", "b", "ia", "ib").mapInArrow(_overlaps, "a long, b long")


@tn.tidied
def _shingles(batches):
    """(node, row, n_shingles, shingle), a row for each member of a text's set."""
    for rows, words in _pieces(batches):
        doc, shingle = shingle_sets(words)
        size = np.bincount(doc, minlength=rows.num_rows)
        node, row = (rows.column(c).to_numpy()[doc] for c in ("node", "row"))
        columns = (node, row, size[doc], shingle.view(np.int64))
        for i in range(0, len(doc), SHINGLES_AT_ONCE):
            part = slice(i, i + SHINGLES_AT_ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in columns], names=["node", "row", "n_shingles", "shingle"])


def clusters(docs: DataFrame, shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cluster): nodes of bands with several classes, joined where their sets share a shingle of their prefixes.

    A shingle that one node has joins nothing, and neither does one that is in no set's shorter prefix.
    """
    placed = saved(shared.select("band", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    of_band = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    open_nodes = saved(join_hot(placed, saved(of_band, "open-bands"), "band").filter("x <> y").select("node").distinct(), "open-nodes")
    # rows of one id are ranked each by itself
    texts = docs.select(F.col("doc_id").alias("node"), F.monotonically_increasing_id().alias("row"), "text").join(with_small(open_nodes, BROADCAST_ROWS), "node")
    rows = saved(texts.mapInArrow(_shingles, "node long, row long, n_shingles long, shingle long"), "shingles")
    common = saved(rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    own = Window.partitionBy("row")
    ranked = (
        join_hot(rows, common, "shingle")
        .withColumn("place", F.row_number().over(own.orderBy("n", "shingle")) + F.col("n_shingles") - F.count("*").over(own))
        .withColumn("short", F.col("place") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * (2 * SHARE / (SHARE + SHARE_OF)) - 1e-9) + 1)
        .filter(F.col("place") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * (SHARE / SHARE_OF) - 1e-9) + 1)
        .select("node", "shingle", "short")
    )
    ranked = saved(ranked, "prefixes")
    least = ranked.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("b"), F.max("node").alias("other"), F.max("short").alias("any"))
    least = saved(least.filter("any AND b <> other").select("shingle", "n", "b"), "prefix-groups")
    edges = join_hot(ranked.select("node", "shingle"), least, "shingle").select(F.col("node").alias("a"), "b").distinct()
    return saved(components(edges), "clusters").withColumnRenamed("component", "cluster")


def remaining_links(docs: DataFrame, cluster: DataFrame, classes: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the exact links between different classes within each cluster."""
    placed = cluster.join(classes, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component"))
    placed = saved(placed, "placed")
    open_ = placed.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    placed = saved(join_hot(placed, saved(open_.filter("x <> y").select("cluster", "n"), "clusters"), "cluster"), "open")
    cells = max(1, placed.count() // BLOCK)
    small = placed.filter(F.col("n") <= BLOCK).select(
        F.pmod(F.xxhash64("cluster"), F.lit(cells)).alias("cell"), "cluster", F.lit(0).cast("long").alias("side"), "node", "component"
    )
    large = placed.filter(F.col("n") > BLOCK)
    sizes = large.groupBy("cluster", "component").agg(F.count("*").alias("of_class"))
    # a class that fills blocks gets its own, the others share mixed ones
    alone = F.col("of_class") > BLOCK
    mixed = sizes.filter(~alone).groupBy("cluster").agg(F.sum("of_class").alias("of_mixed"))
    large = large.join(sizes, ["cluster", "component"]).join(mixed, "cluster", "left")
    count = F.ceil(F.when(alone, F.col("of_class")).otherwise(F.col("of_mixed")) / BLOCK)
    pure = F.when(alone, F.col("component"))
    large = large.select(
        "cluster", "node", "component", pure.alias("pure"), F.xxhash64(pure, F.pmod(F.xxhash64("node"), count)).alias("block")
    )
    blocks = large.select("cluster", "block", "pure").distinct()
    other = blocks.select("cluster", F.col("block").alias("block2"), F.col("pure").alias("pure2"))
    pairs = blocks.join(other, "cluster").filter("block <= block2 AND NOT coalesce(pure = pure2, false)")
    pairs = pairs.select("cluster", "block", "block2", F.xxhash64("cluster", "block", "block2").alias("cell"))
    members = large.select("cluster", "block", "node", "component")
    side = lambda k, of: pairs.filter(of).select("cell", "cluster", F.col(k).alias("block")).join(members, ["cluster", "block"])
    names = ["cell", "cluster", "side", "node", "component"]
    one = side("block", F.lit(True)).withColumn("side", F.lit(0).cast("long")).select(names)
    two = side("block2", F.col("block") < F.col("block2")).withColumn("side", F.lit(1).cast("long")).select(names)
    wanted = saved(small.unionAll(one).unionAll(two), "cells")
    sets = _sets(docs, wanted, [c for c in names if c != "node"])
    return sets.groupBy("cell").applyInArrow(_linked, "a long, b long")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    ``docs`` needs doc_id (long) and text. Null or blank texts have no shingle
    and link with nothing. Rows with a null doc_id link with nothing, get a null
    component_id and are kept. Rows that share a doc_id count as one document.
    Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = saved(docs.mapInArrow(_sketches, SKETCHED), "sketches")
    full = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # read back, so that joins by set and id are dealt by both, not by a set that very many share
    members = saved(full.groupBy("set_key").agg(F.min("doc_id").alias("node")), "members")
    nodes = saved(
        full.join(members.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("node"), "sketch", "bands"),
        "nodes",
    )
    # rows of one id with unequal sets are one document
    twice = full.select("doc_id", "set_key").distinct().groupBy("doc_id").count().filter("count > 1")
    same = full.join(twice, "doc_id", "left_semi").join(members, "set_key")
    same = same.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    banded = nodes.select("node", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("b"), F.max("node").alias("other"))
    leaders = saved(leaders.filter("b <> other").select("band", "n", "b"), "leaders")
    shared = saved(join_hot(banded, leaders, "band").select("band", "node", "b"), "bands")
    pairs = shared.filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    sketches = nodes.select("node", "sketch")
    near = (
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        .mapInArrow(_agreeing, "a long, b long, agree int")
    )
    near = saved(near, "near")
    best = saved(near.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b")), "best")
    links = saved(confirmed(best, docs).unionAll(same), "links")
    classes = saved(components(links), "classes")
    cluster = clusters(docs, shared, classes)
    more = saved(remaining_links(docs, cluster, classes), "links")
    if not more.isEmpty():
        classes = saved(components(links.unionAll(more)), "classes")

    label = members.join(classes, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "set_key").join(label, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _unordered(kind: kinds.DataType) -> bool:
    if isinstance(kind, kinds.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, kinds.StructType):
        return any(_unordered(f.dataType) for f in kind)
    return isinstance(kind, (kinds.MapType, kinds.VariantType))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the first of those with the smallest doc_id.

    Rows with a null doc_id all stay. Of rows that share the kept doc_id, the one
    with the smallest text stays (null first), and of those the one whose further columns, as far as they can be ordered, are smallest.
    """
    plain, restored = set_aside(docs, "doc_id", "text")
    kept = near_duplicate_classes(plain).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    twice = plain.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    stay = plain.join(kept, "doc_id", "left_semi")
    again = stay.join(twice, "doc_id", "left_semi")
    rest = [c for c in plain.columns if c != "doc_id"]
    ordered = [f.name for f in plain.schema if f.name in rest and f.name != "text" and not _unordered(f.dataType)]
    again = again.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct("text", *ordered)).alias("row_"))
    again = again.select("doc_id", *(F.col("row_").getField(c).alias(c) for c in rest))
    out = stay.join(twice, "doc_id", "left_anti").unionByName(again).unionByName(plain.filter("doc_id IS NULL"))
    return restored(out)
