"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.llm.session import join_hot, saved

#: Graphs of up to so many edges (16 MB) are solved in one task; larger ones in rounds over all executors.
ONE_TASK = 1_000_000


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _solved(batches):
    """(node, component) of all edges at once: smallest labels spread along edges and are followed to their end."""
    pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not pairs:
        return
    u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes with an edge.

    Each step only takes minima per node, so a node with very many links is
    pre-aggregated on the map side and its edges are rewritten where they lie, never listed per node.
    Null ends and loops are ignored. Each round is written to the shared folder.
    A graph of at most ``one_task`` edges is solved in one task, with the same result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges, "edges")
    if edges.limit(one_task + 1).count() <= one_task:
        return edges.repartition(1).mapInArrow(_solved, "node long, component long")
    edges = saved(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        first = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "first")
        small = (
            join_hot(large, first, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(first.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = saved(small, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
