"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epifold.operators.joins import join_per_key
from epifold.sources.storage import Scratch

#: Links that a task holds at once.
HELD = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that the links reach from each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _thinned(edges: DataFrame) -> DataFrame:
    """Links (a, b) that reach what the given ones reach: each task's blocks become stars, a below b."""

    def run(batches):
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column("a").to_numpy()])
            b = np.concatenate([b, batch.column("b").to_numpy()])
            if len(a) > HELD:
                a, b = star(a, b)
                if len(a) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.zeros(0, np.int64)
        a, b = star(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def star(a, b):
        node, root = forest(a, b)
        return root[root != node], node[root != node]

    return edges.mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that the links reach from each node.

    In each round every node points at the first of itself and its neighbours,
    and links between what is pointed at are all that goes on to the next round,
    each task's links thinned to stars before. The first round takes nodes by
    number, as most links lead to a small one, the others in a drawn order, in
    which a share of the nodes goes every round whatever the graph. So rounds
    after the first are small, and their tables can be broadcast. After so many
    ``rounds``, if given, nodes with one component are linked for sure, but those
    with different ones may be linked too. Only nodes with a link are listed; a
    node's neighbours meet in a minimum that is taken before the shuffle, so a
    node with very many links is no heavier than others. Tables are written as
    ``name-*``. An empty table gives an empty result.
    """
    steps: list[DataFrame] = []
    x, y = F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")
    edges = scratch.store(_thinned(links.select(x, y).where("a <> b")), f"{name}-edges0")
    while not steps or not edges.isEmpty():
        turn = len(steps)

        def place(node: Column, turn: int = turn) -> Column:
            return F.xxhash64(node, F.lit(turn)) if turn else node

        both = edges.union(edges.select("b", "a")).withColumn("place", place(F.col("b")))
        near = both.groupBy("a").agg(F.min_by("b", "place").alias("first"), F.min("place").alias("place"))
        step = near.select(F.col("a").alias("node"), F.when(F.col("place") < place(F.col("a")), F.col("first")).otherwise(F.col("a")).alias("next"))
        steps.append(scratch.store(step, f"{name}-step{turn}"))
        if len(steps) == rounds:
            break
        for end in ("a", "b"):
            edges = edges.join(steps[-1].select(F.col("node").alias(end), F.col("next").alias(f"{end}_next")), end)
        apart = edges.select(F.col("a_next").alias("a"), F.col("b_next").alias("b")).where("a <> b")
        edges = scratch.store(_thinned(apart), f"{name}-edges{turn + 1}")
    label = steps.pop()
    if not steps:
        # By number, what is pointed at is the smallest node.
        return label.withColumnRenamed("next", "component")
    for step in reversed(steps):
        label = step.join(label.select(F.col("node").alias("next"), F.col("next").alias("beyond")), "next", "left").select(
            "node", F.coalesce("beyond", "next").alias("next")
        )
    label = scratch.store(label, f"{name}-ends")
    low = label.groupBy("next").agg(F.min("node").alias("component"))
    return scratch.store(join_per_key(label, low, ["next"]).select("node", "component"), name)
