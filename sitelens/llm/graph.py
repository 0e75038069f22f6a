"""Connected components of links, as joins and aggregations on stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import stored

#: Links that one task contracts.
LINKS_PER_TASK = 500_000


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as a forest of stars: (node, root) for each of its nodes."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not parts:
        return
    x, y = (np.concatenate(v) for v in zip(*parts))
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[:len(x)], at[len(x):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        for end in (x, y):  # hang the root of either end under the smaller root, then shorten the paths
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    for a in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a:a + (1 << 16)]), pa.array(nodes[root[a:a + (1 << 16)]])], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; ``component`` is one of the nodes it reaches.

    Tasks first contract some hundred thousand links each to stars.  Unless one task held them all, rounds
    follow: each names every node after the first of itself and its neighbours in a random order and maps
    the links to the names, so that nodes that reach one another stay linked or get one name and the links
    left shrink by a constant share, however long the chains; names are then followed from the last round
    to the first.  Rounds are stored, nothing but counts reaches the driver, hot nodes are pre-aggregated.
    """
    edges = stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x != y"), "links")
    tasks = -(-edges.count() // LINKS_PER_TASK)
    stars = edges.repartition(max(1, tasks)).mapInArrow(_forest_batches, "node long, root long")
    if tasks <= 1:
        return stored(stars.withColumnRenamed("root", "component"), "components")
    edges = stored(stars.filter("node != root").select(F.col("node").alias("x"), F.col("root").alias("y")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        order = F.struct(F.xxhash64("other", F.lit(len(rounds))), F.col("other"))
        ends = [F.struct(F.col(p).alias("node"), F.col(q).alias("other")) for p in "xy" for q in "xy"]
        both = edges.select(F.explode(F.array(*ends)).alias("e")).select("e.*")
        names = stored(both.groupBy("node").agg(F.min(order).alias("first")).select("node", F.col("first.other").alias("name")), "names")
        rounds.append(names)
        of = lambda end: names.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
        mapped = edges.join(of("x"), "x").join(of("y"), "y").filter("x_name != y_name")
        edges = stored(mapped.select(F.least("x_name", "y_name").alias("x"), F.greatest("x_name", "y_name").alias("y")).distinct(), "links")
    out = rounds.pop().withColumnRenamed("name", "component")
    while rounds:
        after = out.select(F.col("node").alias("name"), "component")
        out = rounds.pop().join(after, "name", "left").select("node", F.coalesce("component", "name").alias("component"))
    return stored(out, "components")
