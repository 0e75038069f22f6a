"""Embedding near-dedup by product quantisation (operator 3).

Equal vectors of one label are one node.  Nodes lie in the inverted list of their nearest coarse
centroid, with the residual coded by one of ``CODES`` words in each subspace.  A query probes every list
that may hold a vector within the link distance: the list's radius must reach, and the bisector between its
own centroid and the list's must be no farther than that distance (nor, in many dimensions, than
``PROBE_DEVIATIONS`` deviations of it).  In a list, distances to coded vectors are sums of looked-up
distances (asymmetric: the query is not coded); codes within the link distance plus the vector's own
coding error, a bound that loses nothing, are reranked by exact cosine in double precision.  The index is
fitted on a bounded sample (``SAMPLE``), every row is indexed and every row asks.

Queries and members of a list meet in tiles of bounded size; a tile gives link counts and a spanning
forest of its links, so dense lists do not expand into all their pairs.

Defined cases: a null label, null or empty vectors, zero vectors and vectors with null or non-finite
components link with nothing (n_links 0, their own component, kept); vectors of different lengths never
link; repeated rows are vectors of their own and link with each other; a null vec_id is never a
component's smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import stored
from sitelens.llm.graph import components

MIN_COSINE = 0.93
#: Bound of the rows that centroids and code words are fitted on.
SAMPLE = 16_384
MAX_LISTS = 1024
#: Vectors of one label that a list should hold; more lists mean more copies of each query, fewer mean larger lists.
LIST_ROWS = 128
#: A neighbour at distance t lies t / sqrt(d) (one standard deviation) nearer to a bisector or farther from it, if offsets
#: have no preferred direction; lists beyond so many deviations are not probed.
PROBE_DEVIATIONS = 4.0
SUBSPACES, CODES, ROUNDS, SEED = 8, 64, 8, 3
TILE = 512
#: Slack of the float bounds, far above rounding errors and far below distances that matter.
SLACK = 1e-4


def centroids(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """k-means (Lloyd's rounds from random rows)."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], minlength=len(c))
            n = np.bincount(near, minlength=len(c))
            c[:, d] = np.where(n > 0, total / np.maximum(1, n), c[:, d])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a:a + 4096] = ((c * c).sum(1) - 2 * x[a:a + 4096] @ c.T).argmin(1)
    return out


class Index:
    """Coarse centroids and residual code words for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        lists = int(np.clip(lists, 1, min(MAX_LISTS, max(1, len(sample) // 8))))
        self.coarse = centroids(sample, lists)
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.words = [centroids(rest[:, a:b], CODES, SEED + 1 + q) for q, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]
        n = (self.coarse ** 2).sum(1)
        self.gaps = np.sqrt(np.maximum(0, n[:, None] + n[None, :] - 2 * self.coarse @ self.coarse.T))
        self.radius = np.zeros(len(self.coarse))

    def code(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, distance to its centroid, codes, distance to the coded vector)."""
        home = nearest(u, self.coarse)
        rest = u - self.coarse[home]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), self.words)], 1).astype(np.uint8)
        coded = np.concatenate([w[codes[:, q]] for q, w in enumerate(self.words)], 1)
        return home, np.sqrt((rest * rest).sum(1)), codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def probes(self, u: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists from each row's own on that may hold a vector within ``reach`` of it."""
        square = np.maximum(0, (u * u).sum(1)[:, None] + (self.coarse ** 2).sum(1) - 2 * u @ self.coarse.T)
        home = square.argmin(1)
        gap = self.gaps[home]
        beyond = (square - square[np.arange(len(u)), home][:, None]) / np.maximum(2 * gap, 1e-12)  # distance to the bisector
        width = reach * min(1.0, PROBE_DEVIATIONS / np.sqrt(u.shape[1]))
        ok = (np.sqrt(square) <= self.radius + reach) & ((beyond <= width) | (gap == 0)) & (np.arange(len(self.coarse)) >= home[:, None])
        return np.nonzero(ok)

    def distances(self, u: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of list ``at``, by table look-up."""
        rest = u - self.coarse[at]
        out = np.zeros((len(u), len(codes)))
        for q, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            w = self.words[q]
            look_up = (rest[:, a:b] ** 2).sum(1)[:, None] + (w * w).sum(1) - 2 * rest[:, a:b] @ w.T
            out += look_up[:, codes[:, q]]
        return np.sqrt(np.maximum(out, 0))


def unit(values: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision, scaled to length 1."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    x = np.asarray(values.flatten()).astype(np.float64).reshape(len(values), -1)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, root) of a bipartite graph; rows are nodes 0.., columns follow them."""
    q, b = linked.shape
    row, column = np.arange(q), np.full(b, q + b)
    while True:
        new_column = np.where(linked, row[:, None], q + b).min(0)
        new_row = np.minimum(row, np.where(linked, np.minimum(new_column, column)[None, :], q + b).min(1))
        if (new_row == row).all() and (new_column == column).all():
            break
        row, column = new_row, new_column
    nodes = np.concatenate([np.flatnonzero(linked.any(1)), q + np.flatnonzero(linked.any(0))])
    return nodes, np.concatenate([row, column])[nodes]


def _tile(index, cosine: float):
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[2].as_py()
        asks = np.asarray(table["asks"])
        x, y = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not len(x) or not len(y):
            return pa.table([pa.array([], pa.int64())] * 3, names=["node", "root", "n"])
        u, v = unit(x["embedding"]), unit(y["embedding"])
        codes = np.array(y["codes"].to_pylist(), np.int64).reshape(len(v), -1)
        close = index.value.distances(u, at, codes) <= reach + np.asarray(y["error"])[None, :]
        close &= x["node"].to_numpy()[:, None] != y["node"].to_numpy()[None, :]
        linked = np.zeros(close.shape, bool)
        i, j = np.nonzero(close)
        for a in range(0, len(i), 1 << 16):
            p, q = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
            linked[p, q] = np.einsum("ij,ij->i", u[p], v[q]) >= cosine
        ids = np.concatenate([x["node"].to_numpy(), y["node"].to_numpy()])
        nodes, roots = _forest(linked)
        # a list's own vectors ask one another both ways; those of earlier lists ask for both sides
        away = x["from"].to_numpy() != at
        counts = np.concatenate([linked @ y["copies"].to_numpy(), x["copies"].to_numpy()[away] @ linked[away]])
        counted = np.flatnonzero(counts)
        # forest edges carry no count, counts no edge
        return pa.table([pa.array(np.concatenate([ids[nodes], ids[counted]])), pa.array(np.concatenate([ids[roots], ids[counted]])), pa.array(np.concatenate([np.zeros(len(nodes), np.int64), counts[counted]]))], names=["node", "root", "n"])
    return run


def _indexed(index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                home, far, codes, error = index.value.code(unit(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(home), pa.array(far), pa.array(codes.astype(np.int16).tolist(), pa.list_(pa.int16())), pa.array(error)],
                                                 ["node", "embedding", "label", "copies", "list", "far", "codes", "error"])
    return run


def _probing(index, cosine: float):
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, probed = index.value.probes(unit(batch.column(1)), reach)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[batch.column(q).take(rows) for q in range(5)], pa.array(probed)], ["node", "embedding", "label", "copies", "home", "list"])
    return run


def links(nodes: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """(node, root, n): forest edges (n = 0) and partial link counts (root = node) of nodes with vectors of one length."""
    sc = nodes.sparkSession.sparkContext
    n = nodes.count()
    take = min(1.0, SAMPLE / max(1, n))
    drawn = nodes.filter(F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 20)) < F.lit(int(take * (1 << 20)) + 1)).orderBy("node").limit(SAMPLE).select("embedding").toArrow()
    if not len(drawn):
        drawn = nodes.select("embedding").limit(SAMPLE).toArrow()
    labels = nodes.agg(F.approx_count_distinct("label")).first()[0]
    index = Index(unit(drawn["embedding"]), -(-n // (max(1, labels) * LIST_ROWS)))
    fitted = sc.broadcast(index)  # MAX_LISTS centroids at most
    coded = stored(nodes.select("node", "embedding", "label", "copies").mapInArrow(_indexed(fitted), "node long, embedding array<float>, label int, copies long, list long, far double, codes array<short>, error double"), "codes")
    for r in coded.groupBy("list").agg(F.max("far").alias("far")).collect():  # a row for each list
        index.radius[r["list"]] = r["far"] + SLACK
    shared = sc.broadcast(index)
    probes = coded.select("node", "embedding", "label", "copies", F.col("list").alias("home")).mapInArrow(_probing(shared, cosine), "node long, embedding array<float>, label int, copies long, home long, list long")
    where = ["label", "list"]
    tiles = coded.groupBy(*where).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    chunks = stored(probes.groupBy(*where).agg(F.ceil(F.count("*") / TILE).alias("chunks")), "chunks")
    sizes = tiles.join(chunks, where)
    of = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    ask = probes.join(sizes, where).select("label", "list", every("tiles").alias("tile"), of("chunks").alias("chunk"), F.lit(True).alias("asks"), F.col("home").alias("from"), "node", "embedding", "copies", F.array().cast("array<short>").alias("codes"), F.lit(0.0).alias("error"))
    have = coded.join(sizes, where).select("label", "list", of("tiles").alias("tile"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), F.col("list").alias("from"), "node", "embedding", "copies", "codes", "error")
    return ask.union(have).groupBy("label", "tile", "list", "chunk").applyInArrow(_tile(shared, cosine), "node long, root long, n long")


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"), F.col(label_col).cast("int").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    keyed = rows.withColumn("node", F.when(valid, F.xxhash64("label", "embedding")))
    nodes = stored(keyed.filter(F.col("node").isNotNull()).groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")), "nodes")
    found = None
    for r in nodes.groupBy(F.size("embedding").alias("d")).count().collect():  # one index for each length of vectors
        part = links(nodes.filter(F.size("embedding") == r["d"]), cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "found")
    label = components(found.filter("n = 0 AND node != root"), "node", "root")
    counts = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.select("node", "copies", "first").join(label, "node", "left").join(counts, "node", "left")
    named = named.select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = named.join(lowest, "component").select("node", "n_links", "component_id")
    out = keyed.select("vec_id", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
