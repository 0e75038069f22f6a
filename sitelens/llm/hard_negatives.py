"""Hard-negative mining with rotated one-bit codes (operator 11).

Components become integers floor(256 x); a score is the integer inner product with the anchor.  Each row is
rotated by one random orthogonal matrix and stored as its signs (one bit a dimension), its length and the
alignment a of its unit vector o with its code vector c (signs / sqrt(d)).  An anchor, rotated alike and
quantised to ``BITS`` bits a dimension, meets codes by popcounts of bit planes.  As o = a c + r with r
orthogonal to c and |r| = sqrt(1 - a^2), the inner product lies within sqrt(1 - a^2) sqrt(|q|^2 - <q, c>^2) of
a <q, c> (Cauchy-Schwarz); with the bound of the quantisation error this is a certain interval.  In a tile the
rows of the best estimates are scored in integers; rows whose interval cannot reach the k-th of
these scores (or the window) are dropped, all others are scored in integers.  So results are exact.

Anchors and rows meet in tiles of ``TILE`` rows by ``CHUNK`` anchors, first with rows of their own label (positives),
then with all rows (negatives in the windows of the positives' scores); a tile gives at most k rows for each
anchor and window.  No pairs are written.

Defined cases: rows with a null id, a null label, a null vector or a null or non-finite component take no
part; of rows with one id the smallest (label as text, vector) counts; vectors of different lengths do not meet;
zero vectors score 0; equal scores go to the smaller id; components saturate at +-2^22; a negative positive score has an
empty window; anchors without positives or negatives give no rows; an empty table gives an empty result; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import stored

TILE, CHUNK = 4096, 2048
#: Bits of a quantised anchor component, rows scored first in a tile, cells of an estimate matrix.
BITS, SEEDS, CELLS = 6, 16, 1 << 18
SEED = 11
#: Partitions of a shuffle of tiles; more tiles share them.
MOST_PARTITIONS = 20_000
#: Components saturate here: scores of up to 4096 dimensions, times 100, stay within 64 bits.
LARGEST = 1 << 22


@functools.lru_cache(4)
def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([SEED, d]).normal(size=(d, d)))[0] if d else np.zeros((0, 0))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), max(1, -(-bits.shape[1] // 64)) * 64), bool)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), -1)


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits, length, alignment with the code vector) of integer rows."""
    turned = v.astype(np.float64) @ rotation(v.shape[1])
    norm = np.sqrt((turned * turned).sum(1))
    reach = np.abs(turned).sum(1) / np.sqrt(max(1, v.shape[1]))
    align = np.where(norm > 0, reach / np.where(norm > 0, norm, 1), 1.0)
    return packed(turned > 0), norm, np.minimum(align, 1.0)


class Estimates:
    """Intervals of the scores of some anchors against coded rows."""

    def __init__(self, words: np.ndarray, norm: np.ndarray, align: np.ndarray):
        self.words, self.norm, self.align = np.ascontiguousarray(words.T), norm, align
        self.rest = np.sqrt(np.maximum(0, 1 - align * align))
        self.ones = np.bitwise_count(words).sum(1, dtype=np.int64)

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centre, half width) for every anchor and row; the score lies within."""
        d = anchors.shape[1]
        q = anchors.astype(np.float64) @ rotation(d)
        norm = np.sqrt((q * q).sum(1, keepdims=True))
        low = q.min(1, keepdims=True, initial=0.0)
        step = np.maximum((q.max(1, keepdims=True, initial=0.0) - low) / ((1 << BITS) - 1), 1e-300)
        u = np.rint((q - low) / step).astype(np.int64)
        near = low + step * u
        count = np.zeros((len(q), len(self.norm)), np.int32)
        for bit in range(BITS):
            plane = packed((u >> bit & 1).astype(bool))
            for w in range(plane.shape[1]):
                count += np.bitwise_count(plane[:, w, None] & self.words[None, w]).astype(np.int32) << bit
        scale = 1 / np.sqrt(max(1, d))
        along = (2 * (low * self.ones[None, :] + step * count) - near.sum(1, keepdims=True)) * scale  # <q, c>
        slip = np.abs(q - near).sum(1, keepdims=True) * scale
        least = np.maximum(0, np.abs(along) - slip)
        half = self.align * slip + self.rest * np.sqrt(np.maximum(0, norm * norm - least * least))
        return self.norm * self.align * along, self.norm * (half + 1e-9 * norm) + 1e-6


def scored(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows i of a with rows j of b."""
    out = np.zeros(len(i), np.int64)
    for p in range(0, len(i), 1 << 14):
        out[p:p + (1 << 14)] = np.einsum("ij,ij->i", a[i[p:p + (1 << 14)]], b[j[p:p + (1 << 14)]])
    return out


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[place < k]


def threshold(x: np.ndarray, y: np.ndarray, estimate: np.ndarray, most: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """For each anchor, a score that k rows within [least, most] are known to reach, else ``least``.

    ``estimate`` is -inf for rows that may not count.
    """
    if estimate.shape[1] < k:
        return least
    top = np.argpartition(-estimate, min(SEEDS, estimate.shape[1]) - 1, axis=1)[:, :SEEDS]
    i = np.repeat(np.arange(len(x)), top.shape[1])
    score = scored(x, y, i, top.ravel()).reshape(top.shape).astype(np.float64)
    fit = (score <= most[:, None]) & (score >= least[:, None]) & np.isfinite(np.take_along_axis(estimate, top, 1))
    score = np.sort(np.where(fit, score, -np.inf), axis=1)
    kth = score[:, -k] if score.shape[1] >= k else np.full(len(x), -np.inf)
    return np.maximum(least, kth)


def _sides(table: pa.Table) -> tuple[dict, dict]:
    """Anchors and rows of a tile as numpy columns; labels as common numbers."""
    label = np.asarray(table["label"].combine_chunks().dictionary_encode().indices)
    asks = np.asarray(table["asks"])
    out = []
    for mask in (asks, ~asks):
        part = table.filter(pa.array(mask))
        values = part["v"].combine_chunks()
        v = np.asarray(values.flatten()).astype(np.int64).reshape(len(part), -1 if len(part) else 0)
        out.append({"id": np.asarray(part["id"]), "label": label[mask], "v": v, "part": part})
    return out[0], out[1]


def _estimates(rows: dict) -> Estimates:
    part = rows["part"]
    raw = part["code"].combine_chunks()
    words = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(len(part), -1)
    return Estimates(words, np.asarray(part["norm"]), np.asarray(part["align"]))


def _rows_at_a_time(n: int) -> int:
    return max(1, CELLS // max(1, n))


def _positives(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        found = []
        if len(anchors["id"]) and len(rows["id"]):
            estimates = _estimates(rows)
            step = _rows_at_a_time(len(rows["id"]))
            for a in range(0, len(anchors["id"]), step):
                x = anchors["v"][a:a + step]
                centre, half = estimates.of(x)
                may = (anchors["label"][a:a + step, None] == rows["label"][None, :]) & (anchors["id"][a:a + step, None] != rows["id"][None, :])
                none = np.full(len(x), -np.inf)
                least = threshold(x, rows["v"], np.where(may, centre, -np.inf), -none, none, k)
                i, j = np.nonzero(may & (centre + half >= least[:, None]))
                score = scored(x, rows["v"], i, j)
                best = first_of_each(i, score, rows["id"][j], k)
                found.append((anchors["id"][a + i[best]], rows["id"][j[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(k: int, low: int, high: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        anchors, rows = _sides(table)
        found = []
        if len(anchors["id"]) and len(rows["id"]):
            estimates = _estimates(rows)
            windows = anchors["part"]["windows"].to_pylist()
            step = _rows_at_a_time(len(rows["id"]))
            for a in range(0, len(anchors["id"]), step):
                x = anchors["v"][a:a + step]
                centre, half = estimates.of(x)
                other = anchors["label"][a:a + step, None] != rows["label"][None, :]
                asked = windows[a:a + step]
                keep = np.zeros(centre.shape, bool)
                for w in range(max(map(len, asked))):
                    p = np.array([s[w] if w < len(s) else -1 for s in asked], np.float64)
                    most, least = np.where(p < 0, -np.inf, p * high / 100), p * low / 100  # beyond 2^53 rounded, hence the slack
                    slack = 1e-9 * np.abs(p) + 1e-6
                    may = other & (centre + half >= (least - slack)[:, None]) & (centre - half <= (most + slack)[:, None])
                    estimate = np.where(may, -np.abs(centre - np.maximum(most, 0)[:, None]), -np.inf)
                    reach = threshold(x, rows["v"], estimate, most - slack, least + slack, k) - slack
                    keep |= may & (centre + half >= (np.where(reach > least, reach, least) - 2 * slack)[:, None])
                i, j = np.nonzero(keep)
                score = scored(x, rows["v"], i, j)
                for w in range(max(map(len, asked))):
                    p = np.array([s[w] if w < len(s) else -1 for s in asked], np.int64)[i]
                    fit = np.flatnonzero((p >= 0) & (low * p <= 100 * score) & (100 * score <= high * p))
                    best = fit[first_of_each(i[fit], score[fit], rows["id"][j[fit]], k)]
                    found.append((anchors["id"][a + i[best]], p[best], rows["id"][j[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_score", "negative_id", "negative_score"])
    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.asarray(batch.column(2).value_lengths())
        for d in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == d))
            v = np.asarray(part.column(2).flatten()).astype(np.int64).reshape(len(part), d)
            words, norm, align = codes(v)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([w.tobytes() for w in words], pa.binary()), pa.array(norm), pa.array(align)], ["id", "label", "v", "code", "norm", "align"])


def coded_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (integers), code, norm, align of every row that takes part; one row an id."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * 256.0, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    finite = F.forall(F.col(vector_col).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("string").alias("label"), x.alias("v")).alias("r"))
    one = rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")
    return stored(one.mapInArrow(_coded, "id long, label string, v array<int>, code binary, norm double, align double"), "codes")


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], windows: Column, run, schema: str) -> DataFrame:
    """Every anchor with every row of equal ``keys``, in tiles of TILE rows by CHUNK anchors."""
    columns = ["id", "label", "v", "code", "norm", "align"]
    sized = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias(name))
    sizes = sized(rows, TILE, "tiles").join(sized(anchors, CHUNK, "chunks"), keys)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ask = anchors.join(sizes, keys).select(*[F.col(k).alias(f"k_{k}") for k in keys], every("tiles").alias("tile"), part("chunks").alias("chunk"), F.lit(True).alias("asks"), *columns, windows.alias("windows"))
    have = rows.join(sizes, keys).select(*[F.col(k).alias(f"k_{k}") for k in keys], part("tiles").alias("tile"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), *columns, F.lit(None).cast("array<long>").alias("windows"))
    by = [*[f"k_{k}" for k in keys], "tile", "chunk"]
    met = sizes.agg(F.coalesce(F.sum(F.col("tiles") * F.col("chunks")), F.lit(1))).first()[0]
    # small in bytes, long in work: a partition for each tile and chunk, not for so many bytes
    return ask.union(have).repartition(min(int(met), MOST_PARTITIONS), *by).groupBy(*by).applyInArrow(run, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the ids divisible by ``every``; a negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    rows = coded_rows(vectors, id_col, vector_col, label_col).withColumn("d", F.size("v"))
    anchors = rows.filter(F.pmod(F.col("id"), F.lit(every)) == 0)
    none = F.lit(None).cast("array<long>")
    near = _met(anchors, rows, ["d", "label"], none, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = stored(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"), "positives")
    asked = near.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("windows"))
    asking = anchors.join(asked, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    far = _met(asking, rows, ["d"], F.col("windows"), _negatives(negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
