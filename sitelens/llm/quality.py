"""Quality classifier by importance resampling (operator 9).

Two generative models over hashed n-grams (one and two tokens, ``BUCKETS`` buckets): the target model
from labelled good documents, the raw model from every document.  A document's importance weight is
the log-likelihood ratio of the two over its whole text, and Gumbel top-k draws k documents without
replacement in proportion to the weights.  k is the number of documents, of all, whose weight reaches
the level that separates the labelled good from the labelled bad ones best.

Labels are a bounded sample (``LABEL_ROWS``); the raw model, the weights, k and the draw cover all rows.

Defined cases: null and empty texts have weight 0; without good labels nothing is rejected, without
bad ones k counts weights above the lowest good one; equal keys at the cut are all kept; repeated
rows share one key and one decision; rows with a null doc_id are decided by their text alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import LOWER, U64, blocks, mix, prefix_hash, span_hash, stored, utf8

BUCKETS = 1 << 14
#: Bound of the labelled rows that the target model and the separating level are fitted on.
LABEL_ROWS = 20_000
SMOOTH = 0.5
#: A token after itself is one event, whichever token it is.
REPEATED = U64(0x5EED) << U64(20)
SEED = 9

#: Token classes of bytes: space, letters, digits, and every other byte by itself.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first doc, end doc, owner, bucket): hashed one- and two-token n-grams of each document.

    Tokens are runs of letters (case kept: shouting is a feature) or digits, and single other characters.
    """
    for i, j in blocks(offsets):
        whole_lo, whole_hi = int(offsets[i]), int(offsets[j])
        for lo in range(whole_lo, whole_hi, 1 << 22) or [whole_lo]:
            hi = min(whole_hi, lo + (1 << 22))
            x = data[lo:hi]
            kind = _CLASS[x]
            first = kind > 0
            first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
            cuts = np.clip(offsets[i:j + 1], lo, hi) - lo
            at = cuts[(cuts > 0) & (cuts < len(x))]
            first[at] = kind[at] > 0
            start = np.flatnonzero(first)
            ends = np.ones(len(x) + 1, bool)
            ends[:-1] = first | (kind == 0)
            stop = np.flatnonzero(ends)
            end = stop[np.searchsorted(stop, start, "right")]
            p = prefix_hash(x)
            h = span_hash(p, start, end)
            own = np.searchsorted(cuts, start, "right") - 1
            pair = own[1:] == own[:-1] if len(own) else np.zeros(0, bool)
            two = (np.where(h[:-1] == h[1:], REPEATED, mix(h[:-1] * U64(3) + h[1:])) if len(h) else h)[pair]
            yield i, j, np.concatenate([own, own[1:][pair]]), (np.concatenate([h, two]) >> U64(20)).astype(np.int64) % BUCKETS


def _labelled(labels: DataFrame, id_col: str) -> dict[int, int]:
    """At most LABEL_ROWS labelled ids, drawn by hash: id -> 1 good, 0 bad."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.max("quality").alias("quality"))
    n = rows.count()
    if n > LABEL_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1 << 20)) < F.lit(int((1 << 20) * 0.95 * LABEL_ROWS / n)))
    return {r[id_col]: r["quality"] for r in rows.limit(LABEL_ROWS).collect()}


def _weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    p = lambda c: np.log(c + SMOOTH) - np.log((c + SMOOTH).sum())
    return p(target) - p(raw)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Broadcast (labels of the sampled rows, log ratio of target and raw probability by bucket)."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(_labelled(labels, id_col))  # LABEL_ROWS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets, _ = utf8(batch.column(1))
            good = np.array([known.value.get(d) == 1 for d in batch.column(0).to_pylist()], bool)
            for i, j, own, bucket in ngram_buckets(data, offsets):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[i:j][own]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return known, sc.broadcast(_weights(raw, target) if target.sum() else np.zeros(BUCKETS))


def weighed(rows: DataFrame, model, id_col: str, text_col: str, weight: str = "weight", size: str = "n_grams", label: str = "label") -> DataFrame:
    """rows plus importance weight, number of n-grams and (sampled rows) label; nothing is shuffled."""
    known, ratio = model
    id_at, text_at = rows.columns.index(id_col), rows.columns.index(text_col)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField(weight, T.DoubleType()), T.StructField(size, T.LongType()), T.StructField(label, T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(text_at))
            w, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, own, bucket in ngram_buckets(data, offsets):
                w[i:j] += np.bincount(own, ratio.value[bucket], minlength=j - i)
                n[i:j] += np.bincount(own, minlength=j - i)
            y = [known.value.get(d) for d in batch.column(id_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w), pa.array(n), pa.array(y, pa.int32())], names=[f.name for f in schema])

    return rows.mapInArrow(score, schema)


def separating_level(weights: np.ndarray, good: np.ndarray) -> float:
    """The level with the least (share of good below + share of bad at or above it): the middle of the best stretch."""
    if not good.any():
        return -np.inf
    if good.all():
        return float(weights.min())
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    edge = np.flatnonzero(np.concatenate([[True], w[1:] > w[:-1]]))  # cut before each distinct weight
    lost = np.concatenate([[0], np.cumsum(g)])[edge] / g.sum() + 1 - np.concatenate([[0], np.cumsum(~g)])[edge] / (~g).sum()
    best = edge[np.flatnonzero(lost <= lost.min() + 1e-12)]
    gaps = w[best] - np.where(best > 0, w[best - 1], w[best])
    at = int(best[np.argmax(gaps)])
    return float((w[at] + w[at - 1]) / 2) if at else float(w[0])


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """Exact k-th largest of a double column, by counting in ever narrower slots (4,096 counts at a time reach the driver)."""
    if k <= 0:
        return None
    lo, hi = None, None
    while True:  # each round leaves at most 1/4096 of the range
        rows = keys if lo is None else keys.filter(F.col(column).between(lo, hi))
        if lo is None:
            lo, hi = rows.agg(F.min(column), F.max(column)).first()
        if lo is None or lo == hi:
            return lo
        step = (hi - lo) / 4096
        slot = F.least(F.lit(4095), F.floor((F.col(column) - F.lit(lo)) / F.lit(step)).cast("int"))
        parts = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("slot")).collect()
        for part in parts:
            if k <= part["n"]:
                lo, hi = part["lo"], part["hi"]
                break
            k -= part["n"]
        else:
            return lo


def gumbel_key(id_col: str, weight: str) -> Column:
    """Weight plus Gumbel noise; the same row always gets the same noise, from its id and, for a null id, the weight."""
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col).cast("long"), F.when(F.col(id_col).isNull(), F.col(weight))), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    return F.col(weight) - F.log(-F.log(uniform))


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """(model, keys of all rows, the k-th largest key or None)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels.withColumnRenamed(id_col, "doc_id"))
    keys = stored(weighed(rows, model, "doc_id", "text").drop("text").withColumn("key", gumbel_key("doc_id", "weight")), "quality")
    fitted = keys.filter(F.col("label").isNotNull()).select("weight", "label").limit(2 * LABEL_ROWS).toArrow()
    level = separating_level(fitted["weight"].to_numpy(), fitted["label"].to_numpy() == 1)
    return model, keys, kth_largest(keys, "key", keys.filter(F.col("weight") >= F.lit(level)).count())


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weight, n_grams, key, kept: Gumbel top-k draw over all rows by importance weight."""
    _, keys, cut = _drawn(docs, labels, id_col, text_col)
    kept = F.lit(False) if cut is None else F.col("key") >= F.lit(cut)
    return keys.select("doc_id", "weight", "n_grams", "key", kept.alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents, with their own columns."""
    model, _, cut = _drawn(docs, labels, id_col, text_col)
    if cut is None:
        return docs.limit(0)
    tag = uuid.uuid4().hex
    rows = weighed(docs, model, id_col, text_col, f"weight_{tag}", f"size_{tag}", f"label_{tag}")
    return rows.filter(gumbel_key(id_col, f"weight_{tag}") >= F.lit(cut)).select(*docs.columns)
