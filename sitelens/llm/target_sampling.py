"""Importance resampling towards the distribution of target texts (operator 13).

An untrained ``tokenizers`` splitter with one regex pre-tokenises the ASCII-lowered text into words with
offsets.  Windows over the offsets (a run's first start, its last end) feed CRC-32 registers: the register
of a run of n words goes on from that of its first n - 1, so every byte is read once for each run length.
CRC modulo ``BUCKETS`` gives each feature's bucket; buckets of a document are stored once, histograms of
corpus and target texts are summed by tasks and then by Spark, a bucket's gain is its floored log ratio in
thousandths, a document's weight the sum of its features' gains.  Gumbel noise from a hash of the id makes
the highest scores a draw without replacement in proportion to exp(weight / 1000); ranks come from one
range-partitioned sort and the row counts of its partitions.

Defined cases: null and empty texts and texts without words have no features, weight 0 and no rank; they
still have a score; repeated rows are rows of their own (equal ids draw equal noise); a null id counts as the
empty string in the noise and comes last among ties; equal scores go to the smaller id; empty target texts
give gains by the corpus alone; an empty table gives an empty result; extra columns, whatever their names,
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from sitelens.llm.common import BLOCK_BYTES, blocks, stored, utf8

BUCKETS = 10_000
#: Words of the longest feature.
RUN = 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longer words go through the library's CRC one by one.
STEPS = 64

_word_byte = np.ones(256, bool)
_word_byte[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
ONES = np.uint32(0xFFFFFFFF)


def _fed(register: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(register ^ byte) & 0xFF] ^ (register >> 8)


def word_spans(splitter: Split, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of lowered texts, by the splitter; long texts in pieces that end between words."""
    starts, ends = [], []
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and _word_byte[data[end]]:
            gaps = np.flatnonzero(~_word_byte[data[end:end + BLOCK_BYTES]])
            end = end + int(gaps[0]) if len(gaps) else min(len(data), end + BLOCK_BYTES)
        piece = data[at:end]
        words = splitter.pre_tokenize_str(piece.tobytes().decode())
        spans = np.fromiter(chain.from_iterable(span for _, span in words), np.int64, 2 * len(words)).reshape(-1, 2)
        if (piece >= 0x80).any():  # offsets count code points
            spans = np.append(np.flatnonzero((piece & 0xC0) != 0x80), len(piece))[spans]
        starts.append(spans[:, 0] + at)
        ends.append(spans[:, 1] + at)
        at = end
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(ends or none)


def run_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For n = 1 .. RUN: the bucket of the run of n words that ends with each word (-1: it would leave its text).

    The words of text d are bounds[d] to bounds[d + 1].
    """
    size = ends - starts
    order = np.argsort(-np.minimum(size, STEPS + 1), kind="stable")
    order = order[np.searchsorted(-size[order], -STEPS, side="left"):] if len(order) else order
    live = [int(np.searchsorted(-size[order], -step, side="left")) for step in range(int(size[order].max()) if len(order) else 0)]
    long = np.flatnonzero(size > STEPS)
    place = np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds))  # of a word in its text
    register = np.full(len(starts), ONES, np.uint32)
    out = []
    for n in range(1, RUN + 1):
        if n > 1:  # go on from the run that ends one word earlier, over a blank
            register[1:] = _fed(register[:-1], np.uint32(0x20))
        r, at = register[order], starts[order]
        for step, m in enumerate(live):
            r[:m] = _fed(r[:m], data[at[:m] + step])
        register[order] = r
        for w in long.tolist():
            register[w] = zlib.crc32(data[starts[w]:ends[w]], int(register[w] ^ ONES)) ^ 0xFFFFFFFF
        out.append(np.where(place >= n - 1, (register ^ ONES).astype(np.int64) % BUCKETS, -1))
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter = Split(Regex(WORD), "removed", invert=True)
    for batch in batches:
        data, offsets, _ = utf8(batch.column(1))
        for i, j in blocks(offsets):
            lowered = np.frombuffer(data[offsets[i]:offsets[j]].tobytes().lower(), np.uint8)
            cuts = offsets[i:j + 1] - offsets[i]
            spans = [word_spans(splitter, lowered[a:b]) for a, b in zip(cuts, cuts[1:])]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s, _ in spans])]).astype(np.int64)
            starts = np.concatenate([s + a for (s, _), a in zip(spans, cuts)])
            ends = np.concatenate([e + a for (_, e), a in zip(spans, cuts)])
            runs = np.stack(run_buckets(lowered, starts, ends, bounds), 1)
            held = runs >= 0
            at = np.concatenate([[0], np.cumsum(held.sum(1))])[bounds]
            buckets = runs[held].astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(buckets))], ["id", "n_words", "buckets"])


def features(docs: DataFrame, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """id, n_words, buckets (of every feature, repeats included) of each row."""
    key = F.col(id_col) if id_col else F.lit(None).cast("long")
    rows = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_featured, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, buckets array<short>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])


def histogram(featured: DataFrame) -> np.ndarray:
    """Features in each bucket, summed in tasks, then over tasks; ``BUCKETS`` numbers reach the driver."""
    rows = featured.select("buckets").mapInArrow(_summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target share to corpus share) of each bucket."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def _weighed(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.concatenate([[0], np.cumsum(gain.value[np.asarray(lists.flatten())])])
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(np.diff(ends[at]))], ["id", "n_words", "n_features", "weight"])
    return run


def noise(id_col: str, seed: int):
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """``rows`` with rank 1, 2, 3... of the first share percent by score (ties: smaller id), null for the others.

    One range-partitioned sort; a row's place is its place in its partition and the rows of earlier partitions.
    """
    order = [F.desc("score"), F.asc_nulls_last("id")]
    placed = stored(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    most = placed.count() * share // 100
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sort
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(before, "part")
    return out.select(*rows.columns, F.when(rank <= most, rank).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``id_col``, n_features, weight, score, rank, n_words of every row of ``docs``.

    The ``share`` percent of highest scores among rows of ``min_words`` words have a rank.
    """
    featured = stored(features(docs, id_col, text_col), "features")
    gain = docs.sparkSession.sparkContext.broadcast(gains(histogram(featured), histogram(features(target, None, target_col))))
    kind = featured.schema["id"].dataType.simpleString()
    weighed = featured.mapInArrow(_weighed(gain), f"id {kind}, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    out = ranked(scored.filter(F.col("n_words") >= min_words), share)
    out = out.union(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose ids were drawn, with all their columns."""
    drawn = resample(docs, target, id_col, **how).filter(F.col("rank").isNotNull()).select(F.col(id_col).alias("drawn_id")).distinct()
    return docs.join(drawn, docs[id_col].eqNullSafe(drawn["drawn_id"]), "left_semi")
