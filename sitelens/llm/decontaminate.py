"""Benchmark decontamination (operator 5): short test items inside long documents.

Containment of an item of n distinct shingles is (shared shingles) / n.  A document with containment of
at least ``THRESHOLD`` holds one of any n - ceil(THRESHOLD * n) + 1 of the item's shingles, so a bottom-k MinHash
sketch of that many smallest hashes per item finds every such document, however long: an exact prefix
filter, in place of banded signatures, which miss an item whose share of a long document is small.  Documents are
probed with all their shingles; candidates are verified by exact containment of shingle sets.

Items of equal sets are one, and sets lie in size partitions by powers of two.  Partitions go out in blocks
of half ``BLOCK_SHINGLES`` shingles at most on average (measured first), each a query set for all documents with
enough shingles for its smallest item; blocks of ``BLOCK_SHINGLES`` together share a pass over the documents, so the work of a task is bounded whatever the size of the benchmark.

Defined cases: null and empty texts contain nothing and are contained in nothing; an item or document of
fewer than five words is one shingle, its whole sequence; repeated rows give repeated results; a null
item_id is reported as null; an item larger than a block has a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import U64, shingle_sets, stored, utf8

THRESHOLD = 0.8
BLOCK_SHINGLES = 1_000_000
FILTER_BITS = 22
FOUND = T.ArrayType(T.StructType([T.StructField("set_id", T.LongType()), T.StructField("item_shingles", T.LongType()), T.StructField("shared", T.LongType())]))


def needed(n: np.ndarray | int, threshold: float = THRESHOLD) -> np.ndarray:
    """Least number of shared shingles that reaches the threshold."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = utf8(batch.column(1))
        sets = [s for _, s in shingle_sets(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["item_id", "shingles"])


class ItemBlock:
    """Sketches and shingle sets of one block of items."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float):
        self.ids, self.sets = ids, sets
        self.need = needed([len(s) for s in sets], threshold)
        self.least = int(self.need.min()) if sets else 0
        length = np.array([len(s) for s in sets], np.int64) - self.need + 1
        sketch = np.concatenate([s[:k] for s, k in zip(sets, length)]) if sets else np.zeros(0, U64)  # sets are sorted by hash
        owner = np.repeat(np.arange(len(sets)), length)
        order = np.argsort(sketch, kind="stable")
        self.sketch, self.owner = sketch[order], owner[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.sketch & U64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def found_in(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items contained in a document."""
        if len(shingles) < self.least:  # the document can hold no item of this size
            return []
        hit = shingles[self.filter[(shingles & U64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
        if not len(hit):
            return []
        lo, hi = np.searchsorted(self.sketch, hit, "left"), np.searchsorted(self.sketch, hit, "right")
        items = sorted({int(x) for a, b in zip(lo, hi) for x in self.owner[a:b]})
        out = []
        for x in items:
            shared = len(np.intersect1d(self.sets[x], shingles, assume_unique=True))
            if shared >= self.need[x]:
                out.append((x, shared))
        return out


def item_sets(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, set_id) of every item that has words, and (set_id, shingles, part) of their distinct sets with the size partition."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_batches, "item_id long, shingles array<long>")
    rows = stored(rows.filter(F.size("shingles") > 0).withColumn("set_id", F.xxhash64("shingles")), "benchmark-items")
    sets = rows.select("set_id", "shingles", F.floor(F.log2(F.size("shingles"))).alias("part")).dropDuplicates(["set_id"])
    return rows.select("item_id", "set_id"), stored(sets, "benchmark-sets")


def contained(docs: DataFrame, sets: DataFrame, column: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs plus ``column``: array of (set_id, item_shingles, shared) of the item sets each document contains."""
    sc = docs.sparkSession.sparkContext
    parts = sets.groupBy("part").agg(F.sum(F.size("shingles")).alias("n")).orderBy("part").collect()  # a row for each power of two
    passes, room = [[]], BLOCK_SHINGLES
    for part in parts:
        n_blocks = -(-part["n"] // max(1, BLOCK_SHINGLES // 2))
        for b in range(n_blocks):
            if part["n"] // n_blocks > room:
                passes.append([])
                room = BLOCK_SHINGLES
            room -= part["n"] // n_blocks
            rows = sets.filter((F.col("part") == part["part"]) & (F.pmod("set_id", F.lit(n_blocks)) == b)).orderBy("set_id").collect()
            passes[-1].append(sc.broadcast(ItemBlock([r["set_id"] for r in rows], [np.array(r["shingles"], np.int64).view(U64) for r in rows], threshold)))
    out = docs.withColumn(column, F.lit(None).cast(FOUND))
    for blocks in passes:  # small partitions share one
        out = out.mapInArrow(_search(blocks, out.columns.index(text_col), out.columns.index(column)), out.schema)
    return out.withColumn(column, F.coalesce(F.col(column), F.array().cast(FOUND)))


def _search(blocks: list, text_at: int, column_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [block.value for block in blocks]
        for batch in batches:
            data, offsets, _ = utf8(batch.column(text_at))
            found = batch.column(column_at).to_pylist()
            for d, shingles in shingle_sets(data, offsets):
                for x in held:
                    if got := x.found_in(shingles):
                        found[d] = (found[d] or []) + [{"set_id": x.ids[k], "item_shingles": len(x.sets[k]), "shared": n} for k, n in got]
            columns = list(batch.columns)
            columns[column_at] = pa.array(found, batch.schema.field(column_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, contained item): doc_id, item_id, item_shingles, shared."""
    members, sets = item_sets(items)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = contained(rows, sets, "found").select("doc_id", F.inline("found"))
    return found.join(members, "set_id").select("doc_id", "item_id", "item_shingles", "shared")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with their own columns."""
    column = f"found_{uuid.uuid4().hex}"
    return contained(docs, item_sets(items)[1], column, text_col).filter(F.size(column) == 0).drop(column)
