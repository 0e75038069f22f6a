"""Line dedup (operator 7): content-defined chunks of lines, global repeats removed whole.

``dedup_runs`` is the operator, of the query and of the pipeline.  Lines are hashed; a rolling hash over the
hashes of ``RUN_WINDOW`` non-blank lines sets a boundary where it is 0 modulo ``RUN_DIVISOR``, so boundaries
depend on nearby lines alone and move with inserted or removed lines.  A chunk reaches from one boundary line to the
next, both included (and the blank lines between them), so neighbouring chunks overlap and all hold two
non-blank lines at least.  A chunk that stands more than once in the corpus is kept at its first place
(smallest doc_id, then position) and its lines are removed at all others, once all its copies are equal byte
by byte (chunks whose hashes collide are left alone).  With a divisor of 1, the default, every non-blank
line is a boundary and the chunks of a common run cover it: every run of two or more non-blank lines that two
places share goes whole, whatever its surroundings.  Larger divisors make fewer, longer chunks and miss short
runs.  Each removed line stands in an earlier place of its chunk; in one document a chunk that overlaps its
first place is no repeat.

``dedup_lines`` is a coarser form without overlaps: a rolling hash over ``WINDOW`` lines ends a chunk with one line of
``DIVISOR``, and chunks of at least two non-blank lines that stand more than once go.

Defined cases: a null text stays null; empty texts and texts of one line have no pair or multi-line chunk;
rows with the same id and text are one document and share one decision; null ids come first; a document of
nothing but repeats becomes the empty string; a shared line without a shared neighbour is never removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES, SEPARATOR, U64, blocks, mix, prefix_hash, span_hash, utf8

RUN_WINDOW, RUN_DIVISOR = 1, 1
WINDOW, DIVISOR = 2, 4


def document_lines(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first doc, end doc, owner, start, end, hash) of lines; starts are positions in ``data``."""
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        x = data[lo:hi]
        breaks = np.flatnonzero(x == 10) + lo
        full = np.flatnonzero(np.diff(offsets[i:j + 1]) > 0)
        # at equal positions a line of the earlier document comes first (stable sorts)
        start = np.sort(np.concatenate([breaks + 1, offsets[i:j][full]]), kind="stable")
        end = np.sort(np.concatenate([offsets[i + 1:j + 1][full], breaks]), kind="stable")
        holder = np.searchsorted(offsets[i:j + 1], breaks, "right") - 1
        own = np.repeat(full, np.bincount(holder, minlength=j - i)[full] + 1)
        if hi - lo > 4 * BLOCK_BYTES:  # one long document: hash its lines in pieces
            h = np.array([_long_hash(x[a - lo:b - lo]) for a, b in zip(start.tolist(), end.tolist())], U64)
        else:
            h = span_hash(prefix_hash(x), start - lo, end - lo)
        yield i, j, own, start, end, h


def _long_hash(line: np.ndarray) -> np.uint64:
    h = np.zeros(1, U64)
    for a in range(0, max(1, len(line)), BLOCK_BYTES):
        part = line[a:a + BLOCK_BYTES]
        part_hash = span_hash(prefix_hash(part), np.array([0]), np.array([len(part)]))
        h = part_hash if a == 0 else mix(h * U64(3) + part_hash)
    return h[0]


def document_chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, number in the document, start, end, hash, non-blank lines) of all chunks of a block; owner is a row."""
    for i, j, own, start, end, h in document_lines(data, offsets):
        if not len(own):
            continue
        head = np.concatenate([[True], own[1:] != own[:-1]])
        rolling = h.copy()
        for back in range(1, WINDOW):
            before = np.concatenate([np.zeros(back, U64), h[:-back]])
            same = np.concatenate([np.zeros(back, bool), own[back:] == own[:-back]])
            rolling += np.where(same, before, U64(0)) * U64(2 * back + 0x9E3779B97F4A7C14 | 1)
        ends = mix(rolling) % U64(DIVISOR) == 0
        ends[:-1] |= head[1:]
        ends[-1] = True
        last = np.flatnonzero(ends)
        first = np.concatenate([[0], last[:-1] + 1])
        cumulated = np.concatenate([[0], np.cumsum(~SEPARATOR[data[offsets[i]:offsets[j]]], dtype=np.int64)])
        filled = (cumulated[end - offsets[i]] - cumulated[start - offsets[i]]) > 0
        n_filled = np.add.reduceat(filled.astype(np.int64), first)
        place = np.arange(len(h)) - first[np.searchsorted(first, np.arange(len(h)), "right") - 1]
        joined = mix(np.add.reduceat(h * mix(place.astype(U64) + U64(1)), first) + (last - first).astype(U64))
        chunk_own = own[first]
        begins = np.concatenate([[True], chunk_own[1:] != chunk_own[:-1]])
        number = np.arange(len(first)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        yield chunk_own + i, number, start[first], end[last], joined, n_filled


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = utf8(batch.column(2))
        for own, number, start, end, h, filled in document_chunks(data, offsets):
            keep = np.flatnonzero(filled >= 2)
            whole = data[start[0]:end[-1]].tobytes()
            text = [whole[a:b].decode() for a, b in zip((start[keep] - start[0]).tolist(), (end[keep] - start[0]).tolist())]
            rows = pa.array(own[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[keep].astype(np.int32)), pa.array(h[keep].view(np.int64)), pa.array(text, pa.string())], ["k1", "k2", "number", "h", "chunk"])


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's identity: its id and a hash that tells apart texts (and null) under one id."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(F.col(id_col).isNull(), F.col(text_col))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, removed): by document, the numbers of its chunks that stand first elsewhere."""
    k1, k2 = _key(id_col, text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    chunks = keyed.select("k1", "k2", "text").mapInArrow(_chunk_batches, "k1 string, k2 long, number int, h long, chunk string")
    place = F.struct(F.col("k1").try_cast("long").alias("id"), F.col("k2"), F.col("number"))
    known = (chunks.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("chunk").alias("low"), F.max("chunk").alias("high"))
             .filter((F.col("first") != F.col("last")) & (F.col("low") == F.col("high"))).select("h", "first"))
    others = chunks.drop("chunk").join(known, "h").filter(place != F.col("first"))
    return others.groupBy("k1", "k2").agg(F.array_distinct(F.collect_list("number")).alias("removed"))


def _rebuild(text_at: int, removed_at: int, count_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(text_at))
            out = batch.column(text_at).to_pylist()
            removed = [set(r) if r else None for r in batch.column(removed_at).to_pylist()]
            lost = np.zeros(batch.num_rows, np.int64)
            if any(removed):
                rows = [d for d, r in enumerate(removed) if r]
                part = batch.column(text_at).take(pa.array(rows))
                data, offsets, _ = utf8(part)
                for own, number, start, end, _, _ in document_chunks(data, offsets):
                    kept: dict[int, list[bytes]] = {}
                    for o, k, a, b in zip(own.tolist(), number.tolist(), start.tolist(), end.tolist()):
                        pieces = kept.setdefault(o, [])
                        piece = data[a:b].tobytes()
                        if k in removed[rows[o]]:
                            lost[rows[o]] += piece.count(b"\n") + 1
                        else:
                            pieces.append(piece)
                    for o, pieces in kept.items():
                        out[rows[o]] = b"\n".join(pieces).decode()
            columns = list(batch.columns)
            columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
            if count_at is not None:
                columns[count_at] = pa.array(lost)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: str | None = "n_removed_lines") -> DataFrame:
    """docs with shortened texts; ``count`` (or None) names an added column of lines removed."""
    return _shortened(docs, repeated_chunks(docs, id_col, text_col), _rebuild, id_col, text_col, count)


def _shortened(docs: DataFrame, gone: DataFrame, cut, id_col: str, text_col: str, count: str | None) -> DataFrame:
    tag = uuid.uuid4().hex
    k1, k2 = _key(id_col, text_col)
    gone = gone.withColumnsRenamed({"k1": f"k1_{tag}", "k2": f"k2_{tag}", "removed": f"removed_{tag}"})
    rows = docs.withColumns({f"k1_{tag}": k1, f"k2_{tag}": k2}).join(gone, [f"k1_{tag}", f"k2_{tag}"], "left")
    own = [*docs.columns, f"removed_{tag}", *([count] if count else [])]
    if count:
        rows = rows.withColumn(count, F.lit(0).cast("long"))
    rows = rows.select(*own)
    at = [own.index(text_col), own.index(f"removed_{tag}"), own.index(count) if count else None]
    return rows.mapInArrow(cut(*at), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])).drop(f"removed_{tag}")


def document_pairs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, first line, last line, start, end, hash) of all chunks of a block, from a boundary line to the next; lines are
    numbered in their document."""
    for i, j, own, start, end, h in document_lines(data, offsets):
        if not len(own):
            continue
        lo = offsets[i]
        cumulated = np.concatenate([[0], np.cumsum(~SEPARATOR[data[lo:offsets[j]]], dtype=np.int64)])
        filled = np.flatnonzero(cumulated[end - lo] > cumulated[start - lo])
        rolling = h[filled]
        for back in range(1, RUN_WINDOW):
            same = np.concatenate([np.zeros(back, bool), own[filled[back:]] == own[filled[:-back]]])
            rolling = rolling + np.where(same, np.roll(h[filled], back), U64(0)) * U64(2 * back + 0x9E3779B97F4A7C14 | 1)
        filled = filled[mix(rolling) % U64(RUN_DIVISOR) == 0]
        if len(filled) < 2:
            continue
        begins = np.concatenate([[True], own[1:] != own[:-1]])
        number = np.arange(len(own)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        place = np.arange(len(own)) - filled[np.maximum(np.searchsorted(filled, np.arange(len(own)), "right") - 1, 0)]
        opening = np.add.reduceat(h * mix(place.astype(U64) + U64(1)), filled)  # a line and the blank ones after it
        a, b = filled[:-1], filled[1:]
        joined = mix(opening[:-1] + h[b] * U64(0x9E3779B97F4A7C15) + (b - a).astype(U64))
        same = own[a] == own[b]
        a, b = a[same], b[same]
        yield own[a] + i, number[a], number[b], start[a], end[b], joined[same]


def _bits(h: np.ndarray) -> list[np.ndarray]:
    """Places of hashes in a Bloom filter."""
    return [(mix(h + U64(q)) >> U64(64 - BLOOM_BITS)).astype(np.int64) for q in range(BLOOM_HASHES)]


def _pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = utf8(batch.column(0))
        for *_, h in document_pairs(data, offsets):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def _hash_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_bits(np.asarray(batch.column(0)).view(U64))))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["w", "bit"])


def _pair_batches(words, with_text: bool):
    """Pairs whose hash may stand twice: their documents and lines, their hash and on demand their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            data, offsets, _ = utf8(batch.column(2))
            for own, first, last, start, end, h in document_pairs(data, offsets):
                hit = np.ones(len(h), bool)
                for at in _bits(h):
                    hit &= (known[at >> 6].view(U64) >> (at & 63).astype(U64)) & U64(1) == 1
                keep = np.flatnonzero(hit)
                if not len(keep):
                    continue
                rows = pa.array(own[keep])
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first[keep].astype(np.int32)), pa.array(last[keep].astype(np.int32)), pa.array(h[keep].view(np.int64))]
                if with_text:
                    columns.append(pa.array([data[a:b].tobytes() for a, b in zip(start[keep].tolist(), end[keep].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "number", "until", "h", "pair"][:len(columns)])
    return run


def repeated_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, removed): by document, the (first, last) lines of its pairs that stand first elsewhere."""
    k1, k2 = _key(id_col, text_col)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    twice = docs.select(F.col(text_col).alias("text")).mapInArrow(_pair_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    found = twice.mapInArrow(_hash_bits, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bits[found["w"].to_numpy()] = found["bits"].to_numpy()
    words = docs.sparkSession.sparkContext.broadcast(bits)
    kind = "k1 string, k2 long, number int, until int, h long"
    pairs = keyed.mapInArrow(_pair_batches(words, True), f"{kind}, pair binary")
    place = F.struct(F.col("k1").try_cast("long").alias("id"), F.col("k2"), F.col("number"), F.col("until"))
    known = (pairs.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("pair").alias("low"), F.max("pair").alias("high"))
             .filter((F.col("first") != F.col("last")) & (F.col("low") == F.col("high"))).select("h", "first"))
    same = place["id"].eqNullSafe(F.col("first.id")) & (F.col("k2") == F.col("first.k2"))
    others = keyed.mapInArrow(_pair_batches(words, False), kind).join(known, "h").filter(~(same & (F.col("number") <= F.col("first.until"))))
    return others.groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "until")).alias("removed"))


def _cut(text_at: int, removed_at: int, count_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(removed_at)
            rows = np.flatnonzero(np.asarray(spans.is_valid()))
            columns = list(batch.columns)
            lost = np.zeros(batch.num_rows, np.int64)
            if len(rows):
                out = batch.column(text_at).to_pylist()
                removed = spans.take(pa.array(rows)).to_pylist()
                data, offsets, _ = utf8(batch.column(text_at).take(pa.array(rows)))
                for i, j, own, start, end, _ in document_lines(data, offsets):
                    bounds = np.searchsorted(own, np.arange(j - i + 1))
                    for d in range(j - i):
                        a, b = int(bounds[d]), int(bounds[d + 1])
                        gone = np.zeros(b - a, bool)
                        for span in removed[i + d]:
                            gone[span["number"]:span["until"] + 1] = True
                        stays = np.flatnonzero(~gone) + a
                        out[rows[i + d]] = b"\n".join(data[s:e].tobytes() for s, e in zip(start[stays].tolist(), end[stays].tolist())).decode()
                        lost[rows[i + d]] = gone.sum()
                columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
            if count_at is not None:
                columns[count_at] = pa.array(lost)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return run


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: str | None = "n_removed_lines") -> DataFrame:
    """docs without repeated runs of two or more lines; ``count`` (or None) names an added column of lines removed."""
    return _shortened(docs, repeated_pairs(docs, id_col, text_col), _cut, id_col, text_col, count)
