"""Shared helpers of the training-data operators.

Texts are handled as UTF-8 bytes inside Arrow batches: ``utf8`` gives the data and offset
buffers of a string column without copying, and everything below works on those with numpy.
Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import configure, ensure_checkpoint_dir

U64 = np.uint64
#: Rows of one Arrow batch: bounds what a Python worker holds at a time.
BATCH_ROWS = 1000
#: Bytes that numpy temporaries are made for at a time.
BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value for each byte (polynomial hash), fixed by the seed.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Multipliers that join word hashes to shingle hashes, by position and by number of words.
WORD_MUL = _rng.integers(1, 1 << 63, (SHINGLE_WORDS + 1, SHINGLE_WORDS), dtype=np.uint64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def setup(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the cluster's shared checkpoint folder and read it again.

    Cuts the lineage: a lost executor makes later stages read the files, not redo the work.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sitelens-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid = np.ones(n, bool) if column.null_count == 0 else ~np.asarray(column.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset:].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0], valid


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_POW = {"n": 0, "pow": np.zeros(0, U64), "inv": np.zeros(0, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    if _POW["n"] < n:
        m = max(n, BLOCK_BYTES + 64)
        for key, base in (("pow", _BASE), ("inv", _BASE_INV)):
            a = np.full(m, base, U64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=U64)
        _POW["n"] = m
    return _POW["pow"], _POW["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits over the output (in place for fresh arrays)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[i] = sum over j < i of code(data[j]) * base**j: any substring hashes in O(1)."""
    pw, _ = powers(len(data) + 1)
    p = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * pw[:len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) from their prefix hashes."""
    _, inv = powers(len(p))
    return mix((p[end] - p[start]) * inv[start])


def _runs(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-separators; no run goes over a position in ``cuts``."""
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _word_pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in pieces that end at separators (or, in one giant word, anywhere beyond)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data):
            seps = np.flatnonzero(SEPARATOR[data[end:end + BLOCK_BYTES]])
            if len(seps):
                end += int(seps[0])
                break
            end = min(len(data), end + BLOCK_BYTES)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first doc, end doc, word hashes, bounds): words of doc d are [bounds[d-first], bounds[d-first+1])."""
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo > 2 * BLOCK_BYTES:  # one long document: hash it piece by piece
            parts = []
            for a, b in _word_pieces(data[lo:hi]):
                x = LOWER[data[lo + a:lo + b]]
                s, e = _runs(x, np.zeros(0, np.int64))
                parts.append(span_hash(prefix_hash(x), s, e))
            h = np.concatenate(parts)
            yield i, j, h, np.array([0, len(h)])
            continue
        x = LOWER[data[lo:hi]]
        cuts = offsets[i:j + 1] - lo
        s, e = _runs(x, cuts)
        yield i, j, span_hash(prefix_hash(x), s, e), np.searchsorted(s, cuts)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document index, sorted distinct shingle hashes); fewer words than a shingle: the whole sequence is one."""
    k = SHINGLE_WORDS
    for i, j, h, bounds in word_hashes(data, offsets):
        joined = np.zeros(max(0, len(h) - k + 1), U64)
        for q in range(k):
            joined += h[q:len(h) - k + 1 + q] * WORD_MUL[k, q] if len(joined) else joined
        joined = mix(joined)
        for d in range(j - i):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a >= k:
                yield i + d, np.unique(joined[a:b - k + 1])
            elif b > a:
                yield i + d, mix((h[a:b] * WORD_MUL[b - a, :b - a]).sum(dtype=U64, keepdims=True))
            else:
                yield i + d, joined[:0]


#: Bits of a Bloom filter: 8 MB, whatever the input.
BLOOM_BITS = 26
BLOOM_HASHES = 3


def bloom_places(id_col: str) -> list[Column]:
    return [F.pmod(F.xxhash64(id_col, F.lit(q)), F.lit(1 << BLOOM_BITS)).alias(f"bloom{q}") for q in range(BLOOM_HASHES)]


def bloom(ids: DataFrame, id_col: str) -> np.ndarray:
    """Fixed-size Bloom filter of ids as 64-bit words: spares a shuffle the rows that are surely not asked for.

    It saturates (and spares less) beyond some millions of ids; the join behind it stays exact.
    """
    place = F.explode(F.array(*bloom_places(id_col)))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def bloom_hits(words: np.ndarray, places: list[pa.Array]) -> np.ndarray:
    """Rows whose places (the columns of ``bloom_places``) are all set."""
    hit = np.ones(len(places[0]), bool)
    for column in places:
        p = np.asarray(column).astype(np.int64)
        hit &= (words[p >> 6].view(U64) >> (p & 63).astype(U64)) & U64(1) == 1
    return hit
