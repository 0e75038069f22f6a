"""N-gram Jaccard join by PartEnum signatures (operator 1).

A document is its set of distinct five-word shingles; two link when 100 * |A and B| >= 80 * |A or B|,
which bounds their Hamming distance by (|A| + |B|) / 9.  Sets are dealt to size bands; the instance of a
band handles the pairs whose larger set lies in it, with Hamming bound k.  PartEnum splits the feature
domain into n1 parts of n2 cells and signs every subset of n2 - k2 cells of a part: k differences cannot
spoil all signatures, so linked sets share one.  Signatures of empty subsets are left out; a set whose
remaining signatures could all be spoiled also signs at twice as many parts, and so on, until it could not.

Documents with equal sets are one class.  Buckets (classes with one signature) of up to ``SMALL`` classes
give all their pairs.  In larger ones each class first meets a leader.  Of the candidates, each class first has the pair with the
class that most others are paired with; links verified so far join classes to components, and of the other
candidates those between components are verified.  A class needs its larger buckets only as far as its small ones could be spoiled:
for such classes, whatever members of those buckets are not yet in its component are compared too.  So
no link between components is missed and groups of copies do not expand into all their pairs.
Candidates that sizes and sketches (a lower bound of the distance) leave are verified on the exact sets.

Defined cases: null and empty texts, and texts of separators only, have the empty set and link with nothing;
fewer than five words are one shingle; repeated rows and equal texts are linked; a null doc_id is never
a component's smallest id (a component of null ids has a null id); texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import U64, bloom, bloom_hits, bloom_places, mix, shingle_sets, stored, utf8
from sitelens.llm.graph import components

#: Similarity as a fraction, NUM / DEN.
NUM, DEN = 80, 100
BAND_RATIO = 1.4
#: Sets up to this size sign pairs of three cells (k2 = 1), larger ones single parts (k2 = 0).
ENUMERATE_TO = 64
#: Classes of a bucket that are compared in all pairs.
SMALL = 40
#: Signatures that a map task sorts and sends at a time, and that one reduce part should hold.
FLUSH, PART = 600_000, 1_500_000
#: Ranges of the domain that a sketch counts.
CELL_BITS = 8
CELLS = 1 << CELL_BITS
#: Askers, and members, of a large bucket that meet in one task.
TILE = 512
#: Parts that members of large buckets, once known as such, are spread over.
SPREAD = 1024
#: Stands for a null id where rows are looked up by id.
NO_ID = -(1 << 63)
EMPTY = 0


def _bands(largest: int = 1 << 40) -> np.ndarray:
    low = [1]
    while low[-1] <= largest:
        low.append(int(low[-1] * BAND_RATIO) + 1)
    return np.array(low, np.int64)


BAND = _bands()
#: Largest Hamming distance of linked sets up to the end of each band: d <= (1 - j) / (1 + j) * (|A| + |B|).
BOUND = (DEN - NUM) * 2 * (BAND[1:] - 1) // (DEN + NUM)


def scheme(k: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n1, enumerated) of an instance: parts with some to spare, so that few sets need a second level."""
    pairs = largest <= ENUMERATE_TO
    return np.where(pairs, np.ceil(0.6 * (k + 1)) + 1, np.ceil(1.25 * (k + 1)) + 1).astype(np.int64), pairs


def spoiled(k: np.ndarray, n1: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Most signatures that k differences can change: of three pairs of cells the first hits two, the second the last."""
    return np.where(pairs, 2 * np.minimum(k, n1) + np.clip(k - n1, 0, n1), k)


def signatures(x: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(set, signature, settled, spare, instance) of concatenated sorted sets; sets are numbered as in ``sizes``.

    ``settled``: the set needs no further level; ``spare``: how many of its signatures here it can do without.
    """
    band = np.searchsorted(BAND, sizes, "right") - 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    value = mix(x)
    for up in (0, 1):
        inst = band + up
        least = -(-BAND[inst] * NUM // DEN)  # smallest set that can link with one of this band
        act = np.flatnonzero((sizes > 0) & (sizes >= least))
        for level in range(33):
            if not len(act):
                break
            k = BOUND[inst[act]]
            n1, pairs = scheme(k, BAND[inst[act] + 1] - 1)
            n1 = n1 << level
            cells = np.where(pairs, 3 * n1, n1)
            base = np.concatenate([[0], np.cumsum(cells)])
            n = sizes[act]
            at = np.repeat(bounds[act] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            own = np.repeat(np.arange(len(act)), n)
            cell = base[own] + (((x[at] >> U64(32)) * cells[own].astype(U64)) >> U64(32)).astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total = np.zeros(base[-1], U64)
            total[cell[head]] = np.add.reduceat(value[at], head)
            filled = np.zeros(base[-1], bool)
            filled[cell[head]] = True
            key = mix(np.arange(base[-1]).astype(U64) - np.repeat(base[:-1], cells).astype(U64) + np.repeat(((inst[act] << 6) + level), cells).astype(U64) * U64(0x9E3779B97F4A7C15))
            of, signs = [], []
            plain = np.repeat(~pairs, cells)
            use = plain & filled
            cell_own = np.repeat(np.arange(len(act)), cells)
            of.append(cell_own[use])
            signs.append(mix(total[use] + key[use]))
            if pairs.any():
                t, f, o, q = (v[~plain].reshape(-1, 3) for v in (total, filled, cell_own, key))
                for i, j in ((0, 1), (0, 2), (1, 2)):
                    some = f[:, i] | f[:, j]
                    of.append(o[some, 0])
                    signs.append(mix(mix(t[some, i] + q[some, i]) + t[some, j] + q[some, j]))
            of, signs = np.concatenate(of), np.concatenate(signs)
            largest = np.minimum(BAND[inst[act] + 1] - 1, n * DEN // NUM)  # of the sets that this one can link with here
            own_bound = (DEN - NUM) * (n + largest) // (DEN + NUM)
            spare = np.bincount(of, minlength=len(act)) - spoiled(own_bound, n1, pairs) - 1
            yield act[of], signs, (spare >= 0)[of], spare[of], np.repeat(0, len(of)) + up
            act = act[spare < 0]


def class_hash(s: np.ndarray) -> int:
    """Identity of a shingle set (64 bits); EMPTY for the empty set."""
    if not len(s):
        return EMPTY
    h = mix(np.array([mix(s + U64(1)).sum(dtype=U64) + U64(len(s)), np.bitwise_xor.reduce(mix(s * U64(5)))], U64))
    return int((h[:1] * U64(3) + h[1:]).view(np.int64)[0]) or 1


def sketches(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set the features in each of CELLS equal ranges of the domain (255 at most): their L1 distance bounds the Hamming distance from below."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(own * CELLS + (x >> U64(64 - CELL_BITS)).astype(np.int64), minlength=len(sizes) * CELLS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(sizes), CELLS)


def _member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n_shingles, class, sketch, spare): spare is the least number of signatures the set can do without."""
    for batch in batches:
        data, offsets, _ = utf8(batch.column(1))
        n, c = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        spare, sketch = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        rows, sets, held = [], [], 0

        def describe() -> None:
            nonlocal held
            held = 0
            if not sets:
                return
            x, sizes, at = np.concatenate(sets), np.array([len(s) for s in sets], np.int64), np.array(rows)
            for d, v in zip(rows, sketches(x, sizes)):
                sketch[d] = v.tobytes()
            spare[at] = 1 << 40
            for own, _, settled, left, _ in signatures(x, sizes):
                np.minimum.at(spare, at[own[settled]], left[settled])
            rows.clear(), sets.clear()

        for d, s in shingle_sets(data, offsets):
            n[d], c[d] = len(s), class_hash(s)
            if len(s):
                rows.append(d)
                sets.append(s)
                held += len(s) + CELLS
                if held > 1 << 17:
                    describe()
        describe()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(c), pa.array(sketch, pa.binary()), pa.array(spare)], ["doc_id", "text_hash", "n_shingles", "class", "sketch", "spare"])


def _signature_batches(parts: int):
    """Map side: (part, packed signatures).  A row holds sorted 40-bit signatures, indexes to its classes, the classes."""
    bits = parts.bit_length() - 1

    def pack(signs: list[np.ndarray], owners: list[np.ndarray], classes: np.ndarray) -> pa.RecordBatch:
        sign, owner = np.concatenate(signs), np.concatenate(owners)
        sign >>= U64(24 - bits)
        order = np.argsort(sign, kind="stable")
        sign, owner = sign[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
        length = np.diff(np.concatenate([head, [len(sign)]]))
        rows = []
        if (length > SMALL).any():  # pre-aggregate: members of a large bucket go their own way, only a mark goes on
            crowd = np.repeat(length > SMALL, length)
            table = np.stack([sign[crowd].view(np.int64), classes[owner[crowd]]])
            for a in range(0, table.shape[1], 1 << 14):
                rows.append((-1 - int(table[1, a] % SPREAD), table[:, a:a + (1 << 14)].tobytes(), b"", b""))
            marks = sign[head[length > SMALL]]
            sign = np.concatenate([sign[~crowd], marks])
            owner = np.concatenate([owner[~crowd], np.full(len(marks), len(classes))])
            classes = np.append(classes, EMPTY)
            order = np.argsort(sign, kind="stable")
            sign, owner = sign[order], owner[order]
        edges = np.searchsorted((sign >> U64(40)).astype(np.int64), np.arange(parts + 1))
        rest = sign & U64((1 << 40) - 1)
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                some, index = np.unique(owner[a:b], return_inverse=True)
                low = np.ascontiguousarray(rest[a:b]).view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((p, low.T.tobytes(), index.astype(np.uint16 if len(some) < 65536 else np.uint32).tobytes(), classes[some].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[q] for r in rows], pa.binary()) for q in (1, 2, 3)]], ["part", "signs", "owners", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        signs, owners, classes, held = [], [], [], 0
        block: list[np.ndarray] = []

        def flush_block() -> None:
            nonlocal held
            if block:
                first = len(classes) - len(block)
                for own, sign, *_ in signatures(np.concatenate(block), np.array([len(s) for s in block], np.int64)):
                    signs.append(sign)
                    owners.append(own + first)
                    held += len(sign)
                block.clear()

        for batch in batches:
            data, offsets, _ = utf8(batch.column(0))
            size = 0
            for _, s in shingle_sets(data, offsets):
                c = class_hash(s)
                if c == EMPTY or c in seen:
                    continue
                seen.add(c)
                classes.append(c)
                block.append(s)
                size += len(s)
                if size > 1 << 17:
                    flush_block()
                    size = 0
                    if held >= FLUSH:
                        yield pack(signs, owners, np.array(classes, np.int64))
                        signs.clear(), owners.clear(), classes.clear()
                        held = 0
            flush_block()
            if held >= FLUSH:
                yield pack(signs, owners, np.array(classes, np.int64))
                signs.clear(), owners.clear(), classes.clear()
                held = 0
        if held:
            yield pack(signs, owners, np.array(classes, np.int64))
    return run


def _bucket_table(key: tuple, table: pa.Table) -> pa.Table:
    """Reduce side: buckets of a part.  Small ones as arrays of classes, large ones as (bucket, class) rows."""
    part = key[0].as_py()
    if part < 0:  # large buckets found on the map side
        return _bucket_rows(set(), np.concatenate([np.frombuffer(s.as_buffer(), np.int64).reshape(2, -1) for s in table["signs"]], axis=1))
    signs, owners = [], []
    for s, o, c in zip(table["signs"], table["owners"], table["classes"]):
        low = np.frombuffer(s.as_buffer(), np.uint8).reshape(5, -1)
        wide = np.zeros((low.shape[1], 8), np.uint8)
        wide[:, :5] = low.T
        signs.append(wide.view(np.int64).ravel())
        classes = np.frombuffer(c.as_buffer(), np.int64)
        raw = o.as_buffer()
        owners.append(classes[np.frombuffer(raw, np.uint16 if raw.size == 2 * low.shape[1] else np.uint32)])
    sign, owner = np.concatenate(signs), np.concatenate(owners)
    order = np.lexsort((owner, sign))
    sign, owner = sign[order], owner[order]
    new = np.concatenate([[True], (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])])
    sign, owner = sign[new], owner[new]
    head = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    length = np.diff(np.concatenate([head, [len(sign)]]))
    marked = np.logical_or.reduceat(owner == EMPTY, head)
    large = np.repeat((length > SMALL) | marked, length) & (owner != EMPTY)
    some = (length > 1) & (length <= SMALL) & ~marked
    small = {tuple(owner[a:a + n].tolist()) for a, n in zip(head[some].tolist(), length[some].tolist())}
    return _bucket_rows(small, np.stack([sign[large] + (part << 40), owner[large]]))


def _bucket_rows(small: set[tuple[int, ...]], large: np.ndarray) -> pa.Table:
    pad = pa.nulls(len(small), pa.int64())
    groups = pa.array([*small, *[None] * large.shape[1]], pa.list_(pa.int64()))
    return pa.table([groups, *[pa.concat_arrays([pad, pa.array(np.ascontiguousarray(v))]) for v in large]], names=["classes", "bucket", "class"])


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each small bucket."""
    for batch in batches:
        a, b = [], []
        for c in batch.column(0).to_pylist():
            c = np.array(c)
            i, j = np.triu_indices(len(c), 1)
            a.append(c[i])
            b.append(c[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        left, right = batch.column(2), batch.column(3)
        for r in range(batch.num_rows):
            x, y = (np.frombuffer(v[r].as_buffer(), U64) for v in (left, right))
            if DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)):
                continue
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if DEN * shared >= NUM * (len(x) + len(y) - shared):
                keep.append(r)
        yield pa.RecordBatch.from_arrays([batch.column(q).take(pa.array(keep, pa.int64())) for q in (0, 1)], ["a", "b"])


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches do not rule a link out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = (np.asarray(batch.column(q)) for q in (2, 3))
        x, y = (np.frombuffer(utf8(batch.column(q))[0], np.uint8).reshape(-1, CELLS).astype(np.int16) for q in (4, 5))
        apart = np.abs(x - y).sum(1, dtype=np.int64)
        keep = pa.array(np.flatnonzero((DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & ((DEN + NUM) * apart <= (DEN - NUM) * (n + m))))
        yield pa.RecordBatch.from_arrays([batch.column(q).take(keep) for q in (0, 1)], ["a", "b"])


def near(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave: no link is lost, most chance meetings are."""
    known = members.groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    left = pairs.join(known.withColumnsRenamed({"class": "a", "n": "n", "sketch": "x"}), "a")
    both = left.join(known.withColumnsRenamed({"class": "b", "n": "m", "sketch": "y"}), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(_near_batches, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    left = pairs.join(sets.withColumnsRenamed({"class": "a", "shingles": "x"}), "a")
    both = left.join(sets.withColumnsRenamed({"class": "b", "shingles": "y"}), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verify_batches, "a long, b long")


def shingle_tables(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted classes, from the text of one document of each."""
    by_class = members.groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id"))
    ids = stored(by_class.join(classes, "class"), "wanted")
    words = docs.sparkSession.sparkContext.broadcast(bloom(ids, "doc_id"))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.array(np.flatnonzero(bloom_hits(words.value, batch.columns[2:])))
            data, offsets, _ = utf8(batch.column(1).take(some))
            sets = [s for _, s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([class_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "class", "shingles"])

    sets = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").select("doc_id", "text", *bloom_places("doc_id")).mapInArrow(run, "doc_id long, class long, shingles binary")
    found = ids.join(sets, ["doc_id", "class"]).groupBy("class").agg(F.first("shingles").alias("shingles"))
    return stored(found, "shingles")


def _resign_batches(parts: int):
    """(class, bucket, side, spare) of the signatures at the level where each set is settled."""
    bits = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = np.asarray(batch.column(0))
            for a in range(0, batch.num_rows, 256):
                sets = [np.frombuffer(v.as_buffer(), U64) for v in batch.column(1)[a:a + 256]]
                for own, sign, settled, spare, side in signatures(np.concatenate(sets), np.array([len(s) for s in sets], np.int64)):
                    bucket = (sign >> U64(24 - bits)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(v[settled]) for v in (classes[a + own], bucket, side, spare)], ["class", "bucket", "side", "spare"])
    return run


def leader_pairs(large: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the leaders of its large buckets.

    A leader stands in the most large buckets of its bucket's classes: the copy closest to all others
    has the fewest changed parts.
    """
    by_class = large.groupBy("class").agg(F.count("*").alias("n"), F.collect_list("bucket").alias("buckets"))  # some signatures of one set
    rows = by_class.select("class", "n", F.explode("buckets").alias("bucket"))
    best = rows.groupBy("bucket").agg(F.max(F.struct(F.col("n"), F.xxhash64("class").alias("h"), F.col("class"))).alias("best")).select("bucket", F.col("best.class").alias("leader"))
    led = large.join(best, "bucket").filter("class != leader")
    return led.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()


def hub_pairs(pairs: DataFrame) -> DataFrame:
    """One pair of each class: with the class that has the most pairs, of those it has a pair with."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n"))
    hub = both.join(degree, "b").groupBy("a").agg(F.max(F.struct(F.col("n"), F.xxhash64("b"), F.col("b"))).alias("hub")).select("a", F.col("hub")["b"].alias("b"))
    return stored(hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "hubs")


def between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are not in one component yet."""
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return known.filter(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")


def unsettled_pairs(docs: DataFrame, known: DataFrame, large: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b, apart) between components that only large buckets can show, as far as sizes and sketches leave them.

    The signatures in small buckets were compared in full; of its large ones a class asks so many (the
    smallest first) that some signature in them or in small buckets is sure to be unspoiled.  Askers and
    members of a bucket meet in tiles of bounded size with their sketches (of fixed size, whatever the set); a
    pair is compared in the first bucket it shares.
    """
    members = large.join(label.select(F.col("node").alias("class"), "component"), "class", "left")
    members = stored(members.select("bucket", "class", F.coalesce("component", "class").alias("component")), "members")
    mixed = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    of_class = known.groupBy("class").agg(F.min("spare").alias("spare"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    may_ask = stored(members.groupBy("class").agg(F.count("*").alias("n")).join(of_class, "class").filter(F.col("n") > F.col("spare")).select("class"), "askers")
    sets = shingle_tables(docs, known, may_ask)
    signed = sets.mapInArrow(_resign_batches(parts), "class long, bucket long, side long, spare long")
    held = signed.join(members, ["class", "bucket"]).join(mixed, "bucket")
    mine = ["class", "side"]
    nth = F.row_number().over(Window.partitionBy(*mine).orderBy("n", "bucket"))
    total = F.count("*").over(Window.partitionBy(*mine))
    asked = held.withColumn("nth", nth).withColumn("total", total).filter((F.col("nth") <= F.col("total") - F.col("spare")) & (F.col("low") != F.col("high")))
    asked = stored(asked.groupBy("class", "component").agg(F.sort_array(F.collect_set(F.struct("n", "bucket"))).alias("asks")), "asked")
    rows = asked.select("class", "component", F.transform("asks", lambda x: x["bucket"]).alias("asks"), F.posexplode("asks").alias("at", "ask"))
    rows = rows.select("class", "component", F.col("ask")["bucket"].alias("bucket"), F.col("ask")["n"].alias("n"), F.slice("asks", F.lit(1), F.col("at")).alias("buckets"))
    sizes = rows.groupBy("bucket").agg(F.ceil(F.max("n") / TILE).alias("tiles"), F.ceil(F.count("*") / TILE).alias("chunks"))
    of = lambda n: F.pmod(F.xxhash64("class"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spot = F.struct("bucket", "tiles", "chunks")
    # a class's buckets are listed first, so that its sketch joins once and not once a bucket
    asking = rows.join(sizes, "bucket").groupBy("class", "component").agg(F.collect_list(F.struct(spot.alias("spot"), "buckets")).alias("places"))
    present = members.join(sizes, "bucket").groupBy("class", "component").agg(F.collect_list(spot).alias("places"))
    sketches = of_class.select("class", "size", "sketch")
    what = ["class", "component", "size", "sketch", "buckets"]
    askers = asking.join(sketches, "class").withColumn("place", F.explode("places")).select("class", "component", "size", "sketch", "place.buckets", "place.spot.*")
    askers = askers.select("bucket", every("tiles").alias("tile"), of("chunks").alias("chunk"), F.lit(True).alias("asks"), *what)
    answers = present.join(sketches, "class").withColumn("buckets", F.transform("places", lambda x: x["bucket"])).withColumn("place", F.explode("places"))
    answers = answers.select("class", "component", "size", "sketch", "buckets", "place.*")
    answers = answers.select("bucket", of("tiles").alias("tile"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), *what)
    return askers.union(answers).groupBy("bucket", "tile", "chunk").applyInArrow(_tile_pairs, "a long, b long, apart long").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def unsettled_links(docs: DataFrame, known: DataFrame, large: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) between components that only large buckets can show: the closest pair of two components first, then the
    others of those that are still two."""
    pairs = stored(unsettled_pairs(docs, known, large, label, parts), "open-pairs")
    sets = shingle_tables(docs, known, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({f"{e}_of": F.coalesce(f"{e}_of", e) for e in "ab"})
    two = [F.least("a_of", "b_of").alias("p"), F.greatest("a_of", "b_of").alias("q")]
    first = stored(named.groupBy(*two).agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("m.a", "m.b"), "closest")
    links = stored(verified(first, sets), "links")
    joined = components(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    rest = named.join(first, ["a", "b"], "left_anti")
    at = lambda end: joined.select(F.col("node").alias(f"{end}_of"), F.col("component").alias(f"{end}_now"))
    rest = rest.join(at("a"), "a_of", "left").join(at("b"), "b_of", "left").filter(F.coalesce("a_now", "a_of") != F.coalesce("b_now", "b_of"))
    return links.union(stored(verified(rest.select("a", "b"), sets), "links"))


def _dense(lists: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: which of ``among`` (sorted) each list holds."""
    out = np.zeros((len(lists), len(among)), np.float32)
    for r, v in enumerate(lists):
        at = np.searchsorted(among, v)
        ok = at < len(among)
        ok[ok] = among[at[ok]] == v[ok]
        out[r, at[ok]] = 1
    return out


def _tile_pairs(table: pa.Table) -> pa.Table:
    """Pairs of a tile between components, in their first shared bucket, that sizes and sketches leave."""
    asks = np.asarray(table["asks"])
    classes, component, size = table["class"].to_numpy(), table["component"].to_numpy(), table["size"].to_numpy()
    buckets = [np.array(v, np.int64) for v in table["buckets"].to_pylist()]
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    none = pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "apart"])
    if not len(x) or not len(y):
        return none
    open_pairs = component[x][:, None] != component[y][None, :]
    low, high = np.minimum(size[x][:, None], size[y]), np.maximum(size[x][:, None], size[y])
    open_pairs &= DEN * low >= NUM * high
    earlier = np.unique(np.concatenate([buckets[i] for i in x]))
    if len(earlier):
        open_pairs &= _dense([buckets[i] for i in x], earlier) @ _dense([buckets[i] for i in y], earlier).T == 0
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
    a, b, far = [], [], []
    for k in np.flatnonzero(open_pairs.any(1)).tolist():
        j = np.flatnonzero(open_pairs[k])
        apart = np.abs(sketch[y[j]] - sketch[x[k]]).sum(1, dtype=np.int64)
        ok = (DEN + NUM) * apart <= (DEN - NUM) * (size[y[j]] + size[x[k]])
        a.append(np.full(ok.sum(), classes[x[k]]))
        b.append(classes[y[j[ok]]])
        far.append(apart[ok])
    if not a:
        return none
    a, b, far = (np.concatenate(v) for v in (a, b, far))
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far)], names=["a", "b", "apart"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (xxhash64 of the text) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = stored(rows.select("*", F.xxhash64("text").alias("text_hash")).mapInArrow(_member_batches, "doc_id long, text_hash long, n_shingles long, class long, sketch binary, spare long"), "classes")
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(256, 1 << int(np.ceil(np.log2(max(1, 0.6 * total / PART)))))
    packed = rows.select("text").mapInArrow(_signature_batches(parts), "part int, signs binary, owners binary, classes binary")
    buckets = stored(packed.groupBy("part").applyInArrow(_bucket_table, "classes array<long>, bucket long, class long"), "buckets")
    large = buckets.filter(F.col("bucket").isNotNull()).select("bucket", "class").distinct()
    close = buckets.filter(F.col("classes").isNotNull()).select("classes").distinct().mapInArrow(_pair_batches, "a long, b long")
    pairs = stored(near(close.union(leader_pairs(large)).distinct(), members), "pairs")
    sets = shingle_tables(rows, members, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    first = hub_pairs(pairs)
    links = stored(verified(first, sets), "links")
    label = components(links)
    rest = between(pairs.join(first, ["a", "b"], "left_anti"), label)
    links = links.union(stored(verified(rest, sets), "links"))
    label = components(links)
    if not large.isEmpty():
        links = links.union(stored(unsettled_links(rows, members, large, label, parts), "links"))
        label = components(links)
    first = members.groupBy("class").agg(F.min("doc_id").alias("first"))
    named = first.join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = named.join(lowest, "component").select("class", "component_id")
    out = members.join(of_class, "class")
    return out.select("doc_id", "n_shingles", F.when(F.col("class") == EMPTY, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with its own columns.

    Rows without shingles all stay; rows that repeat both id and text are one document and stay together;
    of the texts under one id that link, one stays; rows with a null id stay if no document with an id links.
    """
    tag = uuid.uuid4().hex
    found = join(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("component_id", F.coalesce("component_id", F.lit(NO_ID)))
    alone = F.when(F.col("n_shingles") == 0, F.col("text_hash"))
    stay = found.filter("doc_id = component_id").groupBy("doc_id", "component_id", alone).agg(F.min("text_hash").alias("text_hash"))
    stay = stay.select(F.col("doc_id").alias(f"id_{tag}"), F.col("text_hash").alias(f"hash_{tag}"))
    rows = docs.withColumns({f"id_{tag}": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), f"hash_{tag}": F.xxhash64(text_col)})
    return rows.join(stay, [f"id_{tag}", f"hash_{tag}"], "left_semi").select(*docs.columns)
