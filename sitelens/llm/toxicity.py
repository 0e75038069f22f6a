"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Texts are words of letters; a word is predicted symbol by symbol (64 symbols, the last is its end) from
the six before.  The toxic and the ordinary model keep counts of their own for the highest order; rarer
contexts back off to continuation counts that both classes share, so an expression seen once or never
weighs little.  A document is described by length-normalised differences of the two log-likelihoods: over
the whole text, and over its most toxic words.  A logistic curve, fitted on labelled rows that the models
have not counted, turns these into a score.

Counts come from every labelled row outside the held-out fold and the calibration fold.  The models stay
tables: discounts, continuation counts and log ratios of all n-grams are Spark aggregations and joins, and
no n-gram is dropped.  The contexts counted most often (``FREQUENT_CONTEXTS``) go out with the log ratios
of their symbols; a word in which another known context occurs stays open until its n-grams have joined
the model's table.  That number decides how much is shuffled, not the result.

Defined cases: null text or text without letters scores like an empty text (features 0); conflicting
labels of one id count as toxic; without both classes in the training rows every score is 0;
repeated rows get the same score; texts are read whole; a null doc_id is never held out and has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import bloom, bloom_hits, bloom_places, blocks, crc_mod, stored, utf8

SYMBOLS, BITS, ORDER = 64, 6, 7
#: Contexts whose log ratios are broadcast (each has at most SYMBOLS).
FREQUENT_CONTEXTS = 1 << 17
#: Bits of the filter of known contexts: 8 MB, whatever the model.
KNOWN_BITS = 26
#: Discount of continuation counts; those of class counts follow from the data.
DISCOUNT = 0.75
#: Documents weigh by their most toxic words: how many.
TOP_WORDS = 3
#: Bound of labelled rows of the calibration fold that the logistic curve is fitted on.
CALIBRATION_ROWS = 20_000
HELD_OUT, CALIBRATION, FOLDS = 0, 4, 5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128, 256) % 37


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first doc, end doc, owner, code, first symbol of a word) of predicted symbols with their context."""
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        n = j - i
        spread = np.zeros(hi - lo + n, np.int64)  # one end symbol after each document
        ends = offsets[i + 1:j + 1] - lo + np.arange(n)
        inside = np.ones(len(spread), bool)
        inside[ends] = False
        spread[inside] = _SYMBOL[data[lo:hi]]
        code, seen = spread.copy(), np.ones(len(spread), bool)
        for back in range(1, ORDER):
            before = np.zeros(len(spread), np.int64)
            before[back:] = spread[:-back]
            seen &= before > 0
            code |= np.where(seen, before, 0) << (BITS * back)
        previous = np.concatenate([[0], spread[:-1]])
        at = np.flatnonzero((spread > 0) | (previous > 0))
        own = np.searchsorted(ends, at, "left")
        yield i, j, own, code[at], previous[at] == 0


def slots(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open table for look_up: a slot holds the key it is for and its value."""
    bits = max(10, int(np.ceil(np.log2(2 * len(keys) + 1))))
    held, out = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
    left, at = np.arange(len(keys)), _slot(keys, bits)
    while len(left):  # linear probing, all keys at a time
        free = held[at] < 0
        _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        put = one[free[one]]
        held[at[put]], out[at[put]] = keys[left[put]], values[left[put]]
        rest = np.ones(len(left), bool)
        rest[put] = False
        left, at = left[rest], (at[rest] + 1) & ((1 << bits) - 1)
    return held, out


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def look_up(slots: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value or 0, found) of each key."""
    bits = int(len(slots)).bit_length() - 1
    at = _slot(keys, bits)
    got = np.zeros(len(keys))
    found = np.zeros(len(keys), bool)
    todo = np.arange(len(keys))
    while len(todo):
        here = slots[at]
        hit = here == keys[todo]
        got[todo[hit]] = values[at[hit]]
        found[todo[hit]] = True
        go = ~hit & (here >= 0)
        todo, at = todo[go], (at[go] + 1) & (len(slots) - 1)
    return got, found


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(toxic, text) of the rows that the models count."""
    train = lambda rows: rows.filter(~crc_mod("doc_id", FOLDS).isin(HELD_OUT, CALIBRATION))
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = train(known)
    words = docs.sparkSession.sparkContext.broadcast(bloom(known, "doc_id"))  # of fixed size

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(np.flatnonzero(bloom_hits(words.value, batch.columns[2:])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(1).take(hit)], ["doc_id", "text"])

    rows = train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "text", *bloom_places("doc_id"))
    return rows.mapInArrow(likely, "doc_id long, text string").join(known.hint("merge"), "doc_id").select("toxic", "text")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct n-grams by class, merged over a task as they come."""
    codes, counts = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    pending: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate(pending) if pending else np.zeros(0, np.int64)
        new, of = np.unique(both >> 1, return_inverse=True)
        add = np.stack([np.bincount(of, (both & 1) == c, minlength=len(new)).astype(np.int64) for c in (0, 1)])
        all_codes = np.union1d(codes, new)
        out = np.zeros((2, len(all_codes)), np.int64)
        out[:, np.searchsorted(all_codes, codes)] += counts
        out[:, np.searchsorted(all_codes, new)] += add
        return all_codes, out

    for batch in batches:
        data, offsets, _ = utf8(batch.column(1))
        toxic = np.asarray(batch.column(0)).astype(np.int64)
        for i, j, own, code, _ in gram_codes(data, offsets):
            pending.append(code * 2 + toxic[i:j][own])
            if sum(map(len, pending)) > 1 << 22:
                codes, counts = merged()
                pending.clear()
    codes, counts = merged()
    for a in range(0, len(codes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(codes[a:a + (1 << 16)]), pa.array(counts[1, a:a + (1 << 16)]), pa.array(counts[0, a:a + (1 << 16)])], ["code", "toxic", "ordinary"])


def _low(code: str, symbols: int):
    return F.col(code).bitwiseAND(F.lit((1 << (BITS * symbols)) - 1))


def shared_model(grams: DataFrame) -> DataFrame:
    """(low, p): probability of each n-gram's symbol below the highest order, from continuation counts of both classes."""
    kinds, lows = grams.select(F.col("code").alias("low")), []
    for order in range(ORDER - 1, 0, -1):  # distinct n-grams of one symbol more, by their last symbols
        kinds = kinds.groupBy(_low("low", order).alias("low")).agg(F.count("*").alias("n"))
        lows.append(kinds)
        kinds = kinds.select("low")
    p = None
    for order, low in enumerate(reversed(lows), 1):
        context = Window.partitionBy(F.shiftright("low", BITS))  # one row a symbol: at most SYMBOLS
        low = low.select("low", F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)).alias("own"), F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("kinds"))
        below = F.lit(1.0 / SYMBOLS)
        if p is not None:
            low = low.withColumn("next", _low("low", order - 1)).join(p.withColumnRenamed("low", "next"), "next")
            below = F.col("p")
        p = low.select("low", ((F.col("own") + DISCOUNT * F.col("kinds") * below) / F.col("total")).alias("p"))
    return p


def discounts(grams: DataFrame, count: str) -> list[float]:
    """Discounts of the counts 0, 1, 2 and more: by the numbers of n-grams seen once to four times (modified Kneser-Ney)."""
    seen = grams.agg(*[F.count(F.when(F.col(count) == k, 1)) for k in (1, 2, 3, 4)]).first()
    n = [0, *(max(1, v) for v in seen)]
    share = n[1] / (n[1] + 2 * n[2])
    return [0.0, *(min(max(k - (k + 1) * share * n[k + 1] / n[k], 0.1), k) for k in (1, 2, 3))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """The pair of models as (context, n, spare, known): log ratios of toxic and ordinary probability of its symbols, and of those not seen there; None without both classes."""
    grams = (_labelled(docs, labels, id_col, text_col).mapInArrow(_count_batches, "code long, toxic long, ordinary long")
             .groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    grams = stored(grams, "toxicity-ngrams")
    if not all(grams.agg(F.sum("toxic"), F.sum("ordinary")).first()):
        return None
    classes = ("toxic", "ordinary")
    less = {c: F.array(*map(F.lit, discounts(grams, c))) for c in classes}
    taken = {c: F.get(less[c], F.least(F.col(c), F.lit(3)).cast("int")) for c in classes}
    rows = grams.withColumn("low", _low("code", ORDER - 1)).join(shared_model(grams), "low").withColumn("symbol", _low("code", 1).cast("int"))
    rows = rows.withColumn("context", F.shiftright("code", BITS))
    rows = rows.select("context", "symbol", "p", *classes, *[taken[c].alias(f"{c}_less") for c in classes])
    of = rows.groupBy("context").agg(F.collect_list(F.struct("symbol", "p", *classes, *[f"{c}_less" for c in classes])).alias("seen"),
                                     *[F.sum(x).alias(f"sum_{x}") for c in classes for x in (c, f"{c}_less")])
    back = {c: F.when(F.col(f"sum_{c}") > 0, F.col(f"sum_{c}_less") / F.col(f"sum_{c}")).otherwise(1.0) for c in classes}
    of = of.select("context", "seen", *[F.greatest(f"sum_{c}", F.lit(1)).alias(f"total_{c}") for c in classes], *[back[c].alias(f"back_{c}") for c in classes])
    log = lambda x, c: F.log((x[c] - x[f"{c}_less"]) / F.col(f"total_{c}") + F.col(f"back_{c}") * x["p"])
    known = F.map_from_entries(F.transform("seen", lambda x: F.struct(x["symbol"], log(x, "toxic") - log(x, "ordinary"))))
    seen = F.col("total_toxic") + F.col("total_ordinary")
    return stored(of.select("context", seen.alias("n"), (F.log("back_toxic") - F.log("back_ordinary")).alias("spare"), known.alias("known")), "toxicity-model")


def _places(contexts: np.ndarray) -> list[np.ndarray]:
    return [_slot(contexts, KNOWN_BITS), _slot(contexts ^ 0x5555555555, KNOWN_BITS)]


def known_contexts(model: DataFrame) -> np.ndarray:
    """Bits set at the two places of each context: says which n-grams need no join as their context is unknown."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(np.asarray(batch.column(0)))))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["w", "bits"])

    words = model.select("context").mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (KNOWN_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def frequent_model(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray] | np.ndarray]:
    most = model.orderBy(F.desc("n"), "context").limit(FREQUENT_CONTEXTS).select("context", "spare", F.map_keys("known").alias("symbol"), F.map_values("known").alias("ratio")).toArrow().combine_chunks()
    contexts = most["context"].to_numpy()
    sizes = most["symbol"].combine_chunks().value_lengths().to_numpy()
    codes = (np.repeat(contexts, sizes) << BITS) | most["symbol"].combine_chunks().flatten().to_numpy()
    return {"gram": slots(codes, most["ratio"].combine_chunks().flatten().to_numpy()), "context": slots(contexts, most["spare"].to_numpy()), "known": known_contexts(model)}


def log_ratio(model: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios (0 where the context is unknown or not frequent) and the places of the codes that need the whole model."""
    value, found = look_up(*model["gram"], codes)
    rest = np.flatnonzero(~found)
    value[rest], found = look_up(*model["context"], codes[rest] >> BITS)
    rest = rest[~found]
    hit = np.ones(len(rest), bool)
    for at in _places(codes[rest] >> BITS):
        hit &= (model["known"][at >> 6] >> (at & 63)) & 1 == 1
    return value, rest[hit]


def measure(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, mean log ratio by symbol, means of the 1 and TOP_WORDS words of the highest log ratio, log2 of words."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_model(model))  # at most FREQUENT_CONTEXTS * SYMBOLS n-grams, and the filter
    tops, lists = [f"top{k}" for k in range(TOP_WORDS)], {"open_word": "int", "open_code": "long", "open_value": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = utf8(batch.column(2))
            m = len(offsets) - 1
            symbols, words, total, top = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros((TOP_WORDS, m))
            ends, held = np.zeros(m + 1, np.int64), [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
            for i, j, own, codes, head in gram_codes(data, offsets):
                if not len(own):
                    continue
                value, late = log_ratio(frequent.value, codes)
                first, word_of = np.flatnonzero(head), np.cumsum(head) - 1
                word, word_own = np.add.reduceat(value, first), own[first]
                symbols[i:j], words[i:j] = np.bincount(own, minlength=j - i), np.bincount(word_own, minlength=j - i)
                of_word = word_of[late]
                new = np.concatenate([[True], of_word[1:] != of_word[:-1]])[:len(late)]  # an open word brings its known part once
                held.append((of_word.astype(np.int32), codes[late], np.where(new, word[of_word], 0.0)))
                ends[i + 1:j + 1] = np.bincount(own[late], minlength=j - i)
                closed = np.ones(len(word), bool)
                closed[of_word] = False
                total[i:j] = np.bincount(word_own[closed], word[closed], minlength=j - i)
                good = np.flatnonzero(closed & (word > 0))
                good = good[np.lexsort((-word[good], word_own[good]))]
                rank = np.arange(len(good)) - np.searchsorted(word_own[good], word_own[good])
                for k in range(TOP_WORDS):
                    top[k, i + word_own[good[rank == k]]] = word[good[rank == k]]
            at = pa.array(np.cumsum(ends).astype(np.int32))
            opened = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in zip(*held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(symbols), pa.array(words), pa.array(total), *map(pa.array, top), *opened],
                                             ["row", "doc_id", "symbols", "words", "total", *tops, *lists])

    # the number of a row is kept in the table, so it names the row from here on
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = stored(rows.mapInArrow(run, "row long, doc_id long, symbols long, words long, total double, " + ", ".join(f"{t} double" for t in tops) + "".join(f", {c} array<{t}>" for c, t in lists.items())), "toxicity-rows")
    late = rows.filter(F.size("open_code") > 0).select("row", F.explode(F.arrays_zip(*lists)).alias("x")).select("row", "x.*")
    late = late.select("row", "open_word", "open_value", F.shiftright("open_code", BITS).alias("context"), _low("open_code", 1).cast("int").alias("symbol"))
    ratio = F.col("open_value") + F.coalesce(F.try_element_at("known", "symbol"), "spare", F.lit(0.0))
    late = late.join(model.drop("n"), "context", "left").groupBy("row", "open_word").agg(F.sum(ratio).alias("ratio"))
    late = late.groupBy("row").agg(F.sum("ratio").alias("late"), F.collect_list(F.when(F.col("ratio") > 0, F.col("ratio"))).alias("tops"))  # no longer than the text
    best = F.concat(F.array(*tops), F.coalesce("tops", F.array().cast("array<double>")))
    rows = rows.drop(*lists).join(late, "row", "left").withColumn("best", F.slice(F.sort_array(best, asc=False), 1, TOP_WORDS))
    return rows.select("doc_id", ((F.col("total") + F.coalesce("late", F.lit(0.0))) / F.greatest("symbols", F.lit(1))).alias("mean_log_ratio"), F.get("best", F.lit(0)).alias("top_word"),
                       (F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / TOP_WORDS).alias("top_words"), F.log2(F.col("words") + 1).alias("log_words"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on standardised columns (Newton steps)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # classes weigh the same
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)) / len(w), z.T @ (weight * (p - y)) + ridge * w / len(w))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the length-normalised log ratios, for every row."""
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return rows.select("doc_id", held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *[F.lit(0.0).alias(c) for c in ("mean_log_ratio", "top_word", "top_words")])
    names = ["mean_log_ratio", "top_word", "top_words", "log_words"]
    measured = stored(measure(rows, model), "toxicity")
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    fold = crc_mod("doc_id", FOLDS) == CALIBRATION
    sample = measured.filter(fold).join(known.filter(fold), "doc_id").orderBy(F.xxhash64("doc_id")).limit(CALIBRATION_ROWS).toArrow()
    y = sample["toxic"].to_numpy()
    if len(set(y.tolist())) == 2:
        weights, start = logistic(np.column_stack([sample[c].to_numpy() for c in names]), y)
    else:  # nothing to calibrate on: a log ratio of 10 for the most toxic word is even
        weights, start = np.array([0.0, 1.0, 0.0, 0.0]), -10.0
    logit = F.lit(float(start))
    for c, w in zip(names, weights):
        logit = logit + F.col(c) * F.lit(float(w))
    score = 1 / (1 + F.exp(-logit))
    return measured.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *names[:3])
