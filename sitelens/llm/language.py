"""Language identification (operator 10).

A document is the average of the embeddings of its hashed subwords (byte n-grams of 1 to 4 inside
word boundaries), classified by a linear softmax.  Embeddings and weights are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE_ROWS``), a fifth
of which is held back to fit the softmax temperature and the rejection threshold.  Since the model
is linear in the average, scoring needs only one table of n-gram bucket x language.

Defined cases: null text or text without a letter gives ``und`` with score 0 (accepted false); no
labelled row at all gives ``und`` for every row; repeated rows get the same answer; texts of any
length are read whole; a null doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import U64, blocks, crc_mod, mix, utf8

BUCKETS = 4096
DIM = 16
NGRAMS = (1, 2, 3, 4)
#: Bound of the training sample: rows over all languages, but so many of each language at least.
SAMPLE_ROWS, LANG_ROWS = 2048, 8
EPOCHS, BATCH, RATE, SEED = 30, 32, 2.0, 7
#: Share of right held-back answers that the rejection threshold keeps.
KEPT_RIGHT = 0.995
UNKNOWN = "und"

#: Bytes of letters keep their (lower-cased) value, all others are a boundary.
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def subword_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks (first doc, end doc, counts[doc, bucket]) of hashed subwords."""
    for i, j in blocks(offsets, 1 << 19):
        counts = np.zeros((j - i) * BUCKETS, np.int64)
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, hi, 1 << 20):  # a very long document comes in pieces that overlap by an n-gram
            b = min(hi, a + (1 << 20))
            x = _LETTER[data[a:min(hi, b + max(NGRAMS) - 1)]]
            own = np.repeat(np.arange(j - i), np.diff(np.clip(offsets[i:j + 1], a, a + len(x))))
            letter = x > 0
            code = x.astype(np.uint32)
            inner = None
            for n in NGRAMS:
                if n > 1:
                    m = len(x) - n + 1
                    if m <= 0:
                        break
                    code = code[:m] | (x[n - 1:].astype(np.uint32) << np.uint32(8 * (n - 1)))
                    inner = letter[1:m + 1] if n == 3 else inner[:m] & letter[n - 2:m + n - 2] if n > 3 else None
                m = len(code)
                ok = letter[:m] | letter[n - 1:] if n > 1 else letter.copy()
                if inner is not None:
                    ok &= inner[:m]
                if n > 1:
                    ok &= own[:m] == own[n - 1:]
                ok[b - a:] = False
                at = np.flatnonzero(ok)
                bucket = (mix(code[at].astype(U64) * U64(8) + U64(n)) >> U64(40)).astype(np.int64) % BUCKETS
                counts += np.bincount(own[at] * BUCKETS + bucket, minlength=len(counts))
        yield i, j, counts.reshape(j - i, BUCKETS)


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = utf8(batch.column(1))
        ids, buckets, shares = [], [], []
        for i, j, counts in subword_counts(data, offsets):
            for d in range(i, j):
                at = np.flatnonzero(counts[d - i])
                ids.append(batch.column(0)[d].as_py())
                buckets.append(at.astype(np.int32))
                shares.append((counts[d - i][at] / max(1, counts[d - i].sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "buckets", "shares"])


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict | None:
    """Model fitted on a bounded sample of the labelled ``rows``, or None without any."""
    rows = rows.filter(F.col(lang_col).isNotNull() & has_letter(text_col))
    sizes = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}  # every language is learned
    if not sizes:
        return None
    langs = sorted(sizes)
    each = max(LANG_ROWS, SAMPLE_ROWS / len(langs))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, each / sizes[k])))])
    drawn = F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(F.col(lang_col).isin(langs)).filter(drawn < F.element_at(share, F.col(lang_col)))
    got = (sample.select(lang_col, text_col).mapInArrow(_sample_batches, "lang string, buckets array<int>, shares array<float>")
           .limit(int(2 * each * len(langs))).toArrow())
    x = np.zeros((len(got), BUCKETS), np.float32)
    y = np.array([langs.index(k) for k in got["lang"].to_pylist()])
    for r, (b, v) in enumerate(zip(got["buckets"].to_pylist(), got["shares"].to_pylist())):
        x[r, b] = v
    if not len(y):
        return None
    order = np.random.default_rng(SEED).permutation(len(y))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 5 == 4
    scores = _descend(x[~held], y[~held], len(langs))
    logits = (x[held] if held.any() else x) @ scores
    truth = y[held] if held.any() else y
    temperature = min(np.geomspace(0.02, 20, 60), key=lambda t: -_log_softmax(logits / t)[np.arange(len(truth)), truth].mean())
    prob = np.exp(_log_softmax(logits / temperature))
    right = prob.argmax(1) == truth
    least = float(np.quantile(prob.max(1)[right], 1 - KEPT_RIGHT)) if right.any() else 1.0
    return {"langs": langs, "scores": (scores / temperature).astype(np.float32), "least": least, "held_back_accuracy": float(right.mean())}


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _descend(x: np.ndarray, y: np.ndarray, n_langs: int) -> np.ndarray:
    """Bucket x language scores: embeddings times softmax weights, by minibatch gradient descent."""
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.5, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.5, (DIM, n_langs)).astype(np.float32)
    scale = float(np.sqrt((x * x).sum(1).mean())) or 1.0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            r = order[at:at + BATCH]
            hidden = x[r] @ embed / scale
            wrong = np.exp(_log_softmax(hidden @ weight))
            wrong[np.arange(len(r)), y[r]] -= 1
            wrong /= len(r)
            step = x[r].T @ (wrong @ weight.T) / scale
            weight -= rate * 0.2 * hidden.T @ wrong
            embed -= rate * step
    return embed @ weight / scale


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (probability of the answer), accepted (score reaches the calibrated threshold)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), has_letter(text_col).alias("ok"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets, _ = utf8(batch.column(1))
            ok = np.asarray(batch.column(2).fill_null(False))
            best, prob = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, counts in subword_counts(data, offsets):
                z = counts.astype(np.float32) / np.maximum(1, counts.sum(1, keepdims=True)) @ m["scores"]
                p = np.exp(_log_softmax(z.astype(np.float64)))
                best[i:j], prob[i:j] = p.argmax(1), p.max(1)
            prob[~ok] = 0
            lang = [m["langs"][b] if k else UNKNOWN for b, k in zip(best, ok)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(prob), pa.array(ok & (prob >= m["least"]))], ["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on rows outside the held-out fold (crc32(id) mod 4 = 2) and predict every row."""
    fold = F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
    model = train(docs.filter(~fold), text_col, lang_col, id_col)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
