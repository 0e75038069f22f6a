"""Operator 11 against its definition."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100, k=5, low=80, high=100):
    """Counter of result rows, by definition; rows have distinct ids."""
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
          if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, x, label in ok:
        if a % every:
            continue
        score = [(sum(p * q for p, q in zip(x, v)), i, y == label) for i, v, y in ok if i != a and len(v) == len(x)]
        pos = sorted((s for s in score if s[2]), key=lambda s: (-s[0], s[1]))[:k]
        for p, i, _ in pos:
            neg = sorted((s for s in score if not s[2] and low * p <= 100 * s[0] <= high * p), key=lambda s: (-s[0], s[1]))[:k]
            out.update((a, i, r + 1, j, p, s) for r, (s, j, _) in enumerate(neg))
    return out


def cloud(seed, n, d, centres=6, labels=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(centres, size=n)] + 0.3 * rng.normal(size=(n, d))
    return [(i, (x[i] / np.linalg.norm(x[i])).tolist(), int(rng.integers(labels))) for i in range(n)]


def awkward():
    rows = cloud(1, 300, 16) + [(1000 + i, v, y) for i, v, y in cloud(2, 40, 5)]
    copy = rows[10][1]
    rows += [(2000 + i, list(copy), i % 2) for i in range(60)]  # ties
    rows += [(3000, [0.0] * 16, 0), (3001, [0.0] * 16, 1), (3100, [0.0] * 16, 1), (3200, [], 0), (3201, [], 0), (3202, [], 1),
             (3300, [-1.0] + [0.0] * 15, 2), (None, copy, 0), (3400, None, 1), (3500, copy, None), (3600, [None] * 16, 0),
             (3700, [float("nan")] * 16, 0), (3800, [float("inf")] * 16, 0), (-100, copy, 1), (4000, [1.0, 2.0, 3.0], 5), (4100, [50.0, -70.5, 3.0], 5), (4101, [40.0, -60.5, 3.0], 6)]
    random.Random(3).shuffle(rows)
    return rows


@pytest.mark.parametrize("tile,chunk", [(4096, 2048), (37, 3)])
def test_equals_the_definition(llm, monkeypatch, tile, chunk):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = awkward()
    df = llm.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("tile", F.lit(1)).withColumn("v", F.lit(2))
    got = Counter(tuple(r) for r in hard_negatives.mine(df.repartition(3), every=20).collect())
    assert got == plain(rows, every=20)


def test_other_windows_and_counts(llm):
    rows = cloud(7, 250, 70)
    got = Counter(tuple(r) for r in hard_negatives.mine(llm.createDataFrame(rows, SCHEMA), every=10, positives=3, negatives=7, low=30, high=90).collect())
    want = Counter()
    ok = {i: ([math.floor(256 * x) for x in v], y) for i, v, y in rows}
    for a in range(0, 250, 10):
        dot = {i: sum(p * q for p, q in zip(ok[a][0], v)) for i, (v, _) in ok.items() if i != a}
        pos = sorted((i for i in dot if ok[i][1] == ok[a][1]), key=lambda i: (-dot[i], i))[:3]
        for p in pos:
            neg = sorted((i for i in dot if ok[i][1] != ok[a][1] and 30 * dot[p] <= 100 * dot[i] <= 90 * dot[p]), key=lambda i: (-dot[i], i))[:7]
            want.update((a, p, r + 1, i, dot[p], dot[i]) for r, i in enumerate(neg))
    assert got == want


def test_repeated_ids_and_empty_table(llm):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [0.0, 1.0], 2), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2)]
    got = [tuple(r) for r in hard_negatives.mine(llm.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(100, 1, 1, 2, 256 * 256, 256 * 230)]
    assert hard_negatives.mine(llm.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("d", [1, 3, 64, 100])
def test_intervals_hold(d):
    rng = np.random.default_rng(d)
    x, y = rng.integers(-300, 300, (50, d)), rng.integers(-300, 300, (400, d))
    y[:50] = x + rng.integers(-5, 5, (50, d))
    y[60], x[7] = 0, 0
    centre, half = hard_negatives.Estimates(*hard_negatives.codes(y)).of(x)
    assert (np.abs(x @ y.T - centre) <= half).all()
    if d > 50:
        assert half.mean() < np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)).mean()
