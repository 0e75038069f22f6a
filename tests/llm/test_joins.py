"""Operators 1, 3, 5, 7 and 8 against brute force, on given and on awkward inputs."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm import decontaminate, lines, ngram_join, substrings, vectors
from tests.llm import brute


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=5):
    """A group of near copies beyond SMALL, several small groups, boilerplate, repeats, nulls and odd texts."""
    rng, rows = random.Random(seed), []
    whole, boiler = prose(rng, 90, 5000), prose(rng, 12)
    for i in range(70):
        w = list(whole)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    for i in range(100, 150):
        w = prose(rng, rng.randrange(6, 60), 5000)
        rows.append((i, " ".join(boiler + w)))
        rows.append((i + 1000, " ".join(boiler + w[:-1] + ["changed"])))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "One  TWO"), (2005, "a b c d e"),
             (2006, "a b c d e"), (2006, "a b c d e"), (None, "a b c d e"), (None, "lonely words of a row without id"), (2007, "K b c d e f")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", ["near", "given"])
def test_ngram_join_equals_brute_force(make_docs, small, rows):
    rows = near_copies() if rows == "near" else [(r["doc_id"], r["text"]) for r in small[1]]
    want = Counter((d, n, c if n else d) for (d, _), (n, c) in zip(rows, brute.jaccard_components(rows)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(make_docs(rows)).collect())
    assert got == want


def test_ngram_join_tiles_of_large_buckets(make_docs, monkeypatch):
    """With small buckets of two classes only, all links must come through leaders and tiles."""
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    rows = near_copies(6)
    want = Counter((d, n, c if n else d) for (d, _), (n, c) in zip(rows, brute.jaccard_components(rows)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(make_docs(rows)).collect()) == want


def test_one_of_each_keeps_columns_and_one_document(make_docs):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "something else that stands alone"), (4, None), (5, "")]
    docs = make_docs(rows).withColumn("component_id", F.lit("clash")).withColumn("class", F.lit(0))
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 5]


def test_empty_tables(make_docs, llm):
    docs = make_docs([(1, "x")]).filter("doc_id > 1")
    items = llm.createDataFrame([], "item_id long, text string")
    for df in (ngram_join.join(docs), decontaminate.contaminated(docs, items), lines.dedup_lines(docs), substrings.dedup_substrings(docs)):
        assert df.count() == 0
    assert vectors.dedup(llm.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert decontaminate.clean(make_docs([(1, "x")]), items).count() == 1


def vector_rows(seed=2):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            v = rng.normal(size=16)
            for _ in range(6):
                rows.append((i, [float(x) for x in np.float32(v + rng.normal(size=16) * 0.25)], label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, None, 0), (i + 3, [0.0] * 16, 0),
             (i + 4, [float("nan")] + [1.0] * 15, 0), (i + 5, [None] + [1.0] * 15, 0), (i + 6, [1.0, 0.0], 0), (i + 7, [2.0, 0.0], 0), (i + 8, [], 0), (i + 9, [float("inf")] * 16, 1)]
    return rows


def test_vector_dedup_equals_brute_force(llm):
    rows = vector_rows()
    ok = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    linked, n = [], [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    linked.append((i, j))
                    n[i] += 1
                    n[j] += 1
    want = Counter((r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, brute.groups([r[0] for r in rows], linked)))
    schema = "vec_id long, embedding array<float>, label int"
    got = vectors.dedup(llm.createDataFrame(rows, schema).withColumn("node", F.lit("clash")))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == want


def test_vector_index_recall():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(3000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    index = vectors.Index(u, 30)
    home, far, codes, error = index.code(u)
    np.maximum.at(index.radius, home, far + vectors.SLACK)
    near = u + rng.normal(size=u.shape) * 0.3 / np.sqrt(32)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    reach = np.sqrt(2 - 2 * vectors.MIN_COSINE)
    index_of = index.code(near)[0]
    close = np.einsum("ij,ij->i", u, near) >= vectors.MIN_COSINE
    probed = np.zeros((len(u), len(index.coarse)), bool)
    probed[index.probes(u, reach)] = True
    other = np.zeros_like(probed)
    other[index.probes(near, reach)] = True
    found = probed[np.arange(len(u)), index_of] | other[np.arange(len(u)), home]
    assert close.sum() > 1000 and found[close].mean() >= 0.99
    for c in range(5):  # looked-up distances are those to the coded vectors
        some = home == c
        assert (np.linalg.norm(u[:50, None] - u[some][None], axis=2) <= index.distances(u[:50], c, codes[some]) + error[some] + 1e-9).all()


def test_contaminated_equals_brute_force(make_docs, llm, small):
    bench = [r.asDict() for r in llm.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(1)
    items = [(b["item_id"], b["text"]) for b in bench] + [(9000, "tiny item"), (9001, None), (9002, ""), (None, "item without an id here at all")]
    rows = [(r["doc_id"], r["text"]) for r in small[1]]
    long = " ".join(prose(rng, 3000))
    rows += [(50000 + i, f"{long[:9000]} {b['text']} {long[9000:]}") for i, b in enumerate(bench[:10])]
    rows += [(60000, "tiny item"), (60001, "with a tiny item inside"), (60002, None), (60003, ""), (60004, bench[0]["text"]), (60004, bench[0]["text"]), (None, "Item without an id here at all")]
    want = Counter()
    sets = [(i, brute.shingles(t)) for i, t in items]
    for d, t in rows:
        s = brute.shingles(t)
        want.update((d, i, len(x), len(x & s)) for i, x in sets if x and 10 * len(x & s) >= 8 * len(x))
    docs, table = make_docs(rows), llm.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontaminate.contaminated(docs, table).collect()) == want
    dirty = {d for d, *_ in want}
    kept = decontaminate.clean(docs.withColumn("found", F.lit(1)), table)
    assert kept.columns[-1] == "found" and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - dirty


def test_contaminated_in_blocks(make_docs, llm, small, monkeypatch):
    items = llm.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = Counter(tuple(r) for r in decontaminate.contaminated(small[0], items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 400)
    assert Counter(tuple(r) for r in decontaminate.contaminated(small[0], items).collect()) == whole and whole


def python_chunks(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return [(int(k), data[a:b].tobytes(), int(n)) for _, num, start, end, _, filled in lines.document_chunks(data, np.array([0, len(data)])) for k, a, b, n in zip(num, start, end, filled)]


def test_line_dedup_equals_brute_force(make_docs, small):
    rng = random.Random(3)
    shared = [" ".join(prose(rng, 6)) for _ in range(40)]
    rows = [(r["doc_id"], r["text"]) for r in small[1]]
    rows += [(70000 + i, "\n".join([f"own {i}"] * (i % 3) + shared[:20 + i] + [f"end {i}"])) for i in range(15)]
    rows += [(80000, None), (80001, ""), (80002, "\n\n\n"), (80003, "single line"), (80004, "single line"), (80005, "\n".join(shared)), (80005, "\n".join(shared))]
    first = {}
    for d, t in sorted({r for r in rows if r[1]}):
        for k, c, n in python_chunks(t):
            assert n < 2 or first.setdefault(c, (d, k))
    want = Counter()
    for d, t in rows:
        if t:
            t = b"\n".join(c for k, c, n in python_chunks(t) if n < 2 or first[c] == (d, k)).decode()
        want[d, t] += 1
    got = lines.dedup_lines(make_docs(rows).withColumn("h", F.lit(1)).withColumn("removed", F.lit(2)))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert got.filter("n_removed_lines > 0").count() > 10


def runs_by_definition(rows):
    """Texts without the lines of every pair of neighbouring non-blank lines that stands at an earlier place."""
    first, out, key = {}, [], lambda r: (r[0] is not None, r[0] or 0)
    pairs = {}
    for d, t in sorted({r for r in rows if r[1]}, key=key):
        parts = t.split("\n")
        full = [k for k, x in enumerate(parts) if x.strip(" \t\n\v\f\r")]
        pairs[d, t] = [(a, b, tuple(parts[a:b + 1])) for a, b in zip(full, full[1:])]
        for a, b, p in pairs[d, t]:
            first.setdefault(p, (d, t, b, a))
    for d, t in rows:
        if t:
            gone = {k for a, b, p in pairs[d, t] if first[p][:2] != (d, t) or a > first[p][2] for k in range(a, b + 1)}
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append((d, t))
    return out


def test_line_runs_equal_the_definition(make_docs, small):
    rng = random.Random(11)
    fresh = lambda n: [" ".join(prose(rng, 6, 100000)) for _ in range(n)]
    rows = [(r["doc_id"], r["text"]) for r in small[1]]
    planted = {n: fresh(n) for n in range(2, 11)}
    for n, passage in planted.items():
        rows += [(70000 + 100 * n + i, "\n".join(fresh(1 + i) + passage + fresh(3 - i))) for i in range(3)]
    gap = ["one line", "", " ", "after blanks"]
    rows += [(80000, None), (80001, ""), (80002, "\n\n\n"), (80003, "single line"), (80004, "single line"), (None, "\n".join(gap + ["x"])), (80005, "\n".join(["y", *gap])),
             (80006, "one line\nafter blanks"), (80007, "same\nsame\nsame\nsame\nsame"), (80008, "twin\ntwin\ntwin"), (80009, "p\nq"), (80009, "p\nq"), (80010, "p\nq"), (80011, "\n".join(planted[6][2:5]))]
    got = lines.dedup_runs(make_docs(rows).withColumn("h", F.lit(1)).withColumn("removed", F.lit(2)))
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(runs_by_definition(rows))
    text = {r.doc_id: r for r in found}
    for n, passage in planted.items():  # every line of a passage goes, at every place but the first
        assert [text[70000 + 100 * n + i].n_removed_lines for i in range(3)] == [0, n, n]
        assert not set(passage) & set(text[70000 + 100 * n + 1].text.split("\n"))
    assert text[80007].text == "same\nsame" and text[80008].n_removed_lines == 0 and text[80005].text == "y"


def test_runs_of_sparser_boundaries(make_docs, monkeypatch):
    """With a larger divisor chunks are longer: nothing but shared runs goes, most of a long one does."""
    monkeypatch.setattr(lines, "RUN_DIVISOR", 2)
    monkeypatch.setattr(lines, "RUN_WINDOW", 2)
    rng = random.Random(12)
    fresh = lambda n: [" ".join(prose(rng, 6, 100000)) for _ in range(n)]
    passage = fresh(60)
    rows = [(i, "\n".join(fresh(5) + passage + fresh(5))) for i in range(3)]
    got = {r.doc_id: r for r in lines.dedup_runs(make_docs(rows)).collect()}
    assert got[0].n_removed_lines == 0 and got[1].n_removed_lines == got[2].n_removed_lines > 45
    assert all(set(t.split("\n")) - set(got[d].text.split("\n")) <= set(passage) for d, t in rows)


def test_chunk_boundaries_move_with_the_text():
    rng = random.Random(4)
    body = [" ".join(prose(rng, 5)) for _ in range(200)]
    a, b = "\n".join(body), "\n".join(["new line", *body[:100], "another", *body[100:]])
    one, two = ({c for _, c, _ in python_chunks(t)} for t in (a, b))
    assert len(one & two) >= len(one) - 6


def substring_rows():
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    shared, edge = letters(700), letters(199)
    rows = [(i, letters(rng.randrange(0, 300)) + shared[rng.randrange(0, 300):rng.randrange(350, 700)] + letters(rng.randrange(0, 300))) for i in range(40)]
    rows += [(100, edge), (101, "x" + edge), (102, "abc" * 400), (103, "abc" * 100), (104, None), (105, ""), (106, letters(5000)), (107, None)]
    own = letters(260)
    rows += [(108, own + letters(50) + own), (109, letters(3000)), (109, rows[0][1]), (None, rows[1][1]), (110, rows[2][1]), (110, rows[2][1])]
    return rows


def test_substring_dedup_equals_brute_force(make_docs):
    rows = substring_rows()
    want = Counter(brute.substring_dedup(rows))
    docs = make_docs(rows).withColumn("class", F.lit("clash")).withColumn("spans", F.lit(0))
    got = substrings.dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_substring_dedup_of_large_anchors(make_docs, monkeypatch):
    """Anchors with more than three contexts are counted string by string."""
    monkeypatch.setattr(substrings, "GROUP", 3)
    monkeypatch.setattr(substrings, "SMALL", 2)
    rows = substring_rows()
    from sitelens.llm.substrings import dedup_substrings
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(make_docs(rows)).collect()) == Counter(brute.substring_dedup(rows))


def test_substring_dedup_of_given_documents(small):
    docs, rows = small
    want = Counter(brute.substring_dedup([(r["doc_id"], r["text"]) for r in rows]))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()) == want


def test_suffix_sort_with_colliding_hashes(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    group = np.sort(np.array([rng.randint(0, 20) for _ in texts]))
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    for collide in (False, True):
        if collide:  # every second extension looks equal: byte verification must find it out
            honest = substrings.span_hash
            monkeypatch.setattr(substrings, "span_hash", lambda p, a, b: np.where((b - a) % 2 == 0, 0, honest(p, a, b)))
        order, common = substrings.suffix_sort(data, np.cumsum(size) - size, size, group)
        assert [(group[k], texts[k]) for k in order] == sorted(zip(group.tolist(), texts))
        assert all(common[k] == 0 or texts[order[k]][:common[k]] == texts[order[k - 1]][:common[k]] for k in range(len(order)))


def test_components_over_many_tasks(llm, monkeypatch):
    from sitelens.llm import graph
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(30)] + [(2000, 2000 + i) for i in range(1, 50)]
    ids = sorted({x for p in pairs for x in p})
    at = {d: i for i, d in enumerate(ids)}
    want = dict(zip(ids, brute.groups(ids, [(at[a], at[b]) for a, b in pairs])))
    for per_task in (500_000, 40):
        monkeypatch.setattr(graph, "LINKS_PER_TASK", per_task)
        got = {r.node: r.component for r in graph.components(llm.createDataFrame(pairs, "a long, b long")).collect()}
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        assert set(got) == linked
        assert len({(want[d], got[d]) for d in got}) == len({want[d] for d in got}) == len(set(got.values()))
