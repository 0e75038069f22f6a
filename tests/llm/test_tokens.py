"""Operators 12 and 13 against the tokenizers library and plain versions."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelens.llm import bpe, target_sampling

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["'s't're've'm'll'd", "''s 'S 'LL 'sx it's don't", "<|start<|endoftext|>of", "<|startoftext|>x<|endoftext|><|endoftext|>",
       "a" * 3000, "İstanbul ΣΑΣ ǅ Å Å é é", "각 가 각", "🎉🏽‍ x\x1cy\x85z", "12٣½Ⅷ!!'s", " \t\n", "", None, "ꟲ͸\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def odd_texts(seed=1, n=400):
    rng = random.Random(seed)
    alphabet = ["'s", "'t", "'re", "'ll", "'", "a", "T", "É", "é", " ", "\n", "9", "<|endoftext|>", "<|", "ς", "İ", "-", "你", "’", "the", "q"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(n)]


def codes(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_codec_equals_the_library(make_docs, small, library):
    texts = odd_texts() + [r["text"] for r in small[1]]
    docs = make_docs([(i // 2, t) for i, t in enumerate(texts)]).withColumn("ids", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("decoded", F.lit(2))
    want = Counter((i // 2, tuple(ids), text) for i, t in enumerate(texts) for ids, text in [codes(library, t)])
    got = bpe.encode(docs, WORD_BPE, decoded=True)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == want


def test_digests(make_docs, library):
    rows = [(1, "Hello wörld's end"), (2, None), (None, "x 1")]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(make_docs(rows), WORD_BPE).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in rows:
        ids, text = codes(library, t)
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert bpe.digests(make_docs(rows).filter("false"), WORD_BPE).collect() == []


def test_a_lexicon_of_other_texts_gives_the_same_ids(make_docs, library):
    """Few words in the lexicon, all others merged; special strings as ordinary text; decoding from a table of ids."""
    docs = make_docs(list(enumerate(t or "" for t in odd_texts(2, 100))))
    lexicon = bpe.compile_lexicon(make_docs([(1, "the the q q a")]), WORD_BPE, words=2)
    library.encode_special_tokens = True
    got = bpe.encode(docs, WORD_BPE, specials=False, lexicon=lexicon)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.ids for r in got.collect()} == {d: codes(library, t)[0] for d, t in texts.items()}
    assert {r.doc_id: r.decoded for r in bpe.decode(got, lexicon).collect()} == {d: codes(library, t)[1] for d, t in texts.items()}
    library.encode_special_tokens = False
    unknown = got.sparkSession.createDataFrame([(1, [320, None, 10**7, -1, 321]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(unknown, lexicon).collect()} == {1: f"{library.id_to_token(320)} {library.id_to_token(321)}", 2: ""}


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({w.encode() for w in ["a", "taps", "tap", "tops", "top", "äh", "x" * 40, "ps"]})
    arcs, final, root = bpe.minimal_automaton(words)
    language = {}

    def right(s):
        if s not in language:
            language[s] = frozenset({b""} if final[s] else set()) | {bytes([b]) + w for b, t in arcs[s].items() for w in right(t)}
        return language[s]
    assert right(root) == set(words)
    assert len({right(s) for s in range(len(arcs))}) == len(arcs)  # no two states with one right language
    a = bpe.double_array(arcs, final)
    for n, w in enumerate(words):
        s, total = root, 0
        for b in w:
            at = a["base"][s] + b
            assert a["check"][at] == s
            s, total = a["target"][at], total + a["add"][at]
        assert final[s] and total == n


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.compiled(public_tokenizers.path("byte_bpe_50k.json"), [])


def plain_resample(docs, target, share=5, least=20):
    """{doc_id: (n_features, weight, score, rank)} by definition."""
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def buckets(features):
        return [zlib.crc32(f.encode()) % 10000 for f in features]
    held = {d: runs(t) for d, t in docs}
    s, t = Counter(), Counter()
    for _, f in held.values():
        s.update(buckets(f))
    for x in target:
        t.update(buckets(runs(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = {}
    for d, (n, f) in held.items():
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(f))
        out[d] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n)
    order = sorted((d for d in out if out[d][3] >= least), key=lambda d: (-out[d][2], math.inf if d is None else d))
    rank = {d: r + 1 for r, d in enumerate(order[:len(order) * share // 100])}
    return {d: (*v[:3], rank.get(d)) for d, v in out.items()}


WORDY = [None, "", " .,; \x00\x7f", "A", "One TWO three", "x" * 5000 + " y " + "é" * 70 + " Z", "ÄÖ ÉÀ a1-b2_c3", "1 2 3 " * 50, "w " * 3000]


@pytest.mark.parametrize("share", [5, 40])
def test_resampling_equals_the_definition(make_docs, small, share):
    rows = [(i, t) for i, t in enumerate(WORDY)] + [(100 + r["doc_id"], r["text"]) for r in small[1]] + [(None, "no id " * 30)]
    target = ["three words here " * 5, None, "", small[1][3]["text"], "1 2 3"]
    docs = make_docs(rows).withColumn("rank", F.lit("clash")).withColumn("id", F.lit("clash"))
    aims = make_docs(list(enumerate(target)))
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in target_sampling.resample(docs, aims, share=share).collect()}
    assert got == plain_resample(rows, target, share)
    drawn = target_sampling.sample(docs, aims, share=share)
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.collect()} == {d for d, v in got.items() if v[3]}


def test_resampling_of_ties_repeats_and_empty_tables(make_docs):
    text = "one two three four five " * 4
    rows = [(i // 2, text) for i in range(40)]
    got = target_sampling.resample(make_docs(rows), make_docs([]), share=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21))
    want = plain_resample([(i, text) for i in range(20)], [], 50)
    assert len(got) == 40 and all(r.n_features == want[r.doc_id][0] for r in got)
    picked = [r.doc_id for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)]
    assert picked == sorted(picked, key=lambda d: (-next(r.score for r in got if r.doc_id == d), d))
    assert target_sampling.resample(make_docs([]), make_docs([(1, text)])).collect() == []


def test_long_texts_are_split_between_words(monkeypatch):
    monkeypatch.setattr(target_sampling, "BLOCK_BYTES", 50)
    text = ("ab " * 30 + "é" * 40 + "x" * 120 + ". q " + "ü1 " * 20).encode()
    splitter = target_sampling.Split(target_sampling.Regex(target_sampling.WORD), "removed", invert=True)
    starts, ends = target_sampling.word_spans(splitter, np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(starts, ends)] == [m.group().encode() for m in re.finditer(target_sampling.WORD, text.decode())]
