"""Operators 2, 4, 6, 9, 10 and the pipeline: brute force, round trips and held-out accuracy."""
import base64
import hashlib
import json
import math
import os
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import decontaminate, language, lines, mixing, ngram_join, quality, secrets, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


# ---- secrets ----
def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def integer(v):
    return der(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))


def rsa_key():
    p, q = (1 << 521) - 1, (1 << 607) - 1
    return der(0x30, b"".join(integer(v) for v in (0, p * q, 65537, p * 3, p, q, p - 2, q - 2, 12345)))


def ssh_key():
    s = lambda b: struct.pack(">I", len(b)) + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + struct.pack(">I", 1) + s(s(b"ssh-ed25519") + s(b"k" * 32)) + s(b"p" * 128)


def token(head):
    part = lambda v: base64.urlsafe_b64encode(v).rstrip(b"=").decode()
    return f"{part(json.dumps(head).encode())}.{part(b'{\"sub\": 1}')}.{part(b's' * 32)}"


def test_headers_that_begin_with_a_blank_or_a_line_break(make_docs):
    part = lambda v: base64.urlsafe_b64encode(v).rstrip(b"=").decode()
    heads = [b'{"alg": "HS256"}', b'{ "alg": "HS256"}', b'{\n "alg": "HS256"}', b'{\t"alg": "HS256"}', b'{\r\n"alg": "HS256"}', b'["alg"]', b'{ "typ": 1}']
    rows = [(i, f"they say {part(h)}.{part(b'{ }')}.{part(b's' * 32)} there.") for i, h in enumerate(heads)]
    assert [r.n_signed_token for r in sorted(secrets.scan_secrets(make_docs(rows)).collect(), key=lambda r: r.doc_id)] == [1] * 5 + [0] * 2


def test_structural_confirmation(make_docs):
    rsa, ssh = base64.b64encode(rsa_key()).decode(), base64.b64encode(ssh_key()).decode()
    pem = "\n".join(rsa[i:i + 64] for i in range(0, len(rsa), 64))
    bad = base64.b64encode(rsa_key()[:-3] + b"\x7f\x05\x01").decode()
    rows = [(1, f"é key: {rsa} end"), (2, f"-----BEGIN RSA PRIVATE KEY-----\n{pem}\n-----END RSA PRIVATE KEY-----"), (3, f"{ssh}\nnext words"), (4, f"x {token({'alg': 'HS256'})} y"),
            (5, f"x {token({'typ': 'none'})} y"), (6, bad), (7, rsa_key().hex()), (8, "a" * 5000), (9, None), (10, ""), (11, rsa_key().hex()[:-8]), (12, base64.b64encode(os.urandom(600)).decode())]
    got = {r.doc_id: r for r in secrets.scan_secrets(make_docs(rows)).collect()}
    assert [(r.n_der_key, r.n_ssh_key, r.n_signed_token) for r in (got[k] for k in range(1, 13))] == [(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)] + [(0, 0, 0)] * 2 + [(1, 0, 0)] + [(0, 0, 0)] * 5
    assert got[1].spans.endswith(f"der_key:7:{7 + len(rsa)}")
    assert f"ssh_key:0:{len(ssh)}" in got[3].spans and got[9].spans == ""


def test_keys_in_other_forms(make_docs):
    """Escaped breaks, keys after other base64 characters, whole PEM files in base64, hex of either case."""
    text = base64.b64encode(rsa_key()).decode()
    body = [text[i:i + 64] for i in range(0, len(text), 64)]
    pem = ["-----BEGIN RSA PRIVATE KEY-----", *body, "-----END RSA PRIVATE KEY-----", ""]
    ssh = base64.b64encode(ssh_key()).decode()
    whole = base64.b64encode("\n".join(pem).encode()).decode()
    rows = [(1, json.dumps({"é": "\n".join(pem)})), (2, json.dumps(json.dumps({"k": "\r\n".join(pem)}))), (3, f"key/{text} end"), (4, f"data: {whole}\n"),
            (5, "\n".join(whole[i:i + 76] for i in range(0, len(whole), 76))), (6, f"0x{rsa_key().hex().upper()}"), (7, "ff" + rsa_key().hex()), (8, "key+" + ssh),
            (9, " +\n  ".join(f'"{x}\\n"' for x in pem[:-1])), (10, f"key/{text[:-12]}"), (11, "M" * 4000 + "MIIE" * 1000), (12, "30" * 2000)]
    got = {r.doc_id: r for r in secrets.scan_secrets(make_docs(rows)).collect()}
    assert [(r.n_der_key, r.n_ssh_key) for r in (got[k] for k in range(1, 13))] == [(1, 0)] * 7 + [(0, 1), (1, 0)] + [(0, 0)] * 3
    assert f"der_key:4:{4 + len(text)}" in got[3].spans and f"der_key:2:{2 + 2 * len(rsa_key())}" in got[6].spans
    s, e = (int(x) for x in got[1].spans.split("der_key:")[1].split(",")[0].split(":"))
    assert rows[0][1].encode().decode()[s:e].replace("\\n", "") == text


def test_base_spans_equal_brute_force(make_docs, small):
    odd = ["password=abcdef token=token:abcdefgh", "PASSWORD : 'x1y2z3'", "ſecret=abcdefg", "apikey=\"abc\" api_key=abcdefé", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 11, "f" * 24 + "é" + "0" * 23, "token=" + "a" * 100000, "key=x"]
    rows = [(r["doc_id"], r["text"]) for r in small[1]] + [(90000 + i, t) for i, t in enumerate(odd)] + [(1, "f" * 30), (1, "f" * 30), (None, "token=abcdefgh"), (2, None), (3, "")]
    want = Counter()
    for d, t in rows:
        spans = brute.base_spans(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want[d, *(sum(k == q for _, k, _ in spans) for q in range(3)), hashlib.sha256(said.encode()).hexdigest()] += 1
    got = secrets.scan_secrets(make_docs(rows).withColumn("spans", F.lit(0)))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.collect()) == want


# ---- mixing ----
def edf(a):
    """Slot by slot, exact fractions: the source of each slot of a period."""
    period, done, out = sum(a.values()), Counter(), []
    for t in range(period):
        open_ = [(-(-(done[s] + 1) * period // a[s]), s) for s in sorted(a) if done[s] * period // a[s] <= t]
        _, s = min(open_)
        done[s] += 1
        out.append(s)
    return out


def test_mix_follows_the_schedule_and_keeps_every_row(llm, make_docs):
    rng = random.Random(1)
    rows = [(i, f"t{i}", None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(5, "t5", None, "a"), (None, "n", None, "b"), (None, None, None, "zero")]
    docs = make_docs(rows).withColumn("a", F.lit(1)).withColumn("slots", F.lit("clash"))
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, mixing.NULL_SOURCE: 1.0}
    out = mixing.mix(docs, weights, text_col="text", block_rows=4, period=40)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = sorted(out.collect(), key=lambda r: r.mix_position)
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    assert len({r.mix_position for r in got}) == len(got) and got[-1].source == "zero"
    a = {r.source: r.a for r in mixing.integer_weights(llm.createDataFrame(list(weights.items()), "source string, weight double"), F.lit(40)).collect()}
    order, seen = edf(a), {r.mix_slot: r.mix_source for r in got if r.source != "zero"}
    first_end = min(max(r.mix_slot for r in got if r.mix_source == s) for s in a)
    assert all(seen[t] == order[t % 40] for t in range(first_end))
    count = Counter()
    for t in range(first_end):
        count[seen[t]] += 1
        assert all(abs(count[s] - Fraction((t + 1) * a[s], 40)) < 1 for s in a)


@pytest.mark.parametrize("given", [False, True])
def test_exact_mix_stays_within_one_block_of_the_weights(make_docs, given):
    """20 sources, one of a third of the rows or of weight 0.9: windows and counts by the weights as fractions."""
    sizes = {f"s{i:02}": 200 + 13 * i for i in range(19)} | {"big": 3000}
    rows = [(1000 * i + k, f"t{k}", None, s) for i, (s, n) in enumerate(sizes.items()) for k in range(n)] + [(999999, "n", None, None)]
    weights = {s: 0.9 if s == "big" else 0.1 / 19 for s in sizes} if given else None
    got = mixing.mix(make_docs(rows), weights, text_col="text", block_rows=3, exact=True).select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_position").collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and len({r.mix_position for r in got}) == len(got) == len(rows)
    weight = {s: Fraction(w) for s, w in (weights or {s: math.sqrt(n) for s, n in (sizes | {mixing.NULL_SOURCE: 1}).items()}).items()}
    share = {s: w / sum(weight.values()) for s, w in weight.items()}
    slots = {(r.mix_source, r.mix_block): r.mix_slot for r in got if r.mix_source in share}
    assert len(set(slots.values())) == len(slots)
    assert all(math.floor(j / share[s]) <= t < math.ceil((j + 1) / share[s]) for (s, j), t in slots.items())
    order, count = {t: s for (s, _), t in slots.items()}, Counter()
    ends = {s: max(t for (x, _), t in slots.items() if x == s) for s in share}
    for t in range(max(ends.values()) + 1):
        count[order.get(t)] += 1
        assert all(abs(count[s] - (t + 1) * share[s]) < 1 for s in share if t <= ends[s])


def test_exact_mix_of_nothing(make_docs):
    assert mixing.mix(make_docs([(1, "x", None, "s")]).filter("doc_id > 1"), exact=True).count() == 0


def test_mix_of_nothing(make_docs):
    assert mixing.mix(make_docs([(1, "x", None, "s")]).filter("doc_id > 1")).count() == 0


# ---- toxicity, quality, language ----
def test_toxicity_on_held_out_documents(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) > 0.9
    assert np.mean([r.predicted for r in got if r.toxic == 0]) < 0.03
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_equals_plain_kneser_ney(make_docs, llm, monkeypatch):
    """Models by their formulas, n-gram by n-gram, and the log ratios of odd texts, with few contexts broadcast and most joined."""
    monkeypatch.setattr(toxicity, "FREQUENT_CONTEXTS", 20)
    rng = random.Random(5)
    some = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, rng.choice(" 1-").join(rng.choice(some[:40 if i % 2 else 60]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "12 !"), (None, "abc abc"), (203, "a" * 5000), (204, "zzz " * 300 + "quite unknown words"), (3, "copy of an id"), (205, "ab cab " * 400)]
    labels = [(i, i % 2) for i in range(120)]
    docs, given = make_docs(rows), llm.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    toxic = dict(labels)
    counted = [(text, toxic[i]) for i, text in rows if i in toxic and zlib.crc32(str(i).encode()) % 5 not in (0, 4)]
    plain = brute.KneserNey(counted)
    model = {(r.context, s): v for r in toxicity.fit(docs, given).collect() for s, v in [*r.known.items(), (None, r.spare)]}
    assert model.keys() == plain.ratio.keys() and all(math.isclose(model[k], plain.ratio[k], abs_tol=1e-9) for k in model)
    got = Counter((r.doc_id, round(r.mean_log_ratio, 6), round(r.top_word, 6), round(r.top_words, 6)) for r in toxicity.score_toxicity(docs, given).collect())
    assert got == Counter((i, *(round(v, 6) + 0.0 for v in plain.features(text))) for i, text in rows)


def test_models_without_labels_and_odd_rows(make_docs, llm):
    rows = [(1, None), (2, ""), (3, "!!! 123"), (3, "!!! 123"), (None, "words of a row"), (4, "word " * 50000)]
    docs = make_docs(rows).withColumn("label", F.lit("clash")).withColumn("toxic", F.lit(9))
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter((r.doc_id, r.score, r.predicted) for r in toxicity.score_toxicity(docs, none).collect()) == Counter((d, 0.0, 0) for d, _ in rows)
    assert quality.keep(docs, none).columns == docs.columns and quality.keep(docs, none).count() == len(rows)
    assert all(r.lang_pred == "und" for r in language.identify(docs).collect())
    labels = llm.createDataFrame([(1, None, 1), (4, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.select(docs, labels).count() == toxicity.score_toxicity(docs, labels).count() == len(rows)


def test_quality_weights_and_draw_equal_brute_force(llm):
    docs, labels = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    grams = {}
    for d, t in rows.items():
        data = np.frombuffer(t.encode(), np.uint8)
        grams[d] = np.concatenate([b for *_, b in quality.ngram_buckets(data, np.array([0, len(data)]))])
    count = lambda ids: np.bincount(np.concatenate([grams[d] for d in ids]), minlength=quality.BUCKETS).astype(float)
    ratio = quality._weights(count(rows), count(d for d in rows if label.get(d) == 1))
    weight = {d: ratio[g].sum() for d, g in grams.items()}
    got = {r.doc_id: r for r in quality.select(docs, labels).collect()}
    assert all(abs(got[d].weight - weight[d]) < 1e-6 * max(1, abs(weight[d])) for d in rows)
    level = quality.separating_level(np.array([weight[d] for d in label if d in rows]), np.array([label[d] == 1 for d in label if d in rows]))
    k = sum(got[d].weight >= level for d in rows)
    best = sorted((r.key for r in got.values()), reverse=True)[:k]
    assert {d for d in rows if got[d].kept} == {d for d in rows if got[d].key >= best[-1]}
    assert np.mean([got[d].kept for d in label if label[d] == 1]) > 0.99
    assert np.mean([got[d].kept for d in label if label[d] == 0]) < 0.05


def test_kth_largest(llm):
    values = [1.5, -2.0, 1.5, 7.25, 1e-12, 3.0, 3.0, 3.0]
    df = llm.createDataFrame([(v,) for v in values], "key double")
    assert [quality.kth_largest(df, "key", k) for k in range(0, 9)] == [None, *sorted(values, reverse=True)]


def test_language_on_held_out_documents(llm, make_docs):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.97
    assert np.mean([r.accepted for r in got if r.held_out]) > 0.9
    model = language.train(docs.filter("doc_id % 3 = 0"))
    odd = make_docs([(1, None), (2, ""), (3, "12 ... 45"), (4, "the of and to in"), (5, "the of and to in")]).withColumn("score", F.lit(1))
    out = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred == out[5].lang_pred == "en"
    assert model["held_back_accuracy"] > 0.95


def test_every_language_is_learned(make_docs):
    """Three hundred languages of two words each, also those with few rows."""
    rows = [(1000 * k + i, " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}zq"] * 12), f"l{k:03}", None) for k in range(300) for i in range(10)]
    model = language.train(make_docs(rows))
    assert model["langs"] == [f"l{k:03}" for k in range(300)]


def test_scores_equal_a_plain_average_and_softmax(make_docs, small):
    """Embeddings averaged over a text's subwords, a linear layer and softmax, text by text."""
    model = language.train(small[0])
    texts = [r["text"] for r in small[1] if r["text"]][:20]
    got = {r.doc_id: r for r in language.predict(make_docs(list(enumerate(texts))), model).collect()}
    for d, text in enumerate(texts):
        raw = text.encode()
        (_, _, counts), = list(language.subword_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        logits = sum(n / counts[0].sum() * model["scores"][b].astype(float) for b, n in enumerate(counts[0]) if n)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[d].lang_pred == model["langs"][int(p.argmax())] and abs(got[d].score - p.max()) < 1e-4


# ---- pipeline ----
def test_pipeline_equals_its_stages_by_brute_force(llm):
    docs, labels, bench = (llm.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    names = [f for f, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {r.doc_id for r in quality.select(docs, labels).filter("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    rows = {r.doc_id: r.text for r in lines.dedup_runs(docs.filter(F.col("doc_id").isin(list(rows)))).collect()}
    parts = brute.jaccard_components(list(rows.items()))
    rows = {d: t for (d, t), (n, c) in zip(rows.items(), parts) if n == 0 or c == d}
    items = [s for s in (brute.shingles(r.text) for r in bench.collect()) if s]
    rows = {d: t for d, t in rows.items() if not any(10 * len(s & brute.shingles(t)) >= 8 * len(s) for s in items)}
    out = corpus_pipeline.run(llm, "/root/testdata/sf0.001")
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {d: (t, len(t)) for d, t in rows.items()}
    assert out.columns[:5] == docs.columns
