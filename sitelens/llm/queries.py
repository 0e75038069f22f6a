"""Registered queries of the training-data operators, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from sitelens.llm import bpe as op12
from sitelens.llm import decontaminate as op5
from sitelens.llm import hard_negatives as op11
from sitelens.llm import language as op10
from sitelens.llm import lines as op7
from sitelens.llm import mixing as op4
from sitelens.llm import ngram_join as op1
from sitelens.llm import quality as op9
from sitelens.llm import secrets as op2
from sitelens.llm import substrings as op8
from sitelens.llm import target_sampling as op13
from sitelens.llm import toxicity as op6
from sitelens.llm import vectors as op3
from sitelens.llm.common import setup, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(setup(spark), sf_dir)
    return fn


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.identify(table(spark, sf_dir, "documents"))


@query
def op9_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op4.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), exact=True)
    return mixed.select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_position")


ORACLES["op4_pfair_mix"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, 'null_source') AS mix_source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT mix_source, count(*) AS n FROM d GROUP BY 1),
o AS (SELECT list(mix_source ORDER BY mix_source) AS names, list(sqrt(n) ORDER BY mix_source) AS weight, list(ceil(n / 8) ORDER BY mix_source) AS blocks FROM n),
p AS (SELECT *, list_reduce(list_prepend(0.0::DOUBLE, weight), lambda a, x: a + x) AS total FROM o),
q AS (SELECT names, blocks, [greatest(1, CAST(floor(x / total * 4503599627370496.0::DOUBLE) AS BIGINT)) FOR x IN weight] AS w FROM p),
r AS (SELECT names, blocks, [w[k] + CASE WHEN k = list_position(w, list_max(w)) THEN 4503599627370496 - CAST(list_sum(w) AS BIGINT) ELSE 0 END FOR k IN range(1, len(w) + 1)] AS w FROM q),
run AS (SELECT *, CAST(list_max([ceil(blocks[k] * (4503599627370496.0::DOUBLE / w[k])) FOR k IN range(1, len(w) + 1)]) AS BIGINT) + 1 AS slots FROM r),
sim(t, lag, pick) AS (
  SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN names], CAST(NULL AS BIGINT) FROM run
  UNION ALL
  SELECT t + 1, [lag[k] + w[k] - CASE WHEN k = pick THEN 4503599627370496 ELSE 0 END FOR k IN range(1, len(w) + 1)], pick
  FROM (SELECT t, lag, w, list_position(due, list_min(due)) AS pick
        FROM (SELECT t, lag, w, [CASE WHEN lag[k] + w[k] > 0 THEN (4503599627370496 - lag[k] + w[k] - 1) // w[k] ELSE 9223372036854775807 END FOR k IN range(1, len(w) + 1)] AS due
              FROM sim, run WHERE t < slots))),
slots AS (SELECT names[pick] AS mix_source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM sim, run WHERE pick IS NOT NULL),
rows_of AS (SELECT doc_id, mix_source, row_number() OVER (PARTITION BY mix_source ORDER BY h, doc_id NULLS FIRST) - 1 AS n FROM d)
SELECT doc_id, mix_source, CAST(n // 8 AS BIGINT) AS mix_block, CAST(slot AS BIGINT) AS mix_slot, CAST(slot * 8 + n % 8 AS BIGINT) AS mix_position
FROM rows_of JOIN slots USING (mix_source) WHERE j = n // 8
"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Distinct five-word shingles of a text column, as an SQL expression over its list of words.
WORDS_SQL = "list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SHINGLES_SQL = "CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

ORACLES["op5_decontaminate"] = f"""
WITH i AS (SELECT item_id, {SHINGLES_SQL} AS s FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark)),
d AS (SELECT doc_id, unnest({SHINGLES_SQL}) AS x FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
p AS (SELECT item_id, len(s) AS item_shingles, unnest(s) AS x FROM i)
SELECT doc_id, item_id, item_shingles, count(*) AS shared FROM p JOIN d USING (x)
GROUP BY doc_id, item_id, item_shingles HAVING count(*) * 10 >= 8 * item_shingles
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.join(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.dedup(table(spark, sf_dir, "embeddings"))


ORACLES["op3_vector_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(src, dst) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.src, l.b FROM reach r JOIN link l ON l.a = r.dst)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT src, min(dst) AS component_id FROM reach GROUP BY src) c ON c.src = v.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id
"""


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op11.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""


@query
def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_target_resample"] = r"""
WITH tab AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
words AS (
  SELECT 0 AS part, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT part, id, len(w) AS n_words, w || [w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, len(w) - 1)] AS f FROM words),
each AS (SELECT part, id, unnest(f) AS f FROM runs),
counted AS (SELECT part, id, f, count(*) AS n FROM each GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce([4294967295] || [CAST('0x' || substr(hex(f), 2 * k - 1, 2) AS BIGINT) FOR k IN range(1, strlen(f) + 1)],
         lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), tab),
hist AS (SELECT bucket, sum(n) FILTER (part = 0) AS s, sum(n) FILTER (part = 1) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS big_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS big_t FROM hist),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000)) / ((coalesce(s, 0) + 1.0::DOUBLE) * (big_t + 10000)))) AS BIGINT) AS g FROM hist, total),
weighed AS (SELECT id, sum(n * g) AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE part = 0 GROUP BY id),
scored AS (
  SELECT r.id AS doc_id, n_words, CAST(len(f) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || r.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM runs r LEFT JOIN weighed w ON w.id = r.id WHERE part = 0),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank, n_words
FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op1_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SHINGLES_SQL} AS s FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
x AS (SELECT doc_id, unnest(s) AS shingle FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT p.a, p.b FROM p JOIN d e ON e.doc_id = p.a JOIN d f ON f.doc_id = p.b
  WHERE 100 * p.n >= 80 * (len(e.s) + len(f.s) - p.n)),
reach(src, dst) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.src, l.b FROM reach r JOIN link l ON l.a = r.dst)
SELECT d.doc_id, len(d.s) AS n_shingles, min(r.dst) AS component_id FROM d JOIN reach r ON r.src = d.doc_id GROUP BY d.doc_id, len(d.s)
"""
