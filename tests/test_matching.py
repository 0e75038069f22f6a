"""Fingerprint matching and scoring on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.operators import evidence as E
from sitelens.operators import implies as I
from sitelens.operators import match as M
from sitelens.operators import domains
from sitelens.operators import prefilter as PF
from sitelens.operators import score as S
from sitelens.plans.detect import localize
from sitelens.sources import rules as R


def _tech(spark, rules, raw):
    t = S.score(raw, rules.rules)
    return {r["tech_key"]: r for r in I.resolve_implies(t, rules.rules, rules.walk).collect()}


def test_header_version_and_boost(spark, rules):
    ev = spark.createDataFrame([(1, "server", "nginx/1.25.3")], "page_id long, key_norm string, value string")
    out = _tech(spark, rules, M.match_keyed(ev, rules.patterns, "header"))
    assert out["nginx"]["version"] == "1.25.3"
    assert out["nginx"]["confidence"] == 1.0            # 0.9 + 0.1 version
    assert out["nginx"]["evidence"][0]["key"] == "Server"  # the rule's own key casing


def test_meta_and_html_with_implies(spark, rules):
    pages = spark.createDataFrame(
        [(1, "https://a.example.com/", '<html><head><meta name="generator" content="WordPress 6.4.2"></head>'
                                       '<body><link href="/wp-content/x.css"></body></html>')],
        "page_id long, url string, html string")
    meta = E.meta_tags(pages).select("page_id", F.col("key").alias("key_norm"), F.col("content").alias("value"))
    raw = M.match_keyed(meta, rules.patterns, "meta").unionByName(M.match_html(pages, rules.patterns))
    out = _tech(spark, rules, raw)
    assert out["wordpress"]["version"] == "6.4.2"
    assert out["wordpress"]["confidence"] == 1.0        # 0.85 + 0.1 sources + 0.1 version, capped
    assert out["php"]["confidence"] == 0.6 and out["php"]["implied"]
    assert out["mysql"]["evidence"][0]["matched"] == "Implied by WordPress"


def test_js_globals(spark, rules):
    js = spark.createDataFrame([(1, 0, "window.React", "function"), (1, 1, "window.React?.version", "18.2.0")],
                               "page_id long, pos int, key string, value string")
    out = _tech(spark, rules, M.match_js_globals(js, rules.patterns))
    assert out["react"]["version"] == "18.2.0" and out["react"]["confidence"] == 0.9


def test_html_evidence_always_ends_with_dots_and_cycle_raises(spark, rules):
    pages = spark.createDataFrame([(7, "https://x.example.org/", "<p>track(7)</p>")], "page_id long, url string, html string")
    out = _tech(spark, rules, M.match_html(pages, rules.patterns))
    ev = out["tracker"]["evidence"]
    assert ev[0]["matched"] == "track(7)..."
    # tracker -> tag-host -> loop-a -> loop-b -> tracker: a weak direct match is raised once
    assert out["tracker"]["confidence"] == 0.6
    assert ev[-1]["matched"] == "Implied by Loop B"
    assert out["loop-b"]["evidence"][0]["matched"] == "Implied by Loop A"


def test_script_substring_beats_regex(spark, rules):
    vals = spark.createDataFrame([(1, 0, 0, "https://cdn.example.com/jquery-3.6.0.min.js"),
                                  (1, 0, 1, "https://cdn.jsdelivr.net/npm/x.js")],
                                 "page_id long, grp int, pos int, value string")
    rows = {r["tech_key"]: r for r in M.match_scripts(vals, rules.patterns).collect()}
    assert rows["jquery"]["version"] == "3.6.0"
    assert rows["jsdelivr"]["version"] is None and rows["jsdelivr"]["matched"].startswith("https://cdn.jsdelivr")


def test_prefilter_equals_brute_force(spark, rules):
    """The literal-prefiltered join returns exactly what a plain nested loop returns."""
    pages = E.page_source(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    fast = M.match_html(pages, rules.patterns).select("page_id", "tech_key", "pos", "matched", "version")
    p = rules.patterns.filter("src = 'html'")
    slow = pages.join(F.broadcast(p), F.regexp_like(F.col("html"), F.concat(F.lit("(?iu)"), F.col("pattern")))) \
        .select("page_id", "tech_key", "pos")
    assert sorted(map(tuple, fast.select("page_id", "tech_key", "pos").collect())) == \
        sorted(map(tuple, slow.collect()))


def generated_rules(n=300, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["foo", "bar", "lib", "wp", "q", "app-v", "Iis", "K", r"\d+", "[a-c]", ".", "x?", "é", r"\.js"])

    def pattern(depth=0):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(5 if depth < 2 else 2)
            parts.append(word() if kind < 3 else f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})" if kind == 3 else f"(?:{pattern(depth + 1)}){rng.choice(['', '?', '+', '{2}'])}")
        return "".join(parts)
    return sorted({pattern() for _ in range(n)})


def generated_texts(n=120, seed=5):
    rng = random.Random(seed)
    bits = ["foo", "BAR", "lib", "wp", "q", "App-V", "\u0130\u0130S", "iis", "\u212a", "7", "b", " ", "x", "É", ".js", "ſ", "-"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("bound", [2_000_000, 10])
def test_literal_queries_equal_brute_force_on_generated_rules(spark, monkeypatch, bound):
    """Alternations, optional parts and folding characters; also with the literals in many shards.  No nested loop."""
    monkeypatch.setattr(PF, "MAX_BROADCAST_LITERALS", bound)
    patterns, texts = generated_rules(300 if bound > 10 else 25), generated_texts()
    pats = localize(R.analyzed(spark.createDataFrame(list(enumerate(patterns)), "pid long, pattern string")).filter("valid"))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cond = F.regexp_like("t", F.concat(F.lit("(?iu)"), F.col("rx")))
    join = PF.regex_join(rows, "t", pats, PF.all_of(F.col("clauses")), cond)
    assert "NestedLoop" not in join._jdf.queryExecution().toString() and "CartesianProduct" not in join._jdf.queryExecution().toString()
    got = {(r.i, r.pattern) for r in join.select("i", "pattern").collect()}
    assert got == {(i, p) for p in patterns for i, t in enumerate(texts) if re.search(p, t, re.I)}
    hits = rows.select("i", F.explode(PF.literal_shards(pats, PF.all_of(F.col("clauses")))[0]("t")))
    assert hits.count() < 0.8 * len(patterns) * len(texts)  # the filter filters


def test_a_rule_set_of_odd_patterns_ends_no_job(spark):
    """Patterns that Java refuses or reads otherwise, in every kind of rule."""
    odd = ["(?P<v>nginx)/(?P<n>[0-9.]+)", "a{1,3000000000}", "(", "[", "(?m:^b)", r"\bé\b", "(x)?(?(1)a|b)", "nginx$", "(?s:a.b)c", "foo[&&]", "(?-i:Nginx)"]
    rows = [(i, f"t{i}", f"T{i}", {"Server": p}, [p], [p]) for i, p in enumerate(odd)]
    rules = spark.createDataFrame(rows, "ord int, tech_key string, name string, headers map<string,string>, scripts array<string>, html array<string>")
    empty = F.create_map().cast("map<string,string>")
    rules = rules.withColumns({"category": F.lit("web-servers"), "confidence": F.lit(0.9), "cookies": empty, "meta": empty, "js_globals": empty})
    good, bad = R.compile_rules(rules)
    assert {r.pattern for r in bad.collect()} == {"a{1,3000000000}", "(", "[", "(x)?(?(1)a|b)"}
    values = ["nginx/1.2", "x\nb", "é", "a\nbc", "foo&", "Nginx", "NGINX\n", "a b", "aé"]
    pages = spark.createDataFrame(list(enumerate(values)), "page_id int, html string")
    got = {(r.page_id, r.pattern) for r in M.match_html(pages, good).collect()}
    ok = [p for p in odd if p not in {r.pattern for r in bad.collect()}]
    assert got == {(i, p) for p in ok for i, v in enumerate(values) if re.search(p, v, re.I)}
    headers = spark.createDataFrame([(f"s{i}", "server", v) for i, v in enumerate(values)], "subdomain string, key_norm string, value string")
    techs = {r.subdomain: r.detected_tech for r in domains.classify_by_headers(headers, domains.header_rules(rules)).collect()}
    assert techs["s0"] == "T0" and techs["s2"] == "T5"


def test_quarantine(spark, rules):
    assert [r["tech_key"] for r in rules.quarantine.collect()] == ["broken"]


def _first_impliers(found, order, edges):
    """By definition: of all edges out of reached nodes, the one whose node has the smallest (depth, root's order, way of positions)."""
    label = {k: (0, order[k], ()) for k in found if k in edges}
    while True:
        longer = {}
        for k, (depth, root, way) in label.items():
            for pos, (node, *_) in enumerate(edges[k]):
                if node in edges:
                    longer[node] = min(longer.get(node, (1 << 30,)), (depth + 1, root, (*way, pos)))
        better = {k: v for k, v in longer.items() if v < label.get(k, (1 << 30,))}
        if not better:
            break
        label |= better
    first = {}
    for k, at in label.items():
        for pos, (node, via, raw) in enumerate(edges[k]):
            first[node] = min(first.get(node, ((1 << 30,),)), ((*at[:2], at[2], pos), via, raw))
    return [(node, via, raw) for node, (_, via, raw) in sorted(first.items(), key=lambda x: x[1][0])]


def test_implies_walk_finds_the_first_implier():
    rng = random.Random(3)
    for _ in range(300):
        nodes = [f"t{i}" for i in range(rng.randint(2, 9))]
        edges = {k: [(d, f"name of {k}", d.upper()) for d in rng.choices([*nodes, "no rule"], k=rng.randint(1, 4))] for k in nodes if rng.random() < 0.8}
        order = {k: i for i, k in enumerate(rng.sample(sorted(edges), len(edges)))}
        found = rng.sample(nodes, rng.randint(0, len(nodes)))
        assert I.reached(found, order, edges) == _first_impliers(found, order, edges)


def test_a_hub_of_many_rules(spark):
    n = 20_000
    rules = spark.range(n).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("t"), "id").alias("tech_key"), F.concat(F.lit("T"), "id").alias("name"), F.lit("c").alias("category"),
                                  F.when(F.col("id") == 0, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.concat(F.lit("t"), i.cast("string")))).otherwise(F.array(F.lit("T0"))).alias("implies"))
    none = F.array().cast("array<struct<source:string,key:string,matched:string,pattern:string>>")
    tech = spark.range(3).select(F.col("id").alias("page_id"), F.lit("t7").alias("tech_key"), F.lit(7).alias("ord"), F.lit("T7").alias("name"), F.lit("c").alias("category"),
                                 F.lit("1").alias("version"), F.lit(0.9).alias("confidence"), F.lit(1).alias("n_sources"), none.alias("evidence"))
    walk = I.implies_walk(rules)
    got = I.rank_matches(I.resolve_implies(tech, rules, walk))
    assert got.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("implied").cast("int")).alias("i"), F.countDistinct("rank").alias("r")).filter(f"n = {n} AND i = {n - 1} AND r = {n}").count() == 3
    assert [r.tech_key for r in got.filter("page_id = 1 AND rank <= 4").orderBy("rank").collect()] == ["t7", "t0", "t1", "t2"]
    names = I.detected_names(tech.select("page_id", "tech_key"), rules, walk)
    assert names.count() == 3 * n
