"""Rules: patterns that must not abort a job, DOM criteria, the build from upstream files."""
import json
import re

from pyspark.sql import functions as F

from sitelens.functions import regex as rx
from sitelens.operators import dom as D
from sitelens.operators import domains
from sitelens.operators import rulebuild as RB
from sitelens.operators import wordlists as W
from sitelens.sources import rules as R

ODD = ["a[[]b", "[^[]x", "foo[&&]", "a{,3}c", r"(?P<v>\d+)-(?P=v)", r"[\w-]+\.js", "a.c", "(?i)abc", "x|yz|", r"^q\s*$", "(?:ab)+?c", "[^a-c]d", "(?=x)x(?!y)", "é+"]
TEXTS = ["a[b", "ax", "[x", "foo&", "aaac", "c", "12-12", "12-13", "my-lib.js", "abc", "a\rc", "ABC", "yz", "q  ", "ababc", "dd", "xy", "xz", "ééé", "a{,3}c"]


def test_java_form_matches_what_python_matches(spark):
    forms = [(p, rx.java_form(p)) for p in ODD]
    df = spark.createDataFrame([(p, j, t) for p, j in forms for t in TEXTS], "p string, j string, t string")
    got = {(r.p, r.t) for r in df.filter(F.regexp_like("t", F.concat(F.lit("(?iu)"), F.col("j")))).collect()}
    assert got == {(p, t) for p in ODD for t in TEXTS if re.search(p, t, re.I)}
    assert [rx.java_form(p) for p in ("a(", "[", "(x)?(?(1)a|b)", None)] == [None] * 4


DOM_RULES = "tech_key string, ord int, pos int, selector string, kind string, text_rx string, attr_rx map<string,string>, prop_rx map<string,string>"


def test_dom_criteria_without_group_and_bad_ones(spark):
    found = spark.createDataFrame([(1, "a.x", 0, "Version 3", {"href": "/wp-content/app.css", "class": "x"})],
                                  "page_id long, selector string, pos int, text string, attrs map<string,string>")
    rules = spark.createDataFrame([
        ("plain", 0, 0, "a.x", "criteria", None, {"href": "wp-content"}, None),
        ("both", 1, 0, "a.x", "criteria", r"Version (?P<v>\d+)", {"href": r"/([a-z]+)\.css"}, None),
        ("bad", 2, 0, "a.x", "criteria", "a(", None, {"href": "["}),
        ("other", 3, 0, "a.x", "criteria", None, {"id": ".*"}, None)], DOM_RULES)
    out = {r.tech_key: r.version for r in D.match_dom(found, D.prepare_dom_rules(rules)).collect()}
    assert out == {"plain": None, "both": "3"}
    assert sorted((r.tech_key, r.pattern) for r in D.bad_dom_rules(rules).collect()) == [("bad", "["), ("bad", "a(")]


def test_url_selectors_come_from_the_selector_grammar(spark):
    rules = spark.createDataFrame([("t", 0, 0, "script[src*='x.js'], nav ul, link[rel='y'], [data-href^=\"/z\"], a[href]", "exists", None, None, None)], DOM_RULES)
    got = sorted(tuple(r) for r in D.url_selector_alternatives(rules).select("alt", "attr", "op", "val").collect())
    assert got == [(0, "src", "*=", "x.js"), (3, "data-href", "^=", "/z")]


def test_browser_findings_are_merged(spark):
    cols = "page_id long, selector string, pos int, text string, attrs map<string,string>"
    static = spark.createDataFrame([(1, "h1", 0, "Hello", {})], cols)
    browser = spark.createDataFrame([(1, "h1", 0, "Hello", {}), (1, "h1", 1, "Rendered", {}), (2, "h1", 0, "Hello", {})], cols)
    got = sorted((r.page_id, r.text) for r in D.merge_dom_findings(static, browser).collect())
    assert got == [(1, "Hello"), (1, "Rendered"), (2, "Hello")]
    assert D.merge_dom_findings(static, None).count() == 1


def test_critical_path_far_down_an_always_probe_file_is_kept(spark):
    manifest = spark.createDataFrame([("quickhits.txt", 0, True, 701)], "filename string, file_ord long, always_probe boolean, path_count long")
    parsed = spark.createDataFrame([("quickhits.txt", i, f"/p{i}") for i in range(700)] + [("quickhits.txt", 700, "/.env")], "filename string, pos int, path string")
    sets = spark.createDataFrame([(1, "quickhits.txt")], "page_id long, fileset string")
    got = [r.path for r in W.rank_paths(sets, manifest, parsed).orderBy("rank").collect()]
    assert len(got) == W.MAX_PROBES and got[:2] == ["/.env", "/p0"]


def test_upstream_build(spark, tmp_path):
    one = {"Acme CMS": {"cats": ["1", "9"], "website": "https://acme.example", "headers": {"X-Acme": r"v([\d.]+)\;version:\1\;confidence:60"},
                        "js": {"acme.version": ""}, "html": ["<acme", r"acme\;confidence:30"], "implies": r"PHP\;confidence:50"},
           "Doc": {"cats": ["9"], "dom": {"div.doc": {"text": r"Doc\;confidence:40", "attributes": {"id": "x"}}}}}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps({"Bare": {"dom": "span.bare"}}))
    (tmp_path / "categories.json").write_text(json.dumps({"1": {"name": "CMS", "priority": 1}, "9": {"name": "Doc Tools/Kits", "priority": 5}}))
    techs = RB.read_upstream(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    cats = RB.read_categories(spark, str(tmp_path / "categories.json"))
    built = RB.compile_upstream(techs, cats, "https://default.example")
    got = {r["key"]: r for r in built.collect()}
    assert got["Acme CMS"]["confidence"] == 0.6 and got["Acme CMS"]["category"] == "cms"
    assert got["Acme CMS"]["headers"] == {"X-Acme": r"v([\d.]+)"} and got["Acme CMS"]["js_globals"] == {"acme.version": "."}
    assert got["Acme CMS"]["html"] == ["<acme", "acme"] and got["Acme CMS"]["implies"] == ["PHP"]
    assert got["Doc"]["confidence"] == 0.4 and got["Doc"]["website"] == "https://default.example"
    assert got["Bare"]["category"] == "other"
    table = {r.slug: r["name"] for r in RB.category_table(cats).collect()}
    assert table["cms"] == "CMS" and table["other"] == "Other" and len(table) == 3
    custom = built.filter("key = 'Doc'").withColumn("key", F.lit("doc")).withColumn("confidence", F.lit(0.9)).withColumn("html", F.array(F.lit("<doc"))) \
        .unionByName(built.filter("key = 'Bare'").withColumn("key", F.lit("Own")))
    merged, summary = RB.merge_rules(built, custom)
    by_key = {r["key"]: r for r in merged.collect()}
    assert (by_key["doc"]["status"], by_key["doc"]["confidence"], by_key["doc"]["html"]) == ("updated", 0.9, ["<doc"])
    assert by_key["Own"]["status"] == "preserved" and by_key["acme cms"]["status"] == "added"
    assert tuple(summary.first()) == (2, 1, 1, 4)
    RB.write_rules(merged, RB.category_table(cats), str(tmp_path / "out"))
    back = R.load_rules(spark, str(tmp_path / "out" / "rules"), str(tmp_path / "out" / "categories"))
    assert back.count() == 4 and {r.tech_key for r in R.rules_by_category(back, "CMS").collect()} == {"acme cms"}
    assert "div.doc" in {r.selector for r in R.dom_selectors(back).collect()}
    keys = [r["key"] for r in R.js_global_keys(spark, back.fillna({"ord": 1})).orderBy("grp", "pos").collect()]
    assert keys[0] == R.BUILTIN_JS_GLOBALS[0] and keys[-1] == "acme.version"


def test_pattern_domain_protocols(spark):
    cases = {r"https?://a\.example/x": "a.example", r"https\:\/\/b\.example": "b.example", r"//c\.example/": "c.example", r"http//d\.example": "d.example",
             r"e\.example": "e.example", r"/f\.example": None, r"^http:/g\.example": "g.example"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").withColumn("d", domains.pattern_domain("p"))
    assert {r.p: r.d for r in df.collect()} == cases
