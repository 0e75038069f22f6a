"""DOM selectors, elements and rule forms (rule forms, evidence strings, request findings)."""

import random

from pyspark.sql import functions as F

from sitelens.operators import dom as D


def test_selector_grammar():
    assert D.parse_selector("link[href*='fonts.googleapis.com']") == [[("", "link", [("href", "*=", "fonts.googleapis.com")])]]
    assert D.parse_selector("div#app.main, .x[data-v]") == [[("", "div", [("id", "=", "app"), ("class", "~=", "main")])],
                                                           [("", None, [("class", "~=", "x"), ("data-v", "exists", None)])]]
    assert D.parse_selector("nav  ul>li+ [a='x, y > z']~*") == [[("", "nav", []), (" ", "ul", []), (">", "li", []),
                                                                  ("+", None, [("a", "=", "x, y > z")]), ("~", None, [])]]
    for bad in ("a:hover", "", "> a", "a >", "a,", "a >> b", "a[b", "a::before"):
        assert D.parse_selector(bad) is None, bad    # quarantined


def elements(html, keys=None):
    return [(e["tag"], e["text"]) for e in D._elements(html, None if keys is None else frozenset(keys))]


def test_elements_text_and_raw_bodies():
    els = D._elements('<div id="a">Hi <b>there</b><script>var x="<p>";</script></div><p class=" x  y ">x', frozenset({"<div", "<p"}))
    assert els[0]["tag"] == "div" and els[0]["text"] == "Hithere" and els[0]["attrs"] == {"id": "a"}
    assert els[1]["tag"] == "p" and els[1]["text"] == "x" and els[1]["attrs"] == {"class": "x y"}
    assert (els[0]["pos"], els[0]["last"], els[1]["pos"], els[1]["before"], els[1]["parent"]) == (0, 2, 3, 0, None)


def test_raw_elements_have_their_own_text():
    """A script's, style's or template's strings are its own text and no part of the text around it."""
    page = "<div>a < b<script> var x = 1; </script><style>p{}</style><template>t<i>u</i></template><!-- c -->&amp; d<br/>e</div>"
    assert elements(page) == [("div", "a < b& de"), ("script", "var x = 1;"), ("style", "p{}"), ("template", "tu"), ("i", ""), ("br", "")]
    assert elements("<ul><li>1<li>2</ul>x", ["<li"]) == [("li", "12"), ("li", "2")]
    assert elements("<p data-x>1</b></p><q>2", ["data-x"]) == [("p", "1")]


PAGE = """<nav><div><ul id=u1><li>1</li><li class=x>2</li></ul></div></nav>
<ul id=u2><li>3<ul id=u3><li>4</li></ul></li><b>5</b><li>6</li></ul>
<section><h1>t</h1><p>7</p><p>8</p><div><p>9</p></div></section><nav>no list</nav>"""
SELECTED = {"nav ul": ["u1"], "ul > li": ["1", "2", "34", "4", "6"], "nav li": ["1", "2"], "ul ul li": ["4"], "nav > ul": [], "nav ul > li.x, footer": ["2"],
            "h1 + p": ["7"], "h1 ~ p": ["7", "8"], "section p": ["7", "8", "9"], "section > p": ["7", "8"], "b + li": ["6"], "li ~ li": ["2", "6"],
            "ul > li > ul li": ["4"], "[id] [id]": ["u3"], "* > h1": ["t"], "section h1 ~ div p": ["9"], "script": ["f()"]}


def test_structural_selectors_equal_hand_written_rows(spark):
    pages = spark.createDataFrame([(1, PAGE + "<script>f()</script>"), (2, "<ul><li>other</li></ul><nav></nav>"), (3, "nothing"), (4, None)], "page_id long, html string")
    rules = spark.createDataFrame([(s,) for s in SELECTED], "selector string")
    compounds, bad = D.compile_selectors(rules)
    assert bad.count() == 0
    got = D.dom_evidence(D.dom_elements(pages, D.wanted_keys(compounds)), compounds).collect()
    name = lambda r: r.attrs.get("id", r.text)
    assert {s: [name(r) for r in sorted(got, key=lambda r: r.pos) if r.page_id == 1 and r.selector == s] for s in SELECTED} == SELECTED
    assert {(r.selector, r.text) for r in got if r.page_id == 2} == {("ul > li", "other")}


def test_structural_selectors_equal_a_walk_on_random_trees(spark):
    rng = random.Random(3)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth + 1) if depth < 5 else ''}</{t}>" for t in (rng.choice("abi") for _ in range(rng.randrange(4))))
    htmls = [tree(0) for _ in range(40)]
    selectors = [f"{x}{j}{y}{k}{z}" for x in "ab" for y in "ai" for z in "bi" for j in (" ", ">", "+", "~") for k in (" ", ">", "+", "~")][::5]
    compounds, _ = D.compile_selectors(spark.createDataFrame([(s,) for s in selectors], "selector string"))
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    got = {(r.page_id, r.selector, r.pos) for r in D.dom_evidence(D.dom_elements(pages, D.wanted_keys(compounds)), compounds).collect()}

    def holds(el, joint, other):
        return {" ": other["pos"] < el["pos"] <= other["last"], ">": el["parent"] == other["pos"], "+": el["before"] == other["pos"],
                "~": el["parent"] == other["parent"] and other["pos"] < el["pos"]}[joint]
    want = set()
    for i, h in enumerate(htmls):
        els = D._elements(h, None)
        for s in selectors:
            x, j, y, k, z = s
            mid = [e for e in els if e["tag"] == y and any(o["tag"] == x and holds(e, j, o) for o in els)]
            want |= {(i, s, e["pos"]) for e in els if e["tag"] == z and any(holds(e, k, o) for o in mid)}
    assert got == want and len(want) > 50


def test_list_exists_and_criteria(spark):
    findings = spark.createDataFrame([
        (1, "lottie-player", 0, "anim", {}),
        (1, "link[rel='stylesheet']", 0, "", {"rel": "stylesheet", "href": "https://fonts.googleapis.com/css?family=Roboto:400,700"}),
        (1, "link[rel='manifest']", 0, "", {"rel": "manifest", "href": "/m.json"}),
    ], "page_id long, selector string, pos int, text string, attrs map<string,string>")
    rules = spark.createDataFrame([
        ("lottie", 0, 0, "lottie-player", "list", None, None, None),
        ("gfonts", 1, 0, "link[rel='stylesheet']", "criteria", None, {"href": r"fonts\.googleapis\.com/css\?family=(.+)"}, None),
        ("pwa", 2, 0, "link[rel='manifest']", "exists", None, None, None),
    ], "tech_key string, ord int, pos int, selector string, kind string, text_rx string, "
       "attr_rx map<string,string>, prop_rx map<string,string>")
    out = {r["tech_key"]: r for r in D.match_dom(findings, D.prepare_dom_rules(rules)).collect()}
    assert out["lottie"]["matched"] == "Found element: lottie-player (text: anim)" and out["lottie"]["pattern"] == "lottie-player"
    assert out["gfonts"]["version"] == "Roboto:400,700"
    assert out["pwa"]["matched"] == "Element exists: link[rel='manifest']" and out["pwa"]["pattern"] == ""


def test_request_urls_become_findings(spark):
    rules = spark.createDataFrame([("gf", 0, 0, "link[href*='fonts.googleapis.com']", "exists", None, None, None)],
                                  "tech_key string, ord int, pos int, selector string, kind string, text_rx string, "
                                  "attr_rx map<string,string>, prop_rx map<string,string>")
    reqs = spark.createDataFrame([(1, 1, "https://fonts.googleapis.com/css?family=Roboto"), (2, 1, "https://x.io/a.js")],
                                 "page_id long, seq long, url string")
    none = spark.createDataFrame([], "page_id long, selector string")
    got = D.dom_from_requests(reqs, rules, none).collect()
    assert [(r["page_id"], r["attrs"]["href"]) for r in got] == [(1, "https://fonts.googleapis.com/css?family=Roboto")]
