"""The full detection with DOM evidence, and its report, against hand-written rows."""
import json

from sitelens.operators import implies as I
from sitelens.operators import report as RP
from sitelens.operators import score as S
from sitelens.plans.detect import compile_all, matches_raw
from sitelens.session import DEFAULT_CONF

RULES = "ord int, tech_key string, name string, category string, website string, confidence double, headers map<string,string>, cookies map<string,string>, " \
        "meta map<string,string>, js_globals map<string,string>, scripts array<string>, html array<string>, implies array<string>, dom string"


def rule(o, key, dom=None, headers=None, meta=None, scripts=None, implies=None, confidence=0.5):
    return (o, key, key.title(), "cat", None, confidence, headers or {}, {}, meta or {}, {}, scripts or [], [], implies or [], dom)


def detected(spark):
    rules = spark.createDataFrame([
        rule(0, "menu", dom='["nav > ul"]'), rule(1, "heading", dom='{"h1": {"text": "^Shopv([0-9]+)"}}', implies=["engine"]), rule(2, "widget", dom='{"div.widget[data-id]": {"exists": ""}}'),
        rule(3, "styles", dom='{"link[href*=\'cdn.example\']": {"attributes": {"href": "cdn\\\\.example/v([0-9.]+)/"}}}', scripts=["never"]), rule(4, "server", headers={"Server": "acme(?:/([0-9.]+))?"}, confidence=0.9),
        rule(5, "engine"), rule(6, "live", dom='["#app"]')], RULES)
    cr = compile_all(rules)
    pages = spark.createDataFrame([
        (1, "http://a.example/", "<nav><ul><li>x</li></ul></nav><h1> Shop <b>v7</b></h1><link href='https://cdn.example/v2.1/a.css'><div class='big widget' data-id>w</div>"),
        (2, "http://b.example/", "<nav><div><ul></ul></div></nav><h1>Blog</h1><div class=widget>none</div>")], "page_id long, url string, html string")
    headers = spark.createDataFrame([(2, "server", "Acme/1.5")], "page_id long, name string, value string")
    requests = spark.createDataFrame([(2, 0, "https://cdn.example/v3/b.css")], "page_id long, seq long, url string")
    browser = spark.createDataFrame([(2, "#app", 0, "hi", {"id": "app"}), (1, "nav > ul", 0, "x", {})], "page_id long, selector string, pos int, text string, attrs map<string,string>")
    raw = matches_raw(pages, cr, headers=headers, requests=requests, browser_findings=browser)
    return pages, I.rank_matches(I.resolve_implies(S.score(raw, cr.rules), cr.rules, cr.walk))


def test_full_detection_equals_hand_written_rows(spark):
    rows = {(r.page_id, r.tech_key): r for r in detected(spark)[1].collect()}
    assert {k: (r.version, r.confidence, [e.matched for e in r.evidence]) for k, r in rows.items()} == {
        (1, "menu"): (None, 0.5, ["Found element: nav > ul (text: x)"]),
        (1, "heading"): ("7", 0.6, ["Found: h1 (text: Shopv7)"]),
        (1, "widget"): (None, 0.5, ["Element exists: div.widget[data-id]"]),
        (1, "styles"): ("2.1", 0.6, ['Found: link[href*=\'cdn.example\'] (attributes: {"href":"https://cdn.example/v2.1/a.css"})']),
        (1, "engine"): (None, 0.6, ["Implied by Heading"]),
        (2, "styles"): ("3", 0.6, ['Found: link[href*=\'cdn.example\'] (attributes: {"href":"https://cdn.example/v3/b.css"})']),
        (2, "server"): ("1.5", 1.0, ["Acme/1.5"]),
        (2, "live"): (None, 0.5, ["Found element: #app (text: hi)"])}


def test_report_is_written_as_one_line_a_site(spark, tmp_path):
    pages, tech = detected(spark)
    endpoints = spark.createDataFrame([(2, "http://b.example/api", "GET", "application/json", "OpenAPI spec", 0.9)], "page_id long, url string, method string, content_type string, pattern_matched string, confidence double")
    RP.write_report(RP.scan_report(pages, tech, endpoints, rules_count=7), str(tmp_path / "out"))
    lines = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    by = {r["url"]: r for r in lines}
    assert len(lines) == 2 and [t["name"] for t in by["http://b.example/"]["technologies"]] == ["Server", "Styles", "Live"]
    assert by["http://b.example/"]["openapi_spec_found"] and not by["http://a.example/"]["openapi_spec_found"]
    assert by["http://b.example/"]["api_endpoints"][0]["url"] == "http://b.example/api" and by["http://a.example/"]["meta"]["rules_count"] == 7


def test_pages_are_tokenised_once_and_meet_the_rules_without_a_shuffle(spark):
    """The tag table is written before its branches read it; a rule table has a size that Spark knows."""
    rules = spark.createDataFrame([rule(0, "a", meta={"generator": "A"}, scripts=["a\\.js"])], RULES)
    cr = compile_all(rules)
    pages = spark.range(3).selectExpr("id AS page_id", "'http://a.example/' AS url", "'<meta name=generator content=A><script src=a.js></script>' AS html").repartition(2)
    plan = matches_raw(pages, cr, sources=("meta", "script"))._jdf.queryExecution().optimizedPlan().toString()
    assert "<script" not in plan and "regexp_extract_all" not in plan and "LocalRelation" in plan


def test_a_python_worker_holds_few_pages_at_a_time(spark):
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert DEFAULT_CONF["spark.sql.execution.arrow.maxRecordsPerBatch"] == "500" and DEFAULT_CONF["spark.sql.execution.arrow.maxBytesPerBatch"] == "16m"
