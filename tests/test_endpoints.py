"""API endpoint detection."""

from pyspark.sql import functions as F

from sitelens.operators import endpoints as EP
from sitelens.operators import js_routes as J

REQ = "page_id long, seq long, url string, method string, content_type string"


def _rows(df):
    return {r["url"]: r for r in df.collect()}


def test_runtime_labels_and_confidence(spark):
    r = spark.createDataFrame([(1, 1, "https://a.io/api/v1/users", "GET", "application/json"),
                               (1, 2, "https://a.io/rest/items", "GET", None),
                               (1, 3, "https://a.io/graphql", "POST", "application/graphql"),
                               (1, 4, "https://a.io/static/app.js", "GET", None)], REQ)
    out = _rows(EP.runtime_endpoints(r))
    assert set(out) == {"/api/v1/users", "/rest/items", "/graphql"}
    assert out["/api/v1/users"]["confidence"] == 0.8 and out["/api/v1/users"]["pattern_matched"] == "REST API (Versioned)"
    assert out["/rest/items"]["confidence"] == 0.7
    assert out["/graphql"]["pattern_matched"] == "GraphQL Endpoint"


def test_probe_status_and_labels(spark):
    p = spark.createDataFrame([(1, 1, "https://a.io/robots.txt", "GET", "text/plain", 200),
                               (1, 2, "https://a.io/swagger.json", "GET", "application/json", 200),
                               (1, 3, "https://a.io/missing", "GET", "text/html", 404)], REQ + ", status int")
    out = _rows(EP.probe_endpoints(p))
    assert out["/robots.txt"]["confidence"] == 0.8 and out["/robots.txt"]["pattern_matched"] == "Robots Configuration"
    assert out["/swagger.json"]["confidence"] == 0.9
    assert "/missing" not in out


def test_merge_keeps_strictly_higher(spark):
    r = spark.createDataFrame([(1, 1, "https://a.io/api/users/", "GET", None),
                               (1, 2, "https://a.io/api/users?id=1", "POST", "application/json")], REQ)
    out = EP.merge_endpoints(EP.runtime_endpoints(r)).collect()
    assert len(out) == 1 and out[0]["method"] == "POST" and out[0]["confidence"] == 0.8


def test_static_loses_to_runtime_and_needs_label(spark):
    r = spark.createDataFrame([(1, 1, "https://a.io/api/v1/data", "GET", None)], REQ)
    s = spark.createDataFrame([(1, 1, "/api/v1/data"), (1, 2, "/not-an-api-route")], "page_id long, seq long, route string")
    out = _rows(EP.merge_endpoints(EP.runtime_endpoints(r), EP.static_endpoints(s)))
    assert set(out) == {"/api/v1/data"} and out["/api/v1/data"]["confidence"] == 0.7


def test_wordlist_labels(spark):
    e = spark.createDataFrame([(1, "https://a.io/sap/bc/gui", "SAP-NetWeaver.txt", "redirect", 0.7, None, 0)],
                              "page_id long, url string, source_wordlist string, status_label string, "
                              "confidence double, content_type string, seq long")
    out = EP.wordlist_endpoints(e).first()
    assert out["pattern_matched"] == "SecLists/SAP-NetWeaver.txt (redirect)" and out["confidence"] == 0.7


def test_js_routes(spark):
    body = ('fetch("/api/v1/users");axios.get("/api/v2/items");const x = "https://api.stripe.com/v1/api/charges";'
            'var r = {route: "/dashboard"}; "/v3/things/list"')
    df = spark.createDataFrame([(1, "https://a.io/app.js", body)], "page_id long, js_url string, body string")
    routes = {r["route"] for r in J.bundle_routes(df).collect()}
    assert {"/api/v1/users", "/api/v2/items", "/dashboard", "/v3/things/list"} <= routes
    pages = spark.createDataFrame([(1, "https://a.io/")], "page_id long, url string")
    kept = {r["route"] for r in J.normalize_routes(J.bundle_routes(df).select("page_id", "route"), pages).collect()}
    assert "https://api.stripe.com/v1/api/charges" not in kept and "/v1/api/charges" not in kept
