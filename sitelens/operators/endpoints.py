"""API endpoint detection E1-E11: five typed projections, one union, one window.

Every stage is a narrow projection of its own table; the merge is a single
window over (page_id, path) -- the only shuffle, keyed by page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.functions.staging import computed

# Third-party domains never reported.
THIRD_PARTY_DOMAINS = [
    "googleapis.com", "google.com", "gstatic.com", "googletagmanager.com", "doubleclick.net", "facebook.net",
    "facebook.com", "twitter.com", "analytics.google.com", "maps.googleapis.com", "cloudflare.com",
    "jsdelivr.net", "cdnjs.cloudflare.com", "jquery.com", "bootstrapcdn.com", "unpkg.com",
]
# API URL patterns and labels, first hit wins, searched case-insensitively.
API_PATTERNS = [
    (r"/api/v\d", "REST API (Versioned)"),
    (r"/api/", "REST API"),
    (r"/rest/", "REST API"),
    (r"/wp-json/", "WordPress REST API"),
    (r"/__admin/", "Admin Endpoint"),
    (r"/graphql", "GraphQL Endpoint"),
    (r"/gql", "GraphQL Endpoint"),
    (r"/rpc", "RPC Endpoint"),
    (r"/trpc", "tRPC Endpoint"),
]
# Probed path suffixes and labels, first hit wins (E5).
PROBE_LABELS = [
    ("/robots.txt", "Robots Configuration"),
    ("/sitemap.xml", "Sitemap Index"),
    ("/api-docs", "API Documentation"),
    ("/openapi.json", "OpenAPI Specification"),
    ("/swagger.json", "Swagger UI / Spec"),
    ("/graphql", "GraphQL Endpoint"),
    ("/.well-known/security.txt", "Security Contact Info"),
]
STAGES = {"spec": 0, "runtime": 1, "probe": 2, "static": 3, "wordlist": 4}
ENDPOINT_COLS = ["page_id", "url", "method", "content_type", "pattern_matched", "confidence", "stage", "seq"]

normalize_path = U.normalize_path  # E1


def is_third_party(url) -> F.Column:
    """Absolute http(s) URL whose host is, or is below, a listed domain."""
    u = F.col(url) if isinstance(url, str) else url
    host = U.url_host(u)
    listed = F.array(*[F.lit(d) for d in THIRD_PARTY_DOMAINS])
    return U.is_absolute_http(u) & F.exists(listed, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def api_label(url) -> F.Column:
    """Label of the first API pattern found anywhere in the URL, else NULL."""
    u = F.col(url) if isinstance(url, str) else url
    expr = None
    for rx, label in API_PATTERNS:
        cond = u.rlike("(?i)" + rx)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def _json_boost(ct: F.Column) -> F.Column:
    c = F.lower(F.coalesce(ct, F.lit("")))
    return F.when(F.contains(c, F.lit("application/json")) | F.contains(c, F.lit("application/graphql")), 0.1) \
        .otherwise(0.0)


def runtime_endpoints(requests: DataFrame) -> DataFrame:
    """(page_id, seq, url, method, content_type); third-party dropped; API-labelled; 0.7 (+0.1 json/graphql)."""
    r = computed(requests, _tp=is_third_party("url"), label=api_label("url"), _path=normalize_path("url"))
    r = r.filter(~F.col("_tp") & F.col("label").isNotNull())
    return r.select("page_id", F.col("_path").alias("url"), F.coalesce("method", F.lit("GET")).alias("method"),
                    "content_type", F.col("label").alias("pattern_matched"),
                    F.round(F.least(F.lit(0.7) + _json_boost(F.col("content_type")), F.lit(1.0)), 2).alias("confidence"),
                    F.lit(STAGES["runtime"]).alias("stage"), F.col("seq").cast("long").alias("seq"))


def probe_endpoints(probes: DataFrame) -> DataFrame:
    """E5: status 200 only; label by path suffix else 'Probed API Endpoint'; 0.8 (+0.1 json/graphql)."""
    p = computed(probes.filter(F.col("status") == 200), path=normalize_path("url"))
    label = None
    for suf, lab in PROBE_LABELS:
        cond = F.col("path").endswith(suf)
        label = F.when(cond, F.lit(lab)) if label is None else label.when(cond, F.lit(lab))
    label = label.otherwise(F.lit("Probed API Endpoint"))
    return p.select("page_id", F.col("path").alias("url"), F.coalesce("method", F.lit("GET")).alias("method"),
                    "content_type", label.alias("pattern_matched"),
                    F.round(F.least(F.lit(0.8) + _json_boost(F.col("content_type")), F.lit(1.0)), 2).alias("confidence"),
                    F.lit(STAGES["probe"]).alias("stage"), F.col("seq").cast("long").alias("seq"))


def static_endpoints(routes: DataFrame) -> DataFrame:
    """Static routes with an API label; GET, 0.65; no third-party filter."""
    r = computed(routes, label=api_label("route"), _path=normalize_path("route")).filter(F.col("label").isNotNull())
    return r.select("page_id", F.col("_path").alias("url"), F.lit("GET").alias("method"),
                    F.lit(None).cast("string").alias("content_type"), F.col("label").alias("pattern_matched"),
                    F.lit(0.65).alias("confidence"), F.lit(STAGES["static"]).alias("stage"),
                    F.col("seq").cast("long").alias("seq"))


def spec_endpoints(paths: DataFrame) -> DataFrame:
    """Spec paths at 1.0, 'OpenAPI spec', first listed method else GET."""
    return paths.select("page_id", normalize_path("spec_path").alias("url"),
                        F.coalesce(F.try_element_at("methods", F.lit(1)), F.lit("GET")).alias("method"),
                        F.lit(None).cast("string").alias("content_type"), F.lit("OpenAPI spec").alias("pattern_matched"),
                        F.lit(1.0).alias("confidence"), F.lit(STAGES["spec"]).alias("stage"),
                        F.col("pos").cast("long").alias("seq"))


def wordlist_endpoints(exposed: DataFrame) -> DataFrame:
    """E8: 'SecLists/<file>' plus ' (label)' for auth-required / forbidden / redirect; given confidence (0.8)."""
    label = F.coalesce("status_label", F.lit("exposed"))
    pm = F.concat(F.lit("SecLists/"), F.coalesce("source_wordlist", F.lit("unknown.txt")),
                  F.when(label.isin("auth-required", "forbidden", "redirect"), F.concat(F.lit(" ("), label, F.lit(")")))
                  .otherwise(F.lit("")))
    return exposed.filter(F.coalesce("url", F.lit("")) != "").select(
        "page_id", normalize_path("url").alias("url"), F.lit("GET").alias("method"), "content_type",
        pm.alias("pattern_matched"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.8)).alias("confidence"),
        F.lit(STAGES["wordlist"]).alias("stage"), F.col("seq").cast("long").alias("seq"))


def merge_endpoints(*stages: DataFrame) -> DataFrame:
    """One row per (page, path): highest confidence; ties go to the earlier stage
    (spec, runtime, probe, static, wordlist) and, within a stage, the earlier row --
    except spec, where a later path that normalises alike overwrites."""
    u = reduce(lambda a, b: a.unionByName(b), [s.select(*ENDPOINT_COLS) for s in stages])
    within = F.when(F.col("stage") == STAGES["spec"], -F.col("seq")).otherwise(F.col("seq"))
    w = Window.partitionBy("page_id", "url").orderBy(F.desc("confidence"), "stage", within)
    return u.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
