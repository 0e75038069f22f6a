"""Registered queries: external dependencies (D1-D5), certificate-log subdomains and
their header classification (S12, D7-D12)."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import domains as D
from sitelens.plans import oracle as O
from sitelens.plans.catalog import _rules, _setup, oracle, query
from sitelens.plans.q_endpoints import F5, f5
from sitelens.sources import feeds as FD

q = O.sql_str


def _lambda_any(lst: str, var: str, cond: str) -> str:
    return f"(len(list_filter({lst}, lambda {var}: {cond})) > 0)"


# ---------------------------------------------------------------------------
# rollup
# ---------------------------------------------------------------------------
@query("external_rollup")
def q_external_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.external_rollup(f5(spark, sf_dir))
    return r.select("page_id", "domain", "request_count", F.array_join("resource_types", ",").alias("resource_types"),
                    F.array_join("example_urls", " ").alias("example_urls"))


def d_rollup() -> str:
    h = O.d_strip_www(O.d_host_of("domain"))
    t = O.d_strip_www(O.d_host_of(O.d_netloc("site_url")))
    return f"""rq AS (SELECT *, {O.d_netloc('url')} AS domain FROM {F5} x),
rq2 AS (SELECT * FROM rq WHERE domain <> '' AND {O.d_apex(h, 'noip')} <> {O.d_apex(t, 'noip')}),
roll AS (SELECT page_id, domain, count(*) AS request_count,
  list_sort(list_distinct(list(nullif(coalesce(resource_type, ''), '')) FILTER (WHERE nullif(coalesce(resource_type, ''), '') IS NOT NULL))) AS resource_types,
  list(url ORDER BY seq)[1:3] AS example_urls, min(seq) AS first_seq
FROM rq2 GROUP BY page_id, domain)"""


@oracle("external_rollup")
def o_external_rollup() -> str:
    return f"""WITH {d_rollup()}
SELECT page_id, domain, request_count, array_to_string(resource_types, ',') AS resource_types,
  array_to_string(example_urls, ' ') AS example_urls FROM roll"""


# ---------------------------------------------------------------------------
# Classified external dependencies
# ---------------------------------------------------------------------------
@query("external_deps")
def q_external_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    r = D.external_deps(f5(spark, sf_dir), cr.rules)
    return r.select("page_id", "domain", "category", "technology_name", "request_count",
                    F.array_join("resource_types", ",").alias("resource_types"),
                    F.array_join("example_urls", " ").alias("example_urls"), "rank")


def _oracle_site(website: str) -> str:
    w = (website or "").strip()
    net = urlparse(w).netloc.lower()
    if not net and "//" not in w:
        net = urlparse("//" + w).netloc.lower()
    host = net.split(":")[0]
    return host[4:] if host.startswith("www.") else host


def d_classify(dom: str = "dd") -> str:
    rules = O.fixture_rules()
    lits = []
    for r in rules:
        for i, p in enumerate(r.get("scripts") or []):
            pl = (p or "").lower()
            if pl and not any(ch in D.REGEX_SPECIALS for ch in pl):
                lits.append((pl, r["ord"], i, r["name"], r["category"], r["confidence"]))
    sites, first = [], {}
    for r in rules:
        if r.get("website"):
            sd = _oracle_site(r["website"])
            if sd:
                first.setdefault(sd, r["ord"])
                sites.append((sd, r["ord"], r["name"], r["category"], r["confidence"]))
    sites = [(sd, first[sd], o, n, c, cf) for sd, o, n, c, cf in sites]
    stop = "[" + ", ".join(q(w) for w in D.BRAND_STOPWORDS) + "]"
    shared = "[" + ", ".join(q(w) for w in D.SHARED_DOMAINS) + "]"
    words = (f"list_filter(list_transform(regexp_split_to_array(c.name, '[^a-zA-Z0-9]+'), lambda x: lower(x)), "
             f"lambda x: x <> '' AND NOT list_contains({stop}, x))")
    labels = "string_split(lower(c.domain), '.')"
    labels = f"(CASE WHEN len({labels}) > 1 THEN list_slice({labels}, 1, len({labels}) - 1) ELSE {labels} END)"
    brand = _lambda_any(words, "bw", _lambda_any(labels, "lb", "lb = bw OR (length(bw) >= 5 AND starts_with(lb, bw))"))
    return f"""dl AS (SELECT DISTINCT domain, lower(domain) AS dl FROM {dom}),
lit AS {O.values(lits, ['lit', 'ord', 'pos', 'name', 'category', 'confidence'])},
d2 AS (SELECT domain, name AS technology_name, category FROM dl JOIN lit ON contains(dl.dl, lit.lit)
       QUALIFY row_number() OVER (PARTITION BY domain ORDER BY length(lit) DESC, confidence DESC, ord, pos) = 1),
web AS {O.values(sites, ['site_domain', 'site_ord', 'ord', 'name', 'category', 'confidence'])},
c AS (SELECT dl.domain, dl.dl, w.* FROM dl JOIN web w ON dl.dl = w.site_domain OR ends_with(dl.dl, '.' || w.site_domain)),
c2 AS (SELECT * FROM c WHERE NOT (dl <> site_domain AND list_contains({shared}, site_domain))),
d3 AS (SELECT c.domain, c.name AS technology_name, c.category FROM c2 c
       WHERE {brand}
       QUALIFY row_number() OVER (PARTITION BY c.domain ORDER BY length(c.site_domain) DESC, c.confidence DESC,
                                  c.site_ord, c.ord) = 1),
cls AS (SELECT dl.domain, coalesce(d2.technology_name, d3.technology_name) AS technology_name,
          coalesce(d2.category, d3.category, 'Unclassified') AS category
        FROM dl LEFT JOIN d2 ON d2.domain = dl.domain LEFT JOIN d3 ON d3.domain = dl.domain)"""


@oracle("external_deps")
def o_external_deps() -> str:
    return f"""WITH {d_rollup()}, {d_classify('roll')}
SELECT r.page_id, r.domain, c.category, c.technology_name, r.request_count,
  array_to_string(r.resource_types, ',') AS resource_types, array_to_string(r.example_urls, ' ') AS example_urls,
  row_number() OVER (PARTITION BY r.page_id ORDER BY r.request_count DESC, r.first_seq) AS rank
FROM roll r LEFT JOIN cls c ON c.domain = r.domain"""


# ---------------------------------------------------------------------------
# Certificate-log subdomains
# ---------------------------------------------------------------------------
def f8(spark, sf_dir):
    _setup(spark, sf_dir)
    return (spark.sql(FD.f8_ct_sql()), spark.sql(FD.f8_responses_sql()), spark.sql(FD.f8_headers_sql()))


@query("ct_subdomains")
def q_ct_subdomains(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct, _, _ = f8(spark, sf_dir)
    return D.ct_subdomains(D.ct_names(ct))


def d_ct_subdomains() -> str:
    return f"""ct AS ({FD.f8_ct_sql()}),
nm AS (
  SELECT domain, source, source_rank, entry_pos * 100000 AS pos, lower(trim(split_part(raw, ',', 1))) AS name
  FROM ct WHERE source = 'hackertarget'
  UNION ALL
  SELECT domain, source, source_rank, entry_pos * 100000 + i - 1, lower(trim(parts[i])) FROM (
    SELECT *, generate_subscripts(parts, 1) AS i FROM (
      SELECT *, string_split(raw, chr(10)) AS parts FROM ct WHERE source = 'crt.sh'))
  UNION ALL
  SELECT domain, source, source_rank, entry_pos * 100000 + i - 1, lower(trim(parts[i])) FROM (
    SELECT *, generate_subscripts(parts, 1) AS i FROM (
      SELECT *, from_json(raw, '["VARCHAR"]') AS parts FROM ct WHERE source = 'certspotter'))),
ok AS (SELECT domain, source, source_rank, name, min(pos) AS pos FROM nm
       WHERE name <> '' AND NOT starts_with(name, '*.') AND (ends_with(name, '.' || domain) OR name = domain)
       GROUP BY domain, source, source_rank, name),
subs AS (SELECT domain, source AS ct_source, pos, name AS subdomain FROM ok
         QUALIFY source_rank = min(source_rank) OVER (PARTITION BY domain))"""


@oracle("ct_subdomains")
def o_ct_subdomains() -> str:
    return f"WITH {d_ct_subdomains()}\nSELECT domain, ct_source, pos, subdomain FROM subs"


# ---------------------------------------------------------------------------
# Live subdomains with header technology
# ---------------------------------------------------------------------------
@query("subdomain_tech")
def q_subdomain_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    ct, resp, hdr = f8(spark, sf_dir)
    subs = D.ct_subdomains(D.ct_names(ct))
    return D.live_subdomains(subs, resp, hdr, D.header_rules(cr.rules))


def d_header_rules() -> str:
    import re as _re
    rows = []
    for r in O.fixture_rules():
        for k, p in (r.get("headers") or {}).items():
            try:
                valid = True
                dummy = bool(_re.search(p, D.DUMMY_TARGET, _re.IGNORECASE))
            except _re.error:
                valid, dummy = False, p.lower() in D.DUMMY_TARGET
            rows.append((r["ord"], r["name"], r["category"], r["confidence"], k.lower(), p, valid, dummy))
    return O.values(rows, ["ord", "name", "category", "confidence", "key_norm", "pattern", "valid", "matches_dummy"])


@oracle("subdomain_tech")
def o_subdomain_tech() -> str:
    live = ", ".join(str(s) for s in D.LIVE_STATUSES)
    redir = ", ".join(str(s) for s in D.REDIRECT_STATUSES)
    rbase = O.d_strip_www(O.d_host_of(O.d_netloc("redirect_location")))
    return f"""WITH {d_ct_subdomains()},
resp AS ({FD.f8_responses_sql()}),
hdr AS ({FD.f8_headers_sql()}),
hr AS {d_header_rules()},
m AS (SELECT h.subdomain, hr.* FROM hdr h JOIN hr ON h.key_norm = hr.key_norm
      WHERE (CASE WHEN hr.valid THEN regexp_matches(h.value, '(?i)' || hr.pattern) ELSE contains(lower(h.value), lower(hr.pattern)) END)
        AND NOT hr.matches_dummy),
best AS (SELECT subdomain, arg_max(name, confidence * 1000000 - ord) AS name,
           arg_max(category, confidence * 1000000 - ord) AS category, max(confidence) AS confidence
         FROM m GROUP BY subdomain),
cls AS (SELECT subdomain,
   CASE WHEN confidence >= 0.75 AND length(name) <= 30 AND regexp_matches(name, '^[A-Za-z0-9 .-]+$') THEN name END AS detected_tech,
   CASE WHEN confidence >= 0.75 AND length(name) <= 30 AND regexp_matches(name, '^[A-Za-z0-9 .-]+$') THEN category END AS detected_category
   FROM best),
hm AS (SELECT subdomain, max(CASE WHEN key_norm = 'content-type' THEN value END) AS content_type,
         max(CASE WHEN key_norm = 'location' THEN value END) AS location FROM hdr GROUP BY subdomain),
lv AS (SELECT s.domain, s.subdomain, s.ct_source, r.status, r.response_time_ms, hm.content_type,
         CASE WHEN r.status IN ({redir}) THEN hm.location END AS redirect_location, cls.detected_tech, cls.detected_category
       FROM subs s JOIN resp r ON r.subdomain = s.subdomain LEFT JOIN hm ON hm.subdomain = s.subdomain
       LEFT JOIN cls ON cls.subdomain = s.subdomain WHERE r.status IN ({live})),
fx AS (SELECT *, (redirect_location IS NOT NULL AND {rbase} <> ''
          AND {O.d_apex(rbase, 'last2')} <> {O.d_apex('domain', 'last2')} AND detected_tech IS NOT NULL) AS clear FROM lv)
SELECT domain, subdomain, 'https://' || subdomain AS full_url, status AS status_code, content_type, redirect_location,
  round(response_time_ms, 1) AS response_time_ms,
  CASE WHEN clear THEN NULL ELSE detected_tech END AS detected_tech,
  CASE WHEN clear THEN NULL ELSE detected_category END AS detected_category, ct_source
FROM fx"""
