"""Given tables and the feeds derived from them.

Each feed is one SQL text over the registered views, written in the subset
Spark SQL and DuckDB share (no backslashes, no quote doubling -- single
quotes are built with chr(39)).  Spark runs it with ``spark.sql``; the
oracle embeds the same text as a CTE.  Feeds grow with ``pages``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sitelens.session import session_key

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    # The test files hold one row group each (one scan task).  Spread only when the
    # scan itself is narrower than the cluster; at scale file splits give the tasks.
    par = spark.sparkContext.defaultParallelism
    if name in ("pages", "events") and df.rdd.getNumPartitions() < par:
        df = df.repartition(par, *(["page_id"] if name == "pages" else ["event_id"]))
    return df


_REGISTERED: dict[tuple[str, str], str] = {}


def register(spark: SparkSession, sf_dir: str, names=("pages",)) -> None:
    """Register the given tables as views (once per session and directory)."""
    for n in names:
        key = (session_key(spark), n)
        if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists(n):
            continue
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
        _REGISTERED[key] = sf_dir


def _q(s: str) -> str:
    """A SQL string literal with no quote doubling: ' becomes chr(39)."""
    if "'" not in s:
        return "'" + s + "'"
    parts = s.split("'")
    return "concat(" + ", chr(39), ".join("'" + p + "'" for p in parts) + ")"


# --- F2: augmented html ------------------------------------------------------
# Fixed head snippets by page_id % 6 (FIXTURES F2).
F2_SNIPPETS = [
    '<meta name="generator" content="WordPress 6.4.2"><link rel="stylesheet" href="/wp-content/a.css">',
    '<script src="https://cdn.jsdelivr.net/npm/jquery-3.6.0.min.js"></script>',
    "<link rel=\"manifest\" href=\"/manifest.json\"><META PROPERTY='og:type' CONTENT='article'>",
    '<link href="https://fonts.googleapis.com/css?family=Roboto" rel="stylesheet"><script src=" /static/app.js "></script>',
    '<input type="hidden" name="csrfmiddlewaretoken"><meta name="Generator" content="first">'
    '<meta name="generator" content="Drupal 10">',
    "",
]
BODY_DATA = '<body data-theme="t" data-k="2">'


def f2_sql() -> str:
    cases = "\n".join(f"      WHEN {i} THEN replace(html, '</head>', {_q(s + '</head>')})"
                      for i, s in enumerate(F2_SNIPPETS) if s)
    return f"""SELECT page_id, url,
  replace(CASE page_id % 6
{cases}
      ELSE html END,
    '<body>', CASE WHEN page_id % 5 = 0 THEN {_q(BODY_DATA)} ELSE '<body>' END) AS html
FROM pages"""


# --- F3: response hops, headers and cookies ----------------------------------
# Template rows apply where page_id % m = r.  hop 1 is the final response,
# hop 0 a redirect in front of it (only where page_id % 5 = 2).
F3_HEADERS = [
    # (m, r, hop, pos, name, value)
    (6, 0, 1, 0, "Server", "nginx/1.25.3"),
    (6, 1, 1, 0, "Server", "Apache/2.4.57 (Ubuntu)"),
    (6, 2, 1, 0, "Server", "cloudflare"),
    (6, 3, 1, 0, "Server", "Vercel"),
    (6, 4, 1, 0, "Server", "nginx"),
    (3, 1, 1, 1, "X-Powered-By", "PHP/8.2.1"),
    (4, 0, 1, 2, "Via", "1.1 a"),
    (4, 0, 1, 3, "via", "1.1 b"),
    (1, 0, 1, 4, "Content-Type", "text/html; charset=utf-8"),
    (7, 2, 1, 5, "X-Generator", "Drupal 10"),
    (5, 2, 0, 0, "Server", "awselb/2.0"),
    (5, 2, 0, 1, "Location", "/home"),
    (5, 2, 0, 2, "X-Cache", "Miss from cloudfront"),
    (5, 2, 0, 3, "Set-Cookie", "AWSALB=abc; Path=/"),
    (3, 1, 1, 6, "Set-Cookie", "PHPSESSID=s1; Path=/"),
]
F3_STATUS = [
    # (m, r, hop, status)
    (1, 0, 1, 200),
    (5, 2, 0, 301),
]
F3_COOKIES = [
    # (m, r, hop, origin, name, value)   origin: jar (client jar) or response (final response)
    (3, 1, 1, "jar", "PHPSESSID", "s1"),
    (6, 4, 1, "jar", "csrftoken", "tok"),
    (4, 1, 0, "jar", "session", "from-jar"),
    (4, 1, 1, "response", "session", "from-response"),
    (4, 1, 1, "response", "lang", "fr"),
    (5, 2, 0, "jar", "AWSALB", "abc"),
]


def _values(rows, cols: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else _q(v)
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS t({cols})"


def f3_headers_sql() -> str:
    return f"""SELECT p.page_id, t.hop, t.pos, t.name, t.value
FROM pages p JOIN {_values(F3_HEADERS, 'm, r, hop, pos, name, value')}
  ON p.page_id % t.m = t.r"""


def f3_status_sql() -> str:
    # hop 1 answers 404 on every 11th page (S18: error recorded, payload kept)
    return f"""SELECT p.page_id, p.url, t.hop,
  CASE WHEN t.hop = 1 AND p.page_id % 11 = 10 THEN 404 ELSE t.status END AS status
FROM pages p JOIN {_values(F3_STATUS, 'm, r, hop, status')}
  ON p.page_id % t.m = t.r"""


def f3_cookies_sql() -> str:
    return f"""SELECT p.page_id, t.hop, t.origin, t.name, t.value
FROM pages p JOIN {_values(F3_COOKIES, 'm, r, hop, origin, name, value')}
  ON p.page_id % t.m = t.r"""


# --- F4: JS globals -------------------------------------------------------------
def f4_sql() -> str:
    long_val = "x" * 150
    rows = [
        (6, 1, 0, "window.jQuery?.fn?.jquery", "3.6.0"),
        (6, 1, 1, "window.jQuery", "function"),
        (7, 3, 2, "window.React", "function"),
        (7, 3, 3, "window.React?.version", "18.2.0"),
        (5, 4, 4, "window.React", long_val),
        (9, 0, 5, "window.__NEXT_DATA__", "object"),
    ]
    return f"""SELECT p.page_id, t.pos, t.key, t.value
FROM pages p JOIN {_values(rows, 'm, r, pos, key, value')}
  ON p.page_id % t.m = t.r"""


# --- F5: request log ---------------------------------------------------------
# {h} is the page host.  seq 9 never gets a response.
F5_TEMPLATE = [
    # (seq, url, method, resource_type, status, content_type)
    (1, "https://{h}/api/v1/users", "GET", "xhr", 200, "application/json"),
    (2, "https://{h}/api/v1/users/", "POST", "fetch", 200, "text/plain"),
    (3, "https://api.{h}/graphql?x=1", "POST", "fetch", 200, "application/graphql"),
    (4, "https://{h}/assets/app.js", "GET", "script", 200, "application/javascript"),
    (5, "https://maps.googleapis.com/maps/api/gen_204", "GET", "xhr", 204, ""),
    (6, "https://cdn.jsdelivr.net/npm/vue", "GET", "script", 200, "application/javascript"),
    (7, "https://www.jsdelivr.com/t.js", "GET", "script", 200, "application/javascript"),
    (8, "https://some-unknown-cdn.example.io:8443/lib.js", "GET", "script", 200, "application/javascript"),
    (9, "https://{h}/slow", "GET", "xhr", -1, ""),
    (10, "https://{h}/rest/v2/items?next=/api/", "GET", "fetch", 200, "application/json; charset=utf-8"),
    (11, "https://fonts.googleapis.com/css?family=Roboto:400,700", "GET", "stylesheet", 200, "text/css"),
    (12, "https://{h}//wp-json//wp/v2/posts/", "GET", "xhr", 200, "application/json"),
]

# host of the page url: text between '://' and the next '/', '?', '#' or ':'
PAGE_HOST_SQL = "lower(split_part(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), ':', 1))"


def f5_requests_sql() -> str:
    rows = [(s, u.replace("{h}", "#H#"), m, r, st, ct) for s, u, m, r, st, ct in F5_TEMPLATE]
    return f"""SELECT page_id, site_url, seq,
  replace(t.url, '#H#', host) AS url, t.method, t.resource_type,
  CASE WHEN t.status < 0 THEN NULL ELSE t.status END AS status,
  CASE WHEN t.status < 0 OR t.content_type = '' THEN NULL ELSE t.content_type END AS content_type
FROM (SELECT page_id, url AS site_url, {PAGE_HOST_SQL} AS host FROM pages) p
JOIN {_values(rows, 'seq, url, method, resource_type, status, content_type')}
  ON (p.page_id + t.seq) % 3 <> 0"""


# --- F6: JS bundles and source maps ---------------------------------------------
# Two bundles per page; {h} page host, {id} page id.  No backslashes anywhere.
_F6_APP = ('fetch("/api/v1/users?id={id}");axios.get("/api/v2/items/{id}");const a="https://{h}/api/v3/self";'
           'const b="https://api.stripe.com/v1/api/charges";var c={url: "/dashboard/{id}"};var d="/v1/orders/{id}";'
           'fetch("//cdn.{h}/lib/x.js");fetch(`data:text/plain,abc`);var r={route: "/graphql/{id}"};'
           ';//# sourceMappingURL=app.js.map?v={id}')
_F6_INLINE_MAP = ('{"version":3,"sources":["a.js","b.js"],'
                  '"sourcesContent":[null,"fetch(`/api/v1/from-sourcemap`)"]}')
_F6_VENDOR = ('axios.post("/api/v1/login");const e="https://www.{h}/api/v1/www-ok";fetch("/not-an-api-route/{id}");'
              ';//# sourceMappingURL=data:application/json;base64,#B64#')
_F6_APP_MAP = '{"version":3,"sources":["x.js"],"sourcesContent":[null,"axios.get(`/api/v1/mapped/{id}`)",7]}'
_F6_VENDOR_MAP = '{"version":3,"sourcesContent":["fetch(`/api/v1/from-header-map`)"]}'


def _tmpl(s: str) -> str:
    """SQL expression filling {h} (column host) and {id} (column page_id) into a template."""
    import base64
    s = s.replace("#B64#", base64.b64encode(_F6_INLINE_MAP.encode()).decode())
    parts = []
    for chunk in s.split("{h}"):
        sub = chunk.split("{id}")
        parts.append(", CAST(page_id AS STRING), ".join(_q(x) for x in sub))
    return "concat(" + ", host, ".join(parts) + ")"


def f6_scripts_sql() -> str:
    return f"""SELECT page_id, url, 'https://' || host || '/static/app.js' AS js_url,
  CAST(NULL AS STRING) AS x_sourcemap, CAST(NULL AS STRING) AS sourcemap, {_tmpl(_F6_APP)} AS body
FROM (SELECT page_id, url, {PAGE_HOST_SQL} AS host FROM pages) p
UNION ALL
SELECT page_id, url, 'https://' || host || '/static/vendor.js' AS js_url,
  CASE WHEN page_id % 2 = 0 THEN 'vendor.js.map?v=' || CAST(page_id AS STRING) END AS x_sourcemap, CAST(NULL AS STRING) AS sourcemap,
  {_tmpl(_F6_VENDOR)} AS body
FROM (SELECT page_id, url, {PAGE_HOST_SQL} AS host FROM pages) p"""


def f6_maps_sql() -> str:
    return f"""SELECT 'https://' || host || '/static/app.js.map?v=' || CAST(page_id AS STRING) AS url, {_tmpl(_F6_APP_MAP)} AS body
FROM (SELECT page_id, {PAGE_HOST_SQL} AS host FROM pages) p
UNION ALL
SELECT 'https://' || host || '/static/vendor.js.map?v=' || CAST(page_id AS STRING) AS url, {_tmpl(_F6_VENDOR_MAP)} AS body
FROM (SELECT page_id, {PAGE_HOST_SQL} AS host FROM pages) p"""


# --- F7: probe responses ---------------------------------------------------------
F7_SPEC1 = ('{"openapi":"3.0.0","info":{"title":"Demo API","version":"1.2.3"},"paths":{'
            '"/api/users":{"get":{},"post":{}},"/api/items/{id}":{"PUT":{},"get":{}},"/health":{},'
            '"/ping":"x","/api/users/":{"delete":{}}}}')
F7_SPEC2 = '{"swagger":"2.0","info":{"title":"Second"},"paths":{"/v2/pets":{"post":{}},"/v2/pets//":{}}}'


def f7_probes_sql() -> str:
    from sitelens.operators.network import PROBE_PATHS
    rows = [(i, p) for i, p in enumerate(PROBE_PATHS)]
    k = "(p.page_id + t.path_rank) % 4"
    return f"""SELECT p.page_id, p.url AS site_url, t.path_rank AS seq, t.path_rank, t.path,
  'https://' || p.host || t.path AS url, 'GET' AS method, 'probe' AS resource_type,
  CASE {k} WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 ELSE 301 END AS status,
  CASE {k} WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=utf-8'
           WHEN 2 THEN 'text/html' ELSE 'text/plain' END AS content_type,
  CASE {k}
    WHEN 0 THEN CASE t.path WHEN '/openapi.json' THEN {_q(F7_SPEC1)} WHEN '/v3/api-docs' THEN {_q(F7_SPEC2)}
                ELSE '{{"ok":true}}' END
    WHEN 1 THEN CASE WHEN t.path_rank % 3 = 0 THEN '{{"html":"json"}}' ELSE '<html>nope</html>' END
    WHEN 2 THEN '<html>404</html>' ELSE '' END AS body
FROM (SELECT page_id, url, {PAGE_HOST_SQL} AS host FROM pages) p
JOIN {_values(rows, 'path_rank, path')} ON TRUE"""


# --- F8: certificate-log names and subdomain responses -------------------------------
_SITE_DOMAINS = (f"SELECT DISTINCT CASE WHEN left(h, 4) = 'www.' THEN substr(h, 5) ELSE h END AS domain "
                 f"FROM (SELECT {PAGE_HOST_SQL} AS h FROM pages) x")


def f8_ct_sql() -> str:
    """(domain, source, source_rank, entry_pos, raw); hackertarget only answers for even-length domains."""
    nl = "chr(10)"
    return f"""SELECT domain, 'hackertarget' AS source, 0 AS source_rank, 0 AS entry_pos, 'api.' || domain || ',10.0.0.1' AS raw
FROM ({_SITE_DOMAINS}) d WHERE length(domain) % 2 = 0
UNION ALL SELECT domain, 'hackertarget', 0, 1, upper('static.' || domain) || ',10.0.0.2' FROM ({_SITE_DOMAINS}) d
  WHERE length(domain) % 2 = 0
UNION ALL SELECT domain, 'hackertarget', 0, 2, '*.' || domain || ',10.0.0.3' FROM ({_SITE_DOMAINS}) d
  WHERE length(domain) % 2 = 0
UNION ALL SELECT domain, 'crt.sh', 1, 0, '*.' || domain || {nl} || 'www.' || domain FROM ({_SITE_DOMAINS}) d
UNION ALL SELECT domain, 'crt.sh', 1, 1, ' API.' || domain || ' ' || {nl} || 'evil-' || domain || '.org' || {nl} || ' '
  || {nl} || domain || {nl} || 'www.' || domain FROM ({_SITE_DOMAINS}) d
UNION ALL SELECT domain, 'certspotter', 2, 0, '["mail.' || domain || '","*.' || domain || '"]' FROM ({_SITE_DOMAINS}) d"""


F8_PREFIXES = ["", "www.", "api.", "static.", "mail."]
F8_STATUS = [200, 301, 404, 403, 302, 201, 500, 401]


def f8_responses_sql() -> str:
    """(subdomain, status, response_time_ms) for every name a source could report."""
    pre = _values([(i, p) for i, p in enumerate(F8_PREFIXES)], "prefix_id, prefix")
    st = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(F8_STATUS))
    return f"""SELECT t.prefix || d.domain AS subdomain,
  CASE (length(d.domain) + t.prefix_id) % {len(F8_STATUS)} {st} END AS status,
  CAST(length(d.domain) * 3.14159 + t.prefix_id AS DOUBLE) AS response_time_ms
FROM ({_SITE_DOMAINS}) d JOIN {pre} ON TRUE"""


def f8_headers_sql() -> str:
    """(subdomain, key_norm, value): server, content-type and a location (external on odd lengths)."""
    pre = _values([(i, p) for i, p in enumerate(F8_PREFIXES)], "prefix_id, prefix")
    servers = ["nginx/1.25.3", "cloudflare", "Apache/2.4.57 (Ubuntu)", "Vercel", "awselb/2.0"]
    sv = " ".join(f"WHEN {i} THEN {_q(s)}" for i, s in enumerate(servers))
    base = f"SELECT t.prefix || d.domain AS subdomain, length(d.domain) + t.prefix_id AS k FROM ({_SITE_DOMAINS}) d JOIN {pre} ON TRUE"
    return f"""SELECT subdomain, 'server' AS key_norm, CASE k % {len(servers)} {sv} END AS value FROM ({base}) b
UNION ALL SELECT subdomain, 'content-type', 'text/html' FROM ({base}) b
UNION ALL SELECT subdomain, 'x-powered-by', 'PHP/8.1' FROM ({base}) b WHERE k % 4 = 1
UNION ALL SELECT subdomain, 'location', CASE WHEN k % 2 = 1 THEN 'https://elsewhere.org/login' ELSE '/home' END
  FROM ({base}) b"""


# --- F7 (wordlists): listings, lines, observed path responses --------------------------
F7_LISTING = [
    # (listing_ord, item_pos, name, type, download_url)
    (0, 0, "quickhits.txt", "file", "https://dl/quickhits.txt"),
    (0, 1, "swagger.txt", "file", "https://dl/old/swagger.txt"),
    (0, 2, "big.txt", "file", "https://dl/big.txt"),
    (0, 3, "README.md", "file", "https://dl/README.md"),
    (0, 4, "CMS", "dir", ""),
    (1, 0, "api-endpoints.txt", "file", "https://dl/api-endpoints.txt"),
    (1, 1, "graphql.txt", "file", ""),
    (2, 0, "django.txt", "file", "https://dl/django.txt"),
    (2, 1, "wp-plugins.fuzz.txt", "file", "https://dl/wp-plugins.fuzz.txt"),
    (2, 2, "SAP-NetWeaver.txt", "file", "https://dl/SAP-NetWeaver.txt"),
    (2, 3, "swagger.txt", "file", "https://dl/swagger.txt"),
    (2, 4, "php.txt", "file", "https://dl/php.txt"),
    (2, 5, "jquery.txt", "file", "https://dl/jquery.txt"),
]
# Files that receive page-derived lines, by page_id % 8.
F7_WORDLIST_FILES = ["quickhits.txt", "swagger.txt", "django.txt", "wp-plugins.fuzz.txt", "SAP-NetWeaver.txt",
                     "big.txt", "php.txt", "jquery.txt"]
# Fixed lines at the head of every file (comment, blank, no slash, duplicates, critical paths).
F7_FIXED_LINES = ["# note", "", "backup.zip", "/.env", "/.env", "/.git/config", "  /admin/  ", "/api/v1",
                  "/wp-login.php", "/robots.txt"]


def f7_listing_sql() -> str:
    return f"SELECT * FROM {_values(F7_LISTING, 'listing_ord, item_pos, name, type, download_url')}"


def f7_lines_sql() -> str:
    """(filename, line_no, line): fixed head lines per file, then the six nav links of every page."""
    files = _values([(i, f) for i, f in enumerate(F7_WORDLIST_FILES)], "file_id, filename")
    fixed = _values([(i, l) for i, l in enumerate(F7_FIXED_LINES)], "k, line")
    ks = _values([(k,) for k in range(1, 7)], "k")
    href = "split_part(split_part(p.html, '<a href=\"', t.k + 1), '\"', 1)"
    return f"""SELECT f.filename, CAST(x.k - 100 AS BIGINT) AS line_no, x.line FROM {files.replace('AS t(', 'AS f(')}
  JOIN {fixed.replace('AS t(', 'AS x(')} ON TRUE
UNION ALL
SELECT f.filename, CAST(p.page_id * 10 + t.k AS BIGINT) AS line_no, {href} AS line
FROM pages p JOIN {ks} ON TRUE
JOIN {files.replace('AS t(', 'AS f(')} ON p.page_id % {len(F7_WORDLIST_FILES)} = f.file_id"""


def f7_site_sql() -> str:
    """per page: base_url (scheme://netloc of the page) and the canary answer."""
    return f"""SELECT page_id, url AS site_url,
  split_part(url, '://', 1) || '://' || split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS base_url,
  CASE WHEN page_id % 4 = 0 THEN 301 ELSE 404 END AS canary_status,
  CASE WHEN page_id % 4 = 0 THEN '/Home/' END AS canary_location
FROM pages"""


F7_RESP_STATUS = [200, 200, 401, 403, 301, 302, 404, 301, 500]


def f7_responses_sql(probes: str, extra: str | None = None) -> str:
    """Observed answers for probed (page_id, path) rows of ``probes``; a function of page and path.

    ``extra``: further columns to keep of probes that have their site's ``site_url`` and ``base_url`` already.
    """
    site, source = "s", f"{probes} pr JOIN ({f7_site_sql()}) s ON s.page_id = pr.page_id"
    if extra is not None:
        site, source = "pr", f"{probes} pr"
    h = f"((pr.page_id + length(pr.path)) % {len(F7_RESP_STATUS)})"
    st = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(F7_RESP_STATUS))
    return f"""SELECT pr.page_id, pr.rank, pr.filename, pr.path, {site}.site_url, {site}.base_url,
  CASE {h} {st} END AS status,
  CASE {h} WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type,
  CASE {h} WHEN 4 THEN pr.path || '/'
           WHEN 5 THEN CASE length(pr.path) % 4 WHEN 0 THEN '/login' WHEN 1 THEN 'https://other-site.org/x'
                       WHEN 2 THEN '/home' ELSE pr.path || '/v2' END
           WHEN 7 THEN '/moved' || pr.path END AS location,
  CASE {h} WHEN 0 THEN '{{"name":"x","version":1}}'
           WHEN 1 THEN CASE WHEN length(pr.path) % 2 = 0 THEN '{{"k":1}}' ELSE '<html>page</html>' END
           ELSE '' END AS body,
  CASE pr.page_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 403 END AS next_status,
  'application/json' AS next_content_type, '{{"a":1,"b":2}}' AS next_body, CAST(NULL AS STRING) AS next_location{extra or ''}
FROM {source}"""
