"""Registered queries: HTML evidence (H1-H7, H9), response tables (S6-S9, S18),
keyed / script / JS-global matching (M1-M4, M6, M7), scoring and implies (A1-A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import evidence as E
from sitelens.operators import implies as I
from sitelens.operators import match as M
from sitelens.operators import score as S
from sitelens.plans import oracle as O
from sitelens.plans.catalog import (SCORED_COLS, _pats, _rules, _setup, _spark_scored, o_html_matches,
                                    o_keyed_matches, o_score, oracle, query)
from sitelens.plans.detect import matches_raw
from sitelens.sources import feeds as FD

q = O.sql_str


# --- feeds in Spark ------------------------------------------------------------
def f2(spark, sf_dir) -> DataFrame:
    _setup(spark, sf_dir)
    return E.page_source(spark.sql(FD.f2_sql()))


def f3(spark, sf_dir):
    _setup(spark, sf_dir)
    return spark.sql(FD.f3_headers_sql()), spark.sql(FD.f3_status_sql()), spark.sql(FD.f3_cookies_sql())


def f4(spark, sf_dir):
    _setup(spark, sf_dir)
    return spark.sql(FD.f4_sql())


def f5(spark, sf_dir):
    _setup(spark, sf_dir)
    return spark.sql(FD.f5_requests_sql())


# --- DuckDB versions of the html expressions ---------------------------------------
# The oracle masks comments and raw text first, then reads tags: RE2 has neither lookaround nor possessive
# repetitions, so this is another route to the same rows (on markup that is well formed).
_O_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_O_SECTION = rf"(?:[\s/]{_O_ATTRS})?"
# Groups: 1 comment text, 2 script start tag, 3 script body, 4 script end tag, 5 style start tag, 6 style end tag.
_O_RAW_TEXT = rf"(?is)<!--(.*?)-->|(<script{_O_SECTION}>)(.*?)(</script\s*>)|(<style{_O_SECTION}>).*?(</style\s*>)"


_O_HAS_SRC = r"(?is)(?:^|[\s/])src(?:\s*=|[\s/]|$)"


def _o_attr_rx(name: str) -> str:
    return r"(?is)(?:^|[\s/])" + name + r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def d_masked(h: str) -> str:
    return f"regexp_replace({h}, {q(_O_RAW_TEXT)}, '\\2\\4\\5\\6', 'g')"


def d_raw_text(h: str, group: int) -> str:
    return f"regexp_extract_all({h}, {q(_O_RAW_TEXT)}, {group})"


def d_tags(mh: str, tag: str) -> str:
    return f"regexp_extract_all({mh}, {q(rf'(?is)<{tag}({_O_SECTION})>')}, 1)"


def d_unescape(v: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                    ("&apos;", "'"), ("&nbsp;", " ")):
        v = f"replace({v}, {q(ent)}, {q(ch)})"
    return f"replace({v}, '&amp;', '&')"


def d_attr(a: str, name: str) -> str:
    raw = f"list_extract(regexp_extract_all({a}, {q(_o_attr_rx(name))}, 1), -1)"
    unq = f"CASE WHEN left({raw}, 1) IN ('\"', '''') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    return d_unescape(unq)


def d_explode(src: str, arr: str, cols: str = "page_id") -> str:
    """rows (cols..., pos 0-based, a) of the list ``arr`` computed per row of ``src``."""
    return f"""SELECT {cols}, pos - 1 AS pos, arr[pos] AS a FROM (
  SELECT {cols}, arr, generate_subscripts(arr, 1) AS pos FROM (SELECT {cols}, {arr} AS arr FROM {src}))"""


F2_CTE = f"WITH f2 AS (SELECT page_id, url, html FROM ({FD.f2_sql()}))"


# ---------------------------------------------------------------------------
# H1-H7: html evidence over F2
# ---------------------------------------------------------------------------
@query("meta_tags")
def q_meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.meta_tags(f2(spark, sf_dir))


@oracle("meta_tags")
def o_meta_tags() -> str:
    key = (f"lower(coalesce(nullif({d_attr('a', 'name')}, ''), nullif({d_attr('a', 'property')}, ''), "
           f"nullif({d_attr('a', 'http-equiv')}, '')))")
    return f"""{F2_CTE},
t AS ({d_explode('f2', d_tags(d_masked('html'), 'meta'))}),
r AS (SELECT page_id, pos, {key} AS key, {d_attr('a', 'content')} AS content FROM t)
SELECT page_id, key, arg_max(content, pos) AS content FROM r
WHERE key <> '' AND content <> '' GROUP BY page_id, key"""


def _o_tag_attr(tag: str, attr_name: str) -> str:
    return f"""{F2_CTE},
t AS ({d_explode('f2', d_tags(d_masked('html'), tag))}),
r AS (SELECT page_id, pos, {d_attr('a', attr_name)} AS v FROM t)
SELECT page_id, pos, {O.d_strip('v')} AS {attr_name} FROM r WHERE v IS NOT NULL AND v <> ''"""


@query("script_srcs")
def q_script_srcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.script_srcs(f2(spark, sf_dir))


@oracle("script_srcs")
def o_script_srcs() -> str:
    return _o_tag_attr("script", "src")


@query("link_hrefs")
def q_link_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.link_hrefs(f2(spark, sf_dir))


@oracle("link_hrefs")
def o_link_hrefs() -> str:
    return _o_tag_attr("link", "href")


@query("inline_scripts")
def q_inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.inline_scripts(f2(spark, sf_dir))


@oracle("inline_scripts")
def o_inline_scripts() -> str:
    return f"""{F2_CTE},
b AS (SELECT page_id, {d_raw_text('html', 2)} AS tags, {d_raw_text('html', 3)} AS bodies FROM f2),
e AS (SELECT page_id, n, tags[n] AS tag, bodies[n] AS body FROM (SELECT *, generate_subscripts(tags, 1) AS n FROM b)),
t AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, regexp_replace(tag, '^<[A-Za-z]+|>$', '', 'g') AS attrs, body
      FROM e WHERE tag <> '')
SELECT page_id, pos, {O.d_strip('body')} AS script FROM t
WHERE NOT regexp_matches(attrs, {q(_O_HAS_SRC)}) AND {O.d_strip('body')} <> ''"""


@query("html_comments")
def q_html_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.html_comments(f2(spark, sf_dir))


@oracle("html_comments")
def o_html_comments() -> str:
    return f"""{F2_CTE},
t AS ({d_explode('f2', f"list_filter({d_raw_text('html', 0)}, lambda x: starts_with(x, '<!--'))")})
SELECT page_id, pos, {O.d_strip('substr(a, 5, length(a) - 7)')} AS comment FROM t WHERE {O.d_strip('substr(a, 5, length(a) - 7)')} <> ''"""


@query("data_attributes")
def q_data_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.data_attributes(f2(spark, sf_dir))


@oracle("data_attributes")
def o_data_attributes() -> str:
    rx_pair = r"""(?is)(?:^|[\s/])(data-[^\s"'>/=]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    parts = []
    for order, tag in enumerate(["html", "body"]):
        first = f"list_extract({d_tags(d_masked('html'), tag)}, 1)"
        parts.append(f"""SELECT page_id, {order} AS tag_ord, pos - 1 AS pos, ks[pos] AS k, vs[pos] AS v FROM (
  SELECT *, generate_subscripts(ks, 1) AS pos FROM (
    SELECT page_id, regexp_extract_all(f, {q(rx_pair)}, 1) AS ks, regexp_extract_all(f, {q(rx_pair)}, 2) AS vs
    FROM (SELECT page_id, {first} AS f FROM f2)))""")
    unq = "CASE WHEN left(v, 1) IN ('\"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END"
    return f"""{F2_CTE},
d AS ({' UNION ALL '.join(parts)})
SELECT page_id, lower(k) AS name, arg_max({d_unescape(unq)}, tag_ord * 1000000 + pos) AS value
FROM d GROUP BY page_id, lower(k)"""


@query("manifest_url")
def q_manifest_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.manifest_url(f2(spark, sf_dir))


@oracle("manifest_url")
def o_manifest_url() -> str:
    return f"""{F2_CTE},
t AS ({d_explode('f2', d_tags(d_masked('html'), 'link'))}),
r AS (SELECT page_id, pos, lower(coalesce({d_attr('a', 'rel')}, '')) AS rel, {O.d_strip(d_attr('a', 'href'))} AS href FROM t)
SELECT page_id, arg_min(href, pos) AS manifest_url FROM r
WHERE list_contains(regexp_split_to_array({O.d_strip('rel')}, '\\s+'), 'manifest')
GROUP BY page_id HAVING arg_min(href, pos) IS NOT NULL AND arg_min(href, pos) <> ''"""


# ---------------------------------------------------------------------------
# H9: same-site links over the given pages (root-relative nav links)
# ---------------------------------------------------------------------------
@query("site_links")
def q_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _setup(spark, sf_dir)
    return E.site_links(E.page_source(spark.table("pages")))


@oracle("site_links")
def o_site_links() -> str:
    resolved = O.d_resolve("url", "href")
    url_rx = O.URL_RX
    nl = lambda u: f"lower(regexp_extract({u}, {q(url_rx)}, 2))"
    return f"""WITH pg AS (SELECT page_id, url, html FROM pages),
t AS ({d_explode('pg', d_tags(d_masked('html'), 'a'), 'page_id, url')}),
r AS (SELECT page_id, url, pos, {d_attr('a', 'href')} AS href FROM t),
l AS (SELECT page_id, url, pos, regexp_replace({resolved}, '#.*$', '') AS link FROM r WHERE href IS NOT NULL),
d AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE {nl('link')} = {nl('url')} GROUP BY page_id, link),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM d)
SELECT page_id, link, pos, rank FROM k"""


# ---------------------------------------------------------------------------
# S6-S9, S18 over F3
# ---------------------------------------------------------------------------
F3_CTE = (f"WITH h AS ({FD.f3_headers_sql()}),\nst AS ({FD.f3_status_sql()}),\nck AS ({FD.f3_cookies_sql()}),\n"
          "fh AS (SELECT page_id, max(hop) AS final_hop FROM st GROUP BY page_id)")
O_FOLD = """SELECT h.page_id, lower(h.name) AS name, string_agg(h.value, ', ' ORDER BY h.pos) AS value
FROM h JOIN fh ON h.page_id = fh.page_id AND h.hop = fh.final_hop GROUP BY h.page_id, lower(h.name)"""
O_COOKIES = """SELECT page_id, name, arg_min(value, CASE WHEN origin = 'jar' THEN 0 ELSE 1 END * 1000 - hop) AS value
FROM ck GROUP BY page_id, name"""


@query("header_fold")
def q_header_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, st, _ = f3(spark, sf_dir)
    return E.fold_headers(h, st)


@oracle("header_fold")
def o_header_fold() -> str:
    return f"{F3_CTE}\n{O_FOLD}"


@query("cookie_first_wins")
def q_cookie_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ck = f3(spark, sf_dir)
    return E.first_cookies(ck)


@oracle("cookie_first_wins")
def o_cookie_first_wins() -> str:
    return f"{F3_CTE}\n{O_COOKIES}"


@query("raw_set_cookies")
def q_raw_set_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _, _ = f3(spark, sf_dir)
    return E.raw_set_cookies(h)


@oracle("raw_set_cookies")
def o_raw_set_cookies() -> str:
    return f"""{F3_CTE}
SELECT page_id, hop, pos, value AS raw, {O.d_strip("split_part(value, '=', 1)")} AS cookie_name
FROM h WHERE lower(name) = 'set-cookie'"""


@query("redirect_hops")
def q_redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, st, _ = f3(spark, sf_dir)
    hops = E.redirect_hops(h, st)
    return hops.select("page_id", "hop", "status", F.explode_outer(F.map_entries("headers")).alias("e")) \
        .select("page_id", "hop", "status", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


@oracle("redirect_hops")
def o_redirect_hops() -> str:
    keep = ", ".join(q(k) for k in E.REDIRECT_KEEP)
    return f"""{F3_CTE},
hops AS (SELECT st.page_id, st.hop, st.status FROM st JOIN fh ON st.page_id = fh.page_id AND st.hop < fh.final_hop),
hh AS (SELECT page_id, hop, lower(name) AS name, string_agg(value, ', ' ORDER BY pos) AS value FROM h
       WHERE lower(name) IN ({keep}) GROUP BY page_id, hop, lower(name))
SELECT hops.page_id, hops.hop, hops.status, hh.name, hh.value
FROM hops LEFT JOIN hh ON hops.page_id = hh.page_id AND hops.hop = hh.hop"""


@query("collection_errors")
def q_collection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, st, _ = f3(spark, sf_dir)
    return E.collection_errors(st).select("page_id", "status", F.size("errors").alias("n_errors"),
                                          F.array_join("errors", "; ").alias("errors"))


@oracle("collection_errors")
def o_collection_errors() -> str:
    return f"""{F3_CTE}
SELECT st.page_id, st.status, CASE WHEN st.status >= 400 THEN 1 ELSE 0 END AS n_errors,
  CASE WHEN st.status >= 400 THEN 'HTTP ' || CAST(st.status AS VARCHAR) || ' from ' || st.url ELSE '' END AS errors
FROM st JOIN fh ON st.page_id = fh.page_id AND st.hop = fh.final_hop"""


# ---------------------------------------------------------------------------
# M1-M4, M6: per-source matches (matches_raw rows)
# ---------------------------------------------------------------------------
RAW_COLS = ["page_id", "tech_key", "src", "pos", "key", "matched", "pattern", "version"]


def _raw(df: DataFrame) -> DataFrame:
    return df.select(*RAW_COLS)


@query("header_match")
def q_header_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, st, _ = f3(spark, sf_dir)
    cr = _rules(spark)
    ev = E.fold_headers(h, st).select("page_id", F.col("name").alias("key_norm"), "value")
    return _raw(M.match_keyed(ev, cr.patterns, "header"))


@oracle("header_match")
def o_header_match() -> str:
    return f"""{F3_CTE}, ev AS (SELECT page_id, name AS key_norm, value FROM ({O_FOLD}))
SELECT {', '.join(RAW_COLS)} FROM ({o_keyed_matches('header', 'ev')})"""


@query("cookie_match")
def q_cookie_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ck = f3(spark, sf_dir)
    cr = _rules(spark)
    ev = E.first_cookies(ck).select("page_id", F.lower("name").alias("key_norm"), "value")
    return _raw(M.match_keyed(ev, cr.patterns, "cookie"))


@oracle("cookie_match")
def o_cookie_match() -> str:
    return f"""{F3_CTE}, ev AS (SELECT page_id, lower(name) AS key_norm, value FROM ({O_COOKIES}))
SELECT {', '.join(RAW_COLS)} FROM ({o_keyed_matches('cookie', 'ev')})"""


@query("meta_match")
def q_meta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    ev = E.meta_tags(f2(spark, sf_dir)).select("page_id", F.col("key").alias("key_norm"),
                                              F.col("content").alias("value"))
    return _raw(M.match_keyed(ev, cr.patterns, "meta"))


@oracle("meta_match")
def o_meta_match() -> str:
    inner = o_meta_tags()
    return f"""WITH mt AS ({inner}), ev AS (SELECT page_id, key AS key_norm, content AS value FROM mt)
SELECT {', '.join(RAW_COLS)} FROM ({o_keyed_matches('meta', 'ev')})"""


def _script_vals_spark(spark, sf_dir):
    pages = f2(spark, sf_dir)
    return M.script_values(E.script_srcs(pages), E.link_hrefs(pages), f5(spark, sf_dir))


@query("script_match")
def q_script_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    return _raw(M.match_scripts(_script_vals_spark(spark, sf_dir), cr.patterns))


def o_script_values() -> str:
    return f"""SELECT page_id, 0 AS grp, pos, src AS value FROM ({_o_tag_attr('script', 'src')})
UNION ALL SELECT page_id, 1 AS grp, pos, href AS value FROM ({_o_tag_attr('link', 'href')})
UNION ALL SELECT page_id, 2 AS grp, seq AS pos, url AS value FROM ({FD.f5_requests_sql()})"""


def o_script_matches(vals: str = "sv") -> str:
    sels = []
    for p in _pats("script"):
        rx = f"'(?i)' || {q(p['pattern'])}"
        sub = f"contains(value, {q(p['pattern'])})"
        ver = (f"CASE WHEN {sub} THEN NULL ELSE nullif(regexp_extract(value, {rx}, 1), '') END"
               if p["n_groups"] > 0 else "CAST(NULL AS VARCHAR)")
        sels.append(f"""SELECT page_id, {q(p['tech_key'])} AS tech_key, 'script' AS src, {p['src_rank']} AS src_rank,
  {p['pos']} AS pos, 'script_src' AS key, arg_min(value, (CASE WHEN {sub} THEN 0 ELSE 1 END) * 1000000000 + grp * 100000000 + vpos) AS matched,
  {q(p['pattern'])} AS pattern,
  arg_min({ver}, (CASE WHEN {sub} THEN 0 ELSE 1 END) * 1000000000 + grp * 100000000 + vpos) AS version
FROM (SELECT page_id, grp, pos AS vpos, value FROM {vals}) WHERE {sub} OR regexp_matches(value, {rx}) GROUP BY page_id""")
    return "\nUNION ALL\n".join(sels)


@oracle("script_match")
def o_script_match() -> str:
    return f"""WITH sv AS ({o_script_values()})
SELECT {', '.join(RAW_COLS)} FROM ({o_script_matches('sv')})"""


@query("js_global_match")
def q_js_global_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    return _raw(M.match_js_globals(f4(spark, sf_dir), cr.patterns))


def d_js_key(k: str) -> str:
    return (f"trim(lower(regexp_replace(replace(regexp_replace({k}, '^window\\.', ''), '?.', '.'), "
            f"'\\(\\)$', '')))")


def o_js_matches(js: str = "js") -> str:
    sels = []
    for p in _pats("js_global"):
        rx = f"'(?i)' || {q(p['pattern'])}"
        dot = p["pattern"] == "."
        cond = "TRUE" if dot else f"regexp_matches(value, {rx})"
        ver = ("CAST(NULL AS VARCHAR)" if dot or p["n_groups"] == 0
               else f"nullif(regexp_extract(value, {rx}, 1), '')")
        sels.append(f"""SELECT page_id, {q(p['tech_key'])} AS tech_key, 'js_global' AS src, {p['src_rank']} AS src_rank,
  {p['pos']} AS pos, {q(p['key'])} AS key,
  CASE WHEN length(value) > 100 THEN substr(value, 1, 100) || '...' ELSE value END AS matched,
  {q(p['pattern'])} AS pattern, {ver} AS version
FROM jsn WHERE key_norm = {q(p['key_norm'])} AND {cond}""")
    return (f"WITH jsn AS (SELECT page_id, {d_js_key('key')} AS key_norm, arg_max(value, pos) AS value FROM {js} "
            f"GROUP BY page_id, {d_js_key('key')})\n" + "\nUNION ALL\n".join(sels))


@oracle("js_global_match")
def o_js_global_match() -> str:
    return f"""WITH js AS ({FD.f4_sql()})
SELECT {', '.join(RAW_COLS)} FROM ({o_js_matches('js')})"""


# ---------------------------------------------------------------------------
# A1-A4: every source scored together; A5/A7: implied technologies merged
# ---------------------------------------------------------------------------
def _all_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, st, ck = f3(spark, sf_dir)
    cr = _rules(spark)
    pages = f2(spark, sf_dir)
    return matches_raw(pages, cr, headers=E.fold_headers(h, st), cookies=E.first_cookies(ck),
                       js_globals=f4(spark, sf_dir), requests=f5(spark, sf_dir),
                       sources=("header", "cookie", "meta", "script", "html", "js_global"))


def o_all_raw() -> str:
    return f"""{F3_CTE},
{F2_CTE[5:]},
hv AS (SELECT page_id, name AS key_norm, value FROM ({O_FOLD})),
cv AS (SELECT page_id, lower(name) AS key_norm, value FROM ({O_COOKIES})),
mv AS (SELECT page_id, key AS key_norm, content AS value FROM ({_meta_rel()})),
sv AS ({o_script_values()}),
js AS ({FD.f4_sql()}),
m AS (
{o_keyed_matches('header', 'hv')}
UNION ALL {o_keyed_matches('cookie', 'cv')}
UNION ALL {o_keyed_matches('meta', 'mv')}
UNION ALL SELECT page_id, tech_key, src, src_rank, pos, key, matched, pattern, version FROM ({o_script_matches('sv')})
UNION ALL {o_html_matches('f2')}
UNION ALL SELECT * FROM ({o_js_matches('js')}))"""


def _meta_rel() -> str:
    key = (f"lower(coalesce(nullif({d_attr('a', 'name')}, ''), nullif({d_attr('a', 'property')}, ''), "
           f"nullif({d_attr('a', 'http-equiv')}, '')))")
    return f"""SELECT page_id, key, arg_max(content, pos) AS content FROM (
  SELECT page_id, pos, {key} AS key, {d_attr('a', 'content')} AS content
  FROM ({d_explode('f2', d_tags(d_masked('html'), 'meta'))}))
WHERE key <> '' AND content <> '' GROUP BY page_id, key"""


@query("tech_scores")
def q_tech_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    return _spark_scored(S.score(_all_raw(spark, sf_dir), cr.rules))


@oracle("tech_scores")
def o_tech_scores() -> str:
    return f"""{o_all_raw()}
SELECT {SCORED_COLS} FROM ({o_score('m')}) s"""


IMPLIED_COLS = ["page_id", "tech_key", "name", "category", "version", "confidence", "implied", "evidence", "rank"]


def implied_rows(tech: DataFrame, cr) -> DataFrame:
    merged = I.rank_matches(I.resolve_implies(tech, cr.rules, cr.walk))
    return merged.select("page_id", "tech_key", "name", "category", "version", "confidence", "implied",
                         S.evidence_text().alias("evidence"), "rank")


@query("tech_with_implied")
def q_tech_with_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    cr = _rules(spark)
    return implied_rows(S.score(_all_raw(spark, sf_dir), cr.rules), cr)


def o_implied(scored: str) -> str:
    """DuckDB: closure by a recursive walk over simple paths, then the page-level merge."""
    return f"""e AS ({O.implies_values()}),
rl AS ({O.rules_values()}),
walk AS (
  SELECT tech_key AS root_key, tech_key AS node_key, 0 AS depth, CAST([] AS INTEGER[]) AS path,
         [tech_key] AS visited FROM rl
  UNION ALL
  SELECT w.root_key, e.dst_key, w.depth + 1, list_append(w.path, CAST(e.pos AS INTEGER)), list_append(w.visited, e.dst_key)
  FROM walk w JOIN e ON e.src_key = w.node_key WHERE NOT list_contains(w.visited, e.dst_key)),
clo AS (SELECT root_key, node_key, min(list_prepend(depth, path)) AS dk FROM walk GROUP BY root_key, node_key),
dir AS (SELECT * FROM {scored}),
reach AS (SELECT d.page_id, c.node_key,
            min(list_concat([c.dk[1], d.ord], c.dk[2:])) AS k
          FROM dir d JOIN clo c ON c.root_key = d.tech_key GROUP BY d.page_id, c.node_key),
via AS (SELECT r.page_id, e.dst_key, min(list_append(r.k, CAST(e.pos AS INTEGER))) AS vk,
          arg_min(e.src_name, list_append(r.k, CAST(e.pos AS INTEGER))) AS via_name,
          arg_min(e.dst_raw, list_append(r.k, CAST(e.pos AS INTEGER))) AS dst_raw
        FROM reach r JOIN e ON e.src_key = r.node_key GROUP BY r.page_id, e.dst_key),
merged AS (
  SELECT coalesce(d.page_id, v.page_id) AS page_id, coalesce(d.tech_key, v.dst_key) AS tech_key,
    CASE WHEN d.tech_key IS NULL THEN coalesce(rl.name, v.dst_raw) ELSE d.name END AS name,
    CASE WHEN d.tech_key IS NULL THEN coalesce(rl.category, '') ELSE d.category END AS category,
    CASE WHEN d.tech_key IS NULL THEN NULL ELSE d.version END AS version,
    CASE WHEN d.tech_key IS NULL OR (v.dst_key IS NOT NULL AND d.confidence < 0.6) THEN CAST(0.6 AS DOUBLE) ELSE d.confidence END AS confidence,
    d.tech_key IS NULL AS implied,
    CASE WHEN d.tech_key IS NULL THEN 'implies:implies:Implied by ' || v.via_name
         WHEN v.dst_key IS NOT NULL AND d.confidence < 0.6 THEN d.evidence || ' | implies:implies:Implied by ' || v.via_name
         ELSE d.evidence END AS evidence,
    CASE WHEN d.tech_key IS NULL THEN list_prepend(1, v.vk) ELSE [0, 0, d.ord] END AS okey
  FROM dir d FULL OUTER JOIN via v ON d.page_id = v.page_id AND d.tech_key = v.dst_key
  LEFT JOIN rl ON rl.tech_key = v.dst_key)"""


@oracle("tech_with_implied")
def o_tech_with_implied() -> str:
    return f"""WITH RECURSIVE {o_all_raw()[5:]},
sc AS ({o_score('m')}),
{o_implied('sc')}
SELECT page_id, tech_key, name, category, version, confidence, implied, evidence,
  row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, okey) AS rank
FROM merged"""
