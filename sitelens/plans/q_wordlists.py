"""Registered queries: wordlists (S13, W1-W14), wordlist endpoints (E8) and the full
endpoint merge with all five stages (E9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import endpoints as EP
from sitelens.operators import implies as I
from sitelens.operators import score as S
from sitelens.operators import wordlists as W
from sitelens.plans import oracle as O
from sitelens.plans.catalog import _rules, _setup, o_score, oracle, query
from sitelens.plans.q_endpoints import MERGED_COLS, d_merged, d_spec_paths, d_static_routes, merged_stages
from sitelens.plans.q_evidence import _all_raw, o_all_raw, o_implied
from sitelens.functions.staging import written
from sitelens.sources import feeds as FD

q = O.sql_str


def _arr(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


# --- Spark side -----------------------------------------------------------------------
def _parsed(spark, sf_dir) -> DataFrame:
    _setup(spark, sf_dir)
    return W.parse_wordlists(spark.sql(FD.f7_lines_sql()))


def _manifest(spark, sf_dir, parsed: DataFrame | None = None) -> DataFrame:
    _setup(spark, sf_dir)
    files = W.listing_files(spark.sql(FD.f7_listing_sql()))
    return W.wordlist_manifest(files, _rules(spark).rules, _parsed(spark, sf_dir) if parsed is None else parsed)


def _detected(spark, sf_dir) -> DataFrame:
    cr = _rules(spark)
    return I.detected_names(_all_raw(spark, sf_dir), cr.rules, cr.walk)


def _listed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(page_id, fileset) and the list of each file set.  Each table that several branches read (the wordlists, their
    manifest, the detected names) is written once."""
    parsed = _parsed(spark, sf_dir).checkpoint()
    m = _manifest(spark, sf_dir, parsed).checkpoint()
    sets = W.select_wordlists(_detected(spark, sf_dir).checkpoint(), m, spark.table("pages")).checkpoint()
    return sets, W.ranked_lists(sets, m, parsed)


def _ranked(spark, sf_dir) -> DataFrame:
    sets, lists = _listed(spark, sf_dir)
    return W.listed_paths(sets, written(lists, "lists"), sets.count()).select("page_id", "rank", "filename", "path")


def _exposed(spark, sf_dir) -> DataFrame:
    """What a site has of its own (its URLs, its canary) joins it before its probes do."""
    sets, lists = _listed(spark, sf_dir)
    site = spark.sql(FD.f7_site_sql())
    canary = site.select("page_id", F.concat("base_url", F.lit("/_canary")).alias("canary_url"),
                         F.col("canary_status").alias("status"), F.col("canary_location").alias("location"))
    sites = sets.join(site.select("page_id", "site_url", "base_url"), "page_id").join(W.canary_baseline(canary), "page_id", "left")
    probes = W.listed_paths(sites, written(W.path_parts(lists), "lists"), sets.count())
    probes.createOrReplaceTempView("listed_probes")
    own = ["baseline", "p_noqs", "probed", "generic", "url_lp", "has_ext", "pseg"]
    return W.classify_responses(spark.sql(FD.f7_responses_sql("listed_probes", "".join(f", pr.{c}" for c in own))))


# --- DuckDB side ----------------------------------------------------------------------
def d_words(x: str, drop_generic: bool) -> str:
    w = f"list_distinct(regexp_extract_all(lower({x}), '\\b\\w+\\b'))"
    if drop_generic:
        w = f"list_filter({w}, lambda z: NOT list_contains({_arr(W.GENERIC_WORDS)}, z))"
    return w


def d_subset_either(a: str, b: str) -> str:
    return (f"(len(list_filter({a}, lambda u: NOT list_contains({b}, u))) = 0 OR "
            f"len(list_filter({b}, lambda u: NOT list_contains({a}, u))) = 0)")


def d_norm_filename(x: str) -> str:
    s = f"lower({x})"
    s = f"(CASE WHEN ends_with({s}, '.txt') THEN left({s}, length({s}) - 4) ELSE {s} END)"
    s = (f"(CASE WHEN starts_with({s}, 'wp-') OR {s} = 'wp' THEN replace(replace({s}, 'wp-', 'wordpress-'), 'wp', "
         f"'wordpress') ELSE {s} END)")
    return f"replace(replace(replace({s}, '-', ' '), '_', ' '), ' js', '.js')"


def d_parsed() -> str:
    line = O.d_strip("line")
    p = f"CASE WHEN starts_with({line}, '/') THEN {line} ELSE '/' || {line} END"
    return f"""lines AS ({FD.f7_lines_sql()}),
kept AS (SELECT filename, line_no, {p} AS path FROM lines WHERE {line} <> '' AND NOT starts_with({line}, '#')),
parsed AS (SELECT filename, min(line_no) AS pos, path FROM kept GROUP BY filename, path)"""


def d_manifest() -> str:
    keys = O.values([(r["tech_key"],) for r in O.fixture_rules()], ["tech_key"])
    return f"""{d_parsed()},
listing AS ({FD.f7_listing_sql()}),
lf AS (SELECT name AS filename, min(listing_ord * 100000 + item_pos) AS file_ord FROM listing
       WHERE type = 'file' AND ends_with(name, '.txt') AND coalesce(download_url, '') <> '' GROUP BY name),
fw AS (SELECT *, {d_norm_filename('filename')} AS normalized, {d_words(d_norm_filename('filename'), True)} AS fw FROM lf),
tk AS (SELECT tech_key, {d_words('tech_key', True)} AS tw FROM {keys} k),
tm AS (SELECT filename, list_sort(list(tech_key)) AS tech_match FROM fw JOIN tk
       ON len(fw) > 0 AND len(tw) > 0 AND {d_subset_either('fw', 'tw')} GROUP BY filename),
cnt AS (SELECT filename, count(*) AS n FROM parsed GROUP BY filename),
manifest AS (SELECT fw.filename, fw.file_ord, fw.normalized, coalesce(tm.tech_match, CAST([] AS VARCHAR[])) AS tech_match,
    (tm.tech_match IS NULL AND fw.filename IN ({', '.join(q(f) for f in W.ALWAYS_PROBE_FILES)})) AS always_probe,
    cnt.n AS n
  FROM fw LEFT JOIN tm ON tm.filename = fw.filename LEFT JOIN cnt ON cnt.filename = fw.filename),
man AS (SELECT filename, file_ord, normalized, tech_match, always_probe,
    CASE WHEN len(tech_match) > 0 OR always_probe THEN coalesce(n, 0) ELSE 0 END AS path_count FROM manifest)"""


def d_detected() -> str:
    return f"""sc AS ({o_score('m')}),
{o_implied('sc')},
det AS (SELECT DISTINCT page_id, name FROM merged)"""


def d_ranked() -> str:
    crit = _arr(W.CRITICAL_PATHS)
    return f"""{d_detected()},
dn AS (SELECT DISTINCT page_id, lower(name) AS det, {d_words('lower(name)', False)} AS dw FROM det),
kw AS (SELECT filename, unnest(tech_match) AS kw FROM man),
kww AS (SELECT filename, kw, {d_words('kw', False)} AS kw_w FROM kw),
sel AS (
  SELECT DISTINCT dn.page_id, kww.filename FROM dn JOIN kww
    ON len(kww.kw_w) > 0 AND (len(dn.dw) = 0 OR {d_subset_either('kww.kw_w', 'dn.dw')})
  UNION
  SELECT DISTINCT p.page_id, man.filename FROM pages p JOIN man ON man.always_probe),
wcand AS (SELECT sel.page_id, sel.filename, p.path, p.pos, man.file_ord, man.path_count, man.always_probe
         FROM sel JOIN man ON man.filename = sel.filename JOIN parsed p ON p.filename = sel.filename),
tiered AS (SELECT *, CASE WHEN always_probe AND (filename IN ({', '.join(q(f) for f in W.CRITICAL_FILES)})
                             OR list_contains({crit}, lower(regexp_replace(path, '/+$', '')))) THEN 0
                          WHEN NOT always_probe THEN 1 ELSE 2 END AS tier FROM wcand),
keyed AS (SELECT *, [tier, CASE WHEN tier = 1 THEN path_count ELSE 0 END, file_ord, pos] AS k FROM tiered),
firsts AS (SELECT page_id, path, arg_min(filename, k) AS filename, min(k) AS k FROM keyed GROUP BY page_id, path),
ranked AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rank, filename, path FROM firsts
           QUALIFY rank <= {W.MAX_PROBES})"""


def d_exposed() -> str:
    resp = FD.f7_responses_sql("ranked")
    lab = " ".join(f"WHEN {c} THEN {q(l)}" for c, l, _ in W.STATUS_MAP)
    conf = " ".join(f"WHEN {c} THEN {v}" for c, _, v in W.STATUS_MAP)
    ok = ", ".join(str(c) for c, _, _ in W.STATUS_MAP)
    generic = " OR ".join(f"ends_with(filename, {q(g)})" for g in W.GENERIC_WORDLISTS)
    structured = " OR ".join(f"starts_with(ct, {q(t)})" for t in W.STRUCTURED_TYPES)
    nav = " OR ".join(f"ends_with(raw_lp, {q(s)})" for s in W.NAV_SUFFIXES)
    res = O.d_resolve("url", "coalesce(location, '')")
    lp_of = lambda u: f"lower(regexp_replace({O.d_url(u, 3)}, '/+$', ''))"
    canary_lp = lp_of(O.d_resolve("base_url || '/_canary'", "canary_location"))
    last_seg = f"list_extract(string_split({O.d_url('url', 3)}, '/'), -1)"
    has_ext = (f"(CASE WHEN contains({O.d_url('url', 3)}, '/') THEN contains({last_seg}, '.') "
               f"ELSE contains({O.d_url('url', 3)}, '.') END)")
    pseg = "string_split(regexp_replace(regexp_replace(probed, '^/+', ''), '/+$', ''), '/')"
    lseg = "string_split(regexp_replace(regexp_replace(lp, '^/+', ''), '/+$', ''), '/')"
    return f"""resp AS ({resp}),
site AS ({FD.f7_site_sql()}),
base AS (SELECT page_id, CASE WHEN canary_status IN (301, 302) AND coalesce(canary_location, '') <> ''
           THEN CASE WHEN {canary_lp} = '' THEN '/' ELSE {canary_lp} END END AS baseline FROM site),
r0 AS (SELECT resp.*, base.baseline, base_url || path AS url FROM resp LEFT JOIN base ON base.page_id = resp.page_id
       WHERE status IN ({ok})),
r1 AS (SELECT *, (status IN (301, 302) AND coalesce(location, '') <> ''
          AND ({O.d_netloc(res)} = {O.d_netloc('url')} OR {O.d_netloc(res)} = '')
          AND {lp_of(res)} = {lp_of('url')}) AS hop FROM r0),
r2 AS (SELECT page_id, rank, filename, path, base_url, url, baseline,
          CASE WHEN hop THEN next_status ELSE status END AS status,
          CASE WHEN hop THEN next_content_type ELSE content_type END AS content_type,
          CASE WHEN hop THEN next_body ELSE body END AS body,
          CASE WHEN hop THEN next_location ELSE location END AS location FROM r1),
r3 AS (SELECT *, lower({O.d_strip("coalesce(content_type, '')")}) AS ct, coalesce(body, '') AS b, ({generic}) AS generic
       FROM r2 WHERE status IN ({ok})),
r4 AS (SELECT * FROM r3 WHERE status <> 200 OR (CASE
          WHEN generic THEN ({structured})
          WHEN starts_with(ct, 'text/html') OR (ct = '' AND contains(lower(left(b, 200)), 'html'))
            THEN coalesce(json_valid(b), FALSE) OR ({has_ext} AND length(b) <= {W.SOFT404_MAX_BODY})
          ELSE TRUE END)),
r5 AS (SELECT *, (status IN (301, 302) AND coalesce(location, '') <> '') AS isredir,
          CASE WHEN {lp_of(res)} = '' THEN '/' ELSE {lp_of(res)} END AS lp,
          lower(regexp_replace(path, '/+$', '')) AS probed,
          lower(regexp_replace({O.d_url("coalesce(location, '')", 3)}, '/+$', '')) AS raw_lp,
          {O.d_host_of(O.d_netloc("coalesce(location, '')"))} AS loc_host FROM r4),
r6 AS (SELECT *, {pseg} AS pseg, {lseg} AS lseg FROM r5),
r7 AS (SELECT *, ((baseline IS NOT NULL AND lp = baseline) OR (generic AND probed <> '' AND CASE
          WHEN len(pseg) <= 1 THEN lp <> probed AND NOT starts_with(lp, probed || '/')
          ELSE list_slice(pseg, 1, len(pseg) - 1) <> list_slice(lseg, 1, len(pseg) - 1) END)) AS canonical,
          ({nav}) AS nav,
          (loc_host <> '' AND {O.d_apex('loc_host', 'last2')} <> {O.d_apex(O.d_host_of(O.d_netloc('base_url')), 'last2')}) AS cross_d
       FROM r6),
exposed AS (SELECT page_id, url, status AS status_code, CASE status {lab} END AS status_label,
    nullif(content_type, '') AS content_type, CAST(CASE status {conf} END AS DOUBLE) AS confidence,
    filename AS source_wordlist,
    CASE WHEN (contains(ct, 'application/json') OR (status = 200 AND starts_with(ct, 'text/html')))
              AND json_valid(b) AND json_type(b) = 'OBJECT' THEN array_to_string(json_keys(b), ',') END AS top_level_keys,
    CASE WHEN isredir THEN location END AS redirect_location, path, rank
  FROM r7 WHERE NOT (isredir AND (canonical OR nav OR cross_d)))"""


def _with_all() -> str:
    return f"WITH RECURSIVE {o_all_raw()[5:]},\n{d_manifest()},\n{d_ranked()}"


# ---------------------------------------------------------------------------
@query("wordlist_parse")
def q_wordlist_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


@oracle("wordlist_parse")
def o_wordlist_parse() -> str:
    return f"WITH {d_parsed()}\nSELECT filename, pos, path FROM parsed"


@query("wordlist_manifest")
def q_wordlist_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("filename", "file_ord", "normalized",
                                          F.array_join("tech_match", ",").alias("tech_match"),
                                          "always_probe", "path_count")


@oracle("wordlist_manifest")
def o_wordlist_manifest() -> str:
    return f"""WITH {d_manifest()}
SELECT filename, file_ord, normalized, array_to_string(tech_match, ',') AS tech_match, always_probe, path_count FROM man"""


@query("path_priority")
def q_path_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@oracle("path_priority")
def o_path_priority() -> str:
    return f"{_with_all()}\nSELECT page_id, rank, filename, path FROM ranked"


@query("exposed_paths")
def q_exposed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exposed(spark, sf_dir).withColumn("top_level_keys", F.array_join("top_level_keys", ","))


@oracle("exposed_paths")
def o_exposed_paths() -> str:
    return f"""{_with_all()},
{d_exposed()}
SELECT * FROM exposed"""


def _wordlist_stage(spark, sf_dir) -> DataFrame:
    ex = _exposed(spark, sf_dir).withColumn("seq", F.col("rank"))
    return EP.wordlist_endpoints(ex)


@query("endpoints_wordlist")
def q_endpoints_wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wordlist_stage(spark, sf_dir).drop("stage", "seq")


def d_wordlist_endpoints() -> str:
    lab = "coalesce(status_label, 'exposed')"
    return f"""SELECT page_id, {O.d_normalize_path('url')} AS url, 'GET' AS method, content_type,
  'SecLists/' || coalesce(source_wordlist, 'unknown.txt') ||
    CASE WHEN {lab} IN ('auth-required', 'forbidden', 'redirect') THEN ' (' || {lab} || ')' ELSE '' END AS pattern_matched,
  coalesce(confidence, 0.8) AS confidence, 4 AS stage, CAST(rank AS BIGINT) AS seq
FROM exposed WHERE coalesce(url, '') <> ''"""


@oracle("endpoints_wordlist")
def o_endpoints_wordlist() -> str:
    return f"""{_with_all()},
{d_exposed()}
SELECT page_id, url, method, content_type, pattern_matched, confidence FROM ({d_wordlist_endpoints()})"""


@query("endpoints_all")
def q_endpoints_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 with all five stages: spec, runtime, probe, static, wordlist."""
    return EP.merge_endpoints(*merged_stages(spark, sf_dir), _wordlist_stage(spark, sf_dir)).drop("seq")


@oracle("endpoints_all")
def o_endpoints_all() -> str:
    return f"""{_with_all()},
{d_exposed()},
{d_spec_paths()}, {d_static_routes()}, {d_merged(f'UNION ALL SELECT * FROM ({d_wordlist_endpoints()})')}
SELECT {MERGED_COLS} FROM mg"""
