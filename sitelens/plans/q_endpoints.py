"""Registered queries: network log (N1-N5), static JS routes (J1-J6, S11), API endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.operators import endpoints as EP
from sitelens.operators import evidence as E
from sitelens.operators import js_routes as J
from sitelens.operators import network as N
from sitelens.plans import oracle as O
from sitelens.plans.catalog import _setup, oracle, query
from sitelens.plans.q_evidence import F2_CTE, f2
from sitelens.sources import feeds as FD

q = O.sql_str
PROBE_SEQ_BASE = 1_000_000  # probes follow the captured requests in the runtime list (E11)


# --- feeds ------------------------------------------------------------------------
def f5(spark, sf_dir) -> DataFrame:
    _setup(spark, sf_dir)
    return spark.sql(FD.f5_requests_sql())


def f6(spark, sf_dir):
    _setup(spark, sf_dir)
    return spark.sql(FD.f6_scripts_sql()), spark.sql(FD.f6_maps_sql())


def f7(spark, sf_dir) -> DataFrame:
    _setup(spark, sf_dir)
    return spark.sql(FD.f7_probes_sql())


def _pages(spark, sf_dir) -> DataFrame:
    _setup(spark, sf_dir)
    return spark.table("pages").select("page_id", "url")


F5 = f"({FD.f5_requests_sql()})"
F7 = f"({FD.f7_probes_sql()})"
F6S = f"({FD.f6_scripts_sql()})"
F6M = f"({FD.f6_maps_sql()})"


def d_useful(p: str = "pr") -> str:
    ct = f"lower({O.d_strip("coalesce(content_type, '')")})"
    return (f"SELECT * FROM {p} WHERE status < 400 AND NOT (status = 200 AND starts_with({ct}, 'text/html') "
            f"AND NOT coalesce(json_valid(body), FALSE))")


def d_api_label(u: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({u}, {q('(?i)' + rx)}) THEN {q(lab)}" for rx, lab in EP.API_PATTERNS)
    return f"(CASE {whens} END)"


def d_third_party(u: str) -> str:
    host = O.d_host(u)
    ors = " OR ".join(f"{host} = {q(d)} OR ends_with({host}, {q('.' + d)})" for d in EP.THIRD_PARTY_DOMAINS)
    return f"({O.d_is_abs(u)} AND ({ors}))"


def d_boost(ct: str) -> str:
    c = f"lower(coalesce({ct}, ''))"
    return f"(CASE WHEN contains({c}, 'application/json') OR contains({c}, 'application/graphql') THEN 0.1 ELSE 0.0 END)"


# ---------------------------------------------------------------------------
# N1-N3
# ---------------------------------------------------------------------------
@query("request_pairing")
def q_request_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = f5(spark, sf_dir)
    reqs = r.select("page_id", "seq", "url", "method", "resource_type")
    resps = r.filter(F.col("status").isNotNull()).select("page_id", "seq", "status", "content_type")
    return N.pair_requests(reqs, resps)


@oracle("request_pairing")
def o_request_pairing() -> str:
    return f"""WITH r AS {F5}
SELECT q.page_id, q.seq, q.url, q.method, q.resource_type, s.status, s.content_type
FROM (SELECT page_id, seq, url, method, resource_type FROM r) q
LEFT JOIN (SELECT page_id, seq, status, content_type FROM r WHERE status IS NOT NULL) s
  ON q.page_id = s.page_id AND q.seq = s.seq"""


def _runtime_input(spark, sf_dir) -> DataFrame:
    """captured requests (N2-filtered) followed by the kept probes."""
    req = N.runtime_requests(f5(spark, sf_dir).filter(F.col("resource_type") != "probe"))
    probes = N.useful_probes(f7(spark, sf_dir)).select(
        "page_id", "site_url", (F.lit(PROBE_SEQ_BASE) + F.col("seq")).alias("seq"), "url", "method",
        "resource_type", "status", "content_type")
    cols = ["page_id", "site_url", "seq", "url", "method", "resource_type", "status", "content_type"]
    return req.select(*cols).unionByName(probes.select(*cols))


def d_runtime_input() -> str:
    fp = O.d_first_party(O.d_netloc("url"), O.d_netloc("site_url"))
    return f"""SELECT page_id, site_url, seq, url, method, resource_type, status, content_type FROM {F5} r
WHERE resource_type <> 'probe' AND resource_type IN ('xhr', 'fetch') AND ({O.d_netloc('url')} = '' OR {fp})
UNION ALL
SELECT page_id, site_url, {PROBE_SEQ_BASE} + seq, url, method, resource_type, status, content_type
FROM ({d_useful(F7)})"""


@query("runtime_requests")
def q_runtime_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runtime_input(spark, sf_dir).select("page_id", "seq", "url", "resource_type")


@oracle("runtime_requests")
def o_runtime_requests() -> str:
    return f"SELECT page_id, seq, url, resource_type FROM ({d_runtime_input()})"


@query("probe_filter")
def q_probe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.useful_probes(f7(spark, sf_dir)).select("page_id", "path_rank", "url", "status", "content_type")


@oracle("probe_filter")
def o_probe_filter() -> str:
    return f"SELECT page_id, path_rank, url, status, content_type FROM ({d_useful(F7)})"


# ---------------------------------------------------------------------------
# OpenAPI spec
# ---------------------------------------------------------------------------
def _spec_paths(spark, sf_dir) -> DataFrame:
    return N.spec_paths(N.spec_documents(N.useful_probes(f7(spark, sf_dir))))


@query("openapi_spec")
def q_openapi_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spec_paths(spark, sf_dir).select("page_id", "title", "version", "pos", "spec_path",
                                            F.array_join("methods", ",").alias("methods"))


def d_spec_paths() -> str:
    verbs = ", ".join(q(v) for v in N.SPEC_VERBS)
    return f"""cand AS (SELECT * FROM ({d_useful(F7)}) u
  WHERE json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.paths') = 'OBJECT'),
doc AS (SELECT page_id, arg_min(body, path_rank) AS body FROM cand GROUP BY page_id),
ks AS (SELECT page_id, body, json_keys(body, '$.paths') AS keys FROM doc),
sp AS (SELECT page_id, body, pos - 1 AS pos, keys[pos] AS spec_path FROM (
         SELECT *, generate_subscripts(keys, 1) AS pos FROM ks)),
it AS (SELECT *, json_extract(json_extract(body, '$.paths'), '$."' || spec_path || '"') AS item FROM sp),
spec AS (SELECT page_id, pos, spec_path,
  json_extract_string(body, '$.info.title') AS title, json_extract_string(body, '$.info.version') AS version,
  CASE WHEN json_type(item) = 'OBJECT' THEN
    list_transform(list_filter(json_keys(item), lambda k: lower(k) IN ({verbs})), lambda k: upper(k))
  ELSE ['GET'] END AS methods FROM it)"""


@oracle("openapi_spec")
def o_openapi_spec() -> str:
    return f"""WITH {d_spec_paths()}
SELECT page_id, title, version, pos, spec_path, array_to_string(methods, ',') AS methods FROM spec"""


@query("endpoints_spec")
def q_endpoints_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.spec_endpoints(_spec_paths(spark, sf_dir)).drop("stage")


def d_spec_endpoints() -> str:
    return f"""SELECT page_id, {O.d_normalize_path('spec_path')} AS url, coalesce(methods[1], 'GET') AS method,
  CAST(NULL AS VARCHAR) AS content_type, 'OpenAPI spec' AS pattern_matched, CAST(1.0 AS DOUBLE) AS confidence,
  0 AS stage, CAST(pos AS BIGINT) AS seq FROM spec"""


@oracle("endpoints_spec")
def o_endpoints_spec() -> str:
    return f"""WITH {d_spec_paths()}
SELECT page_id, url, method, content_type, pattern_matched, confidence, seq FROM ({d_spec_endpoints()})"""


# ---------------------------------------------------------------------------
# E4 runtime, E5 probes
# ---------------------------------------------------------------------------
@query("endpoints_runtime")
def q_endpoints_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.runtime_endpoints(_runtime_input(spark, sf_dir)).drop("stage")


def d_runtime_endpoints() -> str:
    return f"""SELECT page_id, {O.d_normalize_path('url')} AS url, coalesce(method, 'GET') AS method, content_type,
  {d_api_label('url')} AS pattern_matched,
  CAST(round(least(0.7 + {d_boost('content_type')}, 1.0), 2) AS DOUBLE) AS confidence, 1 AS stage, CAST(seq AS BIGINT) AS seq
FROM ({d_runtime_input()}) WHERE NOT {d_third_party('url')} AND {d_api_label('url')} IS NOT NULL"""


@oracle("endpoints_runtime")
def o_endpoints_runtime() -> str:
    return f"SELECT page_id, url, method, content_type, pattern_matched, confidence, seq FROM ({d_runtime_endpoints()})"


@query("endpoints_probe")
def q_endpoints_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.probe_endpoints(N.useful_probes(f7(spark, sf_dir))).drop("stage")


def d_probe_endpoints() -> str:
    path = O.d_normalize_path("url")
    whens = " ".join(f"WHEN ends_with({path}, {q(s)}) THEN {q(lab)}" for s, lab in EP.PROBE_LABELS)
    return f"""SELECT page_id, {path} AS url, coalesce(method, 'GET') AS method, content_type,
  CASE {whens} ELSE 'Probed API Endpoint' END AS pattern_matched,
  CAST(round(least(0.8 + {d_boost('content_type')}, 1.0), 2) AS DOUBLE) AS confidence, 2 AS stage, CAST(seq AS BIGINT) AS seq
FROM ({d_useful(F7)}) WHERE status = 200"""


@oracle("endpoints_probe")
def o_endpoints_probe() -> str:
    return f"SELECT page_id, url, method, content_type, pattern_matched, confidence, seq FROM ({d_probe_endpoints()})"


# ---------------------------------------------------------------------------
# J1-J6 / S11 and E6
# ---------------------------------------------------------------------------
@query("select_scripts")
def q_select_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = f2(spark, sf_dir)
    return J.select_scripts(E.script_srcs(pages), pages)


@oracle("select_scripts")
def o_select_scripts() -> str:
    resolved = f"CASE WHEN {O.d_is_abs(O.d_strip('src'))} THEN {O.d_strip('src')} ELSE {O.d_resolve('url', 'src')} END"
    cdn = " OR ".join(f"contains({O.d_netloc('js_url')}, {q(c)})" for c in J.CDN_HOSTS)
    from sitelens.plans.q_evidence import d_attr, d_explode, d_masked, d_tags
    return f"""{F2_CTE},
t AS ({d_explode('f2', d_tags(d_masked('html'), 'script'))}),
rr AS (SELECT page_id, pos, {d_attr('a', 'src')} AS v FROM t),
s AS (SELECT rr.page_id, rr.pos, f2.url, {O.d_strip('rr.v')} AS src FROM rr JOIN f2 ON rr.page_id = f2.page_id
      WHERE rr.v IS NOT NULL AND rr.v <> ''),
r AS (SELECT page_id, pos, {resolved} AS js_url FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM r WHERE NOT ({cdn}))
SELECT page_id, pos, js_url, rank FROM k"""


def d_routes(text: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({text}, {q(p)}, 1)" for p in J.ROUTE_PATTERNS) + ")"


@query("js_routes")
def q_js_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts, _ = f6(spark, sf_dir)
    return J.bundle_routes(scripts)


@oracle("js_routes")
def o_js_routes() -> str:
    return f"SELECT DISTINCT page_id, js_url, unnest({d_routes('body')}) AS route FROM {F6S}"


@query("sourcemap_routes")
def q_sourcemap_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts, maps = f6(spark, sf_dir)
    return J.map_routes(scripts, maps)


def d_map_routes() -> str:
    ref = f"coalesce(nullif(x_sourcemap, ''), nullif(sourcemap, ''), trim(nullif(regexp_extract(body, {q(J.SOURCEMAP_RX)}, 1), '')))"
    return f"""s AS (SELECT page_id, js_url, {ref} AS map_ref FROM {F6S}),
inl AS (SELECT page_id, js_url,
          CASE WHEN contains(map_ref, 'base64,') THEN decode(from_base64(split_part(map_ref, 'base64,', 2))) END AS map_body
        FROM s WHERE starts_with(map_ref, 'data:')),
ext AS (SELECT s.page_id, s.js_url, m.body AS map_body FROM s
        JOIN {F6M} m ON m.url = {O.d_resolve('s.js_url', 's.map_ref')}
        WHERE s.map_ref IS NOT NULL AND NOT starts_with(s.map_ref, 'data:')),
b AS (SELECT * FROM inl UNION ALL SELECT * FROM ext),
code AS (SELECT page_id, js_url, unnest(CASE WHEN json_valid(map_body) AND json_type(map_body, '$.sourcesContent') = 'ARRAY'
           THEN list_transform(CAST(json_extract(map_body, '$.sourcesContent') AS JSON[]),
                               lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END)
           ELSE [] END) AS code FROM b),
mr AS (SELECT DISTINCT page_id, js_url, unnest({d_routes('code')}) AS route FROM code WHERE code IS NOT NULL)"""


@oracle("sourcemap_routes")
def o_sourcemap_routes() -> str:
    return f"WITH {d_map_routes()}\nSELECT page_id, js_url, route FROM mr"


def _static_routes(spark, sf_dir) -> DataFrame:
    scripts, maps = f6(spark, sf_dir)
    routes = J.bundle_routes(scripts).unionByName(J.map_routes(scripts, maps))
    return J.normalize_routes(routes.select("page_id", "route"), _pages(spark, sf_dir))


@query("js_routes_first_party")
def q_js_routes_first_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _static_routes(spark, sf_dir)


def d_static_routes() -> str:
    q_ = f"{O.d_url('ep', 4)}"
    path = f"({O.d_url('ep', 3)} || CASE WHEN {q_} <> '' THEN '?' || {q_} ELSE '' END)"
    path = f"(CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END)"
    target = O.d_netloc("url")
    fp = O.d_first_party(O.d_netloc("ep"), target)
    return f"""{d_map_routes()},
br AS (SELECT DISTINCT page_id, unnest({d_routes('body')}) AS route FROM {F6S}),
ar AS (SELECT page_id, route FROM br UNION SELECT page_id, route FROM mr),
epr AS (SELECT ar.page_id, p.url, {O.d_strip('ar.route')} AS ep FROM ar JOIN pages p ON p.page_id = ar.page_id),
sr AS (SELECT DISTINCT page_id, CASE
    WHEN {O.d_is_abs('ep')} AND ({target} = '' OR {fp}) THEN {path}
    WHEN NOT {O.d_is_abs('ep')} AND starts_with(ep, '/') AND NOT starts_with(ep, '//') THEN ep END AS route FROM epr)"""


@oracle("js_routes_first_party")
def o_js_routes_first_party() -> str:
    return f"WITH {d_static_routes()}\nSELECT page_id, route FROM sr WHERE route IS NOT NULL"


def _static_endpoints(spark, sf_dir) -> DataFrame:
    routes = _static_routes(spark, sf_dir)
    # the collector hands over a sorted list: its order is the tie order within the stage
    routes = routes.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy("route")))
    return EP.static_endpoints(routes)


@query("endpoints_static")
def q_endpoints_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _static_endpoints(spark, sf_dir).drop("stage")


def d_static_endpoints() -> str:
    return f"""SELECT page_id, {O.d_normalize_path('route')} AS url, 'GET' AS method, CAST(NULL AS VARCHAR) AS content_type,
  {d_api_label('route')} AS pattern_matched, CAST(0.65 AS DOUBLE) AS confidence, 3 AS stage,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY route) AS BIGINT) AS seq
FROM sr WHERE route IS NOT NULL QUALIFY {d_api_label('route')} IS NOT NULL"""


@oracle("endpoints_static")
def o_endpoints_static() -> str:
    return f"""WITH {d_static_routes()}
SELECT page_id, url, method, content_type, pattern_matched, confidence, seq FROM ({d_static_endpoints()})"""


# ---------------------------------------------------------------------------
# Merged endpoint list (spec, runtime, probe, static; wordlist stage in q_wordlists)
# ---------------------------------------------------------------------------
def merged_stages(spark, sf_dir) -> list[DataFrame]:
    return [EP.spec_endpoints(_spec_paths(spark, sf_dir)), EP.runtime_endpoints(_runtime_input(spark, sf_dir)),
            EP.probe_endpoints(N.useful_probes(f7(spark, sf_dir))), _static_endpoints(spark, sf_dir)]


MERGED_COLS = "page_id, url, method, content_type, pattern_matched, confidence, stage"


@query("endpoints_merged")
def q_endpoints_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EP.merge_endpoints(*merged_stages(spark, sf_dir)).drop("seq")


def d_merged(extra: str = "") -> str:
    return f"""u AS (
  SELECT * FROM ({d_spec_endpoints()})
  UNION ALL SELECT * FROM ({d_runtime_endpoints()})
  UNION ALL SELECT * FROM ({d_probe_endpoints()})
  UNION ALL SELECT * FROM ({d_static_endpoints()}) {extra}),
mg AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id, url
        ORDER BY confidence DESC, stage, CASE WHEN stage = 0 THEN -seq ELSE seq END) = 1)"""


@oracle("endpoints_merged")
def o_endpoints_merged() -> str:
    return f"""WITH {d_spec_paths()}, {d_static_routes()}, {d_merged()}
SELECT {MERGED_COLS} FROM mg"""
