"""Registered queries: Structured Streaming jobs (X1-X3).  Each runs the stream to
completion over files derived from the given tables and returns its sink as a
batch DataFrame; the oracle is the equivalent batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.operators import evidence as E
from sitelens.operators import score as S
from sitelens.plans import oracle as O
from sitelens.plans.catalog import _rules, _setup, oracle, query
from sitelens.plans.detect import matches_raw
from sitelens.plans.q_evidence import f2, f3, f4, f5, implied_rows, o_tech_with_implied
from sitelens.sources import feeds as FD
from sitelens.streaming import jobs as X


@query("stream_request_pairing")
def q_stream_request_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 (N1 as a stream): clicks answered by views of the same key within an hour, one row per click."""
    _setup(spark, sf_dir, ("events",))
    return X.stream_pairing(spark, FD.read_table(spark, sf_dir, "events"))


@oracle("stream_request_pairing")
def o_stream_request_pairing() -> str:
    """Each key's events in order; a recursive walk keeps the requests that wait."""
    return """WITH RECURSIVE ev AS (
  SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, user_id AS k, event_type = 'view' AS answers,
         row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), event_type = 'view', event_id) AS n
  FROM events WHERE event_type IN ('click', 'view')),
walk(k, n, waiting, req, resp_id, resp_us) AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT), CAST([] AS STRUCT(us BIGINT, id BIGINT)[]), CAST(NULL AS STRUCT(us BIGINT, id BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ev
  UNION ALL
  SELECT k, n, CASE WHEN answers THEN list_slice(still, 2, len(still)) ELSE list_append(still, {'us': us, 'id': event_id}) END,
         CASE WHEN answers THEN still[1] END, event_id, us
  FROM (SELECT e.*, list_filter(w.waiting, lambda r: r.us >= e.us - 3600000000) AS still FROM walk w JOIN ev e ON e.k = w.k AND e.n = w.n + 1)),
pairs AS (SELECT req.id AS req_id, resp_id, resp_us FROM walk WHERE req IS NOT NULL)
SELECT e.event_id AS req_id, e.k, e.us AS req_us, p.resp_id, p.resp_us FROM ev e LEFT JOIN pairs p ON p.req_id = e.event_id WHERE NOT e.answers"""


@query("stream_domain_windows")
def q_stream_domain_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 (D1 over daily tumbling windows, watermark, bounded state, append mode)."""
    return X.stream_domain_windows(spark, FD.read_table(spark, sf_dir, "events"))


@oracle("stream_domain_windows")
def o_stream_domain_windows() -> str:
    site = "'https://www.shop' || user_id || '.example.com/'"
    url = ("CASE WHEN event_type = 'signup' THEN 'https://api.shop' || user_id || '.example.com/v1/' || event_id "
           "ELSE 'https://cdn' || (user_id % 7) || '.example.io/' || event_type || '/' || event_id END")
    host, target = O.d_strip_www(O.d_host_of("domain")), O.d_strip_www(O.d_host_of(O.d_netloc("site_url")))
    return f"""WITH r AS (SELECT epoch_us(date_trunc('day', CAST(ts AS TIMESTAMP))) AS window_start_us, {site} AS site_url, {url} AS url, event_type, event_id FROM events),
d AS (SELECT *, {O.d_netloc('url')} AS domain FROM r)
SELECT site_url, domain, window_start_us, count(*) AS request_count, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS resource_types,
  array_to_string(list(url ORDER BY event_id)[1:3], chr(10)) AS example_urls, min(event_id) AS first_seq
FROM d WHERE {O.d_apex(host, 'noip')} <> {O.d_apex(target, 'noip')} GROUP BY 1, 2, 3"""


@query("stream_detect")
def q_stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, headers, cookies, globals and requests as they arrive, each page detected once its evidence is
    complete (same result as tech_with_implied)."""
    cr = _rules(spark)
    headers, status, cookies = f3(spark, sf_dir)
    sources = {"page": f2(spark, sf_dir), "headers": E.fold_headers(headers, status), "cookies": E.first_cookies(cookies),
               "js_globals": f4(spark, sf_dir), "requests": f5(spark, sf_dir)}

    def detect(rows: dict[str, DataFrame]) -> DataFrame:
        raw = matches_raw(rows["page"], cr, headers=rows["headers"], cookies=rows["cookies"], js_globals=rows["js_globals"],
                          requests=rows["requests"], sources=("header", "cookie", "meta", "script", "html", "js_global"))
        return implied_rows(S.score(raw, cr.rules), cr)

    return X.stream_detect(spark, sources, detect)


@oracle("stream_detect")
def o_stream_detect() -> str:
    return o_tech_with_implied()
