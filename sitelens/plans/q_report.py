"""Registered queries: confidence bands (S17), technology adoption report (G1),
scan summary (S16) and the nested scan report (S14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import report as RP
from sitelens.plans.catalog import _rules, _setup, oracle, query
from sitelens.plans.q_endpoints import d_merged, d_spec_paths, d_static_routes, merged_stages
from sitelens.plans.q_evidence import o_tech_with_implied, q_tech_with_implied
from sitelens.operators import endpoints as EP


def _tech(spark, sf_dir) -> DataFrame:
    return q_tech_with_implied(spark, sf_dir)


@query("confidence_bands")
def q_confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = RP.confidence_band("confidence")
    return _tech(spark, sf_dir).select("page_id", "tech_key", "confidence", b["band"].alias("band"),
                                      b["blocks"].alias("blocks"), b["pct"].alias("pct"),
                                      b["display"].alias("display"))


@oracle("confidence_bands")
def o_confidence_bands() -> str:
    return f"""WITH tw AS ({o_tech_with_implied()})
SELECT page_id, tech_key, confidence,
  CASE WHEN confidence >= 0.85 THEN 'green' WHEN confidence >= 0.7 THEN 'yellow' ELSE 'plain' END AS band,
  CAST(trunc(confidence * 5) AS INTEGER) AS blocks, CAST(trunc(confidence * 100) AS INTEGER) AS pct,
  repeat('█', CAST(trunc(confidence * 5) AS INTEGER)) || repeat('░', 5 - CAST(trunc(confidence * 5) AS INTEGER))
    || ' ' || CAST(CAST(trunc(confidence * 100) AS INTEGER) AS VARCHAR) || '%' AS display
FROM tw"""


@query("tech_report")
def q_tech_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _setup(spark, sf_dir)
    return RP.tech_report(_tech(spark, sf_dir), spark.table("pages"))


@oracle("tech_report")
def o_tech_report() -> str:
    from sitelens.plans import oracle as O
    return f"""WITH tw AS ({o_tech_with_implied()}),
t AS (SELECT tw.*, {O.d_host('p.url')} AS host FROM tw JOIN pages p ON p.page_id = tw.page_id)
SELECT category, name, count(DISTINCT page_id) AS pages, count(DISTINCT host) AS hosts,
  round(avg(confidence), 4) AS avg_confidence, count(DISTINCT version) AS versions,
  grouping(category, name) AS level
FROM t GROUP BY ROLLUP (category, name)"""


@query("scan_summary")
def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _setup(spark, sf_dir)
    ep = EP.merge_endpoints(*merged_stages(spark, sf_dir))
    return RP.scan_summary(_tech(spark, sf_dir), ep, spark.table("pages"))


@oracle("scan_summary")
def o_scan_summary() -> str:
    tw = o_tech_with_implied()
    # tw starts with 'WITH RECURSIVE'; splice the endpoint CTEs in before its final SELECT
    head, final = tw.rsplit("\nSELECT page_id, tech_key, name, category, version, confidence, implied, evidence,", 1)
    return f"""{head},
twf AS (SELECT page_id, tech_key, name, category, version, confidence, implied, evidence,{final}),
{d_spec_paths()}, {d_static_routes()}, {d_merged()},
tcnt AS (SELECT page_id, count(*) AS n FROM twf GROUP BY page_id),
ecnt AS (SELECT page_id, count(*) AS n, bool_or(pattern_matched = 'OpenAPI spec') AS spec FROM mg GROUP BY page_id)
SELECT p.page_id, p.url, coalesce(tcnt.n, 0) AS technologies, coalesce(ecnt.n, 0) AS endpoints,
  coalesce(ecnt.spec, FALSE) AS openapi_spec_found
FROM pages p LEFT JOIN tcnt ON tcnt.page_id = p.page_id LEFT JOIN ecnt ON ecnt.page_id = p.page_id"""


@query("scan_report")
def q_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 nested report (rows-only: scan_time is the run time)."""
    _setup(spark, sf_dir)
    from sitelens.operators import domains as DM
    from sitelens.plans.q_endpoints import f5
    cr = _rules(spark)
    tech = _tech(spark, sf_dir)
    ep = EP.merge_endpoints(*merged_stages(spark, sf_dir))
    deps = DM.external_deps(f5(spark, sf_dir), cr.rules)
    rep = RP.scan_report(spark.table("pages"), tech.withColumn("evidence", F.split("evidence", r" \| ")), ep, deps,
                         rules_count=None)
    return rep.select("page_id", "url", F.to_json(F.struct(*[c for c in rep.columns if c != "page_id"])).alias("report"))


@query("tech_versions")
def q_tech_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: pages per (technology, version)."""
    return RP.version_distribution(_tech(spark, sf_dir))


@oracle("tech_versions")
def o_tech_versions() -> str:
    return f"""SELECT name, version, count(DISTINCT page_id) AS pages FROM ({o_tech_with_implied()})
WHERE version IS NOT NULL GROUP BY name, version"""
