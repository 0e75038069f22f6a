"""Reports: confidence bands (S17), technology adoption (G1), scan summary (S16),
nested per-site report (S14) and its JSON sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import urls as U

BAND_GREEN = 0.85
BAND_YELLOW = 0.70
BLOCKS = 5


def confidence_band(conf) -> Column:
    """struct(band, blocks, pct, display) -- int() truncation as in the text report."""
    c = F.col(conf) if isinstance(conf, str) else conf
    solid = (c * BLOCKS).cast("int")
    pct = (c * 100).cast("int")
    display = F.concat(F.repeat(F.lit("█"), solid), F.repeat(F.lit("░"), F.lit(BLOCKS) - solid), F.lit(" "),
                       pct.cast("string"), F.lit("%"))
    band = F.when(c >= BAND_GREEN, "green").when(c >= BAND_YELLOW, "yellow").otherwise("plain")
    return F.struct(band.alias("band"), solid.alias("blocks"), pct.alias("pct"), display.alias("display"))


def tech_report(tech: DataFrame, pages: DataFrame) -> DataFrame:
    """G1: pages, hosts and mean confidence per (category, technology), with category and grand totals."""
    t = tech.join(pages.select("page_id", U.url_host("url").alias("host")), "page_id")
    return t.rollup("category", "name").agg(
        F.count_distinct("page_id").alias("pages"), F.count_distinct("host").alias("hosts"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count_distinct("version").alias("versions"),
        F.grouping_id().alias("level"))


def version_distribution(tech: DataFrame) -> DataFrame:
    """G1: pages per (technology, version)."""
    return tech.filter(F.col("version").isNotNull()).groupBy("name", "version") \
        .agg(F.count_distinct("page_id").alias("pages"))


def scan_summary(tech: DataFrame, endpoints: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page, technologies and endpoints found, and whether an OpenAPI spec was found."""
    t = tech.groupBy("page_id").agg(F.count(F.lit(1)).alias("technologies"))
    e = endpoints.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("endpoints"),
        F.max(F.col("pattern_matched") == "OpenAPI spec").alias("openapi_spec_found"))
    return pages.select("page_id", "url").join(t, "page_id", "left").join(e, "page_id", "left").select(
        "page_id", "url", F.coalesce("technologies", F.lit(0)).alias("technologies"),
        F.coalesce("endpoints", F.lit(0)).alias("endpoints"),
        F.coalesce("openapi_spec_found", F.lit(False)).alias("openapi_spec_found"))


def scan_report(pages: DataFrame, tech: DataFrame, endpoints: DataFrame, deps: DataFrame | None = None,
                rules_count: int | None = None, version: str = "1.0.0") -> DataFrame:
    """One nested row per page: technologies (ranked), endpoints, dependencies, meta.

    Per-page arrays are bounded by the rule count (technologies) and the page's own
    requests (endpoints, dependencies)."""
    tq = tech.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", "name", "category", "version", "confidence", "evidence"))),
        lambda x: x.dropFields("rank")).alias("technologies"))
    eq = endpoints.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("url", "method", "content_type", "pattern_matched", "confidence")))
        .alias("api_endpoints"),
        F.max(F.col("pattern_matched") == "OpenAPI spec").alias("openapi_spec_found"))
    r = pages.select("page_id", "url").join(tq, "page_id", "left").join(eq, "page_id", "left")
    if deps is not None:
        dq = deps.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            "rank", "domain", "category", "technology_name", "resource_types", "request_count", "example_urls"))),
            lambda x: x.dropFields("rank")).alias("runtime_dependencies"))
        r = r.join(dq, "page_id", "left")
    else:
        r = r.withColumn("runtime_dependencies", F.array())
    meta = F.struct(F.array(F.lit("http"), F.lit("static")).alias("phases_completed"),
                    F.lit(version).alias("fingerprints_version"), F.lit(rules_count).alias("rules_count"))
    return r.select("page_id", "url",
                    F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("scan_time"),
                    F.coalesce("technologies", F.array()).alias("technologies"),
                    F.coalesce("api_endpoints", F.array()).alias("api_endpoints"), meta.alias("meta"),
                    F.coalesce("openapi_spec_found", F.lit(False)).alias("openapi_spec_found"),
                    F.coalesce("runtime_dependencies", F.array()).alias("runtime_dependencies"))


def write_report(report: DataFrame, path: str) -> None:
    """S14 sink: JSON lines, one site per line."""
    report.write.mode("overwrite").json(path)
