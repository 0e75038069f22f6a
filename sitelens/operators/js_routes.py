"""Static JS analysis J1-J6 and source maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import urls as U
from sitelens.functions.staging import computed
from sitelens.functions.text import strip

# CDN host fragments whose scripts are never analysed.
CDN_HOSTS = ["googleapis.com", "cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com"]
# The six route patterns (one capture group each), in order.
ROUTE_PATTERNS = [
    r"""["`](/api[^\s"'`\>]{2,80})["`]""",
    r"""["`](/v\d+/[^\s"'`\>]{2,80})["`]""",
    r"""fetch\(["`]([^"'`]{5,100})["`]""",
    r"""axios\.[a-z]+\(["`]([^"'`]{5,100})""",
    r"""["`](https?://[^"'` ]{5,100}/api[^"'` ]{2,60})["`]""",
    r"""(?:url|path|endpoint|route)\s*[:=]\s*["`](/[a-zA-Z][^\s"'`\>]{2,80})["`]""",
]
# Fixed value: trailing source-map comment (must end the file).
SOURCEMAP_RX = r"(?://#|//@)\s*sourceMappingURL=(\S+)\s*$"


def select_scripts(script_srcs: DataFrame, pages: DataFrame) -> DataFrame:
    """Script srcs resolved against the page URL, CDN hosts dropped, all of them ranked in document order
    (a caller with a quota filters by rank)."""
    s = script_srcs.join(pages.select("page_id", "url"), "page_id")
    src = strip("src")
    resolved = F.when(U.is_absolute_http(src), src).otherwise(U.resolve_url(F.col("url"), src))
    s = s.select("page_id", "pos", resolved.alias("js_url"))
    netloc = U.url_netloc("js_url")
    s = s.filter(~F.exists(F.array(*[F.lit(c) for c in CDN_HOSTS]), lambda c: F.contains(netloc, c)))
    w = Window.partitionBy("page_id").orderBy("pos")
    return s.withColumn("rank", F.row_number().over(w))


def extract_routes(text: F.Column) -> F.Column:
    """Every hit of every route pattern (group 1), in pattern order."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in ROUTE_PATTERNS]))


def digest(body) -> F.Column:
    return F.sha2(body, 256)


def routes_by_digest(texts: DataFrame, text: str) -> DataFrame:
    """(digest, route): the routes of each distinct text, found once however many rows hold it.

    Equal texts meet map-side first, so a text on every page reaches the analysis from each task once.
    """
    distinct = texts.filter(F.col(text).isNotNull()).groupBy(digest(text).alias("digest")).agg(F.any_value(text).alias("text"))
    return distinct.select("digest", F.explode(F.array_distinct(extract_routes(F.col("text")))).alias("route"))


def bundle_routes(scripts: DataFrame) -> DataFrame:
    """J2 over bundle bodies: (page_id, js_url, route) distinct.  Bodies are analysed once a digest and joined back
    (AQE splits the rows of a hot body)."""
    held = scripts.select("page_id", "js_url", digest("body").alias("digest")).distinct()
    return held.join(routes_by_digest(scripts, "body"), "digest").select("page_id", "js_url", "route").distinct()


def sourcemap_url(scripts: DataFrame) -> F.Column:
    """X-sourcemap header, else sourcemap header, else the trailing comment."""
    comment = F.nullif(F.regexp_extract("body", SOURCEMAP_RX, 1), F.lit(""))
    return F.coalesce(F.nullif("x_sourcemap", F.lit("")), F.nullif("sourcemap", F.lit("")), strip(comment))


def map_routes(scripts: DataFrame, maps: DataFrame) -> DataFrame:
    """Routes from ``sourcesContent`` of each script's source map (inline base64 or fetched by URL).

    Null entries and unparsable maps are skipped.
    """
    s = computed(scripts.select("page_id", "js_url", "x_sourcemap", "sourcemap", "body"),
                 map_ref=sourcemap_url(scripts)).select("page_id", "js_url", "map_ref") \
        .filter(F.col("map_ref").isNotNull())
    inline = s.filter(F.col("map_ref").startswith("data:") & F.contains("map_ref", F.lit("base64,"))).select(
        "page_id", "js_url",
        F.try_to_binary(F.split_part("map_ref", F.lit("base64,"), F.lit(2)), F.lit("base64")).alias("b"))
    inline = inline.select("page_id", "js_url", F.expr("try_cast(b AS STRING)").alias("map_body"))
    ext = computed(s.filter(~F.col("map_ref").startswith("data:")),
                   map_url=U.resolve_url(F.col("js_url"), F.col("map_ref"))).select("page_id", "js_url", "map_url")
    ext = ext.join(maps.select(F.col("url").alias("map_url"), F.col("body").alias("map_body")), "map_url")
    bodies = inline.unionByName(ext.select("page_id", "js_url", "map_body")).withColumn("map", digest("map_body"))
    src = F.from_json("map_body", T.StructType([T.StructField("sourcesContent", T.ArrayType(T.StringType()))]))
    # each distinct map is parsed once, each distinct source of all maps analysed once
    maps_once = bodies.groupBy("map").agg(F.any_value("map_body").alias("map_body"))
    code = maps_once.select("map", F.explode(F.coalesce(src["sourcesContent"], F.array())).alias("code")).filter(F.col("code").isNotNull())
    of_map = code.select("map", digest("code").alias("digest")).distinct().join(routes_by_digest(code, "code"), "digest").select("map", "route").distinct()
    return bodies.select("page_id", "js_url", "map").distinct().join(of_map, "map").select("page_id", "js_url", "route").distinct()


def normalize_routes(routes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, route) sorted-distinct per page.

    absolute http(s): kept only if first-party to the page host, reduced to path(+?query);
    root-relative kept as is; protocol-relative, data:, bare words dropped.
    """
    r = routes.join(pages.select("page_id", "url"), "page_id").select("page_id", "url", strip("route").alias("ep"))
    r = computed(r, target=U.url_netloc("url"), ep_net=U.url_netloc("ep"), q=U.url_query("ep"), p=U.url_path("ep"))
    r = computed(r, fp=U.first_party(F.col("ep_net"), F.col("target")))
    path = F.concat(F.col("p"), F.when(F.col("q") != "", F.concat(F.lit("?"), F.col("q"))).otherwise(F.lit("")))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    absolute = U.is_absolute_http("ep")
    out = (F.when(absolute & ((F.col("target") == "") | F.col("fp")), path)
           .when(~absolute & F.col("ep").startswith("/") & ~F.col("ep").startswith("//"), F.col("ep")))
    return r.select("page_id", out.alias("route")).filter(F.col("route").isNotNull()).distinct()
