"""Network log (N1-N5): request/response pairing, runtime filter, probe filter, OpenAPI spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import urls as U
from sitelens.functions.staging import computed
from sitelens.functions.text import strip

# The 17 well-known probe paths in probe order (N4 picks the first spec by this order).
PROBE_PATHS = [
    "/robots.txt", "/sitemap.xml", "/api-docs", "/openapi.json", "/swagger.json", "/graphql",
    "/.well-known/security.txt", "/api/swagger.json", "/v2/api-docs", "/v3/api-docs",
    "/api/v1/swagger.yaml", "/api/v2/swagger.yaml", "/__docs__/openapi.json", "/_swagger-ui/",
    "/api-docs/swagger.json", "/swagger/v1/swagger.json", "/openapi/v3/openapi.json",
]
# HTTP verbs kept from an OpenAPI path item.
SPEC_VERBS = ["get", "post", "put", "delete", "options", "head", "patch", "trace"]

_MAP = T.MapType(T.StringType(), T.StringType())


def pair_requests(requests: DataFrame, responses: DataFrame, keys=("page_id", "seq")) -> DataFrame:
    """Every request with its response; unanswered requests keep NULL status."""
    return requests.join(responses, list(keys), "left")


def runtime_requests(requests: DataFrame) -> DataFrame:
    """xhr/fetch to a first-party (or host-less) URL; probes always pass.

    requests need ``site_url`` (the scanned page) and ``url``, ``resource_type``.
    """
    r = computed(requests, _net=U.url_netloc("url"), _target=U.url_netloc("site_url"))
    r = computed(r, _fp=U.first_party(F.col("_net"), F.col("_target")))
    keep = (F.col("resource_type") == "probe") | (
        F.col("resource_type").isin("xhr", "fetch") & ((F.col("_net") == "") | F.col("_fp")))
    return r.filter(keep).drop("_net", "_target", "_fp")


def useful_probes(probes: DataFrame) -> DataFrame:
    """Drop status >= 400; drop 200 text/html unless the body parses as JSON."""
    ct = F.lower(strip(F.coalesce("content_type", F.lit(""))))
    html200 = (F.col("status") == 200) & ct.startswith("text/html")
    return probes.filter((F.col("status") < 400) &
                         (~html200 | F.try_parse_json(F.coalesce("body", F.lit(""))).isNotNull()))


def spec_documents(probes: DataFrame) -> DataFrame:
    """Per page, the first kept probe (in probe-path order) whose body is a JSON object with object 'paths'."""
    doc = F.from_json("body", _MAP)
    paths = F.from_json(doc["paths"], _MAP)
    cand = probes.withColumn("paths", paths).filter(F.col("paths").isNotNull())
    return cand.groupBy("page_id").agg(F.min_by(F.struct("url", "body", "paths"), "path_rank").alias("s")) \
        .select("page_id", F.col("s.url").alias("spec_url"), F.col("s.body").alias("body"),
                F.col("s.paths").alias("paths"),
                F.get_json_object("s.body", "$.info.title").alias("title"),
                F.get_json_object("s.body", "$.info.version").alias("version"))


def spec_paths(specs: DataFrame) -> DataFrame:
    """(page_id, pos, spec_path, methods) -- upper-cased verbs of object items, [GET] otherwise."""
    e = specs.select("page_id", "title", "version", F.posexplode("paths").alias("pos", "spec_path", "item"))
    item = F.from_json(F.col("item"), _MAP)
    verbs = F.transform(F.filter(F.map_keys(item), lambda k: F.lower(k).isin(SPEC_VERBS)), F.upper)
    is_obj = strip(F.coalesce("item", F.lit(""))).startswith("{") & item.isNotNull()
    return e.select("page_id", "pos", "spec_path",
                    F.when(is_obj, verbs).otherwise(F.array(F.lit("GET"))).alias("methods"), "title", "version")
