"""Rule database build (S4, R1-R7, S15): upstream technology files -> rules table,
merged with a custom rules table.

Upstream files are JSON objects ``{technology name: rule}`` plus a categories
object ``{id: {name, priority}}``.  Everything is a DataFrame transform: one row
per technology, pattern lists handled with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.text import strip

DEFAULT_RULE_CONFIDENCE = 0.75  # R4
DEFAULT_CATEGORY_PRIORITY = 999  # R5
# Legacy category slugs translated on preserved custom rules.
LEGACY_CATEGORY_MAP = {
    "web-server": "web-servers",
    "framework": "web-frameworks",
    "cdn": "cdns",
    "database": "databases",
    "js-library": "javascript-libraries",
    "programming-language": "programming-languages",
}
_STR_MAP = T.MapType(T.StringType(), T.StringType())
_STR_ARR = T.ArrayType(T.StringType())


# ---------------------------------------------------------------------------
# Read the landed upstream files
# ---------------------------------------------------------------------------
def read_upstream(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, pos, name, data JSON) -- one row per technology, file and document order kept."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.select("file", F.posexplode(F.from_json("value", _STR_MAP)).alias("pos", "name", "data"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(cat_id, name, priority) from a categories object."""
    raw = spark.read.text(path, wholetext=True)
    e = raw.select(F.explode(F.from_json("value", _STR_MAP)).alias("cat_id", "info"))
    return e.select("cat_id", F.get_json_object("info", "$.name").alias("name"),
                    F.coalesce(F.get_json_object("info", "$.priority").cast("int"),
                               F.lit(DEFAULT_CATEGORY_PRIORITY)).alias("priority"))


# ---------------------------------------------------------------------------
# Pattern and implies parsing
# ---------------------------------------------------------------------------
def _parts(p: Column) -> Column:
    return F.split(p, r"\\;")


def pattern_regex(p: Column) -> Column:
    """The regex before the first '\\;' (version / confidence suffixes dropped)."""
    return F.coalesce(F.element_at(_parts(F.coalesce(p, F.lit(""))), 1), F.lit(""))


def pattern_confidence(p: Column) -> Column:
    """R1: 'confidence:N' suffix as N/100 (the last parsable one), else NULL."""
    rest = F.slice(_parts(F.coalesce(p, F.lit(""))), 2, 1 << 20)
    vals = F.transform(F.filter(rest, lambda x: x.startswith("confidence:")),
                       lambda x: F.split_part(x, F.lit(":"), F.lit(2)).try_cast("double") / 100.0)
    return F.try_element_at(F.filter(vals, lambda v: v.isNotNull()), F.lit(-1))


def as_list(v: Column) -> Column:
    """A JSON value that is a string or a list of strings, as a list (non-strings dropped)."""
    arr = F.from_json(v, _STR_ARR)
    is_arr = strip(F.coalesce(v, F.lit(""))).startswith("[") & arr.isNotNull()
    return F.when(v.isNull(), F.array().cast(_STR_ARR)).when(is_arr, F.filter(arr, lambda x: x.isNotNull())) \
        .otherwise(F.array(v))


def parse_implies(v: Column) -> Column:
    """R2: string or list; each item cut at '\\;'; empty items dropped."""
    return F.filter(F.transform(as_list(v), pattern_regex), lambda x: x != "")


def slugify(name: Column) -> Column:
    """Lower, runs of non [a-z0-9] -> '-', trimmed of '-'."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


# ---------------------------------------------------------------------------
# Flatten one upstream technology
# ---------------------------------------------------------------------------
def _first_pattern(values: Column, empty_is_dot: bool) -> Column:
    """First list entry whose regex is non-empty (or the first entry, as '.', when empty allowed)."""
    parsed = F.transform(values, lambda x: F.struct(pattern_regex(x).alias("rx"), pattern_confidence(x).alias("conf")))
    if empty_is_dot:
        return F.transform(F.slice(parsed, 1, 1), lambda p: F.struct(
            F.when(p["rx"] == "", F.lit(".")).otherwise(p["rx"]).alias("rx"), p["conf"].alias("conf")))
    return F.slice(F.filter(parsed, lambda p: p["rx"] != ""), 1, 1)


def _keyed(data: Column, field: str, empty_is_dot: bool = False) -> Column:
    """map source (headers, cookies, meta, js): key -> first usable pattern (array of one struct)."""
    m = F.coalesce(F.from_json(F.get_json_object(data, f"$.{field}"), _STR_MAP), F.create_map().cast(_STR_MAP))
    return F.transform_values(m, lambda k, v: _first_pattern(as_list(v), empty_is_dot))


def compile_upstream(techs: DataFrame, categories: DataFrame, default_website: str | None = None) -> DataFrame:
    """Upstream rows -> rules(key, ord, name, category, website, confidence, headers, cookies,
    meta, js_globals, scripts, html, implies, dom)."""
    d = F.col("data")
    t = techs.select("file", "pos", "name", "data",
                     _keyed(d, "headers").alias("h"), _keyed(d, "cookies").alias("c"), _keyed(d, "meta").alias("m"),
                     _keyed(d, "js", True).alias("j"))
    html = F.transform(as_list(F.get_json_object(d, "$.html")),
                       lambda x: F.struct(pattern_regex(x).alias("rx"), pattern_confidence(x).alias("conf")))
    script_src = F.coalesce(*[F.when(F.size(as_list(F.get_json_object(d, f"$.{f}"))) > 0,
                                     as_list(F.get_json_object(d, f"$.{f}"))) for f in ("scriptSrc", "scripts", "script")],
                            F.array().cast(_STR_ARR))
    scripts = F.transform(script_src, lambda x: F.struct(pattern_regex(x).alias("rx"), pattern_confidence(x).alias("conf")))
    t = t.withColumn("html_p", F.filter(html, lambda p: p["rx"] != "")) \
        .withColumn("script_p", F.filter(scripts, lambda p: p["rx"] != ""))

    def flat_map(col: str) -> Column:
        m = F.map_filter(F.col(col), lambda k, v: F.size(v) > 0)
        return F.transform_values(m, lambda k, v: v[0]["rx"])

    def confs(col: str) -> Column:
        return F.flatten(F.transform(F.map_values(F.col(col)), lambda v: F.transform(v, lambda p: p["conf"])))

    all_conf = F.filter(F.concat(confs("h"), confs("c"), confs("m"), confs("j"),
                                 F.transform("html_p", lambda p: p["conf"]),
                                 F.transform("script_p", lambda p: p["conf"]), _dom_confidences(d)), lambda x: x.isNotNull())
    t = t.select("file", "pos", "name", "data",
                 flat_map("h").alias("headers"), flat_map("c").alias("cookies"), flat_map("m").alias("meta"),
                 flat_map("j").alias("js_globals"),
                 F.transform("html_p", lambda p: p["rx"]).alias("html"),
                 F.transform("script_p", lambda p: p["rx"]).alias("scripts"),
                 parse_implies(F.get_json_object(d, "$.implies")).alias("implies"),
                 F.coalesce(F.array_max(all_conf), F.lit(DEFAULT_RULE_CONFIDENCE)).alias("confidence"),
                 F.coalesce(F.get_json_object(d, "$.website"), F.lit(default_website)).alias("website"),
                 _dom(d).alias("dom"),
                 as_list(F.get_json_object(d, "$.cats")).alias("cats"))
    # Lowest priority among known category ids (first listed on ties), slugified; else 'other'
    cats = t.select("file", "pos", F.posexplode("cats").alias("cpos", "cat_id")) \
        .join(categories, "cat_id") \
        .groupBy("file", "pos").agg(F.min_by(slugify(F.col("name")), F.struct("priority", "cpos")).alias("category"))
    t = t.join(cats, ["file", "pos"], "left").withColumn("category", F.coalesce("category", F.lit("other")))
    return t.select(F.col("name").alias("key"), "file", "pos", "name", "category", "website", "confidence",
                    "headers", "cookies", "meta", "js_globals", "scripts", "html", "implies", "dom")


def _dom_confidences(d: Column) -> Column:
    """Confidences named in the text, attribute and property patterns of the dom part."""
    dom = F.coalesce(F.get_json_object(d, "$.dom"), F.lit(""))
    return F.transform(F.regexp_extract_all(dom, F.lit(r";confidence:(\d+)"), 1), lambda x: x.cast("double") / 100)


def _dom(d: Column) -> Column:
    """dom: string -> [s]; list -> strings; dict -> per selector {exists, text, attributes, properties}
    (first usable pattern each, empty attribute/property patterns -> '.'), kept as JSON text."""
    raw = F.get_json_object(d, "$.dom")
    t = strip(F.coalesce(raw, F.lit("")))
    lst = F.to_json(as_list(raw))
    obj = F.from_json(raw, _STR_MAP)

    def norm(sub: Column) -> Column:
        first_text = F.try_element_at(F.filter(F.transform(as_list(F.get_json_object(sub, "$.text")), pattern_regex),
                                               lambda x: x != ""), F.lit(1))

        def sub_map(field: str) -> Column:
            m = F.coalesce(F.from_json(F.get_json_object(sub, f"$.{field}"), _STR_MAP), F.create_map().cast(_STR_MAP))
            mm = F.transform_values(m, lambda k, v: F.coalesce(F.nullif(pattern_regex(
                F.try_element_at(as_list(v), F.lit(1))), F.lit("")), F.lit(".")))
            return F.when(F.size(mm) > 0, mm)

        is_obj = sub.startswith("{")
        has_exists = F.get_json_object(sub, "$.exists").isNotNull() | sub.rlike(r'"exists"\s*:')
        return F.struct(F.when(is_obj & has_exists, F.lit("")).alias("exists"),
                        F.when(is_obj, first_text).alias("text"),
                        F.when(is_obj, sub_map("properties")).alias("properties"),
                        F.when(is_obj, sub_map("attributes")).alias("attributes"))

    as_obj = F.to_json(F.transform_values(obj, lambda k, v: norm(strip(F.coalesce(v, F.lit(""))))))
    return F.when(raw.isNull() | (t == "") | (t == "{}") | (t == "[]"), F.lit(None)) \
        .when(t.startswith("{"), as_obj).otherwise(lst)


def category_table(categories: DataFrame) -> DataFrame:
    """Slug -> display name for every upstream category, plus 'other'."""
    c = categories.select(slugify(F.col("name")).alias("slug"), "name")
    other = categories.sparkSession.createDataFrame([("other", "Other")], "slug string, name string")
    return c.unionByName(other).dropDuplicates(["slug"])


# ---------------------------------------------------------------------------
# Merge upstream with custom rules
# ---------------------------------------------------------------------------
def _union_keep_order(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.array().cast(_STR_ARR)),
                    F.filter(F.coalesce(b, F.array().cast(_STR_ARR)),
                             lambda x: ~F.array_contains(F.coalesce(a, F.array().cast(_STR_ARR)), x)))


def merge_rules(upstream: DataFrame, custom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full outer join on the lower-cased key.

    added: upstream only (key lower-cased); preserved: custom only (legacy category mapped);
    updated: upstream with custom confidence, html/scripts unioned (upstream order first),
    headers/cookies/meta/js_globals per key custom wins, dom lists unioned / dicts merged /
    otherwise custom replaces.  Returns (rules, summary).
    """
    cols = ["key", "name", "category", "website", "confidence", "headers", "cookies", "meta", "js_globals",
            "scripts", "html", "implies", "dom"]
    u = upstream.select(*[F.col(c).alias("u_" + c) for c in cols], F.lower("key").alias("k"))
    c = custom.select(*[F.col(x).alias("c_" + x) for x in cols], F.lower("key").alias("k"))
    j = u.join(c, "k", "full_outer")
    status = F.when(F.col("u_key").isNull(), "preserved").when(F.col("c_key").isNull(), "added").otherwise("updated")
    legacy = F.create_map(*[x for kv in LEGACY_CATEGORY_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])

    def mp(name: str) -> Column:
        return F.when(F.col("c_" + name).isNull(), F.col("u_" + name)).otherwise(
            F.map_concat(F.coalesce("u_" + name, F.create_map().cast(_STR_MAP)), F.col("c_" + name)))

    udom, cdom = strip(F.coalesce("u_dom", F.lit(""))), strip(F.coalesce("c_dom", F.lit("")))
    dom_list = F.to_json(_union_keep_order(F.from_json("u_dom", _STR_ARR), F.from_json("c_dom", _STR_ARR)))
    dom_obj = F.to_json(F.map_concat(F.from_json("u_dom", _STR_MAP), F.from_json("c_dom", _STR_MAP)))
    dom = F.when(F.col("c_dom").isNull(), F.col("u_dom")) \
        .when(udom.startswith("[") & cdom.startswith("["), dom_list) \
        .when(udom.startswith("{") & cdom.startswith("{"), dom_obj).otherwise(F.col("c_dom"))
    updated = [
        F.col("k").alias("key"), F.col("u_name").alias("name"), F.col("u_category").alias("category"),
        F.col("u_website").alias("website"), F.coalesce("c_confidence", "u_confidence").alias("confidence"),
        mp("headers").alias("headers"), mp("cookies").alias("cookies"), mp("meta").alias("meta"),
        mp("js_globals").alias("js_globals"),
        F.when(F.col("c_scripts").isNull(), F.col("u_scripts")).otherwise(_union_keep_order(F.col("u_scripts"), F.col("c_scripts"))).alias("scripts"),
        F.when(F.col("c_html").isNull(), F.col("u_html")).otherwise(_union_keep_order(F.col("u_html"), F.col("c_html"))).alias("html"),
        F.col("u_implies").alias("implies"), dom.alias("dom")]
    merged = j.select(
        status.alias("status"),
        *[F.when(status == "preserved", F.col("c_" + n) if n != "category" else
                 F.coalesce(legacy[F.col("c_category")], F.col("c_category")))
          .when(status == "added", F.col("k") if n == "key" else F.col("u_" + n))
          .otherwise(e).alias(n) for n, e in zip(cols, updated)])
    summary = merged.groupBy().agg(
        F.sum(F.when(F.col("status") == "added", 1).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("status") == "updated", 1).otherwise(0)).alias("updated"),
        F.sum(F.when(F.col("status") == "preserved", 1).otherwise(0)).alias("preserved"),
        F.count(F.lit(1)).alias("total"))
    return merged, summary


def write_rules(rules: DataFrame, categories: DataFrame, path: str) -> None:
    """Rules and category table as JSON lines (the format ``load_rules`` reads)."""
    rules.drop("status").write.mode("overwrite").json(f"{path}/rules")
    categories.write.mode("overwrite").json(f"{path}/categories")
