"""S1-S3, S19, R-compile: the rules table and its compiled forms.

Rules are the user's extension point: a DataFrame (or JSON-lines files) with
one technology per row.  They are a small dimension table (thousands of rows),
so they are broadcast into the page-level joins; every size-dependent choice
below is on the page side.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import regex as rx
from sitelens.functions.staging import computed
from sitelens.functions.text import strip

DATA_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data")
FIXTURE_RULES = os.path.join(DATA_DIR, "rules_fixture.jsonl")
FIXTURE_CATEGORIES = os.path.join(DATA_DIR, "categories.jsonl")

# Evidence sources in version-pick order (A3).
SOURCES = ["header", "cookie", "meta", "script", "html", "js_global", "dom"]
SRC_RANK = {s: i for i, s in enumerate(SOURCES)}

_MAP = T.MapType(T.StringType(), T.StringType())
RULE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("headers", _MAP),
    T.StructField("cookies", _MAP),
    T.StructField("meta", _MAP),
    T.StructField("js_globals", _MAP),
    T.StructField("scripts", T.ArrayType(T.StringType())),
    T.StructField("html", T.ArrayType(T.StringType())),
    T.StructField("implies", T.ArrayType(T.StringType())),
    # list or dict shaped: read raw and resolve in compile_dom_rules
    T.StructField("dom", T.StringType()),
])
CATEGORY_SCHEMA = T.StructType([T.StructField("slug", T.StringType()), T.StructField("name", T.StringType())])


def load_rules(spark: SparkSession, path: str = FIXTURE_RULES, categories_path: str = FIXTURE_CATEGORIES) -> DataFrame:
    """Rules with defaults, lower-cased key, category display name (falls back to the slug)."""
    raw = spark.read.schema(RULE_SCHEMA).json(path)
    cats = spark.read.schema(CATEGORY_SCHEMA).json(categories_path)
    empty_map = F.create_map().cast(_MAP)
    empty_arr = F.array().cast(T.ArrayType(T.StringType()))
    rules = raw.select(
        F.lower("key").alias("tech_key"),
        "ord",
        F.coalesce("name", "key").alias("name"),
        F.coalesce("category", F.lit("other")).alias("category_slug"),
        "website",
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("headers", empty_map).alias("headers"),
        F.coalesce("cookies", empty_map).alias("cookies"),
        F.coalesce("meta", empty_map).alias("meta"),
        F.coalesce("js_globals", empty_map).alias("js_globals"),
        F.coalesce("scripts", empty_arr).alias("scripts"),
        F.coalesce("html", empty_arr).alias("html"),
        F.coalesce("implies", empty_arr).alias("implies"),
        "dom",
    )
    return (rules.join(cats.withColumnRenamed("slug", "category_slug")
                                   .withColumnRenamed("name", "category_name"), "category_slug", "left")
            .withColumn("category", F.coalesce("category_name", "category_slug"))
            .drop("category_name"))


def rules_by_category(rules: DataFrame, category: str) -> DataFrame:
    """Rules whose display category equals ``category``."""
    return rules.filter(F.col("category") == category)


def js_key(col) -> F.Column:
    """M7: drop leading 'window.', '?.' -> '.', drop trailing '()', lower, trim."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"^window\.", "")
    c = F.replace(c, F.lit("?."), F.lit("."))
    c = F.regexp_replace(c, r"\(\)$", "")
    return strip(F.lower(c))


_ANALYSIS = T.StructType([
    T.StructField("n_groups", T.IntegerType()),
    T.StructField("clauses", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("valid", T.BooleanType()),
    T.StructField("rx", T.StringType()),
])


@F.pandas_udf(_ANALYSIS)
def _analyze(patterns: pd.Series) -> pd.DataFrame:
    res = [(*rx.analyze(p), rx.java_form(p)) if p is not None else (0, [], False, None) for p in patterns]
    return pd.DataFrame(res, columns=["n_groups", "clauses", "valid", "rx"])


def analyzed(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``df`` plus n_groups, clauses, rx and valid of its patterns; valid: java.util.regex compiles rx."""
    out = computed(df, a=_analyze(pattern)).select(*df.columns, "a.n_groups", "a.clauses", "a.rx")
    return computed(out, valid=rx.compiles(F.col("rx")))


def _map_patterns(rules: DataFrame, col: str, src: str) -> DataFrame:
    return rules.select("tech_key", "ord", F.posexplode(col).alias("pos", "key", "pattern")) \
        .withColumn("src", F.lit(src))


def _list_patterns(rules: DataFrame, col: str, src: str, key: str) -> DataFrame:
    return rules.select("tech_key", "ord", F.posexplode(col).alias("pos", "pattern")) \
        .withColumn("key", F.lit(key)).withColumn("src", F.lit(src))


def all_patterns(rules: DataFrame) -> DataFrame:
    """Every regex of every rule, one row each, with its analysis (before quarantine)."""
    parts = [
        _map_patterns(rules, "headers", "header"),
        _map_patterns(rules, "cookies", "cookie"),
        _map_patterns(rules, "meta", "meta"),
        _list_patterns(rules, "scripts", "script", "script_src"),
        _list_patterns(rules, "html", "html", "raw_html"),
        _map_patterns(rules, "js_globals", "js_global"),
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    rank = F.create_map(*[x for s, r in SRC_RANK.items() for x in (F.lit(s), F.lit(r))])
    df = df.withColumn("src_rank", rank[F.col("src")]) \
        .withColumn("key_norm", F.when(F.col("src") == "js_global", js_key("key"))
                    .when(F.col("src").isin("header", "cookie", "meta"), F.lower("key")))
    # js_global "." means "key exists" and is never run as a regex
    return analyzed(df).select("tech_key", "ord", "src", "src_rank", "pos", "key", "key_norm", "pattern", "n_groups", "clauses", "valid", "rx")


def compile_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-compile + M15: (rule_patterns, quarantine).  Bad patterns never reach ``rlike``."""
    pats = all_patterns(rules)
    good = pats.filter("valid").drop("valid")
    bad = pats.filter("NOT valid").select("tech_key", "src", "key", "pattern",
                                           F.lit("invalid regex").alias("reason"))
    return good, bad


def implies_edges(rules: DataFrame) -> DataFrame:
    """Implies graph edges (src_key -pos-> dst_key) with the implier's name."""
    return rules.select(F.col("tech_key").alias("src_key"), F.col("name").alias("src_name"),
                        F.posexplode("implies").alias("pos", "dst")) \
        .select("src_key", "src_name", "pos", F.lower(strip("dst")).alias("dst_key"),
                strip("dst").alias("dst_raw"))


def dom_rules(rules: DataFrame) -> DataFrame:
    """dom rules flattened: (tech_key, ord, pos, selector, kind, text_rx, attr_rx, prop_rx).

    kind: ``list`` (list-shaped dom), ``exists`` (empty sub-rule or an ``exists`` key),
    ``criteria`` (text / attributes / properties regexes on one element).
    """
    d = rules.filter(F.col("dom").isNotNull()).select("tech_key", "ord", strip("dom").alias("dom"))
    lists = d.filter(F.col("dom").startswith("[")).select(
        "tech_key", "ord", F.posexplode(F.from_json("dom", T.ArrayType(T.StringType()))).alias("pos", "selector")) \
        .select("tech_key", "ord", "pos", "selector", F.lit("list").alias("kind"),
                F.lit(None).cast("string").alias("text_rx"),
                F.lit(None).cast(_MAP).alias("attr_rx"), F.lit(None).cast(_MAP).alias("prop_rx"))
    dicts = d.filter(F.col("dom").startswith("{")).select(
        "tech_key", "ord", F.posexplode(F.from_json("dom", _MAP)).alias("pos", "selector", "sub"))
    sub = strip(F.coalesce("sub", F.lit("")))
    is_exists = sub.isin("", "{}", "null", "[]", "false", "0") | \
        F.get_json_object(sub, "$.exists").isNotNull() | sub.rlike(r'"exists"\s*:')
    dicts = dicts.select(
        "tech_key", "ord", "pos", "selector",
        F.when(is_exists, "exists").otherwise("criteria").alias("kind"),
        F.get_json_object(sub, "$.text").alias("text_rx"),
        F.from_json(F.get_json_object(sub, "$.attributes"), _MAP).alias("attr_rx"),
        F.from_json(F.get_json_object(sub, "$.properties"), _MAP).alias("prop_rx"))
    return lists.unionByName(dicts)


def dom_selectors(rules: DataFrame) -> DataFrame:
    """S3: distinct selectors over list- and dict-shaped dom."""
    return dom_rules(rules).select("selector").distinct()


# Fixed values -- the built-in JS global expressions probed before rule keys, in order.
BUILTIN_JS_GLOBALS = [
    "window.React", "window.React?.version", "window.__NEXT_DATA__", "window.__nuxt", "window.angular",
    "window.Vue", "window.Backbone", "window.jQuery", "window.jQuery?.fn?.jquery", "window.wp",
    "window.Drupal", "window.Shopify", "window.ga", "window.gtag", "window.dataLayer",
    "window.__REDUX_STORE__", "window.supabase", "window.__FIREBASE_DEFAULTS__", "window.goog",
    "window.goog?.CLOSURE_NO_DEPS", "window.CLOSURE_BASE_PATH", "window.goog?.require", "window.WebFonts",
]


def js_global_keys(spark: SparkSession, rules: DataFrame) -> DataFrame:
    """Built-ins then every rule key, order-preserving dedupe."""
    builtin = spark.createDataFrame([(i, k) for i, k in enumerate(BUILTIN_JS_GLOBALS)], "pos long, key string") \
        .select(F.lit(0).alias("grp"), "pos", "key")
    ruled = rules.select("ord", F.posexplode(F.map_keys("js_globals")).alias("p", "key")) \
        .select(F.lit(1).alias("grp"), (F.col("ord") * 10000 + F.col("p")).cast("long").alias("pos"), "key")
    allk = builtin.unionByName(ruled)
    return allk.groupBy("key").agg(F.min(F.struct("grp", "pos")).alias("o")) \
        .select("key", F.col("o.grp").alias("grp"), F.col("o.pos").alias("pos"))
