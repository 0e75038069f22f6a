"""Evidence extraction: HTML projections (H1-H9) and response tables.

All are narrow transforms of the page (or response) rows: no shuffle until a
per-key fold needs one, and every per-page array is produced with native
regex functions inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions import urls as U
from sitelens.functions.staging import computed
from sitelens.functions.text import strip


def page_source(pages: DataFrame) -> DataFrame:
    """(page_id, url, html): whole pages, whatever their length."""
    return pages.select("page_id", "url", "html")


# attributes read from each start-tag kind (output column -> attribute name)
TAG_ATTRS = {
    "meta": {"n": "name", "p": "property", "h": "http-equiv", "content": "content"},
    "script": {"src": "src"},
    "link": {"href": "href", "rel": "rel"},
    "a": {"href": "href"},
}
_ATTR_NAMES = {c: name for spec in TAG_ATTRS.values() for c, name in spec.items()}
_ALL_ATTR_COLS = sorted(_ATTR_NAMES)


def page_tags(pages: DataFrame, kinds=("meta", "script", "link")) -> DataFrame:
    """One pass over the html: (page_id, kind, pos, <attribute columns>) for every start tag of ``kinds``.

    The html is tokenised once and every tag kind is read from that one list.  Callers with several
    consumers partition the (small) tag table by page, so all of them read one shuffle output.
    """
    m = computed(pages.select("page_id", "html"), tags=H.start_tags("html", kinds)).select("page_id", "tags")

    def recs(kind):
        spec = TAG_ATTRS[kind]
        return F.transform(F.filter("tags", lambda t: H.tag_name(t) == kind), lambda a, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"),
            *[(H.attr_raw(a, spec[c]) if c in spec else F.lit(None).cast("string")).alias("_raw_" + c)
              for c in _ALL_ATTR_COLS]))

    g = m.select("page_id", F.explode(F.concat(*[recs(k) for k in kinds])).alias("t"))
    return g.select("page_id", F.col("t.kind").alias("kind"), F.col("t.pos").alias("pos"),
                    *[H.clean_attr(F.col("t._raw_" + c), _ATTR_NAMES[c]).alias(c) for c in _ALL_ATTR_COLS])


def meta_tags(pages: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """H1: (page_id, key, content); key = name | property | http-equiv, lower-cased; last duplicate wins."""
    t = (tags if tags is not None else page_tags(pages, ("meta",))).filter(F.col("kind") == "meta")
    key = F.coalesce(F.nullif("n", F.lit("")), F.nullif("p", F.lit("")), F.nullif("h", F.lit("")))
    rows = t.select("page_id", "pos", F.lower(key).alias("key"), "content") \
        .filter((F.col("key") != "") & (F.col("content") != ""))
    return rows.groupBy("page_id", "key").agg(F.max_by("content", "pos").alias("content"))


def _tag_attr_list(pages: DataFrame, tag: str, attr_name: str, tags: DataFrame | None = None) -> DataFrame:
    t = (tags if tags is not None else page_tags(pages, (tag,))).filter(F.col("kind") == tag)
    v = F.col(attr_name)
    return t.filter(v.isNotNull() & (v != "")).select("page_id", "pos", strip(v).alias(attr_name))


def script_srcs(pages: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """H2: every <script src>, stripped, document order, duplicates kept."""
    return _tag_attr_list(pages, "script", "src", tags)


def link_hrefs(pages: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """H3: every <link href>, stripped, document order."""
    return _tag_attr_list(pages, "link", "href", tags)


def inline_scripts(pages: DataFrame) -> DataFrame:
    """H4: whole bodies of <script> without src, trimmed, non-empty; a comment mark inside a body is part of it."""
    blocks = pages.select("page_id", F.posexplode(H.scripts("html")).alias("pos", "s"))
    return blocks.filter(~H.has_attr(F.col("s.tag"), "src")).select("page_id", "pos", strip("s.body").alias("script")).filter(F.col("script") != "")


def html_comments(pages: DataFrame) -> DataFrame:
    """H5: comment texts, trimmed, non-empty (comments inside script/style bodies are text, not comments)."""
    return pages.select("page_id", F.posexplode(H.comments("html")).alias("pos", "comment")) \
        .select("page_id", "pos", strip("comment").alias("comment")).filter(F.col("comment") != "")


def data_attributes(pages: DataFrame) -> DataFrame:
    """H6: data-* attributes of the first <html> and first <body>; body wins a clash."""
    m = computed(pages.select("page_id", "html"), tags=H.start_tags("html", ("html", "body"))).select("page_id", "tags")

    def data_of(kind: str, order: int):
        first = F.try_element_at(F.filter("tags", lambda t: H.tag_name(t) == kind), F.lit(1))
        return F.transform(F.filter(H.attributes(first), lambda a: a["name"].startswith("data-")), lambda a, i: F.struct(
            F.lit(order).alias("tag_ord"), i.alias("pos"), a["name"].alias("name"), a["value"].alias("value")))

    data = [data_of(kind, order) for order, kind in enumerate(["html", "body"])]
    out = m.select("page_id", F.explode(F.concat(*[F.coalesce(d, F.array()) for d in data])).alias("d")) \
        .select("page_id", "d.tag_ord", "d.pos", "d.name", H.unescape(F.col("d.value")).alias("value"))
    # within a tag the parser keeps the last duplicate; across tags body overwrites html
    return out.groupBy("page_id", "name").agg(F.max_by("value", F.struct("tag_ord", "pos")).alias("value"))


def manifest_url(pages: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """H7: href of the first <link> whose rel tokens include 'manifest'."""
    t = (tags if tags is not None else page_tags(pages, ("link",))).filter(F.col("kind") == "link")
    rel = F.lower(F.coalesce("rel", F.lit("")))
    hit = t.filter(F.array_contains(F.split(strip(rel), r"\s+"), "manifest"))
    return hit.groupBy("page_id").agg(F.min_by(F.struct(strip("href").alias("h")), "pos").alias("f")) \
        .select("page_id", F.col("f.h").alias("manifest_url")).filter(F.col("manifest_url").isNotNull()
                                                                      & (F.col("manifest_url") != ""))


def site_links(pages: DataFrame) -> DataFrame:
    """H9: <a href> resolved against the page, fragment dropped, same netloc, deduped; all of them, ranked
    by first appearance (a caller with a quota filters by rank)."""
    found = pages.select("page_id", "url", F.posexplode(H.start_tags("html", ("a",))).alias("pos", "tag"))
    tags = computed(found, href=H.attr(F.col("tag"), "href"))
    resolved = F.regexp_replace(U.resolve_url(F.col("url"), F.col("href")), "(?s)#.*$", "")
    links = computed(tags.filter(F.col("href").isNotNull()), link=resolved).select("page_id", "url", "pos", "link") \
        .filter(U.url_netloc("link") == U.url_netloc("url")) \
        .groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("page_id").orderBy("pos")
    return links.withColumn("rank", F.row_number().over(w))


# --- response tables (S6-S9, S18) ---------------------------------------------
REDIRECT_KEEP = ["server", "x-powered-by", "x-aspnet-version", "x-aspnetmvc-version", "x-generator",
                 "x-drupal-cache", "x-varnish", "x-cache", "via"]  # S7 fixed allow-list


def final_hop(status: DataFrame) -> DataFrame:
    return status.groupBy("page_id").agg(F.max("hop").alias("final_hop"))


def fold_headers(headers: DataFrame, status: DataFrame) -> DataFrame:
    """Final-response headers folded to (page_id, name lower, values joined ', ' in arrival order)."""
    h = headers.join(final_hop(status), "page_id").filter(F.col("hop") == F.col("final_hop"))
    return h.groupBy("page_id", F.lower("name").alias("name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]),
                     ", ").alias("value"))


def redirect_hops(headers: DataFrame, status: DataFrame) -> DataFrame:
    """One row per redirect hop (not the final one) with allow-listed headers only; a repeated
    header is joined ', ' in arrival order, as on the final response."""
    fh = final_hop(status)
    hops = status.join(fh, "page_id").filter(F.col("hop") < F.col("final_hop")).select("page_id", "hop", "status")
    folded = headers.filter(F.lower("name").isin(REDIRECT_KEEP)).groupBy("page_id", "hop", F.lower("name").alias("k")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), ", ").alias("value"))
    hh = folded.groupBy("page_id", "hop").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "value")))).alias("headers"))
    return hops.join(hh, ["page_id", "hop"], "left")


def first_cookies(cookies: DataFrame) -> DataFrame:
    """Name -> value; the jar wins (a later hop overwrites an earlier one),
    final-response cookies only fill gaps."""
    pri = F.when(F.col("origin") == "jar", 0).otherwise(1)
    return cookies.groupBy("page_id", "name").agg(
        F.min_by("value", F.struct(pri.alias("p"), (-F.col("hop")).alias("h"))).alias("value"))


def raw_set_cookies(headers: DataFrame) -> DataFrame:
    """Raw Set-Cookie values over history then final, in order, with the cookie name."""
    sc = headers.filter(F.lower("name") == "set-cookie")
    return sc.select("page_id", "hop", "pos", F.col("value").alias("raw"),
                     strip(F.split_part("value", F.lit("="), F.lit(1))).alias("cookie_name"))


def collection_errors(status: DataFrame) -> DataFrame:
    """Status >= 400 on the final response is an error string; the row is kept."""
    fh = final_hop(status)
    fin = status.join(fh, "page_id").filter(F.col("hop") == F.col("final_hop"))
    return fin.select("page_id", "status", F.array_compact(F.array(
        F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"),
                                                F.lit(" from "), F.col("url"))))).alias("errors"))
