"""Registered queries: DOM elements (H8), DOM findings from requests / manifest (M11-M13),
DOM rule matching (M8-M10, M14) and the full detection with every source (A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import dom as D
from sitelens.operators import evidence as E
from sitelens.operators import implies as I
from sitelens.operators import score as S
from sitelens.plans import oracle as O
from sitelens.plans.catalog import _rules, oracle, query
from sitelens.plans.q_evidence import F2_CTE, d_attr, d_explode, d_masked, d_tags, f2, f3, f4, f5
from sitelens.plans.detect import matches_raw

q = O.sql_str


@query("dom_elements")
def q_dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8 (rows-only check: element text needs the parser)."""
    cr = _rules(spark)
    compounds, _ = D.compile_selectors(cr.dom)
    return D.dom_elements(f2(spark, sf_dir), D.wanted_keys(compounds)).select("page_id", "pos", "tag", "text",
                                                         F.to_json("attrs").alias("attrs"))


@query("dom_match")
def q_dom_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8-M10 over static + synthetic findings (rows-only check)."""
    cr = _rules(spark)
    pages = f2(spark, sf_dir)
    found, _ = D.page_dom_findings(pages, cr.dom, requests=f5(spark, sf_dir), manifest=E.manifest_url(pages))
    return D.match_dom(found, D.prepare_dom_rules(cr.dom))


@query("dom_from_requests")
def q_dom_from_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request URLs as findings for URL selectors the page's markup lacks."""
    cr = _rules(spark)
    pages = f2(spark, sf_dir)
    compounds, _ = D.compile_selectors(cr.dom)
    static = D.dom_evidence(D.dom_elements(pages, D.wanted_keys(compounds)), compounds)
    syn = D.dom_from_requests(f5(spark, sf_dir), cr.dom, static)
    return syn.select("page_id", "selector", "pos", "text", F.explode("attrs").alias("attr", "value"))


def _d_css(v: str, op: str, val: str) -> str:
    return {"=": f"{v} = {q(val)}", "*=": f"contains({v}, {q(val)})", "^=": f"starts_with({v}, {q(val)})",
            "$=": f"ends_with({v}, {q(val)})",
            "~=": f"list_contains(regexp_split_to_array({v}, '\\s+'), {q(val)})"}.get(op, f"contains({v}, {q(val)})")


def _d_url_match(op: str, val: str) -> str:
    rel = not val.startswith(("http:", "https:", "//"))
    if op == "=":
        return f"(url = {q(val)}" + (f" OR ends_with(url, {q(val)}))" if rel else ")")
    return _d_css("url", op, val)


@oracle("dom_from_requests")
def o_dom_from_requests() -> str:
    sels = []
    for r in O.fixture_rules():
        dom = r.get("dom") or {}
        for sel in (dom if isinstance(dom, list) else list(dom)):
            if sel not in sels:
                sels.append(sel)
    parts, statics = [], []
    for sel in sels:
        subs = [x.strip() for x in sel.split(",")]
        for alt, sub in enumerate(subs):
            parsed = D.parse_selector(sub)
            if parsed and len(parsed[0]) == 1 and len(parsed[0][0][2]) == 1 and parsed[0][0][2][0][0] in D.URL_ATTRS and parsed[0][0][2][0][2]:
                _, tag, [(attr, op, val)] = parsed[0][0]
                parts.append(f"SELECT page_id, {q(sel)} AS selector, {alt} * 1000000 + seq AS pos, '' AS text, "
                             f"{q(attr)} AS attr, url AS value FROM req WHERE {_d_url_match(op, val)}")
                # the page's own markup: a start tag satisfying the same simple selector
                statics.append(f"SELECT DISTINCT page_id, {q(sel)} AS selector FROM ("
                               f"{d_explode('f2', d_tags(d_masked('html'), tag or '[a-z]+'))}) "
                               f"WHERE {_d_css(d_attr('a', attr), op, val)}")
    from sitelens.sources import feeds as FD
    return f"""{F2_CTE},
req AS ({FD.f5_requests_sql()}),
st AS ({' UNION '.join(statics)}),
syn AS ({' UNION ALL '.join(parts)})
SELECT syn.* FROM syn WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.page_id = syn.page_id AND st.selector = syn.selector)"""


# manifest URLs reported outside the markup (as a browser would)
MANIFEST_FEED = "SELECT page_id, '/site.webmanifest' AS manifest_url FROM pages"


@query("dom_manifest")
def q_dom_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known manifest URL becomes a link[rel='manifest'] finding where the markup has none."""
    pages = f2(spark, sf_dir)
    manifest = spark.sql(MANIFEST_FEED)
    existing = E.manifest_url(pages).select("page_id", F.lit(D.MANIFEST_SELECTOR).alias("selector"))
    syn = D.dom_from_manifest(manifest, existing)
    return syn.select("page_id", "selector", F.col("attrs")["rel"].alias("rel"), F.col("attrs")["href"].alias("href"))


@oracle("dom_manifest")
def o_dom_manifest() -> str:
    from sitelens.plans.q_evidence import o_manifest_url
    return f"""WITH mf AS ({MANIFEST_FEED}),
ex AS ({o_manifest_url()})
SELECT page_id, {q(D.MANIFEST_SELECTOR)} AS selector, 'manifest' AS rel, manifest_url AS href FROM mf
WHERE page_id NOT IN (SELECT page_id FROM ex)"""


@query("tech_full")
def q_tech_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with every evidence source including DOM (rows-only check: DOM text needs the parser)."""
    cr = _rules(spark)
    h, st, ck = f3(spark, sf_dir)
    raw = matches_raw(f2(spark, sf_dir), cr, headers=E.fold_headers(h, st), cookies=E.first_cookies(ck),
                      js_globals=f4(spark, sf_dir), requests=f5(spark, sf_dir))
    merged = I.rank_matches(I.resolve_implies(S.score(raw, cr.rules), cr.rules, cr.walk))
    return merged.select("page_id", "tech_key", "name", "category", "version", "confidence", "implied",
                         S.evidence_text().alias("evidence"), "rank")
