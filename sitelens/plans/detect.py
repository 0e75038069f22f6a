"""The full detection job, evidence -> matches_raw -> tech_matches -> implied -> ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.staging import written
from sitelens.operators import dom as D
from sitelens.operators import evidence as E
from sitelens.operators import implies as I
from sitelens.operators import match as M
from sitelens.operators import score as S
from sitelens.sources import rules as R


@dataclass
class CompiledRules:
    rules: DataFrame
    patterns: DataFrame
    quarantine: DataFrame
    dom: DataFrame
    _walk: object | None = None

    @property
    def walk(self):
        """A5 walk over the implies graph, built on first use (once per rule set)."""
        if self._walk is None:
            self._walk = I.implies_walk(self.rules)
        return self._walk


# Compiled rule tables are a dimension: thousands of rows for a full rule database.
MAX_LOCAL_RULE_ROWS = 1_000_000


def localize(df: DataFrame, max_rows: int = MAX_LOCAL_RULE_ROWS) -> DataFrame:
    """Materialise a small, size-checked dimension table as a local relation.

    Joins then broadcast it without a Spark job per use.  Above the bound the table
    stays distributed (and Spark picks the join strategy by size).  An Arrow table becomes a relation whose size Spark
    knows; of rows it would not, and would first shuffle the pages that meet it.
    """
    rows = df.limit(max_rows + 1).toArrow()  # size probe only: no row is ever dropped
    if rows.num_rows > max_rows:
        return df.cache()
    return df.sparkSession.createDataFrame(rows, df.schema)


def compile_all(rules: DataFrame, with_walk: bool = True) -> CompiledRules:
    """Compile a rule set once: patterns (+ analysis), quarantine, dom rules and the implies walk."""
    rules = localize(rules)
    pats, bad = R.compile_rules(rules)
    dom = localize(R.dom_rules(rules))
    cr = CompiledRules(rules, localize(pats), bad.unionByName(D.bad_dom_rules(dom)), dom)
    if with_walk:
        cr.walk  # noqa: B018 -- materialise now: it belongs to the rule set, not to a page batch
    return cr


def matches_raw(pages: DataFrame, cr: CompiledRules, headers: DataFrame | None = None,
                cookies: DataFrame | None = None, js_globals: DataFrame | None = None,
                requests: DataFrame | None = None, browser_findings: DataFrame | None = None, sources=("header", "cookie", "meta", "script", "html",
                                                            "js_global", "dom")) -> DataFrame:
    """Union of every source's matches for the given evidence tables.

    browser_findings: (page_id, selector, pos, text, attrs) that a browser saw, added to those of the markup (M14).
    """
    pages = E.page_source(pages)
    parts = []
    if "header" in sources and headers is not None:
        parts.append(M.match_keyed(headers.select("page_id", F.col("name").alias("key_norm"), "value"),
                                   cr.patterns, "header"))
    if "cookie" in sources and cookies is not None:
        # names that differ in case only: the last in name order wins, whatever the partitioning
        parts.append(M.match_keyed(cookies.groupBy("page_id", F.lower("name").alias("key_norm"))
                                   .agg(F.max_by("value", "name").alias("value")), cr.patterns, "cookie"))
    # one html pass for every start-tag source: the (small) tag table is written, or each branch below would push its
    # own filter and columns into the pass and tokenise the pages again
    tags = written(E.page_tags(pages, ("meta", "script", "link")), "tags")
    if "meta" in sources:
        parts.append(M.match_keyed(E.meta_tags(pages, tags).select("page_id", F.col("key").alias("key_norm"),
                                                                   F.col("content").alias("value")),
                                   cr.patterns, "meta"))
    srcs = links = None
    if "script" in sources or "dom" in sources:
        srcs, links = E.script_srcs(pages, tags), E.link_hrefs(pages, tags)
    if "script" in sources:
        vals = M.script_values(srcs, links, requests)
        parts.append(M.match_scripts(vals, cr.patterns))
    if "html" in sources:
        parts.append(M.match_html(pages, cr.patterns))
    if "js_global" in sources and js_globals is not None:
        parts.append(M.match_js_globals(js_globals, cr.patterns))
    if "dom" in sources:
        found, _ = D.page_dom_findings(pages, cr.dom, requests=requests, manifest=E.manifest_url(pages, tags), browser=browser_findings)
        parts.append(D.match_dom(found, D.prepare_dom_rules(cr.dom)))
    out = parts[0].select(*M.MATCH_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*M.MATCH_COLS))
    return out
