"""Fingerprint matching M1-M7: evidence x rule_patterns -> matches_raw.

matches_raw(page_id, tech_key, src, src_rank, pos, key, matched, pattern, version)

* M1-M3, M6 are broadcast hash equi-joins on the normalised key, then a
  regex on the value: no shuffle, the page side never moves.
* M4 and M5 are theta joins, run through the prefilter of literal queries
  (``operators.prefilter``) so regexes only run on candidate pairs.
All regexes are case-insensitive and unanchored (``(?iu)`` + the compiled form ``rx``;
``pattern`` is the rule's own text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import prefilter as PF
from sitelens.sources.rules import js_key

CI = "(?iu)"
HTML_MATCH_CUT = 100
JS_VALUE_CUT = 100

MATCH_COLS = ["page_id", "tech_key", "src", "src_rank", "pos", "key", "matched", "pattern", "version"]


def _rx(pattern_col: str = "rx") -> F.Column:
    return F.concat(F.lit(CI), F.col(pattern_col))


def rx_extract(text: F.Column, pattern: F.Column, idx: int) -> F.Column:
    """regexp_extract with a per-row pattern column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(idx))


def _version(text: F.Column) -> F.Column:
    """group 1 when the pattern has groups and it is non-empty, else NULL (guarded: no-group patterns raise)."""
    v = F.when(F.col("n_groups") > 0, rx_extract(text, _rx(), 1))
    return F.nullif(v, F.lit(""))


def with_pid(pats: DataFrame) -> DataFrame:
    """A unique id for up to a million patterns of a kind in a rule."""
    return pats.withColumn("pid", (F.col("ord").cast("long") * 10 + F.col("src_rank")) * 1_000_000 + F.col("pos"))


def match_keyed(evidence: DataFrame, patterns: DataFrame, src: str) -> DataFrame:
    """M1 header / M2 cookie / M3 meta: equi-join on lower(key), regex on the value.

    evidence: (page_id, key_norm, value) for one source, keys unique per page.
    The evidence key reported is the rule's own key; matched = the whole value.
    """
    p = patterns.filter(F.col("src") == src)
    j = evidence.join(p, "key_norm").filter(F.regexp_like(F.col("value"), _rx()))
    return j.select("page_id", "tech_key", "src", "src_rank", "pos", "key",
                    F.col("value").alias("matched"), "pattern", _version(F.col("value")).alias("version"))


def match_js_globals(js: DataFrame, patterns: DataFrame) -> DataFrame:
    """M6/M7: normalised keys on both sides; '.' means the key exists; value cut to 100 + '...' if longer."""
    p = patterns.filter(F.col("src") == "js_global")
    ev = js.select("page_id", js_key("key").alias("key_norm"), "value", F.col("pos").alias("ev_pos"))
    # the evidence dict keeps the last value for a normalised key
    ev = ev.groupBy("page_id", "key_norm").agg(F.max_by("value", "ev_pos").alias("value"))
    j = ev.join(p, "key_norm") \
        .filter((F.col("pattern") == ".") | F.regexp_like(F.col("value"), _rx()))
    cut = F.when(F.length("value") > JS_VALUE_CUT,
                 F.concat(F.substring("value", 1, JS_VALUE_CUT), F.lit("..."))).otherwise(F.col("value"))
    ver = F.when(F.col("pattern") == ".", F.lit(None).cast("string")).otherwise(_version(F.col("value")))
    return j.select("page_id", "tech_key", "src", "src_rank", "pos", "key", cut.alias("matched"), "pattern",
                    ver.alias("version"))


def match_html(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """M5: regex over the raw html; matched = first 100 chars of the hit + '...' (always)."""
    p = with_pid(patterns.filter(F.col("src") == "html"))
    cond = F.regexp_like(F.col("html"), _rx())
    j = PF.regex_join(pages.select("page_id", "html"), "html", p, PF.all_of(F.col("clauses")), cond)
    hit = rx_extract(F.col("html"), _rx(), 0)
    return j.select("page_id", "tech_key", "src", "src_rank", "pos", "key",
                    F.concat(F.substring(hit, 1, HTML_MATCH_CUT), F.lit("...")).alias("matched"), "pattern",
                    _version(F.col("html")).alias("version"))


def script_values(script_srcs: DataFrame | None, link_hrefs: DataFrame | None,
                  requests: DataFrame | None) -> DataFrame | None:
    """script_srcs ++ link_hrefs ++ request URLs per page, with their order (grp, pos)."""
    parts = []
    if script_srcs is not None:
        parts.append(script_srcs.select("page_id", F.lit(0).alias("grp"), "pos", F.col("src").alias("value")))
    if link_hrefs is not None:
        parts.append(link_hrefs.select("page_id", F.lit(1).alias("grp"), "pos", F.col("href").alias("value")))
    if requests is not None:
        parts.append(requests.select("page_id", F.lit(2).alias("grp"), F.col("seq").alias("pos"),
                                     F.col("url").alias("value")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_scripts(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """M4: case-sensitive substring of the raw pattern first (no version), else the regex;
    the first value in order wins; one evidence per pattern.

    Patterns are broadcast onto the page-side values (no shuffle for the join);
    the only shuffle is the per-(page, pattern) pick of the first hit.
    """
    p = with_pid(patterns.filter(F.col("src") == "script"))
    # the pattern as a substring, or the regex
    ways = F.concat(PF.any_of(F.array("pattern")), PF.all_of(F.col("clauses")))
    cond = F.contains(F.col("value"), F.col("pattern")) | F.regexp_like(F.col("value"), _rx())
    vals = values.select("page_id", "grp", F.col("pos").alias("vpos"), "value")
    hits = PF.regex_join(vals, "value", p, ways, cond)
    is_sub = F.contains(F.col("value"), F.col("pattern"))
    hits = hits.select("page_id", "pid", "tech_key", "src", "src_rank", "pos", "key", "pattern", "value",
                       F.struct(F.when(is_sub, 0).otherwise(1).alias("pass"), "grp", "vpos").alias("o"),
                       F.when(~is_sub, _version(F.col("value"))).alias("version"))
    # substring pass beats the regex pass; then the first value in (grp, pos) order
    best = hits.groupBy("page_id", "pid").agg(F.min_by(
        F.struct("tech_key", "src", "src_rank", "pos", "key", "pattern", "value", "version"), "o").alias("b"))
    return best.select("page_id", "b.tech_key", "b.src", "b.src_rank", "b.pos", "b.key",
                       F.col("b.value").alias("matched"), "b.pattern", "b.version")
