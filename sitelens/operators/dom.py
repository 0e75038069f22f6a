"""DOM evidence (H8) and DOM matching.

* Selectors are compiled once per rule set (``compile_selectors``): comma lists of chains of compounds -- tag,
  #id, .class, [attr], [attr op 'v'] -- joined by descendant, child (>), adjacent (+) and sibling (~)
  combinators.  Pseudo-classes are quarantined (counted, never silently dropped).
* Element text needs nesting, which regexes cannot give: ``dom_elements`` is one Arrow UDF over the stdlib HTML
  parser.  It labels each element with its interval in document order (``pos`` to ``last``), its parent and
  its previous sibling, and only emits elements that some compound can match, of pages that may hold one.
* An element meets compounds by an equi-join on one key (its tag, an attribute, or ``*``).  A combinator is
  an equi-join on the parent or sibling label, or a running maximum over the intervals of a page (a window):
  no pairs of elements are built.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions import regex as rx
from sitelens.functions.staging import computed
from sitelens.functions.text import strip
from sitelens.operators import prefilter as PF

DOM_MATCH_CUT = 100     # M8
DOM_CRITERIA_CUT = 120  # M10
SRC_RANK_DOM = 6
# Fixed value: tags with no end tag in HTML.
VOID_TAGS = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
             "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
# Attributes that hold a list of words; their white space is normalised.
WORD_LISTS = {"*": {"class", "accesskey", "dropzone"}, "a": {"rel", "rev"}, "link": {"rel", "rev"}, "td": {"headers"}, "th": {"headers"},
              "form": {"accept-charset"}, "object": {"archive"}, "area": {"rel"}, "icon": {"sizes"}, "iframe": {"sandbox"}, "output": {"for"}}
# Elements whose strings belong to their own text only, not to that of the elements around them.
OWN_TEXT = {"script", "style", "template", "rt", "rp"}
# Attributes that can carry a resource URL for a selector tested on a request URL.
URL_ATTRS = ["href", "src", "data-href"]

ELEMENT = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("before", T.IntegerType()),
])

# ---------------------------------------------------------------------------
# selector grammar (rule-compile time, Python on the small rule table)
# ---------------------------------------------------------------------------
_ATTR = r"\[\s*([A-Za-z0-9_:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*\]"
_COMPOUND = re.compile(r"(?=[A-Za-z*#.\[])([A-Za-z][A-Za-z0-9-]*|\*)?((?:#[A-Za-z0-9_-]+|\.[A-Za-z0-9_-]+|" + _ATTR + r")*)")
_PART = re.compile(r"#([A-Za-z0-9_-]+)|\.([A-Za-z0-9_-]+)|" + _ATTR)
_JOINT = re.compile(r"\s*([>+~,])\s*|\s+")


def _compound(m: re.Match) -> tuple:
    tag = None if m.group(1) in (None, "*") else m.group(1).lower()
    conds = []
    for p in _PART.finditer(m.group(2) or ""):
        if p.group(1):
            conds.append(("id", "=", p.group(1)))
        elif p.group(2):
            conds.append(("class", "~=", p.group(2)))
        else:
            val = next((g for g in (p.group(5), p.group(6), p.group(7)) if g is not None), None)
            conds.append((p.group(3).lower(), p.group(4) or "exists", val))
    return tag, conds


def parse_selector(sel: str):
    """Per comma alternative a chain [(combinator, tag | None, [(attr, op, val)])], the first combinator empty;
    None if unsupported."""
    out, chain, joint, at, sel = [], [], "", 0, sel.strip()
    while True:
        m = _COMPOUND.match(sel, at)
        if not m or m.end() == at:
            return None
        chain.append((joint, *_compound(m)))
        at = m.end()
        if at == len(sel):
            return [*out, chain]
        j = _JOINT.match(sel, at)
        if not j:
            return None
        joint, at = j.group(1) or " ", j.end()
        if joint == ",":
            out.append(chain)
            chain, joint = [], ""


_SEL_SCHEMA = T.ArrayType(T.ArrayType(T.StructType([
    T.StructField("joint", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("conds", T.ArrayType(T.StructType([
        T.StructField("attr", T.StringType()), T.StructField("op", T.StringType()),
        T.StructField("val", T.StringType())]))),
])))


@F.pandas_udf(_SEL_SCHEMA)
def _parse_selectors(sels: pd.Series) -> pd.Series:
    res = []
    for s in sels:
        p = parse_selector(s) if s is not None else None
        res.append(None if p is None else [[{"joint": j, "tag": t, "conds": [{"attr": a, "op": o, "val": v} for a, o, v in c]}
                                            for j, t, c in chain] for chain in p])
    return pd.Series(res)


def compile_selectors(dom_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(compounds(selector, alt, step, steps, joint, tag, conds, key), quarantine(selector, reason)).

    ``key`` is what an element must have to meet the compound: ``<tag``, an attribute name, or ``*``.
    """
    s = dom_rules.select("selector").distinct().withColumn("alts", _parse_selectors("selector"))
    bad = s.filter(F.col("alts").isNull()).select("selector", F.lit("unsupported selector").alias("reason"))
    chains = s.filter(F.col("alts").isNotNull()).select("selector", F.posexplode("alts").alias("alt", "chain"))
    good = chains.select("selector", "alt", F.size("chain").alias("steps"), F.posexplode("chain").alias("step", "c")) \
        .select("selector", "alt", "step", "steps", "c.joint", "c.tag", "c.conds")
    key = F.when(F.col("tag").isNotNull(), F.concat(F.lit("<"), F.col("tag"))).when(F.size("conds") > 0, F.col("conds")[0]["attr"]).otherwise(F.lit("*"))
    return good.withColumn("key", key), bad


def cond_holds(attrs: Column, c) -> Column:
    """CSS attribute test of one compiled condition against an attribute map."""
    v = attrs[c["attr"]]
    tokens = F.split(F.coalesce(v, F.lit("")), r"\s+")
    return (v.isNotNull() &
            F.when(c["op"] == "exists", F.lit(True))
            .when(c["op"] == "=", v == c["val"])
            .when(c["op"] == "*=", F.contains(v, c["val"]) & (c["val"] != ""))
            .when(c["op"] == "^=", v.startswith(c["val"]) & (c["val"] != ""))
            .when(c["op"] == "$=", v.endswith(c["val"]) & (c["val"] != ""))
            .when(c["op"] == "~=", F.array_contains(tokens, c["val"]))
            .when(c["op"] == "|=", (v == c["val"]) | v.startswith(F.concat(c["val"], F.lit("-"))))
            .otherwise(F.lit(False)))


# ---------------------------------------------------------------------------
# H8: elements (Arrow UDF over the stdlib parser)
# ---------------------------------------------------------------------------
def _elements(html: str, wanted: frozenset | None) -> list[dict]:
    """The elements that have one of the ``wanted`` keys (None: all), with labels; texts join stripped strings."""
    from html.parser import HTMLParser

    out: list[dict] = []
    stack: list[dict] = []

    class P(HTMLParser):
        count, data, own = 0, "", []
        before = {None: None}  # the last child of each open element

        def flush(self):
            text, self.data = self.data.strip(), ""
            if text:
                kind = self.own[-1]["tag"] if self.own else None
                for el in stack:  # strings of a script, style or template count there and below only
                    if el["keep"] and (el["tag"] if el["tag"] in OWN_TEXT else None) == kind:
                        el["text"].append(text)

        def handle_starttag(self, tag, attrs, closed=False):
            self.flush()
            lists = WORD_LISTS["*"] | WORD_LISTS.get(tag, set())
            d = {k: " ".join((v or "").split()) if k in lists else v or "" for k, v in attrs}
            parent = stack[-1]["pos"] if stack else None
            el = {"pos": self.count, "tag": tag, "attrs": d, "text": [], "last": self.count, "parent": parent, "before": self.before.get(parent),
                  "keep": wanted is None or f"<{tag}" in wanted or not wanted.isdisjoint(d)}
            self.before[parent] = self.count
            self.count += 1
            if el["keep"]:
                out.append(el)
            if not closed and tag not in VOID_TAGS:
                stack.append(el)
                if tag in OWN_TEXT:
                    self.own.append(el)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs, closed=True)

        def handle_endtag(self, tag):
            self.flush()
            if any(el["tag"] == tag for el in reversed(stack)):
                while self.pop() != tag:
                    pass

        def pop(self):
            el = stack.pop()
            el["last"] = self.count - 1
            self.before.pop(el["pos"], None)
            if self.own and self.own[-1] is el:
                self.own.pop()
            return el["tag"]

        def handle_data(self, data):
            self.data += data

        def unknown_decl(self, data):
            self.flush()
            if data.upper().startswith("CDATA["):
                self.data = data[6:]
                self.flush()

        def handle_comment(self, data):
            self.flush()

        handle_decl = handle_pi = handle_comment

    p = P()
    p.own, p.before = [], {None: None}
    try:
        p.feed(html)
        p.close()
    except Exception:  # malformed markup: keep what was parsed
        pass
    p.flush()
    while stack:
        p.pop()
    return [{"pos": e["pos"], "tag": e["tag"], "attrs": e["attrs"], "text": "".join(e["text"]), "last": e["last"], "parent": e["parent"], "before": e["before"]} for e in out]


def _elements_udf(keys: list[str] | None):
    wanted = None if keys is None else frozenset(keys)

    @F.pandas_udf(T.ArrayType(ELEMENT))
    def elements(htmls: pd.Series) -> pd.Series:
        return pd.Series([[] if h is None else _elements(h, wanted) for h in htmls])

    return elements


def _may_hold(html: Column, keys: list[str]) -> Column:
    """Whether a page has a tag or an attribute of that name at all (written out somewhere)."""
    tags = [re.escape(k[1:]) for k in keys if k.startswith("<")]
    names = [re.escape(k) for k in keys if not k.startswith("<")]
    parts = ([rf"<(?:{'|'.join(tags)})[\s/>]"] if tags else []) + ([rf"""[\s"'/](?:{'|'.join(names)})[\s=/>]"""] if names else [])
    return html.rlike("(?i)" + "|".join(parts)) if parts else F.lit(False)


def dom_elements(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """H8: (page_id, pos, tag, attrs, text, last, parent, before) of the elements with one of the ``keys`` (``<tag`` or
    an attribute name; None: all).

    text is the stripped text of all descendants, joined; pos counts all elements of the page, ``last`` is the pos of
    the last descendant, ``before`` that of the previous sibling.
    """
    if keys is not None:
        pages = pages.filter(_may_hold(F.col("html"), keys))
    e = pages.select("page_id", F.explode(_elements_udf(keys)(F.col("html"))).alias("e"))
    return e.select("page_id", "e.*")


def _linked(steps: DataFrame, before: DataFrame) -> DataFrame:
    """The rows of ``steps`` whose combinator holds towards an element of ``before`` (same page and chain, one step earlier)."""
    chain = ["page_id", "selector", "alt"]
    parts = []
    for joint, label in ((">", "parent"), ("+", "before")):
        left = before.select(*chain, F.col("pos").alias(label))
        parts.append(steps.filter(F.col("joint") == joint).join(left, [*chain, label], "left_semi").select(steps.columns))
    # descendant: an interval that began earlier and is still open; sibling: an earlier child of the same parent
    for joint, keys in ((" ", chain), ("~", [*chain, "parent"])):
        right = steps.filter(F.col("joint") == joint).withColumn("open", F.lit(None).cast("int"))
        until = F.col("last") if joint == " " else F.lit((1 << 31) - 1)
        left = before.withColumn("open", until)
        earlier = Window.partitionBy(*keys).orderBy("pos", F.col("open").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        both = right.withColumn("asks", F.lit(True)).unionByName(left.withColumn("asks", F.lit(False)))
        parts.append(both.withColumn("reach", F.max("open").over(earlier)).filter(F.col("asks") & (F.col("reach") >= F.col("pos"))).select(steps.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dom_evidence(elements: DataFrame, compounds: DataFrame) -> DataFrame:
    """Elements matching each selector: (page_id, selector, pos, text, attrs) -- one row per element."""
    keys = F.concat(F.array(F.concat(F.lit("<"), F.col("tag")), F.lit("*")), F.map_keys("attrs"))
    met = elements.withColumn("key", F.explode(keys)).join(compounds.drop("tag"), "key")
    met = met.filter(F.forall("conds", lambda c: cond_holds(F.col("attrs"), c)))
    met = met.select("page_id", "selector", "alt", "step", "steps", "joint", "pos", "last", "parent", "before", "text", "attrs")
    longest = compounds.agg(F.max("steps")).first()[0] or 1  # one row of the rule table
    if longest > 1:
        met = met.checkpoint()  # pages are parsed once, the few compounds that hold are read for each step
    found = met.filter("step = 0")
    hit = found.filter("steps = 1")
    for step in range(1, longest):
        found = _linked(met.filter(F.col("step") == step), found.filter(F.col("steps") > step))
        hit = hit.unionByName(found.filter(F.col("steps") == step + 1))
    # an element matching two alternatives of one selector counts once
    return hit.select("page_id", "selector", "pos", "text", "attrs").dropDuplicates(["page_id", "selector", "pos"])


# ---------------------------------------------------------------------------
# Synthetic findings
# ---------------------------------------------------------------------------
def url_selector_alternatives(dom_rules: DataFrame) -> DataFrame:
    """M11 compile: (selector, alt, attr, op, val) for alternatives that are one valued test of a URL attribute."""
    compounds, _ = compile_selectors(dom_rules)
    one = compounds.filter((F.col("steps") == 1) & (F.size("conds") == 1))
    m = one.select("selector", "alt", F.inline("conds"))
    return m.filter(F.col("attr").isin(URL_ATTRS) & (F.coalesce("val", F.lit("")) != ""))


def url_matches(url: Column) -> Column:
    """M11 semantics of one compiled alternative (columns attr/op/val) on a request URL."""
    v = F.col("val")
    rel = ~(v.startswith("http:") | v.startswith("https:") | v.startswith("//"))
    return (F.when(F.col("op") == "=", (url == v) | (rel & url.endswith(v)))
            .when(F.col("op") == "*=", F.contains(url, v))
            .when(F.col("op") == "^=", url.startswith(v))
            .when(F.col("op") == "$=", url.endswith(v))
            .when(F.col("op") == "~=", F.array_contains(F.split(url, r"\s+"), v))
            .otherwise(F.contains(url, v)))


def dom_from_requests(requests: DataFrame, dom_rules: DataFrame, existing: DataFrame) -> DataFrame:
    """For selectors without any finding on a page, each request URL that satisfies an
    alternative becomes a finding {text: '', attributes: {attr: url}} (selector alternative order,
    then request order)."""
    alts = url_selector_alternatives(dom_rules)
    # every kind of test needs the value inside the URL: the literal prefilter finds the candidates
    pats = alts.withColumn("pid", F.xxhash64("selector", "alt", "attr", "op", "val"))
    cand = PF.regex_join(requests.select("page_id", "seq", "url"), "url", pats, PF.any_of(F.array("val")), url_matches(F.col("url")))
    cand = cand.join(existing.select("page_id", "selector").distinct(), ["page_id", "selector"], "left_anti")
    return cand.select("page_id", "selector", (F.col("alt") * 1000000 + F.col("seq")).alias("pos"),
                       F.lit("").alias("text"), F.create_map(F.col("attr"), F.col("url")).alias("attrs"))


MANIFEST_SELECTOR = "link[rel='manifest']"


def dom_from_manifest(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """link[rel='manifest'] finding from a known manifest URL when the page has none."""
    m = manifest.select("page_id", F.lit(MANIFEST_SELECTOR).alias("selector"), F.lit(0).alias("pos"),
                        F.lit("").alias("text"),
                        F.create_map(F.lit("rel"), F.lit("manifest"), F.lit("href"), F.col("manifest_url")).alias("attrs"))
    return m.join(existing.select("page_id", "selector").distinct(), ["page_id", "selector"], "left_anti")


def merge_dom_findings(static: DataFrame, browser: DataFrame | None) -> DataFrame:
    """Browser findings are appended unless the same text is already present for the selector."""
    if browser is None:
        return static
    add = browser.join(static.select("page_id", "selector", "text").distinct(), ["page_id", "selector", "text"],
                       "left_anti").withColumn("pos", F.col("pos") + 1_000_000_000).select(static.columns)
    return static.unionByName(add)


# ---------------------------------------------------------------------------
# DOM rules against findings
# ---------------------------------------------------------------------------
def _value_of(c: Column) -> Column:
    """What a criterion tests: the element's text, or one of its attributes."""
    return F.when(c["kind"] == "text", F.coalesce(F.col("text"), F.lit(""))).otherwise(F.col("attrs")[c["key"]])


def _criteria_ok() -> Column:
    return F.forall("criteria", lambda c: F.coalesce(F.regexp_like(_value_of(c), F.concat(F.lit("(?iu)"), c["rx"])), F.lit(False)))


def _criteria_version() -> Column:
    """First non-empty capture: text, then attributes, then properties (map order); patterns without a group have none."""
    got = F.transform("criteria", lambda c: F.when(c["n_groups"] > 0, F.call_function(
        "regexp_extract", _value_of(c), F.concat(F.lit("(?iu)"), c["rx"]), F.lit(1))))
    return F.try_element_at(F.filter(got, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))


def match_dom(findings: DataFrame, dom_rules: DataFrame) -> DataFrame:
    """M8 (list), M9 (exists), M10 (criteria) -> matches_raw rows (src 'dom')."""
    j = findings.withColumnRenamed("pos", "fpos").join(dom_rules, "selector")
    base = ["page_id", "tech_key", F.lit("dom").alias("src"), F.lit(SRC_RANK_DOM).alias("src_rank"), "pos"]
    # M8: any finding; text of the first one
    lst = j.filter(F.col("kind") == "list").groupBy("page_id", "tech_key", "pos", "selector") \
        .agg(F.min_by("text", "fpos").alias("t"))
    lst = lst.select(*base, F.lit("selector").alias("key"),
                     F.substring(F.concat(F.lit("Found element: "), F.col("selector"),
                                          F.when(F.coalesce("t", F.lit("")) != "",
                                                 F.concat(F.lit(" (text: "), F.col("t"), F.lit(")")))
                                          .otherwise(F.lit(""))), 1, DOM_MATCH_CUT).alias("matched"),
                     F.col("selector").alias("pattern"), F.lit(None).cast("string").alias("version"))
    # M9: exists
    ex = j.filter(F.col("kind") == "exists").select("page_id", "tech_key", "pos", "selector").distinct()
    ex = ex.select(*base, F.col("selector").alias("key"),
                   F.concat(F.lit("Element exists: "), F.col("selector")).alias("matched"),
                   F.lit("").alias("pattern"), F.lit(None).cast("string").alias("version"))
    # First element meeting every criterion
    cr = j.filter(F.col("kind") == "criteria").filter(_criteria_ok())
    cr = cr.withColumn("version", _criteria_version())
    details = F.concat_ws(", ",
                          F.when(F.col("text_rx").isNotNull(), F.concat(F.lit("text: "), F.col("text"))),
                          F.when(F.col("attr_rx").isNotNull(), F.concat(
                              F.lit("attributes: "),
                              F.to_json(F.map_from_arrays(F.map_keys("attr_rx"),
                                                          F.transform(F.map_keys("attr_rx"),
                                                                      lambda k: F.col("attrs")[k]))))))
    cr = cr.withColumn("m", F.substring(F.when(details != "", F.concat(F.lit("Found: "), F.col("selector"),
                                                                       F.lit(" ("), details, F.lit(")")))
                                        .otherwise(F.concat(F.lit("Found: "), F.col("selector"))), 1, DOM_CRITERIA_CUT))
    cr = cr.groupBy("page_id", "tech_key", "pos", "selector", "sub_json") \
        .agg(F.min_by(F.struct("m", "version"), "fpos").alias("b"))
    cr = cr.select(*base, F.col("selector").alias("key"), F.col("b.m").alias("matched"),
                   F.col("sub_json").alias("pattern"), F.col("b.version").alias("version"))
    return lst.unionByName(ex).unionByName(cr)


_CRITERIA = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("pattern", T.StringType()),
    T.StructField("rx", T.StringType()), T.StructField("n_groups", T.IntegerType())]))


@F.pandas_udf(_CRITERIA)
def _compile_criteria(criteria: pd.Series) -> pd.Series:
    return pd.Series([None if rows is None else [
        {"kind": c["kind"], "key": c["key"], "pattern": c["pattern"], "rx": rx.java_form(c["pattern"]), "n_groups": rx.n_groups(c["pattern"] or "")}
        for c in rows] for rows in criteria])


def _with_criteria(dom_rules: DataFrame) -> DataFrame:
    """dom rules plus ``criteria``: the compiled regexes of text, attributes and properties (``rx`` null: no valid regex)."""
    empty = F.create_map().cast("map<string,string>")

    def listed(kind: str, entries: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("pattern")))

    text = F.when(F.col("text_rx").isNotNull(), F.create_map(F.lit(""), F.col("text_rx"))).otherwise(empty)
    each = F.concat(*[listed(k, F.map_entries(F.coalesce(m, empty))) for k, m in (("text", text), ("attribute", F.col("attr_rx")), ("property", F.col("prop_rx")))])
    out = computed(dom_rules, criteria=_compile_criteria(each))
    judged = F.transform("criteria", lambda c: c.withField("rx", F.when(rx.compiles(c["rx"]), c["rx"])))
    return computed(out, criteria=judged)


def prepare_dom_rules(dom_rules: DataFrame) -> DataFrame:
    """dom rules with compiled criteria and the sub-rule as JSON (evidence pattern); rules with a bad regex are left
    to ``bad_dom_rules``."""
    sub = F.to_json(F.struct(F.col("text_rx").alias("text"), F.col("attr_rx").alias("attributes"),
                             F.col("prop_rx").alias("properties")))
    return _with_criteria(dom_rules).filter(F.forall("criteria", lambda c: c["rx"].isNotNull())).withColumn("sub_json", sub)


def bad_dom_rules(dom_rules: DataFrame) -> DataFrame:
    """M15 for DOM criteria: (tech_key, src, key, pattern, reason) of every regex without a valid form."""
    c = _with_criteria(dom_rules).select("tech_key", "selector", F.explode("criteria").alias("c")).filter(F.col("c.rx").isNull())
    return c.select("tech_key", F.lit("dom").alias("src"), F.col("selector").alias("key"), F.col("c.pattern").alias("pattern"),
                    F.lit("invalid regex").alias("reason"))


def page_dom_findings(pages: DataFrame, dom_rules: DataFrame, requests: DataFrame | None = None,
                      manifest: DataFrame | None = None, browser: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Static findings (H8) + those of a browser (M14) + synthetic manifest (M13) + request-URL findings (M12); plus quarantine."""
    compounds, bad = compile_selectors(dom_rules)
    found = merge_dom_findings(dom_evidence(dom_elements(pages, wanted_keys(compounds)), compounds), browser).checkpoint()  # parsed once, read by each branch
    parts = [found]
    if manifest is not None:
        parts.append(dom_from_manifest(manifest, found))
    if requests is not None:
        existing = found if manifest is None else found.unionByName(parts[-1])
        parts.append(dom_from_requests(requests, dom_rules, existing))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, bad


def wanted_keys(compounds: DataFrame) -> list[str] | None:
    """What elements must have to matter to some compound; None if one of them matches every element."""
    keys = [r["key"] for r in compounds.select("key").distinct().collect()]  # tags and attributes of the rules
    return None if "*" in keys else sorted(keys)
