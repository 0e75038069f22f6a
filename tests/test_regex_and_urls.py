"""Rule-compile regex analysis and URL expressions."""

import re

from pyspark.sql import functions as F

from sitelens.functions import regex as rx
from sitelens.functions import urls as U
from sitelens.operators import endpoints as EP


def test_mandatory_literal():
    assert rx.mandatory_literal(r"track\(\d+\)") == "track("
    assert rx.mandatory_literal(r"<!-- ad (\d+) -->") == "<!-- ad "
    assert rx.mandatory_literal(r"nginx(?:/([\d.]+))?") == "nginx"
    assert rx.mandatory_literal("^now|Vercel$") is None          # an alternation has no single literal
    assert rx.mandatory_literal(r"ab?c") is None                  # no 3-char run survives '?'
    assert rx.mandatory_literal(r"WordPress(?: ([\d.]+))?") == "wordpress"


def test_clauses_are_and_of_ors():
    assert rx.clauses("^now|Vercel$") == [["now", "vercel"]]
    assert rx.clauses("(?:foo|bar)x+lib(?:one|two[0-9]+three)") == [["one", "three"], ["lib"], ["bar", "foo"]] or \
        sorted(map(sorted, rx.clauses("(?:foo|bar)x+lib(?:one|two[0-9]+three)"))) == [["bar", "foo"], ["lib"], ["one", "three"]]
    assert rx.clauses("(?:foo|b?)tail") == [["tail"]]             # a branch that needs nothing voids the clause
    assert rx.clauses(r"\d+|x?") == [] and rx.clauses("(") == [] and rx.clauses(None) == []
    assert rx.clauses("ab") == [["ab"]] and rx.clauses("a") == []


def test_fold_covers_every_character_that_matches_an_ascii_letter():
    for c in map(chr, range(0x80, 0x110000)):
        if not 0xD800 <= ord(c) < 0xE000:
            for a in set(c.lower() + c.upper() + c.casefold()):
                if a.isascii() and a.isalpha() and re.fullmatch(a, c, re.I):
                    assert rx.fold(c) == a.lower(), hex(ord(c))
    assert rx.fold("\u0130\u0130S \u212a \u03a3\u03c2") == "iis k \u03c3\u03c3"


def test_groups_and_validity():
    assert rx.n_groups(r"jquery[.-]([\d.]*\d)[^/]*\.js") == 1
    assert rx.n_groups("csrfmiddlewaretoken") == 0
    assert not rx.is_valid("([a")
    assert rx.java_form("(?P<v>x)(?P=v)") == r"(x)(?:\1)"   # Python-only syntax is translated
    assert not rx.is_valid("(x)?(?(1)a|b)")   # a conditional has no Java form
    assert rx.is_valid(r"Apache(?:/([\d.]+))?")


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "u string").select(col.alias("r")).first()["r"]


def test_normalize_path(spark):
    assert _one(spark, U.normalize_path(F.col("u")), "https://x.com//api//v1/users/?id=1") == "/api/v1/users"
    assert _one(spark, U.normalize_path(F.col("u")), "https://x.com") == "/"
    assert _one(spark, U.normalize_path(F.col("u")), "/api/users/") == "/api/users"


def test_apex_and_first_party(spark):
    assert _one(spark, U.apex_domain(F.col("u")), "api.example.co.uk") == "example.co.uk"
    assert _one(spark, U.apex_domain(F.col("u")), "v2.aiori.in") == "aiori.in"
    assert _one(spark, U.apex_domain(F.col("u")), "foo.abc.de") == "foo.abc.de"      # 2-char TLD, short 2nd label
    assert _one(spark, U.apex_domain(F.col("u"), "noip"), "maps.googleapis.com") == "googleapis.com"
    assert _one(spark, U.apex_domain(F.col("u")), "10.0.0.1") == "10.0.0.1"
    assert _one(spark, U.apex_domain(F.col("u"), "last2"), "a.b.co.uk") == "co.uk"
    assert _one(spark, U.first_party(F.col("u"), F.lit("example.com")), "www.example.com:443")
    assert not _one(spark, U.first_party(F.col("u"), F.lit("example.com")), "cdn.other.net")


def test_third_party_filter(spark):
    df = spark.createDataFrame([("https://maps.googleapis.com/x",), ("https://www.googletagmanager.com/gtm.js",),
                                ("https://aiori.in/api/anchor/list",), ("/api/x",)], "u string")
    got = [r["t"] for r in df.select(EP.is_third_party("u").alias("t")).collect()]
    assert got == [True, True, False, False]


def test_resolve_url(spark):
    base = "https://h.example.com/a/b/page.html?q=1"
    df = spark.createDataFrame([(base, r) for r in ["/x", "y.js", "//cdn.x/y", "https://o/z", "?p=2"]], "b string, r string")
    got = [x["o"] for x in df.select(U.resolve_url(F.col("b"), F.col("r")).alias("o")).collect()]
    assert got == ["https://h.example.com/x", "https://h.example.com/a/b/y.js", "https://cdn.x/y", "https://o/z",
                   "https://h.example.com/a/b/page.html?p=2"]
