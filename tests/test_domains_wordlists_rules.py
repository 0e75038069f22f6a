"""Domains, wordlists and the rule build."""

from pyspark.sql import functions as F

from sitelens.functions.staging import written
from sitelens.operators import domains as D
from sitelens.operators import rulebuild as RB
from sitelens.operators import wordlists as W


def _one(spark, col):
    return spark.range(1).select(col.alias("r")).first()["r"]


def test_brand_match(spark):
    assert _one(spark, D.brand_matches(F.lit("jsDelivr"), F.lit("www.jsdelivr.com")))
    assert not _one(spark, D.brand_matches(F.lit("Google Font API"), F.lit("maps.example.com")))
    assert _one(spark, D.brand_matches(F.lit("Fullstory"), F.lit("fullstoryapp.com")))   # >= 5 chars: prefix


def test_classify_literal_then_website(spark, rules):
    doms = spark.createDataFrame([("cdn.jsdelivr.net",), ("www.jsdelivr.com",), ("unknown.example.io",),
                                  ("fonts.googleapis.com",)], "domain string")
    out = {r["domain"]: (r["technology_name"], r["category"]) for r in D.classify_domains(doms, rules.rules).collect()}
    assert out["cdn.jsdelivr.net"] == ("jsDelivr", "CDN")
    assert out["www.jsdelivr.com"] == ("jsDelivr", "CDN")
    assert out["fonts.googleapis.com"][0] == "Google Font API"
    assert out["unknown.example.io"] == (None, "Unclassified")


def test_ct_cleanup_and_fallback(spark):
    raw = spark.createDataFrame([
        ("aiori.in", "hackertarget", 0, 0, "*.aiori.in,1.1.1.1"),
        ("aiori.in", "crt.sh", 1, 0, "*.aiori.in\napi.aiori.in"),
        ("aiori.in", "crt.sh", 1, 1, "static.aiori.in\nwww.aiori.in\nAPI.aiori.in\nevil.org"),
    ], "domain string, source string, source_rank int, entry_pos int, raw string")
    subs = D.ct_subdomains(D.ct_names(raw)).orderBy("pos").collect()
    assert [r["subdomain"] for r in subs] == ["api.aiori.in", "static.aiori.in", "www.aiori.in"]
    assert {r["ct_source"] for r in subs} == {"crt.sh"}     # the first source had no usable name


def test_pattern_domain(spark):
    assert _one(spark, D.pattern_domain(F.lit(r"^https?://cdn\.jsdelivr\.net/npm"))) == "cdn.jsdelivr.net"
    assert _one(spark, D.pattern_domain(F.lit(r"googletagmanager\.com/gtm\.js"))) == "googletagmanager.com"
    assert _one(spark, D.pattern_domain(F.lit(r"jquery[.-]"))) is None


def test_normalize_filename_and_token_match(spark):
    got = [_one(spark, W.normalize_filename(F.lit(n))) for n in ["spring-boot.txt", "node-js.txt", "wp-plugins.fuzz.txt"]]
    assert got == ["spring boot", "node.js", "wordpress plugins.fuzz"]
    fw = W.word_set(W.normalize_filename(F.lit("SAP-NetWeaver.txt")), True)
    assert not _one(spark, W.subset_either(fw, W.word_set(F.lit("gsap"), True)))
    assert _one(spark, W.subset_either(W.word_set(F.lit("sap"), True), W.word_set(F.lit("sap commerce cloud"), True)))


def test_parse_wordlist(spark):
    lines = spark.createDataFrame([("q.txt", i, l) for i, l in enumerate(
        ["/.env", "/.git/config", "# note", "", "backup.zip", "/.env"])], "filename string, line_no long, line string")
    got = [r["path"] for r in W.parse_wordlists(lines).orderBy("pos").collect()]
    assert got == ["/.env", "/.git/config", "/backup.zip"]


def test_priority_cap(spark):
    manifest = spark.createDataFrame([("quickhits.txt", 0, True, 3), ("wordpress.txt", 1, False, 2)],
                                     "filename string, file_ord long, always_probe boolean, path_count long")
    parsed = spark.createDataFrame([("quickhits.txt", 0, "/plain"), ("quickhits.txt", 1, "/.env"),
                                    ("quickhits.txt", 2, "/robots.txt"), ("wordpress.txt", 0, "/wp-admin"),
                                    ("wordpress.txt", 1, "/wp-login.php")], "filename string, pos int, path string")
    sets = spark.createDataFrame([(1, "quickhits.txt\nwordpress.txt")], "page_id long, fileset string")
    got = [r["path"] for r in W.rank_paths(sets, manifest, parsed, cap=3).orderBy("rank").collect()]
    assert got == ["/.env", "/robots.txt", "/wp-admin"]     # critical first, framework next, plain dropped


def test_parse_pattern_and_implies(spark):
    assert _one(spark, RB.pattern_regex(F.lit(r"jquery\;version:\1\;confidence:80"))) == "jquery"
    assert _one(spark, RB.pattern_confidence(F.lit(r"jquery\;version:\1\;confidence:80"))) == 0.8
    assert _one(spark, RB.parse_implies(F.lit(r"PHP\;confidence:50"))) == ["PHP"]
    assert _one(spark, RB.slugify(F.lit("SSL/TLS certificate authorities"))) == "ssl-tls-certificate-authorities"


def test_probes_of_one_hot_list_are_dealt_to_many_tasks(spark):
    sites = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("a.txt").alias("fileset"))
    lists = spark.createDataFrame([("a.txt", r, "a.txt", f"/{r}") for r in range(1, 51)], "fileset string, rank int, filename string, path string")
    got = W.listed_paths(sites, written(lists, "lists"), 40_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 50_000 and len(got) > 40_000 * W.MAX_PROBES // W.PROBES_A_TASK // 2
