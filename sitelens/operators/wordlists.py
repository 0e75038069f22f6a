"""Wordlists (S13, W1-W14): parse, manifest, per-site selection, priority cap,
and classification of observed path responses.

Per-site work is bounded before it fans out: paths get their priority tier
first, and a path beyond position ``MAX_PROBES`` of its tier in its own
(deduplicated) file can never reach a site's top ``MAX_PROBES``; so each
(file, tier) is cut once, exactly, independent of the site count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.functions.staging import computed
from sitelens.functions.text import strip

MAX_PROBES = 500
PROBES_A_TASK = 250_000
SOFT404_MAX_BODY = 10_240
# File names always probed when no technology matches.
ALWAYS_PROBE_FILES = [
    "api-endpoints.txt", "swagger.txt", "graphql.txt", "api-seen-in-the-wild.txt", "api-seen-in-wild.txt",
    "objects.txt", "actions.txt", "quickhits.txt", "versioning_metafiles.txt",
]
# Words that never identify a technology in a file name.
GENERIC_WORDS = [
    "api", "endpoints", "seen", "in", "wild", "the", "fuzz", "common", "objects", "actions", "directories", "files",
    "lowercase", "medium", "small", "large", "big", "raft", "list", "words", "quickhits", "versioning",
    "metafiles", "backups", "default", "web", "root", "linux", "windows", "unix", "dotfiles", "logins",
    "passwords", "functions", "scopes", "auth", "oauth", "oidc", "top", "million", "bug", "bounty", "program",
    "inventory", "trickest", "subdomains", "dns", "top1million", "plugins", "themes",
]
# Status -> (label, confidence).
STATUS_MAP = [(200, "exposed", 0.95), (401, "auth-required", 0.85), (403, "forbidden", 0.80),
              (301, "redirect", 0.70), (302, "redirect", 0.70)]
# Wordlists without framework context.
GENERIC_WORDLISTS = ["actions.txt", "objects.txt", "api-endpoints.txt", "quickhits.txt",
                     "versioning_metafiles.txt", "api-seen-in-wild.txt", "api-seen-in-the-wild.txt"]
# Content types accepted for a 200 from a generic wordlist.
STRUCTURED_TYPES = ["application/json", "application/yaml", "application/xml", "application/vnd.", "text/plain",
                    "text/yaml", "text/xml", "text/csv"]
# Redirect targets that mean "navigation", not an endpoint.
NAV_SUFFIXES = ["/login", "/settings", "/session", "/signin", "/auth", "/logon"]
# Always-probe files whose every path is critical.
CRITICAL_FILES = ["swagger.txt", "graphql.txt", "versioning_metafiles.txt"]
# Critical paths, compared lower-cased without a trailing slash.
CRITICAL_PATHS = [
    "/.env", "/.git/config", "/.git/head", "/.git/index", "/.htaccess", "/.htpasswd", "/.ftpquota", "/.npmrc",
    "/.ssh/id_rsa", "/.ssh/id_dsa", "/.ssh/id_ed25519", "/.svn/entries", "/.user.ini", "/composer.json",
    "/composer.lock", "/package.json", "/package-lock.json", "/web.config", "/wp-config.php", "/config.php",
    "/configuration.php", "/settings.py", "/robots.txt", "/sitemap.xml", "/.well-known/security.txt",
    "/swagger.json", "/openapi.json", "/api-docs", "/graphql",
]


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# S13, W13, W1-W3
# ---------------------------------------------------------------------------
def parse_wordlists(lines: DataFrame) -> DataFrame:
    """(filename, line_no, line) -> (filename, pos, path): stripped, no blanks or '#',
    leading '/' forced, first occurrence kept.  ``pos`` is the line number of that first
    occurrence: it orders the file without a per-file window (one file may be huge)."""
    p = strip("line")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    kept = lines.filter((strip("line") != "") & ~strip("line").startswith("#")).select("filename", "line_no", p.alias("path"))
    return kept.groupBy("filename", "path").agg(F.min("line_no").alias("pos")).select("filename", "pos", "path")


def path_tiers(parsed: DataFrame, manifest: DataFrame, cap: int) -> DataFrame:
    """(filename, path, pos, tier, file_ord, path_count): W5 tiers -- 0 critical paths of always-probe files, 1 framework
    files, 2 other always-probe paths -- and of each (file, tier) the first ``cap`` paths (row_number <= cap: a
    group-limited top-k, trimmed map-side before the shuffle)."""
    crit = F.col("filename").isin(CRITICAL_FILES) | F.lower(F.regexp_replace("path", "/+$", "")).isin(CRITICAL_PATHS)
    tier = F.when(F.col("always_probe") & crit, 0).when(~F.col("always_probe"), 1).otherwise(2)
    t = parsed.join(manifest.select("filename", "file_ord", "always_probe", "path_count"), "filename").withColumn("tier", tier)
    w = Window.partitionBy("filename", "tier").orderBy("pos")
    return t.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn", "always_probe")


def listing_files(listing: DataFrame) -> DataFrame:
    """Files of the three listings: type 'file', '.txt', with a download URL; per name the last
    entry wins, the position of its first appearance is kept (manifest order)."""
    f = listing.filter((F.col("type") == "file") & F.col("name").endswith(".txt") &
                       (F.coalesce("download_url", F.lit("")) != ""))
    o = F.struct("listing_ord", "item_pos")
    return f.groupBy("name").agg(F.min(o).alias("first"), F.max_by("download_url", o).alias("download_url")) \
        .select(F.col("name").alias("filename"), (F.col("first.listing_ord") * 100000 + F.col("first.item_pos"))
                .alias("file_ord"), "download_url")


def normalize_filename(name) -> Column:
    """Lower, drop '.txt', wp -> wordpress, '-' / '_' -> ' ', ' js' -> '.js'."""
    s = F.lower(_c(name))
    s = F.when(s.endswith(".txt"), s.substr(F.lit(1), F.length(s) - 4)).otherwise(s)
    wp = s.startswith("wp-") | (s == "wp")
    s = F.when(wp, F.replace(F.replace(s, F.lit("wp-"), F.lit("wordpress-")), F.lit("wp"), F.lit("wordpress"))) \
        .otherwise(s)
    s = F.replace(F.replace(s, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    return F.replace(s, F.lit(" js"), F.lit(".js"))


def word_set(text, drop_generic: bool) -> Column:
    w = F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"\b\w+\b"), 0))
    return F.array_except(w, _arr(GENERIC_WORDS)) if drop_generic else w


def subset_either(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def wordlist_manifest(files: DataFrame, rules: DataFrame, parsed: DataFrame) -> DataFrame:
    """(filename, file_ord, normalized, tech_match sorted, always_probe, path_count).

    The file x technology test is an equi-join on shared words (no cross join): two
    non-empty word sets where one contains the other always share a word.
    """
    f = files.withColumn("normalized", normalize_filename("filename")).withColumn("fw", word_set("normalized", True))
    t = rules.select("tech_key").withColumn("tw", word_set("tech_key", True))
    fx = f.select("filename", "fw", F.explode("fw").alias("word"))
    tx = t.select("tech_key", "tw", F.explode("tw").alias("word"))
    pairs = fx.join(tx, "word").select("filename", "fw", "tech_key", "tw").distinct()
    pairs = pairs.filter(subset_either(F.col("fw"), F.col("tw")))
    tm = pairs.groupBy("filename").agg(F.array_sort(F.collect_set("tech_key")).alias("tech_match"))
    m = f.join(tm, "filename", "left").withColumn("tech_match", F.coalesce("tech_match", F.array().cast("array<string>")))
    m = m.withColumn("always_probe", (F.size("tech_match") == 0) & F.col("filename").isin(ALWAYS_PROBE_FILES))
    counts = parsed.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    m = m.join(counts, "filename", "left")
    downloaded = (F.size("tech_match") > 0) | F.col("always_probe")
    return m.select("filename", "file_ord", "normalized", "tech_match", "always_probe",
                    F.when(downloaded, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("path_count"))


# ---------------------------------------------------------------------------
# Selection and priority per site
# ---------------------------------------------------------------------------
def select_wordlists(detected: DataFrame, manifest: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, fileset) -- per site, the sorted, newline-joined set of selected files:
    every always-probe file, plus files whose keyword words and a detected technology name's
    words are in a subset relation (no generic-word removal; an empty name word set is a
    subset of every keyword).  The always-probe list is the same for every site: it is one row,
    an array, added to each site -- no sites x files product is built."""
    names = detected.select("page_id", F.lower("name").alias("det")).distinct() \
        .withColumn("dw", word_set("det", False))
    kws = manifest.select("filename", F.explode("tech_match").alias("kw")).withColumn("kw_w", word_set("kw", False)) \
        .filter(F.size("kw_w") > 0)
    nx = names.select("page_id", "dw", F.explode_outer("dw").alias("word"))
    kx = kws.select("filename", "kw_w", F.explode("kw_w").alias("word"))
    matched = nx.filter(F.col("word").isNotNull()).join(kx, "word") \
        .filter(subset_either(F.col("kw_w"), F.col("dw"))).select("page_id", "filename")
    empty = nx.filter(F.col("word").isNull()).select("page_id").distinct().withColumn("_empty", F.lit(True))
    names_of = lambda df, c: df.agg(F.array_sort(F.collect_set("filename")).alias(c))  # noqa: E731  one row, also of nothing
    lists = names_of(manifest.filter("always_probe"), "always").crossJoin(names_of(kws, "kw_files"))
    per_site = matched.groupBy("page_id").agg(F.collect_set("filename").alias("m"))
    s = sites.select("page_id").distinct().join(per_site, "page_id", "left").join(empty, "page_id", "left")
    s = s.crossJoin(lists)
    nothing = F.array().cast("array<string>")
    files = F.concat(F.coalesce("m", nothing), "always", F.when(F.col("_empty"), F.col("kw_files")).otherwise(nothing))
    return s.select("page_id", F.array_join(F.array_sort(F.array_distinct(files)), "\n").alias("fileset")) \
        .filter(F.col("fileset") != "")


def ranked_lists(sets: DataFrame, manifest: DataFrame, parsed: DataFrame, cap: int = MAX_PROBES) -> DataFrame:
    """(fileset, rank, filename, path) -- critical always-probe entries, then framework files by
    path_count ascending, then the other always-probe entries; first occurrence of a path kept; top ``cap``.

    ``sets``: (page_id, fileset) from ``select_wordlists``.  The ranked list depends only on the
    set of selected files, so it is computed once per distinct file set (sites sharing a
    technology stack share it).
    """
    fs = sets.select("fileset").distinct()
    fs_files = fs.select("fileset", F.explode(F.split("fileset", "\n")).alias("filename"))
    c = fs_files.join(path_tiers(parsed, manifest, cap), "filename")
    c = c.withColumn("key", F.struct("tier", F.when(F.col("tier") == 1, F.col("path_count")).otherwise(F.lit(0)).alias("pc"),
                                     F.col("file_ord"), F.col("pos")))
    first = c.groupBy("fileset", "path").agg(F.min(F.struct("key", "filename")).alias("k"))
    w = Window.partitionBy("fileset").orderBy("k.key")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap) \
        .select("fileset", "rank", F.col("k.filename").alias("filename"), "path")


def rank_paths(sets: DataFrame, manifest: DataFrame, parsed: DataFrame, cap: int = MAX_PROBES) -> DataFrame:
    """(page_id, rank, filename, path) of each site: ``ranked_lists`` joined back to the sites."""
    return sets.join(ranked_lists(sets, manifest, parsed, cap), "fileset").select("page_id", "rank", "filename", "path")


def listed_paths(sites: DataFrame, lists: DataFrame, n_sites: int, cap: int = MAX_PROBES) -> DataFrame:
    """Each row of ``sites`` (fileset, ...) with the paths of its list: up to ``cap`` rows a site.

    Most sites share a few lists, so a shuffle by list would put all probes in a few tasks: the sites are dealt
    by page to as many tasks as their probes need, before the lists come to them.
    """
    tasks = max(sites.sparkSession.sparkContext.defaultParallelism, -(-n_sites * cap // PROBES_A_TASK))
    return sites.repartition(tasks, "page_id").join(lists, "fileset").drop("fileset")


# ---------------------------------------------------------------------------
# Classify observed responses
# ---------------------------------------------------------------------------
def _status_ok(s: Column) -> Column:
    return s.isin([x[0] for x in STATUS_MAP])


def _label(s: Column) -> Column:
    e = None
    for code, lab, _ in STATUS_MAP:
        e = F.when(s == code, F.lit(lab)) if e is None else e.when(s == code, F.lit(lab))
    return e


def _conf(s: Column) -> Column:
    e = None
    for code, _, conf in STATUS_MAP:
        e = F.when(s == code, F.lit(conf)) if e is None else e.when(s == code, F.lit(conf))
    return e


def _loc_path(resolved: Column) -> Column:
    p = F.lower(F.regexp_replace(U.url_path(resolved), "/+$", ""))
    return p


def path_parts(paths: DataFrame) -> DataFrame:
    """The pieces of a listed path that W6-W12 ask for; of a list, they are found once, not once a site."""
    no_query = F.regexp_extract("path", r"^([^?#]*)", 1)
    last_seg = F.element_at(F.split(F.col("p_noqs"), "/"), -1)
    probed = F.lower(F.regexp_replace("path", "/+$", ""))
    r = computed(paths, p_noqs=no_query, probed=probed, generic=F.exists(_arr(GENERIC_WORDLISTS), lambda g: F.col("filename").endswith(g)))
    return computed(r, url_lp=_loc_path(F.col("p_noqs")), has_ext=F.when(F.contains(F.col("p_noqs"), F.lit("/")), F.contains(last_seg, F.lit(".")))
                    .otherwise(F.contains(F.col("p_noqs"), F.lit("."))),
                    pseg=F.split(F.regexp_replace(F.regexp_replace("probed", "^/+", ""), "/+$", ""), "/"))


def classify_responses(resp: DataFrame) -> DataFrame:
    """W6-W12 in the W14 order.

    resp: (page_id, site_url, base_url, filename, path, status, content_type, location, body,
           next_status, next_content_type, next_body, baseline)
    Every URL piece is computed once (``computed``) before the filters that use it.
    """
    if "p_noqs" not in resp.columns:
        resp = path_parts(resp)
    r = resp.withColumn("url", F.concat(F.col("base_url"), F.col("path"))).filter(_status_ok(F.col("status")))  # W6
    # base_url is the site origin (scheme://netloc), so the request URL's pieces are plain string ops;
    # the Location header is parsed only on redirect rows
    loc0 = F.coalesce("location", F.lit(""))
    redirect0 = F.col("status").isin(301, 302) & (loc0 != "")
    r = computed(r, url_net=F.lower(F.split_part(F.col("base_url"), F.lit("://"), F.lit(2))),
                 res=F.when(redirect0, U.resolve_url(F.col("url"), loc0)))
    r = computed(r, res_net=F.when(redirect0, U.url_netloc("res")), res_lp=F.when(redirect0, _loc_path(F.col("res"))))
    hop = redirect0 & ((F.col("res_net") == F.col("url_net")) | (F.col("res_net") == "")) & \
        (F.col("res_lp") == F.col("url_lp"))
    r = r.withColumn("_hop", hop)
    for c, n in (("status", "next_status"), ("content_type", "next_content_type"), ("body", "next_body"),
                 ("location", "next_location")):
        r = r.withColumn(c, F.when(F.col("_hop"), F.col(n)).otherwise(F.col(c)))
    r = r.filter(_status_ok(F.col("status")))                                                 # W6 again
    ct = F.lower(strip(F.coalesce("content_type", F.lit(""))))
    body = F.coalesce("body", F.lit(""))
    r = computed(r, ct=ct, b=body)
    # W8 soft-404 for 200
    ct, body = F.col("ct"), F.col("b")
    structured = F.exists(_arr(STRUCTURED_TYPES), lambda t: ct.startswith(t))
    htmlish = ct.startswith("text/html") | ((ct == "") & F.contains(F.lower(F.substring(body, 1, 200)), F.lit("html")))
    keep200 = F.when(F.col("generic"), structured) \
        .when(htmlish, F.try_parse_json(body).isNotNull() | (F.col("has_ext") & (F.length(body) <= SOFT404_MAX_BODY))).otherwise(F.lit(True))
    r = r.filter((F.col("status") != 200) | keep200)
    # W10 canonical redirect, W11 nav / cross-domain redirect
    loc = F.coalesce("location", F.lit(""))
    isredir = F.col("status").isin(301, 302) & (loc != "")
    r = computed(r, isredir=isredir,
                 # only a second hop has a Location that is not resolved yet
                 lp0=F.when(isredir, F.when(F.col("_hop"), _loc_path(U.resolve_url(F.col("url"), loc))).otherwise(F.col("res_lp"))),
                 raw_lp=F.when(isredir, F.lower(F.regexp_replace(U.url_path(loc), "/+$", ""))),
                 loc_host=F.when(isredir, U.host_of(U.url_netloc(loc))),
                 base_host=U.host_of(F.col("url_net")))
    lp = F.when(F.col("lp0") == "", F.lit("/")).otherwise(F.col("lp0"))
    probed = F.col("probed")
    lseg = F.split(F.regexp_replace(F.regexp_replace(lp, "^/+", ""), "/+$", ""), "/")
    r = computed(r, lp=lp, lseg=lseg)
    lp, pseg, lseg = F.col("lp"), F.col("pseg"), F.col("lseg")
    single_bad = (lp != probed) & ~lp.startswith(F.concat(probed, F.lit("/")))
    parent = F.slice(pseg, 1, F.size(pseg) - 1)
    multi_bad = parent != F.slice(lseg, 1, F.size(pseg) - 1)
    rule2 = F.col("generic") & (probed != "") & F.when(F.size(pseg) <= 1, single_bad).otherwise(multi_bad)
    canonical = (F.col("baseline").isNotNull() & (lp == F.col("baseline"))) | rule2
    nav = F.exists(_arr(NAV_SUFFIXES), lambda s: F.col("raw_lp").endswith(s))
    cross = (F.col("loc_host") != "") & \
        (U.apex_domain(F.col("loc_host"), "last2") != U.apex_domain(F.col("base_host"), "last2"))
    r = r.filter(~(F.col("isredir") & (canonical | nav | cross)))
    keys_ok = F.contains(ct, F.lit("application/json")) | ((F.col("status") == 200) & ct.startswith("text/html"))
    return r.select(
        "page_id", "url", F.col("status").alias("status_code"), _label(F.col("status")).alias("status_label"),
        F.nullif("content_type", F.lit("")).alias("content_type"), _conf(F.col("status")).alias("confidence"),
        F.col("filename").alias("source_wordlist"),
        F.when(keys_ok, F.json_object_keys(body)).alias("top_level_keys"),
        F.when(F.col("isredir"), F.col("location")).alias("redirect_location"), "path", "rank")


def canary_baseline(canary: DataFrame) -> DataFrame:
    """Per site, the lower-cased path (no trailing '/') of the canary's redirect target, '/' if empty."""
    c = canary.filter(F.col("status").isin(301, 302) & (F.coalesce("location", F.lit("")) != ""))
    p = _loc_path(U.resolve_url(F.col("canary_url"), F.col("location")))
    return c.select("page_id", F.when(p == "", F.lit("/")).otherwise(p).alias("baseline"))
