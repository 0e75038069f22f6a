"""Hand-written pages and responses with hand-written rows (no regex or constant shared with the library)."""
import html
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions import urls as U
from sitelens.operators import evidence as E
from sitelens.operators import wordlists as W


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://s{i}.example/a/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_comment_mark_inside_a_script_hides_no_tag(spark):
    p = pages(spark, '<script>if(x=="<!--"){}</script><meta name="generator" content="Acme 2"><link rel="manifest" href="/m.json">'
                     '<script src="/a.js"></script><body data-x="1"><a href="/in">i</a><!-- c -->')
    assert rows(E.meta_tags(p), "key", "content") == [("generator", "Acme 2")]
    assert rows(E.script_srcs(p), "src") == [("/a.js",)]
    assert rows(E.manifest_url(p), "manifest_url") == [("/m.json",)]
    assert rows(E.data_attributes(p), "name", "value") == [("data-x", "1")]
    assert rows(E.site_links(p), "link") == [("http://s0.example/in",)]
    assert rows(E.html_comments(p), "comment") == [("c",)]
    assert rows(E.inline_scripts(p), "script") == [('if(x=="<!--"){}',)]


def test_comment_wrapped_script_body_is_kept(spark):
    p = pages(spark, "<script><!-- var a=1; //--></script>", "<!-- <script>no()</script> <meta name=a content=b> --><style>/* <!-- */</style><meta name=c content=d>")
    assert rows(E.inline_scripts(p), "page_id", "script") == [(0, "<!-- var a=1; //-->")]
    assert rows(E.html_comments(p), "page_id", "comment") == [(1, "<script>no()</script> <meta name=a content=b>")]
    assert rows(E.meta_tags(p), "page_id", "key", "content") == [(1, "c", "d")]


def test_long_pages_scripts_and_link_lists_are_whole(spark):
    body = "x" * 250_000
    links = "".join(f'<a href="/p{i}">p</a>' for i in range(30))
    p = E.page_source(pages(spark, f"<script>{body}</script>{links}<meta name=late content=yes>"))
    assert rows(E.meta_tags(p), "key") == [("late",)]
    assert [len(s) for s, in rows(E.inline_scripts(p), "script")] == [250_000]
    assert [r for r, in rows(E.site_links(p), "rank")] == list(range(1, 31))


def test_repeated_headers_of_a_redirect_are_joined_in_order(spark):
    headers = spark.createDataFrame([(1, 0, 0, "Via", "2 z"), (1, 0, 1, "via", "1 a"), (1, 0, 2, "X-Other", "no"), (1, 1, 0, "Via", "final")],
                                    "page_id long, hop int, pos int, name string, value string")
    status = spark.createDataFrame([(1, 0, 301, "u"), (1, 1, 200, "v")], "page_id long, hop int, status int, url string")
    assert [(r.hop, r.headers) for r in E.redirect_hops(headers, status).collect()] == [(0, {"via": "2 z, 1 a"})]


class Parsed(HTMLParser):
    """Start tags with attributes, comments and closed script bodies, as the standard parser sees them."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.tags, self.comments, self.bodies, self.inside = [], [], [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        if tag == "script":
            self.bodies.append("")
            self.inside = True

    def handle_startendtag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside:
            self.bodies[-1] += data

    def handle_comment(self, data):
        self.comments.append(data)


KINDS = ("meta", "script", "link", "a", "body")
ODD_PAGES = [
    "<meta name=generator content=O'Neil><meta name=x content=\"a > b\">", "<script src=a.js>var x=1;<meta name=a content=b>", "<script>a</script ><meta name=q content=w>",
    "<div title='<meta name=n content=o>'><meta name=k content=v>", "<!-- <meta name=a content=b> <meta name=c content=d>", "<script src='x'/><meta name=e content=f><script>if(a<b){}</script>",
    '<meta name="u content="v"><p><meta name=r content=t>', "<META NAME='G' Content='v1' content='v2' /><link rel='x manifest' href=\"\n/m.json\t\">",
    "<body data-a=1 data-B='2 &amp; 3' data-c><meta content=a/b name=c/>", "<!foo bar><!doctype html><!-- x --><!---->z", "<style>/* <meta name=s content=t> */</style><a href='x'>y</a>",
    "</p <meta name=1 content=2>><meta name=3 content=4>", "<meta/name=a/content=b>", "<" * 3000 + "<meta name=a content=b>", "<a " * 3000, "<meta name='it''s' content=&copy;&#x1F600;&notit;>",
    "<meta name=a " + "a " * 100_000 + "content=z><meta name=b content=c>", "<meta name=a content=" + "y" * 1_000_000 + ">", '<meta name="' + "q" * 1_000_000 + "><meta name=b content=c>"]


def random_pages(n):
    rng = random.Random(5)
    bits = ["<meta ", "<script", "</script>", ">", " ", "name=", "content=", '"a b"', "'", "a", "/", "<!--", "-->", "<style>", "</style>", "<link ", "href=x", "src='y'", "<a ", "&amp;", "\n", "<body data-x=", "</a>", "--"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(3, 30))) for _ in range(n)]


def test_tokens_are_those_of_the_standard_parser(spark):
    """Odd and very long markup; group by page: wanted tags with all attributes, comments, bodies of closed scripts."""
    htmls = ODD_PAGES + random_pages(400)
    df = pages(spark, *htmls).repartition(4)
    tag = lambda t: F.struct(H.tag_name(t), F.map_from_entries(F.transform(H.attributes(t), lambda a: F.struct(a["name"], H.unescape(a["value"])))), H.attr(t, "content"))
    got = df.select("page_id", F.transform(H.start_tags("html", KINDS), tag).alias("tags"), H.comments("html").alias("comments"), H.scripts("html").alias("scripts")).collect()
    for r in got:
        want = Parsed(htmls[r.page_id])
        tags = [(t, a) for t, a in want.tags if t in KINDS]
        assert [(t, dict(a), c) for t, a, c in r.tags] == [(t, a, a.get("content")) for t, a in tags], htmls[r.page_id][:200]
        assert list(r.comments) == want.comments
        assert [s.body for s in r.scripts] == want.bodies


def test_white_space_of_every_kind_is_stripped(spark):
    p = pages(spark, "<script src='\n/a.js\t'></script><script>\r\n f() \n</script><!--\n\tc --><link rel=\"\tmanifest\n\" href='\x0c/m '>")
    assert rows(E.script_srcs(p), "src") == [("/a.js",)]
    assert rows(E.inline_scripts(p), "script") == [("f()",)]
    assert rows(E.html_comments(p), "comment") == [("c",)]
    assert rows(E.manifest_url(p), "manifest_url") == [("/m",)]
    lines = spark.createDataFrame([("f.txt", 0, "/admin\t"), ("f.txt", 1, "/\t# note\r"), ("f.txt", 2, "\t# note"), ("f.txt", 3, "x\r"), ("f.txt", 4, "　")], "filename string, line_no long, line string")
    assert rows(W.parse_wordlists(lines), "pos", "path") == [(0, "/admin"), (1, "/\t# note"), (3, "/x")]


def test_links_that_leave_the_scheme_are_no_site_links(spark):
    p = spark.createDataFrame([(1, "http://s.example/d/e/p?q#f", "<a href='mailto:a@s.example'><a href=javascript:f()><a href=tel:1><a href=../x><a href='./y?z#t'><a href='//s.example/../w'><a href=''><a href='\n/n '>"
                                "<a href=http:rel><a href=//other.example/x>")], "page_id long, url string, html string")
    assert sorted(r.link for r in E.site_links(p).collect()) == sorted([
        "http://s.example/d/x", "http://s.example/d/e/y?z", "http://s.example/../w", "http://s.example/d/e/p?q", "http://s.example/n", "http://s.example/d/e/rel"])


REFERENCES = ("g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g "
              "./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http:g mailto:a@b data:x,y HTTP://X/y a//b //h/../x /a//b/ g//").split() + ["", " g ", "a b"]


def test_references_resolve_as_the_rfc_says(spark):
    bases = ["http://a/b/c/d;p?q", "http://h", "https://h/", "http://h/a/b/?x#y", "http://h:8/a//b/c"]
    q = spark.createDataFrame([(b, r) for b in bases for r in REFERENCES], "b string, r string")
    got = {(x.b, x.r): x.u for x in q.select("b", "r", U.resolve_url("b", "r").alias("u")).collect()}
    assert got == {(b, r): urljoin(b, r.strip()) for b in bases for r in REFERENCES}
    rfc = {"g": "http://a/b/c/g", "../g": "http://a/b/g", "../../g": "http://a/g", "../../../g": "http://a/g", "?y": "http://a/b/c/d;p?y", "//g": "http://g", ";x": "http://a/b/c/;x", ".": "http://a/b/c/"}
    assert {r: got[bases[0], r] for r in rfc} == rfc


def test_character_references_decode_as_in_the_standard_table(spark):
    rng = random.Random(2)
    values = ["&lt;a&gt;", "&amp;amp;", "a&b", "&copy", "&notit;", "&notin;", "&#39;", "&#x27;x", "&#128;", "&#129;", "&#0;", "&#xD800;", "&#x110000;", "&#x1F600;", "&#99999999999999;", "&;", "&", "&#x;",
              "&CounterClockwiseContourIntegral;", "&acE;", "&ampx", "&#1;", "&#xfdd0;", "&#xB;", "&#9;", ""]
    values += ["".join(rng.choice(["&", "#", "x", "1", "f", "amp", "lt", ";", "notin", "copy", "é", " ", "39"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", H.unescape(F.col("v")).alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: html.unescape(v) for i, v in enumerate(values)}
