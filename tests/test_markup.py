import html
import random
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from kgspark.functions import markup as M
from kgspark.operators import pages as P


def column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"k long, x {kind}")


def decoded(spark, values, **more):
    return [r.x for r in column(spark, values).select("k", M.unescape(F.col("x"), **more).alias("x")).orderBy("k").collect()]


def test_every_reference_by_name(spark):
    given = [f"a &{name} b &{name}" for name in html5]
    assert decoded(spark, given) == [html.unescape(x).replace("\xa0", " ") for x in given]


def test_references_of_any_kind(spark):
    random.seed(5)
    parts = ["&amp;", "&amp", "lt;", "&#65;", "&#x41;", "&#X41", "&#0;", "&#128;", "&#x9f;", "&#129;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x1F600;", "&#000000000000065;", "&#;", "&#x;", "&", "&&", "&notit;", "&notin;", "&nosuch;", "&nbsp;", "&#160;", " ", "x", "=", ";", "é", "\n"]
    given = ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(500)] + parts
    want = [html.unescape(x).replace("\xa0", " ") for x in given]
    assert decoded(spark, given) == want
    assert decoded(spark, [None, ""]) == [None, ""]


def test_references_in_attributes(spark):
    given = ["?a=1&copy=2", "?a&copy", "?a&copy;b", "?a&copyx;", "&lt1", "&amp;copy=3", "&lt-"]
    assert decoded(spark, given, in_attribute=True) == ["?a=1&copy=2", "?a©", "?a©b", "?a&copyx;", "&lt1", "&copy=3", "<-"]


class Plain(HTMLParser):
    """Tags with their attributes, and texts, read one after another."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.raw = [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw = tag
        else:
            self.found.append(("open", tag, dict(reversed(attrs)).get("title") or ""))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        else:
            self.found.append(("close", tag, ""))

    def handle_decl(self, decl):
        self.found.append(("text", "", ""))

    def handle_data(self, data):
        if self.raw is None:
            if self.found and self.found[-1][0] == "text" and self.found[-1][1]:
                data = self.found.pop()[1] + data
            self.found.append(("text", data, ""))


def tokens(spark, pages):
    rows = P.tokens(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    value = M.unescape(M.attribute(F.col("attrs"), "title"), in_attribute=True)
    got = [[] for _ in pages]
    for r in rows.select("page_id", "pos", "kind", F.when(F.col("kind") == "text", F.col("text")).otherwise(F.col("tag")).alias("x"), value.alias("title")).orderBy("page_id", "pos").collect():
        got[r.page_id].append((r.kind, r.x, r.title))
    return got


def test_tokens_agree_with_a_plain_reader(spark):
    random.seed(6)
    parts = ['<a title="x > y">', "<a title='<p>'>", "<A TITLE=b>", "<b title = \"it's\" title=z>", '<i data-title="no" title="&lt;&amp;">', "<p\nclass='title=\"q\"'>", "<br/>", "</p>", "</a >", "text ", "a < b", "&lt;p&gt;", "<!-- <p title='x'> -->", "<!doctype html>", "<script>var x = '<!--<p>';</script>", '<style title=">">p > a {}</STYLE >', "é>", "<my-tag title=''>"]
    pages = ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(400)]
    want = []
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        want.append([(kind, x, title) for kind, x, title in plain.found])
    assert tokens(spark, pages) == want


def test_what_is_never_closed(spark):
    pages = ["a<!-- b <p>", "a<script>b</p>", 'a<p title="b>c', "a<p", "a</", "a<", "", "a<!-->b<!--->c<!-- --!>d"]
    assert [[(k, x) for k, x, _ in page] for page in tokens(spark, pages)] == [[("text", "a")], [("text", "a")], [("text", "a"), ("open", "p"), ("text", "c")], [("text", "a")], [("text", "a")], [("text", "a<")], [], [("text", "abcd")]]


def test_titles(spark):
    pages = ["<!-- <title>no</title> --><script>'<title>no</title>'</script><title lang='>'>a <b> &eacute;</title><title>c</title>", "<meta content='<title>no</title>'><TITLE>yes</TITLE>", "<titles>x</titles>", "<title>open", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert [r.title for r in P.page_titles(rows).orderBy("page_id").collect()] == ["a <b> é", "yes", "Untitled", "open", "Untitled"]


def test_very_long_pages(spark):
    long = "x" * 3_000_000
    pages = [f"<p title='{long}'>{long}</p>", "<i>a</i> &amp; < " * 100_000, "<" * 300_000, "=" * 10 + "<a " + "b='c' " * 300_000 + ">", f"<!--{long}-->", f"<script>{long}", "'\"" * 300_000]
    rows = P.tokens(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    assert {r.page_id: (r.n, r.chars) for r in rows.collect()} == {0: (3, 3_000_000), 1: (400_000, 100_000 * 6), 2: (1, 300_000), 3: (2, 10), 6: (1, 600_000)}
