"""Scalar expressions against given results."""

import math
import posixpath
from urllib.parse import parse_qs, urldefrag, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from kgspark.functions import json_text as J
from kgspark.functions import text as T
from kgspark.functions import urls as U
from kgspark.functions import vectors as V
from kgspark.functions import vocabulary


def run(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_name_keys(spark):
    given = {"Models": "model", "processes": "process", "Over-fitting": "over fitting", "bias": "bia", "techniques": "techniqu", "  L2  (Norm)! ": "l2 norm", "": "", "yes": "yes", "gas": "gas", "Études": "étud"}
    assert run(spark, T.name_key, list(given)) == list(given.values())


def test_token_estimate(spark):
    assert run(spark, T.token_estimate, ["a b c d e f g h i j", "", None, " one two\n"]) == [13, 0, 0, 2]


def test_sentences(spark):
    assert run(spark, T.sentences, ["One. Two!  Three? four", "", " . ", "v1.2 is out.Now"]) == [["One.", "Two!", "Three?", "four"], [], ["."], ["v1.2 is out.Now"]]


def test_generic_names(spark):
    names = ["Model", " data ", "ai", "Overfitting", "Gradient Descent", "learning"]
    assert run(spark, T.is_generic, names) == [True, True, True, False, False, True]


def test_block_types(spark):
    texts = [("x", "code"), ("x", "list"), ("X is defined as y, for example", "paragraph"), ("Such as this", "paragraph"), ("Plain", "paragraph"), ("LET'S SAY so", "paragraph")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, k string")
    got = [r.y for r in rows.select("i", T.block_type(F.col("t"), F.col("k")).alias("y")).orderBy("i").collect()]
    assert got == ["code", "list", "definition", "example", "explanation", "example"]


def test_error_pages(spark):
    rows = spark.createDataFrame([("404", ""), ("ok", "please verify you are HUMAN"), ("ok", "x" * 2000 + "captcha"), (None, None)], "t string, c string")
    assert [r.y for r in rows.select(T.is_error_page(F.col("t"), F.col("c")).alias("y")).collect()] == [True, True, False, False]


BASE = "http://a.com/b/c/d?q"
REFERENCES = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://x.org/a/../b"]


def test_resolution(spark):
    want = [urldefrag(urljoin(BASE, r)).url for r in REFERENCES]
    assert run(spark, lambda x: U.normalize(x, F.lit(BASE)), REFERENCES) == want


def strip(url):
    p = urlparse(url)
    if not p.query:
        return url
    kept = {k: v for k, v in parse_qs(p.query).items() if k not in vocabulary.TRACKING_PARAMETERS}
    return urlunparse((p.scheme, p.netloc, p.path, p.params, urlencode(kept, doseq=True), ""))


def test_tracking(spark):
    urls = ["http://a.b/c?utm_source=a&q=1&ref=x#f", "http://a.b/c#f", "http://a.b/c?q=&r=2", "http://a.b?x=1&y=2&x=3", "http://a.b/?source=z", "http://a.b/?q=a+b%20c%26", "http://u@h:8/p?gclid=1&z=é"]
    assert run(spark, U.strip_tracking, urls) == [strip(u) for u in urls]


def test_domains(spark):
    urls = ["http://U@Ex.org:80/a", "//x/y", "mailto:a", "ftp://h", "", "http://"]
    assert run(spark, U.domain, urls) == [urlparse(u).netloc for u in urls]
    assert run(spark, U.is_valid, urls) == [bool(urlparse(u).scheme and urlparse(u).netloc) for u in urls]


def test_sanitize(spark):
    given = {" <http://a.b> ": "http://a.b", '"http://a.b"': "http://a.b", "http://a.b),": "http://a.b", "http://a.b/(x)": "http://a.b/(x)", "http://a.b]]": "http://a.b", "'": ""}
    assert run(spark, U.sanitize, list(given)) == list(given.values())


def test_json_in_text(spark):
    given = {'{"a":1}': '{"a":1}', '```json\n{"a":1}\n```': '{"a":1}', 'x {"a":{"b":2}} y': '{"a":{"b":2}}', "[1]": "[1]", "none": "none"}
    assert run(spark, J.json_of, list(given)) == list(given.values())
    replies = {'{"a":1}': '{"a":1}', 'so {"a":1} ok': '{"a":1}', "no": None, "{broken": None, "[1]": "[1]"}
    assert run(spark, J.reply_json_of, list(replies)) == list(replies.values())


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.y for r in rows.select(V.cosine(F.col("a"), F.col("b")).alias("y")).collect()] == pytest.approx([math.sqrt(0.5), 0, 0, 0])


def test_dot_segments(spark):
    paths = ["/a/b/../c", "/../a", "/a/./b/", "/a/.."]
    assert run(spark, U.without_dots, paths) == [posixpath.normpath(p) + ("/" if p.endswith(("/", "..")) and posixpath.normpath(p) != "/" else "") for p in paths]
