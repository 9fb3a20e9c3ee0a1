import pytest
from pyspark.sql import functions as F

from ragloom import Params
from ragloom.functions.html import html_to_text, is_wall
from ragloom.functions.urls import admission_problem, blocked_site, host
from ragloom.operators.pages import admission_funnel, admit_pages, clean_pages


@pytest.mark.parametrize("html, want", [
    ("<p>a</p><p>b</p>", "a\n b"), ("a<br>b<BR />c", "a\nb\nc"), ("x<script>if (a<b) {}</script>y", "x y"),
    ("x<script>open", "x open"), ("<STYLE>p{}\n</style><!-- a\n> b -->t", "t"), ("&amp;lt;b&amp;gt; &quot;&#39;&apos;&nbsp;.", "<b> \"'' ."),
    ("<noscript>n</noscript>a  \t b", "a b"), ("<li>1</li>\n \n<li>2</li>", "1\n\n 2"), ("1 < 2 > 0", "1 0"), ("&AMP;", "&AMP;"),
])
def test_html_to_text(one, html, want):
    assert one(html_to_text(F.col("h")), h=html) == want


def test_cut(spark):
    pages = spark.createDataFrame([(1, "<p>" + "a" * 30), (2, "b")], "page_id int, html string")
    got = {r["page_id"]: (r["text"], r["cut"]) for r in clean_pages(pages, Params(page_max_chars=12)).collect()}
    assert got == {1: ("a" * 12, True), 2: ("b", False)}


PUBLIC, PRIVATE, BAD, SCHEME = None, "host is not allowed", "not a valid URL", "only http(s) links are supported"


@pytest.mark.parametrize("url, want", [
    ("https://example.com/a?b#c", PUBLIC), ("HTTP://Example.com:8080", PUBLIC), ("http://172.15.0.1", PUBLIC), ("http://11.0.0.1/", PUBLIC),
    ("http://internal.example.com", PUBLIC), ("http://100.com/", PUBLIC),
    ("http://LOCALHOST/", PRIVATE), ("http://0.0.0.0", PRIVATE), ("http://[::1]/", PRIVATE), ("http://x.internal/", PRIVATE),
    ("http://metadata.google.internal", PRIVATE), ("http://127.0.0.1:80/x", PRIVATE), ("http://10.1.2.3", PRIVATE), ("https://192.168.0.1", PRIVATE),
    ("http://169.254.169.254/latest", PRIVATE), ("http://172.16.0.1", PRIVATE), ("http://172.31.9.9", PRIVATE), ("http://user@10.0.0.1/", PRIVATE),
    ("http://2130706433/", PRIVATE), ("http://0x7f.1/", PRIVATE), ("http://127.1/", PRIVATE), ("http://0177.0.0.1/", PRIVATE),
    ("http://256.0.0.1/", BAD), ("http://08.1.1.1/", BAD), ("http://1.2.3.4.5/", BAD), ("http://1.2.3.256", BAD), ("http://4294967296/", BAD),
    ("http://1.65535", PUBLIC), ("http://0x/", PRIVATE), ("http://a.b.9z/", PUBLIC), ("http://a.b.9/", BAD),
    ("no url", BAD), ("", BAD), ("http://", BAD), ("http://a b/", BAD), ("http://x:port/", BAD), (None, BAD),
    ("ftp://example.com", SCHEME), ("mailto:a@b", SCHEME), ("javascript:alert(1)", SCHEME),
])
def test_admission(one, url, want):
    assert one(admission_problem(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.linkedin.com/jobs", "LinkedIn"), ("https://au.seek.com.au/x", "Seek"), ("https://indeed.co.uk", "Indeed"),
    ("https://uk.indeed.com", "Indeed"), ("https://www.Glassdoor.de", "Glassdoor"), ("https://ziprecruiter.com", "ZipRecruiter"),
    ("https://linkedin.com.example.org", None), ("https://example.com/linkedin.com", None)])
def test_blocked_sites(one, url, want):
    assert one(blocked_site(host(F.col("u"))), u=url) == want


@pytest.mark.parametrize("text, want", [
    ("x" * 199, True), ("x" * 200, False), ("x" * 300 + " Access DENIED", True), ("x" * 600 + "captcha", False)])
def test_walls(one, text, want):
    assert one(is_wall(F.col("t")), t=text) is want


def test_first_problem_counts(spark):
    good = "<p>" + "word " * 100 + "</p>"
    rows = [
        (1, "http://10.0.0.1", "", 500, "image/png"), (2, "https://linkedin.com", "", 500, "image/png"), (3, "https://e.com", "", 404, "image/png"),
        (4, "https://e.com", good, 200, "image/png"), (5, "https://e.com", good, 200, None), (6, "https://e.com", "<p>x</p>", 200, "text/html"),
        (7, "https://e.com", good, 204, "application/xhtml+xml; html"), (8, "https://e.com", good, None, "text/html"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, http_status int, content_type string")
    admitted = admit_pages(pages)
    got = {r["page_id"]: r for r in admitted.collect()}
    assert {i: got[i]["reason"] for i in got} == {
        1: PRIVATE, 2: "LinkedIn blocks page reads", 3: "HTTP 404", 4: "not a readable web page", 5: "not a readable web page",
        6: "login or anti-bot page", 7: None, 8: "could not reach that link"}
    assert all((r["reason"] is None) == (r["text"] is not None) for r in got.values())
    assert admit_pages(pages.drop("http_status", "content_type")).filter("page_id = 3").head()["reason"] == "login or anti-bot page"
    assert {r["reason"]: r["pages"] for r in admission_funnel(admitted).collect()}["admitted"] == 1
