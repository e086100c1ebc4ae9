from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import text as tx
from lumenloom.functions import urls
from lumenloom.functions.numbers import rounded


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("TaskStatus", ["taskstatus", "task", "status"]),
        ("max_items-per HTTPServer2", ["max_items-per", "max", "items", "per", "httpserver2", "http", "server", "2"]),
        ("plain Words", ["plain", "words"]),
        ("1abc", ["abc"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert Counter(one(spark, tx.tokenize(F.col("t")), t=text)) == Counter(tokens)


@pytest.mark.parametrize(("word", "forms"), [("queries", ["queries", "query"]), ("classes", ["classes", "class"]), ("terms", ["terms", "term"]), ("gas", ["gas"]), ("lies", ["lies", "li"]), ("node", ["node"])])
def test_stems(spark, word, forms):
    assert one(spark, tx.stems(F.col("w")), w=word) == forms


@pytest.mark.parametrize(
    ("query", "kind"),
    [("", "simple"), ("what is a token", "simple"), ("redis versus kafka", "complex"), ("cats and dogs", "moderate"), ("how does the very long scheduler queue work today", "moderate"), ("how does it work, and what are the limits", "complex"), (" ".join(["w"] * 15), "complex")],
)
def test_complexity(spark, query, kind):
    assert one(spark, tx.complexity(F.col("q")), q=query) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Just prose, nothing else.", "text"), ("a\n```\nx = 1\ny = 2\nz = 3\n```", "code"), ("def f(x): return (x);\nclass A: import y\nfor (;;) {}", "code"), ('{"a": [1, 2], "b": {"c": [3]}}', "text"), ("", "text"), ("import x\n    return x\n    return y\n    return z", "code")],
)
def test_content_type(spark, text, kind):
    assert one(spark, tx.content_type(F.col("t")), t=text) == kind


def test_identifiers(spark):
    source = "class Foo(Bar):\n  def run_it(self): pass\ntype Node struct {\n  Name string\n}\nfunc (n *Node) Walk() {}\npublic List<int> Items {"
    assert set(one(spark, tx.code_identifiers(F.col("t")), t=source)) == {"Foo", "run_it", "Node", "Walk", "Items", "Name"}


def test_key_terms(spark):
    assert one(spark, tx.key_terms(F.col("q")), q="What does KeyPrefix do with max_items in the Scheduler scheduler?") == "KeyPrefix max_items Scheduler"


@pytest.mark.parametrize(
    ("passage", "chunk", "hit"),
    [("abc", "abc abc", False), ("cats", "two cats.", True), ("cats", "concats", False), ("(a+b)", "x (a+b) y", True), ("a long passage of text here", "xa long passage of text herex", True), ("abcd", "abcdx abcd", True)],
)
def test_overlap(spark, passage, chunk, hit):
    assert one(spark, tx.overlaps(F.col("p"), F.col("c")), p=passage, c=chunk) is hit


def test_json_lists(spark):
    get = lambda t: one(spark, tx.json_list_of_strings(F.col("t")), t=t)
    assert get('```json\n["a", "b"]\n```') == ["a", "b"]
    assert get("none") == []
    assert get('["first query", "second query", oops]') == ["first query", "second query"]


def test_media_type(spark):
    assert one(spark, tx.media_type(F.unhex(F.lit("89504E470D0A1A0A0000")))) == "image/png"
    assert one(spark, tx.media_type(F.unhex(F.lit("FFD8FFE0")))) == "image/jpeg"
    assert one(spark, tx.media_type(F.unhex(F.lit("52494646000000005745425056")))) == "image/webp"


URLS = ["HTTP://Ex.com/a/?b=2&a=1#x", "https://ex.com/", "https://ex.com", "http://ex.com/a/b//?z=", "https://ex.com/p?b=1&b=2&a=3"]


@pytest.mark.parametrize("url", URLS)
def test_canonical_native_equals_plain(spark, url):
    assert one(spark, urls.canonical(F.col("u")), u=url) == urls.canonical_text(url)


def test_canonical_values():
    assert urls.canonical_text("HTTPS://Wiki.COM/A%20b/?q=1#f") == "https://wiki.com/A%20b?q=1"


def test_url_classes(spark):
    kind = lambda u: one(spark, urls.classify(F.col("u"), "Wiki.com"), u=u)
    assert [kind(u) for u in ("https://WIKI.com/x", "https://github.com/a/b", "https://github.com/a", "https://x.org")] == ["same-domain", "repo", "external", "external"]
    assert one(spark, urls.repository_prefix(F.col("u")), u="https://GitHub.com/a/b/tree") == "github.com/a/b/"
    assert one(spark, urls.repository_parts(F.col("u")), u="https://github.com/a/b.git").asDict() == {"platform": "github.com", "owner": "a", "name": "b"}
    assert one(spark, urls.workspace(F.col("u")), u="https://bitbucket.org/team/workspace/overview/") == "team"
    assert one(spark, urls.confluence_space(F.col("u")), u="https://a.atlassian.net/wiki/spaces/ENG/x") == "ENG"


def test_safety():
    names = {"ok.com": ["93.184.216.34"], "mixed.com": ["93.184.216.34", "10.0.0.1"], "six.com": ["2606:4700::1"]}
    resolver = lambda h: names.get(h) or [h]
    assert urls.is_safe("https://ok.com/x", resolver)
    for bad in ("ftp://ok.com", "https://mixed.com", "http://127.0.0.1", "http://[::1]/", "http://169.254.1.1", "http://192.168.0.1", "https:///x"):
        assert not urls.is_safe(bad, resolver), bad
    assert urls.pinned("https://ok.com:8443/x?y", resolver) == "https://93.184.216.34:8443/x?y"
    assert urls.pinned("http://six.com/", resolver) == "http://[2606:4700::1]/"


def test_widest_source(spark):
    assert one(spark, urls.widest_source(F.col("s")), s="a.jpg 320w, b.jpg 1024w, c.jpg 640w") == "b.jpg"
    assert one(spark, urls.widest_source(F.col("s")), s="a.jpg 1x, b.jpg 2x") == "b.jpg"


@pytest.mark.parametrize(("value", "shown"), [(-1e-7, "-0.0"), (1e-7, "0.0"), (-0.0, "-0.0"), (0.1234565, "0.123457"), (-2.5e-6, "-3e-06"), (float("nan"), "nan"), (float("-inf"), "-inf"), (3.0, "3.0")])
def test_rounded_as_in_sql(spark, value, shown):
    assert repr(one(spark, rounded(F.col("v"), 6), v=value)) == shown
