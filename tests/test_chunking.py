import random
import time

from pyspark.sql import functions as F

from lumenloom.functions import dom, packing
from lumenloom.operators import chunking as ch


def test_paragraphs_pack_and_split():
    assert ch.paragraphs("one two\n\nthree four\n\n\nfive", 4) == ["one two\n\nthree four", "five"]
    assert ch.paragraphs("", 5) == ch.paragraphs(None) == []
    long = " ".join(f"word{i}" for i in range(600))
    parts = ch.paragraphs(long, 100)
    assert len(parts) == 6 and " ".join(parts) == long
    assert ch.paragraphs("Dr. Smith came. He saw e.g. this. Then left.", 3) == ["Dr. Smith came.", "He saw", "e.g. this.", "Then left."]


def test_sentences_then_clauses_then_words():
    assert ch.split_oversized("Aa bb. Cc dd! Ee", 2) == ["Aa bb.", "Cc dd!", "Ee"]
    assert ch.split_oversized("aa bb, cc dd; ee", 2) == ["aa bb,", "cc dd;", "ee"]
    assert ch.split_oversized("aa bb cc dd ee", 2) == ["aa bb", "cc dd", "ee"]
    assert ch.split_oversized("See e.g. this. Next one", 3) == ["See e.g.", "this.", "Next one"]


def test_children_of_small_parents(spark):
    rows = [("p", "u", "t", "text", "a b c\n\nd e f"), ("q", "u", "t", "text", "short")]
    df = spark.createDataFrame(rows, "chunk_id string, page_url string, section_title string, content_type string, text string")
    got = {r.chunk_id: r.text for r in ch.chunk_children(df, 3).collect()}
    assert got == {"p::child:0": "a b c", "p::child:1": "d e f", "q::child:0": "short"}
    assert {r.parent_chunk_id for r in ch.chunk_children(df, 3, keep_single=False).collect()} == {"p"}


WIKI = """<body><nav>menu</nav><p>Intro</p><h1>Top</h1><p>First <a href="/x">link</a></p><h2>Sub</h2><table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>
<pre>code here</pre><h3>Deep</h3><p>deep text</p><h2>Other</h2><div>tail<div><pre>x = 1</pre></div></div><script>no()</script></body>"""


def test_wiki_sections():
    found = ch.wiki_chunks(WIKI, "https://w.org/page", None, 50)
    assert [(c["section_title"], c["text"]) for c in found] == [
        ("(untitled)", "Intro"),
        ("Top", "First link"),
        ("Top > Sub", "| A | B |\n| --- | --- |\n| 1 |  |"),
        ("Top > Sub", "code here"),
        ("Top > Sub > Deep", "deep text"),
        ("Top > Other", "tail\n\nx = 1"),
    ]
    assert found[1]["links"] == ["https://w.org/x"]
    assert ch.wiki_chunks("<p>just text</p>", "u", "T")[0]["plain"]
    assert ch.wiki_chunks("<nav>x</nav>", "u") == ch.wiki_chunks(None, "u") == []


def test_wiki_oversized_code_is_whole():
    big = "<h1>H</h1><p>a</p><pre>" + "w " * 60 + "</pre><p>b</p>"
    found = ch.wiki_chunks(big, "u", "T", 20)
    assert [c["kind"] for c in found] == [None, "code", None] and found[0]["section_title"] == "T > H"


def test_chunk_wiki_rows(spark):
    rows = ch.chunk_wiki(spark.createDataFrame([("u", None, WIKI), ("v", None, None)], "page_url string, title string, html string")).collect()
    assert len(rows) == 6 and len({r.chunk_id for r in rows}) == 6 and all(len(r.chunk_id) == 12 for r in rows)


def test_extract_and_links():
    html = '<html><head><title>T</title><base href="https://b.org/d/"></head><body><nav>n</nav><p>Hello <b>you</b></p><pre><code class="language-py">x=1</code></pre><a href="e?q#f">One &amp; two</a><a href="#x">no</a><a href="mailto:a@b">no</a><a href="e?q">dup</a><a href="https://p.org/">self</a></body></html>'
    title, text = dom.extract(html)
    assert title == "T" and "Hello\nyou" in text and "```py\nx=1\n```" in text and "n\n" not in text.split("Hello")[0].replace("T\n", "")
    assert dom.links(html, "https://p.org/") == [("https://b.org/d/e?q", "One &amp; two")]


def test_images():
    html = '<img src="/a.png" width="200" height="200" alt="A"><nav><img src="n.png"></nav><img src="data:x"><img src="l.svg"><img src="p/pixel.gif"><img src="s.png" width=50 height=50><img data-src="lazy image.jpg" srcset="m.jpg 100w, big.jpg 900w"><div aria-hidden="true"><img src="h.png"></div>'
    found = dom.images(html, "https://x.org/")
    assert [i["src_url"] for i in found] == ["https://x.org/a.png", "https://x.org/big.jpg"]
    assert found[0]["dom_offset"] == 0 and html[found[1]["dom_offset"] :].startswith("<img data-src")


PY = '"""Module doc. More of it."""\nimport os\n\nclass Small:\n    """A class."""\n    x = 1\n\ndef alone(a):\n    """Says. More."""\n    return a\n'


def test_python_chunks():
    found = ch.code_chunks("a/b.py", PY)
    assert [c["metadata"].get("class") or c["metadata"].get("function") or c["metadata"].get("preamble") for c in found] == ["true", "Small", "alone"]
    assert found[2]["text"].startswith("// File: a/b.py\n// Module doc.\n// Signature: def alone(a)\n// Doc: Says.")
    big = "class Big:\n    '''Doc.'''\n" + "".join(f"    def m{i}(self):\n        return '{'x' * 400}'\n" for i in range(6))
    parts = ch.code_chunks("x.py", big)
    assert [c["metadata"]["function"] for c in parts] == [f"m{i}" for i in range(6)] and parts[0]["metadata"]["namespace"] == "Big"
    assert ch.code_chunks("bad.py", "def (")[0]["metadata"] == {"fallback": "true"}


def test_other_languages():
    name = lambda path, source: [c["metadata"].get("function") or c["metadata"].get("class") or "fallback" for c in ch.code_chunks(path, source)]
    assert name("a.go", 'package m\n\ntype T struct {\n A int\n}\n\nfunc (t *T) Run(x int) error {\n s := "}"\n return nil\n}\n') == ["T", "Run"]
    assert name("a.js", "function go(a) { if (a) { return 1 } }\nclass K { m() { return 2 } }\n") == ["go", "K"]
    assert name("A.java", "public class A {\n  int f(int x) { return x; }\n}\n") == ["A"]
    assert name("a.rs", "pub fn add(a: i32) -> i32 { a }\nimpl Foo { fn x() {} }\n") == ["add", "Foo"]
    assert name("a.rb", "class A\n  def x\n    1\n  end\nend\ndef y\n  2\nend\n") == ["A", "y"]
    assert name("a.c", "#include <x.h>\nstatic int add(int a) {\n  return a;\n}\n") == ["add"]
    assert name("a.sh", "go() {\n echo 1\n}\n") == ["go"]
    assert name("a.json", "{}") == ["fallback"]


def test_merge_small():
    c = lambda n, text, **m: {"text": text, "metadata": {"class": n, "namespace": "", **m}}
    out = ch.merge_small([c("A", "a"), c("B", "b"), {"text": "f", "metadata": {"function": "f", "namespace": ""}}, c("C", "c" * 300), c("D", "d" * 300)])
    assert [x["metadata"].get("class") for x in out] == ["A, B", None, "C", "D"] and out[0]["text"] == "a\n\nb"


def test_languages(spark):
    paths = ["x/a.PY", "Dockerfile.dev", "b.unknown", "noext", "c.tsx", "Gemfile"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ch.language_of(F.col("p")).alias("l"))
    assert {r.p: r.l for r in df.collect()} == {p: ch.detect_language(p) for p in paths}
    assert ch.detect_language("x/a.PY") == "python" and ch.detect_language("noext") is None


def test_prefix():
    assert ch.embedding_prefix("python", "A", "run", "def run(): pass") == "python — A.run — run\ndef run(): pass"


def test_tiers_of_text(spark):
    from lumenloom.functions import dom
    from lumenloom.operators.chunking import html_text

    story = "A long paragraph of the article, with commas, that goes on for quite some time."
    page = f"<html><head><title>T</title></head><body><div><p>A menu line that is rather long but <a href=x>only links, links, links and links</a></p></div><div><p>{story}</p><p>{story}</p><pre><code class='language-py'>def f():\n    return 1, 2, 3</code></pre></div></body></html>"
    assert dom.dense_text(page).startswith(story) and "menu" not in dom.dense_text(page) and "```py" in dom.dense_text(page)
    assert dom.tiered(page, [("bad", lambda h: 1 / 0), ("short", lambda h: "x"), ("dense", dom.dense_text)])[2] == "dense"
    assert dom.tiered(" ") == ("", "", "none") and dom.tiered("<p>x</p>", [("dense", dom.dense_text)]) == ("", "x", "strip")
    rows = html_text(spark.createDataFrame([("u", page), ("v", None)], "page_url string, html string"), [("dense", dom.dense_text)]).collect()
    assert [(r.page_url, r.title, r.method) for r in rows] == [("u", "T", "dense"), ("v", "", "none")]


def test_packing_in_the_jvm_equals_the_plain_packer(spark):
    """Random texts with all kinds of borders, small budgets, and Python's packer as the measure."""
    import random

    from lumenloom.functions import packing

    r = random.Random(11)
    pieces = ["word", "a-b", "x1", "12", "e.g.", "i.e.", "end.", "why?", "so,", "then;", "ü", "é.", "a.b.c", " ", "!"]
    borders = [" ", " ", " ", "\n", "\n\n", "\n \t\n", "  ", " ", "\xa0", "　", "\x1f", "\x0b", "\x85"]
    texts = ["", " \n ", None, "no borders at all", "word " * 500, "a, " * 300, "One. " * 300] + ["".join(r.choice(pieces) + r.choice(borders) for _ in range(r.randrange(90))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (1, 3, 10, 200):
        got = {x.i: x.p for x in df.select("i", packing.paragraphs(F.col("t"), limit).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == ch.paragraphs(t, limit), (limit, t)


def test_references_that_were_cut(spark):
    page = "<title>A &amp</title><p>x &amp; y&lt z &ampq; &#38 &#38; &#x26; & &; &nosuch; &copy;</p>"
    assert dom.tiered(page, closed=True) == ("A &amp", "A &amp\nx & y&lt z &ampq; &#38 & & & &; &nosuch; ©", "strip")
    assert dom.tiered("<title>A &amp</title>")[0] == "A &"
    from lumenloom.operators.chunking import html_text

    rows = html_text(spark.createDataFrame([("u", page)], "page_url string, html string"), closed=True).collect()
    assert rows[0].title == "A &amp"


def test_texts_without_letters_are_counted_in_one_go(spark):
    texts = ["12 345. " * 60_000, "漢字。" * 100_000, "a1-b_c 7x é " * 150 + "9" * 300_000]
    began = time.monotonic()
    got = {r.i: r.made for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", packing.paragraphs(F.col("text"), 200).alias("made")).collect()}
    assert time.monotonic() - began < 20  # each place of a text without letters was searched to its end
    for i, text in enumerate(texts):
        assert got[i] == ch.paragraphs(text, 200)


def test_tokens_are_counted_by_sentences_as_in_the_whole(spark):
    r = random.Random(11)
    bits = ["a", "B2", "c-d", "_e", "7f", "-", "9", "é", "x.y", "e.g.", "end.", "so!", "why?", "part,", "then;", "𝒳z", "　", "\n", "\n\n"]
    rows = [(i, r.choice(["", " "]).join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(0, 120)))) for i in range(300)]
    made = spark.createDataFrame(rows, "i int, text string").select("text", *[packing.paragraphs(F.col("text"), n).alias(f"p{n}") for n in (1, 5, 20)])
    for row in made.collect():
        for n in (1, 5, 20):
            assert row[f"p{n}"] == ch.paragraphs(row.text, n)
