from collections import defaultdict

from lumenloom.llm.html_extract import Extraction, extract, host_column, main_text, roles_of, template_places, templates, tokens

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>'
    "<article><h1>Head &amp; line</h1><p><b>Bold<br>part<p>Second \n\n one&nbsp;x.</p><div>In <i>div</i></div><form>mail me</form><section class=comments><p>first!</p></section></article>"
    '<aside>side</aside><div id="cookie-notice">We use cookies</div><footer>&copy; x</footer>'
)
TEXT = "Head & line\nBold part\nSecond one x.\nIn div"


def test_article():
    assert main_text(PAGE, None) == TEXT
    assert main_text(PAGE + "</body></html>", None) == TEXT
    assert main_text(None, None) == main_text("", None) == main_text("<nav>x</nav>", None) == ""
    assert main_text("plain < text", None) == "plain < text"


def test_no_article_takes_the_container_with_most_text():
    page = "<body><div>top</div><div class=content><h1>Title</h1><p>" + "long text " * 20 + "</p><p>more</p></div><div>end</div>"
    assert main_text(page, None).endswith("more") and "end" not in main_text(page, None)


def test_classes_that_are_out_of_order_or_not_nested_are_not_used():
    places = lambda sequence, classes: sorted(template_places(sequence, classes))
    assert places([1, 2, 3, 7, 8, 4], [[1, 4], [2, 3]]) == [1, 2, 3, 4]
    assert places([1, 3, 2, 4], [[1, 4], [2, 3]]) == [1, 4]
    assert places([1, 2, 4, 3], [[1, 4], [2, 3]]) == [1, 4]
    assert places([1, 2], [[1, 4], [2, 5], [2]]) == [2]


def page(i, body):
    return f"<html><body><div class=top><b>Our site</b></div><div class=box><h1>Story {i}</h1>{body}<p>Read more on our site</p></div></body></html>"


def test_template_text_goes_and_slots_stay(spark):
    rows = [(i, f"http://h.org/{i}", page(i, "".join(f"<p>word{i} line {j} and more text.</p>" for j in range(4)))) for i in range(20)]
    rows += [(50, "http://one.org/", page(50, "<p>alone</p>")), (51, None, None), (52, "no host", "<article>x &lt; y</article>"), (0, "http://h.org/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, token int")
    want = {i: "\n".join([f"Story {i}", *(f"word{i} line {j} and more text." for j in range(4))]) for i in range(20)}
    for how in (Extraction(), Extraction(salts=1)):
        got = {r.page_id: r.text for r in extract(pages, how).collect()}
        assert {i: got[i] for i in want} == want
        assert got[51] == "" and got[52] == "x < y" and "alone" in got[50]
        assert extract(pages, how).count() == len(rows)
    assert extract(pages.limit(0)).collect() == []


def test_host(spark):
    urls = ["HTTP://A.b/c", None, "x", "x://H\u0130.org?q", "a://b#c"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(host_column()).collect()] == ["a.b", "", "", "h\u0130.org", "b"]


def test_copies_of_one_page_are_no_template(spark):
    body = "".join(f"<p>Line {j} of the copied story.</p>" for j in range(4))
    copies = [(i, f"http://c.org/{i}", page(0, body)) for i in range(20)]
    text = "\n".join(["Story 0", *(f"Line {j} of the copied story." for j in range(4)), "Read more on our site"])
    got = extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert len(got) == 20 and {r.text for r in got} == {text}


def near_copy(i, article):
    tag = "article" if article else "div class=box"
    body = f"<h1>One title for all</h1><p>The first paragraph is the same.</p><p>So is the second, word by word.</p><p>Only the third, of page {i}, differs.</p>"
    return f"<html><body><div class=top><b>Our site</b></div><{tag}>{body}</{tag.split()[0]}><div>end of site</div></body></html>"


def test_near_copies_of_a_host_keep_their_texts(spark):
    """Few or many: text that a host's pages share stays where it is part of the article."""
    rows = [(1000 * n + i, f"http://n{n}.org/{i}", near_copy(i, n % 2)) for n in (6, 7, 8, 9, 100, 101) for i in range(n)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"One title for all\nThe first paragraph is the same.\nSo is the second, word by word.\nOnly the third, of page {k % 1000}, differs." for k in got}
    assert len(got) == len(rows) and got == want


def test_repeated_rows_change_no_template(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"<p>word{i} and more text.</p>")) for i in range(20)]
    schema = "page_id long, url string, html string"
    once = {tuple(r) for r in extract(spark.createDataFrame(rows, schema)).collect()}
    twice = extract(spark.createDataFrame(rows * 2, schema)).collect()
    assert len(twice) == 40 and {tuple(r) for r in twice} == once
    some = extract(spark.createDataFrame(rows + rows[:1] * 60, schema)).collect()
    assert {tuple(r) for r in some} == once


def bare(i, story, menu):
    """A page without telling names; the article is the third element."""
    items = "".join(f"<div><b>menu {m} of page {i}</b></div>" for m in range(menu))
    body = "".join(f"<p>{p}</p>" for p in story)
    return f"<html><body><div>{items}</div><div>Buy this now, offer {i}, it will never come again.</div><div><h1>Head {i}</h1>{body}</div><div>page {i} end</div></body></html>"


def test_the_template_decides_where_names_say_nothing(spark):
    story = {i: [f"Line {j} of story {i} goes on and on for a while." for j in range(1 + i % 5 * 3)] for i in range(30)}
    rows = [(i, f"http://h.org/{i}", bare(i, story[i] if i else ["Short."], 4 + i % 3)) for i in range(30)]
    want = {i: "\n".join([f"Head {i}", *(story[i] if i else ["Short."])]) for i in range(30)}
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    # A page on its own is lost where menus or adverts hold more text than the article.
    assert sum(main_text(html, None) != want[i] for i, _, html in rows) >= 6


def plain_classes(rows, how):
    """Classes from occurrence vectors written out: which distinct pages have each role."""
    where, pages = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for host, html in {(url.split("/")[2], html) for _, url, html in rows}:
        pages[host].add(html)
        items = list(tokens(html))
        for (_, kind, *_), role in zip(items, roles_of(items)[0]):
            if role:
                where[host][role, kind].add(html)
    out = {}
    for host, found in where.items():
        classes = defaultdict(set)
        for (role, kind), held in found.items():
            least = max(how.least_pages, how.share * len(pages[host]), how.text_share * len(pages[host]) if kind == "t" else 0, how.text_pages if kind == "t" else 0)
            if len(held) >= least:
                classes[frozenset(held)].add(role)
        out[host] = {frozenset(c) for c in classes.values() if len(c) >= how.least_tokens}
    return {h: c for h, c in out.items() if c}


def test_classes_against_vectors_written_out(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", bare(i, ["same words", f"own {i}"][: 1 + i % 3], 3 + i % 4)) for i in range(24)] + [(99, "http://c.org/", bare(9, ["x"], 2))]
    how = Extraction()
    want = plain_classes(rows, how)
    assert want and all(len(c) > 1 for c in want.values())
    for table in (rows, rows * 2, rows + rows[:3] * 5):
        got = {r.host: {frozenset(c) for c in r.classes} for r in templates(spark.createDataFrame(table, "page_id long, url string, html string"), how).collect()}
        assert got == want
