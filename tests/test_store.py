import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import evaluation as ev
from lumenloom.operators import incremental as inc
from lumenloom.operators import store as st
from lumenloom.operators.store import Store


@pytest.fixture
def box(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def test_pages_merge_and_default(spark, box):
    box.upsert("pages", spark.createDataFrame([("a", "A", "h1")], "url string, title string, content_hash string"))
    box.upsert("pages", spark.createDataFrame([("a", "A2", None), ("b", "B", None)], "url string, title string, content_hash string"))
    got = {r.url: (r.title, r.content_hash, r.crawl_status) for r in box.read("pages").collect()}
    assert got == {"a": ("A2", "h1", "active"), "b": ("B", None, "active")}


def test_chunks_keep_corroboration(spark, box):
    schema = "chunk_id string, page_url string, text string"
    box.upsert("chunks", spark.createDataFrame([("1", "u", "x"), ("2", "v", "y")], schema))
    box.write("chunks", st.corroborate(box.read("chunks"), spark.createDataFrame([("1",), ("1",)], "chunk_id string"), F.lit(dt.datetime(2024, 1, 1)), 0.3))
    box.upsert("chunks", spark.createDataFrame([("1", "u", "new")], schema))
    row = {r.chunk_id: r for r in box.read("chunks").collect()}
    assert row["1"].text == "new" and row["1"].corroboration_strength == pytest.approx(0.6) and row["2"].corroboration_strength == 0.0
    assert row["1"].content_type == "text" and row["1"].is_child is False


def test_links_and_searches(spark, box):
    links = spark.createDataFrame([("a", "b", "1")], "source_url string, target_url string, anchor_text string")
    box.upsert("page_links", links)
    box.upsert("page_links", links.withColumn("anchor_text", F.lit("2")).union(spark.createDataFrame([("a", "c", "3")], links.schema)))
    assert sorted(tuple(r) for r in box.read("page_links").collect()) == [("a", "b", "1"), ("a", "c", "3")]
    box.log_search("q1", 3)
    box.log_search("q2", 0)
    assert [(r.id, r.query) for r in box.read("searches").orderBy("id").collect()] == [(1, "q1"), (2, "q2")]
    row = box.status().first()
    assert (row.links, row.searches, row.pages) == (2, 2, 0) and row.last_activity is not None


def test_migration(spark):
    old = spark.createDataFrame([("u", "t")], "url string, title string")
    row = st.migrate(old, "pages").first()
    assert row.crawl_status == "active" and row.content_hash is None and row.title == "t"


def test_cascades(spark):
    chunks = spark.createDataFrame([("1", "p"), ("2", "q")], "chunk_id string, page_url string")
    links = spark.createDataFrame([("1", "e1"), ("2", "e2"), ("1", "e2")], "chunk_id string, entity_id string")
    tokens = spark.createDataFrame([("1",), ("2",)], "chunk_id string")
    a, b, c = st.delete_cascade(chunks, links, tokens, "p")
    assert (a.count(), b.count(), c.count()) == (1, 1, 1)
    entities = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    left, kept = st.delete_entities_for_page(entities, links, chunks, "p")
    assert [r.entity_id for r in left.collect()] == ["e2"] and kept.count() == 1


def test_stale_is_by_host(spark):
    pages = spark.createDataFrame([("https://docs.ex.com/a", "active"), ("https://docs.ex.com.evil/a", "active"), ("http://docs.ex.com/b", "active")], "url string, crawl_status string")
    marked = st.mark_active(st.mark_stale(pages, "docs.ex.com"), spark.createDataFrame([("http://docs.ex.com/b",)], "url string"))
    assert [r.url for r in st.stale_pages(marked, "docs.ex.com").collect()] == ["https://docs.ex.com/a"]


def test_graph_columns(spark):
    pages = spark.createDataFrame([("a", None, None), ("b", None, None)], "url string, authority_score double, graph_embedding array<float>")
    out = {r.url: r for r in st.store_graph(pages, spark.createDataFrame([("a", 0.5, [1.0] * 8)], pages.schema.simpleString()[7:-1].replace(":", " "))).collect()}
    assert out["a"].authority_score == 0.5 and out["b"].graph_embedding == [0.0] * 8


def test_greedy_and_rounds_agree(spark):
    import numpy as np

    r = np.random.RandomState(3)
    base = r.randn(6, 16)
    m = np.concatenate([base + 0.2 * r.randn(6, 16) for _ in range(5)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, seq long, embedding array<float>")
    got = {x.id: x.duplicate_of for x in inc.greedy_duplicates(df, 0.85).collect()}
    kept: list[int] = []
    for i in range(len(m)):
        best = max(kept, key=lambda k: m[k] @ m[i], default=None)
        if best is not None and m[best] @ m[i] > 0.85:
            assert got[i] == best
        else:
            kept.append(i)
            assert got[i] is None
    pairs = spark.createDataFrame([(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if m[a] @ m[b] > 0.85], "a long, b long")
    assert sorted(x.id for x in inc.keep_by_rounds(df, pairs).filter("kept").collect()) == kept
    found = {(x.a, x.b) for x in inc.similar_pairs(df, 0.85, planes=4, tables=12).collect()}
    assert found <= {(x.a, x.b) for x in pairs.collect()} and len(found) > 0.8 * pairs.count()


def test_novelty(spark):
    go = lambda n, s: inc.novelty(spark.createDataFrame([("new",)] * n + [("skipped",)] * s, "outcome string")).first()["goes_on"]
    assert go(2, 8) and not go(1, 9) and not go(0, 0)


def test_crawl(spark):
    edges = spark.createDataFrame([("http://w/1", "http://w/2"), ("http://w/2", "http://w/1"), ("http://w/2", "http://w/3"), ("http://w/3", "http://x/9"), ("http://x/9", "http://x/10")], "url string, target string")
    from lumenloom.functions import urls

    got = inc.crawl(spark.createDataFrame([("http://w/1",)], "url string"), lambda f: edges.join(f, "url"), lambda u: urls.classify(u, "w"))
    assert {r.url: (r.depth, r.kind) for r in got.collect()} == {"http://w/1": (0, "same-domain"), "http://w/2": (1, "same-domain"), "http://w/3": (2, "same-domain"), "http://x/9": (3, "external")}


def test_image_neighbours(spark):
    images = spark.createDataFrame([("p", "i1", 15), ("p", "i0", 1)], "page_url string, image_id string, dom_offset int")
    chunks = spark.createDataFrame([("p", "c1", 10), ("p", "c2", 20), ("p", "c3", None)], "page_url string, chunk_id string, offset int")
    assert {r.image_id: (r.before, r.after) for r in inc.nearest_chunks(images, chunks).collect()} == {"i1": ("c1", "c2"), "i0": (None, "c1")}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcde")] + [(2, "x", 0)], "query_id int, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "c"), (3, "z")], "query_id int, chunk_id string")
    got = {r.query_id: (r.precision, r.recall) for r in ev.precision_recall(ranked, relevant, 5).collect()}
    assert got == {1: (0.4, 1.0), 2: (0.0, 0.0)}
    values = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert tuple(ev.nearest_rank(values, "v", [50, 95, 99]).first()) == (5.0, 9.0, 9.0)
    scores = spark.createDataFrame([(1.0, 0.5, 0.0), (float("nan"), 1.0, 1.0)], "relevance double, groundedness double, completeness double")
    assert ev.answer_quality(scores).first().mean_score == 0.5
    with pytest.raises(ValueError, match="combinations"):
        ev.sweep_grid([f"s{i}" for i in range(9)])
    assert len(ev.benchmark_matrix()) == 96


def test_percentiles_of_ties_and_groups(spark):
    import random

    r = random.Random(1)
    rows = [(g, float(r.randrange(6 if g == "a" else 1000))) for g in "ab" for _ in range(500)] + [(None, 7.0), ("c", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.p50, x.p95, x.p99) for x in ev.nearest_rank(df, "v", [50, 95, 99], ["g"], ranges=8).collect()}
    want = {}
    for g in ("a", "b", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = tuple(v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 95, 99))
    assert got == want


def test_passage_pairs_against_all_pairs(spark):
    import random

    from lumenloom.functions import text as tx

    r = random.Random(2)
    word = lambda: r.choice(["sun", "panel", "the", "Light", "a", "&amp;", "of", "grid", "x y", "&nbsp;z"])
    chunks = [(i, "  ".join(word() for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(99, None)]
    passages = []
    for i in range(60):
        t = r.choice([c for c in chunks if c[1]])[1]
        at = r.randrange(max(len(t) - 5, 1))
        passages.append((i, t[at : at + r.randrange(1, 90)] if i % 3 else " ".join(word() for _ in range(6))))
    p, c = spark.createDataFrame(passages, "passage_id long, passage string"), spark.createDataFrame(chunks, "chunk_id long, text string")
    plain = p.withColumn("p", tx.normalized(p.passage)).crossJoin(c.withColumn("t", tx.normalized(c.text)))
    want = {(x.passage_id, x.chunk_id) for x in plain.filter("p <> ''").filter(tx.overlaps(plain.p, plain.t)).collect()}
    got = [(x.passage_id, x.chunk_id) for x in ev.passage_pairs(p, c).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_term_counts(spark):
    from lumenloom.operators import retrieval

    chunks = spark.createDataFrame([(1, "a b a getHTTP b-c"), (2, "a"), (3, ""), (4, "A get")], "chunk_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("term", "df", "cf").collect())
    assert rows(retrieval.term_counts(chunks)) == rows(retrieval.term_stats(retrieval.postings(chunks)))


def test_matches_and_greedy_over_a_whole_table(spark):
    import numpy as np

    r = np.random.RandomState(4)
    base = r.randn(5, 12)
    m = np.concatenate([base + 0.3 * r.randn(5, 12) for _ in range(6)])
    m[7] = m[2]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, seq long, embedding array<double>")
    want = {x.id: x.duplicate_of for x in inc.greedy_duplicates(df, 0.8).collect()}
    assert {x.id: x.duplicate_of for x in inc.greedy_by_pairs(df, 0.8).collect()} == want
    found = {(x.id, x.match) for x in inc.matches(df, df, 0.8, block=7).collect()}
    assert found == {(a, b) for a in range(len(m)) for b in range(len(m)) if m[a] @ m[b] > 0.8}
    best = {x.id: x.match for x in inc.matches(df.filter("id < 5"), df.filter("id >= 5"), 0.5, best=True).collect()}
    assert all(abs(m[a] @ m[b] - max(m[5:] @ m[a])) < 1e-12 for a, b in best.items()) and len(best) > 2
    assert inc.matches(df.limit(0), df, 0.5).collect() == []
