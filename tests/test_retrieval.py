import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.functions import vectors as vx
from lumenloom.operators import fusion, graph, retrieval
from lumenloom.plans.settings import Settings

ROWS = [
    (1, "Python is a high level programming language for general use"),
    (2, "machine learning algorithms learn from data and improve automatically"),
    (3, "web scraping is extraction of data from web pages automatically"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id long, text string")


def spec(query):
    """BM25 as told, in plain Python."""
    docs = {i: Counter(t.lower().split()) for i, t in ROWS}
    n, avg = len(docs), sum(map(Counter.total, docs.values())) / len(docs)
    out = {}
    for i, d in docs.items():
        s = 0.0
        for t in query.split():
            df = sum(t in x for x in docs.values())
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * d.total() / avg))
        if s > 0:
            out[i] = s
    top = max(out.values(), default=1)
    return {i: s / top for i, s in out.items()}


@pytest.mark.parametrize("query", ["programming language", "web data", "data data web", "absent"])
def test_bm25(spark, chunks, query):
    got = {r.chunk_id: r.raw for r in retrieval.bm25(chunks, retrieval.query_tokens(spark, query)).collect()}
    assert got == pytest.approx(spec(query))


def test_bm25_without_terms(chunks):
    assert retrieval.bm25(chunks, Counter()).collect() == []


def test_batch_equals_single(spark, chunks):
    qs = spark.createDataFrame([(1, "web", 1), (1, "data", 1)], "query_id int, term string, qtf int")
    got = {r.chunk_id: r.raw for r in retrieval.bm25_batch(retrieval.postings(chunks), retrieval.chunk_lengths(chunks), qs).collect()}
    assert got == pytest.approx(spec("web data"))


def test_rrf_values(spark):
    lists = spark.createDataFrame([("bm25", "a", 1.0, 0), ("bm25", "b", 0.5, 1), ("text_cosine", "b", 0.9, 0), ("text_cosine", "a", 0.8, 1)], "signal string, chunk_id string, raw double, rank int")
    got = {r.chunk_id: r for r in fusion.rrf(lists, {"bm25": 2.0, "text_cosine": 1.0}).collect()}
    assert got["a"].rrf == pytest.approx(0.048915918, abs=1e-9) and got["b"].rrf == pytest.approx(0.048651507, abs=1e-9)
    assert got["a"].signals == {"bm25": 1.0, "text_cosine": 0.8}
    zero = {r.chunk_id: r.rrf for r in fusion.rrf(lists.filter("signal = 'bm25'"), {"bm25": 0.0}).collect()}
    assert zero == {"a": 0.0, "b": 0.0}


@pytest.mark.parametrize(("age", "strength", "value"), [(0, 0, 1), (30, 0, 0.5), (30, 2.5, 0.75), (90, 0, 0.125), (90, 5, 1), (90, 9, 1)])
def test_recency(spark, age, strength, value):
    assert spark.range(1).select(retrieval.recency_value(F.lit(float(age)), F.lit(float(strength)))).first()[0] == pytest.approx(value)


def test_quantize(spark):
    row = spark.createDataFrame([([-0.5, 0.0, 0.25, 1.0],)], "v array<float>").select(vx.quantize(F.col("v")).alias("q"), vx.dequantize(vx.quantize(F.col("v"))).alias("d")).first()
    assert row.q.codes == [0, 85, 128, 255] and row.d == pytest.approx([-0.5, 0.0, 0.252941, 1.0], abs=1e-6)
    flat = vx.decode(vx.encode([0.3] * 4))
    assert flat == pytest.approx([0.3] * 4)
    assert vx.decode(vx.encode([0.5, 2.0], coded=False)) == [0.5, 2.0]
    assert vx.decode(np.array([1.5, 2.5], "<f4").tobytes()) == [1.5, 2.5]
    assert vx.decode_matrix(vx.encode_matrix([[1.0, 2.0], [3.0, 4.0]])) == [[1.0, 2.0], [3.0, 4.0]] and vx.decode_matrix(b"\1\0\1\0") is None


def test_zscore(spark):
    rows = spark.createDataFrame([(0.2, 0.1), (0.4, 0.3), (0.6, 0.8)], "text_score double, code_score double")
    assert sorted(r.transferred for r in retrieval.zscore_transfer(rows).collect()) == pytest.approx([0.233590, 0.344530, 0.621880], abs=1e-6)
    assert retrieval.zscore_transfer(rows.limit(1)).first().transferred is None


def vectors(spark, n=40, dims=8):
    r = np.random.RandomState(42)
    m = r.randn(n, dims)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "chunk_id int, embedding array<float>")


def test_funnel_finds_what_brute_force_finds_first(spark):
    m, df = vectors(spark)
    s = Settings(funnel_dims=(4, 6, 8))
    got = retrieval.funnel(df, m[7].tolist(), 5, s).collect()
    assert got[0].chunk_id == 7 and len(got) == 5
    every = retrieval.cosine(df, m[7].tolist()).collect()
    assert {r.chunk_id for r in got} <= {r.chunk_id for r in every}


def test_top_k_is_cut_in_each_task(spark):
    _, df = vectors(spark)
    assert "TakeOrderedAndProject" in retrieval.cosine(df, [1.0] + [0.0] * 7, 3)._jdf.queryExecution().executedPlan().toString()


def test_maxsim(spark):
    m, _ = vectors(spark, 12)
    docs = {i: m[3 * i : 3 * i + 3] for i in range(4)}
    q = m[:2]
    best = np.array([(q @ d.T).max(axis=1) for d in docs.values()])
    w = vx.soft_token_weights(best)
    df = spark.createDataFrame([(i, [[float(x) for x in t] for t in d]) for i, d in docs.items()], "chunk_id int, tokens array<array<double>>")
    got = {r.chunk_id: r.raw for r in retrieval.maxsim_signal(df, q.tolist()).collect()}
    assert got == pytest.approx({i: vx.maxsim(q, d, w) for i, d in docs.items()})


def test_fixed_encoding():
    planes = vx.hyperplanes()
    rows = np.random.RandomState(0).randn(9, 128).astype(np.float32)
    e = vx.fixed_encoding(rows, planes)
    assert e.shape == (2560,) and np.linalg.norm(e) == pytest.approx(1, abs=1e-5)
    assert (vx.fixed_encoding(rows, planes) == e).all() and not vx.fixed_encoding(rows[:0], planes).any()


def test_parents(spark):
    chunks = spark.createDataFrame([("p1", "parent")], "chunk_id string, text string")
    hits = spark.createDataFrame([("p1::0", "p1", "c0", 0), ("p1::1", "p1", "c1", 1), ("x::0", "x", "lost", 2), ("solo", None, "alone", 3)], "chunk_id string, parent_chunk_id string, text string, position int")
    assert [(r.chunk_id, r.text) for r in fusion.expand_to_parents(hits, chunks, 10).collect()] == [("p1", "parent"), ("x::0", "lost"), ("solo", "alone")]
    assert [r.chunk_id for r in fusion.expand_to_parents(hits, chunks, 4, backfill=True).collect()] == ["p1", "x::0", "solo", "p1::1"]


def test_centrality(spark):
    edge = lambda pairs: spark.createDataFrame(pairs, "source_url string, target_url string")
    odd = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]
    got = {r.node: r.score for r in graph.centrality(edge(odd)).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.732049, "c": 1.0}, abs=1e-4)
    assert graph.centrality_of(odd) == pytest.approx(got, abs=1e-4)
    even = [("a", "b"), ("b", "a"), ("b", "c")]
    assert graph.centrality_of(even) == pytest.approx({"a": 1.0, "b": 0.833333, "c": 0.5}, abs=1e-5)
    assert graph.centrality(edge([("a", "b")]).limit(0)).collect() == []


def dense_spectrum(pairs):
    """Eigenvalues and vectors of the normalised adjacency, largest first."""
    names = sorted({x for p in pairs for x in p})
    a = np.zeros((len(names), len(names)))
    for u, v in pairs:
        a[names.index(u), names.index(v)] += 1
        a[names.index(v), names.index(u)] += 1
    root = np.sqrt(a.sum(axis=0))
    values, vectors = np.linalg.eigh(a / np.outer(root, root))
    return names, values[::-1], vectors[:, ::-1]


def grid(w, h):
    return [(f"{i:02}-{j:02}", f"{i + a:02}-{j + b:02}") for i in range(w) for j in range(h) for a, b in ((0, 1), (1, 0)) if i + a < w and j + b < h]


@pytest.mark.parametrize("pairs", [grid(4, 2), grid(11, 7) + [("00-00", "00-00"), ("00-01", "00-00")]])
def test_spectral(spark, pairs):
    """Cosines are those of a dense solver: below 13 nodes at once, above by filtered rounds; links to itself, both ways."""
    dims = 4
    names, values, vectors = dense_spectrum(pairs)
    assert values[dims] - values[dims + 1] > 1e-3
    want = vectors[:, 1 : dims + 1] / np.linalg.norm(vectors[:, 1 : dims + 1], axis=1, keepdims=True)
    got = {r.node: r.embedding for r in graph.spectral(spark.createDataFrame(pairs, "source_url string, target_url string"), dims, split=3).collect()}
    assert sorted(got) == names
    found = np.array([got[x] for x in names])
    assert np.abs(found @ found.T - want @ want.T).max() < 1e-4


def test_spectral_in_pieces_and_small(spark):
    """Pages of one piece get one place; a star's rest has one eigenvalue; small graphs have their defined results."""
    links = lambda pairs: spark.createDataFrame(pairs, "source_url string, target_url string")
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(6) for j in range(i)]
    got = {r.node: np.array(r.embedding) for r in graph.spectral(links(pairs), 2).collect()}
    assert all(got[f"{c}{i}"] @ got[f"{c}0"] == pytest.approx(1, abs=1e-5) for c in "abc" for i in range(6))
    assert got["a0"] @ got["b0"] < 0.99
    star = {r.node: np.array(r.embedding) for r in graph.spectral(links([("hub", f"s{i}") for i in range(40)]), 3, split=7).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1, abs=1e-6) for k, v in star.items() if k != "hub") and not np.any(star["hub"].round(3)) and len(star) == 41
    assert [(r.node, r.embedding) for r in graph.spectral(links([("a", "a"), (None, "b")])).collect()] == [("a", [0.0])]
    assert [len(r.embedding) for r in graph.spectral(links([("a", "b"), ("b", "c")])).collect()] == [1, 1, 1]
    assert graph.spectral(links([("a", "b")]).limit(0)).collect() == []
    assert {tuple(r.embedding) for r in graph.spectral(links(grid(9, 3)), 2, rounds=1).collect()} == {(0.0, 0.0)}


def test_spectral_goes_on_until_found(spark):
    """A long chain, where forty rounds of one step each gave zeros; what isn't found is an error, or where the caller sets rounds, a warning."""
    links = lambda pairs: spark.createDataFrame(pairs, "source_url string, target_url string")
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(29)]
    names, _, vectors = dense_spectrum(pairs)
    want = vectors[:, 1:3] / np.linalg.norm(vectors[:, 1:3], axis=1, keepdims=True)
    got = {r.node: r.embedding for r in graph.spectral(links(pairs), 2, degree=1).collect()}
    found = np.array([got[x] for x in names])
    assert np.abs(found @ found.T - want @ want.T).max() < 1e-4
    with pytest.raises(RuntimeError, match="no eigenvectors of 5 nodes"):
        graph.spectral(links(pairs[:4]), 2, tolerance=-1.0, patience=1)
    with pytest.warns(RuntimeWarning, match="0 rounds"):
        assert {tuple(r.embedding) for r in graph.spectral(links(pairs[:4]), 2, rounds=0).collect()} == {(0.0, 0.0)}


def test_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src int, dst int")
    assert {r.node: r.depth for r in graph.reach(e, spark.createDataFrame([(1,)], "node int")).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_spectral_of_many_pieces(spark):
    """More pieces than dimensions: rows lie in the eigenspace of the largest eigenvalue, without the trivial vector, after no round at all."""
    pairs = [(f"{c}{i:02}", f"{c}{j:02}") for k, c in enumerate("abcdefg") for i in range(2 + k) for j in range(i)] + [("b00", "b00"), ("h00", "h01"), ("h01", "h02"), ("h02", "h03"), ("i00", "i00")]
    got = {r.node: np.array(r.embedding) for r in graph.spectral(spark.createDataFrame(pairs, "source_url string, target_url string"), 4, rounds=0).collect()}
    names, values, _ = dense_spectrum(pairs)
    assert sorted(got) == names and (values > 1 - 1e-9).sum() == 9
    assert all(np.linalg.norm(v) == pytest.approx(1) and len(v) == 4 and v == pytest.approx(got[f"{k[0]}00"]) for k, v in got.items())
    # The lengths that the rows had make the columns orthonormal, and orthogonal to square roots of degrees.
    degree = {x: sum(p.count(x) for p in pairs) for x in names}
    volume = {c: sum(d for x, d in degree.items() if x[0] == c) for c in "abcdefghi"}
    rows, root = np.array([got[f"{c}00"] for c in volume]), np.sqrt(list(volume.values()))
    scale = np.linalg.lstsq(np.concatenate([np.einsum("ci,cj->ijc", rows, rows).reshape(16, -1)]), np.eye(4).ravel(), rcond=None)[0]
    assert np.abs(np.einsum("ci,cj,c->ij", rows, rows, scale) - np.eye(4)).max() < 1e-8 and len(root) == 9


def test_pieces(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i != 20] + [("x", "x")]
    both = spark.createDataFrame(chain + [(b, a) for a, b in chain], "node string, other string")
    got = {r.node: r.piece for r in graph.pieces(both).collect()}
    assert got == {f"n{i:03}": "n000" if i <= 20 else "n021" for i in range(41)} | {"x": "x"}


def test_many_queries_in_one_pass_equal_postings(spark, chunks):
    """The same scores as by joins of postings, and the best k of each; counts in batches are those of the token column."""
    asked = spark.createDataFrame([(1, "the", 1), (1, "the", 1), (2, "status", 2), (2, "http", 1), (3, "nowhere", 1)], "query_id int, term string, qtf int")
    texts = ["The TaskStatus of the HTTPServer2", "", None, "the the http-status max_items", "ÉTÉ İthe 1abc K9_x-", "status status Status"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    filled = rows.fillna("")
    want = {(r.query_id, r.chunk_id): r.raw for r in retrieval.bm25_batch(retrieval.postings(filled), retrieval.chunk_lengths(filled), asked).collect()}
    got = {(r.query_id, r.chunk_id): r.raw for r in retrieval.over_best(retrieval.bm25_many(rows.repartition(3), asked)).collect()}
    assert got.keys() == want.keys() and want and all(got[x] == pytest.approx(want[x]) for x in want)
    plain = {(r.query_id, r.chunk_id): r.raw for r in retrieval.bm25_many(rows, asked, places=9).collect()}
    best = {(r.query_id, r.chunk_id) for r in retrieval.bm25_many(rows.coalesce(1), asked, k=2, places=9).collect()}
    assert best == {(q, c) for q in (1, 2) for _, c in sorted((-v, c) for (p, c), v in plain.items() if p == q)[:2]}
    sizes = {r.chunk_id: r.dl for r in retrieval.term_hits(rows, ["the"]).collect()}
    assert sizes == {r.chunk_id: r.dl for r in retrieval.chunk_lengths(filled).collect()}
    # The texts are read by one Python pass, and nothing but results is shuffled.
    plan = retrieval.bm25_many(rows, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
