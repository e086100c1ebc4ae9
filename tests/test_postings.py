import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import postings, retrieval

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa camelCase snake_case the the the the of of".split()


def texts(seed, ids, most=60):
    r = random.Random(seed)
    return {i: " ".join(r.choice(WORDS) + r.choice(["", "", str(r.randrange(40))]) for _ in range(r.randrange(most))) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "chunk_id long, text string")


def wanted(spark, rows, tokens, k):
    got = retrieval.bm25(frame(spark, rows), tokens, limit=k)
    return sorted(((r.chunk_id, round(r.raw, 9)) for r in got.collect()), key=lambda x: (-x[1], x[0]))


def found(df):
    return sorted(((r.chunk_id, round(r.raw, 9)) for r in df.collect()), key=lambda x: (-x[1], x[0]))


@pytest.fixture
def index(spark, tmp_path):
    return postings.Postings(spark, str(tmp_path / "index"), buckets=4, block=8, most_segments=4)


def test_changes_equal_a_new_index(spark, index):
    """Adds, replacements and deletions, each compared with scoring the whole table."""
    ask = [Counter({"alpha": 1, "the": 2, "camel": 1, "absent": 3})]
    rows = texts(1, range(300))
    index.add(frame(spark, rows))
    for step in range(5):
        if step == 1:
            new = texts(2, range(250, 340)) | {7: None, 8: ""}
            rows |= {k: v or "" for k, v in new.items()}
            index.add(frame(spark, new))
        if step == 2:
            gone = [*range(0, 60), 5000]
            rows = {k: v for k, v in rows.items() if k not in gone}
            index.delete(spark.createDataFrame([(g,) for g in gone], "chunk_id long"))
        if step == 3:  # deleted ones come back
            new = texts(3, range(40, 80))
            rows |= new
            index.add(frame(spark, new))
        if step == 4:
            index.delete(spark.createDataFrame([(9,), (45,)], "chunk_id long"))  # the fifth segment: all become one
            rows = {k: v for k, v in rows.items() if k not in (9, 45)}
            assert len(index._segments()) == 1
        for tokens in ask:
            assert found(index.search(tokens, 12)) == wanted(spark, rows, tokens, 12)


def test_many_queries_at_once(spark, index):
    rows = texts(4, range(200))
    index.add(frame(spark, rows))
    ask = {i: Counter(random.Random(i).choices([w.lower() for w in WORDS if w.isalpha()], k=3)) for i in range(6)}
    queries = spark.createDataFrame([(i, t, n) for i, c in ask.items() for t, n in c.items()], "query_id int, term string, qtf int")
    got = index.search_many(queries, 10)
    for i, tokens in ask.items():
        assert found(got.filter(F.col("query_id") == i)) == wanted(spark, rows, tokens, 10)


def test_blocks_are_skipped_and_folders_pruned(spark, tmp_path):
    index = postings.Postings(spark, str(tmp_path / "i"), buckets=8, block=16)
    r = random.Random(7)
    rows = {i: " ".join(["the"] * r.randrange(1, 4) + ["filler"] * r.choice([2, 30, 200, 900])) for i in range(1500)}
    index.add(frame(spark, rows))
    queries = spark.createDataFrame([(0, "the", 1)], "query_id int, term string, qtf int")
    share = index.pruning(queries, 10).first()
    assert share.blocks > 60 and share.scored < share.blocks / 3
    assert found(index.search(Counter({"the": 1}), 10)) == wanted(spark, rows, Counter({"the": 1}), 10)
    plan = index.search(Counter({"the": 1}), 10)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in line or "PartitionFilters: [bucket" in line for line in scans)


def test_a_run_that_stops_leaves_the_index_as_it_was(spark, index, monkeypatch):
    rows = texts(5, range(50))
    index.add(frame(spark, rows))
    monkeypatch.setattr(index, "_publish", lambda segments: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        index.add(frame(spark, texts(6, range(50))))
    monkeypatch.undo()
    assert found(index.search(Counter({"alpha": 1}), 9)) == wanted(spark, rows, Counter({"alpha": 1}), 9)


def test_odd_tables(spark, index):
    assert index.search(Counter({"a": 1}), 3).collect() == []
    index.delete(spark.createDataFrame([(1,)], "chunk_id long"))
    index.add(spark.createDataFrame([], "chunk_id long, text string"))
    assert index.search(Counter({"a": 1}), 3).collect() == []
    index.add(spark.createDataFrame([(1, "b a", 5), (1, "a a a", 6), (None, "a", 7), (2, None, 8)], "chunk_id long, text string, tf int"))
    assert found(index.search(Counter({"a": 1}), 3)) == [(1, 1.0)] == wanted(spark, {1: "a a a", 2: ""}, Counter({"a": 1}), 3)


def test_term_counts(spark):
    rows = [("b a b HTTPServer",), ("",), ("x",)]
    got = spark.createDataFrame(rows, "t string").select(postings.term_counts(F.col("t"))).collect()
    assert [{x.term: x.tf for x in r[0]} for r in got] == [{"b": 2, "a": 1, "httpserver": 1, "http": 1, "server": 1}, {}, {"x": 1}]


def test_texts_of_single_ids_stay(spark, index, monkeypatch):
    """No text is shuffled where ids come once; repeated ids give the smallest text, whether few or many."""
    once = spark.createDataFrame([(i, "alpha beta") for i in range(20)], "chunk_id long, text string")
    assert "Exchange" not in index._single(once)._jdf.queryExecution().executedPlan().toString()
    twice = once.unionByName(spark.createDataFrame([(3, "a"), (4, None), (4, "zeta")], "chunk_id long, text string"))
    rows = {i: "alpha beta" for i in range(20)} | {3: "a"}
    assert dict(index._single(twice).collect()) == rows
    monkeypatch.setattr(postings, "FEW", 0)
    assert dict(index._single(twice).collect()) == rows
