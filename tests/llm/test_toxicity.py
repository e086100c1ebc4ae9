import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenloom.llm import toxicity
from lumenloom.llm.toxicity import Terms, Toxicity, fit, held_out, isotonic, reject, score, terms_of


def corpus(r, n=1200):
    words = ["".join(r.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    bad = ["mucky", "vilest", "grubby"]
    rows = []
    for i in range(n):
        toxic = r.random() < 0.15
        text = [r.choice(words) for _ in range(r.randrange(20, 80))]
        if toxic:
            for _ in range(r.randrange(1, 5)):
                text[r.randrange(len(text))] = r.choice(bad) + r.choice(["", ",", "ness"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_clean_documents(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = fit(docs, labels, ~held_out())
    got = {r.doc_id: r for r in score(docs, model).join(docs.select("doc_id", held_out().alias("h")), "doc_id").collect()}
    test = [(got[i].predicted, y) for i, _, y in rows if got[i].h]
    assert len(test) > 200
    assert sum(p == y for p, y in test) / len(test) > 0.98
    assert sum(p > y for p, y in test) <= 1
    hit = next(got[i] for i, _, y in rows if y and got[i].predicted)
    assert hit.evidence and all(e.toxic in (0, 1) and 0 < e.cosine <= 1.0000001 for e in hit.evidence)
    kept = reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not g.predicted for g in got.values())


def plain_scores(rows, how, model):
    """Cosines of every text with every example, one by one, from the definition."""
    count = lambda text: Counter(t for w in text.split() for t in terms_of(w))
    train = [(i, t, y, count(t)) for i, t, y in rows if y is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    n, total = len(train), sum(y for *_, y, _ in train)
    df, a = Counter(), Counter()
    for *_, y, c in train:
        df.update(c.keys())
        a.update(c.keys() if y else ())
    weight = lambda t: (math.log((n + 1) / (df[t] + 1)) + 1) * (math.log2(2 + a[t] / max(1, df[t] - a[t])) - 0.9)

    def unit(c):
        v = {t: (1 + math.log(k)) * weight(t) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    units = [(i, t, y, unit(c)) for i, t, y, c in train]
    share, out = total / n, {}
    for i, text, _ in rows:
        u = unit(count(text))
        near = sorted(((-sum(x * v.get(t, 0) for t, x in u.items()), j, y) for j, t2, y, v in units if t2 != text))[: how.k]
        near = [(-s, y) for s, _, y in near if s < -1e-9]
        if not near:
            out[i] = model.without
            continue
        w = [1 / (1.05 - min(s, 1)) for s, _ in near]
        vote = (sum(a for a, (_, y) in zip(w, near) if y) + share) / (sum(w) + 1)
        out[i] = model.chance(vote)
    return out


@pytest.mark.parametrize("how", [Toxicity(k=7, block=8, first=1, wide=0.1), Toxicity(k=7, block=8, first=2, wide=2.0), Toxicity(k=7, wide=0.0)])
def test_whole_query_against_all_cosines(spark, how):
    rows = corpus(random.Random(3), 250)
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], None), (1002, "zzz unseen only", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    model = fit(docs, labels, ~held_out(), how)
    want = plain_scores(rows, how, model)
    for r in score(docs, model).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4), r.doc_id


def test_no_text_votes_on_itself(spark):
    rows = corpus(random.Random(5), 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert all(e.doc_id != r.doc_id for r in score(docs, model).collect() for e in r.evidence)


def test_repeated_documents_of_a_label_are_one_example(spark):
    rows = corpus(random.Random(6), 60)
    docs = spark.createDataFrame([(i, f"{t} {k}") for i, t, _ in rows for k in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 3, "doc_id long, toxic int")
    model = fit(docs, labels, None, Toxicity(max_toxic=5, max_clean=20))
    assert len(model.ids) == len(set(model.ids)) <= 25


def test_the_model_is_not_built_in_the_driver(spark, monkeypatch):
    docs, labels = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    driver, build = os.getpid(), toxicity.build

    def elsewhere(*args):
        assert os.getpid() != driver
        return build(*args)

    monkeypatch.setattr(toxicity, "build", elsewhere)
    assert fit(docs, labels).ids == [1, 2]


def test_building_takes_little_beside_the_examples():
    r = np.random.RandomState(1)
    rows = [(i, i % 2, bytes([i]), np.unique(r.randint(0, 60_000, 500)).astype(np.uint64)) for i in range(200)]
    rows = [(*x, np.ones(len(x[3]), np.int32)) for x in rows]
    tracemalloc.start()
    model = toxicity.build(Toxicity(), rows, 0.5, {0: 100, 1: 100})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.terms) > 40_000 and peak < 400 * len(model.terms)  # drawing all signs at once took over 800 bytes a term


def test_a_model_of_many_pieces_comes_whole(spark):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(1500)), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    packed = toxicity.packed_model(model)
    assert len(packed) > 3 * toxicity.PIECE and toxicity.unpacked_model(packed).terms.tolist() == model.terms.tolist()
    assert len(model.terms) == len({t for _, text, _ in rows for w in text.split() for t in terms_of(w)}) and model.ids == list(range(40))


def test_terms_are_counted_over_a_full_memo():
    memo, small = Terms(), Terms(limit=7)
    for text in ("a b a ccc cccd cccd, Ünï", "x y z x", None, "", "?? a", "a b a ccc cccd cccd, Ünï"):
        for one, two in zip(memo.of(text), small.of(text)):
            assert one.tolist() == two.tolist()
    assert sorted(memo.of("ab AB abcd")[1].tolist()) == [1.0, 1.0, 2.0]


def test_isotonic_rises():
    x, y = isotonic(np.array([0.1, 0.2, 0.2, 0.9]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score(docs, fit(docs, none)).collect()] == [0.0] * 3
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "doc_id long, toxic int")
    assert {r.score for r in score(docs, fit(docs, one)).collect()} == {1.0}
    assert score(docs.limit(0), fit(docs, one)).collect() == []
