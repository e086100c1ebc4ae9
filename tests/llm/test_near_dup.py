import random

import numpy as np

from lumenloom.llm.near_dup import NearDup, _permutations, components, connect, keep_one, least_matches, minhash


def brute(rows, percent=85, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeXYZé") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(1, 7)):
            text = list(base)
            for _ in range(r.randrange(0, 4)):  # some just over, some just under the threshold
                text[r.randrange(len(text))] = word()
            rows.append(" ".join(text))
    # A chain: neighbours are alike, its ends are not.
    chain = [word() for _ in range(200)]
    for _ in range(8):
        rows.append(" ".join(chain))
        for _ in range(2):
            chain[r.randrange(len(chain))] = word()
    rows += ["", None, " \n ", "a b", "A  b", "a b c", "same", "SAME", rows[0], rows[0].upper()]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component int")
    for how in (NearDup(), NearDup(star_rounds=0, block=4), NearDup(star_rounds=1, block=2, part_rows=2), NearDup(part_rows=1)):
        got = sorted(tuple(x) for x in components(docs, how).collect())
        assert [(a, b, c, d) for a, b, c, d in got] == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert components(empty).collect() == []
    rows = [(1, "x y z"), (1, "x y z"), (None, "x y z"), (None, None)]
    got = components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and all(r.component_id in (1, None) for r in got)


def test_rows_of_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b), (5, ""), (None, b), (None, "own text"), (None, "own text")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 36, 1, True), (5, 36, 1, False), (5, 36, 1, False), (7, 36, 1, False), (5, 0, 5, True), (None, 36, 1, False), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_keep_one_row_of_each_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 1), (1, a, 2), (2, a.upper(), 3), (None, b, 4), (None, b, 5), (None, b.upper(), 6), (3, None, 7), (3, None, 8), (4, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = keep_one(docs)
    assert got.columns == docs.columns
    left = sorted(r.row for r in got.collect())
    assert left[0] in (1, 2) and left[1] in (4, 5, 6) and left[2:] == [7, 8, 9]
    assert keep_one(docs.limit(0)).collect() == []


def test_a_large_bucket_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        text = list(base)
        text[r.randrange(8, 112)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = components(spark.createDataFrame(rows, "doc_id long, text string"), NearDup(part_rows=100, block=50)).collect()
    assert {x.component_id for x in got} == {0} and sum(x.kept for x in got) == 1


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + i, 6000) for i in range(50)]
    r.shuffle(edges)
    got = dict(tuple(x) for x in connect(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 200)) and got[6000] == 5000


def test_minhash_estimates_and_gates():
    r = np.random.RandomState(0)
    a, b = _permutations(NearDup().size)
    x = r.randint(0, 2**63, 3000).astype(np.uint64)
    one, two = minhash(x[:2700], a, b), minhash(x[300:], a, b)
    assert abs((one == two).mean() - 0.8) < 0.12
    assert least_matches(120, 0.85, 1e-6) < 102 and least_matches(24, 0.85, 1e-6) > 5
