import random

from lumenloom.llm.mixing import Mix, mix, targets


def level(sizes, weights, budget):
    """Targets by giving out and taking back, as told: by weight, the excess again by weight."""
    goal, open_ = {}, set(sizes)
    left = budget
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total >= 2 * sizes[s]]
        if not over:
            return goal | {s: left * weights[s] / total for s in open_}
        for s in over:
            goal[s] = 2.0 * sizes[s]
        left -= sum(goal[s] for s in over)
        open_ -= set(over)
    return goal


def test_against_a_plain_queue(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["b", "a", None, "ä", "zz"]) if r.random() < 0.6 else "hot", " ".join(["w"] * r.choice([0, 1, 5, 30]))) for i in range(400)] + [(900, "tiny", "x"), (901, "none", None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, source string, text string, part int")
    got = mix(docs).collect()
    assert sorted(g.doc_id for g in got) == sorted(x[0] for x in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        mine = [g for g in got if g.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(g.taken for g in mine) - want[s]) <= 31
    assert all(0 <= g.taken <= 2 * g.size for g in got)
    assert abs(sum(g.taken for g in got) - 1.5 * sum(sizes.values())) <= 1
    again = mix(docs.repartition(7), Mix()).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_odd_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    same = mix(spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, None, None)], schema)).collect()
    assert len(same) == 3 and sum(g.taken for g in same) == 6  # half as much again as four words
    assert targets(spark.createDataFrame([("a", 0)], "source string, size long")).first().target == 0
