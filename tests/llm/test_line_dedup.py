import random

import pytest
from pyspark.sql import functions as F

from lumenloom.llm import line_dedup
from lumenloom.llm.line_dedup import LineDedup, dedup_lines, fingerprints, lines_of


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string"), counts=True).collect() == []


def test_a_long_single_line_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"own first\n{passage}\nlast"), (2, f"other\n{passage}"), (3, passage[:60])], "doc_id long, text string")
    got = {x.doc_id: x.text for x in dedup_lines(docs).collect()}
    assert got == {1: f"own first\n{passage}\nlast", 2: "other", 3: passage[:60]}


def brute(rows, least):
    """Every run of at least `least` words, of any length, that equals an earlier one."""
    docs = sorted({(i, t) for i, t in rows if t}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for i, t in docs:
        lines = t.split("\n")
        solid = [p for p, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for at, p in enumerate(solid):
            run, total = (), 0
            for q in solid[at:]:
                run += (lines[q],)
                total += len(lines[q].encode().split())
                if total >= least:
                    if run in seen:
                        gone.update(range(p, q + 1))
                    seen.add(run)
        out[(i, t)] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return [(i, out.get((i, t), t)) for i, t in rows]


@pytest.mark.parametrize("how", [LineDedup(5, 5), LineDedup(5, 5, hot=2, salts=3), LineDedup(3, 7)])
def test_against_all_runs(spark, how):
    r = random.Random(16)
    line = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([0, 0, 1, 2, 3, 8, 11])))
    passages = [[line() for _ in range(r.randrange(1, 12))] for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(passages)
            parts += p[: r.randrange(1, len(p) + 1)] if r.random() < 0.6 else [line() for _ in range(r.randrange(1, 4))]
        rows.append((i, "\n".join(parts)))
    rows += [(300 + i, t) for i, t in enumerate(["one two three four five six seven eight nine ten eleven\n\n" * 2 + "x", "y\none two three four five six seven eight nine ten eleven\n\none two three four five six seven eight nine ten eleven\n\nz"])]
    rows += [(None, "a b c d e f g h i j k\nl")] * 40
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[3][1]), (203, rows[3][1]), (None, rows[5][1]), (204, "\n".join(["one two three"] * 30))]
    docs = spark.createDataFrame([(k, t, i) for k, (i, t) in enumerate(rows)], "key int, text string, doc_id long")
    got = {x.key: (x.doc_id, x.text) for x in dedup_lines(docs, how).collect()}
    want = brute(rows, 10)
    for k, (i, t) in enumerate(want):
        assert got[k] == (i, t), rows[k]


def test_the_last_lines_of_a_repeat_go(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 30), ("b", 30), ("c", 3)))
    long, tail = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("l", 60), ("t", 20)))
    # 3 goes on like 2 where 1 doesn't.
    texts = {1: f"{a}\n{b}\nfirst end", 2: f"{a}\n{b}\n{c}\nown", 3: f"{a}\n{b}\n{c}\nother", 4: f"{long}\n{tail}", 5: f"{long}\n{tail}\nlast"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.text for x in dedup_lines(docs).collect()}
    assert got == {1: texts[1], 2: f"{c}\nown", 3: "other", 4: texts[4], 5: "last"}


def test_fingerprints_carry_the_result(spark, monkeypatch):
    passage = "\n".join(" ".join(f"p{j}_{i}" for i in range(12)) for j in range(8))
    docs = spark.createDataFrame([(1, f"own\n{passage}"), (2, f"{passage}\nlast")], "doc_id long, text string")
    assert [x.text for x in dedup_lines(docs).orderBy("doc_id").collect()] == [f"own\n{passage}", "last"]
    chosen = fingerprints(lines_of(docs), LineDedup()).filter("print is not null").select("key", "print.pos").distinct()
    assert 0 < chosen.count() < 16
    monkeypatch.setattr(line_dedup, "fingerprints", lambda lines, how: fingerprints(lines, how).withColumn("print", F.when(F.lit(False), F.col("print"))))
    assert [x.text for x in dedup_lines(docs).orderBy("doc_id").collect()][1] != "last"
