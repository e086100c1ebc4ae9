import hashlib
import random

import numpy as np

from lumenloom.llm.fingerprint import Fingerprint, _factors, fingerprint, fingerprints, hexes, likeness, numbered_kmers, with_edits

HOW = Fingerprint()


def print_of(text):
    return fingerprint(text.encode(), HOW, _factors(HOW.m))


def plain(text):
    """The same selection, one k-mer at a time."""
    data = text.encode()
    if not data:
        return [()] * HOW.m
    x = numbered_kmers(data).tolist()
    out = []
    for f in _factors(HOW.m).tolist():
        best = sorted(range(len(x)), key=lambda i: (x[i] * f % 2**64, i))[: HOW.l]
        out.append(tuple(x[i] for i in sorted(best)))
    return out


def test_repeats_are_numbered_in_order():
    data = b"abcdefgh" * 3 + b"zz"
    x = numbered_kmers(data)
    assert len(set(x.tolist())) == len(x)
    one, two = numbered_kmers(b"abcdefgh" * 2), numbered_kmers(b"abcdefgh" * 3)
    assert (two[: len(one)] == one).all()


def test_parts_agree_exactly_where_the_selected_tuples_do():
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 9, 40, 300, 2000)] + ["x", "", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    for a in texts:
        for b in texts:
            same = [p == q for p, q in zip(plain(a), plain(b))]
            assert (print_of(a) == print_of(b)).tolist() == same


def test_order_matters():
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    a, b = " ".join(words), " ".join(words[200:] + words[:200])
    assert likeness(print_of(a), print_of(a)) == 1
    assert likeness(print_of(a), print_of(b)) < 0.9
    near = " ".join([*words[:200], "changed", *words[201:]])
    assert likeness(print_of(a), print_of(near)) > likeness(print_of(a), print_of(b))


def test_with_edits_against_a_plain_loop(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"wörd{r.randrange(50)}" for _ in range(r.randrange(0, 60)))) for i in r.sample(range(1000), 60)]
    rows += [(5000, None), (5001, ""), (5002, "tie"), (5002, "tie b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    got = sorted(tuple(x) for x in with_edits(docs, Fingerprint(part_docs=9)).collect())
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = print_of(t), print_of(edited), print_of(nxt)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(a), hexes(b), likeness(a, b), likeness(a, c)))
    assert got == sorted(want)


def test_odd_tables(spark):
    one = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    assert with_edits(one).collect()[0].near_next == 1.0
    assert with_edits(one.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (3, "cc dd")], "doc_id long, text string")
    assert len(with_edits(nulls).collect()) == 3
    assert fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("fingerprint").distinct().count() == 1
    assert np.all(print_of("") == 0)
