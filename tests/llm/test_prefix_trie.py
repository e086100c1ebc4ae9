import hashlib
import math
import random
import zlib

import duckdb
import pytest

from lumenloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}


def replay(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(math.fmod(c, 100))  # the remainder has the sign of c, as in SQL
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    totals = {}
    for key in sorted(nodes, key=len, reverse=True):
        below = [totals[k] for k in children.get(key, [])]
        own = (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0)
        totals[key] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for key, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(key))))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children.get(key, [])), *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def random_rows(seed, convs, most, kinds):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(0, convs * 3), convs):
        n = r.randrange(most)
        turns = [r.choice([None, *range(6)]) for _ in range(n)]
        rows += [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(kinds)) for t in turns]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [2])
def test_against_plain_versions(spark, seed):
    rows = random_rows(seed, 250, 9, ["a", "b", None, "", "ü😀"]) + [(None, 1, "user", "x"), (7000, 0, "u", "lone"), (-5, 1, "u", "neg")]
    docs = spark.createDataFrame([(*x, "extra") for x in rows], SCHEMA + ", pos string")  # `pos` clashes
    assert rows_of(prefix_trie.prefix_trie(docs)) == plain_trie(sequences(rows))
    small = prefix_trie.Trie(block=3, part_turns=40)  # many blocks and ranges
    assert rows_of(prefix_trie.replayed_trie(docs, small)) == plain_trie(replay(sequences(rows)))


def test_long_chains_and_caterpillars(spark):
    """Copies of one long conversation, and conversations that leave it one by one."""
    long = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(90)]
    convs = {i: long for i in range(3)} | {100 + i: [*long[: 2 * i], ("user", f"own {i}")] for i in range(40)} | {300 + i: long[: 7 * i] for i in range(1, 12)}
    rows = [(c, i, *turn) for c, seq in convs.items() for i, turn in enumerate(seq)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(docs, prefix_trie.Trie(block=16, part_turns=500))) == plain_trie(convs)


def test_odd_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert prefix_trie.prefix_trie(table([])).collect() == [] and prefix_trie.replayed_trie(table([(None, 1, "u", "t")])).collect() == []
    repeated = [(4, 1, "u", "t")] * 3 + [(5, None, None, None)]
    assert rows_of(prefix_trie.prefix_trie(table(repeated))) == plain_trie(sequences(repeated))
    h5 = [(c, i, "u", "x") for c in (1, 3, 101) for i in range(2)]  # no conversation 0: those whose head is longer lose all turns
    want = plain_trie(replay(sequences(h5)))
    assert any(x[1] == 0 and x[3] > 0 for x in want)
    assert rows_of(prefix_trie.replayed_trie(table(h5))) == want


def test_many_ends_come_in_pieces(spark):
    rows = [(c, 0, "u", "same") for c in range(-6000, 6001, 5)]
    got = [r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect() if r.depth == 1]
    assert len(got) == 1 and got[0].ends_sha256 == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()


def test_query_equals_its_sql(spark, tmp_path):
    rows = random_rows(3, 120, 8, ["a", "b", "longer text", None])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    want = con.execute(f"select {names} from ({queries.ORACLES['op13_prefix_trie']})").fetchall()
    assert rows_of(got) == sorted(want, key=str) == plain_trie(replay(sequences(rows)))
