import hashlib
import random
import re

import duckdb
import pytest

from lumenloom.llm import infill, queries

SCHEMA = "doc_id long, text string"


def plain_cut(doc_id, text):
    """The contract, written a second way: tokens as a list, parts by joining them."""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    odd = ["", " ", "\n\n", "a", " a", "a ", " x y z", "a<P>b", "<", "<M", "x < S>", "<S", "P> <", "é \U0001f600\U0001f600 \t end \x0b\x0c", "\x1c\x85 q", "0" * 70_000, "ab " * 40_000]
    made = ["".join(r.choice("ab <>PSM\n\té😀") for _ in range(r.randrange(60))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(odd * 12 + made)]


def test_against_a_plain_version(spark, rows):
    docs = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", n long")  # `n` clashes
    got = {g.doc_id: g for g in infill.infill(docs).collect()}
    forms = set()
    for doc_id, text in rows:
        g = got[doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars, g.output) == plain_cut(doc_id, text)
        assert g.output_sha256 == hashlib.sha256(g.output.encode()).hexdigest()
        forms.add(g.form)
    assert forms == {"plain", "psm", "spm"}


def test_round_trip(spark, rows):
    for how in (infill.Infill(percent=100), infill.Infill(seed=7, percent=90, spm_percent=30, units="characters", prefix="[pre]", suffix="[suf]", middle="[mid]")):
        docs = spark.createDataFrame(rows, SCHEMA)
        made = infill.infill(docs, how)
        back = made.select("doc_id", infill.restored(made["output"], made["form"], how).alias("text"))
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, None), (3, None)], SCHEMA)
    got = infill.infill(docs).collect()
    assert len(got) == 4 and {(g.doc_id, g.n) for g in got} == {(None, 3), (3, 0)}
    assert len({g.output for g in got if g.doc_id is None}) == 1
    assert all(g.form == "plain" and g.output == "" and g.prefix_chars is None for g in got if g.doc_id == 3)
    assert infill.infill(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sentinels_that_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("", "b", "c"), ("abc", "b", "x"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            infill.Infill(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_query_equals_its_sql(spark, rows, tmp_path):
    spark.createDataFrame([*rows, (-3, "minus three is a number too"), (10**15, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {names} from ({queries.ORACLES['op11_fill_in_middle']})").fetchall())
