import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from lumenloom.llm.common import WordHash, hashes, words_of
from lumenloom.llm.fertility import duplicate_lines, judge, repeated_words, token_measures


def plain_repeats(words, k=5):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    often = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(k)})


def test_repeated_words_against_a_plain_count():
    r = random.Random(3)
    for n in (0, 3, 5, 6, 30, 200, 900):
        words = [f"w{r.randrange(4)}".encode() for _ in range(n)]
        assert repeated_words(hashes(words, WordHash())) == plain_repeats(words)


def test_duplicate_lines():
    assert duplicate_lines("a\nb\na\n \n \n\na") == 2


def test_entropy():
    cpt, share, entropy = token_measures(np.array([1, 1, 2, 2], np.uint32), 8, np.array([False, True, False]))
    assert (cpt, share, entropy) == (2.0, 0.5, 0.5)


def test_words_split_at_six_spaces_only():
    assert words_of("a\u00a0b\x1fc d\te\v") == ["a\u00a0b\x1fc".encode(), b"d", b"e"]


def test_prose_stays_and_noise_goes(spark):
    r = random.Random(4)
    words = ["".join(r.choice(["the", "er", "on", "an", "re", "in", "ti"]) for _ in range(r.randrange(1, 4))) for _ in range(3000)]
    prose = [(i, " ".join(r.choice(words) for _ in range(100)), "en") for i in range(300)]
    noise = [(1000 + i, " ".join("".join(chr(r.randrange(33, 126)) for _ in range(8)) for _ in range(100)), "en") for i in range(5)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "few words", "en"), (2003, "one two three four five six " * 20, "en")]
    docs = spark.createDataFrame([(*x, 1.0) for x in prose + noise + odd], "doc_id long, text string, lang string, size double")
    got = {x.doc_id: x for x in judge(docs).collect()}
    assert sum(got[i].kept for i, _, _ in prose) >= 299
    assert not any(got[i].kept for i, _, _ in noise + odd)
    assert got[2003].base_failed and got[2003].n_repeat_words == 120 and got[2000].n_words == 0
    assert judge(docs.limit(0)).collect() == []


def test_junk_of_a_tenth_does_not_widen_its_own_band(spark):
    r = random.Random(5)
    words = ["".join(r.choice(["the", "er", "on", "an", "re", "in", "ti"]) for _ in range(r.randrange(1, 4))) for _ in range(3000)]
    text = lambda by: by.join(r.choice(words) for _ in range(100))
    docs = [(i, text(" "), "en") for i in range(270)] + [(1000 + i, text(" | "), "en") for i in range(15)] + [(2000 + i, text("*** "), "en") for i in range(15)]
    got = {x.doc_id: x.kept for x in judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i] for i in range(270)) >= 267
    assert not any(kept for i, kept in got.items() if i >= 1000)


def prose_and_junk(r, n, junk):
    words = ["".join(r.choice(["the", "er", "on", "an", "re", "in", "ti"]) for _ in range(r.randrange(1, 4))) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(100)), "en") for i in range(n)]
    return rows + [(10_000 + i, "*** ".join(r.choice(words) for _ in range(100)), "en") for i in range(junk)]


def test_junk_goes_at_every_table_size(spark):
    r = random.Random(7)
    for n in (5, 20, 48, 52, 200):
        got = {x.doc_id: x.kept for x in judge(spark.createDataFrame(prose_and_junk(r, n, 1), "doc_id long, text string, lang string")).collect()}
        assert not got.pop(10_000) and sum(got.values()) >= n - 1, n
    noise = [(1, " ".join("".join(chr(r.randrange(33, 126)) for _ in range(8)) for _ in range(60)), None)]
    assert not judge(spark.createDataFrame(noise, "doc_id long, text string, lang string")).first().kept


def test_null_language_is_apart_from_any_string(spark):
    r = random.Random(8)
    rows = [(i, t, None) for i, t, _ in prose_and_junk(r, 60, 0)] + [(1000 + i, " ".join(chr(r.randrange(0x4E00, 0x4F00)) * 2 for _ in range(60)), "?") for i in range(60)]
    got = {x.doc_id: x for x in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(x.kept for x in got.values()) >= 118 and got[0].lang is None and got[1000].lang == "?"


BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM docs),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS n FROM p),
m AS (SELECT doc_id, count(DISTINCT i + k) AS repeats FROM g, (VALUES (0), (1), (2), (3), (4)) o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(repeats, 0) AS n_repeat_words,
  len(ws) < 10 OR 100 * coalesce(repeats, 0) > 20 * len(ws) AS base_failed
FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id ORDER BY d.doc_id
"""


def test_base_columns_against_sql(spark):
    r = random.Random(9)
    texts = ["\n".join(" ".join(r.choice(["a", "b", "öé", "c#", "||", "d\u00a0e"]) for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 7))) for _ in range(150)]
    docs = pd.DataFrame([(i, t) for i, t in enumerate([None, "", " \n\t", *texts])], columns=["doc_id", "text"])
    want = duckdb.sql(BASE).fetchall()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = judge(spark.createDataFrame(docs.to_dict("records"), "doc_id long, text string")).select(*names).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == want
