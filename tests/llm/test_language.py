import math
import random

import numpy as np
import pytest

from lumenloom.llm import language, queries

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schn", "ei", "ung", "ö"], "cc": ["ñu", "ella", "ció", "az"], "dd": ["да", "не", "про", "ши"]}


def prose(r, lang, words):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(2, 5))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = [(i, prose(r, lang := r.choice(sorted(SYLLABLES)), r.randrange(1, 80)), lang) for i in range(600)]
    return rows


@pytest.fixture(scope="module")
def model(spark, docs):
    return language.fit(spark.createDataFrame(docs, SCHEMA), ~language.held_out(), language.Language(bits=13))


def test_held_out_accuracy(spark, docs, model):
    df = spark.createDataFrame([(*x, 1.0) for x in docs], SCHEMA + ", score double")  # `score` clashes
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    true = {d: lang for d, _, lang in docs}
    import zlib

    held = [d for d in true if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 100 and sum(got[d].lang_pred == true[d] for d in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    for doc_id, text, _ in docs:
        spans = got[doc_id].spans
        assert spans[0].start == 0 and spans[-1].end == len(text)


def test_mixed_texts_have_spans(spark, model):
    r = random.Random(9)
    mixed = [(a, b, prose(r, a, 40), prose(r, b, 40)) for a, b in [("aa", "bb"), ("cc", "aa"), ("dd", "bb"), ("bb", "cc")]]
    rows = [(i, x + "\n" + y, None) for i, (_, _, x, y) in enumerate(mixed)]
    for got, (a, b, x, y) in zip(sorted(language.identify(spark.createDataFrame(rows, SCHEMA), model).collect()), mixed):
        assert [s.lang for s in got.spans] == [a, b]
        assert abs(got.spans[0].end - len(x)) <= 20 and got.spans[1].end == len(x) + 1 + len(y)
        assert 0.3 < got.score < 0.8


def all_paths(scores, penalty):
    """Viterbi as written in books, every step over all pairs."""
    n, many = scores.shape
    path = [(scores[0][j], (j,)) for j in range(many)]
    for t in range(1, n):
        path = [max(((v - (penalty if p[-1] != j else 0) + scores[t][j], p + (j,)) for v, p in path), key=lambda x: x[0]) for j in range(many)]
    return max(path, key=lambda x: x[0])


def worth(path, scores, penalty):
    return sum(scores[t][j] for t, j in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_path_is_the_best():
    r = np.random.RandomState(3)
    shortcuts = 0
    for _ in range(400):
        n, many, penalty = r.randint(1, 30), r.randint(1, 5), float(r.choice([1, 4, 9, 30]))
        scores = np.maximum(np.round(r.randn(n, many) * 4 + (np.arange(n)[:, None] // 9 % many == np.arange(many)) * r.choice([0, 6]), 2), -20).astype(np.float32)
        best, _ = all_paths(scores.astype(float), penalty)
        got = language.viterbi(scores, penalty).tolist()
        assert math.isclose(worth(got, scores.astype(float), penalty), best, abs_tol=1e-3)
        shortcuts += len(set(got)) == 1
    assert 50 < shortcuts < 390


def test_word_scores_against_a_plain_sum(model):
    chars = language.characters()
    text = language.lowered("Kalo schnei, é́té x 漢字 про")
    codes = language.code_points(text)
    starts, ends = language.words_in(codes, chars)
    words = [text[a:b] for a, b in zip(starts, ends)]
    assert words == ["kalo", "schnei", "é́té", "x", "漢字", "про"]
    got = language.word_scores(codes, starts, ends, model, chars)
    for word, row in zip(words, got):
        one = language.code_points(word)
        alone = language.word_scores(one, np.array([0]), np.array([len(one)]), model, chars)
        assert np.allclose(alone[0], row, atol=1e-4) and row.max() == 0 and row.min() >= -model.how.bound
    assert model.langs[int(got[-1].argmax())] == "dd" and (got[-1] == 0).sum() == 1  # script leaves one language
    n = sum(counts.sum() for _, counts in language.grams(codes, starts, ends, model.how))
    assert n == sum(max(len(w) + 2 - k + 1, 0) - (2 if k == 1 else 0) for w in words for k in range(1, model.how.order + 1))


def test_odd_texts(spark, model):
    long = "kalo " * 120_000  # several blocks
    rows = [(1, None, None), (2, "", None), (3, " 12 ² ... \ń", None), (None, "kalomi tu lomika", None), (None, "kalomi tu lomika", None), (5, long, "bb"), (6, "я", None), (7, "İİ ẞ ", None), (8, "x" * 300_000, None)]
    got = {}
    for r in language.identify(spark.createDataFrame(rows, SCHEMA), model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, round(r.score, 6), len(r.spans)))
    assert got[1] == got[2] == got[3] == [("und", 0.0, 0)]
    assert len(got[None]) == 2 and got[None][0] == got[None][1] and got[None][0][0] == "aa"
    assert got[5] == [("aa", 1.0, 1)] and got[6][0][0] == "dd"
    assert got[7][0][0] in model.langs and len(got[8]) == 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = language.fit(empty, ~language.held_out())
    assert none.langs == [] and language.identify(empty, none).collect() == []
    assert [tuple(r) for r in language.identify(spark.createDataFrame([(1, "some words", None)], SCHEMA), none).collect()] == [(1, "und", 0.0, [])]


def test_a_hot_text_does_not_fill_the_sample(spark):
    r = random.Random(6)
    rows = [(i, "kalo kalo", "aa") for i in range(3000)] + [(5000 + i, prose(r, "bb", 20), "bb") for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), ~language.held_out(), language.Language(bits=12, max_texts=50))
    assert model.langs == ["aa", "bb"]
    assert language.label(["kalo", "schneiung"], model, language.characters())[0][0] == "aa"


def test_query(spark, docs, tmp_path):
    spark.createDataFrame([*docs, (9000, None, "aa"), (9001, "...", None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_language_spans(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs) + 2 and got[9000].lang_pred == got[9001].lang_pred == "und"
    held = [(d, lang) for d, _, lang in docs if got[d].held_out]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.99 * len(held)
