"""Greedy packing of text into pieces of a token budget, as a fold over arrays in the row: no Python worker, no shuffle.

A text is taken apart into atoms: its paragraphs, and in place of a paragraph over the budget its sentences, in place of a sentence over it its clauses, and of a clause its
words. Atoms have the place of what they are parts of as a key. Neighbours of one key are joined as long as the budget holds; another key begins a new piece."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python takes for white space: as a class of the JVM's patterns, and its characters.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A sentence ends in . ! or ? before white space, but not after e.g. or i.e.
SENTENCE = rf"(?<=[.!?])(?<!e\.g\.)(?<!i\.e\.){SPACE}+"
CLAUSE = rf"(?<=[,;:]){SPACE}+"
PARAGRAPH = rf"\n{SPACE}*\n"


def token_count(text: Column) -> Column:
    """As many as text.token_count says, without an array of them: each token with what is before it becomes its first letter. What is behind the
    last one goes in one match too, so that long text without letters isn't searched again from each of its places."""
    return F.length(F.regexp_replace(text, r"\P{Alpha}*+(?:(\p{Alpha})[\w-]*|\z)", "$1"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _counted(parts: Column) -> Column:
    """array<struct<t, n>>: texts and their token counts, each counted once."""
    return F.transform(parts, lambda t: F.struct(t.alias("t"), token_count(t).alias("n")))


def _atom(p: Column, key: Column) -> Column:
    return F.struct(p["t"].alias("t"), p["n"].alias("n"), key.alias("k"))


def _atoms(counted: Column, limit: int, key: Column, finer: Callable[[Column, Column], Column]) -> Column:
    """Atoms of counted parts under a key; a part over the limit gives way to its finer atoms, under a key of its own."""
    return F.flatten(F.transform(counted, lambda p, i: F.when(p["n"] <= limit, F.array(_atom(p, key))).otherwise(finer(p["t"], F.concat(key, F.lit("."), i.cast("string"))))))


def _words(text: Column, key: Column) -> Column:
    words = F.filter(F.split(text, rf"{SPACE}+", -1), lambda w: w != "")
    return F.transform(_counted(words), lambda p: _atom(p, key))


def _clauses(text: Column, key: Column, limit: int) -> Column:
    """By clauses if there are several, else by words."""
    return _with(F.split(text, CLAUSE, -1), lambda parts: F.when(F.size(parts) > 1, _atoms(_counted(parts), limit, key, _words)).otherwise(_words(text, key)))


def _sentences(counted: Column, key: Column, limit: int) -> Column:
    """By sentences if there are several, else by clauses."""
    finer = lambda t, k: _clauses(t, k, limit)
    return F.when(F.size(counted) > 1, _atoms(counted, limit, key, finer)).otherwise(_clauses(counted[0]["t"], key, limit))


def _paragraph(text: Column, i: Column, limit: int) -> Column:
    """Atoms of a paragraph. Its tokens are counted once, by sentences where there can be too many: cuts at white space part no token, so the counts add up."""
    parts = F.when(F.length(text) > 2 * limit, F.split(text, SENTENCE, -1)).otherwise(F.array(text))
    whole = lambda n: F.array(F.struct(text.alias("t"), n.alias("n"), F.lit("").alias("k")))
    total = lambda counted: F.aggregate(counted, F.lit(0), lambda n, p: n + p["n"])
    key = F.concat(F.lit("."), i.cast("string"))
    return _with(_counted(parts), lambda counted: _with(total(counted), lambda n: F.when(n <= limit, whole(n)).otherwise(_sentences(counted, key, limit))))


def _fold(atoms: Column, limit: int) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"), F.lit("").alias("k"))

    def step(s: Column, a: Column) -> Column:
        ends = s["held"].isNotNull() & ((s["k"] != a["k"]) | (s["n"] + a["n"] > limit))
        fresh = s["held"].isNull() | ends
        joiner = F.when(a["k"] == "", "\n\n").otherwise(" ")
        return F.struct(
            F.when(ends, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]).alias("out"),
            F.when(fresh, a["t"]).otherwise(F.concat(s["held"], joiner, a["t"])).alias("held"),
            F.when(fresh, a["n"]).otherwise(s["n"] + a["n"]).alias("n"),
            a["k"].alias("k"),
        )

    return F.aggregate(atoms, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def paragraphs(text: Column, limit: int = 400) -> Column:
    """array<string>: the paragraphs (between blank lines) packed into pieces of at most `limit` tokens."""
    parts = F.filter(F.transform(F.split(stripped(F.coalesce(text, F.lit(""))), PARAGRAPH, -1), stripped), lambda p: p != "")
    return _fold(F.flatten(F.transform(parts, lambda t, i: _paragraph(t, i, limit))), limit)
