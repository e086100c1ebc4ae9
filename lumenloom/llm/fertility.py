"""Quality by tokeniser fertility.

Public vocabularies measure every text: characters per token, the share of byte-fallback tokens (tokens that
are not whole UTF-8 characters) and token entropy (of the text's own token distribution, as a share of
the most that so many tokens can have). Prose of a language stays in narrow bands of these; junk
(noise, lists of symbols, other scripts, broken encodings, repetition) leaves them.

Bands hold for one language and one power of two of words: the median plus and minus `widths` times the distance to the
quartiles (and at least `slack` of the median, more for short texts), over all documents that pass the base
rules; junk that is less than a quarter of them can't stretch its own band much. A group of n documents counts n parts
against `prior_rows` parts of what its language says, a language in the same way against all documents, and those against
the prior bands of the settings, for Latin and for other scripts (told by bytes per character). So bands of small
groups and small tables lean on wider ones, at every size by the same rule.

Base measures of the whole text are reported beside the verdict. Defined results: null text has no words.
A null lang is a language of its own, apart from any string. Rows are judged by themselves, so ties and repeats don't matter; extra columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, small_batches, words_of
from .tokens import joint, public_path, public_pattern, vocabulary

_M = np.uint64(0x9E3779B97F4A7C15)
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_token", "fallback_share", "entropy")


@dataclass(frozen=True)
class Fertility:
    vocabularies: tuple[str, ...] = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
    folder: str | None = None  # of the vocabulary files; the public ones by default
    widths: float = 5.0
    slack: float = 0.06
    short_slack: float = 0.4
    prior_rows: float = 25.0
    #: Lowest and highest value of each measure where nothing else is known.
    latin: tuple[tuple[float, float], ...] = ((1.6, 6.5), (0.0, 0.2), (0.55, 1.0))
    other: tuple[tuple[float, float], ...] = ((0.3, 6.5), (0.0, 0.98), (0.4, 1.0))
    latin_bytes: float = 1.35  # bytes per character under which a text is Latin
    min_words: int = 10
    max_repeat_percent: int = 20


@lru_cache(maxsize=4)
def _fallback(path: str, pattern: str) -> np.ndarray:
    """Which ids are not whole characters."""
    ranks = vocabulary(path, pattern).ranks
    out = np.zeros(max(ranks.values()) + 1, bool)
    for token, i in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            out[i] = True
    return out


def repeated_words(h: np.ndarray, k: int = 5) -> int:
    """Words in k-word windows that the text has twice or more."""
    n = len(h) - k + 1
    if n < 2:
        return 0
    x = h[:n].copy()
    for i in range(1, k):
        x *= _M
        x += h[i : i + n]
    mix64(x)
    order = np.argsort(x)
    run = x[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + k, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + k, -1)
    return int((np.cumsum(edge)[: len(h)] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def token_measures(ids: np.ndarray, chars: int, fallback: np.ndarray, starts: Sequence[int] = (0,)) -> tuple[float, ...]:
    """The three measures of each vocabulary; its ids go from its start to the next one's. The ids' order doesn't matter."""
    values, counts = np.unique(ids, return_counts=True)
    out: tuple[float, ...] = ()
    for a, b in pairwise([*np.searchsorted(values, np.asarray(starts, values.dtype)).tolist(), len(values)]):
        n = int(counts[a:b].sum())
        if n:
            share = counts[a:b] / n
            entropy = float(-(share * np.log2(share)).sum()) / max(np.log2(n), 1.0)
            out += chars / n, int(counts[a:b][fallback[values[a:b]]].sum()) / n, entropy
        else:
            out += 0.0, 0.0, 0.0
    return out


def measure(docs: DataFrame, how: Fertility = Fertility()) -> DataFrame:
    """doc_id, lang, the base measures, and three measures for each vocabulary; a row for each row."""
    small_batches(docs.sparkSession)
    pattern = public_pattern()
    paths = tuple(f"{how.folder}/{v}" if how.folder else public_path(v) for v in how.vocabularies)
    base = ["chars", "bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fertility = [f"{m}_{i}" for i in range(len(paths)) for m in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fallback = joint(paths, pattern), np.concatenate([_fallback(p, pattern) for p in paths])
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                text = text or ""
                words = words_of(text)
                h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # only compared within the text
                row: list = [len(text), len(text.encode("utf-8", "surrogatepass")), len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(h)]
                row += token_measures(ids.of(text), len(text), fallback, ids.starts)
                rows.append(row)
            cols = list(zip(*rows)) or [[]] * (len(base) + len(fertility))
            arrays = [pa.array(c, pa.int64()) for c in cols[: len(base)]] + [pa.array(c, pa.float64()) for c in cols[len(base) :]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "lang", *base, *fertility])

    schema = ", ".join(["doc_id long, lang string", *[f"{b} long" for b in base], *[f"{f} double" for f in fertility]])
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def judge(docs: DataFrame, how: Fertility = Fertility()) -> DataFrame:
    """The measures with base_failed and kept."""
    rows = measure(docs, how)
    names = [c for c in rows.columns if c.rpartition("_")[0] in MEASURES]
    failed = (F.col("n_words") < how.min_words) | (100 * F.col("n_repeat_words") > how.max_repeat_percent * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed).withColumn("size", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")), "fertility")
    # One pass: quartiles of (lang, size), of lang, and of everything. Null languages count as one, told apart by `group`.
    rows = rows.withColumn("group", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    levels = rows.filter(~F.col("base_failed")).rollup("group", "size").agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in names])
    named = lambda to: {c: f"{c}_{to}" for c in ("n", *names)}
    bands = levels.filter("size is not null").withColumnsRenamed(named("b"))
    langs = levels.filter("size is null and group is not null").withColumnsRenamed(named("l")).drop("size")
    whole = levels.filter("group is null").withColumnsRenamed(named("a")).drop("group", "size")
    joined = rows.join(bands, ["group", "size"], "left").join(langs, "group", "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    # A short text varies more.
    slack = how.slack + how.short_slack / F.sqrt(F.greatest("n_words", F.lit(1)))
    is_latin = F.col("bytes") < how.latin_bytes * F.col("chars")
    inside = F.lit(True)
    for c in names:
        measure_number = MEASURES.index(c.rpartition("_")[0])
        low, high = (F.when(is_latin, how.latin[measure_number][i]).otherwise(how.other[measure_number][i]) for i in (0, 1))
        for level in "alb":
            q, n = F.col(f"{c}_{level}"), F.coalesce(f"n_{level}", F.lit(0))
            share = n / (n + how.prior_rows)
            own_low = q[1] - F.greatest(how.widths * (q[1] - q[0]), slack * q[1])
            own_high = q[1] + F.greatest(how.widths * (q[2] - q[1]), slack * q[1], slack)
            low, high = F.coalesce(share * own_low + (1 - share) * low, low), F.coalesce(share * own_high + (1 - share) * high, high)
        inside &= F.col(c).between(low, high)
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *names, "base_failed", "kept")
