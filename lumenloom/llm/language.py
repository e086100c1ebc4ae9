"""Language identification of spans: script ranges, word scores, and a Viterbi path over the words.

A word is a letter with the letters and marks that follow it. Its script, the range its first letter lies in, leaves as candidates the
languages in which the script makes up `script_share` of the training letters or more; where there are none, all languages. The score of a word in a
language is the sum of log chances of its character n-grams (1 to `order`, with the word's borders), scaled to one chance a
character and bounded to `bound` below the best candidate's, so that a strange word can't decide alone. The Viterbi path gives each word a language: it has the
largest sum of scores less `penalty` for every switch. Successive words of one language are a span.

The text's language is the one with most letters in the spans. Its score is the share of these letters times 1 / (1 + exp(-lead)), where lead
is by how much the spans' words fit it better than the next best language, in sum: near 1 for long texts in one language, about a half for a word that fits two.

Most texts stay with one language. That is proven without the path: where no run of words gains more than half the penalty in any other language than the text's
best, every path with switches loses. Other texts take the path word by word. Both give the same spans.

Fitting counts the n-grams of at most `max_texts` different texts of each of at most `max_langs` languages (those of the smallest hashes of the text, so at random), by hashes of 2 ** `bits` values: at most
2 ** bits counts a language reach the driver, and as many numbers are broadcast. A task holds a block of 2 ** 18 characters with its n-grams at
once, and of a long text only its words' scores.

Defined results: texts that are null or have no letter are `und`, with score 0 and no spans; so is every text where no training text has a language. Equal scores go to the
language first by code point. Repeated rows get equal results, null doc_ids too; extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, small_batches

SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"

#: First and last code point of the blocks of each script.
SCRIPTS = (
    ("latin", 0x0041, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F), ("han", 0x20000, 0x323AF),
)
#: Numbers of the scripts from 1; 0 is any other.
SCRIPT_IDS = {name: i + 1 for i, name in enumerate(dict.fromkeys(s[0] for s in SCRIPTS))}

BLOCK = 1 << 18


@dataclass(frozen=True)
class Language:
    order: int = 4  # longest n-gram
    bits: int = 17
    max_texts: int = 1000  # fitted on, a language
    max_langs: int = 256  # more are an error
    script_share: float = 0.005
    bound: float = 8.0
    penalty: float = 16.0


@dataclass
class Model:
    """Languages by code point; log chances by n-gram hash and language; which scripts each language has."""

    how: Language
    langs: list[str]
    scores: np.ndarray  # float32, 2 ** bits x languages
    scripts: np.ndarray  # bool, scripts + 1 x languages


@dataclass
class Characters:
    """Kinds of code points: 1 letter, 2 mark, 0 other; scripts by number. Made once in each worker."""

    kind: np.ndarray = field(default_factory=lambda: np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x32400)), np.uint8, 0x32400))
    script: np.ndarray = field(default_factory=lambda: _script_table(0x32400))

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        return self.kind[np.minimum(codes, len(self.kind) - 1)]

    def scripts(self, codes: np.ndarray) -> np.ndarray:
        return self.script[np.minimum(codes, len(self.script) - 1)]


def _script_table(size: int) -> np.ndarray:
    table = np.zeros(size, np.uint8)
    for name, first, last in SCRIPTS:
        table[first : last + 1] = SCRIPT_IDS[name]
    table[size - 1] = 0  # stands for all code points beyond
    return table


_held: list[Characters] = []


def characters() -> Characters:
    if not _held:
        _held.append(Characters())
    return _held[0]


def lowered(text: str) -> str:
    """Lower case, with as many code points as the text has."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words_in(codes: np.ndarray, chars: Characters) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among code points."""
    kinds = chars.kinds(codes)
    inside = kinds == 1
    if (kinds == 2).any():  # marks go on with a word, and don't begin one
        index = np.where(kinds != 2, np.arange(len(kinds)), 0)
        inside |= (kinds == 2) & (kinds[np.maximum.accumulate(index)] == 1)
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, how: Language) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: their hashes of `bits` bits in word order, and how many each word has. A word is looked at with a border on each side."""
    lengths = ends - starts + 2
    firsts = np.cumsum(lengths) - lengths
    padded = np.zeros(int(lengths.sum()), np.uint64)
    at = np.arange(len(padded)) - np.repeat(firsts, lengths)  # place within the word
    inner = (at > 0) & (at < np.repeat(lengths, lengths) - 1)
    padded[inner] = codes[(np.repeat(starts, lengths) + at - 1)[inner]]
    room = np.repeat(lengths, lengths) - at
    rolled = padded + np.uint64(1)
    for n in range(1, how.order + 1):
        if n > 1:
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + padded[n - 1 :] + np.uint64(n)
        fits = room[: len(rolled)] >= n
        if n == 1:
            fits &= inner
        yield mix64(rolled[fits]) >> np.uint64(64 - how.bits), np.maximum(lengths - n + 1, 0) - (2 if n == 1 else 0)


def word_scores(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model, chars: Characters) -> np.ndarray:
    """words x languages: how far below the best candidate each language is, from -bound to 0."""
    total = np.zeros((len(starts), len(model.langs)), np.float32)
    for hashes, counts in grams(codes, starts, ends, model.how):
        some = counts > 0
        begins = (np.cumsum(counts) - counts)[some]
        if len(begins):
            total[some] += np.add.reduceat(model.scores[hashes], begins, axis=0)
    total /= np.float32(model.how.order)
    allowed = model.scripts[chars.scripts(codes[starts])]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    total[~allowed] = -np.inf
    total -= total.max(axis=1, keepdims=True)
    return np.maximum(total, np.float32(-model.how.bound))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word: of all paths that with the largest sum less penalties, the first language among equals."""
    n, many = scores.shape
    sums = scores.sum(axis=0, dtype=np.float64)
    best = int(sums.argmax())
    gains = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    lows = np.minimum.accumulate(np.vstack([np.zeros((1, many)), gains[:-1]]), axis=0)
    if (gains - lows).max() <= penalty / 2:
        return np.full(n, best, np.int32)
    # Word by word: each language's best path, and where it came from.
    came = np.zeros((n, many), np.int32)
    rows = scores.astype(np.float64).tolist()
    path = rows[0]
    stay = np.arange(many)
    for t in range(1, n):
        top = max(path)
        first, floor = path.index(top), top - penalty
        row = rows[t]
        if min(path) >= floor:
            path = [p + s for p, s in zip(path, row)]
            came[t] = stay
        else:
            came[t] = [i if p >= floor else first for i, p in enumerate(path)]
            path = [(p if p >= floor else floor) + s for p, s in zip(path, row)]
    out = np.empty(n, np.int32)
    out[-1] = path.index(max(path))
    for t in range(n - 1, 0, -1):
        out[t - 1] = came[t, out[t]]
    return out


def pieces_of(text: str) -> Iterator[tuple[int, str]]:
    """A text in pieces of up to BLOCK characters that end between words where they can."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        if end < len(text):
            back = end
            while back > max(at, end - 1000) and (text[back].isalpha() or unicodedata.category(text[back])[0] == "M"):
                back -= 1
            end = back if back > at else end
        yield at, text[at:end]
        at = end


def label(texts: list[str | None], model: Model, chars: Characters) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text. Short texts are scored together, block by block."""
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []

    def flush() -> None:
        joined = code_points(lowered("\n".join(piece for _, _, piece in held)))
        starts, ends = words_in(joined, chars)
        if len(starts):
            scores, at = word_scores(joined, starts, ends, model, chars), 0
            for doc, offset, piece in held:
                a, b = np.searchsorted(starts, (at, at + len(piece)))
                if b > a:
                    found[doc].append((starts[a:b] + (offset - at), ends[a:b] + (offset - at), scores[a:b]))
                at += len(piece) + 1
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for offset, piece in pieces_of(text) if text and model.langs else ():
            if size + len(piece) > BLOCK and held:
                flush()
                size = 0
            held.append((i, offset, piece))
            size += len(piece)
    if held:
        flush()
    return [_verdict(parts, model) for parts in found]


def _verdict(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], model: Model) -> tuple[str, float, list[dict]]:
    if not parts:
        return "und", 0.0, []
    starts, ends, scores = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts))
    path = viterbi(scores, model.how.penalty)
    letters = np.bincount(path, ends - starts, len(model.langs))
    best = int(letters.argmax())
    mine = scores[path == best].sum(axis=0, dtype=np.float64)
    lead = mine[best] - np.delete(mine, best).max() if len(mine) > 1 else np.inf
    score = letters[best] / letters.sum() / (1 + np.exp(-lead))
    borders = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
    spans = [{"start": int(starts[a]), "end": int(ends[b - 1]), "lang": model.langs[path[a]]} for a, b in zip(borders[:-1], borders[1:])]
    return model.langs[best], float(score), spans


def fit(docs: DataFrame, learn: Column, how: Language = Language()) -> Model:
    """A model from the rows of docs with text and lang where `learn` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(learn).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # The smallest hashes: a share by the estimated number of different texts, twice over, then exactly the first ones.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).limit(how.max_langs + 1).collect()}
    if len(counts) > how.max_langs:
        raise ValueError(f"more than {how.max_langs} languages")
    # Settled where a row is read, so that only the sample moves.
    most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * how.max_texts / n) * 2.0**63)])[F.col("lang")] if counts else F.lit(0.0)
    sample = rows.filter(F.shiftrightunsigned("h", 1).cast("double") < most).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h")  # about 2 * max_texts rows
    sample = sample.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= how.max_texts).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = characters()
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = counts.setdefault(lang, np.zeros(1 << how.bits, np.int64))
                seen = scripts.setdefault(lang, np.zeros(len(SCRIPT_IDS) + 1, np.int64))
                for _, piece in pieces_of(text):
                    codes = code_points(lowered(piece))
                    starts, ends = words_in(codes, chars)
                    if len(starts):
                        for hashes, _ in grams(codes, starts, ends, how):
                            np.add.at(mine, hashes, 1)
                        np.add.at(seen, chars.scripts(codes[starts]), ends - starts)
        for lang, mine in counts.items():
            values = np.concatenate([mine, scripts[lang]])
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(values[at], pa.int64())], names=["lang", "at", "n"])

    summed = sample.mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # at most 2 ** bits rows a language, and its scripts
    langs = sorted(set(got.column("lang").to_pylist()))
    size, n_scripts = 1 << how.bits, len(SCRIPT_IDS) + 1
    table = np.zeros((size + n_scripts, len(langs)), np.float64)
    where = {lang: i for i, lang in enumerate(langs)}
    table[got.column("at").to_numpy(), [where[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    counts, scripts = table[:size], table[size:]
    # Half a count for what a language hasn't, of as many n-grams as any language has.
    known = (counts.sum(axis=1) > 0).sum()
    chances = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * known + 1)
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    # An n-gram that no language has says nothing.
    chances[counts.sum(axis=1) == 0] = 0
    return Model(how, langs, chances.astype(np.float32), shares >= how.script_share)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans (start and end in code points, language) of each row. Only texts are looked at; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = characters()
        for batch in batches:
            rows = label(batch.column(1).to_pylist(), shared.value, chars)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that fitting may not learn from: crc32 of doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
