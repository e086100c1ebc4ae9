"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at unit borders, and put together in another order.

A unit is a run of white space with the word that follows it, or the white space that ends the text; by characters every code
point is one. `regex` finds the units, and only their end offsets are kept, in an array of 32-bit
numbers; two look-ups in it slice the text. The first four 32-bit numbers of sha256("seed:doc_id") settle the two cuts, whether the document is
changed at all, and the order of the parts:

    psm  <P>prefix<S>suffix<M>middle        spm  <S>suffix<P>prefix<M>middle        plain  the text as it is

A cut lies after 0 to n units, so each part may be empty. Texts that hold a sentinel stay plain, since they could not be taken apart again. No sentinel's
end is a sentinel's beginning, so the first find of each in an output is where it was put: `restored` is exact.

Defined results: a null text is an empty one, and empty texts are plain. A null doc_id has the seed text of its empty
name ("42:"); rows of equal doc_id are cut by equal numbers. Rows stay as many as they are, in their partitions: nothing is
shuffled. Extra columns are ignored. A task holds an Arrow batch of texts and 4 bytes a unit of one text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNITS = {
    "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "characters": r"(?s:.)",
}
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Infill:
    seed: int = 42
    percent: int = 50  # of the documents change
    spm_percent: int = 80  # of these are in spm order, the others in psm order
    units: str = "words"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or "" in marks:
            raise ValueError("three different sentinels are needed")
        for a in marks:
            for b in marks:
                if any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError(f"{a!r} and {b!r} overlap: outputs could not be taken apart")


def ends_of(text: str, units: str = "words") -> array:
    """Where each unit of a text ends, in code points."""
    return array("I", [m.end() for m in regex.finditer(UNITS[units], text)])


def numbers(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def cut(doc_id: int | None, text: str, how: Infill = Infill()) -> tuple:
    """The fields of SCHEMA for one text."""
    ends = ends_of(text, how.units)
    n = len(ends)
    h1, h2, h3, h4 = numbers(doc_id, how.seed)
    if not text or h3 % 100 >= how.percent or any(mark in text for mark in (how.prefix, how.suffix, how.middle)):
        return n, "plain", None, None, text, sha256(text)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.spm_percent:
        form, output = "spm", f"{how.suffix}{suffix}{how.prefix}{prefix}{how.middle}{middle}"
    else:
        form, output = "psm", f"{how.prefix}{prefix}{how.suffix}{suffix}{how.middle}{middle}"
    return n, form, a, b - a, output, sha256(output)


def restore(output: str, form: str, how: Infill = Infill()) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    first, second = (how.prefix, how.suffix) if form == "psm" else (how.suffix, how.prefix)
    head, _, middle = output.removeprefix(first).partition(how.middle)
    a, _, b = head.partition(second)
    return a + middle + b if form == "psm" else b + middle + a


def infilled(doc_id: Column, text: Column, how: Infill = Infill()) -> Column:
    """A struct of n, form, prefix_chars, middle_chars, output and output_sha256."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [cut(None if d == "" else int(d), t, how) for d, t in zip(ids, texts)]
            made = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # As text, since pandas has no integer column with nulls of its own.
    return run(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))


def restored(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The original text of an output."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([restore(o, f, how) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def infill(docs: DataFrame, how: Infill = Infill()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256 of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), infilled(F.col("doc_id"), F.col("text"), how).alias("x"))
    return rows.select("doc_id", "x.*")
