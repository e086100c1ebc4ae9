"""Document fingerprints by order min-hash.

A k-mer is `k` successive bytes of a text in UTF-8 with the number of its occurrences before it in
the text, so repeated k-mers differ. Each of `m` hash functions selects the `l` k-mers of smallest hash;
they keep their order in the text, and a hash of that tuple is one part of the fingerprint. Parts of two
fingerprints agree with a chance that falls with the edit distance: edits change k-mers, moves
change their order. Likeness is the share of equal parts.

Defined results: a text shorter than k is one k-mer, padded; null and empty texts have the
fingerprint of the empty text and are wholly alike. Equal texts have equal fingerprints. The whole
text counts. In `with_edits` rows of equal doc_id are ordered by text, null doc_ids come last, a single row
is followed by itself; extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts_for, range_bounds, range_part, small_batches

@dataclass(frozen=True)
class Fingerprint:
    k: int = 8  # bytes: a k-mer is one 64-bit number
    m: int = 32
    l: int = 2  # noqa: E741
    part_docs: int = 1000


def _factors(m: int) -> np.ndarray:
    random = np.random.RandomState(7)
    return random.randint(0, 2**62, m).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def numbered_kmers(data: bytes) -> np.ndarray:
    """A hash of each 8-byte k-mer and the number of its earlier occurrences, in text order."""
    if len(data) < 8:
        data = data.ljust(8, b"\0")
    x = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    order = np.argsort(x)
    run = x[order]
    new = np.empty(len(run) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(run[1:], run[:-1], out=new[1:-1])
    repeated = np.flatnonzero(~(new[:-1] & new[1:]))
    mix64(x)
    if len(repeated):
        # Within a group of equal k-mers by position: sorted by group and position in one number.
        group = np.cumsum(new[:-1])[repeated]
        placed = np.sort(group * len(x) + order[repeated])
        starts = np.flatnonzero(np.diff(placed // len(x), prepend=-1))
        nth = np.arange(len(placed)) - np.repeat(starts, np.diff(np.append(starts, len(placed))))
        x[placed % len(x)] += nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(x)


def fingerprint(data: bytes, how: Fingerprint, factors: np.ndarray) -> np.ndarray:
    """m parts of 32 bits."""
    if not data:
        return np.zeros(how.m, np.uint32)
    x, l = numbered_kmers(data), how.l  # noqa: E741
    n = len(x)
    # Few values lie under the ceiling; where fewer than l do, all are looked at.
    ceiling = np.uint64(min(2**64 - 1, 2**64 // n * (4 * l + 8)))
    rows, at, low = [], [], []
    for i in range(0, n, 4096):
        h = x[None, i : i + 4096] * factors[:, None]
        r, c = np.nonzero(h < ceiling)
        rows.append(r)
        at.append(c + i)
        low.append(h[r, c])
    r, c, v = np.concatenate(rows), np.concatenate(at), np.concatenate(low)
    order = np.lexsort((c, v, r))
    starts = np.searchsorted(r[order], np.arange(how.m + 1))
    picked = np.zeros((how.m, l), np.uint64)
    if (np.diff(starts) >= l).all():
        picked = x[np.sort(c[order][starts[:-1, None] + np.arange(l)], axis=1)]
    else:
        for j in range(how.m):
            best = np.sort(np.argsort(x * factors[j], kind="stable")[:l])
            picked[j, : len(best)] = x[best]
    out = np.arange(1, how.m + 1, dtype=np.uint64)
    for i in range(l):
        out = mix64((out + picked[:, i]) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (out >> np.uint64(32)).astype(np.uint32)


def hexes(parts: np.ndarray) -> str:
    return parts.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, how: Fingerprint = Fingerprint()) -> DataFrame:
    """doc_id, fingerprint."""
    small_batches(docs.sparkSession)
    factors = _factors(how.m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hexes(fingerprint((t or "").encode("utf-8", "surrogatepass"), how, factors)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_edits(docs: DataFrame, how: Fingerprint = Fingerprint()) -> DataFrame:
    """Each text beside an edited one: its last half replaced by as much of the beginning of the next
    document, by descending doc_id, the first following the last.

    Documents move once, to ranges of doc_id, each of which also gets the document that follows its last; so
    every task finds all neighbours it needs, and each text is fingerprinted once as itself."""
    spark = docs.sparkSession
    small_batches(spark)
    factors = _factors(how.m)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ends = texts.agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    parts = parts_for(spark, ends["n"], how.part_docs)
    bounds = range_bounds(texts, "doc_id", parts)
    # Range p holds ids over bound p - 1 up to bound p. By descending id, bound p - 1 (the largest id of range p - 1) follows
    # range p; the largest id of all follows the last range, that of nulls if there are any.
    own = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_part(F.col("doc_id"), bounds))
    is_bound = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    lowest = F.lit(-1 if ends["nulls"] else 0)
    places = [F.struct(own.cast("int").alias("part"), F.lit(0).alias("guest"))]
    places.append(F.when(is_bound, F.struct((own + 1).cast("int").alias("part"), F.lit(1).alias("guest"))))
    first_id = F.lit(ends["last"]).cast("long")
    places.append(F.when(F.col("doc_id").eqNullSafe(first_id), F.struct(lowest.cast("int").alias("part"), F.lit(2).alias("guest"))))
    if ends["nulls"]:  # nulls follow the smallest id
        head = texts.filter("doc_id is null").agg(F.min("text")).first()[0]
        if ends["last"] is not None:
            places.append(F.when(F.col("doc_id").isNull() & (F.col("text") == head), F.struct(F.lit(0).alias("part"), F.lit(1).alias("guest"))))
    dealt = texts.withColumn("place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull()))).select("place.part", "place.guest", "doc_id", "text")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # part, doc_id, text, fingerprint of the row that waits for its successor
        out: list[tuple] = []

        def pair(a: tuple, text: str, data: np.ndarray) -> None:
            n = len(a[2])
            half = n // 2
            # As many code points of the next text as are replaced, or all it has.
            edited = (a[2][: n - half] + text[:half]).encode("utf-8", "surrogatepass")
            other = fingerprint(edited, how, factors)
            out.append((a[1], n, hashlib.sha256(edited).hexdigest(), hexes(a[3]), hexes(other), likeness(a[3], other), likeness(a[3], data)))

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            rows = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        for batch in batches:
            for part, visits, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if before is not None and before[0] != part:
                    before = None  # its successor came as a guest
                if visits and before is None:
                    continue
                mine = fingerprint(text.encode("utf-8", "surrogatepass"), how, factors)
                if before is not None:
                    pair(before, text, mine)
                before = None if visits else (part, doc_id, text, mine)
            yield emit()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
