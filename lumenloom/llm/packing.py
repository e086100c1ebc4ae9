"""Hierarchical packing of documents into token windows of several lengths.

A document is its ids and one end id. Whole windows of the longest tier are cut off first; what is
left is routed to the smallest tier (a power of two) that holds it. Each tier is packed by
best fit into windows of its own length. A window that is not quite full is then a gap of a longer
tier: gaps are filled exactly by cutting pieces from the shorter tiers' documents, the shortest
tier first, until no shorter piece is left; what little remains over is packed greedily into
windows of the longest tier. Windows of a shorter tier that are exactly full need no padding, as a
power of two; others are filled up to the longest window.

Rows are dealt to tasks in turn, about `task_docs` to each, so that equal rows and hot keys spread and the result doesn't
hang on the session's number of shuffle partitions. A task packs groups of `group_docs` documents or `group_tokens` tokens
apart from each other: nothing is ordered in one task however large a source is, a task holds one group at a time, and a group leaves one
window at most unfilled. Within a task documents are in order of doc_id and a hash of the text, so a
task that is run again gives the same pieces. Sequences are dealt to training
steps in balance: the longest first, each to the step group with the fewest tokens so far.

Ids are those of the tokenizer file as it is, added tokens such as <|endoftext|> in a text included.

Defined results: null text is an empty text, a document of the end id alone. Rows with equal doc_id are
packed as documents of their own. A null doc_id is packed like others. Extra columns are not
returned. An empty table gives an empty result. Texts of any length are cut into as many windows as they need.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, small_batches
from .tokens import added_tokens, public_path, public_pattern, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group int"


@dataclass(frozen=True)
class Packing:
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    task_docs: int = 750
    group_docs: int = 3000
    group_tokens: int = 1 << 23
    steps: int = 8
    ranks_path: str | None = None  # the public byte_bpe_50k ranks by default
    pattern: str | None = None
    added: tuple[tuple[str, int], ...] | None = None  # that file's added tokens by default

    @property
    def window(self) -> int:
        return self.tiers[-1]


Piece = tuple[int, int, int]  # document, start, length


def pack_lengths(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """Windows (tier, pieces) for documents of these lengths; every id in exactly one piece."""
    window, done = tiers[-1], []
    waiting: list[list[Piece]] = [[] for _ in tiers]  # what each tier still has to pack
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            done.append((window, [(doc, at, window)]))
            at += window
        if n > at:
            waiting[bisect.bisect_left(tiers, n - at)].append((doc, at, n - at))
    # Best fit, the longest first, within each tier.
    gaps: list[tuple[int, int, list[Piece]]] = []  # (free, tier, pieces)
    for t, size in enumerate(tiers):
        open_: list[tuple[int, int]] = []  # (free, number of the bin)
        bins: list[list[Piece]] = []
        for piece in sorted(waiting[t], key=lambda p: (-p[2], p[0])):
            i = bisect.bisect_left(open_, (piece[2], -1))
            if i < len(open_):
                free, b = open_.pop(i)
            else:
                free, b = size, len(bins)
                bins.append([])
            bins[b].append(piece)
            if free > piece[2]:
                bisect.insort(open_, (free - piece[2], b))
            else:
                done.append((size, bins[b]))
        gaps += [(free, t, bins[b]) for free, b in open_]
    # Gaps, the longest tier first, are filled from the windows at the other end, the shortest tier's:
    # those are taken apart and their pieces cut to fit. One window at most stays unfilled.
    gaps.sort(key=lambda g: (-g[1], g[0], g[2][0]))
    front, back = 0, len(gaps) - 1
    while front < back:
        free, t, pieces = gaps[front]
        source = gaps[back][2]
        if not free:
            done.append((tiers[t], pieces))
            front += 1
        elif not source:
            back -= 1
        else:
            doc, at, n = source.pop()
            cut = min(free, n)
            pieces.append((doc, at, cut))
            if cut < n:
                source.append((doc, at + cut, n - cut))
            gaps[front] = (free - cut, t, pieces)
    if front == back and gaps[front][2]:
        free, t, pieces = gaps[front]
        done.append((tiers[t] if sum(p[2] for p in pieces) == tiers[t] else window, pieces))
    return done


def balance(sizes: list[int], steps: int) -> list[int]:
    """A step group for each sequence, so that groups hold about equally many tokens."""
    heap, out = [(0, s) for s in range(steps)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, step = heapq.heappop(heap)
        out[i] = step
        heapq.heappush(heap, (load + sizes[i], step))
    return out


def pack(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """One row for each piece; see SCHEMA."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks_path, pattern = how.ranks_path or public_path("byte_bpe_50k.tiktoken"), how.pattern or public_pattern()
    added = added_tokens(public_path("byte_bpe_50k.json")) if how.added is None else how.added
    end = how.end_id.to_bytes(4, "little")

    def flush(first: int, rows: list[tuple[int | None, bytes]]) -> tuple[int, pa.RecordBatch]:
        """The pieces of a group, numbered from `first` on, and the next free number."""
        sequences = pack_lengths([len(ids) // 4 for _, ids in rows], how.tiers)
        steps = balance([sum(p[2] for p in pieces) for _, pieces in sequences], how.steps)
        out = []
        for number, (tier, pieces) in enumerate(sequences):
            offset = 0
            for doc, at, n in pieces:
                doc_id, ids = rows[doc]
                out.append((doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4, first + number, offset, tier, steps[number]))
                offset += n
        kinds = [pa.int64()] * 7 + [pa.int32()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return first + len(sequences), pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, number, rows, tokens = vocabulary(ranks_path, pattern, added), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((doc_id, vocab.of(text) + end))
                tokens += len(rows[-1][1]) // 4
                if len(rows) >= how.group_docs or tokens >= how.group_tokens:
                    number, found = flush(number, rows)
                    rows, tokens = [], 0
                    yield found
        if rows:
            yield flush(number, rows)[1]

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.repartition(parts_for(spark, docs.count(), how.task_docs, 1)).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(run, SCHEMA)
