"""Stateful steps of ingestion: what changed, what repeats, which entities are the same, when to stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import ship
from .folders import written
from .similarity import Cells, SimilarityJoin, greedy_filter


def changes(seen: DataFrame, known: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """seen: keys, text; known: keys (each once), content_hash. keys, content_hash, change: new, updated or unchanged."""
    hashed = seen.select(*keys, tx.content_hash(F.col("text")).alias("content_hash"))
    old = known.select(*keys, F.col("content_hash").alias("old"))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "unchanged").otherwise("updated")
    return hashed.join(old, list(keys), "left").select(*keys, "content_hash", kind.alias("change"))


def unseen(results: DataFrame, pages: DataFrame) -> DataFrame:
    return results.join(pages.select("url"), "url", "left_anti")


def greedy_keep(vectors: np.ndarray, threshold: float, kept: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """In order: a vector is kept unless one kept before is more similar than the threshold. Returns for each the kept one
    that it repeats (-1 for kept ones; the first best), as positions among all kept, and the positions kept."""
    pool = [] if kept is None else list(kept)
    match, own = [], []
    matrix = np.array(pool).reshape(len(pool), -1) if pool else np.zeros((0, vectors.shape[1] if len(vectors) else 0))
    held = len(matrix)
    for i, v in enumerate(vectors):
        if held:
            s = matrix[:held] @ v
            best = int(s.argmax())
            if s[best] > threshold:
                match.append(best)
                continue
        match.append(-1)
        own.append(i)
        if held == len(matrix):
            matrix = np.concatenate([matrix, np.zeros((max(held, 16), matrix.shape[1]))])
        matrix[held] = v
        held += 1
    return match, own


def greedy_duplicates(rows: DataFrame, threshold: float, partition: str | None = None) -> DataFrame:
    """id, seq, embedding. id, duplicate_of: exact greedy filter in order of seq. The rule is sequential, so it runs within groups of
    `partition` (a page, a domain), which one task holds; greedy_by_pairs is for whole tables."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    key = partition or "_one"
    grouped = rows if partition else rows.withColumn("_one", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        vectors = np.array(pdf["embedding"].tolist(), float).reshape(len(pdf), -1)
        match, own = greedy_keep(vectors, threshold)
        ids = pdf["id"]
        return pd.DataFrame({"id": ids, "duplicate_of": [None if m < 0 else ids[own[m]] for m in match]}).astype({"duplicate_of": ids.dtype if not any(m < 0 for m in match) else "object"})

    return grouped.groupBy(key).applyInPandas(run, f"id {kind}, duplicate_of {kind}")


def similar_pairs(rows: DataFrame, threshold: float, planes: int = 12, tables: int = 8, seed: int = 1) -> DataFrame:
    """(a, b, similarity) with similarity over the threshold among pairs that share a cell of random hyperplanes: approximate in recall, exact
    in similarity. Cells are as many as 2 ** planes in each table, so no group is large unless its vectors are alike."""
    ship(rows.sparkSession)
    first = rows.select("embedding").first()
    if first is None:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    normals = np.random.RandomState(seed).randn(tables, planes, len(first["embedding"]))
    kind = rows.schema["id"].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), float)
            bits = (np.einsum("tpd,nd->ntp", normals, v) > 0) @ (1 << np.arange(planes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits.tolist(), pa.list_(pa.int64()))], names=["id", "embedding", "cells"])

    placed = rows.select("id", "embedding").mapInArrow(cells, f"id {kind}, embedding array<float>, cells array<long>")
    spread = placed.select("id", F.posexplode("cells").alias("t", "cell"))
    pairs = spread.alias("x").join(spread.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    from ..functions.vectors import dot

    va, vb = rows.select(F.col("id").alias("a"), F.col("embedding").alias("ea")), rows.select(F.col("id").alias("b"), F.col("embedding").alias("eb"))
    return pairs.join(va, "a").join(vb, "b").select("a", "b", dot(F.col("ea"), F.col("eb")).alias("similarity")).filter(F.col("similarity") > threshold)


def matches(queries: DataFrame, corpus: DataFrame, threshold: float, block: int = 4096, best: bool = False) -> DataFrame:
    """(id, match, similarity) with similarity over the threshold between rows (id, embedding of unit length) of queries and of corpus: exact. With `best` only the best
    match of each query (the smallest of equals). Neither side is held whole anywhere."""
    found = SimilarityJoin(queries, corpus, threshold, Cells(block=block))
    return found.best() if best else found.pairs()


def greedy_by_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """greedy_duplicates for a whole table (id, seq, embedding of unit length): id, duplicate_of. Equal vectors are collapsed first; no task holds the table."""
    rows = rows.select("id", "seq", "embedding").filter("embedding is not null")
    first = rows.groupBy("embedding").agg(F.min(F.struct("seq", "id")).alias("first")).select("first.id", "first.seq", "embedding")
    # Sorted by ranges, so that numbers rise from partition to partition.
    numbered = first.orderBy("seq", "id").select("id", F.monotonically_increasing_id().alias("n"), "embedding")
    numbered = written(numbered, "numbered")
    settled = numbered.select("id", "embedding").join(greedy_filter(numbered, threshold).select("id", "duplicate_of"), "id").select(F.col("id").alias("head"), "embedding", "duplicate_of")
    # A vector equal to an earlier one repeats it, or what that one repeats.
    out = rows.join(settled, "embedding")
    return out.select("id", F.coalesce("duplicate_of", F.when(F.col("id") != F.col("head"), F.col("head"))).alias("duplicate_of"))


def keep_by_rounds(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The greedy filter as a fixed point over known pairs (a before b): a row stays iff no earlier kept row is similar. Each round
    settles the rows whose earlier neighbours are settled; it ends after the longest chain."""
    settled = ids.select("id", F.lit(None).cast("boolean").alias("kept"))
    while True:
        state = pairs.join(settled.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("ka", F.lit(False))).alias("hit"), F.count_if(F.col("ka").isNull()).alias("open"))
        new = settled.join(state, "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True).alias("kept"))
        new = new.checkpoint()
        left = new.filter("kept is null").count()
        if left == 0:
            return new
        settled = new


def resolve_entities(mentions: DataFrame, threshold: float = 0.75, known: DataFrame | None = None) -> DataFrame:
    """name (each once), seq, embedding (of unit length): a mention becomes an alias of the nearest known entity (canonical_name, embedding) over the
    threshold; the others, in order of seq, of the nearest entity among them before, or a new entity. name, entity_id, canonical_name."""
    rest = mentions.select(F.col("name").alias("id"), "seq", "embedding")
    old = None
    if known is not None:
        old = matches(rest, known.select(F.col("canonical_name").alias("id"), "embedding"), threshold, best=True).select("id", F.col("match").alias("duplicate_of")).checkpoint()
        rest = rest.join(old.select("id"), "id", "left_anti").checkpoint()
    found = greedy_by_pairs(rest, threshold)
    found = found if old is None else found.union(old)
    canonical = F.coalesce("duplicate_of", "id")
    return found.select(F.col("id").alias("name"), tx.entity_id(canonical).alias("entity_id"), canonical.alias("canonical_name"))


def aliases(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("entity_id", "canonical_name").agg(F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical_name"), F.col("name")))).alias("aliases"))


def novelty(attempts: DataFrame, threshold: float = 0.2) -> DataFrame:
    """attempts: outcome (new or skipped). One row: ratio, goes_on. Nothing attempted: stop."""
    new, skipped = F.count_if(F.col("outcome") == "new"), F.count_if(F.col("outcome") == "skipped")
    ratio = F.when(new + skipped > 0, new / (new + skipped))
    return attempts.agg(ratio.alias("ratio"), F.coalesce(ratio >= threshold, F.lit(False)).alias("goes_on"))


def authority_increases(before: DataFrame, after: DataFrame) -> DataFrame:
    """url, old, new: pages whose authority rose."""
    old = before.select("url", F.col("authority_score").alias("old"))
    new = after.select("url", F.col("authority_score").alias("new"))
    return new.join(old, "url").filter((F.col("new") > F.coalesce("old", F.lit(0.0))) & (F.col("new") > 0))


def crawl(seed: DataFrame, fetch_links: Callable[[DataFrame], DataFrame], classify: Callable[[Column], Column], max_depth: int = 50) -> DataFrame:
    """Breadth first from seed (url): fetch_links gives (url, target) for a frontier. url, depth, kind of all found; only same-domain ones
    are fetched. A round is one join; the frontier and what was visited stay DataFrames."""
    visited = seed.select("url", F.lit(0).alias("depth"), F.lit("same-domain").alias("kind")).distinct().checkpoint()
    frontier = visited
    for depth in range(1, max_depth + 1):
        found = fetch_links(frontier.filter("kind = 'same-domain'").select("url")).select(F.col("target").alias("url")).distinct()
        frontier = found.join(visited.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), classify(F.col("url")).alias("kind")).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if depth % 5 == 0:
            visited = visited.checkpoint()
    return visited


def nearest_chunks(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """images: page_url, image_id, dom_offset; chunks: page_url, chunk_id, offset (null if not found). image_id, before, after: the last chunk that begins at or
    before the image and the first after it. One pass over both, sorted within the page."""
    a = images.select("page_url", F.col("dom_offset").alias("at"), F.lit(1).alias("kind"), F.col("image_id"), F.lit(None).cast("string").alias("chunk_id"))
    b = chunks.filter("offset is not null").select("page_url", F.col("offset").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("image_id"), "chunk_id")
    w = Window.partitionBy("page_url").orderBy("at", "kind", "chunk_id", "image_id")
    both = a.unionByName(b)
    back = F.last("chunk_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("chunk_id", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.select("image_id", "kind", back.alias("before"), ahead.alias("after")).filter("kind = 1").drop("kind")


def text_offset(html: Column, text: Column) -> Column:
    """Where the first 100 characters of a chunk's text begin in the page, from 0; null if nowhere."""
    at = F.instr(html, F.left(text, F.lit(100)))
    return F.when(at > 0, at - 1)
