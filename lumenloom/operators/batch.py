"""Retrieval for many queries in one plan.

Lists that hang on the query are made for all queries in one pass over the corpus, and cut to their depth in each task before rows move. Lists that don't, such as authority and
recency, are ranked once for all queries. Fusing takes the second kind by look-up: a chunk that is in no list of a query scores by the common lists alone,
so of those only as many of the best can be among a query's k as k and its own rows together. Any number of weightings goes through the same plan.

Queries are a stated set: at most `most` vectors are held in a worker, more are an error, to be put in several calls."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import Settings
from ..shipping import ship
from .folders import written
from .similarity import matrix


def best_many(scored: DataFrame, k: int, by: list[str] = ("query_id",)) -> DataFrame:
    """The best k rows of each query, ties by chunk_id; each task keeps k before they meet."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("raw"), "chunk_id"))
    return scored.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def cosine_many(chunks: DataFrame, queries: DataFrame, k: int, column: str = "embedding", key: str = "chunk_id", most: int = 10_000) -> DataFrame:
    """query_id, chunk_id, raw: of each query (query_id, vector) the best k rows by dot product, in one pass over the rows."""
    spark = chunks.sparkSession
    ship(spark)
    held = queries.filter("vector is not null").select("query_id", "vector").limit(most + 1).toArrow()
    if len(held) > most:
        raise ValueError(f"more than {most} queries: put them in several calls")
    kinds = [queries.schema["query_id"].dataType.simpleString(), chunks.schema[key].dataType.simpleString()]
    shared = spark.sparkContext.broadcast((held.column("query_id").to_pylist(), matrix(held.column("vector"))))
    query_type = held.schema.field("query_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        top: list[list] = [[] for _ in ids]
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            if not batch.num_rows or not ids:
                continue
            scores, names = vectors @ matrix(batch.column(1)).T, batch.column(0).to_pylist()
            for q, row in enumerate(scores):
                # All that reach the k-th best, so that ties are settled by name.
                at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                pool = top[q] + [(float(row[i]), names[i]) for i in at]
                if len(pool) > k:
                    kth = heapq.nlargest(k, (x[0] for x in pool))[-1]
                    pool = [x for x in pool if x[0] >= kth]
                    if len(pool) > 4 * k:  # many equals: only the smallest names can count
                        pool = heapq.nsmallest(k, pool, key=lambda x: (-x[0], x[1]))
                top[q] = pool
        if key_type is not None:
            rows = [(ids[q], name, raw) for q, pool in enumerate(top) for raw, name in pool]
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, query_type), pa.array(b, key_type), pa.array(c, pa.float64())], names=["query_id", "chunk_id", "raw"])

    rows = chunks.filter(F.col(column).isNotNull()).select(key, column)
    return best_many(rows.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, raw double"), k)


def entity_many(entities: DataFrame, chunk_entities: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, chunk_id, raw: the entity signal of each query (query_id, vector)."""
    near = cosine_many(entities, queries, s.entity_candidates, "entity_embedding", "entity_id").filter(F.col("raw") > s.entity_threshold)
    return chunk_entities.join(near.withColumnRenamed("chunk_id", "entity_id"), "entity_id").groupBy("query_id", "chunk_id").agg(F.sum("raw").alias("raw"))


def ranked_many(signal: str, scored: DataFrame) -> DataFrame:
    """query_id, signal, chunk_id, raw, rank (from 0)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "chunk_id")) - 1
    return scored.select("query_id", F.lit(signal).alias("signal"), "chunk_id", F.col("raw").cast("double").alias("raw"), rank.alias("rank"))


def ranked_whole(signal: str, scored: DataFrame) -> DataFrame:
    """signal, chunk_id, raw, rank of a whole table: sorted by ranges, and numbered by the rows of the ranges before; no task holds the table."""
    ordered = scored.select("chunk_id", F.col("raw").cast("double").alias("raw")).orderBy(F.desc("raw"), "chunk_id")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("range", F.shiftright("at", 33))
    sizes = ordered.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select(F.col("range").alias("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ordered.join(F.broadcast(starts), F.col("range") == F.col("r")).select(F.lit(signal).alias("signal"), "chunk_id", "raw", (F.col("at") + F.col("shift")).cast("int").alias("rank"))


def weight_rows(spark, grid: dict[str, dict[str, float]]) -> DataFrame:
    """combo, signal, w."""
    return spark.createDataFrame([(c, s, float(w)) for c, weights in grid.items() for s, w in weights.items()], "combo string, signal string, w double")


def fuse_many(own: DataFrame, common: DataFrame | None, grid: dict[str, dict[str, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """combo, query_id, chunk_id, rrf, place (from 1): the best k of each query under each weighting.

    own: query_id, signal, chunk_id, rank. common: signal, chunk_id, rank, the same for all queries (those in `own`). A signal that a weighting doesn't name has weight 1."""
    spark = own.sparkSession
    signals = {r[0] for df in (own, common) if df is not None for r in df.select("signal").distinct().collect()}  # a handful
    weights = F.broadcast(weight_rows(spark, {c: {s: w.get(s, 1.0) for s in signals} for c, w in grid.items()}))
    part = F.col("w") / (rrf_k + F.col("rank") + 1)
    scored = own.join(weights, "signal").groupBy("combo", "query_id", "chunk_id").agg(F.sum(part).alias("rrf"))
    if common is not None:
        scored = written(scored, "fused")
        most = scored.groupBy("combo", "query_id").count().agg(F.max("count")).first()[0] or 0
        alone = common.join(weights, "signal").groupBy("combo", "chunk_id").agg(F.sum(part).alias("raw"))
        # Of chunks that are in no list of a query.
        best = best_many(alone, k + most, ["combo"]).select("combo", "chunk_id", F.col("raw").alias("base"))
        known = scored.select("combo", "query_id", "chunk_id", "rrf").join(alone.select("combo", "chunk_id", F.col("raw").alias("base")), ["combo", "chunk_id"], "left")
        mine = known.select("combo", "query_id", "chunk_id", (F.col("rrf") + F.coalesce("base", F.lit(0.0))).alias("rrf"))
        others = scored.select("combo", "query_id").distinct().join(best, "combo").join(scored.select("combo", "query_id", "chunk_id"), ["combo", "query_id", "chunk_id"], "left_anti")
        scored = mine.unionByName(others.select("combo", "query_id", "chunk_id", F.col("base").alias("rrf")))
    place = F.row_number().over(Window.partitionBy("combo", "query_id").orderBy(F.desc(F.round("rrf", 12)), "chunk_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)
