"""Fusion of ranked lists, depth, reranking, and expansion to parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import SIGNAL_WEIGHTS, Settings


def ranked(signal: str, scored: DataFrame, limit: int | None = None) -> DataFrame:
    """signal, chunk_id, raw, rank (from 0; ties by chunk_id). With a limit each task keeps as many rows before they meet."""
    kept = scored if limit is None else scored.orderBy(F.desc("raw"), "chunk_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("raw"), "chunk_id")) - 1
    return kept.select(F.lit(signal).alias("signal"), "chunk_id", F.col("raw").cast("double").alias("raw")).withColumn("rank", rank)


def union(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def rrf(lists: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """chunk_id, rrf, signals (signal -> raw): the weighted sum of 1 / (k + rank + 1). A signal without a weight
    has weight 1; one of weight 0 still brings its rows."""
    w = F.coalesce(F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(float(v)))])[F.col("signal")], F.lit(1.0)) if weights else F.lit(1.0)
    scored = lists.withColumn("part", w / (k + F.col("rank") + 1))
    return scored.groupBy("chunk_id").agg(F.sum("part").alias("rrf"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "raw")))).alias("signals"))


def top(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("rrf"), "chunk_id").limit(k)


def diversity_depth(fused: DataFrame, types: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """One row: minority (share of the rarer content type among the best k) and depth: k, or more where they are too much alike."""
    best = top(fused, k).join(types, "chunk_id")
    share = best.agg(F.count("*").alias("n"), F.count_if(F.col("content_type") == "code").alias("code"))
    minority = F.when(F.col("n") > 0, F.least("code", F.col("n") - F.col("code")) / F.col("n")).otherwise(0.0)
    deeper = F.least(F.floor(F.lit(k) * s.rerank_multiplier), F.lit(s.rerank_max)).cast("int")
    return share.select(minority.alias("minority"), F.when(minority < s.rerank_diversity, deeper).otherwise(F.lit(k)).alias("depth"))


def materialize(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused rows with their chunks' columns; ids without a chunk drop out. The fused side is limited, so it is broadcast."""
    return chunks.join(F.broadcast(fused), "chunk_id")


def result_rows(entries: DataFrame) -> DataFrame:
    """One column for each signal's raw score, 0 where it has none."""
    scores = [F.coalesce(F.col("signals")[s], F.lit(0.0)).alias(f"{s.removeprefix('text_')}_score") for s in SIGNAL_WEIGHTS]
    return entries.select("page_url", "chunk_id", "section_title", F.col("rrf").alias("score"), "text", *scores)


def rerank(entries: DataFrame, logits: DataFrame, k: int) -> DataFrame:
    """entries with rerank_score, the sigmoid of the cross-encoder's logit, best first. Where no logits are, the fused order holds."""
    scored = entries.join(logits.select("chunk_id", "logit"), "chunk_id", "left").withColumn("rerank_score", 1 / (1 + F.exp(-F.col("logit")))).drop("logit")
    return scored.orderBy(F.desc_nulls_last("rerank_score"), F.desc("score"), "chunk_id").limit(k)


def best_of(results: DataFrame) -> DataFrame:
    """Of each chunk its best row over several sub-queries."""
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "query_id"))
    return results.withColumn("_r", rank).filter("_r = 1").drop("_r")


def expand_to_parents(results: DataFrame, chunks: DataFrame, k: int | None, backfill: bool = False) -> DataFrame:
    """results: chunk_id, parent_chunk_id, text, position (rank). Children become their parent (or stay if it is missing), the first of
    each parent wins; with backfill its other children fill up to k behind. Without k all rows, in no order."""
    parents = chunks.select(F.col("chunk_id").alias("p_id"), F.col("text").alias("p_text"))
    joined = results.join(parents, results["parent_chunk_id"] == parents["p_id"], "left")
    unit = F.coalesce("parent_chunk_id", "chunk_id")
    nth = F.row_number().over(Window.partitionBy(unit).orderBy("position", "chunk_id"))
    rows = joined.withColumn("nth", nth)
    first = F.col("nth") == 1
    rows = rows.select(
        F.when(first, F.coalesce("p_id", "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(first, F.coalesce("p_text", "text")).otherwise(F.col("text")).alias("text"), "position", first.alias("is_first")
    )
    if not backfill:
        rows = rows.filter("is_first")
    return (rows if k is None else rows.orderBy(F.desc("is_first"), "position", "chunk_id").limit(k)).drop("is_first")


def context(results: DataFrame) -> DataFrame:
    """One row: the numbered passages for an answer prompt."""
    shown = F.coalesce("rerank_score", "score") if "rerank_score" in results.columns else F.col("score")
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] (score: "), F.format_string("%.3f", shown), F.lit(") ["), F.col("page_url"), F.lit("]\n"), F.col("text"))
    return results.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n\n---\n\n").alias("context"))


def charts_for(images: DataFrame, chunk_ids: DataFrame, limit: int = 3) -> DataFrame:
    """Chart images near one of the chunks, in order of image_id."""
    near = images.filter("is_chart").select("image_id", "src_url", F.explode("nearest_chunk_ids").alias("chunk_id")).join(chunk_ids, "chunk_id", "left_semi")
    return near.select("image_id", "src_url").distinct().orderBy("image_id").limit(limit)
