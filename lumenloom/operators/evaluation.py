"""Evaluation and benchmark analytics as aggregations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.settings import SIGNAL_WEIGHTS


def precision_recall(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ranked: query_id, chunk_id, rank (from 0); relevant: query_id, chunk_id. query_id, precision (over k, even if fewer were found), recall (0
    without relevant chunks)."""
    hits = ranked.filter(F.col("rank") < k).join(relevant.distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    sizes = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    found = ranked.select("query_id").distinct().join(hits, "query_id", "left").join(sizes, "query_id", "left")
    got = F.coalesce("hits", F.lit(0))
    return found.select("query_id", (got / k).alias("precision"), F.when(F.coalesce("n", F.lit(0)) > 0, got / F.col("n")).otherwise(0.0).alias("recall"))


def macro(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count("*").alias("queries"))


def overlap_score(expected: DataFrame, retrieved: DataFrame, least: int = 4, short_never: bool = False) -> DataFrame:
    """expected: query_id, passage; retrieved: query_id, text. query_id, score: the share of passages found in some text. With short_never
    passages under 20 characters count as missed instead of needing boundaries."""
    p = expected.withColumn("p", tx.normalized(F.col("passage"))).withColumn("_row", F.monotonically_increasing_id())
    r = retrieved.withColumn("r", tx.normalized(F.col("text")))
    found = p.join(r.select("query_id", "r"), "query_id", "left")
    hit = F.coalesce(tx.overlaps(F.col("p"), F.col("r"), 20 if short_never else least), F.lit(False))
    each = found.groupBy("query_id", "_row").agg(F.max(hit).alias("hit"))
    return each.groupBy("query_id").agg(F.avg(F.col("hit").cast("double")).alias("score"))


def passage_pairs(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(passage_id, chunk_id) for each passage (passage_id, passage) that overlaps a chunk (chunk_id, text).

    A passage of five words or more holds whole words between its first and its last: of these the longest three in a row are its anchor.
    Chunks give their word triples, which meet the anchors by hash, and only pairs that met are compared. Shorter passages are compared with
    every chunk; they are few by nature."""
    p = passages.select("passage_id", tx.normalized(F.col("passage")).alias("p")).filter("p <> ''")
    split = p.withColumn("w", F.split("p", " ", -1))
    triple = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    inner = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: triple(F.col("w"), i))
    anchor = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    long = split.filter(F.size("w") >= 5).select("passage_id", "p", F.xxhash64(anchor).alias("h"))
    words = chunks.select("chunk_id", F.explode(F.array(F.split(tx.normalized(F.col("text")), " ", -1))).alias("w")).filter(F.size("w") >= 3)
    met = words.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(triple(F.col("w"), i)))).alias("h"))
    found = met.join(long.select("passage_id", "h"), "h").select("passage_id", "chunk_id").distinct()
    texts = chunks.select("chunk_id", "text")
    checked = found.join(texts, "chunk_id").join(long.select("passage_id", "p"), "passage_id").filter(tx.overlaps(F.col("p"), tx.normalized(F.col("text"))))
    short = split.filter(F.size("w") < 5).select("passage_id", "p")
    if short.isEmpty():
        return checked.select("passage_id", "chunk_id")
    few = texts.select("chunk_id", tx.normalized(F.col("text")).alias("t")).join(short, tx.overlaps(F.col("p"), F.col("t")))
    return checked.select("passage_id", "chunk_id").union(few.select("passage_id", "chunk_id"))


def nearest_rank(values: DataFrame, column: str, percents: list[int], by: list[str] = (), ranges: int = 64) -> DataFrame:
    """Percentiles by nearest rank: the value at min(floor(n * p / 100), n - 1) in order. Exact, without ordering a group in one task: sketches cut each
    group into ranges of values, counts of the ranges say in which of them a rank lies, and only values counted in these are ordered."""
    groups = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)] or [F.lit(0).alias("_g0")]
    g = [f"_g{i}" for i in range(len(groups))]
    rows = values.filter(F.col(column).isNotNull()).select(*groups, F.col(column).alias("_v"))
    cuts = rows.groupBy(*g).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 2000).alias("_cuts"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in g]
    placed = rows.alias("r").join(cuts.alias("c"), same("r", "c")).select(*[f"r.{c}" for c in g], "_v", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))).alias("_range"))
    # Equal values are one row from here on.
    counted = placed.groupBy(*g, "_range", "_v").agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*g, "_range").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # `ranges` rows a group
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).withColumn("_all", F.sum("_in").over(Window.partitionBy(*g)))
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1).alias("rank")) for p in percents])
    wanted = sizes.withColumn("_t", F.explode(ranks)).filter("_t.rank >= _before and _t.rank < _before + _in").select(*g, "_range", F.col("_t.p").alias("_p"), (F.col("_t.rank") - F.col("_before")).alias("_at"))
    hit = counted.alias("r").join(wanted.alias("c"), [*same("r", "c"), F.col("r._range") == F.col("c._range")]).select(*[f"r.{c}" for c in g], "_p", "_at", "_v", "_n")
    upto = hit.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*g, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    chosen = upto.filter("_upto > _at").groupBy(*g, "_p").agg(F.min("_v").alias("_v"))
    out = chosen.groupBy(*g).agg(*[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])
    return out.select(*[F.col(f"_g{i}").alias(b) for i, b in enumerate(by)], *[f"p{p}" for p in percents])


def answer_quality(scores: DataFrame) -> DataFrame:
    """relevance, groundedness, completeness; rows with NaN are left out; the mean of the three means, 0 if nothing is left."""
    names = ["relevance", "groundedness", "completeness"]
    good = scores.filter(~F.isnan(names[0]) & ~F.isnan(names[1]) & ~F.isnan(names[2]))
    means = [F.coalesce(F.avg(c), F.lit(0.0)) for c in names]
    return good.agg(*[m.alias(c) for m, c in zip(means, names)], ((means[0] + means[1] + means[2]) / 3).alias("mean_score"), F.count("*").alias("scored"))


def sweep_grid(signals: list[str] = ("bm25", "text_cosine", "image_cosine", "graph"), values: tuple[float, ...] = (0.5, 1.0, 1.5), cap: int = 10_000) -> list[dict[str, float]]:
    grid = [dict(zip(signals, v)) for v in product(values, repeat=len(signals))]
    if len(grid) > cap:
        raise ValueError(f"{len(grid)} combinations; at most {cap}")
    return grid


def weight_sweep(lists: DataFrame, relevant: DataFrame, grid: list[dict[str, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """lists: query_id, signal, chunk_id, rank. combo, precision, recall, best first. All combinations in one plan: the grid is a small table joined by signal."""
    spark = lists.sparkSession
    rows = [(i, s, float(c.get(s, SIGNAL_WEIGHTS.get(s, 1.0)))) for i, c in enumerate(grid) for s in {*SIGNAL_WEIGHTS, *c}]
    weights = spark.createDataFrame(rows, "combo int, signal string, w double")
    scored = lists.join(F.broadcast(weights), "signal").groupBy("combo", "query_id", "chunk_id").agg(F.sum(F.col("w") / (rrf_k + F.col("rank") + 1)).alias("rrf"))
    rank = F.row_number().over(Window.partitionBy("combo", "query_id").orderBy(F.desc("rrf"), "chunk_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    hits = top.join(relevant.distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("combo", "query_id").agg(F.count("*").alias("hits"))
    sizes = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    pairs = scored.select("combo", "query_id").distinct().join(hits, ["combo", "query_id"], "left").join(sizes, "query_id", "left")
    got = F.coalesce("hits", F.lit(0))
    out = pairs.groupBy("combo").agg(F.avg(got / k).alias("precision"), F.avg(F.when(F.col("n") > 0, got / F.col("n")).otherwise(0.0)).alias("recall"))
    return out.orderBy(F.desc("precision"), F.desc("recall"), "combo")


def delta(old: Column, new: Column) -> Column:
    """Percent change; null from 0."""
    return F.when(old != 0, (new - old) / old * 100)


def compare_reports(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """Both reports by config_name: presence, absolute and percent change of each metric."""
    j = a.alias("a").join(b.alias("b"), F.col("a.config_name") == F.col("b.config_name"), "full_outer")
    where = F.when(F.col("a.config_name").isNull(), "only_b").when(F.col("b.config_name").isNull(), "only_a").otherwise("both")
    out = [F.coalesce("a.config_name", "b.config_name").alias("config_name"), where.alias("presence")]
    for m in metrics:
        out += [(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"{m}_delta"), delta(F.col(f"a.{m}"), F.col(f"b.{m}")).alias(f"{m}_percent")]
    return j.select(*out)


def failures(details: DataFrame, frequent: float = 0.75) -> DataFrame:
    """details: config_name, query, overlap. query, failed, configs, kind: universal (all failed) or frequent."""
    rows = details.groupBy("query").agg(F.count_if(F.col("overlap") == 0).alias("failed"), F.count("*").alias("configs"))
    kind = F.when(F.col("failed") == F.col("configs"), "universal").when(F.col("failed") >= frequent * F.col("configs"), "frequent")
    return rows.withColumn("kind", kind).filter("kind is not null")


def breakdown(details: DataFrame) -> DataFrame:
    """Mean overlap by document, by difficulty, and overall, in one pass."""
    return details.groupingSets([["source_doc"], ["difficulty"], []], "source_doc", "difficulty").agg(F.avg("overlap").alias("overlap"), F.count("*").alias("n"))


def roll_up(runs: DataFrame) -> DataFrame:
    """runs: config_name, chunks, ingest_s, overlap, latency_ms. A row for each config."""
    base = runs.groupBy("config_name").agg(F.max("chunks").alias("chunks"), F.max("ingest_s").alias("ingest_s"), F.avg("overlap").alias("text_overlap"))
    ms = F.when(F.col("chunks") > 0, F.col("ingest_s") * 1000 / F.col("chunks")).otherwise(0.0)
    return base.withColumn("ms_per_chunk", ms).join(nearest_rank(runs, "latency_ms", [50, 95, 99], ["config_name"]), "config_name")


def benchmark_matrix() -> list[dict]:
    """4 chunking x 4 embedding x 6 retrieval settings."""
    chunking = [{"chunk_mode": m} for m in ("auto", "paragraph", "wiki", "code")]
    embedding = [{"code_embeddings": c, "token_embeddings": t} for c in (True, False) for t in (True, False)]
    only = lambda *on: {s: (w if s in on else 0.0) for s, w in SIGNAL_WEIGHTS.items()}
    retrieval = [("bm25_only", only("bm25")), ("cosine_only", only("text_cosine")), ("hybrid", dict(SIGNAL_WEIGHTS) | {"hyde_cosine": 0.0}), ("hybrid+maxsim", dict(SIGNAL_WEIGHTS) | {"hyde_cosine": 0.0, "maxsim": 1.5}), ("hybrid+hyde", dict(SIGNAL_WEIGHTS)), ("hybrid+hyde+maxsim", dict(SIGNAL_WEIGHTS) | {"maxsim": 1.5})]
    return [
        {"config_name": f"{c['chunk_mode']}/{'code' if e['code_embeddings'] else 'nocode'}-{'tok' if e['token_embeddings'] else 'notok'}/{r}", **c, **e, "weights": w} for c in chunking for e in embedding for r, w in retrieval
    ]


def signal_metrics(lists: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """lists: query_id, signal, chunk_id, rank. signal, precision, recall, queries: over queries that the signal ranks something for."""
    out = None
    for s in SIGNAL_WEIGHTS:
        mine = lists.filter(F.col("signal") == s).select("query_id", "chunk_id", "rank")
        part = macro(precision_recall(mine, relevant, k)).select(F.lit(s).alias("signal"), "precision", "recall", "queries")
        out = part if out is None else out.union(part)
    return out.filter("queries > 0")


