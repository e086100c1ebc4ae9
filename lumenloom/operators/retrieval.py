"""Ranking signals. Each gives (chunk_id, raw): the higher the better. Queries are scalars, so what
depends on them (terms, vectors, document frequencies of a few terms) is a literal or one row; the corpus is only scanned."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.counting import TermCounter
from ..plans.settings import Settings
from ..shipping import ship
from .folders import written


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf."""
    return chunks.select("chunk_id", F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """term, df (chunks with it), cf (occurrences)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """term_stats from the chunks themselves: tokens are sorted within the row, so the first of its kind counts for df, and one shuffle
    with partial sums is enough."""
    tokens = chunks.select(F.explode(F.array(F.sort_array(tx.tokenize(F.col("text"))))).alias("t"))
    marked = F.transform("t", lambda t, i: F.struct(t.alias("term"), F.when((i == 0) | (F.get("t", i - 1) != t), 1).otherwise(0).alias("first")))
    return tokens.select(F.inline(marked)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


#: Counts that bm25 keeps for the passes over them; the oldest are let go. A plan that still uses them makes them again.
_KEPT: deque = deque()


def _keep(df: DataFrame, most: int = 4) -> DataFrame:
    """Persisted; the same counts are kept once, as letting one go lets go of its equals."""
    for held in list(_KEPT):
        if held.sparkSession is not df.sparkSession:  # of a session that may have ended
            _KEPT.remove(held)
        elif held.sameSemantics(df):
            return held
    while len(_KEPT) >= most:
        _KEPT.popleft().unpersist()
    _KEPT.append(df.persist())
    return df


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(tx.tokenize(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avg_dl (1 for an empty corpus)."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))


def query_tokens(spark, query: str) -> Counter:
    row = spark.range(1).select(tx.tokenize(F.lit(query)).alias("t")).first()
    return Counter(row["t"])


def bm25(chunks: DataFrame, tokens: Counter, s: Settings = Settings(), limit: int | None = None) -> DataFrame:
    """chunk_id, raw in (0, 1]: BM25 over the maximum. A repeated query token counts again.

    The counts of the query's terms are computed in the scan, so no postings are shuffled; document frequencies are one row."""
    terms = sorted(tokens)
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("raw")).limit(0)
    # A few numbers for each chunk, kept for the passes over them; lost parts are made again.
    times = [F.coalesce(F.element_at("hits", F.lit(i)), F.lit(0)).alias(f"tf{i}") for i in range(len(terms))]
    counted = _keep(term_hits(chunks, terms).select("chunk_id", "dl", *times))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    raw = F.lit(0.0)
    for i, t in enumerate(terms):
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
        raw = raw + tokens[t] * idf * f * (s.bm25_k1 + 1) / (f + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / F.col("avg_dl")))
    scored = joined.select("chunk_id", raw.alias("raw")).filter("raw > 0")
    if limit is not None:  # the best rows hold the maximum; they are few
        return best(scored, limit).withColumn("raw", F.col("raw") / F.max("raw").over(Window.partitionBy(F.lit(0))))
    top = scored.agg(F.max("raw").alias("top"))
    return scored.crossJoin(F.broadcast(top)).select("chunk_id", (F.col("raw") / F.col("top")).alias("raw"))


def term_hits(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, dl, hits (map of a term's number in `terms` to its count): one pass over the texts (null: no terms), and nothing of them moves."""
    ship(chunks.sparkSession)
    kind, numbers = chunks.schema["chunk_id"].dataType.simpleString(), {t.encode(): i for i, t in enumerate(terms)}
    shared = chunks.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(shared.value)
        for batch in batches:
            found = [counter.of(t) for t in batch.column(1).to_pylist()]
            hits = pa.array([list(h.items()) for _, h in found], pa.map_(pa.int32(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), hits], names=["chunk_id", "dl", "hits"])

    return chunks.select("chunk_id", F.col("text").cast("binary")).mapInArrow(run, f"chunk_id {kind}, dl long, hits map<int,int>")


def bm25_many(chunks: DataFrame, queries: DataFrame, s: Settings = Settings(), k: int | None = None, places: int | None = None, most: int = 1_000_000) -> DataFrame:
    """query_id, chunk_id, raw (not over the best) for a stated set of queries (query_id, term, qtf) over chunks (chunk_id, each once, text): the same as bm25_batch.

    The texts are read once, for the queries' terms; what is kept of a chunk are its counts of these. Scores are made from them in the tasks, with `places` rounded, and with k each task keeps k rows of a query,
    so no postings move. The weights of the queries' terms, at most `most`, are held in the driver and each worker; more are an error, to be put in several calls."""
    spark = chunks.sparkSession
    asked = queries.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")).limit(most + 1).toArrow()
    if len(asked) > most:
        raise ValueError(f"more than {most} terms: put the queries in several calls")
    terms = sorted(set(asked.column("term").to_pylist()) - {None})
    counted = written(term_hits(chunks, terms), "hits")
    n, mean = counted.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
    df = {r["key"]: r["n"] for r in counted.select(F.explode("hits")).groupBy("key").agg(F.count("*").alias("n")).collect()}  # a row a term
    number = {t: i for i, t in enumerate(terms)}
    ids = sorted(set(asked.column("query_id").to_pylist()))
    place = {q: i for i, q in enumerate(ids)}
    rows = [(place[q], number[t], qtf * float(np.log((n - df[number[t]] + 0.5) / (df[number[t]] + 0.5) + 1))) for q, t, qtf in zip(*(asked.column(c).to_pylist() for c in ("query_id", "term", "qtf"))) if number.get(t) in df]
    by_term: dict[int, list[tuple[int, float]]] = {}
    for q, t, w in rows:
        by_term.setdefault(t, []).append((q, w))
    shared = spark.sparkContext.broadcast((ids, {t: (np.array([q for q, _ in x]), np.array([w for _, w in x])) for t, x in by_term.items()}))
    kinds = [queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()]
    query_type = asked.schema.field("query_id").type

    def scored(batch: pa.RecordBatch, many: int, weights: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, raw) of all that have one of a query's terms."""
        hits = batch.column(2)
        sizes = np.diff(hits.offsets.to_numpy())
        at = np.repeat(np.arange(batch.num_rows), sizes)
        term, tf = (x.to_numpy(zero_copy_only=False)[hits.offsets[0].as_py() : hits.offsets[-1].as_py()] for x in (hits.keys, hits.items))
        part = tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * batch.column(1).to_numpy()[at] / (mean or 1.0)))
        raw = np.zeros((batch.num_rows, many))
        order = np.argsort(term, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(term[order])) + 1):
            if len(run):
                q, w = weights[int(term[run[0]])]
                raw[at[run][:, None], q] += part[run][:, None] * w
        raw = raw if places is None else np.round(raw, places)
        row, query = np.nonzero(raw > 0)
        return query, row, raw[row, query]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        held: list[pa.Table] = []
        made = lambda q, c, v: pa.table({"q": pa.array(q, pa.int32()), "chunk_id": c, "raw": pa.array(v, pa.float64())})

        def best() -> pa.Table:
            table = pa.concat_tables(held).combine_chunks().sort_by([("q", "ascending"), ("raw", "descending"), ("chunk_id", "ascending")])
            q = table.column("q").to_numpy()
            return table.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < k)))

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            named = pa.array(names, query_type).take(table.column("q").combine_chunks())
            for b in pa.table({"query_id": named, "chunk_id": table.column("chunk_id"), "raw": table.column("raw")}).to_batches():
                yield b

        for whole in batches:
            step = max(1, 2_000_000 // max(len(names), 1))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                query, row, raw = scored(batch, len(names), weights)
                if k is not None and len(query):
                    # The k-th best of each query in this batch is a floor; ties stay.
                    order = np.lexsort((-raw, query))
                    first = np.searchsorted(query[order], query[order])
                    nth = np.minimum(first + k, np.searchsorted(query[order], query[order], "right")) - 1
                    keep = order[raw[order] >= raw[order][nth]]
                    query, row, raw = query[keep], row[keep], raw[keep]
                table = made(query, batch.column(0).take(pa.array(row)), raw)
                if k is None:
                    yield from out(table)
                else:
                    held.append(table)
                    if sum(map(len, held)) > 4 * k * len(names):
                        held[:] = [best()]
        if k is not None and held:
            yield from out(best())

    return counted.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, raw double")


def over_best(scored: DataFrame) -> DataFrame:
    """raw over the best of its query."""
    top = scored.groupBy("query_id").agg(F.max("raw").alias("top"))
    return scored.join(F.broadcast(top), "query_id").select("query_id", "chunk_id", (F.col("raw") / F.col("top")).alias("raw"))  # a row a query


def bm25_batch(posted: DataFrame, lengths: DataFrame, queries: DataFrame, s: Settings = Settings(), over_best: bool = True) -> DataFrame:
    """query_id, chunk_id, raw for many queries (query_id, term, qtf): postings join on the term. The scores are over their query's best unless told otherwise."""
    stats = corpus_stats(lengths)
    idf = term_stats(posted).crossJoin(F.broadcast(stats)).select("term", "avg_dl", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    hits = posted.join(queries, "term").join(idf, "term").join(lengths, "chunk_id")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (s.bm25_k1 + 1) / (F.col("tf") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / F.col("avg_dl")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("raw")).filter("raw > 0")
    return scored.withColumn("raw", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))) if over_best else scored


def best(scored: DataFrame, limit: int | None) -> DataFrame:
    """The best rows; ties by chunk_id. Plans as TakeOrderedAndProject: each task keeps `limit` rows."""
    return scored if limit is None else scored.orderBy(F.desc("raw"), "chunk_id").limit(limit)


def cosine(chunks: DataFrame, query: list[float], limit: int | None = None, column: str = "embedding") -> DataFrame:
    """Of unit vectors: the dot product with the query."""
    return best(chunks.filter(F.col(column).isNotNull()).select("chunk_id", vx.dot(F.col(column), vx.literal(query)).alias("raw")), limit)


def funnel(chunks: DataFrame, query: list[float], k: int, s: Settings = Settings()) -> DataFrame:
    """Cosine by stages: the best of short prefixes are looked at with longer ones. (chunk_id, raw) of the last stage."""
    rows = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    q = np.asarray(query, float)
    for dims, width in zip(s.funnel_dims, s.funnel_widths):
        part = q[:dims] / (np.linalg.norm(q[:dims]) or 1.0)
        whole = dims >= len(query)
        own = F.col("embedding") if whole else vx.truncate(F.col("embedding"), dims)
        rows = rows.select("chunk_id", "embedding", vx.dot(own, vx.literal(query if whole else part.tolist())).alias("raw")).orderBy(F.desc("raw"), "chunk_id").limit(k * width)
    return rows.select("chunk_id", "raw")


def images_signal(images: DataFrame, query: list[float]) -> DataFrame:
    """Each chunk's best similarity among the images near it."""
    scored = images.filter("embedding is not null").select(F.explode("nearest_chunk_ids").alias("chunk_id"), vx.dot(F.col("embedding"), vx.literal(query)).alias("raw"))
    return scored.groupBy("chunk_id").agg(F.max("raw").alias("raw"))


def graph_signal(chunks: DataFrame, authority: DataFrame) -> DataFrame:
    """authority: page_url, authority_score. Chunks of pages with a score above 0."""
    scored = chunks.select("chunk_id", "page_url").join(authority, "page_url", "left")
    return scored.select("chunk_id", F.coalesce("authority_score", F.lit(0.0)).alias("raw")).filter("raw > 0")


def recency_value(age_days: Column, strength: Column, s: Settings = Settings()) -> Column:
    """Decay by half-lives, held up by corroboration."""
    decay = F.exp(-F.ln(F.lit(2.0)) / s.half_life_days * F.greatest(age_days, F.lit(0.0)))
    held = F.least(F.coalesce(strength, F.lit(0.0)) / s.corroboration_cap, F.lit(1.0))
    return decay + (1 - decay) * held


def age_days(ts: Column, now: Column) -> Column:
    return F.greatest((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400.0, F.lit(0.0))


def recency_signal(chunks: DataFrame, now: str, s: Settings = Settings()) -> DataFrame:
    """chunks: chunk_id, last_corroborated_at, corroboration_strength. Rows without a time have no rank."""
    age = age_days(F.col("last_corroborated_at").cast("timestamp"), F.to_timestamp(F.lit(now)))
    return chunks.filter("last_corroborated_at is not null").select("chunk_id", recency_value(age, F.col("corroboration_strength"), s).alias("raw"))


def entity_signal(entities: DataFrame, chunk_entities: DataFrame, query: list[float], s: Settings = Settings()) -> DataFrame:
    """Of the entities nearest to the query those over the threshold; a chunk has the sum over its entities."""
    near = entities.filter("entity_embedding is not null").select("entity_id", vx.dot(F.col("entity_embedding"), vx.literal(query)).alias("similarity"))
    near = near.orderBy(F.desc("similarity"), "entity_id").limit(s.entity_candidates).filter(F.col("similarity") > s.entity_threshold)
    # At most entity_candidates rows: broadcast.
    return chunk_entities.join(F.broadcast(near), "entity_id").groupBy("chunk_id").agg(F.sum("similarity").alias("raw"))


# Boosts of the cosine and late-interaction signals


def term_boost(chunks: DataFrame, terms: list[str], weight: float = 0.09) -> DataFrame:
    """chunk_id, boost: the share of the query terms' inverse frequency that the text holds as substrings; 0 where it isn't positive."""
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("boost"))
    distinct = sorted(set(terms))
    hits = chunks.select("chunk_id", *[F.lower("text").contains(t).alias(f"h{i}") for i, t in enumerate(distinct)])
    stats = hits.agg(F.count("*").alias("n"), *[F.count_if(f"h{i}").alias(f"d{i}") for i in range(len(distinct))])
    idf = {t: F.ln(F.col("n") / (1 + F.col(f"d{i}"))) for i, t in enumerate(distinct)}
    total = sum((idf[t] for t in terms[1:]), idf[terms[0]])
    mine = [F.when(F.col(f"h{distinct.index(t)}"), idf[t]).otherwise(0.0) for t in terms]
    got = sum(mine[1:], mine[0])
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    return joined.select("chunk_id", F.when(got > 0, weight * got / F.when(total == 0, 1.0).otherwise(total)).otherwise(0.0).alias("boost"))


def identifier_boost(text: Column, terms: list[str]) -> Column:
    """Query terms that are declared names (or parts of one), by count; more if two or more hit."""
    if not terms:
        return F.lit(0.0)
    names = F.transform(tx.code_identifiers(text), F.lower)
    exact, part = F.lit(0), F.lit(0)
    holds = lambda forms: lambda n: F.exists(forms, lambda f: n.contains(f))
    for t in terms:
        forms = tx.stems(F.lit(t))
        same = F.arrays_overlap(names, forms)
        within = F.exists(names, holds(forms))
        exact = exact + F.when(same, 1).otherwise(0)
        part = part + F.when(~same & within, 1).otherwise(0)
    raw = (0.08 * exact + 0.03 * part) / len(terms)
    return F.when(exact + part >= 2, raw + 0.025).otherwise(raw)


def mention_boost(text: Column, identifiers: list[str]) -> Column:
    """The share of the query's identifiers that the text mentions, case and all."""
    if not identifiers:
        return F.lit(0.0)
    hits = sum((F.when(text.contains(i), 1).otherwise(0) for i in identifiers[1:]), F.when(text.contains(identifiers[0]), 1).otherwise(0))
    return 0.06 * hits / len(identifiers)


def zscore_transfer(scores: DataFrame, target: str = "text_score", other: str = "code_score") -> DataFrame:
    """Rows with both scores: `other` brought to the mean and deviation of `target` as `transferred`; null where a deviation is 0 or
    there is one row."""
    stats = scores.filter(F.col(other).isNotNull()).agg(F.avg(target).alias("tm"), F.stddev_pop(target).alias("ts"), F.avg(other).alias("om"), F.stddev_pop(other).alias("os"), F.count("*").alias("rows"))
    ok = (F.col("rows") >= 2) & (F.col("ts") > 1e-9) & (F.col("os") > 1e-9)
    return scores.crossJoin(F.broadcast(stats)).withColumn("transferred", F.when(ok, (F.col(other) - F.col("om")) / F.col("os") * F.col("ts") + F.col("tm"))).drop("tm", "ts", "om", "os", "rows")


def text_cosine(chunks: DataFrame, query: str, query_vector: list[float], terms: list[str], identifiers: list[str], focused: list[float] | None = None, code_query: list[float] | None = None, limit: int | None = None) -> DataFrame:
    """The cosine signal: the best of the chunk's vectors against the query's, code scores on the same scale, then boosts.

    Chunks: chunk_id, text, embedding and, if there, summary_embedding and code_embedding."""
    score = lambda column, vector: vx.dot(F.col(column), vx.literal(vector))
    forms = [score("embedding", query_vector)]
    if focused is not None:
        forms.append(score("embedding", focused))
    if "summary_embedding" in chunks.columns:
        forms += [score("summary_embedding", v) for v in ([query_vector, focused] if focused is not None else [query_vector])]
    base = F.greatest(*[F.when(f.isNotNull(), f) for f in forms]) if len(forms) > 1 else forms[0]
    has = F.col("embedding").isNotNull() if "summary_embedding" not in chunks.columns else F.col("embedding").isNotNull() | F.col("summary_embedding").isNotNull()
    rows = chunks.withColumn("base", F.when(has, base))
    if code_query is not None and "code_embedding" in chunks.columns:
        rows = rows.withColumn("text_score", F.col("base")).withColumn("code_score", F.when(F.col("code_embedding").isNotNull(), score("code_embedding", code_query)))
        rows = zscore_transfer(rows).withColumn("base", F.greatest("base", "transferred"))
    boosts = term_boost(chunks, terms)
    out = rows.join(boosts, "chunk_id", "left")
    extra = F.coalesce("boost", F.lit(0.0)) + F.greatest(identifier_boost(F.col("text"), terms), F.lit(0.0)) + mention_boost(F.col("text"), identifiers)
    # A chunk without a vector takes part from -1 if something lifts it.
    out = out.select("chunk_id", F.coalesce("base", F.when(extra > 0, F.lit(-1.0))).alias("base"), extra.alias("extra"))
    return best(out.filter("base is not null").select("chunk_id", (F.col("base") + F.col("extra")).alias("raw")), limit)


def boosts(chunks: DataFrame, terms: list[str], identifiers: list[str]) -> DataFrame:
    """chunk_id, extra: the three boosts of a chunk's text together."""
    named = chunks.select("chunk_id", (F.greatest(identifier_boost(F.col("text"), terms), F.lit(0.0)) + mention_boost(F.col("text"), identifiers)).alias("named"))
    return named.join(term_boost(chunks, terms), "chunk_id", "left").select("chunk_id", (F.col("named") + F.coalesce("boost", F.lit(0.0))).alias("extra"))


def maxsim_signal(tokens: DataFrame, query: list[list[float]], candidates: int | None = None, fde_query: list[float] | None = None, limit: int | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Late interaction with soft token weights. tokens: chunk_id, tokens (matrix) and fde. The candidates are the best by fixed encoding, all
    without one; token weights come from one aggregate over them. extra (chunk_id, extra) is added to the scores."""
    rows = tokens
    if candidates is not None and fde_query is not None:
        rows = tokens.filter("fde is not null").withColumn("s", vx.dot(F.col("fde"), vx.literal(fde_query))).orderBy(F.desc("s"), "chunk_id").limit(candidates).drop("s")
    q = np.asarray(query, np.float64)
    kind = dict(tokens.dtypes)["chunk_id"]

    def run(batches):
        for batch in batches:
            found = [(q @ np.asarray(m, float).T).max(axis=1).tolist() if m else [0.0] * len(q) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["chunk_id", "best"])

    found = rows.select("chunk_id", "tokens").mapInArrow(run, f"chunk_id {kind}, best array<double>")
    n = len(query)
    means = found.agg(*[F.avg(F.col("best")[i]).alias(f"m{i}") for i in range(n)])
    soft = [1 / (0.5 + F.col(f"m{i}")) for i in range(n)]
    total = sum(soft[1:], soft[0])
    parts = [F.col("best")[i] * soft[i] / total for i in range(n)]
    scored = found.crossJoin(F.broadcast(means)).select("chunk_id", sum(parts[1:], parts[0]).alias("raw"))
    if extra is not None:
        scored = scored.join(extra, "chunk_id", "left").select("chunk_id", (F.col("raw") + F.coalesce("extra", F.lit(0.0))).alias("raw"))
    return best(scored, limit)


def similar_code(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """Top k by code embedding."""
    return cosine(chunks, query, k, "code_embedding")
