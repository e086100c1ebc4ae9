"""The query engine and the research loop over a Store, with providers for what is outside Spark."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions import vectors as vx
from ..operators import batch, fusion, graph, incremental, retrieval
from ..operators.folders import written
from ..operators.postings import Postings
from ..operators.store import Store, corroborate, store_graph
from ..sources.providers import Embedder, Fetcher, HashingEmbedder, HashingTokenEmbedder, Llm, Reranker, ScriptedLlm, Search, TokenEmbedder, ImageEmbedder, json_between, rerank_logits, search_rows
from .fetching import safe_fetch
from .ingest import Providers, ingest_pages
from .settings import Settings


def index_members(chunks: DataFrame) -> DataFrame:
    """Children, and parents that have none."""
    parents = chunks.filter("is_child and parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
    return chunks.filter("is_child").unionByName(chunks.filter("not is_child").join(parents, "chunk_id", "left_anti").select(*chunks.columns))


def unmigrated(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("embedding").isNotNull() & (F.col("embedding_version") < 1))


class QueryEngine:
    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder | None = None, reranker: Reranker | None = None, llm: Llm | None = None, tokens: TokenEmbedder | None = None, settings: Settings = Settings(), code_embedder: Embedder | None = None, image_embedder: ImageEmbedder | None = None, postings: Postings | None = None):
        self.spark, self.store, self.settings = spark, store, settings
        self.code_embedder, self.image_embedder, self.postings = code_embedder, image_embedder, postings
        self.embedder, self.reranker, self.llm, self.tokens = embedder or HashingEmbedder(), reranker, llm, tokens or HashingTokenEmbedder()

    def index(self) -> DataFrame:
        chunks = self.store.read("chunks")
        if not unmigrated(chunks).isEmpty():
            raise ValueError("some embeddings are of an older version: migrate them first")
        return index_members(chunks)

    def lists(self, query: str, index: DataFrame, k: int, hyde: list[float] | None = None, now: str | None = None, ingest: bool = False) -> DataFrame:
        """The ranked lists of all signals that have input."""
        s, depth = self.settings, k * self.settings.signal_depth
        terms = self.spark.range(1).select(tx.query_terms(F.lit(query)).alias("t"), tx.query_identifiers(F.lit(query)).alias("i"), tx.key_terms(F.lit(query)).alias("k")).first()
        vector = self.embedder.embed([query], "query")[0]
        counted = retrieval.query_tokens(self.spark, query)
        words = self.postings.search(counted, depth) if self.postings is not None and counted else retrieval.bm25(index, counted, s, depth)
        out = [fusion.ranked("bm25", words)]
        if vector is not None:
            focused = self.embedder.embed([terms["k"]], "query")[0] if terms["k"] else None
            out.append(fusion.ranked("text_cosine", retrieval.text_cosine(index, query, vector, terms["t"], terms["i"], focused, self._one(self.code_embedder, query), limit=depth)))
        if not ingest:
            members = index.select("chunk_id")
            authority = self.store.read("pages").select(F.col("url").alias("page_url"), "authority_score")
            seen = self.image_embedder.embed_labels([query])[0] if self.image_embedder is not None else None
            if seen is not None:
                near = retrieval.images_signal(self.store.read("images"), seen).join(members, "chunk_id", "left_semi")
                out.append(fusion.ranked("image_cosine", near, depth))
            out.append(fusion.ranked("graph", retrieval.graph_signal(index, authority)))
            if now is not None:
                out.append(fusion.ranked("recency", retrieval.recency_signal(index, now, s)))
            if hyde is not None:
                out.append(fusion.ranked("hyde_cosine", retrieval.cosine(index, hyde, depth)))
            token_rows = self.store.read("chunk_token_embeddings").join(members, "chunk_id", "left_semi")
            matrix = self.tokens.embed_tokens([query])[0]
            if matrix and not token_rows.isEmpty():
                fde = vx.fixed_encoding(np.array(matrix, np.float32), vx.hyperplanes(s.fde_buckets, len(matrix[0]), s.fde_seed)).tolist()
                out.append(fusion.ranked("maxsim", retrieval.maxsim_signal(token_rows, matrix, 3 * depth, fde, depth, retrieval.boosts(index, terms["t"], terms["i"]))))
            entities = self.store.read("entities")
            if vector is not None and not entities.isEmpty():
                found = retrieval.entity_signal(entities, self.store.read("chunk_entities"), vector, s).join(members, "chunk_id", "left_semi")
                out.append(fusion.ranked("entity", found))
        return fusion.union(out)

    @staticmethod
    def _one(embedder: Embedder | None, query: str) -> list[float] | None:
        return embedder.embed([query], "query")[0] if embedder is not None else None

    def retrieve_many(self, queries: dict[int, str], k: int, grid: dict[str, dict[str, float]] | None = None, now: str | None = None) -> DataFrame:
        """combo, query_id, chunk_id, rrf, place: the best k of each question under each weighting (that of the settings alone by default). The lists of a question are made
        once for all weightings, and all questions and weightings are fused in one plan."""
        s, index = self.settings, self.index()
        lists = [self.lists(q, index, k, now=now).withColumn("query_id", F.lit(i)) for i, q in queries.items()]
        held = written(fusion.union(lists), "lists")
        return batch.fuse_many(held, None, {c: {**s.weights, **w} for c, w in (grid or {"": {}}).items()}, k, s.rrf_k)

    def retrieve(self, query: str, k: int, weights: dict[str, float] | None = None, hyde: list[float] | None = None, now: str | None = None, ingest: bool = False) -> DataFrame:
        s, index = self.settings, self.index()
        wide = s.rerank_candidates if self.reranker is not None and not ingest else k
        fused = fusion.rrf(self.lists(query, index, wide, hyde, now, ingest), {**s.weights, **(weights or {})}, s.rrf_k)
        if self.reranker is not None and not ingest:
            wide = fusion.diversity_depth(fused, index.select("chunk_id", "content_type"), wide, s).first()["depth"]
        entries = fusion.result_rows(fusion.materialize(fusion.top(fused, wide), index))
        if self.reranker is not None and not ingest:
            entries = entries.checkpoint()
            return fusion.rerank(entries, rerank_logits(entries, query, self.reranker), k)
        return entries.orderBy(F.desc("score"), "chunk_id").limit(k)

    def plan(self, query: str) -> dict:
        """How much to look for, by the query's complexity."""
        s = self.settings
        kind = self.spark.range(1).select(tx.complexity(F.lit(query), s.simple_words, s.complex_words)).first()[0]
        k = {"simple": 5, "moderate": 10, "complex": 15}[kind]
        return {"complexity": kind, "top_k": k, "hyde": kind != "simple", "retrieve": 2 * k if s.parent_child else k}

    def ask(self, query: str, now: str | None = None, decompose: bool = False) -> dict:
        plan = self.plan(query)
        hyde = None
        if plan["hyde"] and self.llm is not None:
            hyde = self.embedder.embed([self.llm.generate(f"Write a passage that answers: {query}")], "document")[0]
        queries = [query]
        if decompose and self.llm is not None:
            found = json_between(self.llm.generate(f"Split into at most four questions, as a JSON list: {query}"), "[", "]") or []
            queries += [q for q in found if isinstance(q, str)][:4]
        results = fusion.best_of(fusion.union([self.retrieve(q, plan["retrieve"], hyde=hyde, now=now).withColumn("query_id", F.lit(i)) for i, q in enumerate(queries)])).drop("query_id").checkpoint()
        order = [F.desc_nulls_last("rerank_score")] if "rerank_score" in results.columns else []
        from pyspark.sql import Window

        placed = results.withColumn("position", F.row_number().over(Window.orderBy(*order, F.desc("score"), "chunk_id")))  # a few rows
        chunks = self.store.read("chunks")
        joined = placed.join(chunks.select("chunk_id", "parent_chunk_id"), "chunk_id", "left")
        shown = fusion.expand_to_parents(joined, chunks, plan["top_k"])
        final = shown.join(placed.drop("text", "chunk_id"), "position").withColumn("position", F.row_number().over(Window.orderBy("position")))
        context = fusion.context(final).first()["context"] or ""
        charts = fusion.charts_for(self.store.read("images"), placed.select("chunk_id"))
        answer = self.llm.generate(f"{context}\n\nQuestion: {query}", "Answer from the passages only.") if self.llm is not None else ""
        return {"answer": answer, "context": context, "sources": final, "charts": charts, **plan}

    def list_sources(self) -> DataFrame:
        return self.store.read("pages").select("url", "title", "fetched_at").orderBy(F.desc("fetched_at"), "url")

    def status(self) -> DataFrame:
        return self.store.status()


def refresh_graph(store: Store, settings: Settings = Settings()) -> None:
    """Centrality and spectral places of pages by links; chunks of pages that rose are corroborated."""
    before, links = store.read("pages"), store.read("page_links")
    # Places come first, as nothing may be written where they aren't found.
    places = graph.spectral(links, settings.spectral_dims).select(F.col("node").alias("url"), F.col("embedding").cast("array<float>").alias("graph_embedding"))
    scores = graph.centrality(links, settings).withColumnsRenamed({"node": "url", "score": "authority_score"})
    after = before.select("url").join(scores, "url", "left").select("url", F.coalesce("authority_score", F.lit(0.0)).alias("authority_score"))
    risen = incremental.authority_increases(before, after)
    chunks = store.read("chunks")
    hits = chunks.join(risen.select(F.col("url").alias("page_url")), "page_url", "left_semi").select("chunk_id")
    updated = corroborate(chunks, hits, F.current_timestamp(), settings.graph_increment)
    store.write("chunks", updated)
    store.write("pages", store_graph(before, after.join(places, "url", "left"), settings.spectral_dims))


class ResearchLoop:
    """Query, search, fetch, ingest, until nothing new comes."""

    def __init__(self, spark: SparkSession, store: Store, llm: Llm, search: Search, fetcher: Fetcher, embedder: Embedder, resolver: urls.Resolver, settings: Settings = Settings(), progress: Callable[[str], None] = lambda text: None, providers: Providers | None = None):
        self.providers = providers
        self.spark, self.store, self.llm, self.search, self.fetcher, self.embedder, self.resolver, self.settings, self.progress = spark, store, llm, search, fetcher, embedder, resolver, settings, progress

    def queries(self, prompt: str, context: str) -> list[str]:
        answer = self.llm.generate(f"Search queries as a JSON list for: {prompt}\n\n{context}")
        row = self.spark.range(1).select(tx.json_list_of_strings(F.lit(answer)).alias("q")).first()
        return [q for q in row["q"] if q]

    def run(self, prompt: str, max_depth: int = 3) -> dict:
        context, why, pages = "", "max_depth", 0
        for depth in range(max_depth):
            asked = self.queries(prompt, context) or self.queries(prompt, context)
            if not asked:
                why = "llm_returned_empty"
                break
            found = search_rows(self.spark.createDataFrame([(q,) for q in asked], "query string"), self.search).checkpoint()
            counts = {r["query"]: r["n"] for r in found.groupBy("query").agg(F.count("*").alias("n")).collect()}
            for q in asked:
                self.store.log_search(q, counts.get(q, 0))
            fresh = incremental.unseen(found.select("url").distinct(), self.store.read("pages"))
            got = written(safe_fetch(fresh, self.fetcher, self.resolver), "fetched")
            changed = ingest_pages(self.store, got.select("url", "html"), self.embedder, self.settings, providers=self.providers)
            new = changed.filter("change = 'new'").count()
            refresh_graph(self.store, self.settings)
            pages += new
            attempts = self.spark.createDataFrame([("new",)] * new + [("skipped",)] * (found.select("url").distinct().count() - new), "outcome string")
            self.progress(f"depth {depth + 1}: {new} new pages")
            if not incremental.novelty(attempts, self.settings.novelty_threshold).first()["goes_on"]:
                why = "low_novelty"
                break
            engine = QueryEngine(self.spark, self.store, self.embedder, settings=self.settings)
            context = "\n".join(r["text"] for r in engine.retrieve(prompt, self.settings.top_k, ingest=True).collect())
        return {"stopped": why, "pages": pages}


def log_to(path: str) -> Callable[[str], None]:
    """A progress callback that appends lines with a time to a file of the driver."""

    def write(text: str) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(f"{time.strftime('%Y-%m-%dT%H:%M:%S')} {text}\n")

    return write


def default_llm() -> Llm:
    return ScriptedLlm()
