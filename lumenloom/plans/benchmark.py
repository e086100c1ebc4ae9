"""The benchmark matrix: ingest a corpus under each setting, retrieve its questions, report overlap and latency."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, evaluation
from ..operators.folders import written
from ..operators.store import Store
from ..sources.providers import Embedder, HashingEmbedder, HashingTokenEmbedder, TokenEmbedder, embed, embed_tokens
from .engine import QueryEngine
from .settings import Settings


def chunk_documents(docs: DataFrame, mode: str = "auto", settings: Settings = Settings()) -> DataFrame:
    """docs: path, url, type (html, code, text), text. page_url, chunk_no, text, content_type: by the chunker that the mode names, in auto by
    the document's type."""
    kind = F.col("type") if mode == "auto" else F.lit({"wiki": "html", "code": "code"}.get(mode, "text"))
    routed = docs.withColumn("route", F.when(kind.isin("html", "code"), kind).otherwise("text"))
    plain = routed.filter("route = 'text'").select(F.col("url").alias("page_url"), "text")
    wiki = routed.filter("route = 'html'").select(F.col("url").alias("page_url"), F.lit(None).cast("string").alias("title"), F.col("text").alias("html"))
    code = routed.filter("route = 'code'").select(F.col("url").alias("page_url"), "path", F.col("text").alias("source"))
    columns = ["page_url", "chunk_no", "text", "content_type"]
    out = chunking.chunk_paragraphs(plain, settings.paragraph_tokens).select(columns)
    out = out.unionByName(chunking.chunk_wiki(wiki, settings.section_tokens).select(columns))
    return out.unionByName(chunking.chunk_code(code, small=settings.small_class_tokens).withColumn("content_type", F.lit("code")).select(columns))


def ingest(store: Store, docs: DataFrame, mode: str, embedder: Embedder, settings: Settings = Settings(), code_embedder: Embedder | None = None, tokens: TokenEmbedder | None = None) -> int:
    """Parents and all their children into an empty store, with code vectors and token matrices if there are encoders for them; the number of chunks."""
    chunks = chunk_documents(docs, mode, settings).withColumn("chunk_id", tx.bench_chunk_id(F.col("page_url"), F.col("chunk_no"))).withColumn("section_title", F.lit(""))
    parents = embed(chunks, embedder).checkpoint()
    children = embed(chunking.chunk_children(parents, settings.child_tokens), embedder).checkpoint()
    columns = ["chunk_id", "page_url", "section_title", "text", "embedding", "content_type", "parent_chunk_id", "is_child", "embedding_version"]
    rows = parents.select("chunk_id", "page_url", "section_title", "text", "embedding", "content_type", F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(False).alias("is_child"), F.lit(1).alias("embedding_version"))
    rows = rows.unionByName(children.withColumn("embedding_version", F.lit(1)).select(columns))
    if code_embedder is not None:
        rows = rows.withColumn("code_text", F.when(F.col("content_type") == "code", F.col("text")))
        rows = embed(rows, code_embedder, "code_text", "code_embedding").withColumn("code_embedding", F.when(F.col("code_text").isNotNull(), F.col("code_embedding"))).drop("code_text")
    store.upsert("chunks", written(rows, "bench"))
    if tokens is not None:
        found = embed_tokens(store.read("chunks").select("chunk_id", "text"), tokens).filter("tokens is not null")
        store.write("chunk_token_embeddings", found.select("chunk_id", "tokens", "token_count", "fde"))
    return store.read("chunks").count()


class BenchmarkRunner:
    """Configs that ingest alike share a store, and the ranked lists of its questions: they are made once, and all their weightings are fused in one plan. An error in one group of configs is
    recorded, the others go on. The latency of a question is its share of the group's time."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder, settings: Settings = Settings(), progress: Callable[[str], None] = lambda text: None, code_embedder: Embedder | None = None, tokens: TokenEmbedder | None = None):
        self.spark, self.folder, self.embedder, self.settings, self.progress = spark, folder, embedder, settings, progress
        self.code_embedder, self.tokens = code_embedder or HashingEmbedder(embedder.dims), tokens or HashingTokenEmbedder()

    def _group(self, number: int, key: tuple, docs: DataFrame, queries: list[dict], configs: list[dict], k: int) -> DataFrame:
        mode, code, matrices = key
        code_embedder, tokens = (self.code_embedder if code else None), (self.tokens if matrices else None)
        store, began = Store(self.spark, f"{self.folder}/{number}"), time.time()
        n = ingest(store, docs, mode, self.embedder, self.settings, code_embedder, tokens)
        seconds, began = time.time() - began, time.time()
        engine = QueryEngine(self.spark, store, self.embedder, settings=self.settings, code_embedder=code_embedder, tokens=tokens)
        grid = {c["config_name"]: c.get("weights") or {} for c in configs}
        found = engine.retrieve_many({i: q["query"] for i, q in enumerate(queries)}, k, grid).join(store.read("chunks").select("chunk_id", "text"), "chunk_id")
        asked = self.spark.createDataFrame([(i, q["query"], q.get("source_doc"), q.get("difficulty")) for i, q in enumerate(queries)], "query_id int, query string, source_doc string, difficulty string")
        names = self.spark.createDataFrame([(name,) for name in grid], "config_name string")
        pairs = asked.crossJoin(names)  # questions and configs are stated sets
        passages = self.spark.createDataFrame([(i, p) for i, q in enumerate(queries) for p in q["expected_passages"]], "query_id int, passage string")
        run = lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("i")).alias("query_id")
        expected = passages.crossJoin(names).select(run(F.col("config_name"), F.col("query_id")), "passage")
        scores = written(evaluation.overlap_score(expected, found.select(run(F.col("combo"), F.col("query_id")), "text")), "scores").select(F.col("query_id.c").alias("c"), F.col("query_id.i").alias("i"), "score")
        share = (time.time() - began) * 1000 / (len(queries) * len(configs))
        joined = pairs.join(scores, (F.col("config_name") == F.col("c")) & (F.col("query_id") == F.col("i")), "left")
        return joined.select("config_name", "query", "source_doc", "difficulty", F.coalesce("score", F.lit(0.0)).alias("overlap"), F.lit(share).alias("latency_ms"), F.lit(n).alias("chunks"), F.lit(seconds).alias("ingest_s"))

    def run(self, docs: DataFrame, queries: list[dict], configs: list[dict], k: int = 10) -> tuple[DataFrame, DataFrame]:
        """(details, errors): details have a row for each config and question with its overlap and latency."""
        details = self.spark.createDataFrame([], "config_name string, query string, source_doc string, difficulty string, overlap double, latency_ms double, chunks int, ingest_s double")
        errors, groups = [], {}
        for config in configs:
            if "chunk_mode" not in config:
                errors.append((config["config_name"], "no chunk_mode"))
            else:
                groups.setdefault((config["chunk_mode"], bool(config.get("code_embeddings")), bool(config.get("token_embeddings"))), []).append(config)
        for number, (key, members) in enumerate(groups.items()):
            try:
                details = details.unionByName(written(self._group(number, key, docs, queries, members, k), "details"))
                self.progress(f"{key}: {len(members)} configs")
            except Exception as e:  # noqa: BLE001  recorded
                errors += [(c["config_name"], str(e)[:500]) for c in members]
        return details, self.spark.createDataFrame(errors, "config_name string, error string")
