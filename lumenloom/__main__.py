"""Command line: status, sources, query, research, wiki, ingest, reingest, migrate, repo, benchmark, compare, eval.

Commands that need a network or models take them from `--providers module:function`, a function without arguments that returns a dict of
any of embedder, reranker, llm, search, fetcher, browser, resolver and wait. The offline stand-ins fill what is missing where there are any."""

from __future__ import annotations

import argparse
import importlib
import json
import socket

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .operators.store import Store
from .plans.benchmark import BenchmarkRunner
from .plans.engine import QueryEngine, ResearchLoop, log_to, refresh_graph, unmigrated
from .plans.ingest import Providers, ingest_pages
from .plans.settings import Settings
from .plans.wiki import ingest_wiki
from .sources import files
from .sources.providers import HashingEmbedder, OverlapReranker, embed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenloom", description=__doc__)
    p.add_argument("--store", default="lumenloom-store", help="folder of the tables")
    p.add_argument("--providers", help="module:function that returns the providers")
    p.add_argument("--log", help="file for progress lines")
    p.add_argument("--json", action="store_true", help="rows as JSON instead of a table")
    sub = p.add_subparsers(dest="command", required=True)
    research = sub.add_parser("research")
    research.add_argument("prompt")
    research.add_argument("--max-depth", type=int, default=5)
    research.add_argument("--similarity-threshold", type=float, default=0.85)
    wiki = sub.add_parser("wiki")
    wiki.add_argument("url")
    wiki.add_argument("--max-depth", type=int, default=50)
    bench = sub.add_parser("benchmark")
    bench.add_argument("truth", help="ground-truth file")
    bench.add_argument("folder", help="folder of its documents")
    bench.add_argument("--config", help="names with commas between them; all by default")
    bench.add_argument("--top-k", type=int, default=10)
    bench.add_argument("--output", help="folder for the details as JSON")
    sub.add_parser("status")
    sub.add_parser("sources")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--rerank", action="store_true")
    q.add_argument("--now")
    i = sub.add_parser("ingest")
    i.add_argument("pages", help="Parquet table of url and html")
    sub.add_parser("reingest")
    sub.add_parser("migrate")
    r = sub.add_parser("repo")
    r.add_argument("folder")
    r.add_argument("--url", required=True)
    r.add_argument("--branch", default="")
    c = sub.add_parser("compare")
    c.add_argument("a")
    c.add_argument("b")
    e = sub.add_parser("eval")
    e.add_argument("queries")
    e.add_argument("-k", type=int, default=10)
    return p


def providers(name: str | None) -> dict:
    if not name:
        return {}
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def needed(found: dict, *names: str) -> list:
    missing = [n for n in names if n not in found]
    if missing:
        raise SystemExit(f"this command needs --providers with {', '.join(missing)}")
    return [found[n] for n in names]


def resolve_host(host: str) -> list[str]:
    return sorted({a[4][0] for a in socket.getaddrinfo(host, None)})


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lumenloom").getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{a.store}/_checkpoints")
    given = providers(a.providers)
    store, embedder = Store(spark, a.store), given.get("embedder") or HashingEmbedder()
    engine = QueryEngine(spark, store, embedder, given.get("reranker") or (OverlapReranker() if getattr(a, "rerank", False) else None), given.get("llm"), given.get("tokens"), code_embedder=given.get("code_embedder"), image_embedder=given.get("image_embedder"))
    made = Providers(embedder, **{k: given.get(k) for k in ("code_embedder", "tokens", "llm", "image_embedder", "download")}, memo=True, contextual=bool(given.get("contextual")))
    progress, resolver = log_to(a.log) if a.log else (lambda text: None), given.get("resolver") or resolve_host
    show = lambda rows: print("\n".join(r for r in rows.limit(1000).toJSON().collect()) if a.json else files.format_table(rows))
    if a.command == "research":
        llm, search, fetcher = needed(given, "llm", "search", "fetcher")
        settings = Settings(duplicate_threshold=a.similarity_threshold)
        print(json.dumps(ResearchLoop(spark, store, llm, search, fetcher, embedder, resolver, settings, progress, made).run(a.prompt, a.max_depth)))
    elif a.command == "wiki":
        (fetcher,) = needed(given, "fetcher")
        show(ingest_wiki(store, a.url, fetcher, embedder, resolver, browser=given.get("browser"), max_depth=a.max_depth, wait=given.get("wait")))
    elif a.command == "benchmark":
        docs, queries = files.corpus(spark, a.truth, a.folder)
        wanted = a.config.split(",") if a.config else None
        configs = [c for c in evaluation.benchmark_matrix() if wanted is None or c["config_name"] in wanted]
        details, errors = BenchmarkRunner(spark, f"{a.store}/_benchmark", embedder, progress=progress, code_embedder=given.get("code_embedder"), tokens=given.get("tokens")).run(docs, [r.asDict() for r in queries.collect()], configs, a.top_k)
        show(evaluation.roll_up(details))
        if not errors.isEmpty():
            show(errors)
        if a.output:
            files.save_report(details, a.output)
    elif a.command == "status":
        show(engine.status())
    elif a.command == "sources":
        show(engine.list_sources())
    elif a.command == "query":
        print(engine.ask(a.question, a.now)["context"])
    elif a.command == "ingest":
        print(files.format_table(ingest_pages(store, spark.read.parquet(a.pages).select("url", "html"), embedder, providers=made).groupBy("change").count()))
        refresh_graph(store)
    elif a.command == "reingest":
        pages = store.read("pages").select("url", "html").checkpoint()
        store.write("pages", store.read("pages").withColumn("content_hash", F.lit(None).cast("string")))
        print(files.format_table(ingest_pages(store, pages, embedder, providers=made).groupBy("change").count()))
    elif a.command == "migrate":
        chunks = store.read("chunks")
        todo = unmigrated(chunks).drop("embedding", "embedding_version")
        fresh = embed(todo, embedder).withColumn("embedding_version", F.lit(1)).select(*chunks.columns)
        rest = chunks.join(todo.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)
        total, migrated = chunks.count(), todo.count()
        store.write("chunks", rest.unionByName(fresh))
        print(f"total {total}, migrated {migrated}, skipped {total - migrated}")
    elif a.command == "repo":
        found = files.index_files(files.discover(spark, a.folder), F.lit(a.url), a.branch)
        rows = embed(found, embedder).withColumn("section_title", F.col("page_url")).withColumn("embedding_version", F.lit(1))
        store.upsert("chunks", rows.select("chunk_id", "page_url", "section_title", "text", "embedding", "content_type", "embedding_version"))
        print(files.format_table(found.groupBy("content_type").count()))
    elif a.command == "compare":
        show(files.compare_files(spark, a.a, a.b))
    elif a.command == "eval":
        queries = files.eval_set(spark, a.queries).collect()  # a stated set
        ranked = engine.retrieve_many({i: q["query"] for i, q in enumerate(queries)}, a.k).select("query_id", "chunk_id", (F.col("place") - 1).alias("rank"))
        relevant = spark.createDataFrame([(i, c) for i, q in enumerate(queries) for c in q["relevant_chunk_ids"]], "query_id int, chunk_id string")
        found = evaluation.precision_recall(ranked, relevant, a.k)
        show(evaluation.macro(found))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
