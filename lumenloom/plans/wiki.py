"""A whole wiki or documentation site: crawl its pages breadth first, mark what is gone as stale, store chunks by section."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import chunking
from ..operators import store as tables
from ..operators.store import Store
from ..sources.providers import Embedder, Fetcher
from .engine import refresh_graph
from .fetching import safe_fetch
from .ingest import ingest_pages
from .settings import Settings

#: What became of a URL that the crawl met.
OUTCOMES = ("fetched", "failed", "unsafe", "redirected away", "of a repository", "repository", "external", "beyond depth")


def with_browser(got: DataFrame, browser: Fetcher | None, resolver: urls.Resolver, wait: Callable[[str], None] | None = None) -> DataFrame:
    """Pages that need scripts are fetched again by a second fetcher; where it fails the first answer stays."""
    if browser is None:
        return got
    got = got.checkpoint()
    texts = chunking.html_text(got.select(F.col("url").alias("page_url"), "html")).select(F.col("page_url").alias("url"), "text")
    needy = got.join(texts, "url").filter(urls.needs_browser(F.col("url"), F.col("text"), F.col("html"))).select("url")
    again = safe_fetch(needy, browser, resolver, wait).select("url", F.col("html").alias("_html"), F.col("final_url").alias("_final"))
    return got.join(again, "url", "left").select("url", F.coalesce("_html", "html").alias("html"), F.coalesce("_final", "final_url").alias("final_url"))


def crawl(spark: SparkSession, seed: str, fetcher: Fetcher, resolver: urls.Resolver, browser: Fetcher | None = None, max_depth: int = 50, wait: Callable[[str], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages: url, html; met: url, depth, outcome). Each level of links is one frontier DataFrame; a URL is met once, in its canonical form.

    Pages below a repository that is linked somewhere on the site are left to the repository's own indexing."""
    seed = urls.canonical_text(seed)
    host = urlsplit(seed).netloc
    frontier = spark.createDataFrame([(seed, 0)], "url string, depth int")
    met, pages, prefixes = None, None, None
    for depth in range(max_depth + 1):
        kind = urls.classify(F.col("url"), host)
        placed = frontier.withColumn("kind", F.when(urls.is_repository(F.col("url")) & (F.col("depth") > 0), "repo").otherwise(kind)).withColumn("prefix", urls.repository_prefix(F.col("url"))).checkpoint()
        known = placed.filter("kind = 'repo'").select("prefix").distinct()
        prefixes = (known if prefixes is None else prefixes.union(known).distinct()).checkpoint()
        own = placed.filter("kind = 'same-domain'").join(prefixes, "prefix", "left_anti")
        got = with_browser(safe_fetch(own, fetcher, resolver, wait), browser, resolver, wait).checkpoint()
        home = urls.netloc(F.col("final_url")) == host
        safe = urls.safe_rows(own.select("url"), resolver).withColumn("_safe", F.lit(True))
        state = placed.join(got.select("url", home.alias("_home")), "url", "left").join(safe, "url", "left")
        outcome = F.when(F.col("kind") == "repo", "repository").when(F.col("kind") == "external", "external").when(F.col("_home"), "fetched").when(~F.col("_home"), "redirected away")
        outcome = outcome.when(F.col("prefix").isNotNull(), "of a repository").when(F.col("_safe").isNull(), "unsafe").otherwise("failed")
        level = state.select("url", "depth", outcome.alias("outcome")).checkpoint()
        met = level if met is None else met.union(level)
        kept = got.filter(home).select("url", "html")
        pages = kept if pages is None else pages.union(kept)
        links = chunking.html_links(kept.select(F.col("url").alias("page_url"), "html")).select(urls.canonical(F.regexp_replace("target_url", "#.*$", "")).alias("url")).distinct()
        frontier = links.join(met.select("url"), "url", "left_anti").select("url", F.lit(depth + 1).alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        if depth % 5 == 4:
            met, pages = met.checkpoint(), pages.checkpoint()
    else:
        met = met.union(frontier.select("url", "depth", F.lit("beyond depth")))
    return pages.checkpoint(), met.checkpoint()


def counters(met: DataFrame) -> DataFrame:
    """One row: how many URLs were discovered, and of each outcome."""
    return met.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in OUTCOMES])


def ingest_wiki(store: Store, seed: str, fetcher: Fetcher, embedder: Embedder, resolver: urls.Resolver, settings: Settings = Settings(), browser: Fetcher | None = None, max_depth: int = 50, wait: Callable[[str], None] | None = None) -> DataFrame:
    """Crawl and store a site: the counters of the crawl. Pages of the host that were not met any more are marked as stale, none is deleted."""
    pages, met = crawl(store.spark, seed, fetcher, resolver, browser, max_depth, wait)
    host = urlsplit(urls.canonical_text(seed)).netloc
    sections = lambda fresh: chunking.chunk_wiki(fresh.select(F.col("url").alias("page_url"), "title", "html"), settings.section_tokens)
    ingest_pages(store, pages, embedder, settings, chunker=sections)
    store.write("pages", tables.mark_active(tables.mark_stale(store.read("pages"), host), pages.select("url")))
    refresh_graph(store, settings)
    return counters(met)
