"""Ingestion of pages as one dataflow over the store's tables.

What a batch of pages changes is one set of chunk ids, the ChangeSet: those that go, those that are new or have another text, and those that stay. Every
table that hangs on chunks follows it: token matrices and postings of changed chunks are made anew, others are left alone; entity links of chunks that go or
change go, and with the last link an entity; images of the pages are looked at again. So nothing points at a chunk that isn't there.

The change set is written to `pending_changes` first and taken out at the end, and pages are written last. A run that stops in between finds its pages changed again, and what hangs on the
chunks that were pending is made once more, whether or not the chunks themselves were stored. (Its duplicates then corroborate their chunks a second time.)"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions import vectors as vx
from ..operators import chunking, incremental
from ..operators.folders import written
from ..operators.postings import Postings
from ..operators.store import Store, corroborate
from ..sources.providers import Embedder, ImageEmbedder, Llm, TokenEmbedder, embed_column, embed_images, embed_tokens, fetch_images
from .generation import extract_entities, link_entities, summaries
from .settings import Settings

CHART_LABELS = (["a chart or graph", "a diagram", "a data plot"], ["a photograph", "a logo or icon", "a screenshot"])


@dataclass
class Providers:
    """What ingestion may call; what is missing leaves its tables and columns empty."""

    embedder: Embedder
    code_embedder: Embedder | None = None
    tokens: TokenEmbedder | None = None
    llm: Llm | None = None
    image_embedder: ImageEmbedder | None = None
    download: Callable[[str], bytes | None] | None = None
    postings: Postings | None = None
    memo: bool = False  # keep vectors of texts in the store, so that no text is encoded twice
    contextual: bool = False  # summaries by the language model before passages are encoded
    entities: bool = True


@dataclass
class ChangeSet:
    """gone: chunk_id. changed: chunk_id, text of new chunks and those with another text."""

    gone: DataFrame
    changed: DataFrame

    def left(self) -> DataFrame:
        """chunk_ids whose old dependents don't count any more."""
        return self.gone.select("chunk_id").unionByName(self.changed.select("chunk_id"))


def change_set(old: DataFrame, new: DataFrame, pending: DataFrame | None = None) -> ChangeSet:
    """old and new: chunk_id, text of the chunks that pages had and have; pending: chunk_id of those that an earlier run didn't finish with."""
    before = old.select(F.col("chunk_id").alias("b_id"), F.col("text").alias("b_text"))
    if pending is not None:
        before = before.withColumn("b_open", F.lit(False)).unionByName(pending.select(F.col("chunk_id").alias("b_id"), F.lit(None).cast("string").alias("b_text"), F.lit(True).alias("b_open")))
        before = before.groupBy("b_id").agg(F.max("b_text").alias("b_text"), F.max("b_open").alias("b_open")).select("b_id", F.when(~F.col("b_open"), F.col("b_text")).alias("b_text"))
    joined = written(new.select("chunk_id", "text").join(before, F.col("chunk_id") == F.col("b_id"), "full_outer"), "changes")
    gone = joined.filter("chunk_id is null").select(F.col("b_id").alias("chunk_id"))
    changed = joined.filter("chunk_id is not null and (b_id is null or not (text <=> b_text))").select("chunk_id", "text")
    return ChangeSet(gone, changed)


def encode(store: Store, df: DataFrame, embedder: Embedder, kind: str, column: str | Column = "text", to: str = "embedding", mode: str = "document", memo: bool = False) -> DataFrame:
    """df with a vector of each distinct text. With the memo, texts that the store has a vector of are not encoded: what is missing is found by an anti-join, encoded, and
    written in one step, before anything uses it. kind names the model and purpose: vectors of one kind are never taken for another."""
    from ..shipping import ship

    ship(df.sparkSession)
    rows = df.withColumn("_text", F.col(column) if isinstance(column, str) else column).withColumn("_h", F.sha2(F.col("_text"), 256))
    distinct = rows.filter("_text is not null").groupBy("_h").agg(F.first("_text").alias("_text"))
    if not memo:
        made = distinct.select(F.col("_h").alias("_k"), embed_column(F.col("_text"), embedder, mode).alias(to))
    else:
        name = f"{kind}:{mode}"
        known = store.read("embedding_memo").filter(F.col("kind") == name).select("text_hash")
        missing = distinct.join(known, F.col("_h") == F.col("text_hash"), "left_anti")
        store.merge("embedding_memo", written(missing.select(F.lit(name).alias("kind"), F.col("_h").alias("text_hash"), embed_column(F.col("_text"), embedder, mode).alias("embedding")), "memo"))
        made = store.read("embedding_memo").filter(F.col("kind") == name).select(F.col("text_hash").alias("_k"), F.col("embedding").alias(to))
    return rows.join(made, F.col("_h") == F.col("_k"), "left").drop("_h", "_k", "_text")


def _vectors(store: Store, chunks: DataFrame, p: Providers) -> DataFrame:
    """chunks with embedding and, for code, code_embedding; a summary goes before the text."""
    text = F.concat(F.coalesce(F.concat("context_summary", F.lit("\n\n")), F.lit("")), "text")
    out = encode(store, chunks, p.embedder, "text", text, memo=p.memo)
    if p.code_embedder is None:
        return out.withColumn("code_embedding", F.lit(None).cast("array<float>"))
    return encode(store, out, p.code_embedder, "code", F.when(F.col("content_type") == "code", text), "code_embedding", memo=p.memo)


def _entities(store: Store, parents: DataFrame, children: DataFrame, changes: ChangeSet, p: Providers, s: Settings) -> None:
    """Links of chunks that went or changed go; new ones come from the model, and children have their parent's. Entities that lost their last link go."""
    stored_links = store.read("chunk_entities")
    dead = written(stored_links.join(changes.left().distinct(), "chunk_id", "left_semi"), "links")
    links, entities = None, None
    if p.llm is not None and p.entities:
        asked = parents.join(changes.changed.select("chunk_id"), "chunk_id", "left_semi")
        mentions = written(extract_entities(asked.select("chunk_id", "text"), p.llm), "mentions")
        found, own = link_entities(mentions, p.embedder, s.entity_threshold, store.read("entities"))
        entities = written(found, "entities")
        of_children = children.select(F.col("chunk_id").alias("c"), "parent_chunk_id").join(own, F.col("parent_chunk_id") == F.col("chunk_id")).select(F.col("c").alias("chunk_id"), "entity_id")
        links = written(own.unionByName(of_children).distinct(), "links")
    store.merge("chunk_entities", links, gone=dead)
    if entities is not None:
        store.merge("entities", entities)
    lost = dead.select("entity_id").distinct().join(store.read("chunk_entities"), "entity_id", "left_anti")
    store.merge("entities", gone=written(lost, "lost"))


def _images(store: Store, fresh: DataFrame, chunks: DataFrame, p: Providers) -> None:
    """Images of the fresh pages with their vectors and the chunks next to them; those that the pages no longer have go."""
    pages = fresh.select(F.col("url").alias("page_url"), "html")
    found = written(chunking.html_images(pages).dropDuplicates(["image_id"]), "images")
    if found.isEmpty() and not store.has("images"):
        return
    placed = chunks.filter("not is_child").join(pages, "page_url").select("page_url", "chunk_id", incremental.text_offset(F.col("html"), F.col("text")).alias("offset"))
    near = incremental.nearest_chunks(found.select("page_url", "image_id", "dom_offset"), placed).select(F.col("image_id").alias("n_id"), F.array_compact(F.array("before", "after")).alias("nearest_chunk_ids"))
    rows = found.join(near, F.col("image_id") == F.col("n_id"), "left").drop("n_id", "dom_offset")
    if p.download is not None and p.image_embedder is not None:
        got = fetch_images(found, p.download, urls.netloc(F.col("src_url"))).withColumnsRenamed({"image_id": "g_id", "width": "g_width", "height": "g_height"})
        rows = embed_images(rows.join(got, F.col("image_id") == F.col("g_id"), "left"), p.image_embedder)
        charts, others = (p.image_embedder.embed_labels(labels) for labels in CHART_LABELS)
        chart = F.coalesce(vx.is_chart(F.col("embedding"), charts, others), F.lit(False))
        rows = rows.withColumn("is_chart", chart).withColumn("image_bytes", F.when(chart, F.col("image_bytes"))).withColumn("width", F.coalesce("g_width", "width")).withColumn("height", F.coalesce("g_height", "height"))
    else:
        rows = rows.withColumn("is_chart", F.lit(False)).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("image_bytes", F.lit(None).cast("binary"))
    rows = written(rows.select("image_id", "page_url", "src_url", "alt_text", "width", "height", "embedding", "nearest_chunk_ids", "image_bytes", "is_chart"), "images")
    had = store.read("images").join(pages.select("page_url"), "page_url", "left_semi")
    store.merge("images", rows, gone=written(had.select("image_id").join(rows.select("image_id"), "image_id", "left_anti"), "images"))


def ingest_pages(store: Store, pages: DataFrame, embedder: Embedder, settings: Settings = Settings(), tokens: TokenEmbedder | None = None, chunker: Callable[[DataFrame], DataFrame] | None = None, providers: Providers | None = None) -> DataFrame:
    """pages: url, html. Extract, skip what is unchanged, chunk, encode, filter near-duplicates against the whole store and within the batch, store, and bring along what hangs
    on chunks. chunker makes chunks (as chunk_paragraphs, with section_title) of the fresh pages (url, title, text, html). Returns url, change."""
    s = settings
    p = providers or Providers(embedder, tokens=tokens)
    extracted = chunking.html_text(pages.select(F.col("url").alias("page_url"), "html")).withColumnRenamed("page_url", "url")
    extracted = written(extracted.filter(F.length(F.trim("text")) >= s.min_content_chars).join(pages, "url"), "extracted")
    changed_pages = written(incremental.changes(extracted, store.read("pages")), "pages")
    fresh = extracted.join(changed_pages.filter("change <> 'unchanged'"), "url")
    if fresh.isEmpty():
        return changed_pages
    stored = store.read("chunks")
    old = stored.join(fresh.select(F.col("url").alias("page_url")), "page_url", "left_semi")
    kept = stored.join(fresh.select(F.col("url").alias("page_url")), "page_url", "left_anti")

    chunks = chunker(fresh) if chunker else chunking.chunk_paragraphs(fresh.select(F.col("url").alias("page_url"), "text"), s.paragraph_tokens).withColumn("section_title", F.lit(""))
    if p.llm is not None and p.contextual:
        whole = fresh.select(F.col("url").alias("page_url"), F.col("text").alias("document"))
        chunks = summaries(chunks.join(whole, "page_url"), p.llm).drop("document")
    else:
        chunks = chunks.withColumn("context_summary", F.lit(None).cast("string"))
    chunks = written(_vectors(store, chunks, p), "chunks")

    embedded = chunks.filter("embedding is not null").select(F.col("chunk_id").alias("id"), F.struct("page_url", "chunk_no").alias("seq"), "embedding")
    against = kept.filter("embedding is not null and not coalesce(is_child, false)").select(F.col("chunk_id").alias("id"), "embedding")
    of_store = written(incremental.matches(embedded, against, s.duplicate_threshold, best=True).select("id", F.col("match").alias("duplicate_of")), "repeats")
    of_batch = incremental.greedy_by_pairs(embedded.join(of_store, "id", "left_anti"), s.duplicate_threshold).filter("duplicate_of is not null")
    duplicates = written(of_store.union(of_batch), "repeats")

    new = chunks.join(duplicates.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    columns = ["chunk_id", "page_url", "section_title", "text", "embedding", "code_embedding", "context_summary", "content_type", "parent_chunk_id", "is_child", "embedding_version"]
    parents = new.withColumns({"parent_chunk_id": F.lit(None).cast("string"), "is_child": F.lit(False), "embedding_version": F.lit(1)}).select(columns)
    rows = parents
    if s.parent_child:
        children = chunking.chunk_children(parents, s.child_tokens, keep_single=False).drop("context_summary").withColumn("context_summary", F.lit(None).cast("string"))
        rows = parents.unionByName(_vectors(store, children, p).withColumn("embedding_version", F.lit(1)).select(columns))
    rows = written(rows, "chunks")
    urls_ = fresh.select(F.col("url").alias("page_url"))
    pending = store.read("pending_changes").join(urls_, "page_url", "left_semi") if store.has("pending_changes") else None
    changes = change_set(old, rows, pending)
    places = old.select("chunk_id", "page_url").unionByName(rows.select("chunk_id", "page_url")).dropDuplicates(["chunk_id"])
    store.merge("pending_changes", written(changes.left().join(places, "chunk_id").select("chunk_id", "page_url"), "pending"))
    hits = duplicates.select(F.col("duplicate_of").alias("chunk_id"))
    store.merge("chunks", rows, gone=changes.gone, also=hits, then=lambda t: corroborate(t, hits, F.current_timestamp(), s.dedup_increment))

    if p.tokens is not None:
        matrices = written(embed_tokens(changes.changed, p.tokens).filter("tokens is not null").select("chunk_id", "tokens", "token_count", "fde"), "tokens")
        store.merge("chunk_token_embeddings", matrices, gone=changes.left())
    elif store.has("chunk_token_embeddings"):
        store.merge("chunk_token_embeddings", gone=changes.left())
    if store.has("chunk_entities") or (p.llm is not None and p.entities):
        _entities(store, rows.filter("not is_child"), rows.filter("is_child"), changes, p, s)
    _images(store, fresh, rows, p)
    if p.postings is not None:
        covered = rows.filter("is_child").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
        p.postings.delete(changes.gone.unionByName(covered))
        p.postings.add(rows.join(covered, "chunk_id", "left_anti").join(changes.changed.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text"))
    store.merge("page_links", written(chunking.html_links(fresh.select(F.col("url").alias("page_url"), "html")), "links"))
    store.merge("pages", fresh.select("url", "title", "html", F.col("text").alias("extracted_text"), "content_hash"))
    store.merge("pending_changes", gone=written(store.read("pending_changes").join(urls_, "page_url", "left_semi").select("chunk_id"), "pending"))
    return changed_pages


def orphans(store: Store) -> DataFrame:
    """One row: how many rows point at chunks, entities or pages that aren't there; all are 0 after ingestion."""
    chunks = store.read("chunks").select("chunk_id")
    count = lambda df, label: df.agg(F.count("*").alias(label))
    out = count(store.read("chunk_token_embeddings").join(chunks, "chunk_id", "left_anti"), "token_rows")
    links = store.read("chunk_entities")
    out = out.crossJoin(count(links.join(chunks, "chunk_id", "left_anti"), "entity_links"))  # one row each
    out = out.crossJoin(count(store.read("entities").join(links, "entity_id", "left_anti"), "entities"))
    near = store.read("images").select(F.explode("nearest_chunk_ids").alias("chunk_id"))
    out = out.crossJoin(count(near.join(chunks, "chunk_id", "left_anti"), "image_places"))
    parents = store.read("chunks").filter("is_child").select(F.col("parent_chunk_id").alias("chunk_id"))
    return out.crossJoin(count(parents.join(chunks, "chunk_id", "left_anti"), "children"))
