"""Schemas of the stored tables."""

TABLES = {
    "pages": "url string, title string, html string, extracted_text string, fetched_at timestamp, graph_embedding array<float>, authority_score double, content_hash string, crawl_status string",
    "chunks": (
        "chunk_id string, page_url string, section_title string, text string, embedding array<float>, created_at timestamp, embedding_version int, content_type string, parent_chunk_id string, is_child boolean, context_summary string,"
        " last_corroborated_at timestamp, corroboration_strength double, code_embedding array<float>, cross_links array<string>, summary_embedding array<float>"
    ),
    "searches": "id long, query string, result_count int, created_at timestamp",
    "images": "image_id string, page_url string, src_url string, alt_text string, width int, height int, embedding array<float>, nearest_chunk_ids array<string>, image_bytes binary, is_chart boolean, created_at timestamp",
    "page_links": "source_url string, target_url string, anchor_text string",
    "chunk_token_embeddings": "chunk_id string, tokens array<array<float>>, token_count int, fde array<float>",
    "entities": "entity_id string, canonical_name string, definition string, aliases array<string>, entity_embedding array<float>, created_at timestamp",
    "chunk_entities": "chunk_id string, entity_id string",
    "pending_changes": "chunk_id string, page_url string",
    "embedding_memo": "kind string, text_hash string, embedding array<float>",
}
KEYS = {
    "pages": ["url"], "chunks": ["chunk_id"], "searches": ["id"], "images": ["image_id"], "page_links": ["source_url", "target_url"], "chunk_token_embeddings": ["chunk_id"], "entities": ["entity_id"], "chunk_entities": ["chunk_id", "entity_id"],
    "pending_changes": ["chunk_id"],
    "embedding_memo": ["kind", "text_hash"],
}
#: Values for columns that older tables lack.
DEFAULTS = {"pages": {"crawl_status": "'active'"}, "chunks": {"content_type": "'text'", "is_child": "false", "embedding_version": "0", "corroboration_strength": "0.0D", "last_corroborated_at": "created_at"}, "images": {"is_chart": "false"}}
