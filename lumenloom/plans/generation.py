"""What a language model does in ingestion and evaluation: prompts and the reading of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import incremental
from ..sources.providers import Embedder, Llm, embed, generate_column, json_between
from ..shipping import ship

ENTITIES = "array<struct<name: string, definition: string>>"


def summaries(chunks: DataFrame, llm: Llm) -> DataFrame:
    """chunks (chunk_id, text, document) with context_summary: what the passage is about within its document."""
    ship(chunks.sparkSession)
    prompt = F.concat(F.lit("Say in a sentence what this passage is about within its document.\n\nDocument: "), F.col("document"), F.lit("\n\nPassage: "), F.col("text"))
    return chunks.withColumn("context_summary", F.trim(generate_column(prompt, llm)))


def json_array(answer: Column) -> Column:
    """From the first [ to the last ]."""
    return F.regexp_extract(answer, r"(?s)(\[.*\])", 1)


def extract_entities(chunks: DataFrame, llm: Llm) -> DataFrame:
    """chunk_id, name, definition; answers that can't be read give nothing."""
    ship(chunks.sparkSession)
    prompt = F.concat(F.lit('List the entities of this passage as JSON: [{"name": ..., "definition": ...}]\n\n'), F.col("text"))
    found = chunks.select("chunk_id", F.from_json(json_array(generate_column(prompt, llm)), ENTITIES).alias("e"))
    return found.select("chunk_id", F.explode("e").alias("e")).select("chunk_id", F.trim("e.name").alias("name"), F.coalesce("e.definition", F.lit("")).alias("definition")).filter("name <> ''")


def link_entities(mentions: DataFrame, embedder: Embedder, threshold: float = 0.75, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, chunk_entities) of mentions (chunk_id, name, definition): names that mean the same become one entity, in order of first mention. Names near
    a stored entity (canonical_name, definition, aliases, entity_embedding) are its aliases, added to those that it has."""
    first = mentions.groupBy("name").agg(F.min(F.struct("chunk_id", "definition")).alias("m")).select("name", "m.chunk_id", "m.definition")
    named = embed(first.withColumn("seq", F.struct("chunk_id", "name")), embedder, "name").checkpoint()
    known = None if stored is None else stored.filter("entity_embedding is not null").select("canonical_name", F.col("entity_embedding").alias("embedding"))
    resolved = incremental.resolve_entities(named.filter("embedding is not null").select("name", "seq", "embedding"), threshold, known).checkpoint()
    facts = named.select(F.col("name").alias("canonical_name"), "definition", F.col("embedding").alias("entity_embedding"), F.expr("array()").cast("array<string>").alias("_had"))
    if stored is not None:
        old = stored.filter("entity_embedding is not null").select("canonical_name", "definition", "entity_embedding", F.coalesce("aliases", F.expr("array()").cast("array<string>")).alias("_had"))
        facts = old.union(facts.join(old, "canonical_name", "left_anti"))
    entities = incremental.aliases(resolved).join(facts, "canonical_name").withColumn("aliases", F.array_sort(F.array_union("aliases", "_had")))
    links = mentions.join(resolved, "name").select("chunk_id", "entity_id").distinct()
    return entities.select("entity_id", "canonical_name", "definition", "aliases", "entity_embedding"), links


def score_answer(llm: Llm, question: str, answer: str, context: str) -> tuple[float, float, float]:
    """Relevance, groundedness and completeness from 0 to 1; NaN where the model's answer can't be read."""
    found = json_between(llm.generate(f'Score from 0 to 1 as JSON {{"relevance": x, "groundedness": x, "completeness": x}}.\nQuestion: {question}\nAnswer: {answer}\nPassages: {context}'))
    try:
        return tuple(min(max(float(found[k]), 0.0), 1.0) for k in ("relevance", "groundedness", "completeness"))
    except (TypeError, KeyError, ValueError):
        return (float("nan"),) * 3


def search_queries(answer: Column) -> Column:
    return tx.json_list_of_strings(answer)
