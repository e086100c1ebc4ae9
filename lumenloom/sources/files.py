"""Files as tables: source trees, evaluation sets, corpora, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, evaluation

EVAL_SET = "array<struct<query: string, relevant_chunk_ids: array<string>, modality_labels: map<string, boolean>, reference_answer: string>>"
REPORT = "config_name string, ingestion struct<chunks: bigint, seconds: double>, retrieval struct<text_overlap: double, p50_ms: double, p95_ms: double, p99_ms: double>, queries array<struct<query: string, overlap: double, latency_ms: double>>"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, name, source of files to index below root; folders of builds and dependencies are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    clean = F.regexp_replace("path", "^file:/*", "/")
    relative = F.expr("substring(clean, length(prefix) + 2)")
    rows = files.withColumn("clean", clean).withColumn("prefix", prefix).withColumn("relative", relative)
    skipped = F.arrays_overlap(F.split("relative", "/"), F.array(*map(F.lit, chunking.SKIPPED_FOLDERS)))
    extension = F.lower(F.element_at(F.split("relative", r"\."), -1))
    keep = ~skipped & (F.col("relative").contains(".") & extension.isin(chunking.INDEXABLE) | F.element_at(F.split("relative", "/"), -1).startswith("Dockerfile"))
    return rows.filter(keep).select(F.col("relative").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), extension.alias("extension"))


def index_files(files: DataFrame, repo_url: Column, branch: str = "") -> DataFrame:
    """page_url, path, chunk_id, text, content_type: documents by paragraphs, the rest by code."""
    rows = files.withColumn("page_url", F.concat(repo_url, F.lit("/"), F.col("path")))
    docs = rows.filter(F.col("extension").isin(chunking.DOCUMENTS)).select("page_url", F.col("source").alias("text"))
    text = chunking.chunk_paragraphs(docs).select("page_url", "chunk_no", "text", "content_type")
    code = chunking.chunk_code(rows.filter(~F.col("extension").isin(chunking.DOCUMENTS)), branch).select("page_url", "chunk_no", "text", F.lit("code").alias("content_type"))
    both = text.unionByName(code)
    return both.withColumn("chunk_id", tx.file_chunk_id(F.col("page_url"), F.col("chunk_no"), F.col("text")))


#: Files of a repository's wiki.
WIKI_FILES = ["md", "mediawiki", "rst", "txt"]


def wiki_pages(spark: SparkSession, root: str, repo_url: Column) -> DataFrame:
    """page_url, chunk_no, text, content_type, chunk_id of a cloned repository wiki: its text files by paragraphs."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = found.filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(WIKI_FILES) & ~F.col("path").contains("/.git/"))
    page = F.concat(repo_url, F.lit("/wiki/"), F.regexp_replace(name, r"\.[^.]*$", ""))
    chunks = chunking.chunk_paragraphs(kept.select(page.alias("page_url"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")))
    return chunks.select("page_url", "chunk_no", "text", "content_type", tx.file_chunk_id(F.col("page_url"), F.col("chunk_no"), F.col("text")).alias("chunk_id"))


def issues(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """number, text (title as a header before the body) of the first issues of a JSON export."""
    rows = spark.read.schema("number long, title string, body string").json(path, multiLine=True)
    return rows.select("number", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text")).orderBy("number").limit(limit)


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or an object with `queries`; missing fields get defaults, other shapes are an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    body = F.when(F.trim("value").startswith("{"), F.get_json_object("value", "$.queries")).otherwise(F.col("value"))
    parsed = raw.select(F.from_json(body, EVAL_SET).alias("q"))
    checked = parsed.select(F.when(F.col("q").isNull(), F.raise_error(F.lit("an evaluation set is a JSON array or an object with queries"))).otherwise(F.col("q")).alias("q"))
    e = checked.select(F.explode("q").alias("q")).select("q.*")
    empty = F.expr("array()").cast("array<string>")
    return e.withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", empty)).withColumn("modality_labels", F.coalesce("modality_labels", F.create_map().cast("map<string,boolean>")))


def corpus(spark: SparkSession, truth: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents with text, queries) of a ground-truth file and the folder of its documents."""
    raw = spark.read.schema("documents array<struct<path: string, url: string, type: string, language: string>>, queries array<struct<query: string, expected_passages: array<string>, source_doc: string, expected_content_types: array<string>, difficulty: string>>").json(truth, multiLine=True)
    docs = raw.select(F.explode("documents").alias("d")).select("d.*")
    texts = spark.read.text(folder, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path"))
    return docs.join(texts, "path").withColumnRenamed("value", "text"), raw.select(F.explode("queries").alias("q")).select("q.*")


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """A row for each config; null numbers are 0."""
    rows = spark.read.schema(REPORT).json(path, multiLine=True)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c.rpartition(".")[2])
    return rows.select("config_name", z("ingestion.chunks"), z("ingestion.seconds"), z("retrieval.text_overlap"), z("retrieval.p50_ms"), z("retrieval.p95_ms"), z("retrieval.p99_ms"), "queries")


def save_report(report: DataFrame, path: str) -> None:
    """As JSON; NaN and infinities become null."""
    doubles = [f.name for f in report.schema if f.dataType.simpleString() in ("double", "float")]
    report.withColumns({c: tx.finite(F.col(c)) for c in doubles}).write.mode("errorifexists").json(path)


def format_table(rows: DataFrame, limit: int = 50) -> str:
    """Columns as text for a terminal."""
    data = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in rows.limit(limit).collect()]
    table = [rows.columns, *data]
    widths = [max(len(r[i]) for r in table) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in table)


def format_report(rolled: DataFrame, errors: DataFrame | None = None) -> str:
    """A benchmark's summary for people: configs by overlap, the best and the fastest, errors."""
    rows = rolled.orderBy(F.desc("text_overlap"), "p50", "config_name").collect()
    lines = [f"{r['config_name']}: overlap {r['text_overlap']:.4f}, {r['p50']:.1f} / {r['p95']:.1f} / {r['p99']:.1f} ms, {r['chunks']} chunks at {r['ms_per_chunk']:.2f} ms" for r in rows]
    if rows:
        fastest = min(rows, key=lambda r: (r["p50"], r["config_name"]))
        lines += ["", f"best overlap: {rows[0]['config_name']}", f"fastest: {fastest['config_name']}"]
    failed = errors.orderBy("config_name").collect() if errors is not None else []
    lines += [f"failed: {r['config_name']} ({r['error']})" for r in failed]
    return "\n".join(lines)


def compare_files(spark: SparkSession, a: str, b: str) -> DataFrame:
    return evaluation.compare_reports(load_report(spark, a), load_report(spark, b), ["text_overlap", "p50_ms", "p95_ms", "p99_ms"])


def load_json(path: str):
    with open(path) as f:
        return json.load(f)
