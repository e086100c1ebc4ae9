"""A training-corpus pipeline: five stages over `documents`, each written as Parquet and read again.

toxicity: documents that the nearest labelled examples call toxic go. line_dedup: later repeats of passages
go, and documents of which nothing is left. near_dedup: of each group of near-duplicates (word shingles
alike by 80 % or more) the one of the smallest doc_id stays, and one row of it where rows repeat. mixing: sources are brought to their target weights; a document taken twice is there
twice. packing: what remains is cut into token windows, one row for each piece.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents. Null and empty texts pass
through the first three stages; mixing takes no words from them, so they end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import line_dedup, mixing, near_dup, packing, toxicity
from lumenloom.llm.common import WORD, materialize, table


#: Bands that miss a pair of 80 % by a chance of 6e-7, as op8's 24 do at 85 % (8e-7).
NEAR = near_dup.NearDup(percent=80, bands=36)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.reject(docs, model)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs, counts=True)
    has_words = F.col("text").rlike(WORD)
    left = cut.filter((F.col("n_deleted") == 0) | has_words)
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, NEAR)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = materialize(mixing.sizes(docs), "mixed")
    shares = mixing.mix_sized(sized.select("doc_id", "source", "size")).filter("taken > 0")
    shares = shares.groupBy("doc_id", "source", "size").agg(F.ceil(F.sum("taken") / (F.count("*") * F.col("size"))).cast("int").alias("times"))
    shares = shares.withColumnsRenamed({"doc_id": "d", "source": "s", "size": "z"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return sized.join(shares, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("mixing", _mixing), ("packing", _packing)]

#: Token windows and trained scores can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
