"""A stored inverted index for BM25, kept up by changes, and searched block by block.

The index is a list of segments. A segment has `postings`, a row for each term and block of chunks, in folders by a hash of the term, and
`chunks`, a row for each chunk with its terms, in folders by a hash of its id. Changes make a new segment: of new and replaced
chunks with their postings, of deleted ones with their ids only, and, for what was replaced or deleted, of negative document frequencies. So a
term's frequency is a sum over its rows, and a posting counts unless a later segment has replaced its chunk. The list is one
file, moved by a rename; what a run that stopped had written is not on it. After `most_segments` all segments become one.

A block holds about `block` chunks of like lengths, so that its best chance is close to what its chunks reach. Each row has the block's largest count and
smallest length: no chunk of the block scores higher than with these. A search scores the blocks of the highest bounds first; the k-th best score there is a
floor, and of the other blocks only those whose bound reaches it are looked at. The result is that of scoring all.

Only folders of the queries' terms are read. Of a frequent term every task gets some blocks; nothing of the corpus goes through the driver.

Defined results: null texts have no terms but count as chunks; of rows with one chunk_id the smallest text is taken; null ids are left out. Terms that are not
in the index add nothing. A repeated query token counts again. Ties go to the smaller chunk_id."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..plans.settings import Settings
from . import folders

#: The block number of rows that only correct frequencies.
CORRECTION = -1

#: Repeated ids that are broadcast; with more of them all texts move.
FEW = 100_000


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>>: the tokens sorted, and each run of equal ones counted; within the row."""
    runs = F.transform(F.array(F.sort_array(tx.tokenize(text))), _runs)
    return runs[0]


def _runs(tokens: Column) -> Column:
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(tokens, i - 1) != F.get(tokens, i)))
    # Each start with the next one, in one pass over both.
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(tokens)))
    return F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda a, b: F.struct(F.get(tokens, a).alias("term"), (b - a).alias("tf")))


class Postings:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, block: int = 256, most_segments: int = 8, settings: Settings = Settings()):
        self.spark, self.folder, self.buckets, self.block, self.most_segments, self.settings = spark, folder.rstrip("/"), buckets, block, most_segments, settings

    # Segments

    def _segments(self) -> list[dict]:
        found = folders.read_pointer(self.spark, f"{self.folder}/SEGMENTS")
        return json.loads(found) if found else []

    def _publish(self, segments: list[dict]) -> None:
        folders.move_pointer(self.spark, f"{self.folder}/SEGMENTS", json.dumps(segments))

    def _read(self, segment: dict, kind: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(segment[kind])).parquet(f"{self.folder}/{segment['name']}/{kind}")

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _versions(self, among: DataFrame | None = None) -> DataFrame:
        """chunk_id, live, dl, terms: the last row of each chunk; of those in `among` (chunk_id) only, of whose folders alone rows are read."""
        parts = [self._read(s, "chunks").withColumn("seq", F.lit(i)) for i, s in enumerate(self._segments())]
        rows = reduce(DataFrame.unionByName, parts)
        if among is not None:
            wanted = [r[0] for r in among.select(self._bucket(F.col("chunk_id"))).distinct().collect()]  # at most `buckets`
            rows = rows.filter(F.col("bucket").isin(wanted)).join(among, "chunk_id", "left_semi")
        if len(parts) == 1:  # a segment has a chunk once
            return rows.select("chunk_id", "live", "dl", "terms")
        last = rows.groupBy("chunk_id").agg(F.max_by(F.struct("live", "dl", "terms"), "seq").alias("v"))
        return last.select("chunk_id", "v.*")

    def _append(self, rows: DataFrame, base: list[dict]) -> None:
        """rows: chunk_id, live, dl, terms. base: the segments that stay. Writes the segment and puts it on the list."""
        name = uuid.uuid4().hex
        top = f"{self.folder}/{name}"
        bin_ = F.floor(F.log2(F.col("dl") + 1.0) * 4).cast("long")
        kept = rows.withColumn("bucket", self._bucket(F.col("chunk_id"))).withColumn("bin", bin_)
        kept.write.partitionBy("bucket").parquet(f"{top}/chunks")
        stored = self.spark.read.schema(kept.schema).parquet(f"{top}/chunks")
        live = stored.filter("live")
        # Lengths by quarters of a doubling: at most 128 bins.
        sizes = {r["bin"]: -(-r["n"] // self.block) for r in live.groupBy("bin").agg(F.count("*").alias("n")).collect()}
        splits = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("bin")] if sizes else F.lit(1)
        block = F.col("bin") * F.lit(1 << 40) + F.pmod(F.xxhash64("chunk_id"), splits)
        entries = live.select("chunk_id", "dl", block.alias("block"), F.explode("terms").alias("t")).select("chunk_id", "dl", "block", "t.term", "t.tf")
        # Dealt once, by what they are written and grouped by: postings move one time.
        dealt = entries.withColumns({"bucket": self._bucket(F.col("term")), "part": F.pmod("block", F.lit(32))}).repartition("bucket", "part")
        made = dealt.groupBy("bucket", "part", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("hits"))
        made = made.select("term", "block", "n", "max_tf", "min_dl", "hits", "bucket")
        total = live.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        n, dl = total["n"], total["dl"]
        if base:
            before = self._versions(stored.select("chunk_id")).filter("live")
            gone = before.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            n, dl = n - gone["n"], dl - gone["dl"]
            fewer = before.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg((-F.count("*")).alias("n"))
            fewer = fewer.withColumn("bucket", self._bucket(F.col("term")))
            made = made.unionByName(fewer.withColumns({"block": F.lit(CORRECTION).cast("long"), "max_tf": F.lit(0), "min_dl": F.lit(0), "hits": F.array().cast(made.schema["hits"].dataType)}))
        made.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{top}/postings")
        # A later segment that has a chunk again replaces what earlier ones have of it.
        self._publish([*base, {"name": name, "n": n, "dl": dl, "chunks": kept.schema.jsonValue(), "postings": made.schema.jsonValue()}])

    # Changes

    def add(self, chunks: DataFrame) -> None:
        """New chunks (chunk_id, text), and new texts of known ones."""
        rows = self._single(chunks.filter("chunk_id is not null").select("chunk_id", "text"))
        terms = rows.select("chunk_id", term_counts(F.coalesce("text", F.lit(""))).alias("terms"))
        dl = F.aggregate("terms", F.lit(0), lambda s, t: s + t["tf"])
        self._append(terms.select("chunk_id", F.lit(True).alias("live"), dl.alias("dl"), "terms"), self._segments())
        self._settle()

    @staticmethod
    def _single(rows: DataFrame) -> DataFrame:
        """One row of each chunk_id, of the smallest text; texts of ids that come once don't move."""
        least = lambda of: of.groupBy("chunk_id").agg(F.min("text").alias("text"))
        repeated = folders.written(rows.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id"), "repeated")
        n = repeated.count()
        if n > FEW:
            return least(rows)
        return rows.join(F.broadcast(repeated), "chunk_id", "left_anti").unionByName(least(rows.join(F.broadcast(repeated), "chunk_id", "left_semi"))) if n else rows

    def delete(self, ids: DataFrame) -> None:
        """ids: chunk_id. Those that the index hasn't are ignored."""
        base = self._segments()
        if base:
            known = self._versions(ids.select("chunk_id").distinct()).filter("live")
            self._append(known.select("chunk_id", F.lit(False).alias("live"), F.lit(0).alias("dl"), F.array().cast("array<struct<term:string,tf:int>>").alias("terms")), base)
            self._settle()

    def _settle(self) -> None:
        if len(self._segments()) > self.most_segments:
            self.compact()

    def compact(self) -> None:
        """All segments in one; the old ones' files go."""
        old = self._segments()
        if old:
            self._append(self._versions().filter("live"), [])
            for s in old:
                folders.remove(self.spark, f"{self.folder}/{s['name']}")

    # Searching

    def _rows(self, queries: DataFrame) -> DataFrame:
        """Rows of the queries' terms, of their folders only."""
        wanted = [r[0] for r in queries.select(self._bucket(F.col("term"))).distinct().collect()]  # at most `buckets`
        parts = [self._read(s, "postings").filter(F.col("bucket").isin(wanted)).withColumn("seq", F.lit(i)) for i, s in enumerate(self._segments())]
        return reduce(DataFrame.unionByName, parts)

    def _bounds(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
        """The rows with each query's weight of their term, the bounds (query_id, seq, block, bound), and a hit's share of the score."""
        s, segments = self.settings, self._segments()
        n, dl = sum(x["n"] for x in segments), sum(x["dl"] for x in segments)
        mean = F.lit(dl / n if n and dl else 1.0)
        share = lambda tf, length: tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * length / mean))
        rows = self._rows(queries)
        df = rows.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = queries.groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")).join(df.filter("df > 0"), "term").select("query_id", "term", (F.col("qtf") * idf).alias("w"))
        met = rows.filter(F.col("block") >= 0).join(weighed, "term")
        bounds = met.groupBy("query_id", "seq", "block").agg(F.sum(F.col("w") * share(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
        return met, bounds, share(F.col("h.tf"), F.col("h.dl"))

    def _replaced(self) -> DataFrame | None:
        """r_id, r_seq: the last segment that has a chunk which an earlier one may have too."""
        later = [self._read(s, "chunks").select(F.col("chunk_id").alias("r_id"), F.lit(i).alias("r_seq")) for i, s in enumerate(self._segments()) if i]
        return reduce(DataFrame.unionByName, later).groupBy("r_id").agg(F.max("r_seq").alias("r_seq")) if later else None

    def _score(self, met: DataFrame, blocks: DataFrame, share: Column) -> DataFrame:
        rows = met.join(blocks.select("query_id", "seq", "block"), ["query_id", "seq", "block"]).select("query_id", "seq", "w", F.explode("hits").alias("h"))
        hits = rows.select("query_id", "seq", F.col("h.chunk_id").alias("chunk_id"), (F.col("w") * share).alias("part"))
        replaced = self._replaced()
        if replaced is not None:
            hits = hits.join(replaced, F.col("chunk_id") == F.col("r_id"), "left").filter(F.col("seq") >= F.coalesce("r_seq", F.lit(0)))
        return hits.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("raw")).filter("raw > 0")

    @staticmethod
    def _best(scored: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "chunk_id"))
        return scored.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")

    def _needed(self, met: DataFrame, bounds: DataFrame, share: Column, k: int) -> DataFrame:
        """bounds with `scored`: whether the block may hold one of the best k chunks."""
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "seq", "block"))
        first = bounds.withColumn("_r", order).filter(F.col("_r") <= max(4, k // 8)).drop("_r")
        best = self._best(self._score(met, first, share), k)
        floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("raw")).otherwise(0.0).alias("floor"))
        # A sum in another order may differ in its last digits.
        return bounds.join(floor, "query_id", "left").withColumn("scored", F.col("bound") * (1 + 1e-9) >= F.coalesce("floor", F.lit(0.0))).drop("floor")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, raw: of each query (query_id, term, qtf) the best k chunks, the score over the query's best. One plan for all."""
        if not self._segments():
            return queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("raw")).limit(0)
        met, bounds, share = self._bounds(queries)
        best = self._best(self._score(met, self._needed(met, bounds, share, k).filter("scored"), share), k)
        return best.withColumn("raw", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")))

    def search(self, tokens: Counter, k: int) -> DataFrame:
        """chunk_id, raw."""
        queries = self.spark.createDataFrame([(0, t, n) for t, n in sorted(tokens.items())], "query_id int, term string, qtf int")
        return self.search_many(queries, k).select("chunk_id", "raw")

    def pruning(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, blocks, scored: how many blocks hold a query's terms, and how many of them are scored beyond the first look."""
        met, bounds, share = self._bounds(queries)
        return self._needed(met, bounds, share, k).groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if("scored").alias("scored"))
