"""Tables and their changes. Parquet has no MERGE, so each change is a new table from the old one: by joins on the key, never by collecting.

A Store keeps versions of a table's buckets and a pointer file, so readers see a whole version, and writing never overwrites what is being read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..plans.schemas import DEFAULTS, KEYS, TABLES
from . import folders

#: The folder column of the tables' buckets.
BUCKET = "_bucket"


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order.asc()))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), merge: list[str] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new (one per key) put in their place. Columns in `keep` and columns that new lacks stay as they were; columns in
    `merge` take the new value unless it is null; inserted rows take `defaults` for nulls. One full outer join on the key."""
    a, b = old.alias("a"), new.alias("b")
    condition = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, condition, "full_outer")
    inserted, updated = F.col(f"a.{keys[0]}").isNull(), F.col(f"b.{keys[0]}").isNotNull()
    out = []
    for c in old.columns:
        before = F.col(f"a.{c}")
        after = F.col(f"b.{c}") if c in new.columns else F.lit(None)
        default = (defaults or {}).get(c)
        fresh = after if default is None else F.coalesce(after, default)
        if c in keys:
            value = F.coalesce(before, after)
        elif c in keep or c not in new.columns:
            value = F.when(inserted, fresh).otherwise(before)
        elif c in merge:
            value = F.when(inserted, fresh).otherwise(F.coalesce(after, before))
        else:
            value = F.when(inserted, fresh).when(updated, after).otherwise(before)
        out.append(value.cast(old.schema[c].dataType).alias(c))
    return joined.select(*out)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old and the rows of new whose key it lacks, the first of each key."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    fresh = first_wins(fresh, keys, order) if order is not None else fresh.dropDuplicates(keys)
    return old.unionByName(fresh.select(*old.columns))


def delete_cascade(chunks: DataFrame, chunk_entities: DataFrame, token_rows: DataFrame, page_url: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without the chunks of a page."""
    gone = chunks.filter(F.col("page_url") == page_url).select("chunk_id")
    return chunks.filter(F.col("page_url") != page_url), chunk_entities.join(gone, "chunk_id", "left_anti"), token_rows.join(gone, "chunk_id", "left_anti")


def delete_entities_for_page(entities: DataFrame, chunk_entities: DataFrame, chunks: DataFrame, page_url: str) -> tuple[DataFrame, DataFrame]:
    """Entities and links without those of a page's chunks, and without entities that no chunk is left for."""
    gone = chunks.filter(F.col("page_url") == page_url).select("chunk_id")
    links = chunk_entities.join(gone, "chunk_id", "left_anti")
    return entities.join(links.select("entity_id").distinct(), "entity_id", "left_semi"), links


def orphan_entities(entities: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    return entities.join(chunk_entities, "entity_id", "left_anti")


def on_domain(domain: str, column: str = "url") -> Column:
    """By equality of the host, so that longer host names that begin alike don't match."""
    return (urls.netloc(F.col(column)) == domain.lower()) & urls.scheme(F.col(column)).isin("http", "https")


def mark_stale(pages: DataFrame, domain: str) -> DataFrame:
    return pages.withColumn("crawl_status", F.when(on_domain(domain), "stale").otherwise(F.col("crawl_status")))


def mark_active(pages: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """seen: the key of the pages that were found again."""
    hit = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return pages.join(hit, key, "left").withColumn("crawl_status", F.when(F.col("_seen"), "active").otherwise(F.col("crawl_status"))).select(*pages.columns)


def stale_pages(pages: DataFrame, domain: str) -> DataFrame:
    return pages.filter((F.col("crawl_status") == "stale") & on_domain(domain))


def store_graph(pages: DataFrame, graph: DataFrame, dims: int = 8) -> DataFrame:
    """graph: url, authority_score, graph_embedding; pages outside it get 0 and zeros."""
    found = graph.withColumnsRenamed({"authority_score": "_a", "graph_embedding": "_g"})
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return pages.join(found, "url", "left").withColumn("authority_score", F.coalesce("_a", F.lit(0.0))).withColumn("graph_embedding", F.coalesce("_g", zeros)).select(*pages.columns)


def corroborate(chunks: DataFrame, hits: DataFrame, now: Column, increment: float) -> DataFrame:
    """hits: chunk_id, a row for each corroboration."""
    counted = hits.groupBy("chunk_id").agg(F.count("*").alias("_hits"))
    out = chunks.join(counted, "chunk_id", "left")
    strength = F.coalesce("corroboration_strength", F.lit(0.0)) + F.coalesce("_hits", F.lit(0)) * increment
    return out.withColumn("corroboration_strength", F.when(F.col("_hits") > 0, strength).otherwise(F.col("corroboration_strength"))).withColumn("last_corroborated_at", F.when(F.col("_hits") > 0, now).otherwise(F.col("last_corroborated_at"))).select(*chunks.columns)


def migrate(table: DataFrame, name: str) -> DataFrame:
    """The table with all columns of its present schema: missing ones added, with defaults."""
    schema = T.StructType.fromDDL(TABLES[name])
    out = table
    for f in schema:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.expr(DEFAULTS.get(name, {}).get(f.name, "null")).cast(f.dataType))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def last_activity(pages: DataFrame, chunks: DataFrame, searches: DataFrame) -> DataFrame:
    """The latest of three maxima."""
    parts = [pages.agg(F.max("fetched_at").alias("t")), chunks.agg(F.max("created_at").alias("t")), searches.agg(F.max("created_at").alias("t"))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.max("t").alias("last_activity"))


class Store:
    """The tables in a folder. Rows lie in buckets by a hash of their key, and a pointer file says which versions of each bucket count: a change
    rewrites only the buckets that it touches, and all of them appear at once, when the pointer moves. What a run that stopped had written is not pointed at."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _pointer(self, name: str) -> str:
        return f"{self.folder}/{name}/CURRENT"

    def _version(self, name: str) -> dict | None:
        """buckets (how many) and at (bucket -> versions); tables of one folder, as older stores have them, have no buckets."""
        found = folders.read_pointer(self.spark, self._pointer(name))
        if found is None:
            return None
        return json.loads(found) if found.startswith("{") else {"buckets": 0, "at": {"": [found]}}

    def _files(self, name: str, version: dict, wanted: list[int] | None = None) -> list[str]:
        top = f"{self.folder}/{name}"
        if not version["buckets"]:
            return [f"{top}/{v}" for v in version["at"][""]]
        return [f"{top}/{v}/{BUCKET}={b}" for b, versions in version["at"].items() for v in versions if wanted is None or int(b) in wanted]

    def read(self, name: str, wanted: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some of its buckets."""
        version = self._version(name)
        paths = self._files(name, version, wanted) if version else []
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        if version.get("schema") == TABLES[name]:  # all files have its columns: none is opened to find them
            return self.spark.read.schema(TABLES[name]).parquet(*paths)
        return migrate(self.spark.read.option("mergeSchema", "true").parquet(*paths), name)

    def has(self, name: str) -> bool:
        """Whether the table was ever written."""
        return self._version(name) is not None

    def bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")

    def _put(self, name: str, rows: DataFrame, buckets: int, version: str | None = None) -> tuple[str, list[int]]:
        """Write rows as a new version, or add them to one that all buckets are of: its name, and the buckets that have rows in it."""
        version = version or uuid.uuid4().hex
        placed = migrate(rows, name).withColumn(BUCKET, self.bucket(name, buckets))
        placed.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{self.folder}/{name}/{version}")
        return version, folders.numbers_below(self.spark, f"{self.folder}/{name}/{version}", f"{BUCKET}=")

    def _point(self, name: str, buckets: int, at: dict[str, list[str]], schema: str | None = None) -> None:
        """schema: that of all files, if they have one."""
        folders.move_pointer(self.spark, self._pointer(name), json.dumps({"buckets": buckets, "at": at, "schema": schema}))

    def write(self, name: str, rows: DataFrame) -> None:
        """The table anew."""
        version, filled = self._put(name, rows, self.buckets)
        self._point(name, self.buckets, {str(b): [version] for b in filled}, TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        """More rows of a table whose rows never change: files beside those of the present version."""
        before = self._version(name)
        if before is None or not before["buckets"]:
            self.write(name, rows if before is None else self.read(name).unionByName(rows))
            return
        held = {v for versions in before["at"].values() for v in versions}
        version, filled = self._put(name, rows, before["buckets"], held.pop() if len(held) == 1 else None)
        at = before["at"] | {str(b): sorted({*before["at"].get(str(b), []), version}) for b in filled}
        if at != before["at"]:
            self._point(name, before["buckets"], at, TABLES[name] if before.get("schema") == TABLES[name] else None)

    def merge(self, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None, now: Column | None = None, then: Callable[[DataFrame], DataFrame] | None = None, also: DataFrame | None = None) -> list[int] | None:
        """Put rows in and take the keys `gone` out; `then` sees the result, of the buckets touched. `also` has keys of rows that `then` will change. A key that is in both
        rows and gone is put in anew. Returns the buckets written (None: all)."""
        version = self._version(name)
        keys = KEYS[name]
        parts = [df.select(*keys) for df in (rows, gone, also) if df is not None]
        if not parts:
            return []
        touched = None
        if version and version["buckets"]:
            each = [df.select(self.bucket(name, version["buckets"]).alias("b")) for df in parts]
            touched = sorted(r["b"] for r in reduce(DataFrame.unionByName, each).distinct().collect())  # at most as many as there are buckets
            if not touched:
                return []
        old = self.read(name, touched)
        if gone is not None:
            old = old.join(gone.select(*keys).distinct(), keys, "left_anti").select(*old.columns)
        out = old if rows is None else self._merged(name, old, rows, F.current_timestamp() if now is None else now)
        out = then(out) if then else out
        if touched is None:
            self.write(name, out)
            return None
        fresh, filled = self._put(name, out, version["buckets"])
        at = {b: v for b, v in version["at"].items() if int(b) not in touched} | {str(b): [fresh] for b in filled}
        self._point(name, version["buckets"], at, TABLES[name] if version.get("schema") == TABLES[name] else None)
        return touched

    def _merged(self, name: str, old: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
        stamp = {"pages": "fetched_at", "chunks": "created_at", "images": "created_at", "entities": "created_at"}.get(name)
        if stamp and stamp not in rows.columns:
            rows = rows.withColumn(stamp, now)
        if name in ("page_links", "chunk_entities"):
            return insert_or_ignore(old, rows, KEYS[name])
        if name == "pages":
            return upsert(old, rows, KEYS[name], merge=["content_hash", "crawl_status"], defaults={"crawl_status": F.lit("active")})
        if name == "chunks":
            return upsert(old, rows, KEYS[name], keep=["corroboration_strength", "last_corroborated_at"], defaults={"corroboration_strength": F.lit(0.0), "last_corroborated_at": now, "content_type": F.lit("text"), "is_child": F.lit(False), "embedding_version": F.when(F.col("b.embedding").isNotNull(), 1).otherwise(0) if "embedding" in rows.columns else F.lit(0)})
        return upsert(old, rows, KEYS[name], keep=["created_at"] if name == "entities" else [])

    def upsert(self, name: str, rows: DataFrame, now: Column | None = None) -> None:
        self.merge(name, rows, now=now)

    def vacuum(self, name: str) -> int:
        """Remove the versions that nothing points at; how many they were. Not while others read or write the table."""
        version = self._version(name)
        held = {v for versions in version["at"].values() for v in versions} if version else set()
        idle = [v for v in folders.names_below(self.spark, f"{self.folder}/{name}") if v not in held and not v.startswith("CURRENT")]
        for v in idle:
            folders.remove(self.spark, f"{self.folder}/{name}/{v}")
        return len(idle)

    def log_search(self, query: str, count: int, now: Column | None = None) -> None:
        old = self.read("searches")
        top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        row = top.select((F.col("top") + 1).alias("id"), F.lit(query).alias("query"), F.lit(count).alias("result_count"), (F.current_timestamp() if now is None else now).alias("created_at"))
        self.append("searches", row.select(*old.columns))

    def status(self) -> DataFrame:
        """One row of counts and the last activity."""
        counts = {"pages": "pages", "chunks": "chunks", "images": "images", "page_links": "links", "searches": "searches"}
        out = last_activity(self.read("pages"), self.read("chunks"), self.read("searches"))
        for name, label in counts.items():
            out = out.crossJoin(self.read(name).agg(F.count("*").alias(label)))  # one row each
        return out
