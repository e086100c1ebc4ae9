"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 512

#: Shuffle partitions at most, unless the session's spark.lumenloom.mostPartitions says otherwise; beyond, partitions grow
#: and are worked off in a stream.
MOST_PARTS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Before Python work: send the package, and bound what a worker holds at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary
    one if the session names none. On a cluster that would be lost between machines: an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenloom-"))
            held = spark.sparkContext.getCheckpointDir()
        found = held
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from files that
    outlive any executor, and nothing before is computed twice. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from materialize() that nothing reads any more."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() splits at exactly the six ASCII
    white-space characters, unlike str.split()."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHash(dict):
    """word -> 64-bit hash; forgets everything once it holds `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashes(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A function for mapInArrow from one on single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 values of an integer key that cut df into ranges of about equal
    row counts. One aggregate; what reaches the driver is bounded by parts."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, shares, 5 * MOST_PARTS).alias("b")).first()["b"] or []
    return sorted({x for x in got if x is not None})


def range_part(key: Column, bounds: list[int], cells: int = 4096) -> Column:
    """How many bounds are below key: its range's number; null is in range 0. Values equal to a bound
    share the range that ends at it. A grid over the bounds says where to look."""
    if not bounds:
        return F.lit(0)
    low, high = bounds[0], bounds[-1]
    width = max(-(-(high - low + 1) // cells), 1)
    starts, at = [], 0
    for cell in range((high - low) // width + 2):
        while at < len(bounds) and bounds[at] < low + cell * width:
            at += 1
        starts.append(at)
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  one literal once folded
    cell = F.floor((key - low) / width).cast("int")
    start = F.element_at(numbers(starts), cell + 1).cast("int")
    end = F.element_at(numbers(starts), cell + 2).cast("int")
    near = F.slice(numbers(bounds), start + 1, end - start)
    return F.when(key.isNull() | (key <= low), 0).when(key > high, len(bounds)).otherwise(start + F.size(F.filter(near, lambda b: b < key)))


def parts_for(spark: SparkSession, rows: int, per_part: int, least: int | None = None) -> int:
    """Partitions of about per_part rows; the session's number of shuffle partitions at least unless told otherwise."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if least is None else least
    return min(max(least, -(-rows // per_part), 1), int(spark.conf.get("spark.lumenloom.mostPartitions", str(MOST_PARTS))))
