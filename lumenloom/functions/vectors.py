"""Vector functions. One vector against a column: Column expressions. Many against many: kernels on Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column) -> Column:
    n = norm(vector)
    return F.transform(doubles(vector), lambda x: F.when(n > 0, x / n).otherwise(x))


def truncate(vector: Column, dims: int) -> Column:
    """The first dims components, of unit length again."""
    return normalize(F.slice(vector, 1, dims))


def is_chart(embedding: Column, charts: list[list[float]], others: list[list[float]]) -> Column:
    """Whether an image is nearer to a label for charts than to any other label."""
    best = lambda labels: F.greatest(*[dot(embedding, literal(v)) for v in labels]) if len(labels) > 1 else dot(embedding, literal(labels[0]))
    return best(charts) > best(others)


def quantize(vector: Column) -> Column:
    """struct(low, high, codes): 256 steps between the least and the largest component."""
    values = doubles(vector)
    low, high = F.array_min(values), F.array_max(values)
    codes = F.transform(values, lambda v: F.when(high - low < 1e-10, 0).otherwise(F.least(F.greatest(F.floor((v - low) / (high - low) * 255 + 0.5), F.lit(0)), F.lit(255))).cast("int"))
    return F.struct(low.alias("low"), high.alias("high"), codes.alias("codes"))


def dequantize(quantized: Column) -> Column:
    low, high = quantized["low"], quantized["high"]
    return F.transform(quantized["codes"], lambda c: F.when(high - low < 1e-10, low).otherwise(c / 255.0 * (high - low) + low))


# Storage formats. A head of magic number 0x4D and version (1: float32, 2: 8-bit codes), then the
# dimension as unsigned 16-bit number; version 2 has least and largest component before the codes. Without a head
# the bytes are float32. Token matrices have rows and columns as unsigned 16-bit numbers before float32.
MAGIC, PLAIN, CODED = 0x4D, 1, 2


def encode(vector: list[float], coded: bool = True) -> bytes:
    values = np.asarray(vector, "<f4")
    if not coded:
        return struct.pack("<BBH", MAGIC, PLAIN, len(values)) + values.tobytes()
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    if high - low < 1e-10:
        codes = np.zeros(len(values), np.uint8)
    else:
        codes = np.clip(((values.astype(float) - low) / (high - low) * 255 + 0.5).astype(int), 0, 255).astype(np.uint8)
    return struct.pack("<BBHff", MAGIC, CODED, len(values), low, high) + codes.tobytes()


def decode(data: bytes) -> list[float]:
    if len(data) >= 4 and data[0] == MAGIC:
        version, dims = data[1], struct.unpack_from("<H", data, 2)[0]
        if version == PLAIN and len(data) == 4 + 4 * dims:
            return np.frombuffer(data, "<f4", dims, 4).tolist()
        if version == CODED and len(data) == 12 + dims:
            low, high = struct.unpack_from("<ff", data, 4)
            codes = np.frombuffer(data, np.uint8, dims, 12)
            return [low] * dims if high - low < 1e-10 else (codes / 255.0 * (high - low) + low).tolist()
    return np.frombuffer(data, "<f4").tolist()


def encode_matrix(rows: list[list[float]]) -> bytes:
    values = np.asarray(rows, "<f4").reshape(len(rows), -1) if rows else np.zeros((0, 0), "<f4")
    return struct.pack("<HH", *values.shape) + values.tobytes()


def decode_matrix(data: bytes) -> list[list[float]] | None:
    if len(data) < 4:
        return None
    n, dims = struct.unpack_from("<HH", data)
    if len(data) != 4 + 4 * n * dims:
        return None
    return np.frombuffer(data, "<f4", n * dims, 4).reshape(n, dims).tolist()


def hyperplanes(buckets: int = 20, dims: int = 128, seed: int = 42) -> np.ndarray:
    return np.random.RandomState(seed).randn(buckets, dims).astype(np.float32)


def fixed_encoding(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Token vectors as one: the mean of each bucket (the plane with the largest projection), put together, unit length."""
    out = np.zeros(planes.shape, np.float32)
    if len(rows):
        bucket = (rows @ planes.T).argmax(axis=1)
        for b in np.unique(bucket):
            out[b] = rows[bucket == b].mean(axis=0)
    flat = out.ravel()
    n = float(np.linalg.norm(flat))
    return flat / n if n > 0 else flat


def fixed_encodings(tokens: DataFrame, planes: np.ndarray) -> DataFrame:
    """fixed_encoding for groups of any size: tokens (id, token) give (id, bucket, component, value), without components of empty buckets. Means are partial
    aggregates, so no group of tokens is in one task."""
    scored = F.array(*[F.struct(dot(F.col("token"), literal(p)).alias("s"), F.lit(-b).alias("b")) for b, p in enumerate(planes)])
    placed = tokens.select("id", (-F.array_max(scored)["b"]).alias("bucket"), "token")
    spread = placed.select("id", "bucket", F.posexplode(doubles(F.col("token"))).alias("component", "x"))
    means = spread.groupBy("id", "bucket", "component").agg(F.avg("x").alias("x"))
    norms = means.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return means.join(norms, "id").select("id", "bucket", "component", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.col("x")).alias("value"))


def maxsim(query: np.ndarray, doc: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The best match of each query token, summed with weights."""
    best = (query @ doc.T).max(axis=1)
    return float(best.sum() if weights is None else (best * weights).sum())


def soft_token_weights(best: np.ndarray) -> np.ndarray:
    """Rows: candidates, columns: query tokens. Tokens that match everything weigh less; weights sum to 1."""
    w = 1 / (0.5 + best.mean(axis=0))
    return w / w.sum()


def nearest(left: DataFrame, right_ids: list, right: np.ndarray, threshold: float, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """For each row of left the first best of the right vectors over the threshold (strictly): (id, match, similarity). The right side is held
    in each worker; callers check its size."""
    kind = left.schema[id_column].dataType.simpleString()
    shared = left.sparkSession.sparkContext.broadcast((list(right_ids), right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            own, found, scores = batch.column(0), [], []
            for row in batch.column(1).to_pylist():
                s = matrix @ np.asarray(row, float) if row is not None and len(matrix) else np.zeros(0)
                best = int(s.argmax()) if len(s) else -1
                hit = best >= 0 and s[best] > threshold
                found.append(ids[best] if hit else None)
                scores.append(float(s[best]) if hit else None)
            yield pa.RecordBatch.from_arrays([own, pa.array(found, own.type), pa.array(scores, pa.float64())], names=["id", "match", "similarity"])

    return left.select(id_column, vector).mapInArrow(run, f"id {kind}, match {kind}, similarity double")
