"""What is outside Spark: models, language models, fetching, searching, names. Each is a protocol with an offline stand-in whose
answers depend on its input only. The stand-in embedder hashes words; it is for tests and offline use, not for quality."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str], mode: str) -> list[list[float] | None]: ...


class TokenEmbedder(Protocol):
    def embed_tokens(self, texts: list[str]) -> list[list[list[float]] | None]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Llm(Protocol):
    def generate(self, prompt: str, system: str = "") -> str: ...


class ImageLlm(Protocol):
    """A language model that also sees images."""

    def generate_with_images(self, prompt: str, images: list[bytes], system: str = "") -> str: ...


class ImageEmbedder(Protocol):
    """Images and short texts in one space."""

    dims: int

    def embed_images(self, images: list[bytes]) -> list[list[float] | None]: ...

    def embed_labels(self, texts: list[str]) -> list[list[float] | None]: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[str, str] | None: ...


class Search(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...


def _seeded(word: str | bytes, dims: int) -> np.ndarray:
    import xxhash

    return np.random.RandomState(xxhash.xxh32_intdigest(word)).randn(dims)


class HashingEmbedder:
    """The sum of a random direction for each word, unit length; null for texts without words."""

    def __init__(self, dims: int = 768):
        self.dims = dims

    def embed(self, texts, mode="document"):
        out = []
        for t in texts:
            words = re.findall(r"\w+", (t or "").lower())
            v = sum((_seeded(w, self.dims) for w in words), np.zeros(self.dims))
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


class HashingTokenEmbedder:
    def __init__(self, dims: int = 128, most: int = 64):
        self.dims, self.most = dims, most

    def embed_tokens(self, texts):
        out = []
        for t in texts:
            rows = [_seeded(w, self.dims) for w in re.findall(r"\w+", (t or "").lower())[: self.most]]
            out.append([(r / np.linalg.norm(r)).tolist() for r in rows] or None)
        return out


class HashingImageEmbedder:
    """A direction for each content of an image, and of a text; for tests and offline use."""

    def __init__(self, dims: int = 512):
        self.dims = dims

    def _unit(self, data: bytes) -> list[float]:
        v = _seeded(data, self.dims)
        return (v / np.linalg.norm(v)).tolist()

    def embed_images(self, images):
        return [self._unit(i) if i else None for i in images]

    def embed_labels(self, texts):
        return [self._unit(t.lower().encode()) if t else None for t in texts]


class OverlapReranker:
    """Log odds of the share of query words in the text."""

    def score(self, query, texts):
        q = set(re.findall(r"\w+", query.lower()))
        out = []
        for t in texts:
            share = len(q & set(re.findall(r"\w+", (t or "").lower()))) / max(len(q), 1)
            out.append(float(np.log((share + 0.05) / (1.05 - share))))
        return out


class ScriptedLlm:
    """Answers from a list of (pattern, answer); the first that fits the prompt."""

    def __init__(self, answers: list[tuple[str, str]] = (), default: str = "[]"):
        self.answers, self.default, self.prompts = list(answers), default, []

    def generate(self, prompt, system=""):
        self.prompts.append(prompt)
        return next((a for p, a in self.answers if re.search(p, prompt, re.S)), self.default)


class StaticWeb:
    """Pages and search results held in memory."""

    def __init__(self, pages: dict[str, str], results: dict[str, list[dict]] | None = None):
        self.pages, self.results = pages, results or {}

    def fetch(self, url):
        return (self.pages[url], url) if url in self.pages else None

    def search(self, query, limit=20):
        return self.results.get(query, [])[:limit]


def embed_column(text: Column, embedder: Embedder, mode: str = "document") -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.tolist(), mode))

    return run.asNondeterministic()(text)  # a filter on vectors is not to encode texts again


def embed(df: DataFrame, embedder: Embedder, column: str = "text", to: str = "embedding", mode: str = "document") -> DataFrame:
    """Each distinct text is embedded once and joined back."""
    ship(df.sparkSession)
    distinct = df.select(column).distinct()
    return df.join(distinct.withColumn(to, embed_column(F.col(column), embedder, mode)), column, "left")


def embed_tokens(df: DataFrame, embedder: TokenEmbedder, column: str = "text") -> DataFrame:
    """With tokens, token_count and their fixed encoding fde."""
    ship(df.sparkSession)
    from ..functions.vectors import fixed_encoding, hyperplanes

    planes = hyperplanes(dims=getattr(embedder, "dims", 128))

    @F.pandas_udf("tokens array<array<float>>, fde array<float>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = embedder.embed_tokens(texts.tolist())
        return pd.DataFrame({"tokens": found, "fde": [None if t is None else fixed_encoding(np.array(t, np.float32), planes).tolist() for t in found]})

    # Not to be repeated for each column that is taken from it, nor for a filter.
    out = df.withColumn("_made", run.asNondeterministic()(F.col(column)))
    return out.select(*df.columns, F.col("_made.tokens").alias("tokens"), F.size("_made.tokens").alias("token_count"), F.col("_made.fde").alias("fde"))


def fetch_images(images: DataFrame, download: Callable[[str], bytes | None], host: Column, tasks: int = 16) -> DataFrame:
    """images (image_id, src_url) with image_bytes, width and height of those that could be fetched and are worth keeping."""
    ship(images.sparkSession)
    from .images import accepted, dimensions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for image_id, url in zip(f["image_id"], f["src_url"]):
                try:
                    data = download(url)
                except Exception:  # noqa: BLE001  an image that fails is left out
                    data = None
                if data and accepted(data):
                    rows.append((image_id, data, *dimensions(data)))
            yield pd.DataFrame(rows, columns=["image_id", "image_bytes", "width", "height"])

    dealt = images.select("image_id", "src_url", host.alias("_host")).repartition(tasks, "_host").select("image_id", "src_url")
    return dealt.mapInPandas(run, "image_id string, image_bytes binary, width int, height int")


def embed_images(images: DataFrame, embedder: ImageEmbedder) -> DataFrame:
    """images with `embedding` of their image_bytes; null where there is none."""
    ship(images.sparkSession)

    @F.pandas_udf("array<float>")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed_images([bytes(x) if x is not None else None for x in data]))

    return images.withColumn("embedding", run(F.col("image_bytes")))


def rerank_logits(entries: DataFrame, query: str, reranker: Reranker) -> DataFrame:
    """chunk_id, logit."""
    ship(entries.sparkSession)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(query, texts.tolist()))

    return entries.select("chunk_id", run(F.col("text")).alias("logit"))


def generate_column(prompt: Column, llm: Llm, system: str = "") -> Column:
    """A language model's answer for each row: summaries, entities, scores."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([llm.generate(p, system) for p in prompts])

    return run(prompt)


def fetch(urls: DataFrame, fetcher: Fetcher, host: Column, wait: Callable[[str], None] | None = None, tasks: int = 16) -> DataFrame:
    """url, html, final_url of what could be fetched. All of a host's URLs are in one task, one after another, so that its rate limit holds."""
    ship(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for url in f["url"]:
                if wait:
                    wait(url)
                try:
                    got = fetcher.fetch(url)
                except Exception:  # noqa: BLE001  a page that fails is left out
                    got = None
                if got:
                    rows.append((url, *got))
            yield pd.DataFrame(rows, columns=["url", "html", "final_url"])

    return urls.withColumn("_host", host).repartition(tasks, "_host").select("url").mapInPandas(run, "url string, html string, final_url string")


def search_rows(queries: DataFrame, search: Search, limit: int = 20) -> DataFrame:
    """query -> query, title, url, snippet; a query that fails has no rows."""
    ship(queries.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for q in f["query"]:
                try:
                    found = search.search(q, limit)
                except Exception:  # noqa: BLE001
                    found = []
                rows += [(q, r.get("title"), r.get("url"), r.get("snippet")) for r in found]
            yield pd.DataFrame(rows, columns=["query", "title", "url", "snippet"])

    return queries.select("query").mapInPandas(run, "query string, title string, url string, snippet string")


def json_between(text: str, first: str = "{", last: str = "}"):
    """The JSON value between the first and last bracket of a model's answer; None if there is none."""
    a, b = text.find(first), text.rfind(last)
    try:
        return json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
