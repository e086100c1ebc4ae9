"""Fetching pages that a stranger's link may lead anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.providers import Fetcher, fetch


def safe_fetch(todo: DataFrame, fetcher: Fetcher, resolver: urls.Resolver, wait: Callable[[str], None] | None = None) -> DataFrame:
    """url, html, final_url: addresses are checked before a page is fetched and, as it may redirect, again after."""
    got = fetch(urls.safe_rows(todo.select("url"), resolver), fetcher, urls.netloc(F.col("url")), wait)
    return urls.safe_rows(got, resolver, "final_url")
