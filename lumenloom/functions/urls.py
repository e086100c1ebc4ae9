"""URL functions: canonical form, classes, safety, repositories, source sets."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from urllib.parse import parse_qs, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Hosts of code repositories, hosts whose wikis need scripts, addresses of images that are no content.
REPOSITORY = r"(?i)^https?://(github\.com|bitbucket\.org)/([^/]+)/([^/]+)(/|$)"
SCRIPTED_HOSTS = (r"\.atlassian\.net$", r"\.notion\.site$")
NOT_CONTENT_IMAGE = (
    r"(?i)(?:spacer|pixel|beacon|tracking|tracker|blank|shim|clear)|(?:/ad[sx]?/|/ads/|doubleclick|googlesyndication)|(?:favicon|badge|icon[_\-]|social[_\-]|share[_\-]|button[_\-])"
    r"|(?:\.gif\b.*(?:1x1|spacer|pixel|blank))|(?:facebook\.com/tr|analytics|scorecardresearch|quantserve)"
)
REENCODED = " #%?&=+"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_repository(url: Column) -> Column:
    return url.rlike(REPOSITORY)


def repository_prefix(url: Column) -> Column:
    """host/owner/name/ of a repository URL, else null."""
    owner, name = (F.regexp_extract(url, REPOSITORY, g) for g in (2, 3))
    return F.when(is_repository(url), F.concat(netloc(url), F.lit("/"), owner, F.lit("/"), name, F.lit("/")))


def classify(url: Column, seed_netloc: str) -> Column:
    return F.when(netloc(url) == seed_netloc.lower(), "same-domain").when(is_repository(url), "repo").otherwise("external")


def is_scripted_host(url: Column) -> Column:
    out = F.lit(False)
    for p in SCRIPTED_HOSTS:
        out |= netloc(url).rlike(p)
    return out


def needs_browser(url: Column, text: Column, html: Column) -> Column:
    """Hosts that render with scripts, and large pages with hardly any text."""
    return is_scripted_host(url) | ((F.length(text) < 200) & (F.length(html) > 5120))


def is_confluence(url: Column) -> Column:
    return netloc(url).endswith(".atlassian.net") & path(url).startswith("/wiki")


def confluence_space(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"^/wiki/spaces/([^/]+)", 1)
    return F.when(found != "", found)


def repository_parts(url: Column) -> Column:
    """struct(platform, owner, name) of a repository URL, .git taken off; else null."""
    name = F.regexp_replace(F.regexp_extract(url, REPOSITORY, 3), r"\.git$", "")
    return F.when(is_repository(url), F.struct(F.lower(F.regexp_extract(url, REPOSITORY, 1)).alias("platform"), F.regexp_extract(url, REPOSITORY, 2).alias("owner"), name.alias("name")))


def workspace(url: Column) -> Column:
    """The workspace of a Bitbucket workspace URL, else null."""
    found = F.regexp_extract(url, r"(?i)^https?://bitbucket\.org/([^/]+)(?:/workspace(?:/.*)?)?/*$", 1)
    return F.when(found != "", found)


def valid_branch(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9._/\-]+$")


def canonical_text(url: str) -> str:
    """Lower-case scheme and host, no fragment, parameters by key (the first value of each), seven characters
    encoded again in the path, no slash at the end of a path that isn't the root."""
    parts = urlsplit(url)
    raw_path, _, params = parts.path.partition(";")
    params = ";" + params if params else ""
    where = "".join(quote(c) if c in REENCODED else c for c in unquote(raw_path))
    if where != "/":
        where = where.rstrip("/")
    query = parse_qs(parts.query, keep_blank_values=True)
    ordered = urlencode([(k, query[k][0]) for k in sorted(query)])
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), where + params, ordered, ""))


def canonical(url: Column) -> Column:
    """canonical_text natively, where neither query values nor the path need decoding; exact on such URLs."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    first = F.filter(keyed, lambda p: ~F.exists(keyed, lambda q: (q["k"] == p["k"]) & (q["i"] < p["i"])))
    ordered = F.array_join(F.transform(F.array_sort(first), lambda p: p["p"]), "&")
    where = path(url)
    where = F.when(where == "/", where).otherwise(F.regexp_replace(where, "/+$", ""))
    return F.concat(scheme(url), F.lit("://"), netloc(url), where, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))


def sanitized(url: str) -> str:
    """Unsafe characters percent-encoded, encoded ones left alone."""
    parts = urlsplit(url)
    return urlunsplit((parts.scheme, parts.netloc, quote(parts.path, safe="/:@!$&'()*+,;=-._~%"), quote(parts.query, safe="/:@!$&'()*+,;=-._~?%"), parts.fragment))


def resolve(base: str, href: str) -> str:
    return urljoin(base, href)


def widest_source(srcset: Column) -> Column:
    """The URL with the largest width or density of a srcset attribute; the first of equals."""
    urls, sizes = (F.regexp_extract_all(srcset, F.lit(r"(\S+)\s+([\d.]+)[wx]"), F.lit(g)) for g in (1, 2))
    entries = F.filter(F.transform(urls, lambda u, i: F.struct(F.coalesce(F.element_at(sizes, i + 1).try_cast("double"), F.lit(1.0)).alias("w"), (-i).alias("i"), F.ltrim(u, F.lit(",")).alias("u"))), lambda e: e["u"] != "")
    return F.array_max(entries)["u"]


Resolver = Callable[[str], list[str]]


def public_addresses(addresses: list[str]) -> bool:
    """Whether there is an address and all are public."""
    try:
        found = [ipaddress.ip_address(a.split("%")[0]) for a in addresses]
    except ValueError:
        return False
    return bool(found) and not any(a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified for a in found)


def is_safe(url: str, resolver: Resolver) -> bool:
    """http or https, and a host that resolves to public addresses only."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not host:
        return False
    try:
        return public_addresses(resolver(host))
    except OSError:
        return False


def safe_rows(rows: DataFrame, resolver: Resolver, url: str = "url") -> DataFrame:
    """The rows whose URL is safe; hosts are resolved where the rows are."""
    ship(rows.sparkSession)
    at = rows.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(u) and is_safe(u, resolver) for u in batch.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def pinned(url: str, resolver: Resolver) -> str | None:
    """The URL with its host replaced by the first of its addresses, if all are public."""
    if not is_safe(url, resolver):
        return None
    parts = urlsplit(url)
    first = resolver(parts.hostname or "")[0]
    host = f"[{first}]" if ":" in first else first
    return urlunsplit((parts.scheme, host + (f":{parts.port}" if parts.port else ""), parts.path, parts.query, parts.fragment))


def literal_is_private(url: Column) -> Column:
    """Whether the host is a name or IPv4 literal of this machine or a private network; decided without resolving."""
    host = F.regexp_replace(netloc(url), r"^.*@|:\d+$", "")
    return host.rlike(r"^(localhost|.*\.localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|169\.254\.\d+\.\d+|0\.\d+\.\d+\.\d+|\[.*\])$")


def is_safe_static(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (netloc(url) != "") & ~literal_is_private(url)


def glob_to_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
