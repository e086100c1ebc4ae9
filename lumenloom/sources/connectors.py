"""Connectors that page through remote services by a Fetcher, credentials, repositories, rate limits. Nothing here needs a network of its own."""

from __future__ import annotations

import base64
import fnmatch
import io
import json
import random
import re
import subprocess
import time
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from pathlib import Path
from urllib.parse import quote, urlsplit

from ..functions.urls import valid_branch  # noqa: F401  (part of this surface)
from .providers import Fetcher


class RateLimit:
    """At least a random wait between requests to one host; search and wiki hosts have bounds of their own."""

    #: Seconds between requests, at least and at most.
    BOUNDS = {"default": (1.0, 3.0), "search": (4.0, 8.0), "wiki": (0.5, 1.5)}

    def __init__(self, kind: str = "default", clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, seed: int = 0):
        self.low, self.high = self.BOUNDS[kind]
        self.clock, self.sleep, self.random, self.last = clock, sleep, random.Random(seed), {}

    def __call__(self, url: str) -> None:
        host = urlsplit(url).netloc.lower()
        if host in self.last:
            left = self.last[host] + self.random.uniform(self.low, self.high) - self.clock()
            if left > 0:
                self.sleep(left)
        self.last[host] = self.clock()


def match_credentials(url: str, credentials: list[dict]) -> dict | None:
    """An exact host before a pattern; the first of each."""
    host = urlsplit(url).netloc.lower()
    exact = [c for c in credentials if c.get("domain", "").lower() == host]
    return next(iter(exact), None) or next((c for c in credentials if fnmatch.fnmatch(host, c.get("domain", "").lower())), None)


def auth_headers(credential: dict | None) -> dict[str, str]:
    """basic, bearer, token, cookie, or a header of its own."""
    if not credential:
        return {}
    kind = credential.get("type")
    if kind == "basic":
        pair = f"{credential.get('username', '')}:{credential.get('password', '')}"
        return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}
    if kind == "bearer":
        return {"Authorization": f"Bearer {credential.get('token', '')}"}
    if kind == "token":
        return {"Authorization": f"token {credential.get('token', '')}"}
    if kind == "cookie":
        return {"Cookie": credential.get("cookie", "")}
    if kind == "header":
        return {credential["header"]: credential.get("value", "")}
    return {}


def merge_cli(credentials: list[dict], override: dict | None) -> list[dict]:
    """What was given on the command line goes first."""
    return credentials if not override else [override, *[c for c in credentials if c.get("domain") != override.get("domain")]]


def load_credentials(path: str) -> list[dict]:
    with open(path) as f:
        text = f.read()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    return (found or {}).get("credentials", []) if isinstance(found, dict) else found or []


def clone_url(platform: str, owner: str, name: str, credential: dict | None = None) -> str:
    """With percent-encoded credentials; never to be logged."""
    user = ""
    if credential:
        token = quote(credential.get("token") or credential.get("password") or "", safe="")
        who = quote(credential.get("username") or ("x-token-auth" if "bitbucket" in platform else "x-access-token"), safe="")
        user = f"{who}:{token}@" if token else ""
    return f"https://{user}{platform}/{owner}/{name}.git"


def clone(url: str, folder: str, branch: str | None = None, run: Callable = subprocess.run) -> None:
    """One commit of one branch. Branch names are checked before they reach the command line."""
    if branch is not None and (branch.startswith("-") or not re.match(r"^[a-zA-Z0-9._/\-]+$", branch)):
        raise ValueError(f"not a branch name: {branch!r}")
    run(["git", "clone", "--depth", "1", "--single-branch", *(["--branch", branch] if branch else []), url, folder], check=True, timeout=300, capture_output=True)


def unpack_zip(data: bytes, folder: str, most_bytes: int = 2_000_000_000) -> int:
    """A downloaded archive of a repository into a folder, without its first path component; the number of files. Names that leave the
    folder and archives that unpack to more than `most_bytes` are errors."""
    base, count, total = Path(folder).resolve(), 0, 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for item in z.infolist():
            _, _, name = item.filename.partition("/")
            if not name or item.is_dir():
                continue
            target = (base / name).resolve()
            if not target.is_relative_to(base):
                raise ValueError(f"leaves the folder: {item.filename!r}")
            total += item.file_size
            if total > most_bytes:
                raise ValueError("archive too large")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(z.read(item))
            count += 1
    return count


def fetch_repository(download: Callable[[str], bytes | None], platform: str, owner: str, name: str, folder: str, branch: str | None = None, credential: dict | None = None, run: Callable = subprocess.run) -> str:
    """Clone a repository or, where that fails, unpack its archive; "clone" or "archive"."""
    try:
        clone(clone_url(platform, owner, name, credential), folder, branch, run)
        return "clone"
    except (subprocess.SubprocessError, OSError):
        ref = quote(branch or "HEAD", safe="")
        url = f"https://api.github.com/repos/{owner}/{name}/zipball/{ref}" if platform == "github.com" else f"https://{platform}/{owner}/{name}/get/{ref}.zip"
        data = download(url)
        if data is None:
            raise
        unpack_zip(data, folder)
        return "archive"


def clone_wiki(platform: str, owner: str, name: str, folder: str, credential: dict | None = None, run: Callable = subprocess.run) -> bool:
    """The wiki of a repository, a repository of its own; False where there is none."""
    url = clone_url(platform, owner, name, credential)
    try:
        clone(url.removesuffix(".git") + (".wiki.git" if platform == "github.com" else ".git/wiki"), folder, None, run)
    except (subprocess.SubprocessError, OSError):
        return False
    return True


def _json(fetcher: Fetcher, url: str) -> dict:
    got = fetcher.fetch(url)
    return json.loads(got[0]) if got else {}


def workspace_repos(fetcher: Fetcher, workspace: str) -> Iterator[dict]:
    """Repositories of a workspace, page after page by `next`."""
    url: str | None = f"https://api.bitbucket.org/2.0/repositories/{quote(workspace)}?pagelen=100"
    while url:
        page = _json(fetcher, url)
        yield from page.get("values", [])
        url = page.get("next")


def latest_commit(fetcher: Fetcher, platform: str, owner: str, name: str, branch: str = "HEAD") -> str | None:
    """The change token of a repository."""
    if platform == "github.com":
        return _json(fetcher, f"https://api.github.com/repos/{owner}/{name}/commits/{branch}").get("sha")
    values = _json(fetcher, f"https://api.bitbucket.org/2.0/repositories/{owner}/{name}/commits/{branch}?pagelen=1").get("values") or [{}]
    return values[0].get("hash")


def wiki_spaces(fetcher: Fetcher, base: str, key: str | None = None, size: int = 100) -> Iterator[str]:
    if key:
        yield key
        return
    yield from (s["key"] for s in _paged(fetcher, f"{base}/rest/api/space?", size))


def wiki_pages(fetcher: Fetcher, base: str, space: str, size: int = 100) -> Iterator[dict]:
    yield from _paged(fetcher, f"{base}/rest/api/content?spaceKey={quote(space)}&expand=body.storage,ancestors&", size)


def _paged(fetcher: Fetcher, url: str, size: int) -> Iterator[dict]:
    """Until a page is short."""
    start = 0
    while True:
        found = _json(fetcher, f"{url}start={start}&limit={size}").get("results", [])
        yield from found
        if len(found) < size:
            return
        start += size


def wiki_page_html(page: dict) -> str:
    """Title, breadcrumb and body of a wiki page as one document."""
    crumbs = " &gt; ".join(escape(a.get("title", "")) for a in page.get("ancestors", []))
    body = page.get("body", {}).get("storage", {}).get("value", "")
    title = escape(page.get("title", ""))
    return f"<html><head><title>{title}</title></head><body>{f'<nav>{crumbs}</nav>' if crumbs else ''}<h1>{title}</h1>{body}</body></html>"


def ocr_text(boxes: list[tuple[float, float, str, float]], most: int = 2000, least: float = 0.5) -> str:
    """Recognised boxes (x, y, text, confidence) in reading order."""
    kept = sorted((b for b in boxes if b[3] > least), key=lambda b: (b[1], b[0]))
    return " ".join(b[2] for b in kept)[:most]
