"""URL filters: path rules by longest match, and pattern rules found by their rarest literal token.

A path rule (host, path prefix) fits its host and all subdomains; of those that fit, the one with the longest
host and path decides. Other URLs are judged by pattern rules, regular expressions over the URL with A-Z lower-cased. Tokens are the
URL's runs of a-z and 0-9. Which tokens every match holds is read from the pattern itself: it is taken apart into
alternatives, and a literal run of an alternative is a whole token if both its borders can't be a-z or 0-9. Where no run is bounded,
three characters in a row of an unbounded one are the key: they lie within one token of the URL. Each alternative
is indexed under the key that is rarest among the URLs at hand. A URL's tokens, and the triples of characters in them that some rule is
indexed under, fetch the rules; only these run. A rule with an alternative that has no literal of three characters can't be
indexed and is an error, unless `always` allows it to run on every URL.

Defined results: null or a URL without :// has an empty host and path, no rule, and is allowed unless a
pattern rejects it. Repeated rows are judged alike. Extra columns are ignored; an empty table gives an empty result.
Rules are parameters of the caller's program, held in every worker: their size doesn't follow the data. `load_rules` reads
them from a table of at most `most` rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """always: run it on every URL where it can't be indexed."""

    pattern: str
    always: bool = False


#: Pages that are no prose: gambling, adult, pharmacy and warez spam, downloads and media, sessions, carts, accounts,
#: searches, calendars, archives of tags, feeds, advert networks, and machine interfaces.
PATTERNS = tuple(
    PatternRule(p)
    for p in (
        r"[./-]casino-[a-z]+[./]",
        r"[./-](poker|slots|betting|roulette|jackpot)[./-]",
        r"[./-](xxx|porn|camgirls|escorts)[./-]",
        r"[./-](viagra|cialis|payday-loans?|replica-watches)[./-]",
        r"[./-](warez|keygen|torrents?)[./-]",
        r"/cgi-bin/",
        r"[?&;](phpsessid|jsessionid|sid)=",
        r"/wp-(admin|login|json|includes)\b",
        r"/xmlrpc\.php",
        r"/(cart|checkout|wishlist)/?([?#]|$)",
        r"[?&]add-to-cart=",
        r"[?&]action=(login|register|edit|history)",
        r"/(login|signin|signup|logout|register)(\.[a-z]+)?/?([?#]|$)",
        r"/search\?(q|query)=",
        r"/calendar/[0-9]{4}/",
        r"/tags?/[^/?#]+/page/[0-9]+",
        r"[?&](replytocom|share|print)=",
        r"\.(zip|exe|iso|dmg|apk|tar\.gz|rar)([?#]|$)",
        r"\.(jpe?g|png|gif|svg|webp|mp3|mp4|avi)([?#]|$)",
        r"/(feed|rss|atom)(\.xml)?/?([?#]|$)",
        r"/sitemap[a-z0-9_-]*\.xml",
        r"doubleclick",
    )
)

#: Alternatives of a pattern at most; beyond, what is left of it counts as unknown text.
MOST_ALTERNATIVES = 256
_GAP = None  # in an alternative: text that nothing is known of
_WORD = frozenset(range(48, 58)) | frozenset(range(97, 123))


def alternatives(pattern: str) -> list[list]:
    """A pattern's alternatives: lists of literal characters, of frozensets of character codes, and of gaps (None). Every match of the
    pattern matches one of them. What isn't understood is a gap."""
    import re._constants as c
    import re._parser as parser

    every = frozenset(range(128)) | {-1}  # -1: all other characters
    classes = {
        c.CATEGORY_DIGIT: frozenset(range(48, 58)) | {-1},
        c.CATEGORY_WORD: _WORD | frozenset(range(65, 91)) | {95, -1},
        c.CATEGORY_SPACE: frozenset([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, -1]),
        c.CATEGORY_NOT_DIGIT: every - frozenset(range(48, 58)),
        c.CATEGORY_NOT_WORD: every - _WORD - frozenset(range(65, 91)) - {95},
        c.CATEGORY_NOT_SPACE: every - frozenset([9, 10, 11, 12, 13, 28, 29, 30, 31, 32]),
    }
    code = lambda x: x if x < 128 else -1

    def members(items) -> frozenset:
        found, negate = set(), False
        for op, value in items:
            if op is c.NEGATE:
                negate = True
            elif op is c.LITERAL:
                found.add(code(value))
            elif op is c.RANGE:
                found.update(range(value[0], min(value[1], 127) + 1), [-1] if value[1] > 127 else [])
            else:
                found |= classes[value]
        # Of the characters beyond 127 some are in no class.
        return every - (found - {-1}) if negate else frozenset(found)

    def product(parts: list[list[list]]) -> list[list]:
        out: list[list] = [[]]
        for part in parts:
            if len(out) * len(part) > MOST_ALTERNATIVES:
                part = [[_GAP]]
            out = [a + b for a in out for b in part]
        return out

    def expand(tree) -> list[list]:
        parts = []
        for op, value in tree:
            if op is c.LITERAL:
                parts.append([[chr(value)]])
            elif op is c.NOT_LITERAL:
                parts.append([[every - {code(value)} | {-1}]])
            elif op is c.ANY:
                parts.append([[every]])
            elif op is c.IN:
                parts.append([[members(value)]])
            elif op is c.BRANCH:
                parts.append([a for branch in value[1] for a in expand(branch)])
            elif op is c.SUBPATTERN and not value[1] and not value[2]:
                parts.append(expand(value[3]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                low, high, inner = value
                if low == 0 and high == 1:
                    parts.append([[], *expand(inner)])
                else:
                    parts += [expand(inner)] * min(low, 8)
                    if high != low or low > 8:
                        parts.append([[_GAP]])
            elif op is c.AT and value in (c.AT_BEGINNING, c.AT_BEGINNING_STRING, c.AT_END_STRING):
                parts.append([[frozenset()]])  # a border: no character
            elif op is c.AT and value is c.AT_END:
                parts.append([[frozenset([10])]])  # the end, or a line end before it
            elif op is c.AT and value is c.AT_BOUNDARY:
                parts.append([["\\b"]])
            else:
                parts.append([[_GAP]])
        return product(parts)

    tree = parser.parse(pattern)
    return [[_GAP]] if tree.state.flags & re.IGNORECASE else expand(tree)


def keys_of(alternative: list) -> list[str]:
    """Keys that every URL with a match of the alternative has: whole tokens, or else triples ('~' before them)."""
    runs, run, left = [], "", False

    def bounded(item) -> bool:
        """Whether what stands here surely is no character of a token."""
        return isinstance(item, frozenset) and not item & _WORD or isinstance(item, str) and len(item) == 1 and not (item.isascii() and item.isalnum())

    for i, item in enumerate([*alternative, _GAP]):
        if isinstance(item, str) and len(item) == 1 and item.isascii() and (item.isdigit() or item.islower()):
            if not run:
                before = alternative[i - 1] if i else _GAP
                # A word border before or after a letter or digit: what is beyond it isn't one.
                left = bounded(before) or before == "\\b"
            run += item
        elif run:
            runs.append((run, left and (bounded(item) or item == "\\b")))
            run = ""
    whole = [r for r, closed in runs if closed]
    return whole or ["~" + r[i : i + 3] for r, _ in runs for i in range(len(r) - 2)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, lower-cased) and path, without ? and #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    return host, re.split("[?#]", rest, maxsplit=1)[0]


def longest_rule(host: str, path: str, rules: dict[str, list[PathRule]]) -> PathRule | None:
    """rules: by host. Looks up the host and each parent domain."""
    best, at = None, host
    while at:
        for rule in rules.get(at, ()):
            if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                best = rule
        at = at.partition(".")[2]
    return best


def load_rules(table: DataFrame, most: int = 100_000) -> tuple[tuple[PathRule, ...], tuple[PatternRule, ...]]:
    """Rules from a table of kind (path or pattern), verdict, host, path and pattern; more than `most` are an error, as every worker holds them."""
    rows = table.select("kind", "verdict", "host", "path", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    path = sorted((r.host, r.path or "/", r.verdict) for r in rows if r.kind == "path")
    return tuple(PathRule(v, h, p) for h, p, v in path), tuple(PatternRule(p) for p in sorted({r.pattern for r in rows if r.kind == "pattern"}))


class Index:
    """Pattern rules by key. Without counts every key of an alternative is as good as another."""

    def __init__(self, patterns: tuple[PatternRule, ...]):
        self.rules = [(i, keys_of(a)) for i, p in enumerate(patterns) for a in alternatives(p.pattern)]
        bad = [patterns[i].pattern for i, keys in self.rules if not keys and not patterns[i].always]
        if bad:
            raise ValueError(f"no literal to index by: {bad}")
        self.named = {k for _, keys in self.rules for k in keys}
        self.triples = any(k[0] == "~" for k in self.named)
        self.build({})

    def build(self, counts: dict[str, int]) -> None:
        self.always = sorted({i for i, keys in self.rules if not keys})
        self.by_key: dict[str, list[int]] = {}
        for i, keys in self.rules:
            if keys:
                held = self.by_key.setdefault(min(keys, key=lambda k: (counts.get(k, 0), k[0] == "~", k)), [])
                if i not in held:
                    held.append(i)

    def keys_in(self, low: str, wanted) -> set[str]:
        """The wanted keys that a lower-cased URL has."""
        found = set()
        for t in _TOKEN.findall(low):
            if t in wanted:
                found.add(t)
            if self.triples:
                found.update(k for i in range(len(t) - 2) if (k := "~" + t[i : i + 3]) in wanted)
        return found

    def candidates(self, low: str) -> list[int]:
        return sorted({*self.always, *(i for k in self.keys_in(low, self.by_key) for i in self.by_key[k])})


def key_counts(urls: DataFrame, index: Index) -> dict[str, int]:
    """How many URLs have each key that some rule names: no more rows than the rules have keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for url in batch.column(1).to_pylist():
                if url:
                    counts.update(index.keys_in(url.translate(_LOWER), index.named))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    return {r["key"]: r["n"] for r in urls.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()} if index.named else {}


def judge(pages: DataFrame, path_rules: tuple[PathRule, ...] = (), patterns: tuple[PatternRule, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule (of the path rules), pattern (that rejected), verdict."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    ship(pages.sparkSession)
    index = Index(patterns)
    index.build(key_counts(urls, index))
    by_host: dict[str, list[PathRule]] = {}
    for rule in path_rules:
        by_host.setdefault(rule.host, []).append(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p.pattern) for p in patterns]
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = longest_rule(host, path, by_host)
                hit = None
                if rule is None and url:
                    low = url.translate(_LOWER)
                    hit = next((patterns[i].pattern for i in index.candidates(low) if compiled[i].search(low)), None)
                out.append((host, path, rule and rule.name, hit, rule.verdict if rule else "block" if hit else "allow"))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["page_id", "host", "path", "rule", "pattern", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, pattern string, verdict string")
