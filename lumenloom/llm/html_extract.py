"""Main text of web pages by equivalence-class template deduction.

A token is a tag or a run of text, told apart by its path of open elements; its first, second, ... occurrence in a page
are roles of their own. Roles of one host's pages that come in the same pages (equal occurrence vectors) form a class. A class is valid with at
least `least_tokens` roles in at least `least_pages` pages and `share` of the host's; in a page it is used if its roles come in
the class's order and within one gap of each other class used (or the other way round). The valid classes, nested, are the host's
template; what lies between their tokens are slots.

Where the main text is, is a fact of the host: how much slot text the template's elements hold over all its pages. From the
root on, the one child that holds `most` of the text is entered as long as it is a container that comes equally often in every page;
headings passed on the way belong to the text. The element reached is the region, in pages with little text too. Names refine it:
a region within an article grows to the article, a region around articles shrinks to them.
Elements that are menus, headers, footers, sidebars, notices, adverts, forms or reader comments by name, role or class
are never content, nor are scripts, styles and hidden elements. Text that is itself a template token is dropped outside articles, and within a region
only where most of the page's text there is its own: of near-copies on one host, which share most of it, all text stays. A page whose host
has no template, or which doesn't fit it, is on its own: its articles, or else its main element, or else the element with most text.

Copies of a page (equal html on one host) are one page for the vectors and counts, so that repeated rows change no template and
a host of copies of one page has none. Vectors are not gathered anywhere: each role keeps the exclusive or of its pages' hashes,
so a host with a third of all pages needs no more room than any other. Templates meet their pages by host and
salt, so that no host is one task's.

Defined results: null html gives an empty text, a null url or one without host is a host of its own without a
template. Repeated rows are extracted alike. Block text has single spaces, blocks are joined by \\n; no text is cut.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HOST = r"(?s)^.*?://([^/?#]*)"
_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea noscript template title iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content.
ASIDE = frozenset("nav footer aside form head script style noscript template button select option menu dialog iframe svg textarea label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id that mark what isn't content.
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended widget toolbar pagination pager login search skip copyright".split()
)
TITLES = frozenset(("header", "masthead"))  # content within an article


@dataclass(frozen=True)
class Extraction:
    least_tokens: int = 2
    least_pages: int = 4
    share: float = 0.5
    text_share: float = 0.9  # of the pages that a text must be in to count as template
    text_pages: int = 8
    most: float = 0.5
    salts: int = 32


#: Elements that the way to the region may lead through.
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
HEADINGS = frozenset(("h1", "h2", "h3"))

def host_column() -> Column:
    """The host of `url`, A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract("url", _HOST, 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


class Node:
    __slots__ = ("article", "aside", "main", "mass", "name", "number", "parent", "path", "role")

    def __init__(self, name: str, path: int, number: int, aside: bool, article: int, main: int, parent: Node | None = None):
        self.name, self.path, self.number, self.aside, self.article, self.main, self.parent = name, path, number, aside, article, main, parent
        self.mass, self.role = 0, 0


def _aside(name: str, attributes: str, within: bool) -> tuple[bool, str]:
    """Whether the element is not content, and its class as part of the path."""
    if name in ASIDE or name == "header" and not within:
        return True, ""
    if "=" not in attributes and "hidden" not in attributes:
        return False, ""
    shown, out = "", False
    for key, *values in _NAMES.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            out = True
        elif key == "role":
            out = out or value.lower() in ROLES
        elif key in ("class", "id"):
            shown += value if key == "class" else ""
            parts = {p.lower() for p in _PART.findall(value)} | set(value.lower().split())
            if name not in ("body", "html", "article", "main") or parts & {"comment", "comments"}:
                marks = parts & MARKS
                out = out or bool(marks - (TITLES if within else set()))
            if "header" in parts and not within and name != "h1":
                out = out or name in ("div", "section")
    return out, shown


def tokens(source: str) -> Iterator[tuple[int, str, str, Node, Node]]:
    """(path hash, kind, value, enclosing element, nearest block); kind is '<', '>' or 't' (value: raw text)."""
    root = Node("", 0, 0, False, -1, -1)
    stack, blocks, at, count = [root], [root], 0, 0
    hash_ = xxhash.xxh3_64_intdigest
    end = len(source)
    while at < end:
        m = _TAG.search(source, at)
        start = m.start() if m else end
        if start > at:
            yield stack[-1].path, "t", source[at:start], stack[-1], blocks[-1]
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    while len(stack) > i:
                        node = stack.pop()
                        if blocks[-1] is node:
                            blocks.pop()
                    yield stack[-1].path, ">", name, stack[-1], blocks[-1]
                    break
            continue
        if name in BLOCK or name == "p":  # a block ends an open paragraph, an item the item before
            for i in range(len(stack) - 1, 0, -1):
                n = stack[i].name
                if n == "p" or name == "li" and n == "li" or name in ("dt", "dd") and n in ("dt", "dd") or name in ("td", "th") and n in ("td", "th") or name == "tr" and n in ("tr", "td", "th"):
                    while len(stack) > i:
                        node = stack.pop()
                        if blocks[-1] is node:
                            blocks.pop()
                    if n == "p" or name != "tr":
                        break
                elif n in BLOCK:
                    break
        top = stack[-1]
        aside, shown = (True, "") if top.aside else _aside(name, attributes, top.article >= 0)
        count += 1
        node = Node(
            name, hash_(f"{name}.{shown}", seed=top.path), count, aside, count if name == "article" and top.article < 0 and not aside else top.article, count if (name == "main" or "main" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes)) and top.main < 0 and not aside else top.main, top
        )
        yield node.path, "<", name, node, blocks[-1]
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = close.end() if close else end
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(node)
            if name in BLOCK:
                blocks.append(node)


def key_of(path: int, kind: str, value: str) -> int:
    """A token's number: its value at its path."""
    return xxhash.xxh3_64_intdigest(" ".join(value.split()) if kind == "t" else value, seed=path ^ (1 if kind == "t" else 2 if kind == "<" else 3))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def roles_of(items: list[tuple]) -> tuple[list[int], Counter]:
    """The role of each token of a page (0 for white space), and how often each token comes. Nodes get the roles of their tags, and the length of
    the content text within them."""
    counts: Counter = Counter()
    out = []
    for path, kind, value, node, _ in items:
        if kind == "t":
            text = value.strip()
            if not text:
                out.append(0)
                continue
            if not node.aside:
                above = node
                while above is not None:
                    above.mass += len(text)
                    above = above.parent
        token = key_of(path, kind, value)
        counts[token] += 1
        n = counts[token]
        role = signed(token if n == 1 else xxhash.xxh3_64_intdigest(n.to_bytes(4, "little"), seed=token))
        if kind == "<":
            node.role = role
        out.append(role)
    return out, counts


ROLE = "host string, role long, kind string, sort string, vector long, pages long, place double, mass long, parent long, other_parent long, least long, most long"


def occurrences(pages: DataFrame) -> DataFrame:
    """A row of ROLE for each role of a host and task; role 0 counts pages. sort: c for containers, h for headings; parent: the
    role of the element around an element, least and most, as other_parent says; least, most: how often the token comes in a page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def emit() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 12, kinds)], names=[x.split()[0] for x in ROLE.split(", ")])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = list(tokens(html))
                roles, counts = roles_of(items)
                seed = signed(xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass")))
                seen = [((host, 0, "", ""), 0.0, 0, 0, 1)]
                for place, ((path, kind, value, node, _), role) in enumerate(zip(items, roles)):
                    if not role:
                        continue
                    if kind == "<":
                        sort = "" if node.aside else "c" if node.name in CONTAINERS else "h" if node.name in HEADINGS else ""
                        seen.append(((host, role, kind, sort), float(place), node.mass, node.parent.role, counts[key_of(path, kind, value)]))
                    else:
                        seen.append(((host, role, kind, ""), float(place), 0, 0, 1))
                for key, place, mass, parent, n in seen:
                    row = held.get(key)
                    if row is None:
                        held[key] = [seed, 1, place, mass, parent, parent, n, n]
                    else:
                        row[0] ^= seed
                        row[1] += 1
                        row[2] += place
                        row[3] += mass
                        row[4], row[5] = min(row[4], parent), max(row[5], parent)
                        row[6], row[7] = min(row[6], n), max(row[7], n)
            if len(held) > 200_000:
                yield emit()
        yield emit()

    # One page of each host and html: partial aggregates leave one a task, however often it comes.
    rows = pages.select(host_column().alias("host"), F.col("html").cast("string").alias("html")).filter("host <> '' and html <> ''")
    distinct = rows.groupBy("host", F.md5(F.encode("html", "utf-8")).alias("digest")).agg(F.first("html").alias("html"))
    return distinct.select("host", "html").mapInArrow(run, ROLE)


@dataclass
class Template:
    """classes: roles in order; texts: those of text; region and heads: the elements that hold the main text, 0 if unknown."""

    classes: list[list[int]]
    texts: frozenset[int]
    region: int
    heads: frozenset[int]


def region_of(elements: dict[int, tuple], how: Extraction) -> tuple[int, list[int]]:
    """elements: role -> (place, mass, parent, steady, sort). The region, and the headings passed on the way to it."""
    children: dict[int, list[int]] = defaultdict(list)
    for role, (_, _, parent, _, _) in elements.items():
        children[parent if parent in elements else 0].append(role)
    at, heads = 0, []
    total = sum(elements[r][1] for r in children[0])
    while True:
        ways = [r for r in children[at] if elements[r][3] and elements[r][4] == "c"]
        best = max(ways, key=lambda r: (elements[r][1], -elements[r][0], r), default=0)
        if not best or elements[best][1] <= how.most * total:
            return at, heads
        heads += [r for r in children[at] if elements[r][4] == "h" and elements[r][0] < elements[best][0]]
        at, total = best, elements[best][1]


TEMPLATE = "host string, classes array<array<long>>, texts array<long>, region long, heads array<long>"


def templates(pages: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    """host, classes (roles in order), texts, region, heads: one row for each host with a template. Classes in most pages and with most
    roles come first and keep their places where another is not nested with them."""
    sums = [F.sum(c).alias(c) for c in ("pages", "place", "mass")]
    found = occurrences(pages).groupBy("host", "role", "kind").agg(F.max("sort").alias("sort"), F.bit_xor("vector").alias("vector"), *sums, F.min("parent").alias("parent"), F.max("other_parent").alias("other_parent"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = materialize(found.filter(F.col("pages") >= how.least_pages), "roles")
    whole = materialize(found.filter("role = 0 and kind = ''").select("host", F.col("pages").alias("all_pages")), "hosts")
    often = found.filter("kind <> ''").join(whole, "host").filter(F.col("pages") >= how.share * F.col("all_pages"))
    often = often.filter((F.col("kind") != "t") | (F.col("pages") >= how.text_share * F.col("all_pages")) & (F.col("pages") >= how.text_pages))
    role = F.struct((F.col("place") / F.col("pages")).alias("place"), "role", "kind", "sort", "mass", F.when(F.col("parent") == F.col("other_parent"), F.col("parent")).alias("parent"), (F.col("least") == F.col("most")).alias("steady"))
    # The roles of a class are few: each is in half of the host's pages.
    classes = often.groupBy("host", "vector", "pages").agg(F.sort_array(F.collect_list(role)).alias("t")).filter(F.size("t") >= how.least_tokens)
    hosts = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("less"), (-F.size("t")).alias("short"), "t"))).alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = [r for c in classes for r in c["t"]]
                region, heads = region_of({r["role"]: (r["place"], r["mass"], r["parent"], r["steady"], r["sort"]) for r in held if r["kind"] == "<"}, how)
                rows.append((host, [[r["role"] for r in c["t"]] for c in classes], [r["role"] for r in held if r["kind"] == "t"], region, heads))
            kinds = [pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=[x.split()[0] for x in TEMPLATE.split(", ")])

    return hosts.select("host", F.expr("transform(classes, c -> struct(c.t as t))").alias("classes")).mapInArrow(run, TEMPLATE)


def template_places(sequence: list[int], classes: list[list[int]]) -> dict[int, int]:
    """Places (by role) of the classes that are valid in this page: in order, and nested."""
    wanted = {r for c in classes for r in c}
    at = {role: place for place, role in enumerate(sequence) if role in wanted}
    taken: list[list[int]] = []
    out: dict[int, int] = {}
    for c in classes:
        places = [at.get(r) for r in c]
        if None in places or any(a >= b for a, b in zip(places, places[1:])):
            continue
        if all(_nested(places, other) for other in taken):
            taken.append(places)
            out.update(zip(c, places))
    return out


def _nested(a: list[int], b: list[int]) -> bool:
    """Whether one of two ascending place lists lies within one gap of the other."""
    return bisect(a, b[0]) == bisect(a, b[-1]) or bisect(b, a[0]) == bisect(b, a[-1])


def _below(node: Node | None, top: Node) -> bool:
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


def _mostly_fixed(items: list[tuple], fixed: set[int], region: Node) -> bool:
    """Whether template text is half of the region's content or more, as in pages that are near-copies of each other."""
    total = shared = 0
    for place, (_, kind, value, node, _) in enumerate(items):
        if kind == "t" and not node.aside and _below(node, region):
            n = len(value.strip())
            total += n
            shared += n if place in fixed else 0
    return 2 * shared >= total


def main_text(html: str | None, template: Template | None) -> str:
    """The text of the slots in the content region."""
    if not html:
        return ""
    items = list(tokens(html))
    places: dict[int, int] = {}
    if template is not None:
        places = template_places(roles_of(items)[0], template.classes)
    fixed = {place for role, place in places.items() if role in template.texts} if template is not None else set()
    region = items[places[template.region]][3] if template is not None and template.region in places else None
    heads = {items[places[r]][3].number for r in template.heads if r in places} if region is not None else set()

    if fixed and region is not None and _mostly_fixed(items, fixed, region):
        fixed = {place for place in fixed if not _below(items[place][3], region)}

    def within(node: Node) -> bool:
        while node is not None:
            if node is region or node.number in heads:
                return True
            node = node.parent
        return False

    # Slots' texts by block: (nearest block, article, main, in the region, text).
    blocks: list[list] = []
    last = None
    for place, (_, kind, value, node, block) in enumerate(items):
        if kind != "t":
            if kind == "<" and node.name in BLOCK or kind == ">" and value in BLOCK:
                last = None
            elif kind == "<" and node.name == "br" and last is not None and blocks:
                blocks[-1][4].append(" ")
            continue
        if node.aside or place in fixed and node.article < 0:
            continue
        if last is not block:
            blocks.append([block, node.article, node.main, region is not None and within(node), []])
            last = block
        blocks[-1][4].append(value)
    texts = [(block, article, main, inside, " ".join(entities.unescape("".join(parts)).split())) for block, article, main, inside, parts in blocks]
    texts = [t for t in texts if t[4]]
    if region is not None:
        chosen = [t for t in texts if t[3]]
        if region.article >= 0:  # the region lies in an article: all of that
            chosen = [t for t in texts if t[3] or t[1] == region.article]
        elif any(t[1] >= 0 for t in chosen):
            chosen = [t for t in chosen if t[1] >= 0]
        return "\n".join(t[4] for t in chosen)
    chosen = [t for t in texts if t[1] >= 0] or [t for t in texts if t[2] >= 0]
    if not chosen:
        # No article or main element: the container of the slots with most text, by the path above the block.
        sizes: dict[int, int] = defaultdict(int)
        for block, *_, text in texts:
            sizes[block.path] += len(text)
        if sizes:
            best = max(sizes.items(), key=lambda s: s[1])[0]
            places_ = [i for i, t in enumerate(texts) if t[0].path == best]
            heads_ = [i for i in range(places_[0]) if texts[i][0].name in HEADINGS]
            chosen = [t for i, t in enumerate(texts) if places_[0] <= i <= places_[-1] or i in heads_]
    return "\n".join(t[4] for t in chosen)


def extract(pages: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    """page_id, url, text: one row for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = materialize(templates(rows, how), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for batch in batches:
            texts = []
            hosts = batch.column(3).to_pylist()
            for i, (host, html) in enumerate(zip(hosts, batch.column(2).to_pylist())):
                template = None
                if batch.column(4)[i].is_valid:
                    if host not in held:
                        if len(held) > 1000:
                            held.clear()
                        classes, words, region, heads = (batch.column(c)[i].as_py() for c in (4, 5, 6, 7))
                        held[host] = Template(classes, frozenset(words), region, frozenset(heads))
                    template = held[host]
                texts.append(main_text(html, template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    salted = rows.withColumn("host", host_column()).withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(how.salts)).cast("int"))
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(how.salts - 1))))
    joined = salted.join(copies, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "host", "classes", "texts", "region", "heads").mapInArrow(run, "page_id long, url string, text string")
