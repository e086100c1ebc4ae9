"""A small document tree on the standard HTML parser, and what is read from it: text, links, images, tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html import escape
from html.entities import html5
from html.parser import HTMLParser

from .urls import NOT_CONTENT_IMAGE, resolve, sanitized

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What may stay open when its like begins: opening one closes the other.
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl div section article body".split())
BOILERPLATE = frozenset("script style nav footer header noscript svg".split())
HEADERS = {f"h{i}": i for i in range(1, 7)}


class Element:
    """An element with its children (elements and strings) and its place in the source."""

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None, offset: int):
        self.name, self.attributes, self.parent, self.offset, self.children = name, attributes, parent, offset, []

    def walk(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, Element):
                yield from c.strings()
            else:
                yield c

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return separator.join(s for s in parts if s or not strip)

    def find_all(self, *names: str) -> list[Element]:
        return [e for e in self.walk() if e.name in names]

    def remove(self, names: frozenset[str]) -> None:
        self.children = [c for c in self.children if not (isinstance(c, Element) and c.name in names)]
        for c in self.children:
            if isinstance(c, Element):
                c.remove(names)

    def above(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None, 0)
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag)
        if closes:
            node = self.at
            while node.parent is not None and node.name not in _SCOPES:
                if node.name in closes:
                    self.at = node.parent
                    break
                node = node.parent
        line, column = self.getpos()
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.lines[line - 1] + column)
        self.at.children.append(element)
        if tag not in _VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.name == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(source: str) -> Element:
    return _Builder(source).root


def _closed(m: re.Match) -> str:
    return m[0] if m[1].startswith("#") or m[1] in html5 else f"&amp;{m[1]}"


def only_closed(source: str) -> str:
    """The source with every ampersand escaped that begins no whole character reference with its semicolon, so that a parser leaves them as they are."""
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|#|[a-zA-Z0-9]+;|)", lambda m: _closed(m) if m[1] and m[1] != "#" else f"&amp;{m[1]}", source)


def code_language(pre: Element) -> str:
    """From class names such as language-x, lang-x or highlight-source-x."""
    code = next(iter(pre.find_all("code")), None)
    for e in (code, pre, pre.parent):
        for name in (e.attributes.get("class", "") if e is not None else "").split():
            m = re.match(r"(?:language|lang|highlight-source)-(.+)", name)
            if m:
                return m[1]
    return ""


def fence_code(root: Element) -> None:
    """pre elements become fenced text."""
    for pre in root.find_all("pre"):
        source = next(iter(pre.find_all("code")), pre).text()
        if source.strip() and pre.parent is not None:
            at = pre.parent.children
            at[at.index(pre)] = f"\n```{code_language(pre)}\n{source}\n```\n"


def extract(html: str) -> tuple[str, str]:
    """(title, text): a line for each string of text outside boilerplate."""
    root = parse(html or "")
    title = next((e.text(strip=True) for e in root.find_all("title")), "")
    fence_code(root)
    root.remove(BOILERPLATE)
    return title, re.sub(r"\n{3,}", "\n\n", root.text("\n", strip=True)).strip()


#: What a tier makes of a page: its text, or None.
Tier = Callable[[str], str | None]


def dense_text(html: str) -> str | None:
    """The text of the element whose paragraphs hold most text, commas counting extra and links less; None without paragraphs."""
    root = parse(html or "")
    fence_code(root)
    root.remove(BOILERPLATE)
    scores: dict[int, tuple[float, Element]] = {}
    for p in root.find_all("p", "pre", "td", "blockquote"):
        text = p.text(" ", strip=True)
        if p.parent is None or len(text) < 25:
            continue
        linked = sum(len(a.text(" ", strip=True)) for a in p.find_all("a"))
        weight = (len(text) + 25 * text.count(",")) * (1 - linked / max(len(text), 1))
        for share, node in zip((1.0, 0.5), (p.parent, p.parent.parent)):
            if node is not None:
                scores[id(node)] = (scores.get(id(node), (0.0, node))[0] + share * weight, node)
    if not scores:
        return None
    best = max(scores.values(), key=lambda s: s[0])[1]
    return best.text("\n", strip=True)


def tiered(html: str, tiers: Sequence[tuple[str, Tier]] = (), least: int = 50, closed: bool = False) -> tuple[str, str, str]:
    """(title, text, method): the first tier with more than `least` characters, else all text outside boilerplate. A tier that fails is passed over.
    With `closed` only character references that end in a semicolon are decoded; a page that was cut within one has its rest as text."""
    if not html or not html.strip():
        return "", "", "none"
    html = only_closed(html) if closed else html
    title, plain = extract(html)
    for name, tier in tiers:
        try:
            text = tier(html)
        except Exception:  # noqa: BLE001  the next tier is tried
            text = None
        if text and len(text.strip()) > least:
            return title, text.strip(), name
    return title, plain, "strip"


def base_url(root: Element, page_url: str) -> str:
    return next((resolve(page_url, e.attributes["href"]) for e in root.find_all("base") if e.attributes.get("href")), page_url)


def links(html: str, page_url: str) -> list[tuple[str, str]]:
    """(target, anchor text): resolved, without fragment, each target once, the page itself left out."""
    root = parse(html or "")
    base, seen, out = base_url(root, page_url), set(), []
    for a in root.find_all("a"):
        href = a.attributes.get("href", "").strip()
        if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:")):
            continue
        try:
            target = resolve(base, href).partition("#")[0]
        except ValueError:
            continue
        if not target.startswith(("http://", "https://")) or target in seen or target == page_url.partition("#")[0]:
            continue
        seen.add(target)
        out.append((target, escape(a.text(" ", strip=True))))
    return out


def wiki_links(element: Element, page_url: str) -> list[str]:
    """Targets in an element, each once, in order; fragments of the page itself, scripts and mail left out."""
    out: dict[str, None] = {}
    for a in ([element] if element.name == "a" else []) + element.find_all("a"):
        href = a.attributes.get("href", "").strip()
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            out[resolve(page_url, href)] = None
    return list(out)


def widest(srcset: str) -> str | None:
    best: tuple[float, str] | None = None
    for url, size in re.findall(r"(\S+)\s+([\d.]+)[wx]", srcset):
        url = url.lstrip(",")
        try:
            width = float(size)
        except ValueError:
            width = 1.0
        if url and (best is None or width > best[0]):
            best = (width, url)
    return best and best[1]


def _number(value: str | None) -> int | None:
    m = re.match(r"\s*(\d+)", value or "")
    return int(m[1]) if m else None


def images(html: str, page_url: str) -> list[dict]:
    """Content images: src_url, alt_text, width, height, dom_offset. Left out: those in menus and the like, hidden ones, data
    addresses, vector icons, trackers, and those that are small by their attributes."""
    root = parse(html or "")
    base, out, seen = base_url(root, page_url), [], set()
    for img in root.find_all("img"):
        a = img.attributes
        chain = [img, *img.above()]
        if any(e.name in ("nav", "footer", "header", "aside") for e in chain[1:]) or any(e.attributes.get("aria-hidden") == "true" or e.attributes.get("role") in ("presentation", "none") for e in chain):
            continue
        source = a.get("srcset") and widest(a["srcset"]) or next((a[k] for k in ("src", "data-src", "data-lazy-src") if a.get(k)), None)
        if not source or source.startswith("data:") or re.search(r"\.(svg|ico)(?:[?#]|$)", source, re.I):
            continue
        url = sanitized(resolve(base, source))
        if re.search(NOT_CONTENT_IMAGE, url) or url in seen:
            continue
        w, h = _number(a.get("width")), _number(a.get("height"))
        if w is not None and h is not None and (w < 100 and h < 100 or w * h < 15000):
            continue
        seen.add(url)
        out.append({"src_url": url, "alt_text": a.get("alt", ""), "width": w, "height": h, "dom_offset": img.offset})
    return out


def table_markdown(table: Element) -> str:
    """Rows of a table as markdown; the separator comes after the first header row, else after the first row."""
    rows, header = [], None
    for tr in table.find_all("tr"):
        cells = [c for c in tr.children if isinstance(c, Element) and c.name in ("td", "th")]
        if not cells:
            continue
        if header is None and all(c.name == "th" for c in cells):
            header = len(rows)
        rows.append([re.sub(r"\s+", " ", c.text(" ", strip=True)).replace("|", "\\|") for c in cells])
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    lines.insert((header or 0) + 1, f"| {' | '.join(['---'] * width)} |")
    return "\n".join(lines)
