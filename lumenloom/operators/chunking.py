"""Chunkers: rows of text, HTML or code become rows of chunks; each row is chunked by itself, so nothing is shuffled. Text is packed in the JVM, HTML and code run on Arrow batches."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom, packing
from ..functions import text as tx
from ..shipping import ship

_TOKENS = re.compile(tx.TOKEN)
#: A sentence ends in . ! or ? before white space, but not after e.g. or i.e.
_SENTENCE = re.compile(r"(?<=[.!?])(?<!e\.g\.)(?<!i\.e\.)\s+")
_CLAUSE = re.compile(r"(?<=[,;:])\s+")


def token_count(text: str) -> int:
    return len(_TOKENS.findall(text))


def pack(items: Iterable[str], limit: int, joiner: str, oversized: Callable[[str], list[str]] | None = None, count: Callable[[str], int] = token_count) -> list[str]:
    """Items joined greedily into pieces of at most `limit` tokens; an item over it goes through `oversized`."""
    out, held, total = [], [], 0

    def flush() -> None:
        nonlocal held, total
        if held:
            out.append(joiner.join(held))
        held, total = [], 0

    for item in items:
        n = count(item)
        if n > limit and oversized is not None:
            flush()
            out.extend(oversized(item))
            continue
        if held and total + n > limit:
            flush()
        held.append(item)
        total += n
    flush()
    return out


def split_oversized(text: str, limit: int) -> list[str]:
    """By sentences, else clauses, else words, as far as needed."""
    for boundary in (_SENTENCE, _CLAUSE):
        parts = boundary.split(text)
        if len(parts) > 1:
            return pack(parts, limit, " ", lambda part: split_oversized(part, limit))
    return pack(text.split(), limit, " ")


def paragraphs(text: str | None, limit: int = 400) -> list[str]:
    """Paragraphs (between blank lines) packed into chunks."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", (text or "").strip())]
    return pack((p for p in parts if p), limit, "\n\n", lambda p: split_oversized(p, limit))


def _per_row(df: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """make(*values of columns) gives result rows for one row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*(c.to_pylist() for c in batch.columns)) for r in make(*values)]
            cols = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return df.select(*columns).mapInArrow(run, ddl)


def chunk_paragraphs(pages: DataFrame, limit: int = 400) -> DataFrame:
    """pages: page_url, text. page_url, chunk_no, text, chunk_id, content_type. In the JVM, row by row."""
    rows = pages.select("page_url", F.posexplode(packing.paragraphs(F.col("text"), limit)).alias("chunk_no", "text"))
    return rows.withColumn("chunk_id", tx.web_chunk_id(F.col("page_url"), F.col("chunk_no"))).withColumn("content_type", tx.content_type(F.col("text")))


def chunk_children(chunks: DataFrame, limit: int = 200, keep_single: bool = True) -> DataFrame:
    """Chunks (chunk_id, page_url, section_title, text, content_type) split into children; a chunk that makes one child only is left out unless keep_single."""
    made = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), "page_url", "section_title", "content_type", packing.paragraphs(F.col("text"), limit).alias("_made"))
    if not keep_single:
        made = made.filter(F.size("_made") > 1)
    rows = made.select("parent_chunk_id", "page_url", "section_title", "content_type", F.posexplode("_made").alias("child_no", "text"))
    return rows.withColumn("chunk_id", tx.child_chunk_id(F.col("parent_chunk_id"), F.col("child_no"))).withColumn("is_child", F.lit(True))


def _words(text: str) -> int:
    return len(text.split())


def _flat(nodes: list, out: list) -> list:
    """Containers that hold a table or pre are opened; others stay whole."""
    for node in nodes:
        if isinstance(node, dom.Element) and node.name not in ("table", "pre") and node.find_all("table", "pre"):
            _flat(node.children, out)
        else:
            out.append(node)
    return out


def wiki_sections(root: dom.Element) -> list[tuple[list[str], list]]:
    """(breadcrumb, nodes) by the headers directly in the body."""
    body = next(iter(root.find_all("body")), root)
    sections: list[tuple[list[str], list]] = []
    crumbs: list[tuple[int, str]] = []
    nodes: list = []
    for child in body.children:
        if isinstance(child, dom.Element) and child.name in dom.HEADERS:
            if nodes:
                sections.append(([t for _, t in crumbs], nodes))
            nodes, level = [], dom.HEADERS[child.name]
            crumbs = [c for c in crumbs if c[0] < level] + [(level, child.text(" ", strip=True))]
        else:
            nodes.append(child)
    if nodes:
        sections.append(([t for _, t in crumbs], nodes))
    return sections


def wiki_chunks(html: str | None, url: str, title: str | None = None, limit: int = 500) -> list[dict]:
    """Chunks of a wiki page: within sections, tables whole as markdown, long code whole, the rest packed."""
    if not html or not html.strip():
        return []
    root = dom.parse(html)
    root.remove(dom.BOILERPLATE | {"aside"})
    if not root.text(strip=True):
        return []
    if not root.find_all("table", *dom.HEADERS):
        return [{"section_title": title or "", "text": t, "links": [], "kind": None, "plain": True} for t in paragraphs(root.text("\n\n"), limit)]
    out: list[dict] = []
    for crumbs, nodes in wiki_sections(root):
        name = " > ".join(([title] if title and crumbs else []) + crumbs) or title or "(untitled)"
        held: list[tuple[str, object]] = []
        total = 0

        def add(text: str, sources: list, kind: str | None = None, name: str = name) -> None:
            found = dict.fromkeys(t for s in sources if isinstance(s, dom.Element) for t in dom.wiki_links(s, url))
            out.append({"section_title": name, "text": text, "links": list(found), "kind": kind, "plain": False})

        def flush() -> None:
            nonlocal held, total
            if "".join(t for t, _ in held).strip():
                add("\n\n".join(t for t, _ in held), [s for _, s in held])
            held, total = [], 0

        for node in _flat(nodes, []):
            if isinstance(node, dom.Element) and node.name == "table":
                table = dom.table_markdown(node)
                if table:
                    flush()
                    add(table, [node])
                continue
            code = isinstance(node, dom.Element) and node.name == "pre"
            text = node.strip() if isinstance(node, str) else node.text() if code else node.text(" ", strip=True)
            if not text.strip():
                continue
            n = _words(text)
            if code and n > limit:
                flush()
                add(text, [node], "code")
                continue
            if held and total + n > limit or code and total + n > limit:
                flush()
            held.append((text, node))
            total += n
        flush()
    return out


def chunk_wiki(pages: DataFrame, limit: int = 500) -> DataFrame:
    """pages: page_url, title, html. page_url, section_title, chunk_no, text, cross_links, chunk_id, content_type."""
    schema = pa.schema([("page_url", pa.string()), ("section_title", pa.string()), ("chunk_no", pa.int32()), ("text", pa.string()), ("cross_links", pa.list_(pa.string())), ("kind", pa.string())])

    def make(url, title, html):
        for i, c in enumerate(wiki_chunks(html, url, title, limit)):
            yield url, c["section_title"], i, c["text"], c["links"] or None, c["kind"]

    rows = _per_row(pages, ["page_url", "title", "html"], schema, "page_url string, section_title string, chunk_no int, text string, cross_links array<string>, kind string", make)
    section = F.concat(F.col("section_title"), F.lit("::"), F.col("chunk_no").cast("string"))
    return rows.withColumn("chunk_id", tx.wiki_chunk_id(F.col("page_url"), section)).withColumn("content_type", F.coalesce("kind", tx.content_type(F.col("text")))).drop("kind")


def html_text(pages: DataFrame, tiers: Sequence[tuple[str, dom.Tier]] = (), closed: bool = False) -> DataFrame:
    """pages: page_url, html. page_url, title, text, method: by the first tier that finds enough text (say ("dense", dom.dense_text), or a reader of one's
    own), else all text outside boilerplate. `closed`: only character references with a semicolon are decoded."""
    schema = pa.schema([("page_url", pa.string()), ("title", pa.string()), ("text", pa.string()), ("method", pa.string())])
    return _per_row(pages, ["page_url", "html"], schema, "page_url string, title string, text string, method string", lambda url, html: [(url, *dom.tiered(html, tiers, closed=closed))])


def html_links(pages: DataFrame) -> DataFrame:
    """pages: page_url, html. source_url, target_url, anchor_text."""
    schema = pa.schema([("source_url", pa.string()), ("target_url", pa.string()), ("anchor_text", pa.string())])
    return _per_row(pages, ["page_url", "html"], schema, "source_url string, target_url string, anchor_text string", lambda url, html: ((url, *x) for x in dom.links(html, url)))


def html_images(pages: DataFrame) -> DataFrame:
    """pages: page_url, html. page_url, src_url, alt_text, width, height, dom_offset, image_id."""
    schema = pa.schema([("page_url", pa.string()), ("src_url", pa.string()), ("alt_text", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("dom_offset", pa.int32())])
    rows = _per_row(pages, ["page_url", "html"], schema, "page_url string, src_url string, alt_text string, width int, height int, dom_offset int", lambda url, html: ((url, *x.values()) for x in dom.images(html, url)))
    return rows.withColumn("image_id", tx.image_id(F.col("src_url")))


# Code

#: Languages by file extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python",
    "go": "go",
    "java": "java", "kt": "java", "kts": "java", "groovy": "java", "gradle": "java",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "html": "html", "htm": "html", "xhtml": "html", "svelte": "html", "vue": "html",
    "sh": "bash", "bash": "bash", "zsh": "bash", "fish": "bash", "ksh": "bash",
    "cs": "c_sharp",
    "csproj": "xml", "fsproj": "xml", "vbproj": "xml", "sln": "xml", "props": "xml", "targets": "xml", "nuspec": "xml", "xml": "xml", "xsl": "xml", "xsd": "xml", "svg": "xml", "plist": "xml", "xaml": "xml", "resx": "xml",
    "c": "c", "h": "c",
    "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp",
    "rs": "rust",
    "rb": "ruby", "rake": "ruby",
    "tf": "hcl", "tfvars": "hcl", "hcl": "hcl",
    "dockerfile": "dockerfile",
    "yaml": "yaml", "yml": "yaml",
    "toml": "toml",
    "json": "json", "jsonc": "json",
    "css": "css", "scss": "css", "less": "css",
    "sql": "sql",
    "proto": "protobuf",
    "md": "markdown", "markdown": "markdown",
    "rst": "restructuredtext",
}
#: Files to index, those that are documents, and folders to leave out.
INDEXABLE = "py js ts tsx jsx cs java go rb rs c cpp h hpp swift kt scala md rst txt yaml yml json toml html css scss sql sh bash dockerfile".split()
DOCUMENTS = "md rst txt yaml yml json toml".split()
SKIPPED_FOLDERS = ".git node_modules __pycache__ .venv vendor build dist .tox".split()


def detect_language(path: str) -> str | None:
    name = path.replace("\\", "/").rpartition("/")[2]
    if name.startswith("Dockerfile"):
        return "dockerfile"
    if name in ("Rakefile", "Gemfile"):
        return "ruby"
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None


def language_of(path):
    """detect_language as a Column expression."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(name.startswith("Dockerfile"), "dockerfile").when(name.isin("Rakefile", "Gemfile"), "ruby").otherwise(known[extension])


def _head(path: str, branch: str) -> str:
    return f"// File: {path} (branch {branch})" if branch else f"// File: {path}"


def first_sentence(text: str) -> str:
    text = " ".join(text.split())
    end = text.find(". ")
    return text if end < 0 else text[: end + 1]


def _enriched(body: str, path: str, branch: str, parents: list[str], signature: str = "", doc: str = "", class_doc: str = "", module_doc: str = "") -> str:
    lines = [_head(path, branch)]
    for label, value in (("", module_doc), ("Parents: ", " > ".join(parents)), ("Class: ", first_sentence(class_doc)), ("Signature: ", signature), ("Doc: ", first_sentence(doc))):
        if value:
            lines.append(f"// {label}{value}")
    return "\n".join([*lines, body])


def _python_chunks(path: str, source: str, branch: str, small: int) -> list[dict]:
    tree, lines = ast.parse(source), source.split("\n")
    module = ast.get_docstring(tree) or ""
    brief, out = first_sentence(module) if module else "", []
    if module and module != brief:
        out.append({"text": f"{_head(path, branch)}\n// {module}", "metadata": {"preamble": "true", "namespace": ""}})

    def body(node) -> str:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        return "\n".join(lines[start - 1 : node.end_lineno])

    def walk(nodes, parents: list[str], class_doc: str) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                text, doc = body(node), ast.get_docstring(node) or ""
                if len(text) // 4 < small:
                    out.append({"text": _enriched(text, path, branch, parents, doc=doc, module_doc=brief), "metadata": {"class": node.name, "namespace": ".".join(parents)}})
                else:
                    walk(node.body, [*parents, node.name], doc)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                signature = lines[node.lineno - 1].strip().rstrip(":")
                out.append(
                    {"text": _enriched(body(node), path, branch, parents, signature, ast.get_docstring(node) or "", class_doc, brief), "metadata": {"function": node.name, "namespace": ".".join(parents), "signature": signature}}
                )
            elif hasattr(node, "body"):
                walk(node.body, parents, class_doc)
                walk(getattr(node, "orelse", []), parents, class_doc)

    walk(tree.body, [], "")
    return out


#: Heads of types and functions, by language: (pattern, group of the name, class or function).
_TYPES = r"^[ \t]*(?:(?:public|private|protected|internal|static|abstract|sealed|final|partial|export|default|pub(?:\([^)]*\))?)\s+)*(?:class|interface|struct|enum|record|trait|impl|module)\s+(\w+)"
_CALLS = r"^[ \t]*(?:(?:public|private|protected|internal|static|async|virtual|override|final|export|default|pub(?:\([^)]*\))?)\s+)*(?:function\s+(\w+)|func\s+(?:\([^)]*\)\s*)?(\w+)|fn\s+(\w+)|def\s+(?:self\.)?(\w+)|(?!(?:if|for|while|switch|return|else|new|catch)\b)(?:[\w<>\[\],.*&:?]+\s+)+\*?(\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:throws\s+[\w, ]+)?(?=\{|\n\s*\{)|(\w+)\s*\(\)\s*(?=\{))"
_GO_TYPE = r"^type\s+(\w+)\s+(?:struct|interface)"


def _block_end(source: str, start: int, ruby: bool) -> int:
    """Past the brace that closes the first one after start (or past Ruby's end); strings and comments are skipped."""
    if ruby:
        indent = re.match(r"[ \t]*", source[start:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(source, start)
        return m.end() if m else len(source)
    depth = 0
    for m in re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[{}]|;""", re.S).finditer(source, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif m[0] == ";" and not depth:
            return m.end()
    return len(source)


def _leading_comment(source: str, start: int) -> str:
    lines = []
    for line in reversed(source[:start].rstrip("\n").split("\n")):
        bare = line.strip()
        if not bare.startswith(("//", "#", "*", "/*", "@", "///")) or bare.startswith("#include"):
            break
        if not bare.startswith("@"):
            lines.append(re.sub(r"^[/#*]+!?\s?|\s*\*/$", "", bare))
    return "\n".join(reversed(lines)).strip()


def _brace_chunks(path: str, source: str, language: str, branch: str, small: int) -> list[dict]:
    out: list[dict] = []
    ruby = language == "ruby"
    lead = re.match(r"\s*((?://[^\n]*\n|#(?!include)[^\n]*\n|/\*.*?\*/\s*)+)", source, re.S)
    module = _leading_comment(source[: lead.end()], lead.end()) if lead else ""
    brief = first_sentence(module) if module else ""
    if module and module != brief:
        out.append({"text": f"{_head(path, branch)}\n// {module}", "metadata": {"preamble": "true", "namespace": ""}})
    types = re.compile(_GO_TYPE if language == "go" else _TYPES, re.M)
    calls = re.compile(_CALLS, re.M)

    def walk(start: int, end: int, parents: list[str], class_doc: str) -> None:
        at = start
        while at < end:
            t, f = types.search(source, at, end), calls.search(source, at, end)
            m = min((x for x in (t, f) if x), key=lambda x: x.start(), default=None)
            if m is None:
                return
            stop = min(_block_end(source, m.start(), ruby), end)
            text, doc = source[m.start() : stop].strip("\n"), _leading_comment(source, m.start())
            name = next(filter(None, m.groups()), "")
            if m is t:
                if len(text) // 4 < small:
                    out.append({"text": _enriched(text, path, branch, parents, doc=doc, module_doc=brief), "metadata": {"class": name, "namespace": ".".join(parents)}})
                else:
                    walk(m.end(), stop, [*parents, name], doc)
            else:
                signature = text.strip().split("\n")[0].rstrip("{ ")
                out.append({"text": _enriched(text, path, branch, parents, signature, doc, class_doc, brief), "metadata": {"function": name, "namespace": ".".join(parents), "signature": signature}})
            at = max(stop, m.end())

    walk(0, len(source), [], "")
    return out


def merge_small(chunks: list[dict], least: int = 250) -> list[dict]:
    """Neighbours that are whole types of one namespace are joined if either is short."""
    out: list[dict] = []
    for c in chunks:
        whole = lambda x: "class" in x["metadata"] and "function" not in x["metadata"]
        last = out[-1] if out else None
        if last and whole(c) and whole(last) and c["metadata"].get("namespace", "") == last["metadata"].get("namespace", "") and min(len(c["text"]), len(last["text"])) < least:
            names = ", ".join(filter(None, (last["metadata"].get("class"), c["metadata"].get("class"))))
            out[-1] = {"text": last["text"] + "\n\n" + c["text"], "metadata": {**last["metadata"], "class": names}}
        else:
            out.append(c)
    return out


def code_chunks(path: str, source: str, language: str | None = None, branch: str = "", small: int = 500) -> list[dict]:
    """Chunks of a source file by type and function; the whole file where the language has neither, or can't be read."""
    language = language or detect_language(path) or "unknown"
    found: list[dict] = []
    try:
        if language == "python":
            found = _python_chunks(path, source, branch, small)
        elif language in ("go", "java", "javascript", "typescript", "c_sharp", "c", "cpp", "rust", "ruby", "bash"):
            found = _brace_chunks(path, source, language, branch, small)
    except (SyntaxError, ValueError, RecursionError):
        found = []
    if not found:
        return [{"text": f"{_head(path, branch)}\n{source}", "metadata": {"fallback": "true"}, "language": language}]
    return [c | {"language": language} for c in merge_small(found)]


def chunk_code(files: DataFrame, branch: str = "", small: int = 500) -> DataFrame:
    """files: page_url, path, source. page_url, path, language, chunk_no, text, metadata, chunk_id."""
    schema = pa.schema([("page_url", pa.string()), ("path", pa.string()), ("language", pa.string()), ("chunk_no", pa.int32()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])

    def make(url, path, source):
        for i, c in enumerate(code_chunks(path, source or "", None, branch, small)):
            yield url, path, c["language"], i, c["text"], list(c["metadata"].items())

    rows = _per_row(files, ["page_url", "path", "source"], schema, "page_url string, path string, language string, chunk_no int, text string, metadata map<string,string>", make)
    return rows.withColumn("chunk_id", tx.file_chunk_id(F.col("page_url"), F.col("chunk_no"), F.col("text")))


def embedding_prefix(language: str, namespace: str, name: str, text: str) -> str:
    """What is embedded for a code chunk: language, qualified name and declared names before the text."""
    names = [next(filter(None, m.groups())) for m in re.finditer(tx.DECLARATION, text)]
    head = " — ".join(filter(None, (language, ".".join(filter(None, (namespace, name))), ", ".join(dict.fromkeys(names)))))
    return f"{head}\n{text}" if head else text


def bench_chunk_id(url: str, i: int) -> str:
    return hashlib.sha256(f"{url}::bench::{i}".encode()).hexdigest()[:16]
