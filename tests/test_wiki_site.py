import io
import json
import struct
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenloom import __main__ as cli
from lumenloom.operators.store import Store
from lumenloom.plans import engine, wiki
from lumenloom.plans.engine import ingest_pages
from lumenloom.plans.settings import Settings
from lumenloom.sources import connectors as cn
from lumenloom.sources import files
from lumenloom.sources.providers import HashingEmbedder, HashingImageEmbedder, ScriptedLlm, StaticWeb, embed_images, fetch_images

EMB = HashingEmbedder(16)


def body(words, *links):
    text = " ".join(f"{words}{i}" for i in range(60))
    return f"<html><head><title>{words}</title></head><body><h1>{words}</h1><p>{text}.</p>{''.join(f'<a href={chr(34)}{x}{chr(34)}>x</a>' for x in links)}</body></html>"


SITE = {
    "https://w.org/": body("root", "/a#top", "/b", "https://github.com/o/n/tree/main", "https://else.org/", "http://10.0.0.1/"),
    "https://w.org/a": body("alpha", "/", "/b", "/c"),
    "https://w.org/b": body("beta", "/missing", "/away"),
    "https://w.org/c": "<html><body><script>" + "x" * 6000 + "</script></body></html>",
    "https://w.org/away": body("away"),
}


class Web(StaticWeb):
    def fetch(self, url):
        got = super().fetch(url)
        return (got[0], "https://else.org/") if got and url.endswith("/away") else got


def resolver(host):
    return ["93.184.216.34"] if not host[0].isdigit() else [host]


def test_crawl(spark):
    browser = StaticWeb({"https://w.org/c": body("gamma", "/a")})
    pages, met = wiki.crawl(spark, "HTTPS://W.org/", Web(SITE), resolver, browser)
    got = {r.url: (r.depth, r.outcome) for r in met.collect()}
    assert got["https://w.org/"] == (0, "fetched") and got["https://w.org/c"] == (2, "fetched") and got["https://w.org/b"] == (1, "fetched")
    assert got["https://w.org/missing"][1] == "failed" and got["https://w.org/away"][1] == "redirected away"
    assert got["https://github.com/o/n/tree/main"][1] == "repository" and got["https://else.org/"][1] == "external"
    assert "gamma" in {r.url: r.html for r in pages.collect()}["https://w.org/c"]
    row = wiki.counters(met).first()
    assert row.discovered == len(got) and row.fetched == 4 and row.failed == 1


def test_site_is_stored_and_gone_pages_are_stale(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    wiki.ingest_wiki(store, "https://w.org/", Web(SITE), EMB, resolver, Settings(min_content_chars=20, power_iterations=2))
    left = {u: h for u, h in SITE.items() if not u.endswith("/b")}
    wiki.ingest_wiki(store, "https://w.org/", Web(left), EMB, resolver, Settings(min_content_chars=20, power_iterations=2))
    assert {r.url: r.crawl_status for r in store.read("pages").collect()} == {"https://w.org/": "active", "https://w.org/a": "active", "https://w.org/b": "stale"}
    assert store.read("chunks").filter("page_url = 'https://w.org/b'").count() > 0


def test_a_stopped_ingestion_loses_nothing(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(u, h) for u, h in SITE.items() if u.endswith(("/a", "/b"))], "url string, html string")
    whole = Store(spark, f"file://{tmp_path}/whole")
    ingest_pages(whole, pages, EMB)
    want = sorted(r.chunk_id for r in whole.read("chunks").collect())
    for table in ("chunks", "pages"):
        store = Store(spark, f"file://{tmp_path}/{table}")
        write = store.write

        def broken(name, rows, table=table, write=write):
            if name == table:
                raise OSError("stopped")
            write(name, rows)

        monkeypatch.setattr(store, "write", broken)
        with pytest.raises(OSError):
            ingest_pages(store, pages, EMB)
        monkeypatch.undo()
        again = Store(spark, f"file://{tmp_path}/{table}")
        ingest_pages(again, pages, EMB)
        assert sorted(r.chunk_id for r in again.read("chunks").collect()) == want and again.read("pages").count() == pages.count()


def test_duplicates_are_found_across_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    page = lambda u, w: spark.createDataFrame([(u, body(w))], "url string, html string")
    ingest_pages(store, page("https://x.org/1", "first"), EMB)
    one = store.read("chunks").count()
    ingest_pages(store, page("https://y.org/2", "first"), EMB)
    assert store.read("chunks").count() == one
    assert store.read("chunks").agg(F.max("corroboration_strength")).first()[0] > 0


def test_pointer_and_appends(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(3):
        store.log_search(f"q{i}", i)
    assert sorted((r.id, r.query) for r in store.read("searches").collect()) == [(1, "q0"), (2, "q1"), (3, "q2")]
    assert len([p for p in (tmp_path / "s" / "searches").iterdir() if p.is_dir()]) == 1
    store.write("searches", store.read("searches").filter("id = 1"))
    assert store.read("searches").count() == 1 and not [p for p in (tmp_path / "s" / "searches").iterdir() if p.name.startswith("CURRENT.")]


def provider_set():
    web = Web(SITE, {"q": [{"title": "t", "url": u, "snippet": ""} for u in SITE]})
    return {"embedder": EMB, "llm": ScriptedLlm(default='["q"]'), "search": web, "fetcher": web, "resolver": resolver}


def test_commands(spark, tmp_path, capsys, monkeypatch):
    for module in (engine, wiki):  # many rounds
        monkeypatch.setattr(module, "refresh_graph", lambda *a: None)
    at = ["--store", f"file://{tmp_path}/s", "--providers", "tests.test_wiki_site:provider_set", "--log", f"{tmp_path}/log"]
    assert cli.main([*at, "research", "root", "--max-depth", "1"], spark) == 0
    assert cli.main([*at, "--json", "wiki", "https://w.org/", "--max-depth", "2"], spark) == 0
    out = capsys.readouterr().out.strip().split("\n")
    assert json.loads(out[0])["pages"] >= 3 and json.loads(out[-1])["fetched"] >= 3
    assert "new pages" in (tmp_path / "log").read_text()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("solar panels turn light into power")
    truth = {"documents": [{"path": "a.txt", "url": "u/a", "type": "text", "language": ""}], "queries": [{"query": "solar panels", "expected_passages": ["panels turn light into power"], "source_doc": "a.txt", "expected_content_types": [], "difficulty": "easy"}]}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    name = cli.evaluation.benchmark_matrix()[0]["config_name"]
    assert cli.main([*at, "--json", "benchmark", f"{tmp_path}/truth.json", f"{tmp_path}/docs", "--config", name], spark) == 0
    assert json.loads(capsys.readouterr().out.strip())["text_overlap"] == 1.0
    with pytest.raises(SystemExit, match="fetcher"):
        cli.main(["--store", f"file://{tmp_path}/s", "wiki", "https://w.org/"], spark)


def test_repository_archives_and_wikis(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("o-n-abc/README.md", "hello")
        z.writestr("o-n-abc/src/a.py", "x = 1")
    fail = lambda *a, **k: (_ for _ in ()).throw(subprocess.CalledProcessError(1, "git"))
    seen = []
    assert cn.fetch_repository(lambda u: seen.append(u) or data.getvalue(), "github.com", "o", "n", str(tmp_path / "r"), run=fail) == "archive"
    assert (tmp_path / "r" / "src" / "a.py").read_text() == "x = 1" and seen == ["https://api.github.com/repos/o/n/zipball/HEAD"]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("o/../../evil", "x")
    with pytest.raises(ValueError, match="leaves"):
        cn.unpack_zip(bad.getvalue(), str(tmp_path / "r2"))
    calls = []
    assert cn.clone_wiki("github.com", "o", "n", "d", run=lambda *a, **k: calls.append(a[0])) and calls[0][-2] == "https://github.com/o/n.wiki.git"
    assert not cn.clone_wiki("github.com", "o", "n", "d", run=fail)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "Home.md").write_text("Welcome to the wiki")
    (tmp_path / "w" / "x.png").write_bytes(b"\x89PNG")
    rows = files.wiki_pages(spark, str(tmp_path / "w"), F.lit("https://github.com/o/n")).collect()
    assert [(r.page_url, r.text) for r in rows] == [("https://github.com/o/n/wiki/Home", "Welcome to the wiki")]


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 120, 300)
    images = spark.createDataFrame([("i1", "https://a/1.png"), ("i2", "https://a/2.png")], "image_id string, src_url string")
    got = embed_images(fetch_images(images, lambda u: png if "1" in u else None, F.lit("a")), HashingImageEmbedder(8)).collect()
    assert [(r.image_id, r.width, r.height, len(r.embedding)) for r in got] == [("i1", 120, 300, 8)]


def test_report_text(spark):
    rolled = spark.createDataFrame([("a", 3, 0.5, 1.0, 1.0, 9.0, 9.0, 9.0), ("b", 3, 0.7, 1.0, 1.0, 12.0, 12.0, 12.0)], "config_name string, chunks int, text_overlap double, ingest_s double, ms_per_chunk double, p50 double, p95 double, p99 double")
    text = files.format_report(rolled, spark.createDataFrame([("c", "no")], "config_name string, error string"))
    assert "best overlap: b" in text and "fastest: a" in text and "failed: c (no)" in text


def test_log_file(tmp_path):
    engine.log_to(str(tmp_path / "l"))("one")
    assert (tmp_path / "l").read_text().endswith(" one\n")
