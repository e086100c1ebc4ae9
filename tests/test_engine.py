import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lumenloom.__main__ import main
from lumenloom.operators.store import Store
from lumenloom.plans.engine import QueryEngine, ResearchLoop, ingest_pages, refresh_graph
from lumenloom.plans.settings import Settings
from lumenloom.sources import connectors as cn
from lumenloom.sources import files
from lumenloom.sources.providers import HashingEmbedder, OverlapReranker, ScriptedLlm, StaticWeb
from lumenloom.streaming import ingest as streaming

EMB = HashingEmbedder(32)
PAGES = {
    f"https://w.org/{i}": f"<html><head><title>Page {i}</title></head><body><p>{words} {' '.join(f'filler{i}x{j}' for j in range(20))}.</p><a href='https://w.org/{(i + 1) % 3}'>next</a></body></html>"
    for i, words in enumerate(["solar panels turn light into power", "kafka brokers replicate partition logs", "bakers knead dough before proofing bread"])
}


def test_ingest_query_and_change(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    pages = spark.createDataFrame(list(PAGES.items()), "url string, html string")
    s = Settings(child_tokens=12)
    assert {r.change for r in ingest_pages(store, pages, EMB, s).collect()} == {"new"}
    assert {r.change for r in ingest_pages(store, pages, EMB, s).collect()} == {"unchanged"}
    refresh_graph(store, s)
    assert {tuple(map(abs, r.graph_embedding)) for r in store.read("pages").collect()} == {(1.0,)}
    engine = QueryEngine(spark, store, EMB, OverlapReranker(), ScriptedLlm(default="an answer"), settings=s)
    got = engine.ask("how do kafka brokers replicate logs, and why", now="2030-01-01 00:00:00")
    assert got["answer"] == "an answer" and got["complexity"] == "complex" and "kafka" in got["context"].split("---")[0]
    first = engine.retrieve("kafka brokers", 3).first()
    assert first.page_url == "https://w.org/1" and first.rerank_score is not None
    assert engine.list_sources().count() == 3


def test_unmigrated_chunks_are_refused(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("chunks", spark.createDataFrame([("1", "u", "text", [1.0], 0)], "chunk_id string, page_url string, text string, embedding array<float>, embedding_version int"))
    with pytest.raises(ValueError, match="older version"):
        QueryEngine(spark, store, EMB).index()


def test_research_loop_stops(spark, tmp_path):
    web = StaticWeb(PAGES, {"q": [{"title": "t", "url": u, "snippet": ""} for u in PAGES] + [{"title": "bad", "url": "http://10.0.0.1/", "snippet": ""}]})
    store = Store(spark, f"file://{tmp_path}/s")
    loop = ResearchLoop(spark, store, ScriptedLlm(default='["q"]'), web, web, EMB, lambda h: ["93.184.216.34"] if h == "w.org" else [h])
    assert loop.run("power", 3) == {"stopped": "low_novelty", "pages": 3}
    assert ResearchLoop(spark, store, ScriptedLlm(default="[]"), web, web, EMB, lambda h: []).run("x")["stopped"] == "llm_returned_empty"


def test_command_line(spark, tmp_path, capsys):
    folder = f"file://{tmp_path}/s"
    spark.createDataFrame(list(PAGES.items()), "url string, html string").write.parquet(f"file://{tmp_path}/pages")
    assert main(["--store", folder, "ingest", f"file://{tmp_path}/pages"], spark) == 0
    assert main(["--store", folder, "status"], spark) == 0
    assert main(["--store", folder, "query", "kafka brokers"], spark) == 0
    out = capsys.readouterr().out
    assert "new" in out and "kafka" in out


def test_streaming(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", "<p>x", "x"), ("b", "<p>y", "y")], "url string, html string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        streaming.detect_changes(stream, store, f"{tmp_path}/ck").awaitTermination()
    assert store.read("pages").count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    assert streaming.activity(events).first().total == 3.0
    assert streaming.first_of_text(spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")).isStreaming


def test_files(spark, tmp_path):
    for path, text in {"a.py": "def f():\n    return 1\n", "docs/r.md": "Hello world", "node_modules/x.js": "no", "b.bin": "no", "Dockerfile": "FROM x"}.items():
        os.makedirs(tmp_path / "r" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "r" / path).write_text(text)
    found = files.discover(spark, str(tmp_path / "r"))
    assert sorted(r.path for r in found.collect()) == ["Dockerfile", "a.py", "docs/r.md"]
    rows = {r.page_url: r.content_type for r in files.index_files(found, F.lit("repo://o/n")).collect()}
    assert rows == {"repo://o/n/a.py": "code", "repo://o/n/docs/r.md": "text", "repo://o/n/Dockerfile": "code"}
    (tmp_path / "e.json").write_text(json.dumps({"queries": [{"query": "q", "relevant_chunk_ids": ["1"]}]}))
    row = files.eval_set(spark, str(tmp_path / "e.json")).first()
    assert row.relevant_chunk_ids == ["1"] and row.modality_labels == {} and row.reference_answer is None
    (tmp_path / "bad.json").write_text('"x"')
    with pytest.raises(Exception, match="evaluation set"):
        files.eval_set(spark, str(tmp_path / "bad.json")).collect()
    report = spark.createDataFrame([("c", float("nan"))], "config_name string, v double")
    files.save_report(report, str(tmp_path / "rep"))
    assert spark.read.schema("config_name string, v double").json(str(tmp_path / "rep")).first().v is None


def test_connectors():
    pages = {"https://b/rest/api/space?start=0&limit=2": json.dumps({"results": [{"key": "A"}, {"key": "B"}]}), "https://b/rest/api/space?start=2&limit=2": json.dumps({"results": [{"key": "C"}]})}
    assert list(cn.wiki_spaces(StaticWeb(pages), "https://b", size=2)) == ["A", "B", "C"]
    html = cn.wiki_page_html({"title": "T & x", "ancestors": [{"title": "Up"}], "body": {"storage": {"value": "<p>b</p>"}}})
    assert "<h1>T &amp; x</h1><p>b</p>" in html and "<nav>Up</nav>" in html
    creds = [{"domain": "*.x.org", "type": "bearer", "token": "t"}, {"domain": "a.x.org", "type": "basic", "username": "u", "password": "p"}]
    assert cn.match_credentials("https://a.x.org/", creds)["type"] == "basic" and cn.match_credentials("https://b.x.org/", creds)["type"] == "bearer"
    assert cn.auth_headers(creds[1]) == {"Authorization": "Basic dTpw"} and cn.auth_headers(None) == {}
    assert cn.clone_url("github.com", "o", "n", {"token": "a/b"}) == "https://x-access-token:a%2Fb@github.com/o/n.git"
    calls = []
    cn.clone("u", "d", "main", lambda *a, **k: calls.append(a[0]))
    assert calls[0][-2:] == ["u", "d"] and "--single-branch" in calls[0]
    with pytest.raises(ValueError, match="branch"):
        cn.clone("u", "d", "--upload-pack=x", subprocess.run)
    now, waits = [0.0], []
    limit = cn.RateLimit(clock=lambda: now[0], sleep=waits.append)
    limit("https://a/1")
    limit("https://b/1")
    limit("https://a/2")
    assert len(waits) == 1 and 1 <= waits[0] <= 3
    assert cn.ocr_text([(5, 9, "b", 0.9), (1, 9, "a", 0.8), (0, 1, "top", 0.6), (0, 0, "no", 0.5)]) == "top a b"


def test_benchmark_runner(spark, tmp_path):
    from lumenloom.operators import evaluation
    from lumenloom.plans.benchmark import BenchmarkRunner

    docs = spark.createDataFrame([("a.html", "u/a", "html", "<h1>Solar</h1><p>solar panels turn light into power</p>"), ("b.py", "u/b", "code", "def proof():\n    return 'dough'\n"), ("c.txt", "u/c", "text", "kafka brokers replicate logs")], "path string, url string, type string, text string")
    queries = [{"query": "solar panels", "expected_passages": ["panels turn light into power"], "source_doc": "a.html", "difficulty": "easy"}]
    configs = [{"config_name": "auto/x", "chunk_mode": "auto", "weights": {"bm25": 2.0}}, {"config_name": "paragraph/x", "chunk_mode": "paragraph"}, {"config_name": "broken"}]
    details, errors = BenchmarkRunner(spark, f"file://{tmp_path}", EMB).run(docs, queries, configs, 3)
    assert {r.config_name: r.overlap for r in details.collect()} == {"auto/x": 1.0, "paragraph/x": 1.0}
    assert [r.config_name for r in errors.collect()] == ["broken"]
    assert evaluation.roll_up(details).count() == 2 and evaluation.breakdown(details).count() == 3


def test_generation(spark):
    import math

    from lumenloom.plans import generation as g

    chunks = spark.createDataFrame([("1", "the GIL blocks threads", "doc"), ("2", "lock", "doc")], "chunk_id string, text string, document string")
    llm = ScriptedLlm([("sentence", " about locks "), ("GIL", 'x [{"name": "GIL", "definition": "a lock"}, {"name": " "}] y')], "not json")
    assert {r.context_summary for r in g.summaries(chunks, llm).collect()} == {"about locks"}
    mentions = g.extract_entities(chunks, llm)
    assert [tuple(r) for r in mentions.collect()] == [("1", "GIL", "a lock")]
    entities, links = g.link_entities(mentions, EMB)
    assert entities.first().canonical_name == "GIL" and links.count() == 1
    more = spark.createDataFrame([("2", "the GIL", "d2"), ("3", "borrow checker", "d3")], "chunk_id string, name string, definition string")
    again, more_links = g.link_entities(more, EMB, 0.3, entities)
    rows = {r.canonical_name: (r.definition, r.aliases) for r in again.collect()}
    assert rows == {"GIL": ("a lock", ["the GIL"]), "borrow checker": ("d3", [])} and more_links.count() == 2
    assert g.score_answer(ScriptedLlm(default='{"relevance": 2, "groundedness": 0.5, "completeness": 0}'), "q", "a", "c") == (1.0, 0.5, 0.0)
    assert all(map(math.isnan, g.score_answer(ScriptedLlm(default="?"), "q", "a", "c")))


def test_image_headers():
    import struct

    from lumenloom.sources import images

    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 120, 300)
    assert images.dimensions(png) == (120, 300) and images.accepted(png) and not images.accepted(png, least_side=200)
    assert images.dimensions(b"GIF89a" + struct.pack("<HH", 10, 20)) == (10, 20) and images.dimensions(b"junk") is None
    assert images.dimensions(b"\xff\xd8\xff\xc0\0\x11\x08\0\x40\0\x80\x03" + b"\0" * 9) == (128, 64)
    w, h = images.scaled(10_000, 10_000)
    assert w * h <= 25_000_000 and images.scaled(10, 10) == (10, 10)
