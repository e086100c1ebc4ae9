import json
import struct

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import retrieval
from lumenloom.operators.postings import Postings
from lumenloom.operators.store import Store
from lumenloom.plans.engine import QueryEngine, ResearchLoop
from lumenloom.plans.ingest import Providers, ingest_pages, orphans
from lumenloom.plans.settings import Settings
from lumenloom.sources.providers import HashingEmbedder, HashingImageEmbedder, HashingTokenEmbedder, StaticWeb

S = Settings(child_tokens=12, paragraph_tokens=30)
PARAGRAPHS = [f"Part {i} tells of {w}. " + " ".join(f"{w}{j}word" for j in range(22)) + f". It ends with {w} again and {w}end." for i, w in enumerate("solar kafka bread zebra copper".split())]


class CountingEmbedder(HashingEmbedder):
    """Notes every text it is given in a file, since it works in other processes."""

    def __init__(self, path, dims=32):
        super().__init__(dims)
        self.path = path

    def embed(self, texts, mode="document"):
        with open(self.path, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return super().embed(texts, mode)


class CountingTokens(HashingTokenEmbedder):
    def __init__(self, path):
        super().__init__(8)
        self.path = path

    def embed_tokens(self, texts):
        with open(self.path, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return super().embed_tokens(texts)


class NamingLlm:
    """The first word with a capital letter after `Part` is an entity."""

    def generate(self, prompt, system=""):
        import re

        return json.dumps([{"name": w, "definition": f"the {w}"} for w in re.findall(r"tells of (\w+)", prompt)])


def png(width=200, height=150):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\0" * 5


def page(paragraphs, image=""):
    return "<html><head><title>T</title></head><body>" + image.join(f"<p>{p}</p>" for p in paragraphs) + "</body></html>"


def lines(path):
    return [json.loads(x) for x in open(path)] if path.exists() else []


def frame(spark, pages):
    return spark.createDataFrame(list(pages.items()), "url string, html string")


def test_changes_reach_every_table(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=3)
    vectors, tokens = tmp_path / "vectors", tmp_path / "tokens"
    index = Postings(spark, f"{tmp_path}/postings", buckets=4)
    p = Providers(CountingEmbedder(str(vectors)), code_embedder=HashingEmbedder(16), tokens=CountingTokens(str(tokens)), llm=NamingLlm(), image_embedder=HashingImageEmbedder(24), download=lambda url: png(), postings=index, memo=True)
    image = "<img src='https://w.org/i.png' alt='a chart of things' width='300' height='200'>"
    pages = {"https://w.org/a": page(PARAGRAPHS, image), "https://w.org/b": page(["A page of its own about otters and rivers. " + " ".join(f"otter{j}" for j in range(20)) + "."])}
    ingest_pages(store, frame(spark, pages), p.embedder, S, providers=p)
    chunks = {r.chunk_id: r.text for r in store.read("chunks").collect()}
    assert len(chunks) > 8 and set(orphans(store).first()) == {0}
    assert {r.chunk_id for r in store.read("chunk_token_embeddings").collect()} == set(chunks)
    assert {r.canonical_name for r in store.read("entities").collect()} == {"solar", "kafka", "bread", "zebra", "copper"}
    row = store.read("images").first()
    assert row.width == 200 and len(row.embedding) == 24 and len(row.nearest_chunk_ids) >= 1
    assert sorted(lines(tokens)) == sorted(chunks.values())

    # The page shrinks to its first paragraph: nothing is left of the others, and nothing is encoded again.
    n_vectors, n_tokens = len(lines(vectors)), len(lines(tokens))
    ingest_pages(store, frame(spark, pages | {"https://w.org/a": page(PARAGRAPHS[:1])}), p.embedder, S, providers=p)
    left = {r.chunk_id: r.text for r in store.read("chunks").collect()}
    assert len(left) < len(chunks) and set(orphans(store).first()) == {0}
    assert {r.chunk_id for r in store.read("chunk_token_embeddings").collect()} == set(left)
    assert [r.canonical_name for r in store.read("entities").collect()] == ["solar"]
    assert store.read("images").count() == 0
    again = [t for t in lines(tokens)[n_tokens:]]
    assert set(again) <= {t for i, t in left.items() if chunks.get(i) != t}
    assert not set(lines(vectors)[n_vectors:]) & set(chunks.values())

    # The stored index and the engine see the same.
    engine = QueryEngine(spark, store, HashingEmbedder(32), settings=S, postings=index, code_embedder=HashingEmbedder(16), image_embedder=HashingImageEmbedder(24), tokens=HashingTokenEmbedder(8))
    counted = retrieval.query_tokens(spark, "solar otters")
    a, b = ({(r.chunk_id, round(r.raw, 6)) for r in df.collect()} for df in (index.search(counted, 9), retrieval.bm25(engine.index(), counted, limit=9)))
    assert a == b and len(a) > 1
    assert engine.retrieve("solar otters", 3).count() == 3


def test_equal_texts_are_encoded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    p = Providers(CountingEmbedder(str(calls)), memo=True)
    store = Store(spark, f"{tmp_path}/s", buckets=3)
    pages = {"https://w.org/a": page(PARAGRAPHS[:3])}
    ingest_pages(store, frame(spark, pages), p.embedder, S, providers=p)
    first = {r.chunk_id: r.embedding for r in store.read("chunks").collect()}
    n = len(lines(calls))
    assert n == len(set(lines(calls))) > 0
    store.write("pages", store.read("pages").withColumn("content_hash", F.lit("other")))  # all are done anew
    assert ingest_pages(store, frame(spark, pages), p.embedder, S, providers=p).first().change == "updated"
    assert len(lines(calls)) == n and {r.chunk_id: r.embedding for r in store.read("chunks").collect()} == first


def test_a_redirect_to_a_private_address_is_not_stored(spark, tmp_path):
    text = page(["Words enough to be kept as a page, about nothing in particular, but long enough."])

    class Web(StaticWeb):
        def fetch(self, url):
            return (text, "http://10.0.0.5/admin" if url.endswith("/trap") else url)

    results = {"q": [{"title": "t", "url": f"https://w.org/{x}", "snippet": ""} for x in ("fine", "trap")]}
    store = Store(spark, f"{tmp_path}/s", buckets=3)
    loop = ResearchLoop(spark, store, type("L", (), {"generate": lambda self, p, system="": '["q"]'})(), Web({}, results), Web({}, results), HashingEmbedder(16), lambda h: ["93.184.216.34"] if h == "w.org" else [h])
    loop.run("x", 1)
    assert [r.url for r in store.read("pages").collect()] == ["https://w.org/fine"]


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=32)
    rows = spark.range(500).select(F.concat(F.lit("https://w.org/"), "id").alias("url"), F.lit("T").alias("title"))
    store.upsert("pages", rows)
    before = store._version("pages")["at"]
    touched = store.merge("pages", rows.filter("url in ('https://w.org/1', 'https://w.org/2')").withColumn("title", F.lit("new")).unionByName(spark.createDataFrame([("https://x.org/", "added")], "url string, title string")))
    after = store._version("pages")["at"]
    assert len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    got = {r.url: r.title for r in store.read("pages").collect()}
    assert len(got) == 501 and got["https://w.org/1"] == "new" and got["https://w.org/3"] == "T"
    store.merge("pages", gone=rows.select("url"))
    assert [r.url for r in store.read("pages").collect()] == ["https://x.org/"]
    assert store.vacuum("pages") >= 2 and store.read("pages").count() == 1


def test_a_stop_between_writes(spark, tmp_path, monkeypatch):
    """Whichever write stops, a second run completes the tables."""
    pages = {"https://w.org/a": page(PARAGRAPHS[:2])}
    p = Providers(HashingEmbedder(16), tokens=HashingTokenEmbedder(8), llm=NamingLlm())
    whole = Store(spark, f"{tmp_path}/whole", buckets=2)
    ingest_pages(whole, frame(spark, pages), p.embedder, S, providers=p)
    want = {n: sorted(r[0] for r in whole.read(n).select(c).collect()) for n, c in (("chunks", "chunk_id"), ("chunk_token_embeddings", "chunk_id"), ("chunk_entities", "entity_id"), ("pages", "url"))}
    for stops in ("chunk_entities",):
        store = Store(spark, f"{tmp_path}/{stops}", buckets=2)
        point = Store._point
        monkeypatch.setattr(Store, "_point", lambda self, name, *a: (_ for _ in ()).throw(RuntimeError("stopped")) if name == stops else point(self, name, *a))  # noqa: B023
        with pytest.raises(RuntimeError):
            ingest_pages(store, frame(spark, pages), p.embedder, S, providers=p)
        monkeypatch.undo()
        ingest_pages(store, frame(spark, pages), p.embedder, S, providers=p)
        assert {n: sorted(r[0] for r in store.read(n).select(c).collect()) for n, c in (("chunks", "chunk_id"), ("chunk_token_embeddings", "chunk_id"), ("chunk_entities", "entity_id"), ("pages", "url"))} == want
        assert set(orphans(store).first()) == {0}
