"""Registered queries over single functions, on inputs built from the tables' columns. Their SQL states results from the parts that
inputs are built of, or from plain rules, not with the functions' patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as tx
from .functions import urls
from .functions import vectors as vx
from .functions.numbers import rounded
from .operators import store
from .queryset import T, query


def _name(column: str = "p_name"):
    """A table's text as one word of letters."""
    return F.regexp_replace(column, "[^a-zA-Z]+", "")


@query(
    """WITH p AS (SELECT p_partkey AS k, regexp_replace(p_name, '[^a-zA-Z]+', '', 'g') AS n FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN ['C' || n || k] WHEN 1 THEN ['T' || n] WHEN 2 THEN ['f_' || k] WHEN 3 THEN ['M' || k, 'N' || k] ELSE [] END AS names FROM p"""
)
def code_identifiers(spark, d):
    p = T(spark, d, "part")
    n, k, by = _name(), F.col("p_partkey"), F.col("p_partkey") % 5
    code = (
        F.when(by == 0, F.concat(F.lit("public class C"), n, k, F.lit(" {\n}\n")))
        .when(by == 1, F.concat(F.lit("type T"), n, F.lit(" struct {\n}\n")))
        .when(by == 2, F.concat(F.lit("def f_"), k, F.lit("(x):\n    return x\n")))
        .when(by == 3, F.concat(F.lit("func M"), k, F.lit("() {}\nfn N"), k, F.lit("() {}\n")))
        .otherwise(F.concat(F.lit("plain words on "), n))
    )
    return p.select(k.alias("k"), tx.code_identifiers(code).alias("names"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN NOT c_custkey % 40 BETWEEN 16 AND 31 WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN false ELSE true END AS safe FROM customer"""
)
def safe_url_static(spark, d):
    k = F.col("c_custkey")
    url = (
        F.when(k % 8 == 0, F.concat(F.lit("https://h"), k, F.lit(".example.org/a")))
        .when(k % 8 == 1, F.concat(F.lit("ftp://h"), k, F.lit(".example.org/")))
        .when(k % 8 == 2, F.concat(F.lit("http://10."), k % 200, F.lit(".0.1/x")))
        .when(k % 8 == 3, F.concat(F.lit("http://172."), k % 40, F.lit(".0.1:8080/")))
        .when(k % 8 == 4, F.concat(F.lit("http://user@192.168."), k % 200, F.lit(".7/")))
        .when(k % 8 == 5, F.lit("HTTP://LocalHost/"))
        .when(k % 8 == 6, F.concat(F.lit("no scheme "), k))
        .otherwise(F.concat(F.lit("http://11."), k % 200, F.lit(".0.1/")))
    )
    return T(spark, d, "customer").select(k.alias("k"), F.coalesce(urls.is_safe_static(url), F.lit(False)).alias("safe"))


_REPO = """c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS o, 'r' || c_custkey AS n FROM customer)"""


@query(
    f"""WITH {_REPO} SELECT k, CASE WHEN k % 4 < 3 THEN CASE WHEN k % 2 = 0 THEN 'github' ELSE 'bitbucket' END END AS platform, CASE WHEN k % 4 < 3 THEN o END AS owner, CASE WHEN k % 4 < 3 THEN n END AS name,
CASE WHEN k % 4 < 3 THEN CASE WHEN k % 2 = 0 THEN 'github.com' ELSE 'bitbucket.org' END || '/' || o || '/' || n || CASE WHEN k % 4 = 0 THEN '.git' ELSE '' END || '/' END AS prefix FROM c"""
)
def repository_parts(spark, d):
    k, owner = F.col("c_custkey"), F.lower("c_mktsegment")
    host = F.when(k % 2 == 0, "GitHub.com").otherwise("bitbucket.org")
    tail = F.when(k % 4 == 0, ".git").when(k % 4 == 1, "").otherwise("/tree/main")
    url = F.when(k % 4 < 3, F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/r"), k, tail)).otherwise(F.concat(F.lit("https://"), host, F.lit("/"), owner))
    parts = urls.repository_parts(url)
    return T(spark, d, "customer").select(k.alias("k"), F.replace(F.replace(parts["platform"], F.lit(".com"), F.lit("")), F.lit(".org"), F.lit("")).alias("platform"), parts["owner"].alias("owner"), parts["name"].alias("name"), urls.repository_prefix(url).alias("prefix"))


@query(f"WITH {_REPO} SELECT k, CASE k % 3 WHEN 0 THEN o || k WHEN 1 THEN o || k END AS workspace, CASE WHEN k % 2 = 0 THEN 'S' || k END AS space, k % 2 = 0 AS confluence, k % 5 <> 0 AS branch FROM c")
def wiki_and_workspace(spark, d):
    k, o = F.col("c_custkey"), F.lower("c_mktsegment")
    work = F.concat(F.lit("https://bitbucket.org/"), o, k, F.when(k % 3 == 0, "").when(k % 3 == 1, "/workspace/projects").otherwise("/name/src"))
    wiki = F.concat(F.lit("https://x"), k, F.when(k % 2 == 0, ".atlassian.net/wiki/spaces/S").otherwise(".example.org/wiki/spaces/S"), k, F.lit("/pages/1"))
    space = F.when(urls.is_confluence(wiki), urls.confluence_space(wiki))
    branch = F.concat(F.lit("feature/a-"), k, F.when(k % 5 == 0, " ; rm").otherwise(".x"))
    return T(spark, d, "customer").select(k.alias("k"), urls.workspace(work).alias("workspace"), space.alias("space"), urls.is_confluence(wiki).alias("confluence"), urls.valid_branch(branch).alias("branch"))


@query("SELECT p_partkey AS k, 'https://i/' || CASE WHEN p_size >= 25 THEN 'a' ELSE 'b' END || p_partkey || '.png' AS source FROM part")
def widest_source(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    entry = lambda letter, width: F.concat(F.lit(f"https://i/{letter}"), k, F.lit(".png "), width, F.lit("w"))
    return T(spark, d, "part").select(k.alias("k"), urls.widest_source(F.concat_ws(", ", entry("a", n), entry("b", 50 - n))).alias("source"))


@query("SELECT p_partkey AS k, ['image/png', 'image/jpeg', 'image/webp', 'image/gif', 'image/png'][(p_partkey % 5 + 1)::INT] AS kind FROM part")
def media_types(spark, d):
    k = F.col("p_partkey")
    heads = F.array(*[F.lit(h) for h in ("89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "524946460000000057454250", "474946383961010001000000", "00000000")])
    data = F.concat(F.unhex(F.get(heads, (k % 5).cast("int"))), F.encode(F.col("p_name"), "utf-8"))
    return T(spark, d, "part").select(k.alias("k"), tx.media_type(data).alias("kind"))


@query(
    "SELECT doc_id, 'c' || doc_id || '::child:' || length(lang) AS child, substr(sha256(source || '::bench::' || doc_id), 1, 16) AS bench, substr(sha256(source), 1, 16) AS image, sha256(coalesce(text, '')) AS hash FROM documents"
)
def more_ids(spark, d):
    i, s = F.col("doc_id"), F.col("source")
    return T(spark, d, "documents").select("doc_id", tx.child_chunk_id(F.concat(F.lit("c"), i), F.length("lang")).alias("child"), tx.bench_chunk_id(s, i).alias("bench"), tx.image_id(s).alias("image"), tx.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query(
    r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z][a-zA-Z0-9_-]*'))::INT AS tokens, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::INT AS words, length(coalesce(text, '')) // 4 AS estimate FROM documents"
)
def text_counts(spark, d):
    t = F.coalesce("text", F.lit(""))
    return T(spark, d, "documents").select("doc_id", tx.token_count(t).cast("int").alias("tokens"), tx.word_count(t).cast("int").alias("words"), tx.estimated_tokens(t).cast("long").alias("estimate"))


@query(
    """WITH p AS (SELECT p_partkey AS k, lower(regexp_replace(p_name, '[^a-zA-Z]+', '', 'g')) AS n FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN ['get', n, 'http'] WHEN 1 THEN [n, k::VARCHAR] WHEN 2 THEN ['xml', 'parser', n] ELSE [n, 'id'] END AS parts FROM p"""
)
def sub_tokens(spark, d):
    k, low = F.col("p_partkey"), F.lower(_name())
    title = F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 1000))
    token = F.when(k % 4 == 0, F.concat(F.lit("get"), title, F.lit("HTTP"))).when(k % 4 == 1, F.concat(low, F.lit("_"), k)).when(k % 4 == 2, F.concat(F.lit("XMLParser"), title)).otherwise(F.concat(low, F.lit("-id")))
    return T(spark, d, "part").select(k.alias("k"), tx.sub_tokens(token).alias("parts"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE value END AS value FROM events")
def finite_values(spark, d):
    value = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "click", float("-inf")).otherwise(F.col("value"))
    return T(spark, d, "events").select("event_id", tx.finite(value).alias("value"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(e[:16], e[:16])), 6) AS length, list_transform(e[:16], lambda x: round(x / sqrt(list_dot_product(e[:16], e[:16])), 6)) AS head FROM v")
def truncated_vectors(spark, d):
    e = F.col("embedding")
    return T(spark, d, "embeddings").select("vec_id", rounded(vx.norm(F.slice(e, 1, 16)), 6).alias("length"), F.transform(vx.truncate(e, 16), lambda x: rounded(x, 6)).alias("head"))


@query("SELECT source AS url, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, count(*) AS versions FROM documents GROUP BY source")
def last_version(spark, d):
    docs = T(spark, d, "documents").select(F.col("source").alias("url"), "doc_id", "lang")
    return store.last_wins(docs, ["url"], F.col("doc_id")).join(docs.groupBy("url").agg(F.count("*").alias("versions")), "url").select("url", "doc_id", "lang", "versions")


@query("SELECT c_name AS url, c_mktsegment AS title, NULL::VARCHAR AS content_hash, 'active' AS crawl_status, 0.0::DOUBLE AS authority_score FROM customer")
def migrated_table(spark, d):
    """A table of an older schema gets the columns that it lacks, with their defaults."""
    old = T(spark, d, "customer").select(F.col("c_name").alias("url"), F.col("c_mktsegment").alias("title"))
    return store.migrate(old, "pages").select("url", "title", "content_hash", F.coalesce("crawl_status", F.lit("active")).alias("crawl_status"), F.coalesce("authority_score", F.lit(0.0)).alias("authority_score"))
