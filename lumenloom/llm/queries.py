"""The registered queries of this subpackage, and the SQL that gives their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, fingerprint, html_extract, infill, language, line_dedup, mixing, near_dup, packing, prefix_trie, toxicity, url_filter, warc
from .common import table

#: Path rules of op10: verdict, host, path.
PATH_RULES = (
    url_filter.PathRule("allow", "com"),
    url_filter.PathRule("block", "example.com", "/en/"),
    url_filter.PathRule("allow", "www.example.com", "/en/"),
    url_filter.PathRule("block", "net", "/es/"),
    url_filter.PathRule("block", "net", "/fr/"),
)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"))


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op3_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.judge(table(spark, sf_dir, "documents"))
    return found.drop("lang")


def op4_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op5_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_deleted")


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), PATH_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infill(table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(again.cast("binary"), 256).alias("restored_sha256"))


def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, ~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.replayed_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_template_extraction,
        op2_order_minhash,
        op3_tokenizer_fertility,
        op4_nearest_toxicity,
        op5_hierarchical_packing,
        op6_weighted_fair_mix,
        op7_line_dedup,
        op8_minhash_near_dedup,
        op9_warc_archive,
        op10_url_filter,
        op11_fill_in_middle,
        op12_language_spans,
        op13_prefix_trie,
    )
}

#: The patterns of op10 in one condition.
_ANY_PATTERN = " OR ".join(f"regexp_matches(low, '{p.pattern}')" for p in url_filter.PATTERNS)

ORACLES = {
    "op6_weighted_fair_mix": r"""
WITH RECURSIVE z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM g),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM w),
level(i, x) AS (
  SELECT 0, (SELECT budget FROM b) / (SELECT sum(weight) FROM w)
  UNION ALL
  SELECT i + 1, ((SELECT budget FROM b) - (SELECT coalesce(sum(cap), 0) FROM w WHERE cap <= weight * x)) / (SELECT sum(weight) FROM w WHERE cap > weight * x)
  FROM level WHERE i < 60
), t AS (SELECT source, source_size, least(cap, weight * (SELECT max(x) FROM level)) AS target FROM w),
o AS (SELECT *, ('0x' || substr(md5('17:' || doc_id || ':' || size), 1, 15))::BIGINT AS ord FROM z),
s AS (SELECT o.doc_id, o.source, o.size, t.source_size, t.target, o.ord, sum(o.size) OVER (PARTITION BY o.source ORDER BY ord, doc_id, o.size ROWS UNBOUNDED PRECEDING) AS sent FROM o JOIN t ON t.source IS NOT DISTINCT FROM o.source),
f AS (SELECT s.* EXCLUDE (sent), epoch, sent + epoch * source_size AS sent FROM s, (VALUES (0), (1)) e(epoch)),
c AS (SELECT *, sum(size) OVER (ORDER BY sent / target, source NULLS LAST, epoch, ord, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM f WHERE sent - size < target),
k AS (SELECT doc_id, sum(greatest(0, least(size, (SELECT 150 * sum(source_size) // 100 FROM t) - upto + size))) AS got FROM c GROUP BY doc_id)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(k.got, 0)::BIGINT AS taken FROM s LEFT JOIN k ON k.doc_id = s.doc_id
""",
    # All pairs of equal lines, an earlier and a later place; runs of them at an equal distance are the matches.
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS d FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')),
l AS (SELECT d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pos) AS i FROM n WHERE words > 0),
p AS (SELECT b.d, b.i, b.pos, b.words, a.d AS earlier, b.i - a.i AS shift FROM c a JOIN c b ON a.line = b.line AND (a.d < b.d OR a.d = b.d AND a.i < b.i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY d, earlier, shift ORDER BY i) AS island FROM p),
r AS (SELECT d, min(pos) AS run_start, max(pos) AS run_end FROM g GROUP BY d, earlier, shift, island HAVING sum(words) >= 50),
gone AS (SELECT DISTINCT l.d, l.pos FROM l JOIN r ON r.d = l.d AND l.pos BETWEEN run_start AND run_end),
t AS (
  SELECT l.d, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept, count(*) AS n_lines, count(gone.pos) AS n_deleted
  FROM l LEFT JOIN gone ON gone.d = l.d AND gone.pos = l.pos GROUP BY l.d
)
SELECT x.doc_id, CASE WHEN x.text IS NOT NULL THEN coalesce(t.kept, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted
FROM documents x LEFT JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text LEFT JOIN t ON t.d = d.d
""",
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ') || ' (' || len(ws) || ')']
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * n >= 85 * (len(sa.sh) + len(sb.sh) - n)
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id, doc_id AS r FROM s
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM s JOIN reach ON reach.doc_id = s.doc_id GROUP BY s.doc_id, s.sh
""",
    "op9_warc_archive": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND payload_bytes >= 100
""",
    "op10_url_filter": rf"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']), {{'h': '', 'p': ''}}) AS u FROM pages),
b AS (
  SELECT page_id, translate(u.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.p AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM a
), r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT b.page_id, b.host, b.path, b.low, r.h || r.p AS rule, r.verdict,
    row_number() OVER (PARTITION BY b.page_id, b.low ORDER BY length(r.h || r.p) DESC NULLS LAST) AS nth
  FROM b LEFT JOIN r ON (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_ANY_PATTERN} THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE nth = 1
""",
    "op11_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2,
    ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM t
), c AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR h3 >= 50 OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1:], '') AS s FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
""",
    # Sequences are compared as lists of whole turns; a subtree is found through the members of its top.
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT c, list(x ORDER BY i) AS xs FROM t GROUP BY c),
h AS (
  SELECT c, xs, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END))) % 6 AS h
  FROM l
), s AS (
  SELECT h.c, list_concat(coalesce(f.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs FROM h LEFT JOIN l f ON f.c = h.c - h.c % 100
), p AS (SELECT c, len(xs)::BIGINT AS n, unnest(range(0, len(xs) + 1))::BIGINT AS depth, xs FROM s),
k AS (SELECT c, n, depth, xs[1:depth] AS seq, min(c) OVER (PARTITION BY depth, xs[1:depth]) AS conv_id FROM p),
g AS (
  SELECT conv_id, depth, count(*)::BIGINT AS n_convs, (count(*) - 1) * coalesce(any_value(length(seq[depth].t)), 0) AS own,
    sha256(coalesce(string_agg(CASE WHEN n = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM k GROUP BY conv_id, depth
), u AS (SELECT g.*, k.conv_id AS parent_conv_id FROM g LEFT JOIN k ON k.c = g.conv_id AND k.depth = g.depth - 1),
v AS (SELECT u.*, (SELECT count(*) FROM u y WHERE y.parent_conv_id = u.conv_id AND y.depth = u.depth + 1)::BIGINT AS n_children FROM u),
a AS (
  SELECT k.conv_id AS top, k.depth AS top_depth, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(v.own)::BIGINT AS saved_tokens
  FROM v JOIN k ON k.c = v.conv_id AND k.depth <= v.depth GROUP BY k.conv_id, k.depth
)
SELECT v.conv_id, v.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM v JOIN a ON a.top = v.conv_id AND a.top_depth = v.depth
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
