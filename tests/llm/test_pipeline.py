import random

from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    bad = ["rotter", "swine", "wretch"]
    rows, labels = [], []
    passage = " ".join(word() for _ in range(60))
    for i in range(400):
        words = [word() for _ in range(r.randrange(60, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(bad)
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if i % 40 == 5:
            lines.insert(1, passage)
        rows.append([i, "\n".join(lines), "en", f"s{i % 3}"])
        labels.append((i, 1, int(toxic)))
    near = rows[101][1].split(" ")
    near[3] = "changed"
    rows.append([1000, " ".join(near).replace("\n", " "), "en", "s0"])
    rows.append([1001, rows[101][1].replace("\n", " "), "en", "s0"])
    rows += [[1002, rows[103][1], "en", "s1"], [1003, None, "en", None], [1004, "", None, "s1"]]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, passage = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        kept.append(spark.read.parquet(f"{folder}/{name}"))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    toxic = {i for i in range(400) if i % 8 == 0}
    assert len(ids[1] & toxic) <= 2 and ids[0] - ids[1] <= toxic
    # The passage is left once, the exact copy is gone, what has no text stays.
    assert kept[2].filter(F.col("text").contains(passage)).count() == 1
    assert 1002 not in ids[2] and 103 in ids[2] and {1003, 1004} <= ids[2]
    assert kept[2].filter("text is not null and n_chars <> length(text)").count() == 0
    # 101, 1000 and 1001 are one group of near-duplicates.
    assert ids[3] & {101, 1000, 1001} == {101} and {1003, 1004} <= ids[3]
    sizes = {r.source: r.n for r in kept[3].groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    mixed = {r.source: r.n for r in kept[4].groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    assert mixed["s0"] > 1.7 * sizes["s0"] and mixed["s1"] < 1.2 * sizes["s1"]
    assert kept[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2


def test_run_and_repeat(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    one, two = (sorted(tuple(r) for r in cp.run(spark, folder).collect()) for _ in range(2))
    assert one == two and len(one) > 100


def test_near_dedup_takes_pairs_from_80_percent(spark):
    word = lambda i, k: f"w{i}x{k}"
    rows = []
    for i in range(20):
        words = [word(i, k) for k in range(104)]
        # 100 shingles each; new last words change as many shingles: 90 / 110 = 0.82 and 88 / 112 = 0.79 are the same.
        for at, new in ((0, 0), (100, 10), (200, 12)):
            text = words[: 104 - new] + [word(i, f"{at}y{k}") for k in range(new)]
            rows.append((at + i, " ".join(text), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    left = {r.doc_id for r in cp._near_dedup(spark, docs, "").collect()}
    assert left == {*range(20), *range(200, 220)}
    assert (1 - 0.8**cp.NEAR.rows) ** cp.NEAR.bands < 1e-6
