import random

import pytest
from pyspark.sql import functions as F

from lumenloom.llm import common


@pytest.mark.parametrize("bounds", [[], [5], [1, 2, 3, 900], sorted(random.Random(1).sample(range(-(10**12), 10**12), 300)), [0, 10**15, 10**15 + 1]])
def test_range_part_counts_bounds_below(spark, bounds):
    r = random.Random(2)
    keys = [None, -(10**13), 10**16, 0, *bounds, *[b + d for b in bounds for d in (-1, 1)], *[r.randrange(-(10**12), 10**12) for _ in range(200)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", common.range_part(F.col("k"), bounds).alias("p"))
    for row in df.collect():
        assert row.p == (0 if row.k is None else sum(b < row.k for b in bounds))


def test_range_bounds_cut_evenly(spark):
    df = spark.range(0, 100_000).withColumn("k", F.col("id") * F.col("id"))
    bounds = common.range_bounds(df, "k", 20)
    sizes = [r["count"] for r in df.groupBy(common.range_part(F.col("k"), bounds)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * min(sizes)
    assert common.range_bounds(df.limit(0), "k", 4) == [] and common.range_bounds(df, "k", 1) == []


def test_materialize(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    again = common.materialize(df, "t")
    assert again.schema == df.schema and sorted(map(tuple, again.collect())) == [(1, None), (2, "x")]


def test_word_hash_forgets(spark):
    memo = common.WordHash(2)
    first = [memo[w] for w in (b"a", b"b", b"c", b"a")]
    assert first[0] == first[3] and len(memo) <= 2
