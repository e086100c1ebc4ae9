"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of doc_id and a seed) and offered up to `epochs`
times. A document's virtual finish time is the words its source has sent up to and with it,
divided by the source's target. All offers are range-sorted by finish time and cut where the
total budget is used up; the last offer is cut to fit. As weights are the targets, all sources
reach their targets at virtual time 1.

No source is ordered in one task: a source's shuffle order is cut into `slices` hash ranges whose
sums (sources x slices rows) give each range its base, and only rows within a range are ordered.
The cut is found the same way, over `slices` ranges of finish time. All sums are of whole
numbers, so reruns agree.

Defined results: null or blank text has size 0 and is taken with 0 words. A null source is a
source of its own, ordered last. Rows with equal doc_id are separate rows; among rows that agree in
doc_id, source and size the order doesn't matter. A null doc_id is allowed. Sources without words
have target 0. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    percent: int = 150
    epochs: int = 2
    slice_rows: int = 500_000
    seed: int = 17

    def slices(self, rows: int) -> int:
        """Ranges that hold some hundred thousand rows each at most."""
        return max(1024, rows // self.slice_rows)


def sizes(docs: DataFrame) -> DataFrame:
    """The number of words of each text as `size`."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, how: Mix = Mix()) -> DataFrame:
    """source, source_size, target: one row for each source.

    Sources in code point order (null last) get the weights in turn. A source can't get more than
    epochs times its size; what it can't take goes to the others by weight, until none is above.
    That fixed point is a water level L with target = min(cap, weight * L): sorted by cap / weight,
    the first sources are full, and L is what is left over the weights that are left."""
    summed = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(how.weights))) + 1).cast("int"))
    rows = summed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * how.epochs)
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(total) * F.lit(how.percent) / F.lit(100.0))
        .withColumn("left_words", F.col("budget") - F.coalesce(F.sum("cap").over(full), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    )
    # The level is set by the first source that isn't filled; -1 where all are.
    fits = F.col("left_words") * F.col("weight") / F.col("left_weight") >= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(~fits, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("left_words") / F.col("left_weight")).alias("x"))).over(total))
    level = F.col("level")["col4"]
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * level))
    return rows.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of docs."""
    sized = sizes(docs).select(F.col("doc_id"), F.col("source"), F.col("size"))
    return mix_sized(sized, how)


def mix_sized(sized: DataFrame, how: Mix = Mix()) -> DataFrame:
    """mix() for rows of doc_id, source and size."""
    sized = materialize(sized, "sized")
    slices = how.slices(sized.count())
    # 60 bits of a digest: the same on any engine.
    digest = F.md5(F.concat_ws(":", F.lit(str(how.seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")).cast("binary"))
    rows = sized.withColumn("order", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    # A slice is a range of the shuffle order, so slices in turn are the whole order.
    rows = rows.withColumn("part", F.floor(F.col("order") / F.lit(2.0**60) * slices).cast("int"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    goals = targets(sized, how)
    bases = bases.join(goals.withColumnRenamed("source", "g"), _same(F.col("source"), F.col("g"))).drop("g", "part_size")
    bases = bases.withColumnsRenamed({"source": "s", "part": "p"})
    placed = rows.join(bases, _same(F.col("source"), F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    within = Window.partitionBy("source", "part").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("sent", F.col("base") + F.sum("size").over(within))
    # Offers: the same shuffle once more in each epoch.
    offers = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(how.epochs - 1)))).withColumn("sent", F.col("sent") + F.col("epoch") * F.col("source_size"))
    finish = F.when(F.col("target") > 0, F.col("sent") / F.col("target")).otherwise(F.lit(0.0))
    # The budget is used up by offers that start before their source's target, one of which per source
    # ends after time 1. Later offers get nothing and lie in ranges of their own, dealt evenly.
    starts = F.col("sent") - F.col("size") < F.col("target")
    place = F.when(starts, F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices))).otherwise(F.lit(2 * slices + 1) + F.pmod("order", F.lit(slices)))
    offers = offers.withColumn("finish", finish).withColumn("range", place.cast("int"))
    # The ranges' sums (their number is fixed) say in which range the budget ends.
    by_range = offers.groupBy("range").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).select(F.col("range").alias("r"), "before")
    words = F.sum("source_size")
    budget = goals.agg(F.least(F.floor(words * F.lit(how.percent) / 100), words * how.epochs).cast("long").alias("budget"))
    by_range = by_range.crossJoin(F.broadcast(budget))  # one row
    # At most 3 * slices + 1 rows: broadcast.
    dealt = offers.join(F.broadcast(by_range), F.col("range") == F.col("r")).drop("r")
    in_range = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("upto", F.col("before") + F.sum("size").over(in_range))
    got = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("upto") + F.col("size")))
    dealt = dealt.withColumn("got", got)
    # Only totals are needed for each row; a row number keeps rows of equal doc_id apart.
    same = Window.partitionBy("source", "doc_id", "size", "epoch").orderBy("order", "sent")
    numbered = dealt.withColumn("nth", F.row_number().over(same))
    return numbered.groupBy("doc_id", "source", "size", "nth").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("got").cast("long").alias("taken")).drop("nth")
