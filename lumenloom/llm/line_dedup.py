"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A gram is a run of whole lines, from one line on, just long enough to hold `gram_words` words. In
each window of `window_words` words the gram with the smallest hash is a fingerprint: one row with its position, however many windows
choose it, and nothing else goes on. Any run of lines of at least gram_words + window_words words that two places share
holds the same fingerprint at the same place in both: all grams of the window at its first line lie within the run.

Fingerprints are joined on their hash. From each that occurs again, the match is extended over the lines before it (back to each
line whose window chose it) and after it (from where the run has its least words, line by line). A run from a line on is
extended until it holds the next line's shortest run: from there on the next line's fingerprint takes over, so that there are about two
runs a line, and matches of any length are followed to their last line in one pass. Runs of equal lines meet by their hash,
never in pairs; all but the first by document and position are deleted.

So a line goes if and only if it lies in a run of at least `run_words` words that equals, line by line, a run at an earlier place.
Order: doc_id, then line number; a null doc_id comes last. Repeats that overlap within one text (the same lines again and again)
shrink to their first period.

Hot keys: repeated rows and repeated prints are counted by partial aggregates. A fingerprint that is in `hot` places or more
has its runs dealt over `salts` tasks, which each get the first places of its runs.

Defined results: null text stays null, an empty text stays empty. Blank lines have no words: they
never start a run, inside a run they go with it. Rows with equal doc_id and text are one
document and get the same text. Lines end at \\n; a last \\n is kept unless the line after it goes.
Extra columns pass through untouched, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize


@dataclass(frozen=True)
class LineDedup:
    gram_words: int = 25
    window_words: int = 25
    hot: int = 256
    salts: int = 64

    @property
    def run_words(self) -> int:
        """Every repeated run of so many words is found."""
        return self.gram_words + self.window_words


def _key():
    """What tells rows apart: rows of equal doc_id and text are the same document."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")).cast("binary")))


def _hash(of):
    return F.struct(F.xxhash64(of).alias("x"), F.hash(of).alias("m"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, key, pos, hash, words, upto (words before the line); one row for each line with words, in the partition of its key."""
    rows = docs.filter("text is not null and text <> ''").select("doc_id", _key().alias("key"), F.split("text", "\n", -1).alias("lines"))
    solid = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("pos"), _hash(line).alias("hash"), F.regexp_count(line, F.lit(WORD)).cast("long").alias("words"))), lambda x: x["words"] > 0)
    # Repeated rows leave one a task before anything moves.
    once = rows.select("doc_id", "key", solid.alias("lines")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines"))
    lines = once.select("doc_id", "key", F.explode("lines").alias("line")).select("doc_id", "key", "line.*")
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("upto", F.coalesce(F.sum("words").over(before), F.lit(0)))


def fingerprints(lines: DataFrame, how: LineDedup) -> DataFrame:
    """lines with `print`: (hash, position) of the least gram in each line's window; null where fewer than run_words words are left."""
    order = Window.partitionBy("key").orderBy("upto")
    span = order.rangeBetween(0, how.gram_words - 1)
    grams = lines.withColumn("_gram", F.array_sort(F.collect_list(F.struct("pos", "hash")).over(span))).withColumn("_n", F.sum("words").over(span))
    grams = grams.withColumn("_gram", F.when(F.col("_n") >= how.gram_words, F.struct(_hash(F.col("_gram")["hash"]).alias("hash"), "pos"))).drop("_n")
    return grams.withColumn("print", F.min("_gram").over(order.rangeBetween(0, how.window_words - 1))).drop("_gram")


def extensions(lines: DataFrame, words: int) -> DataFrame:
    """lines with `runs`: (start, end, hash) of each run from a line on that ends from its shortest run of so many words to before the end of
    the next line's, or of the text; null where the text ends before."""
    order = Window.partitionBy("key").orderBy("upto")
    span = order.rangeBetween(0, words - 1)
    raw = lines.withColumn("_run", F.array_sort(F.collect_list(F.struct("pos", "hash")).over(span))).withColumn("_n", F.sum("words").over(span))
    whole = F.col("_n") >= words
    next_, next_whole = F.lead("_run").over(order), F.lead(whole).over(order)
    end = F.element_at("_run", -1)["pos"]
    # The next line's run without its last line (with it, if it has no other), or what is left of the text; of these, the lines after this run.
    inner = F.when(next_whole & (F.size(next_) > 1), F.slice(next_, 1, F.size(next_) - 1)).otherwise(next_)
    raw = raw.withColumn("_tail", F.filter(F.coalesce(inner, F.slice("_run", 1, 0)), lambda x: x["pos"] > end))
    longest = F.concat("_run", "_tail")
    sizes = F.sequence(F.size("_run"), F.size(longest))
    runs = F.transform(sizes, lambda n: F.struct(F.col("pos").alias("start"), F.element_at(longest, n)["pos"].alias("end"), _hash(F.slice(longest, 1, n)["hash"]).alias("hash")))
    return raw.withColumn("runs", F.when(whole, runs)).drop("_run", "_n", "_tail")


def repeated_runs(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """key, start, end: the lines of each document that repeat an earlier run; disjoint."""
    both = extensions(fingerprints(lines_of(docs), how), how.run_words).filter("runs is not null")
    # One row for each selected minimum, with the runs that extend it both ways.
    chosen = both.groupBy("key", F.col("print.pos").alias("at"), F.col("print.hash").alias("print")).agg(F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("runs")).alias("runs"))
    chosen = materialize(chosen, "fingerprints")
    often = materialize(chosen.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    met = chosen.join(often, "print")
    # Where a fingerprint is very frequent, its runs go to many tasks.
    salt = F.when(F.col("n") >= how.hot, F.pmod(F.xxhash64("key", "r.start"), F.lit(how.salts)).cast("int")).otherwise(0)
    runs = materialize(met.select("doc_id", "key", "n", F.explode("runs").alias("r")).select("doc_id", "key", "r.*", "n", salt.alias("salt")), "extended")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    first = runs.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.max("n").alias("n")).filter("times > 1")
    salts = F.sequence(F.lit(0), F.when(F.col("n") >= how.hot, how.salts - 1).otherwise(0))
    first = materialize(first.select("hash", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"), "n"), "first").select("hash", "first_key", "first_start", F.explode(salts).alias("salt"))
    later = runs.drop("n").join(first, ["hash", "salt"]).filter((F.col("key") != F.col("first_key")) | (F.col("start") != F.col("first_start")))
    # Merge touching runs into maximal ones.
    seen = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    steps = later.groupBy("key", "start").agg(F.max("end").alias("end")).withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(seen), F.lit(-2)) + 1).cast("int"))
    merged = steps.withColumn("run", F.sum("new").over(Window.partitionBy("key").orderBy("start")))
    return merged.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("key", "start", "end")


def dedup_lines(docs: DataFrame, how: LineDedup = LineDedup(), counts: bool = False) -> DataFrame:
    """docs with later repeated runs deleted from `text`; counts adds n_lines and n_deleted."""
    held = [c for c in docs.columns if c != "text"]
    # Extra columns travel in one struct, so that their names can't clash with ours.
    packed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"))
    spans = materialize(repeated_runs(packed, how).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    # Spans grow with the documents, so they meet them by a shuffle at every size.
    joined = packed.withColumn("key", _key()).join(spans.hint("merge"), "key", "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i <= s["end"])))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    extra = []
    if counts:
        gone = F.aggregate(F.coalesce("spans", F.array()), F.lit(0), lambda n, s: n + s["end"] - s["start"] + 1)
        n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines))
        extra = [n.cast("long").alias("n_lines"), F.when(F.col("spans").isNull(), 0).otherwise(gone).cast("long").alias("n_deleted")]
    return joined.select(*[(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in docs.columns], *extra)
