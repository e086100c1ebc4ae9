"""MinHash near-duplicates with sequential Bayesian verification.

Documents become sets of 5-word shingles. Equal sets are one class, by a 128-bit key of the whole set, and
from here on only classes are compared: each has a number, the signature and the smallest doc_id of its rows. Classes
meet in banded MinHash buckets; a bucket yields pairs with its leader only (a line per member, never all pairs). Pairs are compared
signature batch by signature batch and dropped once the posterior chance that their similarity reaches the
threshold is under `miss`; survivors are verified exactly on the full sets. Verified links are
joined into components. Buckets that still hold several components get other leaders in further rounds.
What no leader settles is compared block by block within the bucket, so no link depends on a leader: members outside the bucket's largest
component meet all others, by signatures alone; only those with a survivor are looked at
again with their texts. Nothing but links leaves a block.

Hot groups: copies collapse by partial aggregates. A bucket's members are dealt to parts of `part_rows`, and
its leader goes to each part, in the joins with signatures and texts too, so no leader's followers are one task's.

Defined results: null, empty or blank text: empty set, linked with nothing, its own component, kept.
Fewer than `k` words: the whole sequence is the one shingle. Rows with equal doc_id are one
document: all their texts' classes are linked, and rows with words get the same component. A row with a null doc_id has the smallest doc_id of
its component, or null where there is none; such a row is kept only where it has none. Extra columns are ignored by
`components`; `keep_one` returns them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHash, by_batch, hashes, materialize, mix64, parts_for, small_batches, words_of

_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDup:
    k: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    miss: float = 1e-6
    star_rounds: int = 3
    block: int = 400
    part_rows: int = 1000

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_set(text: str | None, k: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the whole text, A-Z lower-cased."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        whole = b" ".join(words).lower()
        return np.array([xxhash.xxh3_64_intdigest(whole, seed=len(words))], np.uint64)
    h = hashes(text.encode("utf-8", "surrogatepass").lower().split(), memo)
    n = len(h) - k + 1
    x = h[:n].copy()
    for i in range(1, k):
        x *= _M
        x += h[i : i + n]
    return np.unique(mix64(x))


def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(20240229)
    draw = lambda: random.randint(0, 2**32, size, dtype=np.uint64) << np.uint64(32) | random.randint(0, 2**32, size, dtype=np.uint64)
    return (draw() | np.uint64(1))[:, None], draw()[:, None]


def minhash(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each permutation, in blocks that fit the cache."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(low, (values[None, i : i + 1024] * a + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(-1, bands, rows).astype(np.uint64)
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M, parts.shape[:2]).copy()
    for i in range(rows):
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x += parts[:, :, i]
        mix64(x)
    return x.view(np.int64)


def sketch(docs: DataFrame, how: NearDup) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of the whole set), signature; a row for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (a, b) = WordHash(), _permutations(how.size)
        for batch in batches:
            sizes, keys, rows = [], [], []
            for text in batch.column(2).to_pylist():
                values = shingle_set(text, how.k, memo)
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                rows.append(minhash(values, a, b).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_key", "signature"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, signature binary")


def bucket_keys(classes: DataFrame, how: NearDup) -> DataFrame:
    """node, band, key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, how.size)
        keys = band_keys(signatures, how.bands, how.rows)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), how.bands)), pa.array(np.tile(np.arange(how.bands, dtype=np.int32), len(keys))), pa.array(keys.ravel())], names=["node", "band", "key"])

    return classes.select("node", "signature").mapInArrow(by_batch(run), "node long, band int, key long")


def least_matches(n: int, share: float, miss: float) -> int:
    """The fewest matches in n hashes at which a pair goes on: below it, under a flat prior,
    the posterior chance of a similarity of at least `share` is under `miss`."""
    # P(J >= s | m of n) for Beta(m + 1, n - m + 1) is the chance of at most m heads in n + 1 tosses of s.
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def gates_of(how: NearDup) -> list[tuple[int, int]]:
    step = max(how.size // 5, 1)
    return [(n, least_matches(n, how.percent / 100, how.miss)) for n in range(step, how.size + 1, step)]


def with_sides(pairs: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """pairs (leader, member, part) with `value` of both sides as l and m. A leader's facts are copied to each part of its members."""
    copies = pairs.select("leader", "part").distinct().join(facts.select(F.col("node").alias("leader"), F.col(value).alias("l"), F.col("n_shingles").alias("nl")), "leader")
    members = pairs.join(facts.select(F.col("node").alias("member"), F.col(value).alias("m"), F.col("n_shingles").alias("nm")), "member")
    return members.join(copies, ["leader", "part"])


def bayes_prune(pairs: DataFrame, sketches: DataFrame, how: NearDup) -> DataFrame:
    """Of pairs (leader, member, part) those that sizes and signatures don't rule out."""
    gates = gates_of(how)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, how.size) for i in (3, 4))
        alive, seen, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
        for n, least in gates:
            seen[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
            alive, done = alive[seen[alive] >= least], n
        return batch.select(["leader", "member", "part"]).take(pa.array(alive))

    joined = with_sides(pairs, sketches, "signature").filter(F.least("nl", "nm") * 100 >= F.greatest("nl", "nm") * how.percent)
    return joined.select("leader", "member", "part", "l", "m").mapInArrow(by_batch(run), "leader long, member long, part int")


def alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    both = np.intersect1d(one, other, assume_unique=True).size
    return 100 * both >= percent * (len(one) + len(other) - both)


def verify(pairs: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """Links (a, b): of the pairs those with 100 * intersection >= percent * union on the full sets, made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held = WordHash(), (None, None)
        for batch in batches:
            leaders, l, members, keep = batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), []  # noqa: E741
            for i, text in enumerate(members):
                if held[1] is None or held[0] != leaders[i]:
                    held = (leaders[i], shingle_set(l[i].as_py(), how.k, memo))
                if alike(held[1], shingle_set(text, how.k, memo), how.percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64())).rename_columns(["a", "b"])

    return with_sides(pairs, texts, "text").select("leader", "member", "l", "m").mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first `keys` columns, one table each; they come sorted by these."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(c[start] for c in columns)
            if now != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def by_blocks(members: DataFrame, sketches: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """Links (a, b) between different components within buckets (band, key, n, node, comp, part), enough to join what belongs together.

    A bucket is dealt into blocks of its largest component and blocks of the others. Two blocks meet in one group unless both are of
    the largest: its members are joined already. First signatures meet; a pair is looked at in the first bucket that
    it shares. Members with a survivor, in the groups where they have it, meet again with their texts."""
    spark = members.sparkSession
    bucket, group = ["band", "key"], ["band", "key", "i", "j"]
    sizes = members.groupBy(*bucket, "comp").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    largest = sizes.groupBy(*bucket).agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.first("n").alias("n"))
    parts = F.sequence(F.lit(0), (F.ceil(F.col("n") / how.part_rows) - 1).cast("int"))
    ceil = lambda x: F.ceil(x / how.block).cast("int")
    largest = materialize(largest.select(*bucket, F.col("top.comp").alias("top"), ceil(F.col("top.size")).alias("inner"), ceil(F.col("all") - F.col("top.size")).alias("outer"), "n"), "largest")
    own = members.drop("n").join(largest.withColumn("part", F.explode(parts)).drop("n"), [*bucket, "part"])
    mix = F.xxhash64("node", F.lit(3))
    own = own.withColumn("block", F.when(F.col("comp") == F.col("top"), F.pmod(mix, F.col("inner"))).otherwise(F.col("inner") + F.pmod(mix, F.col("outer"))).cast("int"))
    # A member of the largest component meets the outer blocks, the others meet all.
    meets = F.sequence(F.when(F.col("comp") == F.col("top"), F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)
    dealt = own.withColumn("x", F.explode(meets)).select(*bucket, F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "node", "comp")
    gates = gates_of(how)

    def candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """A row and those it may be alike with."""
        band, first, second = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        comp, block, n = (np.asarray(table.column(c)) for c in ("comp", "block", "n_shingles"))
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, how.size)
        bands = band_keys(signatures, how.bands, how.rows)
        right = np.flatnonzero(block == second)
        for k in np.flatnonzero(block == first).tolist():
            alive = right[right > k] if first == second else right
            alive = alive[(comp[alive] != comp[k]) & (np.minimum(n[alive], n[k]) * 100 >= np.maximum(n[alive], n[k]) * how.percent)]
            if len(alive):
                alive = alive[(bands[alive] == bands[k]).argmax(axis=1) == band]
            seen, done = np.zeros(len(alive), np.int64), 0
            for upto, least in gates:
                seen += (signatures[alive, done:upto] == signatures[k, done:upto]).sum(axis=1)
                keep = seen >= least
                alive, seen, done = alive[keep], seen[keep], upto
            if len(alive):
                yield k, alive[np.argsort(-seen, kind="stable")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 4):
            met = sorted({x for k, others in candidates(table) for x in (k, *others.tolist())})
            if met:
                yield from table.select([*group, "block", "node", "comp", "n_shingles", "signature"]).take(pa.array(met)).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for table in _groups(batches, 4):
            comp, nodes, text, sets, parent, out = table.column("comp").to_pylist(), table.column("node").to_pylist(), table.column("text"), {}, {}, []

            def root(c: int) -> int:
                while parent.get(c, c) != c:  # noqa: B023
                    c = parent[c]  # noqa: B023
                return c

            def full(k: int) -> np.ndarray:
                if k not in sets:  # noqa: B023
                    sets[k] = shingle_set(text[k].as_py(), how.k, memo)  # noqa: B023
                return sets[k]  # noqa: B023

            for k, others in candidates(table):
                for o in others.tolist():
                    x, y = root(comp[k]), root(comp[o])
                    if x != y and alike(full(k), full(o), how.percent):
                        parent[max(x, y)] = min(x, y)
                        out.append((nodes[k], nodes[o]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    kinds = "band int, key long, i int, j int, block int, node long, comp long, n_shingles long, signature binary"
    count = parts_for(spark, dealt.count(), 20_000)
    near = dealt.join(sketches, "node").select(*[k.split()[0] for k in kinds.split(", ")]).repartition(count, *group).sortWithinPartitions(*group)
    near = materialize(near.mapInArrow(look, kinds), "near")
    again = near.join(texts.select("node", "text"), "node").repartition(parts_for(spark, near.count(), 2_000), *group).sortWithinPartitions(*group)
    return again.select(*[k.split()[0] for k in kinds.split(", ")], "text").mapInArrow(confirm, "a long, b long")


def connect(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b). Each round, every node
    points its neighbours at the smallest it knows, and pointers are shortened; the rounds
    needed grow with the logarithm of a component's width. Nothing is collected."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    while True:
        # Every neighbour (larger or smaller) gets linked to the smallest in the neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = edges.select(F.col("v").alias("c"), F.col("u").alias("w")).join(low.withColumnRenamed("u", "c"), "c").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # Then each node's smaller neighbours get linked to the smallest of them.
        least = larger.filter("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.filter("u <> v").join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        fresh = materialize(smaller.filter("u <> v").distinct(), label)
        # A star forest: each u has one v, and no v is a u.
        stats = fresh.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if stats is None:
            break
        if stats == 1 and fresh.join(fresh.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            edges = fresh
            break
        edges = fresh
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(docs: DataFrame, how: NearDup) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of docs' rows, the classes of equal sets (node, set_key, least, its row of least doc_id), and (node, root) of each linked node but the roots."""
    base = materialize(sketch(docs, how), "sketch")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = base.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min(order).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # Numbers are fixed by writing them.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = bucket_keys(classes.filter("n_shingles > 1"), how)
    shared = materialize(buckets.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("n") / how.part_rows)).cast("int").alias("part")
    members = buckets.join(shared, ["band", "key"]).select("band", "key", "n", "node", part)
    # A text that others were made from shares more buckets with them than they do with each other: it leads.
    members = materialize(members, "members")
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    sketches = materialize(classes.join(score, "node").select("node", "n_shingles", "signature", "score", "row"), "candidates")
    row_of = (F.col("doc_id").eqNullSafe(F.col("r"))) & (F.col("text_key") == F.col("k"))
    owners = sketches.select("node", "n_shingles", F.col("row.doc_id").alias("r"), F.col("row.text_key").alias("k"))
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(owners, row_of).select("node", "n_shingles", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    sketches = sketches.select("node", "n_shingles", "signature", "score")

    # The texts of one doc_id belong together.
    several = base.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low < high")
    links, roots = None, None
    several = materialize(several.select("doc_id", "low"), "several")
    if not several.isEmpty():
        held = base.join(several, "doc_id").filter("set_key <> low").select("set_key", "low").distinct()
        node = lambda name, to: classes.select(F.col("set_key").alias(name), F.col("node").alias(to))
        links = materialize(held.join(node("set_key", "a"), "set_key").join(node("low", "b"), "low").select("a", "b"), "links")
        roots = connect(links)

    tested = None
    for turn in range(how.star_rounds + 1):
        now = members.withColumn("comp", F.col("node"))
        if roots is not None:
            now = members.join(roots, "node", "left").select("band", "key", "n", "node", "part", F.coalesce("root", "node").alias("comp"))
        if turn == how.star_rounds:
            order = F.lit(0)
        elif turn:
            order = F.xxhash64("node", F.lit(turn))
        else:
            now, order = now.join(score, "node"), -F.col("score")
        lead = now.groupBy("band", "key").agg(F.min(F.struct(order.alias("o"), "node", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("n")).filter("lo < hi")
        lead = materialize(lead.select("band", "key", "n", F.col("lead.node").alias("leader"), F.col("lead.comp").alias("own")), "leaders")
        if lead.isEmpty():
            break
        parts = F.sequence(F.lit(0), (F.ceil(F.col("n") / how.part_rows) - 1).cast("int"))
        now = now.join(lead.withColumn("part", F.explode(parts)).drop("n"), ["band", "key", "part"])
        if turn == how.star_rounds:
            found = materialize(by_blocks(now.select("band", "key", "n", "node", "comp", "part"), sketches.drop("score"), texts, how), "links")
        else:
            pairs = now.filter("comp <> own").groupBy("leader", F.col("node").alias("member")).agg(F.min("part").alias("part"))
            both = [F.least("leader", "member").alias("a"), F.greatest("leader", "member").alias("b")]
            if tested is not None:
                pairs = pairs.select("leader", "member", "part", *both).join(tested, ["a", "b"], "left_anti").drop("a", "b")
            pairs = materialize(pairs.select("leader", "member", "part"), "pairs")
            tested = pairs.select(*both).distinct() if tested is None else tested.union(pairs.select(*both))
            alive = materialize(bayes_prune(pairs, sketches, how), "alive")
            found = materialize(verify(alive, texts, how), "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = connect(links)
    if roots is None:
        roots = classes.filter("false").select("node", F.col("node").alias("root"))
    return base, classes, roots


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, set_key, row, root, least: the smallest doc_id of the whole component."""
    roots = materialize(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")  # a root is a node too
    linked = classes.join(roots, "node").select("node", "set_key", "row", "root", "least")
    whole = materialize(linked.groupBy("root").agg(F.min("least").alias("whole"), F.min("row").alias("first")), "roots")
    linked = linked.join(whole, "root").select("set_key", F.col("whole").alias("least"), "row", "first")
    alone = classes.join(roots, "node", "left_anti").select("set_key", "least", "row", F.col("row").alias("first"))
    return materialize(linked.union(alone), "components")


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def components(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs (doc_id, text)."""
    base, classes, roots = _classes(_typed(docs), how)
    found = _rooted(classes, roots).select("set_key", "least")
    out = base.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """The rows of docs, all their columns: of each component the row of least doc_id (nulls last, then by a hash of the text), one of it where
    rows repeat; and every row without words."""
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    _, classes, roots = _classes(packed.select("doc_id", "text"), how)
    rows = _rooted(classes, roots).filter("row = first").select(F.col("row.doc_id").alias("r"), F.col("row.text_key").alias("k")).distinct()
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    keyed = packed.filter(has_words).withColumn("text_key", F.xxhash64("text"))
    kept = keyed.join(rows, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["doc_id", "text_key"])
    return kept.select("whole.*").union(packed.filter(~has_words).select("whole.*"))
