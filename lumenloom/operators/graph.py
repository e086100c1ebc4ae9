"""The link graph: adjacency, degree, centrality, spectral positions, reachability."""

from __future__ import annotations

import itertools
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settings import Settings
from . import folders


def adjacency(links: DataFrame) -> DataFrame:
    """source_url, targets (sorted)."""
    return links.groupBy("source_url").agg(F.array_sort(F.collect_set("target_url")).alias("targets"))


def edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("source_url").alias("src"), F.col("target_url").alias("dst"))


def symmetric(links: DataFrame) -> DataFrame:
    """node, other, weight: both directions of each edge, their multiplicity added up."""
    e = edges(links)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.groupBy("node", "other").agg(F.count("*").cast("double").alias("weight"))


def degree(links: DataFrame) -> DataFrame:
    return symmetric(links).groupBy("node").agg(F.sum("weight").alias("degree"))


def centrality(links: DataFrame, s: Settings = Settings(), iterations: int | None = None, tolerance: bool = True) -> DataFrame:
    """node, score: power iteration on the symmetric graph from equal values, at most `power_iterations` rounds, over the largest value.

    Each round is one join and one sum; vectors stay DataFrames, and lineage is cut by checkpoints. On graphs without
    an odd cycle the values alternate, so the result is the last round's."""
    matrix = symmetric(links).checkpoint()
    nodes = matrix.select("node").distinct()
    n = nodes.count()
    if n == 0 or n > s.max_graph_nodes:
        return nodes.select("node", F.lit(0.0).alias("score")).limit(0)
    x = nodes.select("node", F.lit(1 / np.sqrt(n)).alias("x")).checkpoint()
    for i in range(iterations or s.power_iterations):
        y = matrix.join(x.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        length = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("l"))
        new = y.crossJoin(F.broadcast(length)).select("node", (F.col("y") / F.col("l")).alias("x"))  # one row
        if tolerance or i % 5 == 4:
            new = new.checkpoint()
        if tolerance:
            close = F.abs(F.col("x") - F.col("o")) <= 1e-8 + 1e-5 * F.abs("o")
            done = new.join(x.withColumnRenamed("x", "o"), "node").agg(F.bool_and(close).alias("c")).first()["c"]
            x = new
            if done:
                break
        else:
            x = new
    top = x.agg(F.max(F.abs("x")).alias("top"))
    return x.crossJoin(F.broadcast(top)).select("node", F.when(F.col("top") > 0, F.col("x") / F.col("top")).otherwise(0.0).alias("score"))


def centrality_of(pairs: list[tuple[str, str]], iterations: int = 100) -> dict[str, float]:
    """The same for a small graph that fits the driver."""
    names = sorted({x for p in pairs for x in p})
    at = {v: i for i, v in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for u, v in pairs:
        a[at[u], at[v]] += 1
        a[at[v], at[u]] += 1
    x = np.full(len(names), 1 / np.sqrt(max(len(names), 1)))
    for _ in range(iterations):
        y = a @ x
        length = np.linalg.norm(y)
        if not length:
            break
        y = y / length
        done = np.allclose(y, x, atol=1e-8)
        x = y
        if done:
            break
    top = np.abs(x).max() if len(x) else 0
    return {v: float(x[i] / top) if top else 0.0 for v, i in at.items()}


def pieces(e: DataFrame) -> DataFrame:
    """e: node, other, each link both ways. node, piece: the smallest node that it is joined with over any number of links.

    Each round every node points its neighbours at the smallest it knows of, and pointers are shortened, so that rounds grow with the logarithm of a piece's width."""
    spark, held = e.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        held.append(folders.shared_folder(spark, "pieces"))
        df.write.parquet(held[-1])
        return spark.read.schema(df.schema).parquet(held[-1])

    now = keep(e.filter("node > other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # The larger neighbours of each node are linked to the smallest there is around it, then its smaller neighbours to the smallest of them.
        larger = now.select(F.col("v").alias("c"), F.col("u").alias("w")).join(low, "c").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        larger = keep(larger)
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        fresh = keep(larger.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        most = fresh.groupBy("u").count().agg(F.max("count")).first()[0]
        # A star forest: each u has one v, and no v is a u.
        done = most is None or (most == 1 and fresh.join(fresh.select(F.col("u").alias("v")), "v", "left_semi").isEmpty())
        now = fresh
        for path in held[:-1]:
            folders.remove(spark, path)
        del held[:-1]
        if done:
            break
    return e.select("node").distinct().join(now.withColumnsRenamed({"u": "node", "v": "piece"}), "node", "left").select("node", F.coalesce("piece", "node").alias("piece"))


def _spectral_of_pieces(nodes: DataFrame, placed: DataFrame, volume: float, wanted: int) -> DataFrame:
    """The places where there are more pieces than `wanted`. Each piece gives the eigenvalue 1 of the scaled links once, with square roots of degrees within the piece as its vector, so
    the vectors wanted are combinations of these: random ones, made orthogonal to the trivial one and to each other. All nodes of a piece have one place."""
    sizes = folders.written(nodes.join(placed, "node").groupBy("piece").agg(F.sum("degree").alias("volume")), "volumes")
    shares = [(F.pmod(F.xxhash64("piece", F.lit(j)), F.lit(1 << 20)) / (1 << 19) - 1.0) for j in range(wanted)]
    root = F.sqrt(F.col("volume") / F.lit(float(volume)))
    pairs = [(i, j) for i in range(wanted) for j in range(i, wanted)]
    got = sizes.agg(*[F.sum(root * a) for a in shares], *[F.sum(shares[i] * shares[j]) for i, j in pairs]).first()
    along = np.array(got[:wanted])
    gram = np.zeros((wanted, wanted))
    for (i, j), v in zip(pairs, got[wanted:]):
        gram[i, j] = gram[j, i] = v - along[i] * along[j]
    weights, basis = np.linalg.eigh(gram)
    turn = basis / np.sqrt(weights)
    free = [a - root * float(s) for a, s in zip(shares, along)]
    embedding = F.array(*[sum(f * float(t) for f, t in zip(free, column)) for column in turn.T])
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda total, v: total + v * v))
    unit = F.when(length > 1e-12, F.transform("e", lambda v: v / length)).otherwise(F.transform("e", lambda v: F.lit(0.0)))
    return placed.join(sizes.select("piece", embedding.alias("e")).select("piece", unit.alias("embedding")), "piece").select("node", "embedding")


def spectral(links: DataFrame, dims: int = 8, rounds: int | None = None, degree: int = 10, tolerance: float = 1e-6, split: int = 200_000, patience: int = 50) -> DataFrame:
    """links: source_url, target_url. node, embedding (array<double>): places of unit length from the `dims` smallest eigenvectors of the
    normalised Laplacian after the trivial one, square roots of degrees; links count both ways and as often as they occur.

    A block of a few more vectors is filtered by Chebyshev polynomials of the edge table, which damp the far end of the spectrum, and turned to
    its eigenvectors by its Gram matrices (Rayleigh-Ritz) until the residuals are below `tolerance`, and below 1e-4 of the last eigenvalue wanted, as
    vectors of eigenvalues that lie closer together than the residuals are mixed. The closer the block comes to the end of the spectrum, the more steps
    a round's polynomial has. Each step is one join and one sum, and reads the step before once; `degree` of them are one plan and one write; the
    driver sees matrices of dims + 4 rows only. A node's links beyond `split` are dealt over tasks, each with the node's vectors.

    A graph of more than `dims` pieces needs none of this: its vectors are known from the pieces.

    Defined results: n nodes give min(dims, n - 2) numbers; two nodes or one give [0.0]; null ends are no links. Rounds go on until all is found; if
    `patience` of them don't lower the residuals by a tenth, a RuntimeError is raised. Only a caller that sets `rounds` gets values of 0, and a warning, where these don't suffice. Vectors of one eigenvalue (as of a graph in pieces) are fixed up to a rotation, which cosines over the whole eigenspace don't see."""
    spark = links.sparkSession
    matrix = folders.written(symmetric(links.filter("source_url is not null and target_url is not null")), "links")
    nodes = matrix.groupBy("node").agg(F.sum("weight").alias("degree"), F.ceil(F.count("*") / split).cast("int").alias("parts"))
    nodes = folders.written(nodes, "nodes")
    n, volume = nodes.agg(F.count("*"), F.sum("degree")).first()
    if n <= 2:
        return nodes.select("node", F.array(F.lit(0.0)).alias("embedding"))
    wanted, p = min(dims, n - 2), min(dims + 4, n - 1)
    placed = folders.written(pieces(matrix), "placed")
    if placed.select("piece").distinct().count() > wanted:
        return _spectral_of_pieces(nodes, placed, volume, wanted)
    ends = nodes.select(F.col("node").alias("other"), F.col("degree").alias("other_degree"), "parts")
    edges_ = matrix.join(nodes.drop("parts"), "node").join(ends, "other")
    scaled = edges_.select("node", "other", (F.col("weight") / F.sqrt(F.col("degree") * F.col("other_degree"))).alias("w"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    # A row of its own carries each node's vectors over to the next step.
    own = nodes.select("node", F.col("node").alias("other"), F.lit(None).cast("double").alias("w"), F.lit(0).alias("part"))
    scaled = folders.written(scaled.unionByName(own), "edges")

    now, before, product = ([f"{c}{j}" for j in range(p)] for c in "qry")
    held: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = folders.shared_folder(spark, "vectors")
        df.write.parquet(path)
        held.append(path)
        for old in held[:-1]:
            folders.remove(spark, old)
        del held[:-1]
        return spark.read.schema(df.schema).parquet(path)

    def spread(x: DataFrame, carried: list[str]) -> DataFrame:
        """Each link beside the vectors of its other end; `mine` marks the node's own row."""
        sent = x.select(F.col("node").alias("other"), "root", "parts", *carried, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return scaled.join(sent, ["other", "part"]).withColumn("mine", F.col("w").isNull()).groupBy("node")

    mine = lambda c: F.max(F.when(F.col("mine"), F.col(c)))
    fixed = [mine("root").alias("root"), mine("parts").alias("parts")]
    draws = itertools.count()
    drawn = lambda: F.pmod(F.xxhash64("node", F.lit(next(draws))), F.lit(1 << 20)) / (1 << 19) - 1.0
    x = nodes.select("node", F.sqrt(F.col("degree") / volume).alias("root"), "parts", *[drawn().alias(c) for c in now])
    worst: list[float] = []
    for turn in itertools.count() if rounds is None else range(rounds):
        x = keep(spread(x, now).agg(*fixed, *[mine(c).alias(c) for c in now], *[F.sum(F.when(~F.col("mine"), F.col("w") * F.col(c))).alias(y) for c, y in zip(now, product)]))
        turned, values = _ritz(x, now, product)
        along, image = ([sum((F.col(c) - F.col("root") * float(s)) * float(t) for c, s, t in zip(names, turned[0], column)) for column in turned[1].T] for names in (now, product))
        residuals = np.sqrt(x.agg(*[F.sum((y - q * float(v)) ** 2) for y, q, v in zip(image, along, values)]).first()[:wanted])
        found = len(values) == p and bool((residuals <= min(tolerance, 1e-4 * (1 - values[wanted - 1]))).all())
        if found:
            length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda total, v: total + v * v))
            unit = F.when(length > 1e-12, F.transform("e", lambda v: v / length)).otherwise(F.transform("e", lambda v: F.lit(0.0)))
            # As the vectors have length 1, an average entry is 1 / sqrt(n).
            return x.select("node", F.array(*[v * float(np.sqrt(n)) for v in along[:wanted]]).alias("e")).select("node", unit.alias("embedding"))
        if rounds is not None and turn == rounds - 1:
            break
        worst.append(float(residuals.max()))
        if turn >= patience and not min(worst[-patience:]) <= 0.9 * min(worst[:-patience]):
            raise RuntimeError(f"spectral: no eigenvectors of {n} nodes: residuals stay at {min(worst)} after {turn + 1} rounds")
        if len(values) < p:
            # Vectors that others span are drawn anew, as a smaller block can miss an eigenvector.
            x = x.select("node", "root", "parts", *[q.alias(c) for q, c in zip(along + [drawn() for _ in now[len(values) :]], now)])
            continue
        # What lies between -1 and `high` is damped. As the block's last value is never above its eigenvalue, nothing wanted is.
        high = float(np.clip(values[-1], -0.9, 1 - 1e-12))
        middle, half = (high - 1) / 2, (high + 1) / 2
        # Of the vectors none may grow so much beyond the others that these are lost: by e^14 (once the first ones are found, by what these have, and e^25 at the trivial one).
        far = float(np.arccosh((1 - middle) / half))
        steps = 14 / far if turn < 3 else min(25 / far, 14 / max(float(np.arccosh(max((values[0] - middle) / half, 1.0))), 1e-9))
        first = [((y - middle * q) / half).alias(c) for y, q, c in zip(image, along, now)]
        x = x.select("node", "root", "parts", *first, *[q.alias(c) for q, c in zip(along, before)])
        for k in range(1, max(int(steps), 2)):
            step = [
                F.sum(F.when(F.col("mine"), F.col(q) * (-2 * middle / half) - F.col(r)).otherwise(F.col("w") * F.col(q) * (2 / half))).alias(q)
                for q, r in zip(now, before)
            ]
            x = spread(x, now + before).agg(*fixed, *step, *[mine(q).alias(r) for q, r in zip(now, before)])
            if k % degree == 0:
                x = keep(x)
    warnings.warn(f"spectral: all values are 0, as {rounds} rounds don't suffice for {n} nodes", RuntimeWarning, stacklevel=2)
    return nodes.select("node", F.array_repeat(F.lit(0.0), wanted).alias("embedding"))


def _ritz(x: DataFrame, now: list[str], product: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(shares of the trivial vector, turn to Ritz vectors), Ritz values from the largest."""
    p = len(now)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(F.col("root") * F.col(c)) for c in now] + [F.sum(F.col(a[i]) * F.col(b[j])) for a, b in ((now, now), (now, product)) for i, j in pairs]
    got = x.agg(*[c.alias(f"s{k}") for k, c in enumerate(sums)]).first()
    share = np.array(got[:p])
    grams = []
    for k in range(2):
        m = np.zeros((p, p))
        for (i, j), v in zip(pairs, got[p + k * len(pairs) : p + (k + 1) * len(pairs)]):
            m[i, j] = m[j, i] = v
        grams.append(m - np.outer(share, share))
    size = np.sqrt(np.maximum(np.diag(grams[0]), 1e-300))
    g, h = (m / np.outer(size, size) for m in grams)
    weights, basis = np.linalg.eigh(g)
    use = weights > 1e-13 * weights.max()
    white = basis[:, use] / np.sqrt(weights[use])
    values, mixed = np.linalg.eigh(white.T @ h @ white)
    turn = (white @ mixed)[:, ::-1]
    return (share, turn / size[:, None]), values[::-1]


def reach(e: DataFrame, seeds: DataFrame, max_depth: int = 50) -> DataFrame:
    """e: src, dst; seeds: node. node, depth of all that can be reached."""
    visited = seeds.select("node", F.lit(0).alias("depth")).distinct().checkpoint()
    frontier = visited
    for depth in range(1, max_depth + 1):
        step = e.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(visited.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.union(frontier).checkpoint()
    return visited
