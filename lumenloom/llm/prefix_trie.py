"""The prefix trie of conversations, and totals of its subtrees by peeling leaves.

A node of depth d is a sequence of d turns (role, text) that some conversation begins with; the conversations that do are its
members. `build` makes the nodes, `subtree_totals` sums over subtrees, `prefix_trie` does both.

Building. Turns are sorted by ranges of (conv_id, turn), so one long conversation lies in many tasks; a turn's place is its
number within the range plus the counts of the ranges before. A sequence is told by 128 bits: the XOR over its turns of a hash of (place, role,
text), which is a running XOR along a conversation, taken in blocks of `block` turns and over the blocks' totals. Grouping these hashes gives the
nodes, whose number of members and smallest member are partial aggregates. A node is named by (smallest member, depth).

Peeling. Every node holds a counter of the children that haven't finished, the XOR of their names and the totals so far. Finished
nodes send their subtree's totals to their parents, summed for each parent before they move; a parent whose counter reaches 0
is finished. A node with one open child knows its name from the XOR. It waits for it, and while that one waits for one child itself, takes over its totals and
waits for its child instead; so a chain of n nodes takes about log2 n rounds, not n, and so does every trie
(leaves and chains are half of any tree at least). Nodes with one member are finished at the start: below them is one chain that saves nothing.
Each round's table is written to the shared folder; of the open nodes only the last ones stay there.

Defined results: turns are ordered by turn, null first, then by role and text; null roles and texts are empty; repeated rows are turns of
their own. Rows with a null conv_id belong to no conversation and are left out. No conversations give no nodes, not even a root. Extra
columns are ignored. Only turns that agree in conv_id, turn, role and the first 64 characters of the text must be sorted in one task, on disk where they must.
The SHA-256 of a node's ends is one stream by its nature: lists come in pieces of up to 4096 ids, and are hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, parts_for, small_batches

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    block: int = 4096  # turns of a conversation in one running XOR
    part_turns: int = 200_000  # in a range of the sort
    replay: int = 6  # lengths of the replayed head, 0 to replay - 1
    family: int = 100  # conversations c - c % family to the next share a head


def placed(turns: DataFrame, how: Trie = Trie()) -> DataFrame:
    """conv_id, pos (from 0), turn_hash (two longs), n_chars: a row for each turn, in its order within the conversation."""
    spark = turns.sparkSession
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    parts = parts_for(spark, rows.count(), how.part_turns)
    start = F.substring("text", 1, 64)
    # The beginning of a text is no longer than the text, and orders as the text does.
    rows = rows.withColumn("start", start).repartitionByRange(parts, "conv_id", F.col("turn").asc_nulls_first(), "role", "start").drop("start")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    hashed = [F.xxhash64(F.lit(seed), "role", "text").alias(f"t{seed}") for seed in (1, 2)]
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("at"), *hashed, F.length("text").cast("long").alias("n_chars"))
    # Written, so that numbers and ranges hold whatever is run again.
    rows = materialize(rows, "turns")
    ranged = rows.withColumn("range", F.shiftright("at", 33))
    ranges = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    joined = ranged.join(ranges, (F.col("conv_id") == F.col("c")) & (F.col("range") == F.col("r")))
    out = materialize(joined.select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "t1", "t2", "n_chars"), "placed")
    drop_table(rows)
    return out


def replayed(turns: DataFrame, how: Trie = Trie()) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % family instead of its own; h = crc32(c) % replay.
    turns: as from placed(). Returns all conversations (conv_id) and the new turns. At most 2 * family conversations share a head."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % how.replay
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % how.family).alias("head_id"))
    sizes = convs.select(F.col("conv_id").alias("hc"), F.col("own").alias("head_size"))
    convs = convs.join(sizes, F.col("head_id") == F.col("hc"), "left").withColumn("taken", F.least("h", F.coalesce("head_size", F.lit(0)))).drop("hc", "head_size", "own")
    convs = materialize(convs, "convs")
    short = turns.filter(F.col("pos") < how.replay - 1).withColumnRenamed("conv_id", "from")
    head = short.join(convs, (F.col("from") == F.col("head_id")) & (F.col("pos") < F.col("taken"))).select("conv_id", "pos", "t1", "t2", "n_chars")
    moved = convs.select(F.col("conv_id").alias("c"), "h", "taken")
    own = turns.join(moved, (F.col("conv_id") == F.col("c")) & (F.col("pos") >= F.col("h"))).select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "n_chars")
    return convs.select("conv_id"), head.unionByName(own)


def prefixes(turns: DataFrame, how: Trie = Trie()) -> DataFrame:
    """conv_id, depth, n_chars, p1, p2 (the sequence up to this turn), q1, q2 (up to the turn before), last (whether no turn follows)."""
    rows = turns.select(
        "conv_id",
        (F.col("pos") + 1).alias("depth"),
        "n_chars",
        F.floor(F.col("pos") / how.block).alias("b"),
        *[F.xxhash64(F.lit(seed), "pos", "t1", "t2").alias(f"x{seed}") for seed in (1, 2)],
    )
    upto = Window.partitionBy("conv_id", "b").orderBy("depth")
    running = upto.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "conv_id",
        "depth",
        "n_chars",
        "b",
        "x1",
        "x2",
        *[F.bit_xor(f"x{i}").over(running).alias(f"p{i}") for i in (1, 2)],
        F.lead("depth").over(upto).isNull().alias("closes"),  # its block
    )
    rows = materialize(rows, "blocks")
    blocks = rows.filter("closes").select("conv_id", "b", "p1", "p2")
    earlier = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("b").alias("cb"),
        *[F.coalesce(F.bit_xor(f"p{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in (1, 2)],
        (F.col("b") == F.max("b").over(Window.partitionBy("conv_id"))).alias("top"),
    )
    joined = rows.join(tops, (F.col("conv_id") == F.col("c")) & (F.col("b") == F.col("cb")))
    p = [F.col(f"p{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)]
    out = joined.select(
        "conv_id",
        "depth",
        "n_chars",
        p[0].alias("p1"),
        p[1].alias("p2"),
        p[0].bitwiseXOR(F.col("x1")).alias("q1"),
        p[1].bitwiseXOR(F.col("x2")).alias("q2"),
        (F.col("top") & F.col("closes")).alias("last"),
    )
    out = materialize(out, "prefixes")
    drop_table(rows)
    return out


def build(convs: DataFrame, turns: DataFrame, how: Trie = Trie()) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_chars, open) and the ends of the shared ones (node_conv_id, depth, conv_id).

    convs: conv_id of every conversation, also of those without turns. turns: conv_id, pos, t1, t2, n_chars."""
    rows = prefixes(turns, how)
    empty = convs.join(turns.select(F.col("conv_id").alias("c")).distinct(), F.col("conv_id") == F.col("c"), "left_anti")
    zero = lambda *names: [F.lit(0).cast("long").alias(x) for x in names]
    roots = convs.select("conv_id", *zero("depth", "n_chars", "p1", "p2", "q1", "q2"), F.lit(False).alias("last"))
    found = rows.unionByName(roots).groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    found = materialize(found, "nodes")
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("kd"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"), F.bit_xor("conv_id").alias("open"))
    same = (F.col("depth") == F.col("kd")) & (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2"))
    nodes = found.join(children, same, "left").drop("kd", "k1", "k2").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("open", F.coalesce("open", F.lit(0)))
    parents = found.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("pd"), F.col("p1").alias("pp1"), F.col("p2").alias("pp2"))
    up = (F.col("depth") - 1 == F.col("pd")) & (F.col("q1") == F.col("pp1")) & (F.col("q2") == F.col("pp2"))
    nodes = nodes.join(parents, up, "left").drop("pd", "pp1", "pp2", "q1", "q2")
    nodes = materialize(nodes, "linked")
    drop_table(found)
    # Where a node has one member, that is its end if any is.
    shared = nodes.filter("n_convs > 1").select(F.col("conv_id").alias("node_conv_id"), F.col("depth").alias("nd"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
    lasts = rows.filter("last").select("conv_id", "depth", "p1", "p2").unionByName(empty.select("conv_id", *zero("depth", "p1", "p2")))
    ends = lasts.join(shared, (F.col("depth") == F.col("nd")) & (F.col("p1") == F.col("n1")) & (F.col("p2") == F.col("n2"))).select("node_conv_id", "depth", "conv_id")
    return nodes.drop("p1", "p2"), ends


def _round(state: DataFrame, finished: DataFrame, number: int) -> DataFrame:
    """One round. state: conv_id, depth, parent_conv_id, k (open children), open (XOR of their names; for k = 1 the one waited for, at depth wait_depth), leaves, saved,
    done_at (the last round, for nodes that finished in it, else null). finished: all finished nodes; one that waits may find its target among the older ones,
    since it takes over a target from a node that finishes at the same time."""
    fresh = state.filter(F.col("done_at").isNotNull() & F.col("parent_conv_id").isNotNull())
    sent = fresh.groupBy(F.col("parent_conv_id").alias("mc"), (F.col("depth") - 1).alias("md")).agg(
        F.count("*").alias("m_k"), F.bit_xor("conv_id").alias("m_open"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved")
    )
    zero = F.lit(0).cast("long")
    seen = state.filter("done_at is null").select("conv_id", "depth", "k", "open", "wait_depth", "leaves", "saved")
    seen = seen.unionByName(finished.select("conv_id", "depth", *[zero.alias(c) for c in ("k", "open", "wait_depth")], "leaves", "saved"))
    target = seen.select(F.col("conv_id").alias("wc"), F.col("depth").alias("wd"), *[F.col(c).alias(f"w_{c}") for c in ("k", "open", "wait_depth", "leaves", "saved")])
    live = state.filter("done_at is null")
    # Nodes with more open children than one take messages.
    busy = live.filter("k > 1").join(sent, (F.col("conv_id") == F.col("mc")) & (F.col("depth") == F.col("md")), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = F.col("k") - none("m_k")
    busy = busy.select(
        "conv_id", "depth", "parent_conv_id", left.alias("k"), F.col("open").bitwiseXOR(none("m_open")).alias("open"), "wait_depth",
        (F.col("leaves") + none("m_leaves")).alias("leaves"), (F.col("saved") + none("m_saved")).alias("saved"), F.when(left == 0, F.lit(number)).alias("done_at"),
    )
    # Nodes with one look at what they wait for. It is finished, or waits for one child as well, or has several open ones.
    chain = live.filter("k = 1").join(target, (F.col("open") == F.col("wc")) & (F.col("wait_depth") == F.col("wd")))
    done, jump = F.col("w_k") == 0, F.col("w_k") == 1
    gain = done | jump
    chain = chain.select(
        "conv_id", "depth", "parent_conv_id", F.when(done, 0).otherwise(F.col("k")).alias("k"), F.when(jump, F.col("w_open")).otherwise(F.col("open")).alias("open"),
        F.when(jump, F.col("w_wait_depth")).otherwise(F.col("wait_depth")).alias("wait_depth"),
        (F.col("leaves") + F.when(gain, F.col("w_leaves")).otherwise(0)).alias("leaves"), (F.col("saved") + F.when(gain, F.col("w_saved")).otherwise(0)).alias("saved"),
        F.when(done, F.lit(number)).alias("done_at"),
    )
    return busy.unionByName(chain)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens for nodes with several members. nodes: as from build()."""
    own = (F.col("n_convs") - 1) * F.col("n_chars")
    long = lambda x: F.lit(x).cast("long")
    # A node of one member counts as one leaf that saves nothing, whatever its length; of them only those below shared nodes are needed.
    parents = nodes.filter("n_convs > 1 and n_children > 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("d"))
    tips = nodes.filter("n_convs = 1").join(parents, (F.col("parent_conv_id") == F.col("c")) & (F.col("depth") - 1 == F.col("d"))).drop("c", "d")
    single = tips.select("conv_id", "depth", "parent_conv_id", long(0).alias("k"), long(0).alias("open"), (F.col("depth") + 1).alias("wait_depth"), long(1).alias("leaves"), long(0).alias("saved"), F.lit(0).alias("done_at"))
    shared = nodes.filter("n_convs > 1").select(
        "conv_id", "depth", "parent_conv_id", F.col("n_children").alias("k"), "open", (F.col("depth") + 1).alias("wait_depth"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), own.alias("saved"), F.when(F.col("n_children") == 0, F.lit(0)).alias("done_at"),
    )
    state = materialize(single.unionByName(shared), "round0")
    columns = ("conv_id", "depth", "leaves", "saved")
    tips = state.filter("done_at = 0").select(*columns)
    finished, number, older = [], 0, None
    while state.filter("done_at is null").limit(1).count():
        number += 1
        known = tips
        for more in finished:
            known = known.unionByName(more)
        before, state = state, materialize(_round(state, known, number), f"round{number}")
        finished.append(materialize(state.filter(F.col("done_at") == number).select(*columns), "finished"))
        if older is not None:
            drop_table(older)
        older = before if number > 1 else None  # the first holds the tips
    out = shared.filter("done_at = 0").select(*columns)
    for more in finished:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})


def ends_digests(ends: DataFrame) -> DataFrame:
    """node_conv_id, depth, ends_sha256: the hash of each node's ends, ascending and joined by commas."""
    small_batches(ends.sparkSession)
    pieces = ends.groupBy("node_conv_id", "depth", F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    pieces = pieces.repartition("node_conv_id", "depth").sortWithinPartitions("node_conv_id", "depth", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def emit() -> pa.RecordBatch:
            rows = list(zip(*out)) or [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.string()))], names=["node_conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv_id, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (conv_id, depth):
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (conv_id, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield emit()
        if key is not None:
            out.append((*key, digest.hexdigest()))
            yield emit()

    return pieces.mapInArrow(run, "node_conv_id long, depth long, ends_sha256 string")


def with_totals(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    totals = subtree_totals(nodes).withColumnsRenamed({"conv_id": "tc", "depth": "td"})
    digests = ends_digests(ends).withColumnsRenamed({"node_conv_id": "ec", "depth": "ed"})
    key = lambda c, d: (F.col("conv_id") == F.col(c)) & (F.col("depth") == F.col(d))
    shared = nodes.filter("n_convs > 1").join(totals, key("tc", "td")).join(digests, key("ec", "ed"), "left")
    single = nodes.filter("n_convs = 1").withColumn("n_leaves", F.lit(1).cast("long")).withColumn("saved_tokens", F.lit(0).cast("long"))
    alone = F.when(F.col("n_children") == 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA)
    out = lambda df, sha: df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
    return out(shared, F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).unionByName(out(single, alone))


def prefix_trie(turns: DataFrame, how: Trie = Trie()) -> DataFrame:
    """The trie of the conversations as they are."""
    rows = placed(turns, how)
    return with_totals(*build(rows.select("conv_id").distinct(), rows, how))


def replayed_trie(turns: DataFrame, how: Trie = Trie()) -> DataFrame:
    """The trie of the conversations that share replayed heads."""
    rows = placed(turns, how)
    convs, again = replayed(rows, how)
    again = materialize(again, "replayed")
    drop_table(rows)
    return with_totals(*build(convs, again, how))

