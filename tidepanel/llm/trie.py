"""Prefix trie of conversations by time-forward processing: nodes in reverse level order send subtree totals to their parents through a
priority queue that spills, first within shards, then across shard roots."""
from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import keep, table

#: a node with more members than this, or than one in SHARDS of all conversations, is settled after the shards; its lighter children are
#: shard roots. There are at most (rows / HEAVY) + (SHARDS x turns of a conversation) such nodes
HEAVY, SHARDS = 10_000, 256
#: messages that a queue holds in memory; more are written to sorted runs in the task's own scratch space
QUEUE = 200_000


class SpillingQueue:
    """Messages (key, ...) in ascending order of key. Keys put in are never below one already taken out."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def put(self, message: tuple) -> None:
        if len(self.heap) >= self.limit:
            self._spill()
        heapq.heappush(self.heap, message)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for m in sorted(self.heap):
            pickle.dump(m, file, protocol=5)
        file.seek(0)
        self.heap = []
        self._next(file)

    def _next(self, file) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), id(file), file))
        except EOFError:
            file.close()

    def take(self, key) -> Iterator[tuple]:
        """All messages of this key, which is the least one still held, or none."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][0] == key:
            message, _, file = heapq.heappop(self.runs)
            self._next(file)
            yield message

    def close(self) -> None:
        for _, _, file in self.runs:
            file.close()


TOTALS = "depth int, k1 bigint, k2 bigint, p1 bigint, p2 bigint, n_children bigint, n_leaves bigint, saved bigint, is_root boolean"
_NAMES = [c.split()[0] for c in TOTALS.split(", ")]
_TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in TOTALS.split(", ")]


def time_forward(limit: int):
    """Function for mapInArrow over rows (s0, s1, s2, depth, k1, k2, p1, p2, own, n_children, n_leaves, saved) in order of the shard s0 to s2,
    depth descending, k1, k2: adds to each node what its children sent, gives it out, and sends its totals on to its parent.

    A shard is named by its root. The last three columns bring what came from other shards; ``own`` is the node's own share of ``saved``.
    What is for the parent of a shard root is not taken here, the caller sums it. Memory holds one batch and one queue."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(limit)
        for b in batches:
            out = []
            for s0, s1, s2, depth, k1, k2, p1, p2, own, children, leaves, saved in zip(*(c.to_pylist() for c in b.columns)):
                if (s0, s1, s2) != shard:
                    queue.close()
                    shard, queue = (s0, s1, s2), SpillingQueue(limit)
                for _, leaf, save in queue.take((-depth, k1, k2)):
                    children, leaves, saved = children + 1, leaves + leaf, saved + save
                leaves, saved = leaves if children else 1, saved + own
                is_root = (depth, k1, k2) == shard
                out.append((depth, k1, k2, p1, p2, children, leaves, saved, is_root))
                if not is_root:
                    queue.put(((1 - depth, p1, p2), leaves, saved))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
        queue.close()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, k1, k2, conv_id) sorted by all four -> depth, k1, k2 and the hash of the ids, read as a stream."""
    held, digest = None, None
    for b in batches:
        out = []
        rows = zip(*(c.to_pylist() for c in b.columns))
        for key, group in groupby(rows, lambda r: r[:3]):
            ids = ",".join(str(r[3]) for r in group)
            if key == held:
                digest.update(f",{ids}".encode())
                continue
            if held is not None:
                out.append((*held, digest.hexdigest()))
            held, digest = key, hashlib.sha256(ids.encode())
        if out:
            yield _end_rows(out)
    if held is not None:
        yield _end_rows([(*held, digest.hexdigest())])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    d, k1, k2, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha)], names=["depth", "k1", "k2", "ends_sha256"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 0), role, text: by turn, null first, then role and text. Null role or text becomes empty; rows without
    conv_id belong to no conversation; repeated rows are turns of their own."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), "turn", text("role"), text("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    return rows.select("conv_id", place.alias("i"), "role", "text")


def prefix_trie(turns: DataFrame, members: DataFrame, heavy: int | None = None, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie of turn sequences: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: conv_id, i (0, 1, ... without gaps in each conversation), role, text. members: conv_id of all conversations, each once, those
    without a turn included; they are members of the root (depth 0) only. No conversation at all gives no node.

    A prefix is named by two exclusive ors of 64-bit hashes of (place, role, text), a running aggregate; equal names at one depth are one
    node. Members are counted by partial sums. A node with more than ``heavy`` members is heavy (default: see HEAVY); there are at most rows / heavy of
    them, so a first turn that many conversations share is cut into many shards. Every other node lies in the shard of its topmost ancestor that is not heavy. Each shard is one sorted stream; the totals of shard
    roots are then summed per heavy parent, and the heavy nodes are one more stream.
    """
    # one row per turn: the names of the prefix that ends with it and of the prefix before
    past = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "i", F.octet_length("text").cast("bigint").alias("bytes"),
                        *(F.xxhash64(F.lit(s), "i", "role", "text").alias(f"x{s}") for s in (1, 2)))
    last = F.lead("i").over(Window.partitionBy("conv_id").orderBy("i")).isNull()
    rows = rows.select("conv_id", (F.col("i") + 1).cast("int").alias("depth"), "bytes", "x1", "x2", last.alias("last"),
                       *(F.bit_xor(f"x{s}").over(past).alias(f"k{s}") for s in (1, 2)))
    rows = keep(rows.select("conv_id", "depth", "bytes", "last", "k1", "k2", *(F.col(f"k{s}").bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s in (1, 2))))
    key = ["depth", "k1", "k2"]
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = top.select(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"))
    nodes = keep(nodes.unionByName(root))
    if heavy is None:
        everyone = nodes.where("depth = 0").select("n_convs").first()
        heavy = min(HEAVY, -(-everyone[0] // SHARDS)) if everyone else HEAVY
    big = keep(nodes.where((F.col("n_convs") > heavy) | (F.col("depth") == 0)))
    # a conversation's heavy prefixes are its first ones; the next is its shard root
    deep = rows.join(big.select(*key), key).groupBy("conv_id").agg(F.max("depth").alias("heavy"))
    light = rows.join(deep, "conv_id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0))).where("depth > heavy")
    at = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    shard = light.select("conv_id", *key, F.first(F.struct(*key)).over(at).alias("shard"))
    shard = shard.groupBy(*key).agg(F.first("shard").alias("shard"))
    own = ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")
    place = ["s0", "s1", "s2"]
    small = nodes.join(shard, key).select(*(F.col(f"shard.{k}").alias(s) for s, k in zip(place, key)), *key, "p1", "p2", own, *(zero.alias(c) for c in ("n_children", "n_leaves", "saved")))
    order = [*place, F.desc("depth"), "k1", "k2"]
    within = keep(small.repartition(*place).sortWithinPartitions(*order).mapInArrow(time_forward(queue), TOTALS))
    sent = within.where("is_root").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    total = lambda c: F.coalesce(c, zero).alias(c)
    across = big.join(sent, key, "left").select(F.lit(0).alias("s0"), zero.alias("s1"), zero.alias("s2"), *key, "p1", "p2", own, total("n_children"), total("n_leaves"), total("saved"))
    across = across.repartition(1).sortWithinPartitions(*order).mapInArrow(time_forward(queue), TOTALS)
    totals = within.union(across).select(*key, "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))
    last = rows.where("last").select(*key, "conv_id")
    bare = members.join(last.select("conv_id"), "conv_id", "left_anti").select(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    ends = last.unionByName(bare).repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(_ends, "depth int, k1 bigint, k2 bigint, ends_sha256 string")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, key).join(ends, key, "left").join(parent, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(turns: DataFrame, members: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, i, role, text of branching conversations: the first h turns of conversation c - c % ``every``, then c's own turns after
    its first h; h is crc32 of c in decimal, modulo ``most``. At most ``most`` - 1 turns of a conversation are copied, ``every`` times."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = members.select("conv_id", h.alias("h"), (F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(every))).alias("base"))
    lead = turns.where(F.col("i") < most - 1).select(F.col("conv_id").alias("base"), "i", "role", "text")
    lead = base.join(lead, "base").where("i < h").select("conv_id", "i", "role", "text")
    size = turns.where(F.col("i") < most - 1).groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("first"))
    place = base.join(size, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("first", F.lit(0))).alias("start"))
    tail = turns.join(place, "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("start")).cast("int").alias("i"), "role", "text")
    return lead.union(tail)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, over the whole table."""
    turns = keep(ordered_turns(table(spark, sf_dir, "conversations")))
    members = keep(turns.select("conv_id").distinct())
    return prefix_trie(rebuilt(turns, members), members)
