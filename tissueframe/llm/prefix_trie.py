"""The trie of shared conversation prefixes, with totals of its subtrees by time-forward processing.

A node is a distinct sequence of the first d turns (role and text) of a conversation; the root is the empty one. The
smallest conversation that starts so and d name a node, as a conversation has one node of each depth.

1. Turns get positions; a prefix is told by 128 bits, exclusive sums of hashes of position and content. Both are made in
   two levels, over stretches of ``STRETCH`` turns, so a conversation of any length is not one task's.
2. One aggregation makes the nodes, with partial sums before its shuffle, and one join names their parents.
3. Nodes are sorted by name and cut into shards, ranges of bounded size. A shard's nodes come in reverse level order, by
   Spark's external sort, and each sends its totals to its parent through a priority queue that spills: children before
   parents, so every message is there when its node is read.
4. Nodes whose parent lies in another shard are shard roots. What a shard alone makes of them goes up the tree of shard
   roots by pointer doubling, in as many rounds as the logarithm of its depth. A last pass through the shards takes the
   finished totals of the roots beneath as messages.

A queue's spilled runs are unnamed scratch files of one task, like those of Spark's own sorts; nothing else reads them.

Edge cases: null roles and texts count as empty; null turns come first; turns that share a number come in an order of
their content. Rows without a conversation id belong to none. Conversations without turns are members of the root. An
empty table has no node. Repeated rows are turns of their own; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace
from .common import arrow_map, whole_key

#: Turns in a stretch; nodes in a shard, on average; messages that a queue holds in memory, and reads of a run at a time.
STRETCH, SHARD_NODES, QUEUE_ROWS, RUN_ROWS = 1024, 1 << 18, 1 << 18, 1 << 13
LEAST = -(1 << 63)


def positions(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, c1, c2, bytes``: each turn's place in its conversation from 1, 128 bits of its content, and the length
    of its text in UTF-8."""
    whole_key(df, key)
    whole_key(df, turn)
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.xxhash64(*said).alias("c1"), F.xxhash64(F.lit(1), *said).alias("c2"), F.octet_length(said[1]).cast("long").alias("bytes"),
        F.coalesce(F.floor(F.col(turn) / STRETCH).cast("long"), F.lit(LEAST)).alias("part"),
    )
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("c"))
    parts = parts.select("conv", "part", (F.sum("c").over(W.partitionBy("conv").orderBy("part")) - F.col("c")).alias("before"))
    within = F.row_number().over(W.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "c1", "c2"))
    return rows.withColumn("pos", within).join(parts, ["conv", "part"]).select("conv", (F.col("pos") + F.col("before")).alias("pos"), "c1", "c2", "bytes")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, h1, h2, p1, p2, bytes``: each prefix and its parent as 128 bits; the empty one is zero."""
    rows = turns.select("conv", "pos", "bytes", F.xxhash64("pos", "c1").alias("x1"), F.xxhash64("c2", "pos").alias("x2"), F.expr(f"pos div {STRETCH}").alias("part"))
    parts = rows.groupBy("conv", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("conv", "part", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    within = W.partitionBy("conv", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.withColumns({f"w{i}": F.bit_xor(f"x{i}").over(within) for i in (1, 2)}).join(parts, ["conv", "part"])
    out = sums.withColumns({f"h{i}": F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    return out.select("conv", F.col("pos").cast("long").alias("depth"), "h1", "h2", *[F.col(f"h{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "bytes")


# --- time-forward processing -------------------------------------------------------------------------

class _Run:
    """A sorted run of messages, read from its file piece by piece."""

    def __init__(self, rows: np.ndarray, file=None) -> None:
        self.rows, self.file = rows, file

    def take(self, upto: int) -> Iterator[np.ndarray]:
        while True:
            n = int(np.searchsorted(self.rows[:, 0], upto, "right"))
            yield self.rows[:n]
            self.rows, width = self.rows[n:], self.rows.shape[1]
            if len(self.rows) or self.file is None:
                return
            self.rows = np.frombuffer(self.file.read(RUN_ROWS * width * 8), np.int64).reshape(-1, width)
            if not len(self.rows):
                self.file = None
                return


class SpillingQueue:
    """Messages to nodes of the next level, taken in the order of keys once that level begins. Beyond ``limit`` rows they
    are sorted and written to an unnamed file of the task."""

    def __init__(self, width: int, limit: int = QUEUE_ROWS) -> None:
        self.width, self.limit, self.spilled = width, limit, 0
        self.held: list[np.ndarray] = []
        self.rows, self.runs, self.open = 0, [], []

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate([np.empty((0, self.width + 1), np.int64), *self.held])
        self.held, self.rows = [], 0
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def push(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.held.append(np.stack([keys, *values], 1))
        self.rows += len(keys)
        if self.rows >= self.limit:
            file = tempfile.TemporaryFile()
            file.write(self._sorted().tobytes())
            file.seek(0)
            self.runs.append(_Run(np.empty((0, self.width + 1), np.int64), file))
            self.spilled += 1

    def next_level(self) -> None:
        self.open, self.runs = [*self.runs, _Run(self._sorted())], []

    def pull(self, upto: int) -> np.ndarray:
        """The messages of this level to keys up to one, by key."""
        rows = np.concatenate([np.empty((0, self.width + 1), np.int64), *(x for run in self.open for x in run.take(upto))])
        return rows[np.argsort(rows[:, 0], kind="stable")]


def _levels(batches: Iterator[pa.RecordBatch], queue: SpillingQueue) -> Iterator[dict[str, np.ndarray]]:
    """The rows in pieces of one shard and level; the queue moves on with them."""
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        cuts = np.flatnonzero((np.diff(col["shard"]) != 0) | (np.diff(col["depth"]) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if at != (at := (int(col["shard"][a]), int(col["depth"][a]))):
                queue.next_level()
            yield {n: c[a:b] for n, c in col.items()}


def send_up(batches: Iterator[pa.RecordBatch], roots_only: bool, limit: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows ``shard, depth, conv, parent, own, inside, leaves, saved`` by shard, depth (falling) and conv: nodes of the
    shard (``own``), ``inside`` if their parent is in it too, with what they save themselves; and children that lie in
    other shards, with their totals. Gives ``conv, depth, n_children, n_leaves, saved_tokens`` of nodes, or of shard roots."""
    queue = SpillingQueue(3, limit)
    for rows in _levels(batches, queue):
        own = rows["own"]
        conv, leaves, saved = rows["conv"], rows["leaves"].copy(), rows["saved"].copy()
        children = np.zeros(len(conv), np.int64)
        got = queue.pull(int(conv[-1]))
        to = np.searchsorted(conv, got[:, 0])
        for total, column in ((children, 1), (leaves, 2), (saved, 3)):
            np.add.at(total, to, got[:, column])
        leaves[own & (children == 0)] = 1
        up = ~own | rows["inside"]
        queue.push(rows["parent"][up], np.ones(int(up.sum()), np.int64), leaves[up], saved[up])
        out = own & ~rows["inside"] if roots_only else own
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (conv, rows["depth"], children, leaves, saved)], ["conv", "depth", "n_children", "n_leaves", "saved_tokens"])


def send_down(batches: Iterator[pa.RecordBatch], limit: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows by shard, depth (rising) and parent: for each child that lies in another shard, the shard root above
    it, ``conv, depth, root_conv, root_depth``."""
    queue, last, before = SpillingQueue(2, limit), np.empty((0, 3), np.int64), None
    for rows in _levels(batches, queue):
        here = (rows["shard"][0], rows["depth"][0])
        if here != before:  # messages of a level without rows after it have no reader
            last = last[:0]
            if before is None or (before[0], before[1] + 1) != here:
                queue.open = []
            before = here
        parent, own = rows["parent"], rows["own"]
        got = np.concatenate([last, queue.pull(int(parent[-1]))])
        last = got[got[:, 0] == parent[-1]]
        label = np.stack([rows["conv"], rows["depth"]], 1)
        under = ~own | rows["inside"]
        label[under] = got[np.searchsorted(got[:, 0], parent[under])][:, 1:]
        queue.push(rows["conv"][own], label[own, 0], label[own, 1])
        yield pa.RecordBatch.from_arrays([pa.array(x[~own]) for x in (rows["conv"], rows["depth"], label[:, 0], label[:, 1])], ["conv", "depth", "root_conv", "root_depth"])


def _shard_of(conv: np.ndarray, depth: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The shard of each name: the last whose first name isn't greater."""
    values = np.unique([c for c, _ in bounds])

    def place(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, c)
        equal = values[np.minimum(at, len(values) - 1)] == c
        return ((2 * at + equal) << 40) + np.where(equal, d, 0)

    first = place(np.array([c for c, _ in bounds]), np.array([d for _, d in bounds]))
    return np.searchsorted(first, place(conv, depth), "right") - 1


def subtree_totals(nodes: DataFrame, work: Workspace, shards: int | None = None) -> DataFrame:
    """``conv, depth, n_children, n_leaves, saved_tokens`` of ``nodes(conv, depth, parent, saves)``: children, childless
    nodes of the subtree and the sum of ``saves`` over it. ``parent`` names the parent's conv, null for the root; a
    parent's name comes before its child's."""
    spark = nodes.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // SHARD_NODES))
    cut = work.write(nodes.repartitionByRange(shards, "conv", "depth").withColumn("shard", F.spark_partition_id()))
    firsts = cut.groupBy("shard").agg(F.min(F.struct("conv", "depth")).alias("first")).orderBy("shard").collect()  # a row for each shard
    numbers, bounds = np.array([r.shard for r in firsts], np.int64), [(r.first.conv, r.first.depth) for r in firsts]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = batch.column("parent").is_null().to_numpy(zero_copy_only=False)
            parent = batch.column("parent").fill_null(0)
            above = numbers[np.maximum(_shard_of(parent.to_numpy(), batch.column("depth").to_numpy() - 1, bounds), 0)]
            above = np.where(root, -1, above)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "depth")), parent, batch.column("saves"), batch.column("shard"), pa.array(above)], ["conv", "depth", "parent", "saves", "shard", "above"])

    placed = work.write(arrow_map(cut.select("conv", "depth", "parent", "saves", F.col("shard").cast("long").alias("shard")), locate, "conv long, depth long, parent long, saves long, shard long, above long"))
    own = placed.select("shard", "depth", "conv", "parent", F.lit(True).alias("own"), F.expr("above = shard").alias("inside"), F.lit(0).cast("long").alias("leaves"), F.col("saves").alias("saved"))
    cross = placed.filter("above >= 0 AND above <> shard").select(F.col("above").alias("shard"), "depth", "conv", "parent", F.lit(False).alias("own"), F.lit(False).alias("inside"))
    schema = "conv long, depth long, n_children long, n_leaves long, saved_tokens long"

    def up(rows: DataFrame, roots_only: bool) -> DataFrame:
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "conv")
        return arrow_map(rows, lambda batches: send_up(batches, roots_only), schema)

    zero = F.lit(0).cast("long")
    open_ = own.unionByName(cross.withColumns({"leaves": zero, "saved": zero}))
    if cross.isEmpty():
        return up(own, False)
    roots = up(open_, True)
    labels = arrow_map(open_.repartition("shard").sortWithinPartitions("shard", "depth", "parent"), send_down, "conv long, depth long, root_conv long, root_depth long")
    total = _root_totals(roots.join(labels, ["conv", "depth"], "left").select("conv", "depth", "root_conv", "root_depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), work)
    return up(own.unionByName(cross.join(total, ["conv", "depth"]).select(own.columns)), False)


def _root_totals(roots: DataFrame, work: Workspace) -> DataFrame:
    """``conv, depth, leaves, saved``: sums over what lies beneath each shard root in their tree. A round adds what stands
    2^k steps below and doubles the steps."""
    state = work.write(roots)
    while not state.filter("root_conv IS NOT NULL").isEmpty():
        linked = state.filter("root_conv IS NOT NULL")
        below = linked.groupBy(F.col("root_conv").alias("conv"), F.col("root_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = linked.select(F.col("conv").alias("root_conv"), F.col("depth").alias("root_depth"), F.col("root_conv").alias("to_conv"), F.col("root_depth").alias("to_depth"))
        step = state.join(below, ["conv", "depth"], "left").join(jump, ["root_conv", "root_depth"], "left")
        old, state = state, work.write(step.select("conv", "depth", F.col("to_conv").alias("root_conv"), F.col("to_depth").alias("root_depth"), *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))]))
        work.drop(old)
    return state.select("conv", "depth", "leaves", "saved")


# --- the trie ----------------------------------------------------------------------------------------

def _digests(ends: DataFrame) -> DataFrame:
    """``depth, h1, h2, ends_sha256``: a digest of the sorted conversations that end in a node, read as a stream."""
    keys = ["depth", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([int(x)]) for x in at), pa.array([digest.hexdigest()])], [*keys, "ends_sha256"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            conv = batch.column("conv").to_numpy()
            cuts = (np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()
            done = []
            for a, b in zip([0, *cuts], [*cuts, len(k)]):
                new, text = tuple(k[a].tolist()), ",".join(map(str, conv[a:b].tolist())).encode()
                if new != at:
                    if at is not None:
                        done.append(row())
                    at, digest = new, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if at is not None:
            yield row()

    return arrow_map(ends.repartition(*keys).sortWithinPartitions(*keys, "conv"), run, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of ``turns(conv, pos, c1, c2, bytes)``, as ``positions`` gives them, over the conversations ``convs(conv)``,
    distinct, which may have no turn: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    work = Workspace(turns.sparkSession)
    convs = work.write(convs.select("conv"))
    prefixes = work.write(_prefixes(turns))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0")
    root = root.select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv", "n", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"))
    nodes = prefixes.groupBy("depth", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("p1", "p2", "bytes")])
    nodes = work.write(nodes.unionByName(root))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("parent"))
    named = work.write(nodes.join(above, ["depth", "p1", "p2"], "left").select("conv", "depth", "parent", "n", "h1", "h2", ((F.col("n") - 1) * F.col("bytes")).alias("saves")))
    work.drop(nodes)

    last = prefixes.groupBy("conv").agg(F.max(F.struct("depth", "h1", "h2")).alias("e"))
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(f"e.{c}", zero).alias(c) for c in ("depth", "h1", "h2")])
    totals = subtree_totals(named.select("conv", "depth", "parent", "saves"), work)
    out = named.join(_digests(ends), ["depth", "h1", "h2"], "left").join(totals, ["conv", "depth"])
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
