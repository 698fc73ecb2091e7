"""Prefix trie of conversations: shards of sorted paths finish their own nodes, a skeleton of splitter paths the rest.

A turn is 16 bytes of the SHA-256 of its role and text, a conversation's path its turns one after another, so that
paths sorted as bytes are the trie in depth-first order, an ancestor before its descendants. Splitters, taken from a
sample of (path, conversation), cut this order into shards of about equal size. A node whose members lie in two shards is
a prefix of the splitter between them; so the trie of the splitters' paths, which is broadcast, holds every node that a
shard can't finish by itself. A shard goes once over its sorted rows with a stack of open nodes, finishes all others,
and gives partial sums for the skeleton's nodes. Those are added up over the shards; the skeleton's own subtree sums are
differences of running totals in its depth-first order.

Copies of one conversation are ordered by its key, so a group of any size is cut into shards like other rows; the keys
of conversations that end in a skeleton node travel as packed blocks, and are hashed in order as a stream. Sampling and
the number of shards decide where work is done, never a result.

Null roles and texts are empty ones, rows without a conversation's key belong to none. Turns are ordered by turn (null
first), role and then hash, so ties and repeated rows have one order. A conversation is one row of 24 bytes a turn,
whatever the length of its texts. An empty table has no nodes, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.operators.ids import dense_ids, running_totals
from scriptline.plans.model import checked_broadcast
from scriptline.session import written

TURN = 16
#: A table of so many bytes of paths is one shard; shards of more grow in number by the power 2/3, and in size.
SHARD_BYTES = 32 << 10
#: Rows of the sample for each shard, and turns of a splitter: what the sort of the splitters and the broadcast can take.
SAMPLES, SPLITTER_TURNS = 24, 1024
#: Bytes of all splitters together; there are fewer shards where they would take more.
SPLITTER_BYTES = 64 << 20
#: Keys in a packed block.
BLOCK = 8192

_EMPTY = hashlib.sha256(b"").hexdigest()
_LOCAL = "shard int, seq long, skeleton int, parent int, last int, below int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, size long, ends binary"


def paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, keys, sizes): hash (32 hexadecimal digits) and bytes of text of every turn, in order."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.substring(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * TURN)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), role_.alias("role"), key.alias("key"), F.octet_length(text_).cast("long").alias("size")).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


class Skeleton:
    """The trie of the splitters' paths. Nodes are numbered depth first; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.children: dict[tuple[int, bytes], int] = {}
        self.parent, self.last, self.below = [-1], [0], [0]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), TURN):
                turn = (node, path[at : at + TURN])
                if turn not in self.children:
                    self.children[turn] = len(self.parent)
                    self.parent.append(node)
                    self.last.append(0)
                    self.below.append(0)
                    self.below[node] += 1
                node = self.children[turn]
        for node in range(len(self.parent) - 1, -1, -1):
            self.last[node] = max(self.last[node], node)
            if node:
                self.last[self.parent[node]] = max(self.last[self.parent[node]], self.last[node])


class _Open:
    """A node whose members are being read."""

    __slots__ = ("skeleton", "size", "least", "count", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size
        self.least, self.count, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = array("q") if skeleton >= 0 else None
        self.waiting: list[tuple] = []  # finished children, until this node's least key is known


class _Shard:
    """One pass over the sorted rows of a shard."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton, self.rows, self.seq = shard, skeleton, [], 0
        self.path, self.stack = b"", [_Open(0, 0)]

    def add(self, path: bytes, conv: int, sizes: np.ndarray) -> None:
        if path != self.path:
            shared, most = 0, min(len(path), len(self.path))
            while shared < most and path[shared : shared + TURN] == self.path[shared : shared + TURN]:
                shared += TURN
            self.close(shared // TURN)
            for at in range(shared, len(path), TURN):
                above = self.stack[-1].skeleton
                node = self.skeleton.children.get((above, path[at : at + TURN]), -1) if above >= 0 else -1
                self.stack.append(_Open(node, int(sizes[at // TURN])))
            self.path = path
        node = self.stack[-1]
        node.count += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.skeleton >= 0:
            node.ends.append(conv)
            if len(node.ends) == BLOCK:
                self.partial(node, len(self.stack) - 1, 0, None)
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv)
        else:
            node.ends.update(b",%d" % conv)

    def partial(self, node: _Open, depth: int, count: int, least: int | None) -> None:
        s, i = self.skeleton, node.skeleton
        raw = np.frombuffer(node.ends, np.int64).astype("<i8").tobytes()
        self.rows.append((self.shard, self.seq, i, s.parent[i], s.last[i], s.below[i], least, depth, None, count, node.children, node.leaves, node.saved, None, node.size, raw))
        self.seq += 1
        node.ends, node.children, node.leaves, node.saved = array("q"), 0, 0, 0

    def close(self, depth: int) -> None:
        """Finish the open nodes below ``depth``."""
        while len(self.stack) - 1 > depth:
            at, node = len(self.stack) - 1, self.stack.pop()
            above = self.stack[-1]
            above.count += node.count
            above.least = node.least if above.least is None else min(above.least, node.least)
            if node.skeleton >= 0:
                self.partial(node, at, node.count, node.least)
                continue
            for child in node.waiting:
                self.rows.append((*child[:8], node.least, *child[9:]))
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.count - 1) * node.size
            ends = node.ends.hexdigest() if node.ends is not None else _EMPTY
            row = (self.shard, None, None, above.skeleton, None, None, node.least, at, None, node.count, node.children, leaves, saved, ends, None, None)
            (self.rows if above.skeleton >= 0 else above.waiting).append(row)
            above.children += 1
            above.leaves += leaves
            above.saved += saved

    def end(self) -> None:
        self.close(0)
        self.partial(self.stack[0], 0, self.stack[0].count, self.stack[0].least)


_FIELDS = [f.split() for f in _LOCAL.split(", ")]
_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in _FIELDS])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _splitters(rows: DataFrame, shard_bytes: int) -> list[tuple[bytes, int]]:
    """Borders (path, conv_id) between shards, from a sample by the hash of the key."""
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("path") + 8 * F.size("sizes"))).first()
    number = math.ceil(((size or 0) / shard_bytes) ** (2 / 3))
    if number < 2:
        return []
    share = min(1.0, SAMPLES * number / count)
    short = F.substring("path", 1, TURN * SPLITTER_TURNS).alias("path")
    chosen = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(short, "conv_id")
    ranked = dense_ids(chosen, [F.col("path"), F.col("conv_id")], "rank")
    sampled, weight = ranked.agg(F.count(F.lit(1)), F.sum(F.octet_length("path"))).first()
    number = min(number, sampled, max(2, int(SPLITTER_BYTES / max(1, (weight or 0) / max(1, sampled)))))
    if number < 2:
        return []
    # The rank of border i is ceil(i * sampled / number): the first row of the i-th of ``number`` equal parts.
    part = F.floor(F.col("rank") * number / sampled)
    borders = ranked.where((F.col("rank") > 0) & (part != F.floor((F.col("rank") - 1) * number / sampled)))
    return sorted((bytes(r.path), r.conv_id) for r in borders.select("path", "conv_id").collect())


def nodes(conversations: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``conversations`` is (conv_id, keys, sizes), each conversation once. conv_id is the least key of a node's members;
    saved_tokens adds up, over the subtree, the bytes of each node's last text times its members but one;
    ends_sha256 is the hash of the keys of those that end in the node.
    """
    spark = conversations.sparkSession
    rows = written(conversations.select("conv_id", F.unhex(F.array_join("keys", "")).alias("path"), "sizes"), "trie_paths")
    splitters = _splitters(rows, shard_bytes)
    shared = spark.sparkContext.broadcast(splitters)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            yield batch.append_column("shard", pa.array([bisect_right(shared.value, k) for k in keys], pa.int32()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton, shard = Skeleton(shared.value), None
        for batch in batches:
            sizes = batch.column("sizes")
            flat, at = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_numpy()
            columns = (batch.column(n).to_pylist() for n in ("shard", "path", "conv_id"))
            for i, (number, path, conv) in enumerate(zip(*columns, strict=True)):
                if shard is None or shard.shard != number:
                    if shard is not None:
                        shard.end()
                        yield _batch(shard.rows)
                    shard = _Shard(number, skeleton)
                shard.add(path, conv, flat[at[i] : at[i + 1]])
                if len(shard.rows) >= BLOCK:
                    yield _batch(shard.rows)
                    shard.rows = []
        if shard is not None:
            shard.end()
            yield _batch(shard.rows)

    dealt = rows.mapInArrow(route, "conv_id long, path binary, sizes array<long>, shard int")
    dealt = dealt.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = written(dealt.mapInArrow(walk, _LOCAL), "trie_nodes")
    top = _reduced(found.where(F.col("skeleton").isNotNull()))
    least = top.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = found.where(F.col("skeleton").isNull()).join(checked_broadcast(least, least.count()), "parent", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*columns).unionByName(top.select(*columns))


def _reduced(partial: DataFrame) -> DataFrame:
    """The skeleton's nodes from the partial sums of the shards."""
    summed = partial.groupBy("skeleton").agg(
        *(F.max(c).alias(c) for c in ("parent", "last", "below", "depth", "size")),
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    summed = summed.withColumn("n_children", F.col("n_children") + F.col("below"))
    own = summed.withColumn("leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    own = own.withColumn("saved", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).drop("n_leaves", "saved_tokens")
    for weight in ("leaves", "saved"):
        own = running_totals(own, [F.col("skeleton")], weight, f"{weight}_before")
    own = written(own, "trie_skeleton")
    until = own.select(
        F.col("skeleton").alias("last"),
        (F.col("leaves_before") + F.col("leaves")).alias("leaves_until"),
        (F.col("saved_before") + F.col("saved")).alias("saved_until"),
    )
    above = own.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    blocks = partial.where(F.octet_length("ends") > 0).select("skeleton", "shard", "seq", "ends")
    ends = blocks.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq").mapInArrow(_hashed, "skeleton int, ends_sha256 string")
    return written(
        own.join(until, "last")
        .join(above, "parent", "left")
        .join(ends, "skeleton", "left")
        .select(
            "skeleton",
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("leaves_until") - F.col("leaves_before")).alias("n_leaves"),
            (F.col("saved_until") - F.col("saved_before")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        ),
        "trie_top",
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's keys, block by block: nothing but a state of the hash is held."""
    node, state = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for i, raw in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            keys = ",".join(map(str, np.frombuffer(raw, "<i8").tolist())).encode()
            if i != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = i, hashlib.sha256(keys)
            else:
                state.update(b"," + keys)
    if state is not None:
        done.append((node, state.hexdigest()))
    names = ["skeleton", "ends_sha256"]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.int32()), pa.array([h for _, h in done], pa.string())], names)
