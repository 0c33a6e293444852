"""Prefix trie of conversations: every distinct sequence of first turns is a node with sums over its subtree.

A conversation is its path: one 24-byte element per turn (16 bytes of a SHA-256 of role and text, the number of UTF-8
bytes of the text). Paths are sorted into shards by splitters taken from a sample of them. A node whose members lie in
more than one shard is a prefix of a splitter, so the trie of the splitters' paths (the skeleton) is broadcast: each task
walks its sorted shard with a stack and finishes all other nodes by itself; for skeleton nodes it gives partial sums,
which are reduced, completed up the skeleton and joined back to the nodes whose parent is in it.

Bounds: the skeleton has at most `skeleton_bytes` of elements (fewer shards are made where the paths are that long). A
task holds the open nodes of one path, and those children of the open nodes that wait for their parent's least member,
all from its own shard. Copies of one conversation may be spread over shards: their ids are hashed in order afterwards.

Turns are ordered by number (null first), equal numbers by role and digest. Null roles and texts are empty. Repeated
turns each count. Rows without conv_id belong to no conversation and are left out. Other columns are not read. An empty
table has no nodes. Long texts leave their row as a digest only.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import stored

ELEMENT, BASE, LONGEST_HEAD = 24, 5, 9
CHUNK = 1 << 16
NO_ENDS = hashlib.sha256(b"").digest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, element) of every turn with an id."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    element = F.unhex(F.concat(F.substring(name, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")))
    return conversations.select(F.col("`conv_id`").cast("bigint").alias("conv_id"), F.col("`turn`").cast("bigint").alias("turn"), role.alias("role"), element.alias("element")).filter("conv_id IS NOT NULL")


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation as it is."""
    ordered = turns_of(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "element")
    return ordered.select("conv_id", "element").mapInArrow(lambda batches: _paths(batches, shared=False), "conv_id bigint, path binary")


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation c rebuilt: the first h turns of conversation c - c % 5, then c's own turns
    after its first h, with h = crc32(c) % 9. The five conversations of a base lie in one task, the base first."""
    turns = turns_of(conversations).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(BASE)))
    ordered = turns.repartition("base").sortWithinPartitions("base", "conv_id", F.asc_nulls_first("turn"), "role", "element")
    return ordered.select("conv_id", "element").mapInArrow(lambda batches: _paths(batches, shared=True), "conv_id bigint, path binary")


def _paths(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[pa.RecordBatch]:
    conv, own = None, bytearray()
    base, head = None, b""
    done: list[tuple[int, bytes]] = []

    def close() -> None:
        nonlocal base, head
        if conv is None:
            return
        if not shared:
            done.append((conv, bytes(own)))
            return
        if conv % BASE == 0:
            base, head = conv, bytes(own[: LONGEST_HEAD * ELEMENT])
        h = zlib.crc32(str(conv).encode()) % 9 * ELEMENT
        first = head if base == conv - conv % BASE else b""
        done.append((conv, first[:h] + bytes(own[h:])))

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([p for _, p in done], pa.binary())], names=["conv_id", "path"])
        done.clear()
        return out

    for rows in batches:
        for c, element in zip(rows.column("conv_id").to_pylist(), rows.column("element").to_pylist(), strict=True):
            if c != conv:
                close()
                conv, own = c, bytearray()
            own += element
        if done:
            yield batch()
    close()
    yield batch()


class Skeleton:
    """Trie of the splitters' paths; node 0 is the root, parents stand before their children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.element = [-1], [0], [b"\0" * ELEMENT]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), ELEMENT):
                element = path[at : at + ELEMENT]
                if (node, element) not in self.child:
                    self.child[node, element] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.element.append(element)
                node = self.child[node, element]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def completed(self, partial: dict[int, tuple[int, int, int, int, int]]) -> list[tuple]:
        """Nodes (number, conv_id, depth, parent's conv_id, members, children, leaves, saved) from the sums that the
        shards gave for each: least member, members, children, leaves, saved."""
        total = [list(partial[i]) for i in range(len(self.parent))]
        for i in range(len(total) - 1, -1, -1):
            conv, n, children, leaves, saved = total[i]
            leaves = leaves if children else 1
            saved += (n - 1) * int.from_bytes(self.element[i][16:], "big")
            total[i] = [conv, n, children, leaves, saved]
            if i:
                up = total[self.parent[i]]
                up[:] = [conv if up[0] is None else min(conv, up[0]), up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved]
        return [(i, t[0], self.depth[i], total[self.parent[i]][0] if i else None, *t[1:]) for i, t in enumerate(total)]


def splitters_of(paths: DataFrame, shards: int, skeleton_bytes: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 splitters (path, conv_id) of about equal distance in a sample of about 32 paths a shard."""
    n = paths.count()
    every = max(1, n // (32 * shards))
    some = paths.filter((F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0) & (F.octet_length("path") <= skeleton_bytes // shards))
    sample = sorted((bytes(r.path), r.conv_id) for r in some.toLocalIterator())
    found = [sample[len(sample) * k // shards] for k in range(1, shards)] if sample else []
    return sorted(set(found))


@dataclass
class Node:
    element: bytes
    skeleton: int
    least: int | None = None
    members: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: object = None
    ids: list = field(default_factory=list)  # of a skeleton node, not yet given out
    waiting: list = field(default_factory=list)  # finished children that lack this node's least member


PARTS = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, parent_node int, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, digest binary, "
    "node int, shard int, seq bigint, ids binary"
)


def shard_nodes(batches: Iterator[pa.RecordBatch], skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    """Finished nodes, partial sums of skeleton nodes and the ids that end in them, from rows in order of shard, path and id."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in PARTS.split(", ")]
    out: list[tuple] = []
    stack: list[Node] = []
    shard, path, seq = None, b"", 0

    def give_ids(node: Node) -> None:
        nonlocal seq
        if node.ids:
            out.append((*[None] * 9, node.skeleton, shard, seq, b",".join(node.ids)))
            seq += 1
            node.ids = []

    def close() -> None:
        node = stack.pop()
        if node.skeleton >= 0:
            give_ids(node)
            out.append((node.least, None, None, None, node.members, node.children, node.leaves, node.saved, None, node.skeleton, shard, None, None))
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.members - 1) * int.from_bytes(node.element[16:], "big")
        out.extend((*row[:2], node.least, *row[3:]) for row in node.waiting)
        row = (node.least, len(stack), None, None, node.members, node.children, leaves, saved, node.ends.digest() if node.ends else None, None, None, None, None)
        up = stack[-1]
        up.least = node.least if up.least is None else min(up.least, node.least)
        up.members += node.members
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.skeleton >= 0:
            out.append((*row[:3], up.skeleton, *row[4:]))
        else:
            up.waiting.append(row)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(types), types, strict=True)], names=names)
        out.clear()
        return made

    for rows in batches:
        for s, conv, p in zip(rows.column("shard").to_pylist(), rows.column("conv_id").to_pylist(), rows.column("path").to_pylist(), strict=True):
            if s != shard:
                while stack:
                    close()
                shard, path, seq = s, b"", 0
                stack.append(Node(skeleton.element[0], 0))
            same = 0
            while same < len(p) and p[same : same + ELEMENT] == path[same : same + ELEMENT]:
                same += ELEMENT
            while len(stack) > same // ELEMENT + 1:
                close()
            for at in range(same, len(p), ELEMENT):
                element = p[at : at + ELEMENT]
                stack.append(Node(element, skeleton.child.get((stack[-1].skeleton, element), -1) if stack[-1].skeleton >= 0 else -1))
            path = p
            node = stack[-1]
            node.members += 1
            node.least = conv if node.least is None else min(conv, node.least)
            name = str(conv).encode()
            if node.skeleton >= 0:
                node.ids.append(name)
                if len(node.ids) >= CHUNK // 16:
                    give_ids(node)
            elif node.ends is None:
                node.ends = hashlib.sha256(name)
            else:
                node.ends.update(b"," + name)
            if len(out) > 1 << 14:
                yield batch()
    while stack:
        close()
    yield batch()


def id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's ids, which come in order; only the running hash is held."""
    node, state = None, None
    done: list[tuple[int, bytes]] = []
    for rows in batches:
        for number, ids in zip(rows.column("node").to_pylist(), rows.column("ids").to_pylist(), strict=True):
            if number != node:
                if node is not None:
                    done.append((node, state.digest()))
                node, state = number, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if node is not None:
        done.append((node, state.digest()))
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int32()), pa.array([d for _, d in done], pa.binary())], names=["node", "digest"])


def trie(paths: DataFrame, shards: int | None = None, skeleton_bytes: int = 1 << 25) -> DataFrame:
    """Nodes of (conv_id, path) rows: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_digest (SHA-256 of the ids that end here, ascending, comma-joined)."""
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    skeleton = Skeleton(splitters_of(paths, shards, skeleton_bytes))
    table = spark.sparkContext.broadcast(skeleton)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            where = [table.value.shard(p, c) for p, c in zip(rows.column("path").to_pylist(), rows.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(where, pa.int32())], names=["conv_id", "path", "shard"])

    sharded = paths.mapInArrow(dealt, "conv_id bigint, path binary, shard int").repartitionById(len(skeleton.splitters) + 1, F.col("shard"))
    parts = stored(sharded.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(lambda batches: shard_nodes(batches, table.value), PARTS), "trie-parts")
    sums = parts.filter("node IS NOT NULL AND ids IS NULL").groupBy("node").agg(F.min("conv_id").alias("c"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    partial = {r.node: (r.c, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in sums.collect()}  # at most the skeleton's nodes
    done = skeleton.completed({i: partial.get(i, (None, 0, 0, 0, 0)) for i in range(len(skeleton.parent))}) if partial else []
    top = spark.createDataFrame(done, "node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")
    ids = parts.filter("ids IS NOT NULL").select("node", "shard", "seq", "ids").repartition("node").sortWithinPartitions("node", "shard", "seq").select("node", "ids")
    upper = top.join(ids.mapInArrow(id_digests, "node int, digest binary"), "node", "left")
    parents = F.broadcast(top.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_parent")))
    lower = parts.filter("node IS NULL").join(parents, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "digest")
    return upper.select(*columns).unionAll(lower.select(*columns)).withColumn("ends_digest", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest")
