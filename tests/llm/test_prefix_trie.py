import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from tabloom.llm import prefix_trie
from tabloom.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def conversations(rows):
    """Turns of every conversation in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in found.items()}


def rebuilt(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = found.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(paths):
    members, ends, children = defaultdict(set), defaultdict(set), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            node = tuple(path[:d])
            members[node].add(c)
            if d:
                children[node[:-1]].add(node)
        ends[tuple(path)].add(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def rows_of(nodes):
    if "ends_digest" in nodes.columns:
        nodes = nodes.withColumn("ends_sha256", F.lower(F.hex("ends_digest")))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows, **more: spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(more) if rows else spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf, folder):
    where = sf.replace("sf0.001", folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_splitter_skeleton"](spark, where)) == brute(rebuilt(conversations(rows)))


def forest(n):
    """Shared openings, a hot first turn, many copies of one conversation, prefixes of others, and one long conversation."""
    rows = []
    for c in range(n):
        turns = [("user", "hello")] if c % 3 else [("user", f"opening {c % 7}")]
        if c % 4 == 0:
            turns += [("assistant", "same"), ("user", "copy")]
        else:
            turns += [("assistant", f"reply {c % 11} ñ"), ("user", f"more {c % 5}"), ("assistant", f"own {c}")][: c % 4]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    return rows + [(n, k, "user", f"turn {k // 3}") for k in range(400)]


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_any_number_of_shards(table, shards):
    rows = forest(300)
    nodes = prefix_trie.trie(prefix_trie.conversation_paths(table(rows)), shards=shards)
    assert rows_of(nodes) == brute(conversations(rows))


def test_rebuilt_conversations(table):
    rows = [r for r in forest(200) if r[0] % 10 != 5] + [(-c - 1, None, "x", "y") for c in range(12)]  # absent bases, negative ids
    assert rows_of(prefix_trie.trie(prefix_trie.rebuilt_paths(table(rows)), shards=9)) == brute(rebuilt(conversations(rows)))


def test_odd_rows_and_empty_tables(table):
    rows = [(1, 0, None, "a"), (1, 0, None, "a"), (2, None, "user", None), (2, 1, "user", ""), (3, 0, "us", "era"), (4, 0, "user", "a"), (None, 0, "user", "lost"), (7, 0, "user", "word " * 50000), (8, 0, "user", "word " * 50000)]
    got = prefix_trie.trie(prefix_trie.conversation_paths(table(rows, path=F.lit(1), node=F.lit("clash"), shard=F.lit(2))), shards=3)
    assert rows_of(got) == brute(conversations(rows))
    assert prefix_trie.trie(prefix_trie.rebuilt_paths(table([]))).count() == 0
    assert prefix_trie.trie(prefix_trie.conversation_paths(table([(None, 0, "user", "a")]))).count() == 0


def test_skeleton_is_bounded(table):
    paths = prefix_trie.conversation_paths(table(forest(300)))
    found = prefix_trie.splitters_of(paths, 20, 20 * 24 * 4)
    assert found and all(len(p) <= 24 * 4 for p, _ in found)
    assert rows_of(prefix_trie.trie(paths, shards=20, skeleton_bytes=20 * 24 * 2)) == brute(conversations(forest(300)))
