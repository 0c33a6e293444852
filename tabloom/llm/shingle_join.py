"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

A text is the set of its runs of `size` words (a shorter text is one run). Its signature has `trees` rows of `depth`
MinHash values. The matched prefix starts at the full depth and is shortened until texts of the wanted similarity meet
in at least one tree with the target recall: `shortest_prefix`. All texts that share such a prefix in a tree are the
members of a trie node, and every pair of members is compared:

1. `bundles`: a node's members are dealt into blocks of about `BLOCK`; each pair of blocks is a bundle of its own, so a
   hot node is spread over tasks. A pair is taken up in the first tree in which it meets, so it is in one bundle only,
   and left out if fewer of its MinHash values are equal than a pair of the wanted similarity has but with chance `MISS`.
2. `verified`: a bundle gets the texts that are in its pairs, each once, and compares their exact shingle sets. It gives
   the number of links of each text and the links of a spanning forest: a large group's links are counted, not emitted.

Equal texts are one text here (known by MD5) and share class and links. A class is a connected component of verified
links; its id is the least doc_id in it. Null texts and texts without words have no shingles, link to nothing and are
classes of their own; null ids are kept and lose to other ids; repeated rows each have their row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.llm.common import distinct_texts, first_of_partition, stored, text_chunks, texts_of
from tabloom.llm.components import connected
from tabloom.llm.words import Words, window_hashes

#: Members of a node that are compared with each other, or with another block's, in one bundle.
BLOCK = 256
#: Chance that the comparison of MinHash values leaves out a pair of exactly the wanted similarity.
MISS = 1e-9


def text_key() -> Column:
    """16 bytes for a text with words, null for others."""
    return F.when(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.unhex(F.md5("text")))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of `size` words of each text, and where each text's runs begin."""
    n = np.diff(words.bounds)
    last = np.repeat(words.bounds[1:], n)
    whole = window_hashes(words.hashes, size)
    fits = np.arange(len(words.hashes)) + size <= last
    flat = [whole[fits[: len(whole)]]]
    counts = np.where(n >= size, n - size + 1, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    if short.size:
        own = np.array([window_hashes(words.hashes[words.bounds[i] : words.bounds[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
        at = np.cumsum(counts)[short]
        flat = [np.insert(flat[0], at, own)]
        counts[short] = 1
    return flat[0], np.append(0, np.cumsum(counts))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: DataFrame, trees: int, depth: int, shortest: int, size: int) -> DataFrame:
    """(key, nodes, sketch), one row per different text: for each tree a 32-bit fingerprint of the first `shortest` MinHash
    values, and the lowest byte of all `trees * depth` values."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(trees * depth)
        for keys, values in text_chunks(first_of_partition(batches), 1 << 19):
            flat, bounds = shingles(Words(values), size)
            out = np.zeros((len(values), trees * depth), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k, factor in enumerate(factors):
                    out[:, k] = np.minimum.reduceat((flat * factor) >> np.uint64(32), bounds[:-1])
            paths = out.reshape(-1, trees, depth)[:, :, :shortest].reshape(-1, shortest).T
            nodes = np.zeros(paths.shape[1], dtype=np.uint64)
            for value in paths:
                nodes = window_hashes(np.stack([nodes, value], axis=1).ravel(), 2)[::2]
            nodes = (nodes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sketch = out.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * trees), pa.array(nodes)), pa.array([row.tobytes() for row in sketch], pa.binary()),
            ], names=["key", "nodes", "sketch"])

    signed = texts.select(F.col("key").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(sign, "key binary, nodes array<int>, sketch binary")
    return signed.dropDuplicates(["key"])


def shortest_prefix(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from the full depth down, with which two texts of this similarity meet in some tree with the recall."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def least_equal(similarity: float, values: int) -> int:
    """The largest number of equal MinHash values that a pair of this similarity falls short of with a chance of at most MISS."""
    below, n = 0.0, 0
    while n < values:
        below += math.comb(values, n) * similarity**n * (1 - similarity) ** (values - n)
        if below > MISS:
            break
        n += 1
    return n


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of a partition that is sorted by `by`."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
        at = 0
        for i in [*[i for i in range(batch.num_rows) if values[i] != (values[i - 1] if i else last)], batch.num_rows]:
            if i > at:
                waiting.append(batch.slice(at, i - at))
            if i < batch.num_rows and waiting:
                yield pa.Table.from_batches(waiting)
                waiting = []
            at = i
        last = values[-1]
    if waiting:
        yield pa.Table.from_batches(waiting)


def bundles(signed: DataFrame, similarity: float, trees: int, depth: int) -> DataFrame:
    """(bundle, place, key, pairs): the members of each bundle that are in a pair, numbered by place. The first member's row
    has all pairs, as places in little-endian unsigned 16-bit."""
    rows = signed.select("key", F.posexplode("nodes").alias("tree", "node"))
    sizes = rows.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = rows.join(sizes.select("tree", "node", "blocks"), ["tree", "node"]).join(signed, "key")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    blocks = members.withColumn("own", own).select(
        "tree", "node", "own", "key", "nodes", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    dealt = blocks.repartition("tree", "node", "low", "high").sortWithinPartitions("tree", "node", "low", "high", "key")
    least = least_equal(similarity, trees * depth)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["tree", "node", "low", "high"]):
            m = group.num_rows
            if m < 2:
                continue
            tree, node, low, high = (group.column(c)[0].as_py() for c in ("tree", "node", "low", "high"))
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(m, -1)
            met = np.array(group.column("nodes").to_pylist(), dtype=np.int32)[:, :tree]
            side = group.column("own").to_numpy()
            found = []
            for i in range(m - 1):
                near = ((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= least) & ~(met[i + 1 :] == met[i]).any(axis=1)
                if low != high:
                    near &= side[i + 1 :] != side[i]
                to = np.flatnonzero(near) + i + 1
                if len(to):
                    found.append(np.stack([np.full(len(to), i), to], axis=1))
            if found:
                used, pairs = np.unique(np.concatenate(found), return_inverse=True)
                keys = group.column("key").take(pa.array(used)).combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{tree}/{node}/{low}/{high}"] * len(used)), pa.array(np.arange(len(used), dtype=np.int32)), keys,
                    pa.array([pairs.astype("<u2").tobytes(), *[None] * (len(used) - 1)], pa.binary()),
                ], names=["bundle", "place", "key", "pairs"])

    wanted = dealt.select("tree", "node", "low", "high", "own", "key", "nodes", "sketch")
    return stored(wanted.mapInArrow(pair, "bundle string, place int, key binary, pairs binary"), "bundles", compression="zstd")


def verified(bundled: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, b, n) of the pairs whose exact Jaccard similarity is at least `similarity`: for each bundle links (a, b) that
    join the same texts as all its links, and rows without b that give the number of its links of the text a."""
    wanted = stored(distinct_texts(texts.filter("key IS NOT NULL"), bundled.select("key")), "pair-texts", compression="zstd")
    dealt = bundled.join(wanted, "key").select("bundle", "place", "key", "pairs", "text").repartition("bundle").sortWithinPartitions("bundle", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bundle"]):
            m = group.num_rows
            pairs = np.frombuffer(group.column("pairs")[0].as_py(), dtype="<u2").reshape(-1, 2).astype(np.int64)
            sets = []
            for at in range(0, m, 32):
                flat, bounds = shingles(Words(group.column("text").slice(at, 32).to_pylist()), size)
                sets += [np.unique(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = np.array([len(x) for x in sets])
            linked = np.zeros((m, m), dtype=bool)
            if m == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                linked[0, 1] = both / (sizes.sum() - both) >= similarity
            else:
                _, names = np.unique(np.concatenate(sets), return_inverse=True)
                bounds = np.cumsum(sizes) - sizes
                mark = np.zeros(len(names), dtype=bool)
                order = pairs[:, 0]  # pairs are sorted by their first place
                for i, fro, to in zip(*np.unique(order, return_index=True), np.append(np.flatnonzero(np.diff(order)) + 1, len(order)), strict=True):
                    own = names[bounds[i] : bounds[i] + sizes[i]]
                    mark[own] = True
                    with_i = pairs[fro:to, 1]
                    both = np.add.reduceat(mark[names], bounds, dtype=np.int64)[with_i]
                    mark[own] = False
                    linked[i, with_i] = both / (sizes[i] + sizes[with_i] - both) >= similarity
            linked |= linked.T
            degree = linked.sum(axis=1)
            keys = group.column("key").to_pylist()
            a, b, n = [keys[i] for i in np.flatnonzero(degree)], [None] * int((degree > 0).sum()), degree[degree > 0].tolist()
            left = degree > 0
            while left.any():
                root = int(left.argmax())
                left[root], reached = False, [root]
                while reached:
                    i = reached.pop()
                    for j in np.flatnonzero(linked[i] & left).tolist():
                        a.append(keys[i])
                        b.append(keys[j])
                        n.append(0)
                        reached.append(j)
                    left &= ~linked[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return dealt.mapInArrow(compare, "a binary, b binary, n bigint")


def links(docs: DataFrame, similarity: float = 0.8, size: int = 5, trees: int = 16, depth: int = 8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `verified` for different texts, known by their keys."""
    texts = texts_of(docs, id_col, text_col).withColumn("key", text_key())
    signed = stored(signatures(texts, trees, depth, shortest_prefix(similarity, trees, depth, recall), size), "signatures")
    return stored(verified(bundles(signed, similarity, trees, depth), texts, similarity, size), "links")


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """A stored row per different text: key, class_id, n_links (links to other texts), n_copies (its rows but one), chosen
    (it stands for the class: it has the class's least id)."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", text_key().alias("key"))
    found = links(docs, id_col=id_col, text_col=text_col, **settings)
    degree = found.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    texts = stored(
        rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
        .join(connected(found.filter("b IS NOT NULL")).withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
        .select("key", "least", "n_rows", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "text-roots")
    heads = texts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "key")).alias("head"))
    return stored(texts.join(heads, "root").select("key", "n_links", (F.col("n_rows") - 1).alias("n_copies"), F.col("head.least").alias("class_id"), (F.col("head.key") == F.col("key")).alias("chosen")), "text-classes")


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (links of its text to different texts), n_copies (other rows with its text)."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", text_key().alias("key"))
    return rows.join(text_classes(docs, id_col, text_col, **settings), "key", "left").select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def one_of_each(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) that stand for their class: one row per class, and every row
    without words."""
    classes = text_classes(docs, **settings).select(*[F.col(c).alias(f"_{c}") for c in ("key", "class_id", "n_copies", "chosen")])
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").select("row", "doc_id", text_key().alias("_own"))
    kept = rows.join(classes, rows["_own"] == classes["_key"], "left").filter("_own IS NULL OR (_chosen AND doc_id <=> _class_id)")
    alone, several = kept.filter("_own IS NULL OR _n_copies = 0"), kept.filter("_n_copies > 0")  # of copies only those with the class's id are left
    return alone.select("row.*").unionByName(several.dropDuplicates(["doc_id", "_own"]).select("row.*"))
