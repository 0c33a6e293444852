"""Exact repeated passages from a sparse suffix array over the cluster.

1. `sampled`: a document's suffixes are retained at minimiser places: the least fingerprint of `k` words among `window`
   neighbours. The window is chosen so that every stretch of `min_words` words that occurs twice has a retained place in
   common with at least `PREFIX` equal words after it. Which of its places stands for a stretch depends on the stretch
   alone, so each stretch belongs to one suffix, at a known distance (`back`) before its place.
2. Suffixes whose first PREFIX words (the block) occur only once are dropped; no repeat can begin with them.
3. `contexts`: the others get the words after the block and the words before the place, as far as they are needed.
4. The suffixes are sorted by block and following words, and neighbours in this order are compared and extended to the
   left: this gives the long matches. A neighbour has the longest common part to the right only; so, for every distance,
   the stretches of a block's suffixes are compared by their fingerprints too, which leaves none out.
5. Both occurrences are reported; overlapping reports of a document are merged, which restores repeats of any length.

Suffixes are partitioned by block, so all candidates of a match meet. A block with more than `SPLIT` suffixes is dealt
over several partitions by a hash of the document. There each partition hands on one occurrence of each of its stretches,
and these are compared once more by fingerprint, at most one a partition: nothing is lost by the dealing.
Words are compared by 32-bit fingerprints, blocks and stretches by 64-bit ones.

Null, empty and short texts have no repeats. Rows equal in id and text are occurrences of their own and reported once.
Null ids stay null; an empty table gives no rows; other columns are not read. Of several other places with equally long
matches any may be named. A very long text is read whole by one task, as words of four bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import distinct_texts, row_key, stored, text_chunks, texts_of
from tabloom.llm.pretokens import mixed
from tabloom.llm.spans import merged
from tabloom.llm.words import Words, minimizer_places, minimizers, window_hashes

#: Words that neighbours must have in common from the retained place on.
PREFIX = 24
#: Words after the block that are kept: the next retained place of a longer match is at most window + PREFIX words on.
FOLLOWING = 32
#: Suffixes of a block that one task takes; more at sizes where over MAX_HOT blocks would be larger.
SPLIT = 10_000
MAX_HOT = 1_000_000
#: Suffixes that a task compares at a time, and those of the block that ends there.
STEP = 1 << 15


def sampled(docs: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """(num, key, block, at, near, far): a stored row per document with its retained places, the fingerprints of their blocks
    and how many words before the place the stretches begin for which it stands: near to far, none if near > far."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num = TaskContext.get().partitionId() << 33
        for batch in batches:
            for keys, texts in text_chunks(iter([batch.rename_columns(["doc_id", "text"])]), 1 << 19):
                words = Words(texts)
                blocks, places, near, far = [], [], [], []
                for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                    values = window_hashes(words.hashes[a:b], k)
                    stands = minimizer_places(values, window)[: max(b - a - min_words + 1, 0)]  # for the stretch from each word on
                    at = minimizers(values, window)
                    at = at[at + PREFIX <= b - a]
                    blocks.append(window_hashes(words.hashes[a:b], PREFIX)[at].view(np.int64))
                    places.append(at)
                    far.append(at - np.searchsorted(stands, at))
                    near.append(at - np.searchsorted(stands, at, side="right") + 1)
                bounds = pa.array(np.append(0, np.cumsum([len(x) for x in places])).astype(np.int32))
                kinds = ((blocks, np.int64), (places, np.int32), (near, np.int32), (far, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(num, num + len(keys))), pa.array(keys, pa.binary()), *(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).astype(t))) for x, t in kinds)],
                    names=["num", "key", "block", "at", "near", "far"],
                )
                num += len(keys)

    rows = docs.withColumn("key", row_key()).select("key", "text")
    return stored(rows.mapInArrow(find, "num bigint, key binary, block array<bigint>, at array<int>, near array<int>, far array<int>"), "suffixes", compression="zstd")


def contexts(docs: DataFrame, table: DataFrame, before: int) -> DataFrame:
    """(block, part, hot, following, leading, num, at, near, far) of the suffixes whose block occurs more than once. `following`
    has the words after the block, `leading` those before the place from right to left, both big-endian 32-bit."""
    rows = table.select("num", F.explode(F.arrays_zip("block", "at", "near", "far")).alias("s")).select("num", "s.*")
    often = stored(rows.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-blocks", compression="zstd")
    split = max(SPLIT, (often.agg(F.sum("n")).first()[0] or 0) // MAX_HOT)
    hot = F.broadcast(often.filter(F.col("n") > split).withColumn("hot", F.lit(True)))  # at most MAX_HOT blocks
    marked = rows.join(hot, "block", "left")
    part = F.pmod(F.xxhash64("num"), F.lit(1) + F.floor(F.col("n") / split))
    dealt = marked.filter("hot").withColumn("part", part).drop("n")
    few = marked.filter("hot IS NULL").drop("n", "hot").join(often.filter(F.col("n") <= split).select("block"), "block").withColumns({"hot": F.lit(False), "part": F.lit(0).cast("bigint")})
    lists = dealt.unionByName(few).groupBy("num").agg(F.collect_list(F.struct("at", "block", "part", "hot", "near", "far")).alias("suffixes"))
    wanted = stored(lists.join(table.select("num", "key"), "num"), "suffix-places", compression="zstd")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, text, suffixes in zip(batch.column("num").to_pylist(), batch.column("text"), batch.column("suffixes"), strict=True):
                words = Words([text.as_py()]).hashes.astype(">u4").tobytes()
                fields = suffixes.values
                places = fields.field("at").to_pylist()
                # of the words before a place only their order is turned
                leading = [np.frombuffer(words[4 * max(p - before, 0) : 4 * p], dtype=">u4")[::-1].tobytes() for p in places]
                yield pa.RecordBatch.from_arrays([
                    fields.field("block"), fields.field("part"), fields.field("hot"), pa.array([words[4 * (p + PREFIX) : 4 * (p + PREFIX + FOLLOWING)] for p in places], pa.binary()), pa.array(leading, pa.binary()),
                    pa.array([num] * len(places), pa.int64()), pa.array(places, pa.int64()), fields.field("near"), fields.field("far"),
                ], names=["block", "part", "hot", "following", "leading", "num", "at", "near", "far"])

    texts = distinct_texts(docs.withColumn("key", row_key()), wanted.select("key"))
    joined = wanted.join(texts, "key").select("num", "text", "suffixes")
    return joined.mapInArrow(cut, "block bigint, part bigint, hot boolean, following binary, leading binary, num bigint, at bigint, near int, far int")


def word_matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of strings as rows, filled up with zeros, and their numbers."""
    sizes = np.array([len(v) // 4 for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(v[: 4 * width].ljust(4 * width, b"\0") for v in values), dtype=">u4").reshape(-1, width).astype(np.uint64), np.minimum(sizes, width)


def prefix_hashes(words: np.ndarray, multiplier: int) -> np.ndarray:
    """Fingerprints of the first 0, 1, 2 ... words of each row."""
    out = np.zeros((len(words), words.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            out[:, i + 1] = mixed(out[:, i] * np.uint64(multiplier) + words[:, i] + np.uint64(1))
    return out


def common_counts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Equal leading words of each row and the next."""
    differ = words[1:] != words[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


FOUND = "stretch bigint, num bigint, start bigint, end bigint, other_num bigint, other_start bigint"


def compare(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Matches (stretch is null) among sorted suffixes; of hot blocks also one place (end is null) of each stretch."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size < STEP:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        block, part = rows.column("block").to_numpy(), rows.column("part").to_numpy()
        new = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]))
        if len(new):
            stop = int(new[-1]) + 1
            yield matches(rows.slice(0, stop), min_words)
            rows = rows.slice(stop).combine_chunks()
        waiting, size = rows.to_batches(), rows.num_rows
    if size:
        yield matches(pa.Table.from_batches(waiting), min_words)


def matches(rows: pa.Table, min_words: int) -> pa.RecordBatch:
    block, part, hot, num, at, near, far = (rows.column(c).to_numpy() for c in ("block", "part", "hot", "num", "at", "near", "far"))
    after, before = min_words - PREFIX, min_words - PREFIX
    following, n_following = word_matrix(rows.column("following").to_pylist(), FOLLOWING)
    leading, n_leading = word_matrix(rows.column("leading").to_pylist(), before)
    out: list[tuple[np.ndarray, ...]] = []
    covered = np.zeros((len(num), 4), dtype=np.int64)  # matches with the row before and with the next
    # neighbours in the order of the suffixes
    right, left = PREFIX + common_counts(following, n_following), common_counts(leading, n_leading)
    i = np.flatnonzero((block[1:] == block[:-1]) & (part[1:] == part[:-1]) & (left + right >= min_words))
    for x, y, c in ((i + 1, i, 0), (i, i + 1, 2)):
        out.append((np.zeros(len(i), dtype=np.int64), num[x], at[x] - left[i], at[x] + right[i], num[y], at[y] - left[i]))
        covered[x, c], covered[x, c + 1] = at[x] - left[i], at[x] + right[i]
    # stretches that begin `back` words before the place
    ahead, behind = prefix_hashes(following[:, :after], 0x9E3779B97F4A7C15), prefix_hashes(leading, 0xC2B2AE3D27D4EB4F)
    for back in range(before + 1):
        j = np.flatnonzero((near <= back) & (back <= far))
        with np.errstate(over="ignore"):
            key = mixed(block[j].view(np.uint64) + mixed(ahead[j, after - back] + mixed(behind[j, back] + np.uint64(back))))
        order = np.lexsort((part[j], key))
        j, key = j[order], key[order]
        same = (key[1:] == key[:-1]) & (part[j[1:]] == part[j[:-1]])
        member = np.append(False, same) | np.append(same, False)
        other = np.arange(len(j)) + np.where(np.append(False, same), -1, 1)
        start = at[j] - back
        known = ((covered[j, 0] <= start) & (start + min_words <= covered[j, 1])) | ((covered[j, 2] <= start) & (start + min_words <= covered[j, 3]))
        m = np.flatnonzero(member & ~known)
        out.append((np.zeros(len(m), dtype=np.int64), num[j[m]], start[m], start[m] + min_words, num[j[other[m]]], start[other[m]]))
        one = np.flatnonzero(~np.append(False, same) & hot[j])
        out.append((key[one].view(np.int64), num[j[one]], start[one], np.full(len(one), -1), start[one], start[one]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    single = columns[3] < 0
    arrays = [pa.array(c, pa.int64(), mask=m) for c, m in zip(columns, (~single, None, None, single, single, single), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])


def meet(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Matches among the single places of stretches, sorted by stretch."""
    last = (None, None, None)
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("stretch", "num", "start")], strict=True):
            if row[0] == last[0]:
                out += [(None, x[1], x[2], x[2] + min_words, y[1], y[2]) for x, y in ((row, last), (last, row))]
            last = row
        names = [c.split()[0] for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)


def repeats(docs: DataFrame, k: int = 8, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, start, end, other_key, other_id, other_start): passages of at least `min_words` words that occur at
    more than one place, merged per document, with one of the other places of the longest match in them."""
    docs = texts_of(docs, id_col, text_col)
    before = min_words - PREFIX
    table = sampled(docs, k, before + 1, min_words)
    suffixes = contexts(docs, table, before).repartition("block", "part").sortWithinPartitions("block", "part", "following", "num", "at")
    compared = stored(suffixes.mapInArrow(lambda batches: compare(batches, min_words), FOUND), "suffix-matches", compression="zstd")
    singles = compared.filter("stretch IS NOT NULL").select("stretch", "num", "start").repartition("stretch").sortWithinPartitions("stretch", "num", "start")
    spans = compared.filter("stretch IS NULL").unionAll(singles.mapInArrow(lambda batches: meet(batches, min_words), FOUND)).drop("stretch")
    found = merged(spans, "num")
    ids = docs.withColumn("key", row_key()).select("key", "doc_id").distinct()
    names = stored(table.select("num", "key").join(ids, "key"), "numbers")
    named = found.join(names, "num").join(names.select(F.col("num").alias("other_num"), F.col("key").alias("other_key"), F.col("doc_id").alias("other_id")), "other_num")
    return named.select("key", "doc_id", "start", "end", "other_key", "other_id", "other_start").dropDuplicates(["key", "start", "end"])
