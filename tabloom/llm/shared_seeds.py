"""Seeds of texts that occur more than once, and links from each to its first and its previous occurrence.

Texts are kept in chunks of about CHUNK words (or one longer text): a stored table with one row per chunk, dealt into
buckets by chunk, so that a chunk's words never move. What moves is small and goes by ranges of fingerprints:

1. Each chunk offers its different short seeds as 40-bit fingerprints. A range of them tells each chunk which of its own
   others have too. A longer seed can stand in another chunk only if all short seeds inside it do.
2. The seeds that passed are sent exactly (64 bits), once per chunk, with the chunk's first and last place. A range answers
   with the first place of all and the last one in the chunk before.
3. Links inside a chunk are found there. So a seed costs at most one entry per chunk, however often it occurs.

Values are sorted, coded by differences and compressed. A task holds one chunk with its answers, or one range.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabloom.catalog.common import scratch
from tabloom.llm.common import row_key, stored, text_chunks
from tabloom.llm.pretokens import mixed
from tabloom.llm.words import Words, minimizers

CHUNK = 1 << 20
SHORT_BITS = 40
RANGE = 1 << 22  # words of the table for each range of fingerprints
FACTOR = 0x9E3779B97F4A7C15


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. The bytes of an array lie by significance, so that small numbers cost little."""
    arrays = [a.astype(a.dtype.newbyteorder("<"), copy=False) for a in arrays]
    head = ",".join(f"{a.dtype.str} {len(a)}" for a in arrays).encode() + b"\n"
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], decompressed_size=struct.unpack_from("<q", value)[0], codec="zstd", asbytes=True)
    at, out = raw.index(b"\n") + 1, []
    for kind, n in (x.split() for x in raw[: at - 1].decode().split(",")):
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * dtype.itemsize, offset=at)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def order_of(*keys: np.ndarray) -> np.ndarray:
    """Order by the first key, then the next ones; one sort where they fit into 63 bits."""
    spans = [int(k.max()) - int(k.min()) + 1 for k in keys] if len(keys[0]) else []
    if np.prod([float(s) for s in spans]) >= 2**62:
        return np.lexsort(keys[::-1])
    value = np.zeros(len(keys[0]), dtype=np.int64)
    for key, span in zip(keys, spans):
        value = value * span + (key - key.min())
    return np.argsort(value)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once: np.unique without its table of hashes, which is slow for many values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes below n, frequent ones first, and the codes as places in that order: mostly small numbers."""
    order = np.argsort(-np.bincount(codes, minlength=n))
    place = np.empty(n, dtype=np.uint32)
    place[order] = np.arange(n, dtype=np.uint32)
    return order, place[codes]


def least_places(values: np.ndarray, window: int, block: int = 1 << 15) -> np.ndarray:
    """For each place the last place of the least of the `window` values from it on (as far as there are any). In blocks that fit the cache."""
    out = np.empty(len(values), dtype=np.int64)
    for a in range(0, len(values), block):
        part = values[a : a + block + window - 1]
        best, least = np.arange(len(part)), part.copy()
        for i in range(1, min(window, len(part))):
            other = part[i:]
            less = np.flatnonzero(other <= least[: len(other)])
            least[less] = other[less]
            best[less] = less + i
        out[a : a + block] = best[:block] + a
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(base, keys, ids, words): rows are numbered in the order they are read, partition << 33 and up; base is the number of
    a chunk's first row. Stored, in buckets by base."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        keys, ids, hashes, sizes, n = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal base, n
            known, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            order, codes = by_frequency(codes, len(known))
            words = packed(np.concatenate(sizes), known[order], codes)
            out = pa.RecordBatch.from_arrays(
                [pa.array([base], pa.int64()), pa.array([keys], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.binary()), pa.array([len(codes)], pa.int64())],
                names=["base", "keys", "ids", "words", "n_words"])
            base, n = base + len(keys), 0
            for x in (keys, ids, hashes, sizes):
                x.clear()
            return out

        for batch in batches:
            own_keys, own_ids = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            for rows, texts in text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])]), 1 << 19):
                found = Words(texts)
                keys += [own_keys[i] for i in rows]
                ids += [own_ids[i] for i in rows]
                hashes.append(found.hashes)
                sizes.append(np.diff(found.bounds))
                n += len(found.hashes)
                if n >= CHUNK:
                    yield row()
        if keys:
            yield row()

    spark, name = docs.sparkSession, f"seed_chunks_{uuid.uuid4().hex}"
    rows = docs.withColumn("key", row_key()).select("key", "doc_id", "text").mapInArrow(gather, "base bigint, keys array<binary>, ids array<bigint>, words binary, n_words bigint")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").bucketBy(buckets, "base").option("compression", "uncompressed").option("path", scratch(spark, "seed-chunks")).saveAsTable(name)
    return spark.table(name)


class Chunk:
    """The words of a chunk's row: 64-bit fingerprints, and where each text begins."""

    def __init__(self, base: int, words: bytes):
        self.sizes, self.known, self.codes = unpacked(words)
        self.base = base
        self.bounds = np.append(0, np.cumsum(self.sizes))

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.known[self.codes]

    @cached_property
    def left(self) -> np.ndarray:
        """Words from each place to the end of its text."""
        return np.repeat(self.bounds[1:], self.sizes) - np.arange(len(self.codes))

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def windows(self, sizes: list[int]) -> Iterator[np.ndarray]:
        """Fingerprints of the windows of some rising sizes from each place on, in texts or across; the same as window_hashes."""
        have: dict[int, np.ndarray] = {1: self.hashes}

        def of(k: int) -> np.ndarray:
            if k not in have:
                a = max(x for x in have if x < k)
                b = k - a if k - a in have else max(x for x in have if x <= k - a)
                head, tail = have[a], have[b]
                n = max(len(self.hashes) - (a + b) + 1, 0)
                have[a + b] = head[:n] * np.uint64(pow(FACTOR, b, 1 << 64)) + tail[a : a + n]
                return have[k] if k in have else of(k)
            return have[k]

        for k in sizes:
            yield mixed(of(k))

    def seeds(self, levels: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, place in the chunk, words) of every text's minimisers for each (k, window) of `levels`."""
        seeds, at, size = [], [], []
        for (k, window), h in zip(levels, self.windows([k for k, _ in levels]), strict=True):
            fits = np.flatnonzero(self.left >= k)
            values = h[fits]
            if window == 1:
                places = np.arange(len(fits))
            else:
                # windows inside one text: its last place is as far ahead in fits as in the text
                full = np.flatnonzero(self.left[fits] - k + 1 >= window)
                places = least_places(values, window)[full]
                counts = np.maximum(np.diff(self.bounds) - k + 1, 0)
                begins = np.cumsum(counts) - counts
                few = np.flatnonzero((counts > 0) & (counts < window))
                short = [begins[d] + minimizers(values[begins[d] : begins[d] + counts[d]], window) for d in few]
                places = distinct(np.concatenate([places, *short]))
            seeds.append(values[places])
            at.append(fits[places])
            size.append(np.full(len(places), k, dtype=np.int8))
        return np.concatenate(seeds), np.concatenate(at), np.concatenate(size)

    def short(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where k words fit, and their short fingerprints."""
        fits = np.flatnonzero(self.left >= k)
        return fits, next(self.windows([k]))[fits] >> np.uint64(64 - SHORT_BITS)

    def passed(self, flags: list[bytes], k: int, seeds: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The seeds whose short seeds all stand in other chunks, with the order in which they are sent: by seed and place."""
        fits, short = self.short(k)
        if not len(fits):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        yes = np.concatenate([np.unpackbits(bits, count=n) for value in flags for bits, n in [_bits(value)]])
        order = np.argsort(short)
        rank = np.cumsum(np.append(False, np.diff(short[order].view(np.int64)) != 0))
        assert len(yes) == rank[-1] + 1, "the answers are not those of this chunk"
        alone = np.ones(len(self.hashes) + 1, dtype=np.int32)
        alone[fits[order]] = 1 - yes[rank]
        before = np.append(0, np.cumsum(alone))
        kept = np.flatnonzero(before[at + size.astype(np.int64) - k + 1] == before[at])
        own = kept[order_of_seeds(seeds[kept], at[kept])]
        new = np.ones(len(own), dtype=bool)
        new[1:] = seeds[own[1:]] != seeds[own[:-1]]
        return own, new


def ranked(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of small numbers below `top`, and the place of each value among them."""
    there = np.zeros(top, dtype=bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


def _bits(value: bytes) -> tuple[np.ndarray, int]:
    bits, n = unpacked(value)
    return bits, int(n[0])


def order_of_seeds(seeds: np.ndarray, at: np.ndarray) -> np.ndarray:
    order = np.argsort(seeds)
    s = seeds[order]
    group = np.cumsum(np.append(0, (s[1:] != s[:-1]).astype(np.int64))) if len(s) else np.zeros(0, dtype=np.int64)
    return order[order_of(group, at[order])]


def _parts(values: np.ndarray, bits: int, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted values of so many bits."""
    edges = np.searchsorted(values, np.array([-(-(i << bits) // ranges) for i in range(1, ranges)], dtype=np.uint64))
    edges = np.concatenate([[0], edges, [len(values)]])
    return [(i, int(edges[i]), int(edges[i + 1])) for i in np.flatnonzero(np.diff(edges))]


def _rows(names: str, *columns: list) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "base": pa.int64(), "other": pa.int64(), "kind": pa.int32(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names.split(), columns, strict=True)], names=names.split())


def linked(table: DataFrame, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    """(base, kind, part, payload): what each chunk needs to link its seeds; read by `links`."""
    k = levels[0][0]
    total = table.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(total // RANGE, min(24, total // (1 << 17) + 1))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, words in zip(batch.column("base").to_pylist(), batch.column("words")):
                short = distinct(Chunk(base, words.as_py()).short(k)[1])
                parts = _parts(short, SHORT_BITS, ranges)
                yield _rows("part base payload", [p for p, _, _ in parts], [base] * len(parts), [packed(np.diff(short[a:b], prepend=np.uint64(0))) for _, a, b in parts])

    def several(rows: pa.Table) -> pa.Table:
        each = [np.cumsum(unpacked(p.as_py())[0], dtype=np.uint64) for p in rows.column("payload")]
        both = np.sort(np.concatenate(each))
        both = np.append(both[1:][both[1:] == both[:-1]], np.uint64(1 << 63))
        flags = [packed(np.packbits(both[np.searchsorted(both, x)] == x), np.array([len(x)])) for x in each]
        return pa.table({"base": rows.column("base"), "kind": pa.array([0] * len(each), pa.int32()), "part": rows.column("part"), "payload": pa.array(flags, pa.binary())})

    schema = "base bigint, kind int, part int, payload binary"
    offers = table.select("base", "words").mapInArrow(offer, "part int, base bigint, payload binary")
    flags = stored(offers.groupBy("part").applyInArrow(several, schema), "shared-short-seeds", compression="uncompressed")

    def send(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for base, words in zip(chunk.column("base").to_pylist(), chunk.column("words")):
            own = Chunk(base, words.as_py())
            seeds, at, size = own.seeds(levels)
            order, new = own.passed(answered(answers, 0), k, seeds, at, size)
            first, last = order[new], order[np.append(new[1:], True)] if len(order) else order
            values = seeds[first]
            for part, a, b in _parts(values, 64, ranges):
                f, t = at[first[a:b]], at[last[a:b]]
                twice = f != t
                places = [x.astype(np.int32) for p in (f, t[twice]) for x in (own.doc[p], p - own.bounds[own.doc[p]])]
                for column, v in zip(out, (part, base, packed(np.diff(values[a:b], prepend=np.uint64(0)), np.packbits(twice), *places)), strict=True):
                    column.append(v)
        return pa.Table.from_batches([_rows("part base payload", *out)])

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("base")
        bases = rows.column("base").to_numpy()
        seeds, chunk, first, last = [], [], [], []
        for i, payload in enumerate(rows.column("payload")):
            steps, twice, doc, at, last_doc, last_at = unpacked(payload.as_py())
            seeds.append(np.cumsum(steps, dtype=np.uint64))
            chunk.append(np.full(len(steps), i))
            f = np.stack([doc, at]).astype(np.int64)
            t = f.copy()
            t[:, np.unpackbits(twice, count=len(steps)).astype(bool)] = [last_doc, last_at]
            first.append(f)
            last.append(t)
        sizes = [len(x) for x in seeds]
        seeds, chunk, first, last = np.concatenate(seeds), np.concatenate(chunk), np.concatenate(first, axis=1), np.concatenate(last, axis=1)
        order = order_of_seeds(seeds, chunk)
        new = np.ones(len(order), dtype=bool)
        new[1:] = seeds[order[1:]] != seeds[order[:-1]]
        start = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.zeros(len(order), dtype=bool)
        heads, before = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        later[order] = ~new
        heads[order] = start
        before[order[1:]] = order[:-1]
        out, lo = [], 0
        for n in sizes:
            yes = np.flatnonzero(later[lo : lo + n]) + lo
            a, b = heads[yes], before[yes]
            used, code = ranked(chunk[np.append(a, b)], len(bases))
            c, d = code[: len(a)].astype(np.int32), code[len(a) :].astype(np.int32)
            out.append(packed(np.packbits(later[lo : lo + n]), np.array([n]), np.diff(bases[used], prepend=0), c, *first[:, a].astype(np.int32), d - c, *(last[:, b] - first[:, a]).astype(np.int32)))
            lo += n
        return pa.table({"base": rows.column("base"), "kind": pa.array([1] * len(out), pa.int32()), "part": rows.column("part"), "payload": pa.array(out, pa.binary())})

    sent = by_chunk(table.select("base", "words"), flags).applyInArrow(send, "part int, base bigint, payload binary")
    return flags.unionByName(sent.groupBy("part").applyInArrow(answer, schema))


def by_chunk(table: DataFrame, rows: DataFrame):
    """Chunks with the rows for them. Only the rows are shuffled: the table lies in buckets by base."""
    return table.groupBy("base").cogroup(rows.groupBy("base"))


def answered(answers: pa.Table, kind: int) -> list[bytes]:
    """The payloads of a kind in the order of their ranges."""
    rows = zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), range(answers.num_rows))
    return [answers.column("payload")[i].as_py() for _, i in sorted((p, i) for k, p, i in rows if k == kind)]


def links(chunk: Chunk, answers: pa.Table, levels: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, ...]:
    """(doc in the chunk, at, base of the earlier chunk, doc in it, at in it, words) of every link from a seed to its first and to
    its previous occurrence; one link where they are the same."""
    seeds, at, size = chunk.seeds(levels)
    order, new = chunk.passed(answered(answers, 0), levels[0][0], seeds, at, size)
    sent, place = seeds[order[new]], []  # first base, doc, at, previous base, doc, at
    yes = []
    for value in answered(answers, 1):
        bits, n, steps, c, doc, a, step, doc_step, a_step = unpacked(value)
        bases = np.cumsum(steps)
        yes.append(np.unpackbits(bits, count=int(n[0])))
        place.append(np.stack([bases[c], doc, a, bases[c + step], doc + doc_step, a + a_step]).astype(np.int64))
    known = sent[np.flatnonzero(np.concatenate(yes))] if yes else sent[:0]
    assert sum(map(len, yes)) == len(sent), "the answers are not those of this chunk"
    place = np.concatenate(place, axis=1) if place else np.zeros((6, 0), dtype=np.int64)

    order = np.argsort(seeds)
    s = seeds[order]
    same = s[1:] == s[:-1]
    outside = np.searchsorted(known, s)
    far = np.append(known, np.uint64(0))[outside] == s if len(known) else np.zeros(len(s), dtype=bool)
    far &= outside < len(known)
    kept = far.copy()  # what occurs once needs no link
    kept[1:] |= same
    kept[:-1] |= same
    order, s, outside, far = order[kept], s[kept], outside[kept], far[kept]
    head = np.append(True, s[1:] != s[:-1])[: len(s)]
    order = order[order_of(np.cumsum(head), at[order])]
    start = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    rows = np.flatnonzero(~head | far)
    own = np.stack([np.full(len(s), chunk.base), chunk.doc[at[order]], at[order] - chunk.bounds[chunk.doc[at[order]]]])
    away = outside[rows] % max(len(known), 1)
    first, before = own[:, start[rows]], own[:, rows - 1]
    if len(known):
        first = np.where(far[rows], place[:3, away], first)
        before = np.where(head[rows], place[3:, away], before)
    two = np.flatnonzero((first != before).any(axis=0))
    mine = np.concatenate([rows, rows[two]])
    return own[1, mine], own[2, mine], *np.concatenate([first, before[:, two]], axis=1), size[order[mine]].astype(np.int64)
