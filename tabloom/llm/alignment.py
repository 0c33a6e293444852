"""Alignment of two tokenizers over the same bytes, as fragments that compose associatively.

Both tokenizers cut the same bytes (a space and the text) into tokens. Where a token of each ends, the tokens are cut
into groups. A byte range of a document gives a `Fragment`: the tokens that end in it before and at the first common
end (open prefix: the group may have begun in an earlier range), its closed groups, and the tokens behind the last
common end (open suffix). Fragments compose associatively, so a document's ranges may be computed in any task and put
together by a tree reduction; only open parts, sums and distinct id pairs travel, the text of closed groups stays in a
table ordered by range.

Documents of up to BLOCK bytes are one fragment each and never leave their task. Longer ones are cut into blocks where
both tokenizers always cut (at a single space between two letters), each block is tokenized by some task and gives one
fragment per RANGE bytes; FANOUT neighbours compose per level.

The number of documents that hold an id pair is counted over all documents. A document's sums over these counts come
from two tiers: the at most `table_size` most frequent pairs are broadcast (9 bytes each), the others, none of which is
frequent, are joined by a shuffle.

Null and empty texts, and texts whose tokens do not spell the space and the text (those with U+2581), have no tokens:
zeros and an empty digest. Every row gives one row, repeated rows too, each counted as a document; the id may be null;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import stored, text_chunks, texts_of
from tabloom.llm.pretokens import PieceCoder

BLOCK, RANGE, FANOUT = 1 << 18, 1 << 15, 16
#: Bits of a pair that hold the second id.
LOW = 15
#: Groups with more links than this are counted by their distinct ids.
WIDE_GROUP = 1 << 12
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_NONE = np.zeros(0, dtype=np.int64)


class TokenPair:
    """Both tokenizers, and the bytes of every token."""

    def __init__(self, bpe: str, pieces: str):
        import sentencepiece

        self.first = PieceCoder(bpe)
        self.first.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.first.special = None
        char_byte = {chr(c): b for b, c in _byte_chars().items()}
        size = self.first.tokenizer.get_vocab_size(with_added_tokens=True)
        self.first_bytes = [bytes(char_byte.get(c, 0) for c in self.first.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.first_lens = np.array([len(b) for b in self.first_bytes])
        self.second_lens = np.array([len(b) for b in self.second_bytes])
        if size >= 1 << 31 - LOW or len(names) > 1 << LOW:
            raise ValueError("the vocabularies are too large for packed pairs")
        # a merge never joins a space with what stands before it, so a text may be cut before a space
        self.may_cut = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts that all begin with a space: ids of both with the number per text, and which texts both spell.
        The ids of the other texts are left out."""
        a, n_a = self.first.encode(texts)
        found = self.second.encode([t[1:] for t in texts], num_threads=1)
        ok = np.ones(len(texts), dtype=bool)
        at = 0
        parts_a, parts_b = [], []
        for i, (text, ids) in enumerate(zip(texts, found, strict=True)):
            own = a[at : at + n_a[i]]
            at += n_a[i]
            raw = text.encode()
            if b"".join(map(self.second_bytes.__getitem__, ids)) == raw and b"".join(map(self.first_bytes.__getitem__, own.tolist())) == raw:
                parts_a.append(own.astype(np.int64))
                parts_b.append(np.array(ids, dtype=np.int64))
            else:
                ok[i] = False
        counts_b = np.array([len(x) for x in found], dtype=np.int64)
        return np.concatenate([_NONE, *parts_a]), np.where(ok, n_a, 0), np.concatenate([_NONE, *parts_b]), np.where(ok, counts_b, 0), ok


def _byte_chars() -> dict[int, int]:
    """Code point that stands for each byte in byte-level vocabularies."""
    from tabloom.llm.pretokens import BYTE_CHARS

    return {b: BYTE_CHARS.get(b, b) for b in range(256)}


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(bpe: str, pieces: str) -> TokenPair:
    """The worker's tokenizers; they stay for later tasks."""
    if (bpe, pieces) not in _pairs:
        _pairs[bpe, pieces] = TokenPair(bpe, pieces)
    return _pairs[bpe, pieces]


@dataclass
class Groups:
    """Closed groups: ids of both sides and how many of each belong to each group."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of `a1,a2|b1;` for all groups, and where each ends."""
        group_a, group_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        ends_a, ends_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        ids = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        signs = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[np.arange(len(self.a)) + (ends_b - self.n_b)[group_a]] = self.a
        ids[np.arange(len(self.b)) + ends_a[group_b]] = self.b
        signs[ends_a + ends_b - self.n_b - 1] = ord("|")
        signs[ends_a + ends_b - 1] = ord(";")
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))
        table = np.empty((len(ids), 7), dtype=np.uint8)
        for k in range(6):
            table[:, k] = 48 + ids // 10 ** np.maximum(digits - 1 - k, 0) % 10
        table[np.arange(len(ids)), digits] = signs
        return table[np.arange(7) <= digits[:, None]], np.cumsum(digits + 1)[ends_a + ends_b - 1]

    def pairs(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (owner, pair) with the number of links, in order. owner: of each group, ascending."""
        links = self.n_a * self.n_b
        small = links <= WIDE_GROUP
        at_a, at_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        n_a, n_b = self.n_a[small], self.n_b[small]
        group = np.repeat(np.arange(len(n_a)), n_a * n_b)
        place = np.arange(len(group)) - (np.cumsum(n_a * n_b) - n_a * n_b)[group]
        key = self.a[at_a[small][group] + place // n_b[group]] << LOW | self.b[at_b[small][group] + place % n_b[group]]
        keys, times = [owner[small][group] << 31 | key], [np.ones(len(key), dtype=np.int64)]
        for g in np.flatnonzero(~small):
            a, k_a = np.unique(self.a[at_a[g] : at_a[g] + self.n_a[g]], return_counts=True)
            b, k_b = np.unique(self.b[at_b[g] : at_b[g] + self.n_b[g]], return_counts=True)
            keys.append((owner[g] << 31 | a[:, None] << LOW | b).ravel())
            times.append((k_a[:, None] * k_b).ravel())
        all_keys = np.concatenate(keys)
        if len(keys) == 1:
            found, n = np.unique(all_keys, return_counts=True)
        else:
            found, back = np.unique(all_keys, return_inverse=True)
            n = np.bincount(back, np.concatenate(times), len(found)).astype(np.int64)
        return found >> 31, found & (1 << 31) - 1, n


@dataclass
class Fragment:
    """What a byte range of a document says: open ends, and whether and where (`cut`: number of the range) it has a common end."""

    first: int
    cut: int | None
    prefix: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray]

    def __add__(self, other: Fragment) -> tuple[Fragment, Groups | None]:
        """The fragment of both ranges, and the group that closes between them, if any. Associative."""
        join = lambda x, y: (np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]))
        if self.cut is None:
            return Fragment(self.first, other.cut, join(self.prefix, other.prefix), other.suffix), None
        if other.cut is None:
            return Fragment(self.first, self.cut, self.prefix, join(self.suffix, other.prefix)), None
        return Fragment(self.first, self.cut, self.prefix, other.suffix), one_group(join(self.suffix, other.prefix))


def one_group(sides: tuple[np.ndarray, np.ndarray]) -> Groups:
    return Groups(sides[0], sides[1], np.array([len(sides[0])]), np.array([len(sides[1])]))


def cut_groups(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[Groups, np.ndarray]:
    """All groups of tokens whose last ends agree, and the common ends."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    n_a = np.diff(np.searchsorted(ends_a, common, side="right"), prepend=0)
    n_b = np.diff(np.searchsorted(ends_b, common, side="right"), prepend=0)
    return Groups(a, b, n_a, n_b), common


def range_fragment(number: int, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[Fragment, Groups]:
    """The fragment of the tokens that end in one byte range, and its closed groups."""
    groups, common = cut_groups(a, ends_a, b, ends_b)
    if not len(common):
        return Fragment(number, None, (a, b), (_NONE, _NONE)), Groups(_NONE, _NONE, _NONE, _NONE)
    p_a, p_b = groups.n_a[0], groups.n_b[0]
    s_a, s_b = groups.n_a.sum(), groups.n_b.sum()
    closed = Groups(a[p_a:s_a], b[p_b:s_b], groups.n_a[1:], groups.n_b[1:])
    return Fragment(number, number, (a[:p_a], b[:p_b]), (a[s_a:], b[s_b:])), closed


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    return keys.astype("<u4").tobytes(), times.astype(np.uint8 if not len(times) or times.max() < 256 else "<u8").tobytes()


def unpack_pairs(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(keys, dtype="<u4").astype(np.int64)
    return found, np.frombuffer(times, dtype=np.uint8 if len(times) == len(found) else "<u8").astype(np.int64)


ALIGNED = "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest binary, keys binary, times binary"


def _aligned_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()] * 3
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)


def align_short(batches: Iterator[pa.RecordBatch], bpe: str, pieces: str) -> Iterator[pa.RecordBatch]:
    """Whole documents: a step's documents lie end to end, and the end of each is a common end."""
    own = token_pair(bpe, pieces)
    for ids, texts in text_chunks(batches):
        some = [i for i, t in enumerate(texts) if t]  # null and empty texts have no tokens
        a, n_a, b, n_b, ok = own.encode([" " + texts[i] for i in some])
        groups, common = cut_groups(a, np.cumsum(own.first_lens[a]), b, np.cumsum(own.second_lens[b]))
        held = [i for i, good in zip(some, ok, strict=True) if good]
        n_a, n_b = n_a[ok], n_b[ok]
        ends_a = np.cumsum(n_a)
        last = np.searchsorted(np.cumsum(groups.n_a), ends_a)  # last group of each document
        owner = np.repeat(np.arange(len(held)), np.diff(last, prepend=-1))
        doc, keys, times = groups.pairs(owner)
        bounds = np.searchsorted(doc, np.arange(len(held) + 1))
        links = np.bincount(owner, groups.n_a * groups.n_b, len(held)).astype(np.int64)
        out = {i: (ids[i], None, 0, 0, 0, 0, b"", b"", b"") for i in range(len(texts))}
        if held:
            text, text_ends = groups.spelled()
            stops = text_ends[last]
            for k, i in enumerate(held):
                spelled = text[stops[k - 1] if k else 0 : stops[k] - 1].tobytes()
                some_pairs = pack_pairs(keys[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]])
                out[i] = (ids[i], None, int(n_a[k]), int(n_b[k]), int(last[k] - (last[k - 1] if k else -1)), int(links[k]), hashlib.sha256(spelled).digest(), *some_pairs)
        yield _aligned_batch(list(out.values()))


def blocks(batches: Iterator[pa.RecordBatch], size: int, may_cut: bool) -> Iterator[pa.RecordBatch]:
    """A long text in parts of about `size` characters, each beginning with a space where both tokenizers cut."""
    for batch in batches:
        for doc_id, row, value in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
            text = " " + value.as_py()
            at = start = number = 0
            while at < len(text):
                cut = _CUT.search(text, at + size) if may_cut and len(text) - at > size else None
                part = text[at : cut.start() if cut else len(text)]
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row], pa.int64()), pa.array([start], pa.int64()), pa.array([part], pa.string())], names=["doc_id", "row", "start", "text"])
                start += len(part.encode())
                number += 1


OPEN = (
    "doc_id bigint, row bigint, first bigint, cut bigint, pre_a binary, pre_b binary, suf_a binary, suf_b binary, ok boolean, "
    "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, keys binary, times binary, at bigint, part bigint, spelled binary"
)


@dataclass
class Running:
    """A fragment with the sums over what has closed in it."""

    fragment: Fragment
    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    keys: np.ndarray = None
    times: np.ndarray = None

    def take(self, groups: Groups | None, keys: np.ndarray, times: np.ndarray) -> None:
        """Count closed groups, and links that were counted before."""
        parts = [(self.keys, self.times), (keys, times)] if self.keys is not None else [(keys, times)]
        if groups is not None and len(groups.n_a):
            self.n_groups += len(groups.n_a)
            self.n_links += int((groups.n_a * groups.n_b).sum())
            parts.append(groups.pairs(np.zeros(len(groups.n_a), dtype=np.int64))[1:])
        self.keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        self.times = np.bincount(back, np.concatenate([p[1] for p in parts]), len(self.keys)).astype(np.int64)

    def add(self, other: Running) -> Groups | None:
        self.fragment, closed = self.fragment + other.fragment
        self.ok &= other.ok
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.take(closed, other.keys, other.times)
        return closed

    def row(self, doc_id: int | None, row: int) -> dict:
        f = self.fragment
        keys, times = pack_pairs(self.keys, self.times)
        ids = dict(zip(("pre_a", "pre_b", "suf_a", "suf_b"), (x.astype("<i4").tobytes() for x in (*f.prefix, *f.suffix)), strict=True))
        return {"doc_id": doc_id, "row": row, "first": f.first, "cut": f.cut, **ids, "ok": self.ok, "n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_groups, "n_links": self.n_links, "keys": keys, "times": times}

    @staticmethod
    def read(r: dict) -> Running:
        ids = [np.frombuffer(r[c], dtype="<i4").astype(np.int64) for c in ("pre_a", "pre_b", "suf_a", "suf_b")]
        return Running(Fragment(r["first"], r["cut"], (ids[0], ids[1]), (ids[2], ids[3])), r["ok"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *unpack_pairs(r["keys"], r["times"]))


def closed_row(row: int, at: int, part: int, groups: Groups) -> dict:
    """Text of closed groups: part 0 stands before a range's own groups (part 1)."""
    return {"row": row, "at": at, "part": part, "spelled": groups.spelled()[0].tobytes()}


def _open_batch(rows: list[dict]) -> pa.RecordBatch:
    kind = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in OPEN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind[t]) for name, t in fields], names=[name for name, _ in fields])


def block_fragments(batches: Iterator[pa.RecordBatch], bpe: str, pieces: str, width: int) -> Iterator[pa.RecordBatch]:
    """One fragment per byte range of each block, and the text of its closed groups."""
    own = token_pair(bpe, pieces)
    for batch in batches:
        for r in batch.to_pylist():
            a, _, b, _, ok = own.encode([r["text"]])
            if not ok[0]:
                number = 2 * (r["start"] // width)
                yield _open_batch([Running(Fragment(number, None, (_NONE, _NONE), (_NONE, _NONE)), False, keys=_NONE, times=_NONE).row(r["doc_id"], r["row"])])
                continue
            ends_a, ends_b = r["start"] + np.cumsum(own.first_lens[a]), r["start"] + np.cumsum(own.second_lens[b])
            for number in range(r["start"] // width, int(ends_a[-1] - 1) // width + 1):
                # a token belongs to the range its last byte lies in, so both tokens of a common end meet in one range
                in_a, in_b = (slice(*np.searchsorted(e, [number * width + 1, (number + 1) * width + 1])) for e in (ends_a, ends_b))
                fragment, closed = range_fragment(2 * number + (number * width < r["start"]), a[in_a], ends_a[in_a], b[in_b], ends_b[in_b])
                running = Running(fragment, n_a=len(a[in_a]), n_b=len(b[in_b]), keys=_NONE, times=_NONE)
                running.take(closed, _NONE, _NONE)
                rows = [running.row(r["doc_id"], r["row"])]
                if len(closed.n_a):
                    rows.append(closed_row(r["row"], fragment.cut, 1, closed))
                yield _open_batch(rows)


def compose(table: pa.Table) -> pa.Table:
    """Neighbouring fragments of one document as one, and the text of the groups that closed between them."""
    rows = sorted(table.to_pylist(), key=lambda r: r["first"])
    out = []
    total = Running.read(rows[0])
    for r in rows[1:]:
        right = Running.read(r)
        closed = total.add(right)
        if closed is not None:
            out.append(closed_row(r["row"], right.fragment.cut, 0, closed))
    return pa.Table.from_batches([_open_batch([total.row(rows[0]["doc_id"], rows[0]["row"]), *out])])


def finish(table: pa.Table) -> pa.Table:
    """The last fragment of a document: its prefix begins the document and is a group."""
    r = table.to_pylist()[0]
    total = Running.read(r)
    out = [r]
    if total.ok and total.fragment.cut is not None:
        group = one_group(total.fragment.prefix)
        total.take(group, _NONE, _NONE)
        out = [total.row(r["doc_id"], r["row"]), closed_row(r["row"], total.fragment.cut, 0, group)]
    return pa.Table.from_batches([_open_batch(out)])


def text_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each row's texts, which come in order: one hash runs, no text is kept. The last `;` is left out."""
    row, state, held = None, None, b""
    done: list[tuple[int, bytes]] = []

    def close() -> None:
        if row is not None:
            state.update(held[:-1])
            done.append((row, state.digest()))

    for batch in batches:
        for number, value in zip(batch.column("row").to_pylist(), batch.column("spelled").to_pylist(), strict=True):
            if number != row:
                close()
                row, state, held = number, hashlib.sha256(), b""
            state.update(held)
            held = value
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done], pa.binary())], names=["row", "digest"])


def align_long(docs: DataFrame, bpe: str, pieces: str, block: int, width: int) -> DataFrame:
    """(doc_id, row, text) of long documents, cut and put together over tasks."""
    spark = docs.sparkSession
    may_cut = token_pair(bpe, pieces).may_cut
    parts = docs.mapInArrow(lambda batches: blocks(batches, block, may_cut), "doc_id bigint, row bigint, start bigint, text string")
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row", "start")
    found = stored(spread.mapInArrow(lambda batches: block_fragments(batches, bpe, pieces, width), OPEN), "fragments")
    texts = [found.filter("spelled IS NOT NULL").select("row", "at", "part", "spelled")]
    ends = found.filter("first IS NOT NULL")
    top = ends.agg(F.max("first")).first()[0] or 0
    step = 1
    while step <= top:
        step *= FANOUT
        level = stored(ends.groupBy("row", F.floor(F.col("first") / step).alias("_node")).applyInArrow(compose, OPEN), "composed")
        texts.append(level.filter("spelled IS NOT NULL").select("row", "at", "part", "spelled"))
        ends = level.filter("first IS NOT NULL")
    last = stored(ends.groupBy("row").applyInArrow(finish, OPEN), "composed")
    texts.append(last.filter("spelled IS NOT NULL").select("row", "at", "part", "spelled"))
    every = texts[0]
    for t in texts[1:]:
        every = every.unionAll(t)
    digests = every.repartition("row").sortWithinPartitions("row", "at", "part").select("row", "spelled").mapInArrow(text_digests, "row bigint, digest binary")
    sums = last.filter("first IS NOT NULL").select("doc_id", "row", "ok", "n_a", "n_b", "n_groups", "n_links", "keys", "times")
    kept = {c: F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0)) for c in ("n_a", "n_b", "n_groups", "n_links")}
    empty = {c: F.when(F.col("ok"), F.col(c)).otherwise(F.lit(b"")) for c in ("digest", "keys", "times")}
    return sums.join(digests, "row", "left").withColumns(kept | empty).select(*[c.split()[0] for c in ALIGNED.split(", ")])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its first id is in more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        keys, n = _NONE, _NONE

        def merge() -> None:
            nonlocal keys, n
            fresh, times = np.unique(np.concatenate([_NONE, *waiting]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, times]), len(keys)).astype(np.int64)
            waiting.clear()

        for batch in batches:
            waiting.extend(np.frombuffer(v, dtype="<u4").astype(np.int64) for v in batch.column("keys").to_pylist())
            if sum(map(len, waiting)) > 1 << 22:
                merge()
            if len(keys) > 1 << 23:  # what one task holds is bounded; the sums are made behind the shuffle
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                keys, n = _NONE, _NONE
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    counts = stored(aligned.select("keys").mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", LOW)
    most = counts.groupBy(first.alias("_a")).agg(F.max("n").alias("_most"))  # one row per id of the first vocabulary
    return counts.join(F.broadcast(most), first == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def frequent_pairs(counts: DataFrame, table_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The most frequent pairs, at most `table_size`, and the number of documents from which on a pair is one of them."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("k")).orderBy(F.desc("power")).collect()
    least, total = 1 << 62, 0
    for r in sizes:
        if total + r.k > table_size:
            break
        least, total = 1 << r.power, total + r.k
    table = counts.filter(F.col("n") >= least).orderBy("pair").toPandas() if total else pd.DataFrame({"pair": [], "n": [], "best": []})
    return table.pair.to_numpy(dtype=np.int64), table.n.to_numpy(dtype=np.int64), table.best.to_numpy(dtype=bool), least


def align(docs: DataFrame, bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = 1 << 20, block: int = BLOCK, width: int = RANGE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    if width > block:
        raise ValueError("a byte range must fit into a block")
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    is_long = F.coalesce(F.octet_length("text") > block, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(lambda batches: align_short(batches, bpe, pieces), ALIGNED)
    long = align_long(docs.filter(is_long).withColumn("row", F.monotonically_increasing_id()), bpe, pieces, block, width)
    aligned = stored(short.unionAll(long).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned), "best-pairs")
    keys, n, best, least = frequent_pairs(counts, table_size)
    table = spark.sparkContext.broadcast((keys.astype(np.uint32), n, best))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            held = [unpack_pairs(k, t) for k, t in zip(batch.column("keys").to_pylist(), batch.column("times").to_pylist(), strict=True)]
            sizes = np.array([len(k) for k, _ in held], dtype=np.int64)
            flat, times = np.concatenate([_NONE, *(k for k, _ in held)]), np.concatenate([_NONE, *(t for _, t in held)])
            hit = np.zeros(len(flat), dtype=bool)
            at = np.zeros(len(flat), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat.astype(np.uint32)), len(known) - 1)
                hit = known[at] == flat
            sums, bests = np.zeros(len(flat) + 1, dtype=np.int64), np.zeros(len(flat) + 1, dtype=np.int64)
            if len(known):
                np.cumsum(np.where(hit, n[at] * times, 0), out=sums[1:])
                np.cumsum(np.where(hit & best[at], times, 0), out=bests[1:])
            ends = np.cumsum(sizes)
            rest = [pa.array(x, pa.int64()) for x in (flat[~hit], times[~hit])]
            offsets = pa.array(np.append(0, np.cumsum(~hit))[np.append(0, ends)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "digest")), pa.array(sums[ends] - sums[ends - sizes]), pa.array(bests[ends] - bests[ends - sizes]), *(pa.ListArray.from_arrays(offsets, x) for x in rest)],
                names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "digest", "count_sum", "n_best", "pairs", "times"],
            )

    sums = stored(aligned.mapInArrow(summed, "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest binary, count_sum bigint, n_best bigint, pairs array<bigint>, times array<bigint>"), "aligned-sums")
    rest = sums.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    added = rest.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    return sums.join(added, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        F.when(F.octet_length("digest") > 0, F.lower(F.hex("digest"))).otherwise("").alias("groups_sha256"),
    )
