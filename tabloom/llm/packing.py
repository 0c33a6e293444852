"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

`tokenised_pieces` encodes and cuts the documents; `pack` places the pieces. Packing depends on lengths only, and
lengths of at most `capacity` have at most `capacity` values, so the plan is made from their histogram: its size and
the time to make it do not grow with the data. A plan line is a bin pattern (lengths with counts) and how many bins
use it. Each pattern is filled greedily, longest piece first; then the smallest piece of the bin is replaced by two
unpacked pieces if these fill the gap that opens more tightly. Pieces find their place by their rank among the pieces
of the same length. Ranks come from counts per input partition and length, so no task sees all pieces of a length.

Null text counts as empty (its end id alone is packed); repeated rows are packed each; an empty table gives no rows;
null ids are kept; other columns are not read. A document longer than the capacity is cut; its first piece takes the
odd length, the others fill a sequence each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.llm.common import stored, texts_of
from tabloom.llm.pretokens import coder

PIECES = "part bigint, nth bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"


def tokenised_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the ids (little-endian unsigned 32-bit), the place in the document, and the piece's number
    among those of its length in its partition (part, nth)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                flat, n = own.encode(rows.column("text").to_pylist())
                ids = np.insert(flat.astype("<u4"), np.cumsum(n), end_id)
                n = n + 1
                first = (n - 1) % capacity + 1  # length of the first piece
                pieces = (n - first) // capacity + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                runs = np.searchsorted(ordered, ordered)
                nth = np.empty(len(length), dtype=np.int64)
                nth[order] = seen[ordered] + np.arange(len(ordered)) - runs
                seen += np.bincount(length, minlength=capacity + 1)
                offsets = np.append(0, np.cumsum(length) * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(doc), part)), pa.array(nth), rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                ], names=["part", "nth", "doc_id", "piece", "start", "length", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(cut, PIECES)


def plan_bins(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """Bin patterns with the number of bins that use them. histogram[k]: number of pieces of length k."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan = []
    while (sizes := np.flatnonzero(left)).size:
        need = np.zeros_like(left)
        gap, items = capacity, []

        def take(size: int) -> None:
            nonlocal gap
            items.append(size)
            need[size] += 1
            gap -= size

        take(int(sizes[-1]))
        while gap and (fits := np.flatnonzero((left - need)[: gap + 1] > 0)).size:
            take(int(fits[-1]))
        if gap and len(items) > 1:
            small = min(items)
            room, free = gap + small, left - need
            ok = np.flatnonzero(free[: room + 1] > 0)
            reach = np.zeros(room + 1, dtype=np.int64)  # the largest free length up to each room
            reach[ok] = ok
            reach = np.maximum.accumulate(reach)
            partner = reach[room - ok]
            twin = (partner == ok) & (free[ok] < 2)
            partner[twin] = reach[np.maximum(ok[twin] - 1, 0)]
            total = np.where(partner > 0, ok + partner, 0)
            if total.size and total.max() > small:
                k = int(total.argmax())
                items.remove(small)
                need[small] -= 1
                gap += small
                take(int(ok[k]))
                take(int(partner[k]))
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= need * times
        plan.append((sorted(items, reverse=True), times))
    return plan


def plan_lookup(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the ranks from which a pattern takes its pieces: columns first rank, first sequence, pieces of
    this length in a bin, offset of the first of them."""
    lines: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for items, times in plan:
        offset = 0
        for size in sorted(set(items), reverse=True):
            k = items.count(size)
            lines.setdefault(size, []).append((ranks.get(size, 0), sequence, k, offset))
            ranks[size] = ranks.get(size, 0) + k * times
            offset += k * size
        sequence += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in lines.items()}


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset. `pieces` needs part, nth and length as tokenised_pieces gives them, and must be a
    stored table: it is read more than once."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row.length] = row.n
    lookup = pieces.sparkSession.sparkContext.broadcast(plan_lookup(plan_bins(histogram)))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                lines = lookup.value[size]
                line = lines[np.searchsorted(lines[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - line[:, 0]
                sequence[at] = line[:, 1] + inside // line[:, 2]
                offset[at] = line[:, 3] + inside % line[:, 2] * size
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(counts.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).select(*[c for c in pieces.columns], "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids, sequence_id, offset."""
    pieces = stored(tokenised_pieces(docs, path, end_id, capacity, id_col, text_col), "packing-pieces", compression="zstd")
    return pack(pieces, capacity).drop("part", "nth")
