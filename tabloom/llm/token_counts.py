"""Token counts by a map-side lookup in two tiers.

Tier 1 is a compact table of the frequent pre-tokens: sorted 64-bit fingerprints and numbers of ids, at most
`table_size` entries of 9 bytes, broadcast. What it lacks goes to tier 2, the cache of the Python worker, and what
that lacks to the tokenizers library. Texts stay where they are: no pre-token is shuffled. The table comes from all
documents: each partition keeps a summary of bounded size (Misra-Gries) and hands on only pieces with at least a
`1 / table_size` share of its own pieces, so the merge sees at most `table_size` rows of each partition. The table
decides only how fast a piece is counted, never its count.

Null and empty texts have 0 bytes and 0 tokens. Every row gives one row, repeated rows too; the id may be null; other
columns are not read; an empty table gives no rows. Very long texts are counted in parts cut where the pattern cuts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import texts_of
from tabloom.llm.pretokens import PieceCoder, Pieces, coder


def shrink(counts: Counter, size: int) -> Counter:
    """Keep the `size` largest counts, less the next one (a Misra-Gries step)."""
    if len(counts) <= size:
        return counts
    ranked = counts.most_common(size + 1)
    least = ranked[-1][1]
    return Counter({k: n - least for k, n in ranked[:-1] if n > least})


def frequent_pieces(docs: DataFrame, path: str, table_size: int) -> DataFrame:
    """(piece, n): pieces that are frequent in at least one partition, with their counts there, added up."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for _, step, special in own.steps(batch.column("text").to_pylist()):
                if special:
                    continue
                pieces = Pieces(step)
                _, at, n = np.unique(pieces.hashes, return_index=True, return_counts=True)
                for i, k in zip(at.tolist(), n.tolist(), strict=True):
                    counts[pieces.string(i)] += k
                total += len(pieces.hashes)
                if len(counts) > 8 * table_size:
                    counts = shrink(counts, 2 * table_size)
        heavy = [(k, n) for k, n in counts.items() if n * table_size >= total]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in heavy], pa.string()), pa.array([n for _, n in heavy], pa.int64())], names=["piece", "n"])

    return docs.select("text").mapInArrow(summary, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def length_table(docs: DataFrame, path: str, table_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tier 1: sorted fingerprints of the most frequent pieces, and their numbers of ids."""
    top = [r.piece for r in frequent_pieces(docs, path, table_size).orderBy(F.desc("n"), "piece").limit(table_size).collect()]
    own = PieceCoder(path, bits=1)
    found = [Pieces([p]) for p in top]
    usable = [(int(x.hashes[0]), len(own.encode_piece(p))) for p, x in zip(top, found, strict=True) if len(x.hashes) == 1 and not x.whole[0]]
    usable = sorted({k: n for k, n in usable if n < 256}.items())
    return np.array([k for k, _ in usable], dtype=np.uint64), np.array([n for _, n in usable], dtype=np.uint8)


def count_step(own: PieceCoder, step: list[str], keys: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Numbers of ids of some texts."""
    pieces = Pieces(step)
    n = np.zeros(len(pieces.hashes), dtype=np.int64)
    known = np.zeros(len(n), dtype=bool)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, pieces.hashes), len(keys) - 1)
        known = keys[at] == pieces.hashes
        n[known] = lens[at[known]]
    rest = np.flatnonzero(~known)
    n[rest] = own.lookup(pieces.some(rest))[0]
    counts = np.diff(np.append(0, np.cumsum(n))[pieces.bounds])
    for i in np.flatnonzero(pieces.whole):
        counts[i] = len(own.library(step[i]))
    return counts


def count_tokens(docs: DataFrame, path: str, table_size: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text."""
    docs = texts_of(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(length_table(docs, path, table_size))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        keys, lens = table.value
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for owner, step, special in own.steps(batch.column("text").to_pylist()):
                np.add.at(n, owner, [len(own.library(step[0]))] if special else count_step(own, step, keys, lens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return sized.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint")
