"""Token ids in compressed files: written in document order, read back block by block.

The format is a folder of Parquet files with one row per block: shard and block number, the number of ids, the documents'
stretches in it (number in the shard, id, place in the document, length), a CRC-32 of the ids and the coded payload
(`token_codec`). Blocks are coded and reset on their own, so any of them can be read alone. Shards are ranges of ids in
ascending order; ties are ordered by text. A block has at most BLOCK ids; where a task has few ids they are dealt over
more and shorter blocks, so that the coder has many to work on side by side.

Null text counts as empty: such a document has only its end id. Null ids come first. Repeated rows are written each. An
empty table gives an empty folder's worth of rows: none. Other columns are not read. A long text spans many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.llm.common import texts_of
from tabloom.llm.pretokens import coder
from tabloom.llm.token_codec import checksum, decode_blocks, encode_blocks, joined_checksum

BLOCK, SHORTEST, LANES = 4096, 512, 1024
STRETCH = "array<struct<doc:bigint,doc_id:bigint,offset:bigint,length:bigint>>"
FORMAT = f"shard bigint, block bigint, n bigint, stretches {STRETCH}, crc bigint, payload binary"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents, append end_id to each, and write the folder."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        shard = TaskContext.get().partitionId()
        block = doc = 0
        waiting: list[tuple[int, int | None, int, np.ndarray]] = []  # document stretches

        def flush() -> pa.RecordBatch:
            nonlocal block
            flat = np.concatenate([w[3] for w in waiting])
            size = int(np.clip(-(-len(flat) // LANES), SHORTEST, BLOCK))
            parts = [flat[i : i + size] for i in range(0, len(flat), size)]
            stretches: list[list[dict]] = [[] for _ in parts]
            at = 0
            for number, doc_id, offset, ids in waiting:
                done = 0
                while done < len(ids):
                    n = min(len(ids) - done, size - at % size)
                    stretches[at // size].append({"doc": number, "doc_id": doc_id, "offset": offset + done, "length": n})
                    at, done = at + n, done + n
            waiting.clear()
            rows = len(parts)
            out = pa.RecordBatch.from_arrays([
                pa.array([shard] * rows), pa.array(range(block, block + rows), pa.int64()), pa.array([len(x) for x in parts], pa.int64()),
                pa.array(stretches, pa.list_(pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))),
                pa.array([checksum(x) for x in parts], pa.int64()), pa.array(encode_blocks(parts), pa.binary()),
            ], names=["shard", "block", "n", "stretches", "crc", "payload"])
            block += rows
            return out

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                flat, counts = own.encode(rows.column("text").to_pylist())
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(rows.column("doc_id").to_pylist(), ends - counts, ends, strict=True):
                    ids, offset = np.append(flat[a:b], flat.dtype.type(end_id)), 0
                    while offset < len(ids):
                        part = ids[offset : offset + BLOCK * LANES - size]
                        waiting.append((doc, doc_id, offset, part))
                        offset, size = offset + len(part), size + len(part)
                        if size >= BLOCK * LANES:
                            yield flush()
                            size = 0
                    doc += 1
        if waiting:
            yield flush()

    rows = texts_of(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(code, FORMAT).write.option("compression", "uncompressed").parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the folder, undecoded."""
    return spark.read.schema(FORMAT).parquet(folder)


def read_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc, doc_id, offset, ids): the ids of the documents as little-endian unsigned 32-bit, one row per document and
    block. A block whose ids do not have its CRC raises an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LANES):
                rows = batch.slice(at, LANES)
                blocks = decode_blocks(rows.column("payload").to_pylist(), rows.column("n").to_pylist())
                for ids, crc, block in zip(blocks, rows.column("crc").to_pylist(), rows.column("block").to_pylist(), strict=True):
                    if checksum(ids) != crc:
                        raise ValueError(f"block {block}: the checksum does not fit")
                lists = rows.column("stretches")
                each = lists.flatten()
                lengths = each.field("length").to_numpy()
                ids = np.concatenate(blocks).astype("<u4") if blocks else np.zeros(0, dtype="<u4")
                offsets = np.append(0, np.cumsum(lengths) * 4).astype(np.int32)
                shard = rows.column("shard").take(pa.array(np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())))
                yield pa.RecordBatch.from_arrays(
                    [shard, each.field("doc"), each.field("doc_id"), each.field("offset"), pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])],
                    names=["shard", "doc", "doc_id", "offset", "ids"])

    return read_blocks(spark, folder).mapInArrow(decode, "shard bigint, doc bigint, doc_id bigint, offset bigint, ids binary")


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the folder, from its decoded ids."""
    parts = read_stretches(spark, folder).select("shard", "doc", "doc_id", "offset", (F.octet_length("ids") / 4).cast("bigint").alias("n"), F.crc32("ids").alias("crc"))
    docs = parts.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "n", "crc"))).alias("parts"))

    @F.pandas_udf("bigint")
    def whole(parts: pd.Series) -> pd.Series:
        def join(line: list) -> int:
            crc = int(line[0]["crc"])
            for p in line[1:]:
                crc = joined_checksum(crc, int(p["crc"]), int(p["n"]))
            return crc
        return parts.map(join)

    # one row per shard; places of documents inside their shard by the blocks' counts
    shards = read_blocks(spark, folder).groupBy("shard").agg(F.sum("n").alias("total"))
    base = shards.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return placed.join(base, "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", whole("parts").alias("ids_crc32"))
