"""Helpers shared by the text operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

import tabloom
from tabloom.catalog.common import scratch


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver found it; once per application."""
    sc = spark.sparkContext
    if not getattr(sc, "_tabloom_shipped", False):
        root = Path(tabloom.__file__).resolve().parent.parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tabloom-code-')}/tabloom", "zip", root, "tabloom"))
        sc._tabloom_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash with the operators' own."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def row_key():
    """16 bytes that tell rows apart by id and text; rows equal in both are one row to the operators that join by it."""
    return F.unhex(F.md5(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table in the shared folder and read it: cuts the lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the first of the rows with one key (`doc_id`) in this partition: hot copies shrink to one row per partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(batch.column("doc_id").to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def distinct_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row (key, text) for each of `keys`; `texts` may have a key on any number of rows."""
    once = texts.select(F.col("key").alias("doc_id"), "text").mapInArrow(first_of_partition, "doc_id binary, text string").withColumnRenamed("doc_id", "key")
    return once.join(keys.distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])  # the same plan at every size


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and texts of (doc_id, text) batches in lists of at most `limit` characters, or of one longer text."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            value = text.as_py()
            if texts and size + len(value or "") > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(value)
            size += len(value or "")
    if texts:
        yield ids, texts
