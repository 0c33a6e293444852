"""Spans of words in documents: where passages stand, merged and cut out. Words are those of `words`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabloom.llm.common import row_key
from tabloom.llm.words import Words


def merged(spans: DataFrame, *key: str) -> DataFrame:
    """(key, start, end, ...): overlapping or touching spans of one key as one; of other columns those of the longest span stay."""
    order = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = [c for c in spans.columns if c not in (*key, "start", "end")]
    opens = F.when(F.col("_before") >= F.col("start"), 0).otherwise(1)
    marked = spans.withColumn("_before", before).withColumn("_island", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct(*rest), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("best") if rest else F.lit(1).alias("best")
    out = marked.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best)
    return out.select(*key, "start", "end", *[f"best.{c}" for c in rest])


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the words of `spans` (key = row_key(), start, end) cut out of the text, each with what follows it up to
    the next word. n_chars follows the text where there is such a column; texts without a span stay as they are."""
    columns = docs.columns
    cuts = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    joined = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("key", row_key()).join(cuts, "key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, cuts in enumerate(batch.column("_cuts").to_pylist()):
                if cuts:
                    words = Words([texts[i]])
                    edges = np.append(words.starts, len(words.bytes))
                    keep, at = [], 0
                    for c in cuts:
                        keep.append(words.bytes[at : edges[c["start"]]])
                        at = max(at, int(edges[c["end"]]))
                    texts[i] = b"".join([*keep, words.bytes[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    schema = f"row {joined.schema['row'].dataType.simpleString()}, text string"
    out = joined.select("row", "text", "_cuts").mapInArrow(cut, schema)
    fields = {c: F.col(f"row.`{c}`") for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        fields["n_chars"] = F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fields[c].alias(c) for c in columns])
