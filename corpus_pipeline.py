"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of `documents`. Null, empty and wordless texts fall to the quality rules; the stages themselves accept them (see the
operators' docstrings) and pass them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import scratch
from tabloom.llm import chaining, packing, positional_index, quality, shingle_join
from tabloom.llm.common import benchmark, documents, labels, row_key, ship
from tabloom.llm.queries import BPE
from tabloom.llm.spans import merged, without_spans

#: No SQL: the joins on similar texts and passages have no practical form in it. tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or exceed a cutoff of their language go."""
    ship(spark)
    return quality.judged_rows(docs, labels(spark, sf_dir)).filter("kept").select("row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    ship(spark)
    return shingle_join.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred in an earlier place are cut out; a document of which no word is left goes."""
    ship(spark)
    spans = merged(chaining.repeats(docs).select("key", "start", "end"), "key")
    cut = without_spans(docs.withColumn("_before", shingle_join.text_key().isNotNull()), spans)
    return cut.filter(~F.col("_before") | shingle_join.text_key().isNotNull()).drop("_before")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark)
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(row_key()).alias("_key"), "text")
    found = positional_index.contamination(keyed, benchmark(spark, sf_dir), id_col="_key")
    return keyed.join(found.filter("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    ship(spark)
    return packing.pack_documents(docs, BPE, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
