import random

import pytest
from oracle_check import duck
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES
from tabloom.catalog.common import scratch
from tabloom.llm.queries import SQL

from .conftest import DOCS
from .test_chaining import brute_exact, fresh, words
from .test_packing import check
from .test_positional_index import brute as brute_hits
from .test_shingle_join import brute as brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in STAGES:
        before = docs
        path = scratch(spark, "pipeline-test")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages, spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    assert all(after.schema == schema for _, after in list(stages.values())[:-1])
    assert [n for n, _ in STAGES] == ["quality_rules", "ngram_join", "substring_dedup", "decontamination", "best_fit_packing"]


def test_quality(stages, sf):
    kept = {r[0] for r in duck(sf).execute(f"SELECT doc_id FROM ({SQL['op8_quality_rules']}) WHERE kept").fetchall()}
    assert set(texts(stages["quality_rules"][1])) == kept


def test_one_document_of_each_class_stays(stages):
    before, after = (texts(df) for df in stages["ngram_join"])
    assert sorted(after) == sorted(min(c) for c in brute_classes(list(before.items())))


def test_repeats_are_cut_and_clean_documents_stay(stages):
    before, after = (texts(df) for df in stages["substring_dedup"])
    assert not brute_exact(sorted(after.items()))
    repeated = brute_exact(sorted(before.items()))
    for doc_id, text in before.items():
        if doc_id not in repeated and after.get(doc_id) != text:  # fuzzy passages only
            assert len(words(text)) - len(words(after.get(doc_id))) >= 50
    rows = stages["substring_dedup"][1].filter("n_chars <> length(text)").count()
    assert rows == 0


def test_contaminated_documents_go(stages, spark, sf):
    before, after = (texts(df) for df in stages["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(after) == [r[0] for r in brute_hits(sorted(before.items()), items, 10) if not r[2]]


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    used, least = check(after.withColumn("ids_crc32", F.crc32("ids")).collect(), texts(before), 1024)
    assert used <= least + 2


def test_run_equals_the_stages(stages, spark, sf):
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.piece, r.length) for r in stages["best_fit_packing"][1].collect())


def test_planted_and_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    clean = {i: " ".join(fresh(rng, 90)) for i in range(6)}
    passage, item = fresh(rng, 60), " ".join(fresh(rng, 14))
    docs = list(clean.items()) + [(10, clean[0]), (11, clean[1] + " added"), (11, clean[1] + " added")]  # copies
    docs += [(20 + i, " ".join(fresh(rng, 40) + passage + fresh(rng, 40))) for i in range(3)]
    docs += [(30, " ".join([*fresh(rng, 40), item, *fresh(rng, 40)])), (40, None), (41, ""), (42, "too short"), (None, " ".join(fresh(rng, 50)))]
    rows = [(i, t, None if i == 2 else "en", None, len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs_now.columns
    for name, stage in STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == columns, name
        path = scratch(spark, "planted")
        docs_now.write.parquet(path)
        docs_now = spark.read.parquet(path)
        kept.append({r.doc_id: r.text for r in docs_now.collect()})
        assert docs_now.count() == len(kept[-1]) or name == "quality_rules"
    assert set(kept[0]) == {*range(6), 10, 11, 20, 21, 22, 30, None}
    assert set(kept[1]) == {*range(6), 20, 21, 22, 30, None}
    assert sorted(len(words(kept[2][i])) for i in (20, 21, 22)) == [80, 80, 140]
    assert {i: kept[2][i] for i in clean} == clean
    assert set(kept[3]) == {*range(6), 20, 21, 22, None}
    packed = STAGES[-1][1](spark, docs_now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
