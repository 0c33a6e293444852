"""The most frequent terms, with and without looking among frequent words only."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions.text import TextConfig
from tabloom.operators import tfidf


@pytest.mark.parametrize(("most", "high"), [(3, 2), (7, 2), (9, 3), (40, 2), (500, 2)])
def test_terms_are_those_of_the_full_count(spark, monkeypatch, most, high):
    i = F.col("id")
    word = lambda k: F.concat(F.lit("w"), F.floor(F.sqrt((i * k * 7919) % 401)).cast("string"))
    texts = spark.range(0, 120).select(F.when(i % 17 != 3, F.concat_ws(" ", F.lit("aa aa aa of"), *[word(k) for k in range(1, 9)])).alias("text"))
    config = TextConfig(enable_tfidf=True, max_tfidf_features=most, stop_words=("of",), ngram_range=(1, high))
    got = tfidf.fit_terms(texts, "text", config).orderBy("idx").collect()
    frequent = tfidf._frequent_words(texts, "text", config)
    counted = tfidf.term_counts(texts, "text", config, frequent).count()
    whole = tfidf.term_counts(texts, "text", config).count()
    assert counted < whole if most < 20 else frequent is None
    monkeypatch.setattr(tfidf, "_frequent_words", lambda *a: None)
    assert got == tfidf.fit_terms(texts, "text", config).orderBy("idx").collect() and len(got) == min(most, whole - 1)
