"""TF-IDF over whole texts: a bounded vocabulary of the most frequent terms, vectors stay sparse."""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.text import TextConfig, ngrams, words
from tabloom.session import spread


def stop_words(config: TextConfig) -> list[str]:
    """The configured list, else Spark's own English list."""
    if config.stop_words is not None:
        return list(config.stop_words)
    return list(StopWordsRemover.loadDefaultStopWords("english"))


ALL_DOCUMENTS = ""


def term_counts(df: DataFrame, column: str, config: TextConfig, among: list[str] | None = None) -> DataFrame:
    """(term, tf, df): occurrences and documents per term, in one pass and one map-side combined shuffle.

    The empty term, which no text can hold, stands for the documents themselves: its df is their number. With ``among`` only
    terms made of these words are counted.
    """
    texts = spread(df.select(column).where(F.col(column).isNotNull()))
    found = texts.select(words(F.col(column), stop_words(config)).alias("w"))
    listed = found.select(_terms_of("w", config.ngram_range, among).alias("t"))

    def entry(term: Column, tf: int, in_documents: int) -> Column:
        return F.struct(term.alias("term"), F.lit(tf).alias("tf"), F.lit(in_documents).alias("df"))

    marked = F.concat(
        F.array(entry(F.lit(ALL_DOCUMENTS), 0, 1)),
        F.transform("t", lambda t: entry(t, 1, 0)),
        F.transform(F.array_distinct("t"), lambda t: entry(t, 0, 1)),
    )
    return listed.select(F.explode(marked).alias("e")).groupBy("e.term").agg(F.sum("e.tf").alias("tf"), F.sum("e.df").alias("df"))


def _terms_of(found: str, ngram_range: tuple[int, int], among: list[str] | None) -> Column:
    if among is None:
        return ngrams(F.col(found), ngram_range)
    # other words become null, which a term made of them inherits
    kept = F.transform(found, lambda w: F.when(w.isin(among), w))
    low, high = ngram_range
    parts = []
    for n in range(low, high + 1):
        size = F.greatest(F.size(found) - (n - 1), F.lit(0))
        grams = F.slice(kept, F.lit(1), size)
        for k in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(kept, F.lit(k), size), lambda left, right: F.concat(left, F.lit(" "), right))
        parts.append(F.filter(grams, lambda t: t.isNotNull()))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


#: Words up to which the longer terms are looked for among frequent words only.
MAX_FREQUENT = 2_000


def _frequent_words(df: DataFrame, column: str, config: TextConfig) -> list[str] | None:
    """The words that a term among the most frequent can hold, or None if they are no short list.

    A term occurs at most as often as each of its words. As many single words as there may be terms are at least as frequent
    as the last of these, so no term with a rarer word is one of the most frequent.
    """
    low, high = config.ngram_range
    most = config.max_tfidf_features
    if low != 1 or high < 2 or most >= MAX_FREQUENT:
        return None
    texts = spread(df.select(column).where(F.col(column).isNotNull()))
    counted = texts.select(F.explode(words(F.col(column), stop_words(config))).alias("word")).groupBy("word").count()
    best = counted.orderBy(F.desc("count"), "word").limit(MAX_FREQUENT + 1).collect()
    if len(best) <= most:
        return None  # fewer words than terms: all of them count
    last = best[most - 1]["count"]
    frequent = [r["word"] for r in best if r["count"] >= last]
    return frequent if len(frequent) <= MAX_FREQUENT else None


def fit_terms(df: DataFrame, column: str, config: TextConfig) -> DataFrame:
    """(column, term, idx, tf, df, idf): the most frequent terms, numbered in alphabetical order.

    The result has ``max_tfidf_features`` rows at most, so it is made on the driver from one top-k job. Terms of several words
    are counted among the frequent words only (`_frequent_words`), which leaves the result as it is.
    """
    everything = F.col("term") == ALL_DOCUMENTS
    among = _frequent_words(df, column, config)
    best = term_counts(df, column, config, among).orderBy(F.desc(everything), F.desc("tf"), F.asc("term")).limit(config.max_tfidf_features + 1).collect()
    documents = sum(r["df"] for r in best if r["term"] == ALL_DOCUMENTS)
    kept = sorted((r["term"], r["tf"], r["df"]) for r in best if r["term"] != ALL_DOCUMENTS)
    rows = [(column, t, i, tf, n, math.log((1 + documents) / (1 + n)) + 1) for i, (t, tf, n) in enumerate(kept)]
    return df.sparkSession.createDataFrame(rows, "column string, term string, idx int, tf bigint, df bigint, idf double")


def tfidf_vectors(df: DataFrame, column: str, vocabulary: list[tuple[str, float]], config: TextConfig, out: str) -> DataFrame:
    """Adds the normalised TF-IDF vector; ``vocabulary`` is (term, idf) in index order. No shuffle."""
    found, listed, counts, weighted = (f"{out}__{k}" for k in ("w", "t", "c", "x"))
    with_words = df.withColumn(found, words(F.coalesce(F.col(column), F.lit("")), stop_words(config)))
    with_terms = with_words.withColumn(listed, ngrams(F.col(found), config.ngram_range))
    counter = CountVectorizerModel.from_vocabulary([t for t, _ in vocabulary], inputCol=listed, outputCol=counts)
    weights = ElementwiseProduct(scalingVec=Vectors.dense([i for _, i in vocabulary]), inputCol=counts, outputCol=weighted)
    norm = Normalizer(p=2.0, inputCol=weighted, outputCol=out)
    return norm.transform(weights.transform(counter.transform(with_terms))).drop(found, listed, counts, weighted)
