"""Keywords of documents: the terms that weigh most by TF-IDF over the full vocabulary.

Each text is turned into (term, times) inside its row: one sort of its words and a comparison with the neighbour, no
shuffle. Document frequencies come from one row per document and term, combined map-side. They are joined back in two
ways: the terms that more than 1 / HOT_SHARE of all document terms are (at most HOT_SHARE of them) are broadcast, the rest,
none of which is hot, is joined by term. A rank limit keeps ``k`` terms per document and task before the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tabloom.session import cut_lineage, spread

HOT_SHARE = 1000
#: Fixed value: a word is a run of letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sorted_words(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)))


def word_times(column: str) -> Column:
    """array<struct<term, tf, size>> of a column of sorted words; size is the number of all words. It must be a column, not
    an expression, which would be evaluated again for every word."""
    ordered = F.col(column)
    # places where a new term begins, in a sorted list; the next one's place gives the number of times
    place = F.transform(ordered, lambda w, i: F.when((i == 0) | (F.get(ordered, i - 1) != w), i))
    begins = F.filter(place, lambda i: i.isNotNull())
    stops = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size(ordered)))
    return F.zip_with(begins, F.slice(stops, 1, F.greatest(F.size(begins), F.lit(0))), lambda b, e: F.struct(F.get(ordered, b).alias("term"), (e - b).cast("bigint").alias("tf"), F.size(ordered).cast("bigint").alias("size")))


def keywords(df: DataFrame, key: str, text: str, k: int = 5, min_df: int = 1) -> DataFrame:
    """(key, rank, term, tf, df, score): the ``k`` terms of each row with the greatest tf / words * ln((1 + n) / (1 + df)),
    equal ones in order of the term. n counts the rows with a word. Rows without one give nothing; rows that share a key
    are one document each and come out under that key."""
    rows = spread(df.select(F.col(key).alias("__doc"), F.col(text).alias("__text"))).select("__doc", F.monotonically_increasing_id().alias("__id"), sorted_words(F.col("__text")).alias("__words"))
    terms = cut_lineage(rows.select("__doc", "__id", F.explode(word_times("__words")).alias("e")).select("__doc", "__id", "e.*"))
    counts = cut_lineage(terms.groupBy("term").agg(F.count("*").alias("df")))
    total, cells = terms.agg(F.count_distinct("__id"), F.count("*")).first()
    inverse = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df")))
    weighed = counts.where(F.col("df") >= min_df).withColumn("__idf", inverse)
    floor = max(1, cells // HOT_SHARE)
    hot = weighed.where(F.col("df") > floor)  # each has over cells / HOT_SHARE rows, so there are fewer than HOT_SHARE
    cold = weighed.where(F.col("df") <= floor)
    common = terms.join(F.broadcast(hot), "term")
    names = F.broadcast(counts.where(F.col("df") > floor).select("term"))
    rare = terms.join(names, "term", "left_anti").join(cold, "term")
    best = Window.partitionBy("__id").orderBy(F.desc("score"), "term")
    scored = common.unionByName(rare).withColumn("score", F.col("tf") / F.col("size") * F.col("__idf"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("__doc").alias(key), "rank", "term", "tf", "df", "score")
