"""Tagging a catalog of column names with domains and semantic groups.

A catalog is a DataFrame (table, column). The dictionaries are fixed and small (under a hundred words),
so each name is tested against them in one projection: no join, no shuffle before the final counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words and name fragments of each domain.
DOMAIN_KEYWORDS = {
    "finance": ["price", "cost", "amount", "payment", "balance", "transaction", "credit", "debit", "loan", "interest"],
    "healthcare": ["age", "weight", "height", "blood", "pressure", "heart", "disease", "diagnosis", "treatment"],
    "ecommerce": ["product", "category", "brand", "rating", "review", "purchase", "customer", "order"],
    "transportation": ["speed", "distance", "time", "route", "vehicle", "fuel", "traffic", "journey"],
    "real_estate": ["area", "room", "bedroom", "bathroom", "floor", "location", "neighborhood", "sqft"],
    "text_analysis": ["text", "comment", "review", "description", "title", "content", "message"],
    "time_series": ["date", "time", "timestamp", "year", "month", "day", "hour"],
}
DOMAIN_PATTERNS = {
    "finance": ["price", "cost", "amount", "balance"],
    "healthcare": ["age", "weight", "height", "blood", "bmi"],
    "ecommerce": ["product", "category", "brand", "rating"],
    "transportation": ["speed", "distance", "time", "fuel"],
    "real_estate": ["area", "room", "bedroom", "sqft", "floor"],
    "text_analysis": ["text", "comment", "review", "description"],
    "time_series": ["date", "time", "timestamp"],
}
SEMANTIC_GROUPS = {
    "identifiers": ["id", "key", "index", "identifier"],
    "measurements": ["size", "length", "width", "height", "weight", "area"],
    "categories": ["type", "category", "class", "group", "kind"],
    "temporal": ["date", "time", "year", "month", "day", "hour"],
}
# Advice given per domain; the word is what an applicable column must hold ("" = always).
DOMAIN_ADVICE = {
    "finance": [
        ("price", "Prices are often skewed: try their logarithm"),
        ("price", "Relate prices to each other and to their former values"),
    ],
    "healthcare": [
        ("=age", "Ages can be grouped into stages of life"),
        ("weight|height", "Weight over squared height gives the body mass index"),
    ],
    "real_estate": [("area|sqft", "Divide areas by the number of rooms")],
    "time_series": [
        ("", "Split time stamps into calendar parts"),
        ("", "Add earlier values and moving averages"),
    ],
}


def _hits(name: Column, dictionary: dict[str, list[str]], label: str, weight: int) -> list[Column]:
    low = F.lower(name)
    return [
        F.when(low.contains(word), F.struct(F.lit(group).alias(label), F.lit(word).alias("word"), F.lit(weight).alias("weight")))
        for group, words in dictionary.items()
        for word in words
    ]


def domain_matches(catalog: DataFrame) -> DataFrame:
    """(table, column, domain, word, weight): 2 per keyword found in the name, 1 per pattern."""
    name = F.col("column")
    hits = _hits(name, DOMAIN_KEYWORDS, "domain", 2) + _hits(name, DOMAIN_PATTERNS, "domain", 1)
    return catalog.select("table", "column", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(
        "table", "column", "h.*"
    )


def domain_scores(catalog: DataFrame) -> DataFrame:
    return domain_matches(catalog).groupBy("table", "domain").agg(F.sum("weight").alias("score"))


def semantic_groups(catalog: DataFrame) -> DataFrame:
    """(table, column, semantic_group), once per group whatever the number of words that match."""
    low = F.lower(F.col("column"))
    tags = [F.when(low.rlike("|".join(words)), F.lit(group)) for group, words in SEMANTIC_GROUPS.items()]
    return catalog.select("table", "column", F.explode(F.array_compact(F.array(*tags))).alias("semantic_group"))


def rank_domains(catalog: DataFrame) -> DataFrame:
    """Scores plus 1 per text column and 2 per date column; catalog needs ``detected_type``."""
    extra = catalog.select(
        "table",
        F.when(F.col("detected_type") == "text", "text_analysis").when(F.col("detected_type") == "datetime", "time_series").alias("domain"),
        F.when(F.col("detected_type") == "text", 1).otherwise(2).alias("weight"),
    ).where(F.col("domain").isNotNull())
    return (
        domain_matches(catalog).select("table", "domain", "weight").unionByName(extra)
        .groupBy("table", "domain").agg(F.sum("weight").alias("score")).where(F.col("score") > 0)
    )


def domain_columns(catalog: DataFrame) -> DataFrame:
    """(table, domain, column): the columns a domain's techniques apply to."""
    return domain_matches(catalog).select("table", "domain", "column").distinct()


def domain_advice(catalog: DataFrame) -> DataFrame:
    """(table, domain, message) for the advice whose condition some applicable column meets."""
    hits = []
    for domain, entries in DOMAIN_ADVICE.items():
        for word, message in entries:
            low = F.lower(F.col("column"))
            meets = low == word[1:] if word.startswith("=") else low.rlike(word) if word else F.lit(True)
            hits.append(F.when((F.col("domain") == domain) & meets, F.lit(message)))
    return (
        domain_columns(catalog).select("table", "domain", F.explode(F.array_compact(F.array(*hits))).alias("message")).distinct()
    )


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """The columns of several DataFrames as one catalog."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c) for t, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table string, column string")
